import pytest


@pytest.fixture()
def frame(spark):
    """Rows of documents, with a column whose name others use."""
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, score double"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)
    return make
