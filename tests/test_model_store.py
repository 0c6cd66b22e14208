"""The store of models and tables: what is loaded again, what starts anew, and what a dead process leaves."""

import time

import pytest
from fixtures import SCOPE
from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F
from test_features import busy_sources

from shelfspark.plans.decisions import ModelStages
from shelfspark.plans.features import feature_table
from shelfspark.plans.model_store import FOLDER_SETTING, ModelStore


@pytest.fixture()
def source(spark, tmp_path):
    spark.conf.set(FOLDER_SETTING, str(tmp_path / "models"))
    path = str(tmp_path / "source.parquet")
    spark.range(10).write.parquet(path)
    yield path
    spark.conf.unset(FOLDER_SETTING)


def never():
    raise AssertionError("this is stored already")


def test_tables_are_built_once(spark, source):
    store = ModelStore(spark, [source], rounds=3)
    assert not store.has("t")
    assert store.table("t", lambda: spark.range(5)).count() == 5
    again = ModelStore(spark, [source], rounds=3)
    assert again.has("t") and again.table("t", never).count() == 5


def test_models_are_fitted_once(spark, source):
    store = ModelStore(spark, [source])
    pipeline = Pipeline(stages=[SQLTransformer(statement="SELECT id + 1 AS next FROM __THIS__")])
    store.model("m", lambda: pipeline.fit(spark.range(1)))
    loaded = ModelStore(spark, [source]).model("m", never)
    assert loaded.transform(spark.range(1)).first().next == 1


def test_other_files_or_parameters_start_anew(spark, source):
    first = ModelStore(spark, [source], rounds=3).root
    assert ModelStore(spark, [source], rounds=4).root != first
    assert ModelStore(spark, [source], rounds=3).root == first
    time.sleep(0.01)
    spark.range(3).write.mode("append").parquet(source)
    assert ModelStore(spark, [source], rounds=3).root != first


def test_an_unfinished_version_does_not_count(spark, source):
    """A process that dies while it writes leaves files, but no marker."""
    store = ModelStore(spark, [source])
    spark.range(2).write.parquet(f"{store.root}/t/dead")
    with pytest.raises(RuntimeError):
        store.table("t", lambda: (_ for _ in ()).throw(RuntimeError("died")))
    assert not store.has("t")
    assert store.table("t", lambda: spark.range(7)).count() == 7


def test_of_two_that_end_at_once_one_counts(spark, source):
    store = ModelStore(spark, [source])

    def late():
        store.table("t", lambda: spark.range(1))  # another process is faster
        return spark.range(2)

    found = store.table("t", late)
    assert found.count() in (1, 2)
    assert store.table("t", never).count() == found.count() == ModelStore(spark, [source]).table("t", never).count()


def test_a_later_process_loads_models_and_predictions(spark, source):
    def features():
        return feature_table(busy_sources(spark), SCOPE)

    first = ModelStages.stored(ModelStore(spark, [source]), features, rounds=3, depth=2)
    made = [t.orderBy(*t.columns[:4]).collect() for t in first.predictions()]
    later = ModelStages.stored(ModelStore(spark, [source]), never, rounds=3, depth=2)
    later._model = lambda *_: never()
    assert [t.orderBy(*t.columns[:4]).collect() for t in later.predictions()] == made
    model = ModelStages.stored(ModelStore(spark, [source]), never, rounds=3, depth=2).demand_model
    assert len(model.stages[-1].trees) == 3 and first.kpis().filter(F.col("kpi_value").isNotNull()).count() > 0
