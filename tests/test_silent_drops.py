"""Rows and quantities that used to vanish."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import purchasing, ranking
from shelfspark.operators.grids import PlanningScope
from shelfspark.schemas import schema_of


def test_missing_score_is_an_error(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None)], "label int, score double")
    with pytest.raises(Exception, match="has no score"):
        ranking.score_counts(rows, "label", "score").collect()


def test_lines_sharing_an_id_keep_their_quantities(spark):
    day = dt.date(2025, 1, 6)

    def rows(table, *values):
        schema = schema_of(table)
        return spark.createDataFrame([tuple(v.get(f.name) for f in schema.fields) for v in values], schema)

    line = {"po_id": "P", "po_line_id": "1", "po_created_date": day, "vendor_id": "V", "erp_sku_code": "E", "center_id": "C",
            "promised_delivery_date": dt.date(2025, 2, 3), "po_status": "OPEN", "cancelled_qty": 0, "ordered_qty": 10}
    orders = rows("erp_purchase_orders", {**line, "confirmed_qty": 10}, {**line, "confirmed_qty": 7})
    mapping = rows("sku_code_mapping", {"sku_id": "S", "source_system": "ERP", "source_sku_code": "E", "effective_from": day - dt.timedelta(30),
                                        "effective_to": None, "mapping_status": "VALID"})
    scope = PlanningScope(channels=("O",), centers=("C",), first_week="2025-01-06", last_week="2025-01-27")
    found = purchasing.po_segments(orders, rows("wms_goods_receipts"), mapping, scope)
    assert sorted(r["remaining_qty"] for r in found.select(F.col("remaining_qty")).collect()) == [7, 10]
