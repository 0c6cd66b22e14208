"""Run queries next to their SQL twins and report differences.

Usage: python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Values as text (numbers by repr), columns and rows in a fixed order."""
    out = {}
    for name in sorted(frame.columns):
        column = frame[name]
        if pd.api.types.is_numeric_dtype(column):
            text = column.astype("float64").map(lambda v: "" if pd.isna(v) else repr(v + 0.0))
        elif pd.api.types.is_datetime64_any_dtype(column):
            text = column.dt.strftime("%Y-%m-%d %H:%M:%S").fillna("")
        else:
            text = column.map(lambda v: "" if v is None or v is pd.NaT or v != v else
                              repr(float(v)) if isinstance(v, (int, float)) or
                              type(v).__name__ == "Decimal" else str(v))
        out[name] = text.astype(str).str.removesuffix(" 00:00:00")
    table = pd.DataFrame(out)
    return table.sort_values(list(table.columns), ignore_index=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(set(ours.columns) ^ set(theirs.columns))}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    a, b = _canonical(ours), _canonical(theirs)
    if a.equals(b):
        return None
    off = a.ne(b)
    names = [name for name in a.columns if off[name].any()]
    first = off.any(axis=1).idxmax()
    return (f"{int(off.any(axis=1).sum())} rows differ in {names}; first: "
            f"{a.loc[first, names].to_dict()} != {b.loc[first, names].to_dict()}")


def main() -> None:
    from shelfspark.session import build_session

    import __spark_entry__ as spark_entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, sql = spark_entry.queries(), spark_entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.sql.execution.arrow.pyspark.enabled": "true"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            ours = queries[name](spark, folder).toPandas()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{name}: SPARK {str(error)[:600]}", flush=True)
            continue
        middle = time.time()
        verdict = f"{len(ours)} rows, no SQL"
        if name in sql:
            try:
                theirs = con.execute(sql[name]).df()
                verdict = difference(ours, theirs)
                bad += verdict is not None
                verdict = verdict or f"ok, {len(ours)} rows"
            except Exception as error:  # noqa: BLE001
                bad += 1
                verdict = f"DUCKDB {str(error)[:600]}"
        print(f"{name}: {verdict} (spark {middle - started:.1f}s, sql "
              f"{time.time() - middle:.1f}s)", flush=True)
    print(f"{bad} of {len(names)} differ")


if __name__ == "__main__":
    main()
