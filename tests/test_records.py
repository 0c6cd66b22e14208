"""CSV records with quoted line breaks, cut in several byte ranges."""

import csv

import pytest
from pyspark.sql import functions as F

from shelfspark.schemas import schema_of
from shelfspark.sources import staging
from shelfspark.sources.records import lines, read_records, record_count
from shelfspark.sources.staging import read_csv, rejected_counts, stage_csv, typed, write_csv

SCHEMA = ["override_id", "sku_id", "channel_id", "center_id", "effective_from", "effective_to", "override_type", "override_value",
          "override_reason", "created_at", "created_by", "approval_status"]
REASON = ['plain', 'two\nlines', 'a "quoted" word', 'one "\n" in quotes\n\nand a blank line', '', 'x' * 50, '\n', 'comma, and\r\nreturn']


def write(path, rows, newline="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator=newline)
        writer.writerow(SCHEMA)
        writer.writerows(rows)


def overrides(n):
    return [[f"X{k}", "S1", "A", "C1", "2025-01-13", "2025-01-19", "FORCE_HOLD", "", REASON[k % len(REASON)] + str(k),
             "2025-01-01T09:00:00", "me", "APPROVED"] for k in range(n)]


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "1000")
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_records_over_many_ranges(spark, tmp_path, small_ranges, newline):
    (tmp_path / "f").mkdir()
    given = overrides(200)
    write(tmp_path / "f" / "a.csv", given[:150], newline)
    write(tmp_path / "f" / "b.csv", given[150:], newline)
    path, schema = str(tmp_path / "f"), schema_of("manual_overrides")
    assert lines(spark, path).select("file", "block").distinct().count() > 10
    assert record_count(spark, path, True) == 200
    found = {row.override_id: row.override_reason for row in read_records(spark, path, schema).collect()}
    assert found == {row[0]: row[8] or None for row in given}


def test_a_record_longer_than_several_ranges(spark, tmp_path, small_ranges):
    rows = overrides(3)
    rows[1][8] = "\n".join(f"line {k}, with \"quotes\"" for k in range(400))
    write(tmp_path / "a.csv", rows)
    path = str(tmp_path / "a.csv")
    assert record_count(spark, path, True) == 3
    found = read_records(spark, path, schema_of("manual_overrides")).collect()
    assert sorted(r.override_reason for r in found) == sorted(r[8] for r in rows)


def test_staging_files_with_line_breaks(spark, tmp_path):
    write(tmp_path / "manual_overrides.csv", overrides(40))
    out = str(tmp_path / "out")
    assert stage_csv(spark, str(tmp_path), out, ["manual_overrides"], multi_line=True) == {"manual_overrides": 40}


def test_quotes_survive_a_round_trip(spark, tmp_path):
    schema = schema_of("manual_overrides")
    write(tmp_path / "a.csv", overrides(16))
    given = typed(read_records(spark, str(tmp_path / "a.csv"), schema), schema)
    single = given.filter(~F.contains("override_reason", F.lit("\n")) & ~F.contains("override_reason", F.lit("\r")))
    write_csv(single, str(tmp_path / "b.csv"))
    again = read_csv(spark, str(tmp_path / "b.csv"), schema)
    assert again.count() == 8 and again.exceptAll(single).isEmpty()


def test_a_lost_record_is_reported(spark, tmp_path, monkeypatch):
    write(tmp_path / "manual_overrides.csv", overrides(40))

    def losing(spark, path, schema):
        return read_records(spark, path, schema).filter(F.col("override_id") != "X7")

    monkeypatch.setattr(staging, "read_records", losing)
    with pytest.raises(ValueError, match="40 records in the file, 39 rows read, 39 stored"):
        stage_csv(spark, str(tmp_path), str(tmp_path / "out"), ["manual_overrides"], multi_line=True)


def test_open_quotes_wrong_headers_and_empty_files(spark, tmp_path):
    schema = schema_of("manual_overrides")
    write(tmp_path / "open.csv", overrides(2))
    with open(tmp_path / "open.csv", "a") as file:
        file.write('X9,"never closed\n')
    with pytest.raises(ValueError, match="never closed in: .*open.csv"):
        record_count(spark, str(tmp_path / "open.csv"), True)
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="header is not override_id"):
        read_records(spark, str(tmp_path / "other.csv"), schema).collect()
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("﻿" + ",".join(SCHEMA) + "\n\n", encoding="utf-8")
    for name in ("empty.csv", "header.csv"):
        path = str(tmp_path / name)
        rows = read_records(spark, path, schema)
        assert rows.agg(*rejected_counts(schema)).count() == 1 and rows.count() == 0
        assert record_count(spark, path, True) == record_count(spark, path, False) == 0
