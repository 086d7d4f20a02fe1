"""The entry point's contract, and some of its queries against SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["detect_email", "detect_inn", "detect_person", "detect_url", "mask_documents", "interval_union_bytes", "eval_contract", "events_hourly_findings", "finding_errors", "suite_rows_strict", "map_labels", "placeholders_distinct", "detect_inn_12", "eval_by_label"]


def same(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(entry.oracle_sql()[name]).to_arrow_table()
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.column_names)
    order = sorted(got.columns)
    rows = lambda table: sorted(map(repr, (tuple(r[c] for c in order) for r in table)))
    assert rows([r.asDict() for r in got.collect()]) == rows(want.to_pylist())


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    same(spark, name)


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "entity", "findings", "documents"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
