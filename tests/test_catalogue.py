"""Every catalogue query on the smallest tables; those with SQL against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.plans import catalogue, services  # noqa: F401  services registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def as_text(df, columns):
    df = df[columns].astype(object)
    return df.where(df.notna(), None).map(lambda v: repr(float(v)) if isinstance(v, float) else str(v)).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert as_text(got, columns).equals(as_text(want, columns))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "aspect" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(SF)


def test_upserts_and_labels_leave_no_row_out(spark, duck):
    ids, docs = (duck.execute(f"select count(*) from {t}").fetchone()[0] for t in ("customer", "labels"))
    for name in ("ups4_upsert_keep_all", "ups6_upsert_overwrite_all"):
        assert catalogue.QUERIES[name](spark, SF).where("k >= 5").count() == ids
    got = catalogue.QUERIES["joi9_set1_set2_label_match_all"](spark, SF)
    assert got.select("doc_id").distinct().count() == docs
    assert {r.outcome for r in got.select("outcome").distinct().collect()} == {"missed", "extra", "exact", "matched"}
