"""The driver's contract, and the queries' SQL over the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gleanery.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
#: One query of each family; the driver runs them all.
SOME = ["win01_agg18_joi13_rejected_advantage", "win03_best_of_group", "agg09_expected_best", "txt01_clean_html", "txt28_answer_f1", "cnv02_turn_rows", "cnv03_merged_observations", "set02_interleave_first", "srt08_srt09_shuffled_split", "win34_sample_index", "sql01_trace_upsert", "agg10_majority", "evl14_domain_rollup", "agg02_degrees"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", SOME)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(DATA))
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(_norm, r)) for r in df.collect()) == sorted(tuple(_norm(r[i]) for i in place) for r in want.fetchall())
