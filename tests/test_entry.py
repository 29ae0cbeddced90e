"""Driver contract smoke test: entry() runs, and a set of headline queries agree with their
DuckDB twins at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from fpengine.sources.tables import TABLES

from .conftest import SF001

HEADLINE = ["RT1_local_retrieval", "JN8_shared_feature_neighbors", "WIN2_kfold_split", "ML7_tfidf",
            "PRJ6_9_flatten_services", "AGG8_AGG9_entropy_importance", "RT3_reasoning_paths", "JN17_positional_forward_asof"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"query_id", "neighbor_id", "similarity_score"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", HEADLINE)
def test_oracle_agreement(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = E.queries()[name](spark, SF001)
    res = con.execute(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(d[0] for d in res.description)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in res.description], res.fetchall())
