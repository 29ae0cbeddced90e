"""Blocks of the exact search: same rows as a full sort, and memory that does not follow the block's number of queries."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from fpengine.operators import knn


def block(nq, nc, dim, seed, whole):
    rng = np.random.default_rng(seed)
    draw = (lambda n: rng.integers(-2, 3, (n, dim)).astype(float)) if whole else (lambda n: rng.normal(size=(n, dim)))
    return pd.DataFrame({"q": np.arange(nq), "v": list(draw(nq))}), pd.DataFrame({"id": rng.permutation(nc), "w": list(draw(nc))})


@pytest.mark.parametrize("nq,nc,k,chunk", [(300, 900, 5, 64), (600, 500, 40, 16), (30, 3, 5, 2), (1, 9, 9, 4)])
def test_block_equals_full_sort(nq, nc, k, chunk):
    q, c = block(nq, nc, 3, nq, True)  # whole numbers: many ties
    got = knn._block_search(k, "q", "v", "id", "w", True, chunk, [])(q, c)
    score, ids = np.stack(q["v"]) @ np.stack(c["w"]).T, c["id"].to_numpy()
    for i in range(nq):
        want = [j for j in np.lexsort((ids, -score[i])) if ids[j] != i][:k]
        mine = got[got["q"] == i].sort_values(["score", "id"], ascending=[False, True])
        assert mine["id"].tolist() == ids[want].tolist() and mine["score"].tolist() == score[i][want].tolist()


def test_a_full_block_needs_little_memory():
    q, c = block(2048, 8192, 16, 1, False)
    run = knn._block_search(5, "q", "v", "id", "w", False, 4096, [])
    tracemalloc.start()
    run(q, c)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 80, peak


def test_rows_are_not_copied_for_every_block(spark):
    """However many blocks the other side has, a row travels inside its own block; the result is that of one block."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 7) for i in range(400)]
    c = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    q = c.selectExpr("id as query_id", "vec as qvec")
    many = knn.exact_topk(q, c, 5, payload=("label",), exclude_same_id=True, queries_per_block=20, corpus_rows_per_block=10)
    one = knn.exact_topk(q, c, 5, payload=("label",), exclude_same_id=True, min_corpus_blocks=1)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.score, r.label) for r in df.collect())
    assert key(many) == key(one)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan and "CartesianProduct" in plan


def test_a_block_is_alone_in_its_partition(spark):
    from pyspark.sql import functions as F
    df = spark.range(1_000).withColumn("vec", F.array(F.lit(1.0)))
    got = knn._block_rows(df, "id", 37, "_q").select(F.spark_partition_id().alias("p"), F.size("_q").alias("n")).collect()
    assert sorted(r.p for r in got) == list(range(37)) and sum(r.n for r in got) == 1_000
