"""The inverted file (VEC5) against an exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fpengine.operators import inverted
from fpengine.operators.inverted import VectorIndex


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "id long, vec array<double>")


def queries(df):
    return df.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))


def best(x, ids, q, k, skip=None):
    s = x @ q
    return [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != skip][:k]


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    return out


def grouped(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("limits", [None, (16, 8, 32)])
def test_all_cells_and_full_depth_are_exact(spark, tmp_path, monkeypatch, limits):
    """With every cell probed and no cut by codes the result is the exact one, ties by id, also when cells and their queries are cut into pieces."""
    if limits:
        for name, v in zip(("SLICE_ROWS", "PART_QUERIES", "CHUNK"), limits):
            monkeypatch.setattr(inverted, name, v)
    x = grouped(150, 6, 1)
    x[40:90] = x[3]  # a third of all rows are one vector
    df = frame(spark, x)
    index = VectorIndex.build(df, str(tmp_path / "i"))
    got = answers(index.search(queries(df), 4, probes=1000, depth=150, exclude_same_id=True))
    ids = np.arange(len(x))
    scores = np.round(x @ x.T, 12)
    for q in range(len(x)):
        want = [int(i) for i in np.lexsort((ids, -scores[q])) if i != q][:4]
        assert [(r, round(s, 9)) for r, _, s in got[q]] == [(r + 1, round(float(scores[q, i]), 9)) for r, i in enumerate(want)]
        if len(set(scores[q])) == len(x):
            assert [i for _, i, _ in got[q]] == want
    assert [i for _, i, _ in got[3]] == [40, 41, 42, 43]


def test_tuned_recall(spark, tmp_path):
    x = grouped(1500, 20, 2)  # 20 = five slices
    df = frame(spark, x)
    index = VectorIndex.build(df, str(tmp_path / "i"), metric="cosine")
    state = index.tune(5, aim=0.95, queries=100)
    assert state["recall"] >= 0.95 and index.probes < 39  # fewer than all cells
    got = answers(index.search(queries(df), 5, exclude_same_id=True))
    ids = np.arange(len(x))
    hits = sum(len({i for _, i, _ in got[q]} & set(best(x, ids, x[q], 5, q))) for q in range(len(x)))
    assert hits / (5 * len(x)) >= 0.9
    for q in (0, 7, 1499):
        for _, i, s in got[q]:
            assert abs(s - x[q] @ x[i]) < 1e-9


def test_appends(spark, tmp_path):
    x = grouped(300, 8, 3)
    path = str(tmp_path / "i")
    VectorIndex.build(frame(spark, x[:200]), path)
    index = VectorIndex(spark, path)  # another session's view of the folder
    model = index.model().value[0].copy()
    assert index.append(frame(spark, x[150:], range(150, 300))) == 100
    assert index.append(frame(spark, x[150:], range(150, 300))) == 0  # a repeated append stores nothing
    assert np.array_equal(VectorIndex(spark, path).model().value[0], model)
    assert index.rows().count() == 300 == index.rows().select("id").distinct().count()
    # rows of a batch that did not finish are not seen, and the next append replaces them
    index.rows().select(F.col("id") + 1000, "cell", "code", "vec").write.parquet(f"{path}/rows/batch=3")
    assert index.rows().count() == 300
    assert index.append(frame(spark, x[:1], [5000])) == 1
    assert index.rows().count() == 301
    got = answers(index.search(queries(frame(spark, x[290:], range(290, 300))), 1, probes=1000, depth=400))
    assert {q: v[0][1] for q, v in got.items()} == {q: q for q in range(290, 300)}


def test_defined_results(spark, tmp_path):
    schema = "id long, vec array<double>, score double, cell int"
    rows = [(1, [1.0, 0.0], 0.0, 9), (2, None, 0.0, 9), (3, [float("nan"), 1.0], 0.0, 9), (4, [None, 1.0], 0.0, 9), (5, [float("inf"), 1.0], 0.0, 9),
            (6, [0.0, 0.0], 0.0, 9), (None, [1.0, 1.0], 0.0, 9), (7, [0.6, 0.8], 0.0, 9), (7, [0.6, 0.8], 0.0, 9), (8, [1.0, 0.0], 0.0, 9), (9, [1.0], 0.0, 9)]
    df = spark.createDataFrame(rows, schema)
    index = VectorIndex.build(df, str(tmp_path / "c"), metric="cosine")
    assert sorted(r.id for r in index.rows().collect()) == [1, 7, 8]
    got = answers(index.search(queries(df), 2, probes=9, depth=9))
    assert set(got) == {1, 7, 8}
    assert [i for _, i, _ in got[1]] == [1, 8] == [i for _, i, _ in got[8]]
    empty = VectorIndex.build(df.limit(0), str(tmp_path / "e"))
    assert empty.search(queries(df), 2).count() == 0 and empty.tune(2)["recall"] == 1.0
    assert empty.append(df) == 4  # without cosine the zero vector stays
    assert empty.search(queries(df), 1, probes=9).count() > 0


def test_registered_search_asks_every_hundredth_id_against_all(spark, tmp_path):
    """VEC5 indexes all rows; the queries are the ids divisible by 100, and their neighbours may have any id."""
    from fpengine.plans import registry
    registry.load_all()
    x = grouped(730, 64, 11)
    frame(spark, x).select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding"), F.lit(0).alias("label")) \
        .write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = registry.QUERIES["VEC5_ivf_topk"](spark, str(tmp_path)).collect()
    assert sorted({r.query_id for r in rows}) == list(range(0, 730, 100))
    assert any(r.id % 100 for r in rows)
    assert np.mean([r.recall_at_5 for r in rows]) >= 0.9
