"""Distributed operators against small brute-force references (numpy / pandas)."""


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fpengine.operators import aggregate as A
from fpengine.operators import cluster as CL
from fpengine.operators import graph as G
from fpengine.operators import knn
from fpengine.operators import windows as W


def test_exact_topk_matches_numpy(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 8))
    X[5] = X[6]                                  # exact tie
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, vec array<double>")
    q = df.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    res = knn.exact_topk(q, df, 4, exclude_same_id=True, queries_per_block=64, corpus_rows_per_block=70,
                         chunk_rows=33).toPandas()
    S = X @ X.T
    np.fill_diagonal(S, -np.inf)
    for qi in range(len(X)):
        order = sorted(range(len(X)), key=lambda j: (-S[qi, j], j))[:4]
        got = res[res.query_id == qi].sort_values("rank").id.tolist()
        assert got == order


def test_range_pairs_matches_numpy(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, vec array<double>")
    got = {(r.src, r.dst) for r in knn.exact_range_pairs(df, 0.8, points_per_block=30).collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    want = {(i, j) for i in range(len(X)) for j in range(len(X)) if i != j and D[i, j] <= 0.8}
    assert got == want


def _dbscan_numpy(X, eps, min_samples, min_size):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    nb = [set(np.nonzero((D[i] <= eps) & (np.arange(n) != i))[0]) for i in range(n)]
    core = [len(nb[i]) + 1 >= min_samples for i in range(n)]
    comp = list(range(n))

    def find(a):
        while comp[a] != a:
            comp[a] = comp[comp[a]]
            a = comp[a]
        return a
    for i in range(n):
        if core[i]:
            for j in nb[i]:
                if core[j]:
                    a, b = find(i), find(j)
                    comp[max(a, b)] = min(a, b)
    label = {}
    for i in range(n):
        if core[i]:
            label[i] = find(i)
    for i in range(n):
        if not core[i]:
            cands = [label[j] for j in nb[i] if core[j]]
            if cands:
                label[i] = min(cands)
    sizes = pd.Series(label).value_counts()
    kept = sorted(c for c, s in sizes.items() if s >= min_size)
    dense = {c: k for k, c in enumerate(kept)}
    out = [dense.get(label.get(i, -2), -1) for i in range(n)]
    if all(o == -1 for o in out):
        out = [0] * n
    return out


def test_dbscan_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    blobs = [rng.normal(loc=c, scale=0.15, size=(40, 2)) for c in ((0, 0), (3, 3), (0, 4))]
    X = np.vstack(blobs + [rng.uniform(-2, 6, size=(15, 2)), rng.normal(loc=(6, 0), scale=0.1, size=(8, 2))])
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, vec array<double>")
    got = {r.id: r.cluster for r in CL.dbscan(df, eps=0.35, min_samples=4, min_cluster_size=20).collect()}
    want = _dbscan_numpy(X, 0.35, 4, 20)
    assert [got[i] for i in range(len(X))] == want
    assert len(set(want) - {-1}) == 3


def test_connected_components_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    verts = spark.range(n).select(F.col("id"))
    labels = CL.connected_components(verts, edges)
    assert {r.component for r in labels.collect()} == {0}


def test_distributed_row_number_matches_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], size=500, p=[.7, .2, .1]), "v": rng.permutation(500)})
    df = spark.createDataFrame(pdf)
    got = W.distributed_row_number(df, ["g"], ["v"], num_partitions=7).toPandas().sort_values(["g", "v"])
    want = pdf.sort_values(["g", "v"]).assign(rn=lambda d: d.groupby("g").cumcount() + 1)
    assert got.rn.tolist() == want.rn.tolist()


def test_next_match_matches_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(int(u), int(t), bool(rng.random() < 0.3)) for t, u in enumerate(rng.integers(0, 4, size=300))]
    df = spark.createDataFrame(rows, "u long, t long, hit boolean")
    got = {r.t: r.nxt for r in W.next_match(df, ["u"], ["t"], F.col("hit"), F.col("t"), "nxt", num_partitions=5).collect()}
    for u, t, _ in rows:
        later = [t2 for u2, t2, h2 in rows if u2 == u and t2 > t and h2]
        assert got[t] == (min(later) if later else None)


def test_exact_median(spark):
    vals = [5.0, 1.0, 9.0, 3.0, 7.0, 2.0]
    df = spark.createDataFrame([(v, "x" if i % 2 else "y") for i, v in enumerate(vals)], "v double, g string")
    m = A.exact_quantile(df, "v").first()["median"]
    assert m == np.median(vals)
    per = {r.g: r.median for r in A.exact_quantile(df, "v", ["g"]).collect()}
    assert per == {"y": np.median([5.0, 9.0, 7.0]), "x": np.median([1.0, 3.0, 2.0])}


def test_radix_quantiles(spark):
    """Signs, zeros, ties, tiny and huge values, groups with a null key, several quantiles; no value is moved by a range exchange."""
    rng = np.random.default_rng(12)
    groups = {"a": rng.normal(size=301), "b": np.concatenate([-10.0 ** rng.uniform(-300, 300, 50), [0.0, -0.0, 5e-324, 1e308]]), "c": np.repeat([2.5, -1.0], 40),
              None: 1 + rng.integers(0, 50, size=100) * 2.0 ** -52, "one": np.array([3.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {r.g: r.x for r in A.exact_quantile(df, "v", ["g"], q, "x").collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            v, pos = sorted(vs), (len(vs) - 1) * q
            lo, hi = v[int(np.floor(pos))], v[int(np.ceil(pos))]
            assert got[g] == (lo if pos == int(pos) else lo + (hi - lo) * (pos - np.floor(pos)))
    every = [v for _, v in rows if v is not None]
    res = A.exact_quantile(df, "v")
    assert res.first()["median"] == np.median(every)
    assert A.exact_quantile(df.where("v IS NULL"), "v").first()["median"] is None
    assert "rangepartitioning" not in res._jdf.queryExecution().toString()


def test_shared_neighbors_bruteforce(spark):
    rng = np.random.default_rng(6)
    n, f = 60, 4
    vals = rng.integers(0, 3, size=(n, f))
    dev = spark.createDataFrame([(i, *[str(v) for v in vals[i]]) for i in range(n)],
                                "id long, " + ", ".join(f"c{j} string" for j in range(f)))
    seeds_rows = [(q, s) for q in range(10) for s in rng.choice(n, size=3, replace=False).tolist()]
    seeds = spark.createDataFrame(seeds_rows, "query_id long, seed_id long")
    got = G.shared_feature_neighbors(dev, "id", [f"c{j}" for j in range(f)], seeds, q=1, k=5, degree=4).toPandas()
    for q in range(10):
        sd = {s for qq, s in seeds_rows if qq == q}
        best = {}
        for s in sd:
            for b in range(n):
                if b == s:
                    continue
                c = int((vals[s] == vals[b]).sum())
                if c > 1:
                    best[b] = max(best.get(b, 0), c)
        want = sorted(((b, c) for b, c in best.items() if b not in sd), key=lambda x: (-x[1], x[0]))[:5]
        have = got[got.query_id == q].sort_values("rank")
        assert list(zip(have.neighbor_id, have.shared_count)) == want


@pytest.mark.parametrize("degree", [256, 5, 0])
def test_shared_neighbors_many_overlapping_seeds(spark, degree):
    rng = np.random.default_rng(8)
    n, f = 30, 3
    vals = rng.integers(0, 2, size=(n, f))
    dev = spark.createDataFrame([(i, *[str(v) for v in vals[i]]) for i in range(n)],
                                "id long, " + ", ".join(f"c{j} string" for j in range(f)))
    seeds_rows = [(q, int(s)) for q in range(12) for s in rng.choice(n, size=8, replace=False)]
    extra = [(q, q) for q in range(12)]
    seeds = spark.createDataFrame(seeds_rows, "query_id long, seed_id long")
    excl = spark.createDataFrame(extra, "query_id long, neighbor_id long")
    got = G.shared_feature_neighbors(dev, "id", [f"c{j}" for j in range(f)], seeds, q=1, k=4, exclude=excl,
                                     degree=degree, depth=2).toPandas()
    for q in range(12):
        sd = {s for qq, s in seeds_rows if qq == q}
        best = {}
        for s in sd:
            for b in range(n):
                if b != s and int((vals[s] == vals[b]).sum()) > 1:
                    best[b] = max(best.get(b, 0), int((vals[s] == vals[b]).sum()))
        want = sorted(((b, c) for b, c in best.items() if b not in sd and b != q), key=lambda x: (-x[1], x[0]))[:4]
        have = got[got.query_id == q].sort_values("rank")
        assert list(zip(have.neighbor_id, have.shared_count)) == want


@pytest.mark.parametrize("q", [0, 1, 3])
def test_shared_neighbors_hub_blank_25_columns(spark, q):
    """25 columns, a blank that a third of the devices hold in most of them, copies of whole devices, light and heavy nodes."""
    rng = np.random.default_rng(20 + q)
    n, f = 240, 25
    vals = rng.integers(0, 40, size=(n, f))
    vals[:, :6] = rng.integers(0, 4, size=(n, 6))
    blank = rng.permutation(n)[:n // 3]
    vals[np.ix_(blank, np.arange(8, 22))] = -1
    vals[200:] = vals[rng.integers(0, 3, size=40)]
    rows = [(i, "t", *[None if v < 0 else str(v) for v in vals[i]]) for i in range(n)]
    cols = [f"c{j}" for j in range(f)]
    dev = spark.createDataFrame(rows, "id long, kind string, " + ", ".join(f"{c} string" for c in cols))
    seeds_rows = [(z, int(s)) for z in range(25) for s in rng.choice(n, size=4, replace=False)] + [(99, int(b)) for b in blank] + [(98, 10_000)]
    seeds = spark.createDataFrame(seeds_rows, "query_id long, seed_id long")
    got = {}
    for r in G.shared_feature_neighbors(dev, "id", cols, seeds, q=q, k=5, type_col="kind", degree=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.neighbor_id, r.shared_count, r.device_type))
    same = (vals[:, None, :] == vals[None, :, :]).sum(axis=2)
    for z in {z for z, _ in seeds_rows}:
        sd = {s for y, s in seeds_rows if y == z and s < n}
        best = {b: max(int(same[s, b]) for s in sd) for b in range(n) if b not in sd} if sd else {}
        want = sorted(((b, c) for b, c in best.items() if c > q), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got.get(z, [])) == [(i, b, c, "t") for i, (b, c) in enumerate(want, 1)]


@pytest.mark.parametrize("few,short", [(64, 1024), (3, 1024), (64, 6)])
def test_lists_of_a_query_merge_alike_as_arrays_and_as_rows(spark, monkeypatch, few, short):
    """Queries with few excluded devices, hubs and deep lists take different ways to the same answer."""
    from fpengine.operators import sharing as SH

    monkeypatch.setattr(SH, "FEW", few)
    monkeypatch.setattr(SH, "SHORT", short)
    rng = np.random.default_rng(12)
    vals = rng.integers(0, 3, size=(60, 3)).tolist()
    seeds = [(q, int(d)) for q in range(12) for d in rng.choice(60, size=1 + q % 6, replace=False)]
    excl = [(q, int(d)) for q in range(12) for d in rng.choice(60, size=(0, 2, 30)[q % 3], replace=False)]
    dev = spark.createDataFrame([(i, *map(str, v)) for i, v in enumerate(vals)], "id long, a string, b string, c string")
    got = SH.shared_feature_neighbors(dev, "id", ["a", "b", "c"], spark.createDataFrame(seeds, "query_id long, seed_id long"), q=1, k=4,
                                      exclude=spark.createDataFrame(excl, "query_id long, neighbor_id long")).collect()
    want = set()
    for q in range(12):
        mine, gone = [d for p, d in seeds if p == q], {d for p, d in seeds + excl if p == q}
        best = {i: max(sum(x == y for x, y in zip(vals[i], vals[d])) for d in mine) for i in range(60) if i not in gone}
        want |= {(q, i, s, r + 1) for r, (s, i) in enumerate(sorted((-s, i) for i, s in best.items() if s > 1)[:4]) for s in (-s,)}
    assert {(r.query_id, r.neighbor_id, r.shared_count, r.rank) for r in got} == want


def test_merged_lists_are_one_row_per_query(spark):
    from fpengine.operators import sharing as SH

    asked = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 12)], "q long, sp long")
    lists = spark.createDataFrame([(10, 5, 2), (10, 6, 2), (11, 5, 3), (11, 7, 2), (11, 8, 2)], "sp long, neighbor long, s int")
    got = {r.q: ([(x.s, x.neighbor) for x in r.top], tuple(r.last) if r.last else None) for r in
           SH._merged(asked, lists, spark.createDataFrame([(1, [7])], "q long, out array<long>"), 3, 2).collect()}
    assert got == {1: ([(-3, 5), (-2, 6)], (-2, 8)), 2: ([(-3, 5), (-2, 7)], (-2, 8))}
