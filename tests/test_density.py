"""Density hierarchy against a plain one-machine hierarchy over all pairs."""
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from fpengine.operators import density as D

VEC = "id long, vec array<double>, kind string"


def brute(points, size, samples):
    """{id: (cluster, level)} by the definition: all pairs, merge tree, condensed tree top-down, larger stability wins."""
    groups = {}
    for i, v in points:
        groups.setdefault(tuple(v), []).append(i)
    pts = sorted((min(ids), v, ids) for v, ids in groups.items())
    n, w = len(pts), [len(p[2]) for p in pts]
    d = [[float(np.sqrt(((np.array(a[1]) - np.array(b[1])) ** 2).sum())) for b in pts] for a in pts]
    core = []
    for i in range(n):
        near, got, c = sorted((0.0 if j == i else d[i][j], w[j]) for j in range(n) if j != i), w[i], 0.0 if w[i] >= samples else np.inf
        for x, m in near:
            if got >= samples:
                break
            got, c = got + m, x
            c = x if got >= samples else np.inf
        core.append(c)
    links = sorted((max(core[i], core[j], d[i][j]), pts[i][0], pts[j][0], i, j) for i in range(n) for j in range(i + 1, n))
    node = [("leaf", i) for i in range(n)]
    weight = {("leaf", i): w[i] for i in range(n)}
    kids, of = {}, list(range(n))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for lvl, _, _, i, j in links:
        a, b = find(i), find(j)
        if a != b:
            of[b] = a
            new = ("in", len(kids))
            kids[new] = (node[a], node[b], lvl)
            weight[new] = weight[node[a]] + weight[node[b]]
            node[a] = new
    root = node[find(0)]

    def leaves(t):
        out, stack = [], [t]
        while stack:
            x = stack.pop()
            if x[0] == "leaf":
                out.append(x[1])
            else:
                stack += kids[x][:2]
        return out

    clusters = [dict(birth=0.0, parent=None, points={}, split=None, value=0.0, children=[])]
    todo = [(root, 0)] if weight[root] >= size else []
    while todo:
        t, c = todo.pop()
        while True:
            if t[0] == "leaf":  # copies alone are large
                clusters[c]["points"][t[1]] = 0.0
                break
            a, b, lvl = kids[t]
            big = [x for x in (a, b) if weight[x] >= size]
            if len(big) == 2:
                for x in big:
                    clusters.append(dict(birth=1 / max(lvl, D.FLOOR), parent=c, points={}, value=0.0, children=[]))
                    clusters[c]["children"].append((len(clusters) - 1, weight[x]))
                    todo.append((x, len(clusters) - 1))
                break
            for x in (a, b):
                if x not in big:
                    clusters[c]["points"].update((p, lvl) for p in leaves(x))
            if not big:
                break
            t = big[0]
    for c in clusters:
        c["value"] = sum(w[p] * (1 / max(lvl, D.FLOOR) - c["birth"]) for p, lvl in c["points"].items())
        c["value"] += sum(m * (clusters[k]["birth"] - c["birth"]) for k, m in c["children"])

    def best(k):
        below = sum(best(x)[0] for x, _ in clusters[k]["children"])
        picks = [p for x, _ in clusters[k]["children"] for p in best(x)[1]]
        if k == 0 or (clusters[k]["children"] and below > clusters[k]["value"]):
            return below, picks
        return clusters[k]["value"], [k]

    chosen = set(best(0)[1])
    label, level = {}, {}
    for k, c in enumerate(clusters):
        up = k
        while up is not None and up not in chosen:
            up = clusters[up]["parent"]
        for p, lvl in c["points"].items():
            label[p], level[p] = -1 if up is None else up, lvl
    order = {}
    for p in range(n):
        if label.get(p, -1) >= 0:
            order.setdefault(label[p], len(order))
    out = {}
    for p, (_, _, ids) in enumerate(pts):
        for i in ids:
            out[i] = (order.get(label.get(p, -1), -1) if order else 0, level.get(p))
    return out


def blobs(seed, part=1.0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(scale=s, size=(m, 3)) + c for s, m, c in
                        ((.05, 60, (0, 0, 0)), (.4, 70, (4, 0, 0)), (.1, 40, (0, 3, 0)), (.1, 40, (.6, 3, 0)), (1.2, 50, (9, 9, 9)))] + [rng.uniform(-5, 15, size=(40, 3))])
    x = np.round(x, 2)  # rounding brings ties and copies
    keep = rng.random(len(x)) < part
    keep[[5, 130]] = True
    rows = [(i, x[i].tolist()) for i in rng.permutation(len(x)).tolist() if keep[i]]
    return rows + [(1000 + i, x[5].tolist()) for i in range(30)] + [(2000 + i, x[130].tolist()) for i in range(6)]


@pytest.mark.parametrize("seed,block,part,local", [(0, 768, 1, D.LOCAL_LINKS), (1, 90, 1, D.LOCAL_LINKS), (2, 90, .6, 0)])
def test_hierarchy_equals_brute_force(spark, monkeypatch, seed, block, part, local):
    monkeypatch.setattr(D, "BLOCK", block)
    rows = blobs(seed, part)
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], VEC)
    got = {r.id: (r.cluster, r.level) for r in D.density_clusters(df, min_cluster_size=15, min_samples=6, local_links=local).collect()}
    want = brute(rows, 15, 6)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)
    assert len(Counter(c for c, _ in want.values())) >= 4  # several clusters and noise


def test_densities_that_no_single_radius_separates(spark):
    """Two close dense groups inside the spread of a sparse one's spacing: one radius either joins the two or loses the sparse one."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(scale=.02, size=(50, 2)), rng.normal(scale=.02, size=(50, 2)) + [.5, 0], rng.normal(scale=1.5, size=(80, 2)) + [20, 0]])
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], VEC)
    got = {r.id: r.cluster for r in D.density_clusters(df, min_cluster_size=20).collect()}
    for a, b in ((0, 50), (50, 100), (100, 180)):
        top, m = Counter(got[i] for i in range(a, b)).most_common(1)[0]
        assert top >= 0 and m >= .75 * (b - a)
    assert len({Counter(got[i] for i in range(a, b)).most_common(1)[0][0] for a, b in ((0, 50), (50, 100), (100, 180))}) == 3


def test_groups_and_edges(spark):
    rows = blobs(3)
    df = spark.createDataFrame([(i, v, "a") for i, v in rows] + [(10_000 + i, [float(i), 0., 0.], "b") for i in range(5)]
                               + [(20_000 + i, v, None) for i, v in rows[:120]] + [(None, [0.] * 3, "a"), (5000, None, "a"), (5001, [float("nan")] * 3, "a")], VEC)
    got = {(r.kind, r.id): r.cluster for r in D.density_clusters(df, min_cluster_size=15, group_col="kind").collect()}
    assert {i: c for (k, i), c in got.items() if k == "a"} == {i: c for i, (c, _) in brute(rows, 15, 15).items()}
    assert {i - 20_000: c for (k, i), c in got.items() if k == ""} == {i: c for i, (c, _) in brute(rows[:120], 15, 15).items()}
    assert {c for (k, _), c in got.items() if k == "b"} == {0}  # noise alone is cluster 0
    assert D.density_clusters(df.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], "a") for i in range(50)], VEC)
    assert {r.cluster for r in D.density_clusters(same).collect()} == {0}


def test_tile_trees_hold_the_whole_tree():
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(90, 2)), 1)  # many equal distances
    m = D.pair_distances(x)
    a, b, w = D.spanning_links(m)
    whole = set(zip(a.tolist(), b.tolist()))
    parts = np.arange(90) % 3
    kept = set()
    for i in range(3):
        for j in range(i, 3):
            idx = np.flatnonzero((parts == i) | (parts == j))
            p, q, _ = D.spanning_links(m[np.ix_(idx, idx)])
            kept |= set(zip(idx[p].tolist(), idx[q].tolist()))
    assert whole <= kept and len(kept) < 90 * 89 / 2 / 5


@pytest.mark.parametrize("case", range(12))
def test_links_of_two_blocks_need_no_full_matrix(monkeypatch, case):
    """The links between two blocks are those of the tree of both together, ties included, without all exact distances of the tile."""
    rng = np.random.default_rng(case)
    n, dim = 40 + 10 * case, 1 + case % 9
    x = rng.normal(size=(n, dim)) * rng.choice([.1, 1, 5], size=(n, 1))
    x = (np.round(x, 1) if case % 2 else x) + (1e6 if case % 3 == 0 else 0)
    side = x[:, 0] < np.median(x[:, 0]) if case % 4 == 0 else rng.random(n) < .4
    side[:2] = True, False
    core = np.sort(D.pair_distances(x), axis=1)[:, 5]
    a, b, w = D.spanning_links(np.maximum(D.pair_distances(x), np.maximum(core[:, None], core[None, :])))
    want = {(p, q, r) for p, q, r in zip((a * 3).tolist(), (b * 3).tolist(), w.tolist()) if side[p // 3] != side[q // 3]}
    pdf = pd.DataFrame({"g": "", "pid": np.arange(n) * 3, "vec": list(x), "core": core, "block": np.where(side, "i", "j"), "ti": "i", "tj": "j"})
    tree = pd.concat([D._home_links(part) for _, part in pdf.groupby("block")])
    monkeypatch.setattr(D, "pair_distances", None)
    got = D._tile_links(pdf.merge(tree[["pid", "up", "up_lvl", "top"]], on="pid").sample(frac=1, random_state=case))
    assert set(zip(got["a"].tolist(), got["b"].tolist(), got["lvl"].tolist())) == want


@pytest.mark.parametrize("seed", [0, 1])
def test_nearest_of_two_blocks(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(120, 3)), 1)
    d, w = D.pair_distances(x), rng.integers(1, 4, 120)
    side, ub = rng.random(120) < .5, np.where(rng.random(120) < .1, np.inf, rng.uniform(.2, 1.5, 120))
    pdf = pd.DataFrame({"pid": np.arange(120), "vec": list(x), "w": w, "ub": ub, "block": np.where(side, "i", "j"), "ti": "i", "tj": "j"})
    want = {}
    for i in range(120):
        got = w[i]
        for z, m in sorted((d[i, j], j) for j in range(120) if side[j] != side[i] and d[i, j] < ub[i]):
            if got >= 8:
                break
            got += w[m]
            want.setdefault(i, []).append((z, w[m]))
    monkeypatch.setattr(D, "pair_distances", None)
    rows = D._nearest(8)(pdf.sample(frac=1, random_state=seed))
    assert {r.pid: list(zip(r.d, r.m)) for r in rows.itertuples()} == want
