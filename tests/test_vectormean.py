"""Means of whole vectors and message passing against plain Python."""

import math
import random

from fpengine.operators import graph as G
from fpengine.operators.vectormean import mean_vectors


def test_mean_vectors_hot_key_nulls_and_empty(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 50}", [rng.uniform(-1, 1) for _ in range(5)]) for i in range(600)]
    rows += [("hot", None), ("only null", None), (None, [1.0] * 5), (None, [3.0] * 5)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(7)
    got = {r.k: r["mean"] for r in mean_vectors(df, ["k"], "v").collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert set(got) == set(want)
    for k, vs in want.items():
        assert all(math.isclose(a, sum(x) / len(vs), abs_tol=1e-12) for a, x in zip(got[k], zip(*vs), strict=True))
    assert mean_vectors(df.where("false"), ["k"], "v").count() == 0


def _plain(vecs, edges, rounds, weights, norm):
    cur = dict(vecs)
    deg = {}
    for a, b, _ in edges:
        deg[a] = deg.get(a, 0) + 1
        deg[b] = deg.get(b, 0) + 1
    pen = {n: 1 / math.log(d) if d > 1 else 1.0 for n, d in deg.items()}
    for _ in range(rounds):
        box = {}
        for a, b, r in edges:
            for f, t in ((a, b), (b, a)):
                if f in cur:
                    box.setdefault(t, []).append([x * pen[f] * weights.get(r, 1.0) for x in cur[f]])
        nxt = {}
        for n in set(cur) | set(box):
            s = [sum(c) / len(box[n]) for c in zip(*box[n], strict=True)] if n in box else None
            s = cur[n] if s is None else s if n not in cur else [x + y for x, y in zip(cur[n], s, strict=True)]
            if norm == "layer":
                mu = sum(s) / len(s)
                sd = math.sqrt(max(sum(x * x for x in s) / len(s) - mu * mu, 0) + 1e-5)
                nxt[n] = [(x - mu) / sd for x in s]
            else:
                ln = math.sqrt(sum(x * x for x in s))
                nxt[n] = [x / ln for x in s] if ln else s
        cur = nxt
    return cur


def test_propagate_equals_plain_python_with_a_hub(spark):
    rng = random.Random(5)
    vecs = {f"d{i}": [rng.gauss(0, 1) for _ in range(4)] for i in range(120)}
    edges = [(f"d{i}", "hub", "a") for i in range(120)]  # one feature holds a third of all edges
    edges += [(f"d{i}", f"f{rng.randrange(15)}", rng.choice("ab")) for i in range(120) for _ in range(2)]
    nodes = spark.createDataFrame(list(vecs.items()), "node string, vec array<double>")
    e = spark.createDataFrame(edges, "ip string, feature_id string, rel string")
    for norm in ("l2", "layer"):
        got = {r.node: r.vec for r in G.propagate(nodes, e, relation="rel", relation_weights={"a": 0.5}, norm=norm).collect()}
        want = _plain(vecs, edges, 2, {"a": 0.5}, norm)
        assert set(got) == set(want)
        for n in want:
            assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[n], want[n], strict=True))


def test_hubs_are_cut_and_few(spark):
    edges = spark.createDataFrame([("hub", f"t{i}") for i in range(3000)] + [(f"s{i}", "x") for i in range(3000)], "_from string, _to string")
    degree = edges.groupBy("_from").count().toDF("_node", "_d")
    cut, slices = G.spread_hubs(edges, degree, 8)
    sizes = cut.groupBy("_from", "_slice").count()
    assert sizes.agg({"count": "max"}).first()[0] < 400
    assert sizes.join(slices, ["_from", "_slice"], "left_anti").count() == 0
    assert slices.count() <= 3001 + 64
