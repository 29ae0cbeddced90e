"""Whitening, filter audit and exact top-k against plain Python."""
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from fpengine.llm import audit, pivots, vectors, whitening
from tests.conftest import SF001

EMB = "vec_id long, embedding array<float>, label int, id string, n long, score double, x string"


def emb(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", 1, 0.5, "y") for i, v in rows], EMB)


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.integers(-b, b, size=(20, 5)) for b in (100, 30_000, 1 << 30, 1 << 62)])
    cells = vectors.pack(v)
    assert (vectors.unpack(cells, 5) == v).all()
    assert vectors.pack(v[:1]) == vectors.pack(v[:1].copy()) and len(set(cells)) == len({tuple(r) for r in v.tolist()})


# --- whitening ------------------------------------------------------------------------------

def brute_covariance(x):
    """Exact covariance of integer rows as fractions."""
    n, s = len(x), [sum(c) for c in zip(*x)]
    d = len(s)
    return s, [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3) for j in range(d)] for i in range(d)]


def check_whitening(rows, got):
    ok = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    ints = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in ok]
    fit = sorted(set(map(tuple, ints)))
    s, cov = brute_covariance(fit)
    n, d = len(fit), len(s)
    v = np.array([[float(c) for c in r] for r in cov])
    k = min(16, d)
    assert len(got) == k * len(ok) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    share = [by[c][0].explained for c in sorted(by)]
    want = sorted(np.linalg.eigvalsh(v), reverse=True)[:k]
    assert np.allclose(share, np.array(want) / np.trace(v), rtol=1e-9, atol=1e-12) and share == sorted(share, reverse=True)
    dev = {}
    for (i, _), x in zip(ok, ints):
        dev.setdefault(i, set()).add(sum((n * c - t) ** 2 for c, t in zip(x, s)))
    for r in got:
        assert r.deviation in dev[r.vec_id]
    # whitened values rebuild the distances in the whitened space
    inverse = np.linalg.pinv(v)
    if k == d and np.linalg.matrix_rank(v) == d:
        for (i, _), x in zip(ok, ints):
            c = np.array([float(Fraction(n * a - t, n)) for a, t in zip(x, s)])
            norms = [sum(r.whitened ** 2 for r in got if r.vec_id == i) / sum(1 for j, _ in ok if j == i)]
            if sum(1 for j, _ in ok if j == i) == 1:
                assert np.isclose(norms[0], c @ inverse @ c, rtol=1e-8)
    assert all(r.identity_error <= 1e-9 for r in got)


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6)) * [3, 2, 1, 1, .5, .2] @ rng.normal(size=(6, 6))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[3][1]) for i in range(50)] + [(7, rows[7][1]), (200, None), (201, []), (202, [1.0, None, 1., 1., 1., 1.]),
                                                          (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5)]
    check_whitening(rows, whitening.whiten(emb(spark, rows)).collect())


def test_whitening_edges(spark):
    assert whitening.whiten(emb(spark, [])).collect() == []
    one = whitening.whiten(emb(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained == 0 and r.n == 1 and r.deviation == 0 for r in one)
    # a constant dimension has no component of its own; lengths are apart; huge entries stay exact or null
    flat = whitening.whiten(emb(spark, [(i, [float(i), 1.0]) for i in range(5)] + [(None, [float(i)]) for i in range(3)])).collect()
    assert len(flat) == 5 * 2 + 3
    second = [r for r in flat if r.component == 2]
    assert all(r.whitened is None for r in second) and len(second) == 5
    big = whitening.whiten(emb(spark, [(i, [1e30 * (i % 2), float(i)]) for i in range(6)])).collect()
    assert len(big) == 12 and all(r.deviation is None and r.n == 6 for r in big)


def test_eigenvectors_of_close_values():
    """Eigenvalues that differ by one part in 10^9: refined vectors solve the equation to the last bits."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    a = q @ np.diag([1, 1 + 1e-9, 1 + 2e-9, .5, .25, .1, 1e-3, 1e-6]) @ q.T
    m = np.array([[int(round(c * 2 ** 80)) for c in r] for r in (a + a.T) / 2], dtype=object)
    m = (m + m.T) // 2
    lam, x = whitening.eigen(m, 1 << 80)
    ext = np.array([[whitening._extended(int(c), 1 << 80) for c in r] for r in m])
    assert np.abs(ext @ x - x * lam).max() < 1e-17 and np.abs(x.T @ x - np.eye(8)).max() < 1e-17


# --- audit ----------------------------------------------------------------------------------

def brute_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and i > first[t] else set()
        parts.setdefault(s or "", []).append((f, i in good, i in toxic))
    out = set()
    for p, rows in parts.items():
        steps, shapley = [], {}
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, c in enumerate(order, 1):
                gone = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                shapley[c] = shapley.get(c, 0) + len(gone)
                steps.append((p, order, k, len(left), len(gone), sum(c in r[0] for r in rows) - len(gone),
                              sum(r[0] == {c} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out |= {(*s, shapley[s[1][s[2] - 1]]) for s in steps}
    return out


def docs_and_labels(spark, docs, labels):
    d = spark.createDataFrame([(i, t, s, 1, 0, "x", "y") for i, t, s in docs], "doc_id long, text string, source string, mask int, good int, part string, digest string")
    return d, spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, source string")


AUDIT_DOCS = [(1, "word " * 300, "a"), (2, "word " * 300, "a"), (3, " ".join(f"w{i}" for i in range(250)), "a"), (3, "WORD#", "b"),
              (4, None, None), (5, "", ""), (None, "word " * 300, "a"), (None, None, None), (6, "A" * 1_000_000, "c"), (6, "A" * 1_000_000, "c"),
              (7, " \t\n" * 200_000 + "x", "c"), (8, "Straße # 99% | café", "ü"), (9, " ".join(f"w{i}" for i in range(250)), "b"),
              *[(100 + i, "copy of one text " * 60, "hot") for i in range(3000)], *[(50, f"t {i}", "hot") for i in range(1500)]]
AUDIT_LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (6, None, 1), (50, 1, 0), (None, 1, 1), (105, 1, 1), (999, 1, 1)]


def test_audit_brute_force(spark):
    d, lab = docs_and_labels(spark, AUDIT_DOCS, AUDIT_LABELS)
    got = audit.audit(d.repartition(7), lab).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute_audit(AUDIT_DOCS, AUDIT_LABELS)
    assert audit.audit(d.limit(0), lab).collect() == []
    assert {r.good_lost for r in audit.audit(d, lab.limit(0)).collect()} == {0}


def test_swaps_visit_every_order_once():
    d = audit.Diagram({0: (1,), 5: (2,), 31: (3,)}, 5)
    seen = {tuple(d.order)}
    for level in audit.swaps(5):
        d.swap(level)
        seen.add(tuple(d.order))
    assert len(seen) == 120 == 1 + len(list(audit.swaps(5)))


@pytest.mark.parametrize("seed", range(4))
def test_diagram_steps(seed):
    rng = np.random.default_rng(seed)
    masks = {int(m): (int(rng.integers(1, 4)), int(rng.integers(0, 2)), 0) for m in rng.integers(0, 32, size=rng.integers(1, 25))}
    docs = [(set("ABCDE"[f] for f in range(5) if m >> f & 1), w) for m, w in masks.items()]
    for order, step, kept, removed, *_ in audit.audit_part(masks):
        before, at = set(order[:step - 1]), order[step - 1]
        assert removed == sum(w[0] for f, w in docs if at in f and not f & before)
        assert kept == sum(w[0] for f, w in docs if not f & (before | {at}))


# --- exact top-k ----------------------------------------------------------------------------

def brute_top(rows, every=100, best=10):
    ok = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows
          if v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for k, (i, q) in enumerate(ok):
        if i is None or i % every:
            continue
        s = [(-sum(a * b for a, b in zip(q, x)), j is None, j if j is not None else 0) for m, (j, x) in enumerate(ok) if m != k and len(x) == len(q)]
        for r, (neg, null, j) in enumerate(sorted(s)[:best], 1):
            out.append((i, r, None if null else j, -neg if abs(neg) < 1 << 63 else None))
    return sorted(out, key=repr)


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=8)]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)] + [(300, rows[5][1]), (300, rows[300][1]), (None, rows[100][1]), (None, rows[100][1])]
    rows += [(-200, [0.0] * 8), (2000, None), (2100, []), (2200, [None] * 8), (2300, [float("nan")] * 8), (2400, [1.0, 2.0]), (2500, [1.0, 2.5]), (2600, [3.0])]
    rows += [(5000, [1e17] + [0.0] * 7), (5001, [1e17] * 8), (5002, [-1e17] * 8)]
    for size in (pivots.QUERY_BYTES, 1500):  # one block of queries, then many
        got = sorted(map(tuple, pivots.top_k(emb(spark, rows).repartition(5), query_bytes=size).collect()), key=repr)
        assert got == brute_top(rows)
    assert pivots.top_k(emb(spark, [])).collect() == []
    assert pivots.top_k(emb(spark, [(100, [1.0])])).collect() == []


def test_top_k_whole_table(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert sorted(map(tuple, pivots.top_k(df).collect()), key=repr) == brute_top(rows)


def test_elimination_is_exact_and_works_on_groups():
    """On grouped vectors the bounds set most rows aside; what is left out never holds a better row."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16)) * 1000
    v = np.floor(centre[rng.integers(0, 40, size=6000)] + rng.normal(size=(6000, 16)) * 20).astype(np.int64)
    pv = pivots.spread_out(v[:800], pivots.PIVOTS)
    block = pivots.Queries(np.arange(60), np.arange(60), v[:60], pv, v[1000:2000], 10)
    search = pivots.Search(block)
    far = pivots.distances(v, pv).astype(np.float32).astype(np.float64)
    order = np.argsort(far.argmin(axis=1), kind="stable")
    for i in range(0, 6000, 500):
        k = order[i:i + 500]
        search.add(k, v[k], far[k])
    score = v[:60] @ v.T
    for q in range(60):
        assert search.score[q] == sorted((-int(s), j) for j, s in enumerate(score[q]))[:11]
    assert search.evaluated < 0.2 * search.seen
