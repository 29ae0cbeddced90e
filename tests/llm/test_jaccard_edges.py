"""Empty tables, null ids and texts, repeated ids in the n-gram join."""

import numpy as np
import pyarrow as pa

from fpengine.llm import jaccard
from fpengine.llm.jaccard import similar_components


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    assert similar_components(spark.createDataFrame([], schema)).count() == 0
    base = [f"w{i}" for i in range(60)]
    near = [*base[:59], "other"]
    apart = " ".join(f"z{i}" for i in range(60))
    rows = [(5, " ".join(base)), (9, " ".join(near)), (7, apart), (7, " ".join(base)), (3, None), (4, ""), (None, " ".join(base)), (8, apart)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in similar_components(spark.createDataFrame(rows, schema)).collect())
    # document 7 stands in two rows and joins the links of both
    assert got == [(0, 56, 0), (3, 0, 3), (4, 0, 4), (5, 56, 5), (7, 56, 5), (7, 56, 5), (8, 56, 5), (9, 56, 5)]


def _members(rows, size):
    """Rows that _meet gives for (h, doc), in batches of ``size``, and the most input rows it held back."""
    rows = sorted(rows)
    read = [0]

    def batches():
        for i in range(0, len(rows), size):
            part = rows[i:i + size]
            read[0] += len(part)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], type=pa.int64()) for k in (0, 1)], names=["h", "doc"])

    got, late = [], 0
    for b in jaccard._meet(batches()):
        got += [tuple(r.values()) for r in b.to_pylist()]
        late = max(late, read[0] - len(got))
    return got, late


def test_one_pass_finds_groups_and_members():
    rng = np.random.default_rng(3)
    rows = [(int(h), int(d)) for h, d in zip(rng.integers(-6, 6, 60), rng.integers(0, 9, 60), strict=True)] + [(40, 1), (41, 2), (41, 2), (42, 3), (42, 5)]
    want = []
    for h in {r[0] for r in rows}:
        docs = sorted(d for g, d in rows if g == h)
        if docs[0] != docs[-1]:
            want += [(h, d, docs[0], len(docs) > 2) for d in (docs if len(docs) > 2 else docs[1:])]
    for size in (1, 2, 3, 7, 1000):
        assert sorted(_members(rows, size)[0]) == sorted(want)
    assert _members([], 5) == ([], 0)


def test_a_large_group_is_not_held():
    got, late = _members([(7, d) for d in range(5000)], 100)
    assert len(got) == 5000 and late <= 200


def test_bitmaps_of_half_the_width_lose_no_link():
    rng = np.random.default_rng(5)
    for n, gone in ((40, 4), (300, 33), (300, 30), (1000, 100)):
        u = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        v = np.unique(np.concatenate([u[gone:], rng.integers(0, 1 << 62, gone).astype(np.uint64)]))
        assert 100 * len(np.intersect1d(u, v)) >= 80 * len(np.union1d(u, v))
        sig = [jaccard.signature(s, jaccard.BITS).tobytes() for s in (u, v)]
        assert all(len(x) <= jaccard.BITS * n / 4 for x in sig)
        a, b = jaccard.tile_pairs(np.array([1, 2]), np.array([len(u), len(v)]), np.array([1, 2]), np.array([0, 0]), sig, False)
        assert sorted([*a.tolist(), *b.tolist()]) == [1, 2]


def test_driver_gets_no_row_per_slot(spark, monkeypatch):
    """Counts and bitmaps reach the driver as segments of an array, broadcasts go with their plan, and joins broadcast small sides alone."""
    from fpengine.llm import common

    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:78], f"x{i}", f"y{i % 3}"])) for i in range(40)] + [(90, "other words stand alone here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent, limits = [], []
    real, write = type(spark.sparkContext).broadcast, jaccard.stage
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    monkeypatch.setattr(type(docs), "toPandas", lambda df: 1 / 0)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, x: sent.append(real(sc, x)) or sent[-1])
    monkeypatch.setattr(jaccard, "stage", lambda df, tag: limits.append(common._bytes(spark.conf.get(key))) or write(df, tag))
    got = {r.doc_id: r.component_id for r in similar_components(docs).collect()}
    assert got == {**{i: 0 for i in range(40)}, 90: 90}
    assert sent and all(b._jbroadcast is not None and not b._jbroadcast.isValid() for b in sent)
    assert max(limits) <= 1 << 20 and spark.conf.get(key) == before


def test_packed_rows_are_the_array(spark):
    from fpengine.llm import common

    rows = [(3, 7), (8191, 1), (8192, 2), (40_000, 9)]
    got = common.packed(spark.createDataFrame(rows, "k long, v long"), "k", "v", "<i8", 40_001)
    assert len(got) == 40_001 and {(int(k), int(got[k])) for k in np.flatnonzero(got)} == set(rows)
    assert not common.packed(spark.createDataFrame([], "k long, v long"), "k", "v", "u1", 64).any()
    assert [common._bytes(x) for x in ("10485760b", "256k", "10MB", "-1", "1g")] == [10485760, 262144, 10485760, -1, 1 << 30]


def test_a_task_that_saw_every_slot_gives_small_batches(monkeypatch):
    monkeypatch.setattr(jaccard, "SEEN_IN_TASK", 1)
    text = " ".join(f"w{i}" for i in range(250_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    out = list(jaccard._scan(5)([batch]))
    assert max(b.num_rows for b in out) <= 100_000 and sum(b.num_rows for b in out) > 200_000
