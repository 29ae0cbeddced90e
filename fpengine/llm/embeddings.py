"""Operator 7: embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Equal vectors collapse to their smallest id. A rotation of the centred unit vectors is learned in turns
with their sign codes (iterative quantisation) on at most ``SAMPLE`` vectors in the order of a hash; several rotations, from
different starts, give as many bits as needed. The bits are cut into tables of about log2(n) bits, so a bucket holds a
few unrelated vectors at any n. Two vectors meet in a table when their bits there differ in at most two places (each side is stored under its own
code and all codes one bit away). The number of tables is the smallest at which ``AIM`` of pairs exactly at
the threshold, drawn around sample vectors, meet. Pairs that meet and are near in the first code are compared
by cosine of the original vectors in double precision; only pairs at or above the threshold
are links. Every vector is indexed; buckets and candidates have no cap.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null id, link with nothing; vectors of different lengths never link; equal vectors link
with each other; repeated ids count as separate vectors of one component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpengine.llm.common import connected_components, discard, spark_of, stage

SAMPLE = 20_000
THRESHOLD = 0.9
AIM = 0.985
SEED = 7


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: codes from the rotated vectors, then the rotation that brings the
    vectors nearest to their codes (orthogonal Procrustes)."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds):
        b = np.where(x @ r >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(b.T @ x)
        r = (u @ vt).T
    return r


class Codes:
    """Centre, rotations and tables; a table is a set of ``bits`` columns of the rotated vectors."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float):
        x = unit(sample)
        self.centre = x.mean(axis=0)
        d = x.shape[1]
        c = x - self.centre
        self.bits = int(min(max(6, round(np.log2(max(n, 2)))), 40, max(d, 1)))
        rng = np.random.default_rng(SEED)
        # pairs exactly at the threshold around sample vectors
        base = x[rng.integers(0, len(x), size=4000)]
        other = rng.normal(size=base.shape)
        other -= (other * base).sum(axis=1, keepdims=True) * base
        norm = np.linalg.norm(other, axis=1, keepdims=True)
        other = np.divide(other, norm, out=np.zeros_like(other), where=norm > 0)
        other = threshold * base + np.sqrt(1 - threshold * threshold) * other
        self.rotations: list[np.ndarray] = []
        self.tables: list[tuple[int, np.ndarray]] = []
        met = np.zeros(len(base), dtype=bool)
        while met.mean() < AIM and len(self.tables) < 64:
            r = learn_rotation(c, SEED + len(self.rotations))
            self.rotations.append(r)
            diff = ((base - self.centre) @ r >= 0) != ((other - self.centre) @ r >= 0)
            if len(self.rotations) == 1:
                self.radius = int(np.quantile(diff.sum(axis=1), 0.999))
            cols = np.random.default_rng(SEED + len(self.rotations)).permutation(d)
            for k in range(0, d - self.bits + 1, self.bits):
                part = cols[k:k + self.bits]
                self.tables.append((len(self.rotations) - 1, part))
                met |= diff[:, part].sum(axis=1) <= 2
                if met.mean() >= AIM:
                    break

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed first code (n, bytes) and table codes (n, tables)."""
        x = unit(v) - self.centre
        signs = [x @ r >= 0 for r in self.rotations]
        first = np.packbits(signs[0], axis=1)
        weight = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        return first, np.stack([signs[r][:, part] @ weight for r, part in self.tables], axis=1)


def _keys(model, dims):
    def run(batches):
        import pyarrow as pa
        codes: Codes = model.value
        ball = np.concatenate([[0], np.int64(1) << np.arange(codes.bits, dtype=np.int64)])
        t = len(codes.tables)
        pad = -(-dims // 64) * 8
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                v = b.column(1).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, dims)
                first, tab = codes.of(v)
                wide = np.zeros((len(v), pad), dtype=np.uint8)
                wide[:, :first.shape[1]] = first
                words = wide.view(np.int64)
                key = (tab[:, :, None] ^ ball[None, None, :]) | (np.arange(t, dtype=np.int64)[None, :, None] << 41)
                per = t * len(ball)
                ids = np.repeat(b.column(0).to_numpy(), per)
                off = np.arange(len(v) * per + 1, dtype=np.int32) * words.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.reshape(-1)), pa.array(ids), pa.ListArray.from_arrays(pa.array(off), pa.array(np.repeat(words, per, axis=0).reshape(-1)))],
                    names=["key", "id", "code"])
    return run


def _cosine(threshold):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(k).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1) for k in (2, 3))
            cos = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            keep = pa.array(np.flatnonzero(cos >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(cos).take(keep)], names=["a", "b", "cosine"])
    return run


def near_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b, cosine), a < b, between the rows of ``vectors`` (id long, v array<double or float>, all valid,
    of one length per call)."""
    spark = spark_of(vectors)
    out = None
    for row in vectors.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        dims, n = row["d"], row["count"]
        part = vectors.where(F.size("v") == dims)
        order = F.xxhash64(F.col("id"), F.lit(SEED))
        sample = np.array([r["v"] for r in part.orderBy(order, "id").limit(SAMPLE).select("v").collect()], dtype=np.float64)
        model = spark.sparkContext.broadcast(codes := Codes(sample, n, threshold))
        keys = part.select("id", "v").mapInArrow(_keys(model, dims), "key long, id long, code array<long>")
        keys = stage(keys, "itq-keys")
        words = -(-dims // 64)
        differ = sum((F.bit_count(F.col("x.code")[k].bitwiseXOR(F.col("y.code")[k])) for k in range(words)), F.lit(0))
        meet = keys.alias("x").join(keys.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (differ <= codes.radius))
        pairs = meet.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        va, vb = part.select(F.col("id").alias("a"), F.col("v").alias("x")), part.select(F.col("id").alias("b"), F.col("v").alias("y"))
        links = pairs.join(va, "a").join(vb, "b").select("a", "b", "x", "y").mapInArrow(_cosine(threshold), "a long, b long, cosine double")
        links = stage(links, "itq-links")
        discard(keys)
        out = links if out is None else out.unionByName(links)
    return spark.createDataFrame([], "a long, b long, cosine double") if out is None else out


def near_duplicates(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``embeddings``."""
    spark_of(embeddings)
    base = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    valid = (F.col("v").isNotNull() & F.col("vec_id").isNotNull()
             & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0))
    base = stage(base.withColumn("ok", F.coalesce(valid, F.lit(False))), "itq-base")
    same = stage(base.where("ok").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "itq-same")
    links = near_links(same.select("id", "v"), threshold)
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(same.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    comp = connected_components(links)
    cls = same.join(degree, "id", "left").join(comp, "id", "left") \
        .select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    linked = base.where("ok").join(cls, "v").select("vec_id", "n_links", "component_id")
    alone = base.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    res = linked.unionByName(alone)
    # a repeated id ties its vectors together
    ids = res.groupBy("vec_id").agg(F.countDistinct("component_id").alias("c")).where("c > 1")
    if not ids.isEmpty():
        tied = connected_components(res.select(F.col("vec_id").alias("a"), F.col("component_id").alias("b")))
        res = res.join(tied.select(F.col("id").alias("vec_id"), F.col("component_id").alias("_c")), "vec_id", "left") \
            .withColumn("component_id", F.coalesce("_c", "component_id")).drop("_c")
    return res.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
