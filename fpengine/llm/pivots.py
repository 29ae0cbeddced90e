"""Operator 13: exact top-k by inner product with pivot-table elimination.

Components become the integers floor(1024 x) (1024 x saturates at 2^62); the score is their inner product, computed exactly.
``PIVOTS`` vectors are drawn by a hash of the id and thinned farthest-first; the pivot table holds every row's distance to each of them. As
``q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2`` and every pivot p gives ``|q - x| >= | |q - p| - |x - p| |``, the largest such lower bound over all
pivots bounds the score from above. Each query starts from the scores against the drawn sample, which no true
answer can fall below; rows whose bound is under the current k-th score are eliminated without looking at their vectors, and the others are evaluated
in falling order of their bounds until the next bound is under it. Equal bounds are evaluated, so ties are complete.

Rows of one cell (nearest pivot) are written next to each other, so that a whole run of rows is often eliminated by the first few bounds. The queries go out in
broadcast blocks of at most ``QUERY_BYTES``; for each block one pass over the table keeps the best rows per query in every task, and
a window merges them. Of equal vectors only the k + 1 smallest ids can be among the best k of any query, so
further copies are set aside before (exactly: nothing that could be returned is lost).

Defined results: vectors that are null or empty or hold null or non-finite entries take no part; a query meets the vectors of
its own length only; a row with a null id is a candidate, last among ties, and no query; rows that repeat an id are separate candidates and
queries (a query excludes one row of its own id and vector: itself); score is null beyond a long; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fpengine.llm.common import discard, spark_of, stage
from fpengine.llm.vectors import integer_vectors, matrices, unpack
from fpengine.session import ensure_checkpoint_dir

SCALE = 1024
BEST = 10
EVERY = 100
PIVOTS = 48
SAMPLE = 1024  # expected size of the drawn sample, whatever the table
QUERY_BYTES = 24 << 20
BLOCK = 2048  # rows bounded at a time
STEP = 64  # rows evaluated at a time
SEED = 13
_NONE = np.iinfo(np.int64).max
_LOW = (1 << 62) - 1
_HITS = "number long, query long, s2 long, s1 long, s0 long, vec_id long, own boolean, score long"
OUT = "query_id long, rank int, vec_id long, score long"


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of integer rows to integer pivots."""
    a, b = v.astype(np.float64), pivots.astype(np.float64)
    out = np.empty((len(a), len(b)))
    for k in range(len(b)):
        z = a - b[k]
        out[:, k] = np.sqrt(np.einsum("ij,ij->i", z, z))
    return out


def spread_out(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows of the sample, each the one farthest from those chosen before."""
    chosen = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(chosen) < most and near.max(initial=0) > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every partial sum is below 2^53, else in Python integers."""
    far = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * len(q)
    if far < 2 ** 53:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return rows.astype(object) @ q.astype(object)


class Queries:
    """A block of queries: ids, vectors, distances to the pivots, the starting scores and the bound of each."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, sample: np.ndarray, best: int):
        self.number, self.ids, self.v, self.best = number, ids, vectors, best
        self.far = distances(vectors, pivots)
        self.square = np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64))
        # one of the sample's rows may be the query itself, so the (best + 1)-th score is the start
        self.start = None
        if len(sample) > best:
            self.start = [np.sort(products(sample, q))[-best - 1] for q in vectors]
            self.start = [int(s) for s in self.start]


class Search:
    """Best rows of every query of a block over the rows seen so far, in one task."""

    def __init__(self, block: Queries):
        n = len(block.number)
        self.block, self.keep = block, block.best + 1
        self.score: list[list] = [[] for _ in range(n)]  # (-score, id), ascending
        self.least = list(block.start) if block.start is not None else [None] * n
        self.floor = np.array([-np.inf if s is None else float(s) for s in self.least])
        self.evaluated = self.seen = 0

    def bounds(self, q: np.ndarray, far: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Scores that no pair (query, row) can exceed; slack covers the rounding of the stored and computed distances."""
        b = self.block
        low = np.zeros((len(q), len(far)))
        gap = np.empty_like(low)
        for k in range(far.shape[1]):
            np.subtract(b.far[q, k][:, None], far[:, k][None, :], out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        low -= 1e-6 * (b.far[q].max(axis=1)[:, None] + far.max(axis=1)[None, :])
        np.maximum(low, 0, out=low)
        both = b.square[q][:, None] + square[None, :]
        return (both * (1 + 1e-9) - low * low * (1 - 1e-9)) / 2 + 1

    def add(self, ids: np.ndarray, v: np.ndarray, far: np.ndarray) -> None:
        b = self.block
        square = np.einsum("ij,ij->i", v.astype(np.float64), v.astype(np.float64))
        # the run of rows as one: the interval of its distances to each pivot, and its largest norm
        low = np.maximum(far.min(axis=0)[None, :] - b.far, b.far - far.max(axis=0)[None, :]).max(axis=1)
        low = np.maximum(low - 1e-6 * (b.far.max(axis=1) + far.max()), 0)
        run = ((b.square + square.max()) * (1 + 1e-9) - low * low * (1 - 1e-9)) / 2 + 1
        left = np.flatnonzero(run >= self.floor)
        self.seen += len(b.number) * len(ids)
        per = max(1, (1 << 20) // max(1, len(ids)))
        for s in range(0, len(left), per):
            q = left[s:s + per]
            bound = self.bounds(q, far, square)
            live = bound >= self.floor[q][:, None]
            for r in np.flatnonzero(live.any(axis=1)):
                cand = np.flatnonzero(live[r])
                self._evaluate(int(q[r]), ids, v, cand[np.argsort(-bound[r, cand], kind="stable")], bound[r])

    def _evaluate(self, q: int, ids, v, order, bound) -> None:
        best, step = self.score[q], STEP
        for i in range(0, len(order), step):
            part = order[i:i + step]
            if bound[part[0]] < self.floor[q]:
                return  # bounds only fall from here
            got = products(v[part], self.block.v[q])
            self.evaluated += len(part)
            if self.least[q] is not None:
                ok = np.flatnonzero(got >= self.least[q])
                part, got = part[ok], got[ok]
            if not len(part):
                continue
            best = sorted(best + [(-s, t) for s, t in zip(got.tolist(), ids[part].tolist())])[:self.keep]
            self.score[q] = best
            if len(best) == self.keep and (self.least[q] is None or -best[-1][0] > self.least[q]):
                self.least[q] = -best[-1][0]
                # the floor in doubles lies a little lower, so that rounding eliminates nothing
                self.floor[q] = float(self.least[q]) - 1e-9 * abs(float(self.least[q]))

    def rows(self):
        """(number, query, score, id, whether the row is the query itself)"""
        b = self.block
        for q, best in enumerate(self.score):
            own = int(products(b.v[q:q + 1], b.v[q])[0])
            for s, t in best:
                yield int(b.number[q]), int(b.ids[q]), -s, t, t == b.ids[q] and -s == own


def _table(pivots):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for rows, d, v in matrices(batch):
                far = distances(v, pivots.value[d])
                off = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * far.shape[1])
                take = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [take.column("id"), take.column("dims"), take.column("x"), pa.array(far.argmin(axis=1).astype(np.int32)),
                     pa.ListArray.from_arrays(off, pa.array(far.astype(np.float32).reshape(-1)))], names=["id", "dims", "x", "cell", "far"])
    return run


def _search(shared):
    def run(batches):
        import pyarrow as pa
        search = Search(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids = part.column("id").fill_null(_NONE).to_numpy()
                v = unpack(part.column("x").to_pylist(), shared.value.v.shape[1])
                search.add(ids, v, part.column("far").flatten().to_numpy().astype(np.float64).reshape(len(ids), -1))
        got = list(search.rows())
        if got:
            number, query, score, ids, own = zip(*got)
            # three longs hold any score of saturated vectors; they sort as the score does
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, type=pa.int64()), pa.array(query, type=pa.int64()), pa.array([s >> 124 for s in score], type=pa.int64()),
                 pa.array([(s >> 62) & _LOW for s in score], type=pa.int64()), pa.array([s & _LOW for s in score], type=pa.int64()),
                 pa.array([None if t == _NONE else t for t in ids], type=pa.int64()), pa.array(own, type=pa.bool_()),
                 pa.array([s if -(1 << 63) <= s < 1 << 63 else None for s in score], type=pa.int64())], names=[c.split()[0] for c in _HITS.split(", ")])
    return run


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(id, dims, x, cell, far): the distances of every row to the pivots of its length; each written part is in the order of its cells."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    return rows.mapInArrow(_table(shared), "id long, dims int, x binary, cell int, far array<float>").sortWithinPartitions("dims", "cell")


def _ranges(queries: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges [from, to) of ``number`` with at most ``most`` queries each. One count per written part reaches the driver: a number is
    (part << 33) + position."""
    parts = queries.groupBy(F.shiftright("number", 33).alias("p")).agg(F.min("number").alias("lo"), F.max("number").alias("hi")).orderBy("lo").collect()
    out, start, held = [], None, 0
    for r in parts:
        at, end = r["lo"], r["hi"] + 1
        while at < end:
            start = at if start is None else start
            step = min(end - at, most - held)
            at, held = at + step, held + step
            if held == most:
                out.append((start, at))
                start, held = None, 0
    if start is not None:
        out.append((start, parts[-1]["hi"] + 1))
    return out


def _best_rows(hits: DataFrame, best: int) -> DataFrame:
    """The best rows of every query out of those that the tasks kept, without the query's own row."""
    w = Window.partitionBy("number")
    order = [F.desc("s2"), F.desc("s1"), F.desc("s0"), F.col("vec_id").asc_nulls_last()]
    top = hits.withColumn("r", F.row_number().over(w.orderBy(*order))).where(F.col("r") <= best + 1)
    own = F.coalesce(F.min(F.when(F.col("own"), F.col("r"))).over(w), F.lit(best + 2))
    top = top.withColumn("at", own).where(F.col("r") != F.col("at"))
    rank = F.col("r") - (F.col("r") > F.col("at")).cast("int")
    return top.select(F.col("query").alias("query_id"), rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= best)


def top_k(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY, best: int = BEST,
          query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``best`` highest scores of each row whose id is divisible by ``every``, ties to smaller ids."""
    spark = spark_of(embeddings)
    every_row = integer_vectors(embeddings, vec_id, embedding, SCALE)
    copies = Window.partitionBy("dims", "x").orderBy(F.col("id").asc_nulls_last())
    rows = stage(every_row.withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= best + 1).drop("_r"), "piv-rows")
    queries = stage(every_row.where(F.col("id") % every == 0).withColumn("number", F.monotonically_increasing_id()), "piv-queries")
    samples, pivots = {}, {}
    for r in rows.groupBy("dims").count().collect():
        d, n = r["dims"], r["count"]
        # the draw keeps about one of n / SAMPLE rows, so the driver gets between SAMPLE and twice as many, whatever n
        drawn = rows.where((F.col("dims") == d) & (F.pmod(F.xxhash64("id", "x", F.lit(SEED)), F.lit(max(1, n // SAMPLE))) == 0)).toArrow()
        cells = sorted(drawn.column("x").to_pylist())
        samples[d] = unpack(cells, d)
        pivots[d] = spread_out(samples[d], PIVOTS) if len(cells) else np.zeros((1, d), dtype=np.int64)
    table = stage(pivot_table(rows, pivots), "piv-table")
    path = f"{ensure_checkpoint_dir(spark)}/fpengine-piv-result-{uuid.uuid4().hex}"
    spark.createDataFrame([], OUT).write.parquet(path)
    for d in sorted(pivots):
        of_length = queries.where(F.col("dims") == d)
        most = max(1, query_bytes // (8 * (d + PIVOTS + 4)))
        for lo, hi in _ranges(of_length, most):
            block = of_length.where((F.col("number") >= lo) & (F.col("number") < hi)).toArrow()
            shared = spark.sparkContext.broadcast(Queries(block.column("number").to_numpy(), block.column("id").to_numpy(),
                                                          unpack(block.column("x").to_pylist(), d), pivots[d], samples[d], best))
            hits = table.where(F.col("dims") == d).select("id", "x", "far").mapInArrow(_search(shared), _HITS)
            _best_rows(hits, best).write.mode("append").parquet(path)
            shared.unpersist()
    discard(rows, queries, table)
    return spark.read.schema(OUT).parquet(path)


TOP_SQL = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS rn, [floor({SCALE} * c::DOUBLE)::BIGINT::DOUBLE FOR c IN embedding] AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c::DOUBLE)]) = 0),
s AS (SELECT q.vec_id AS query_id, q.rn, c.vec_id, list_sum([q.x[i] * c.x[i] FOR i IN range(1, len(q.x) + 1)])::BIGINT AS score
      FROM v q JOIN v c ON q.rn <> c.rn AND len(q.x) = len(c.x) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {BEST}
"""
