"""Exact similarity search by blocks (VEC4 brute-force inner-product top-k, JN12, TOP2).

Queries and corpus are cut into blocks by hash of their ids: query block ``_qb`` of about ``queries_per_block`` rows, corpus block
``_cb`` of about ``corpus_rows_per_block`` rows. A block is one row that holds its ids and vectors as an array, alone in its
partition, and every query block meets every corpus block in a task of its own (a join of blocks that is forced to be
shuffled: no side is ever broadcast). So each row is shuffled twice whatever the number of blocks, instead of once per
block of the other side. Inside a task a numpy matrix product scores the two blocks and only the best ``k`` per query leave it,
so no pair of rows is ever materialised as a Spark row. A final per-query window keeps the best ``k`` of at most ``cb_count * k``
partial results.

The size of a task is bounded by the block parameters, not by the data, so a large corpus becomes more tasks rather than bigger ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NEG_INF = -np.inf
QUERY_ROWS = 256  # queries of a block scored at once: their scores against one chunk are the largest table of a task


def _topk_rows(scores: np.ndarray, ids: np.ndarray, kk: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the ``kk`` best entries ordered by (score desc, id asc); ties exact."""
    n = scores.shape[1]
    if n > kk:
        sel = np.argpartition(-scores, kk - 1, axis=1)[:, :kk]
        kth = np.take_along_axis(scores, sel, 1).min(axis=1)
        tied = np.nonzero((scores >= kth[:, None]).sum(axis=1) > kk)[0]
        if len(tied):
            sel[tied] = np.lexsort((ids[tied], -scores[tied]), axis=1)[:, :kk]
        scores = np.take_along_axis(scores, sel, 1)
        ids = np.take_along_axis(ids, sel, 1)
    order = np.lexsort((ids, -scores), axis=1)
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _best_of(qm: np.ndarray, qids: np.ndarray, cm: np.ndarray, cids: np.ndarray, kk: int, exclude_same_id: bool, chunk_rows: int):
    """Scores and ids of the ``kk`` best rows of ``cm`` per row of ``qm``. After the first chunk only scores that reach a query's ``kk``-th best so
    far are looked at."""
    best_s = best_i = None
    for start in range(0, len(cids), chunk_rows):
        bids = cids[start:start + chunk_rows]
        s = qm @ cm[start:start + chunk_rows].T
        if exclude_same_id:
            s[qids.astype(np.int64)[:, None] == bids[None, :]] = _NEG_INF
        if best_s is None or best_s.shape[1] < kk:
            if best_s is not None:
                s, ids = np.hstack([best_s, s]), np.hstack([best_i, np.broadcast_to(bids, s.shape)])
            else:
                ids = np.broadcast_to(bids, s.shape)
            best_s, best_i = _topk_rows(s, ids, kk)
            continue
        row, at = np.nonzero(s >= best_s[:, -1:])
        if len(row) == 0:
            continue
        some, row_of = np.unique(row, return_inverse=True)
        new = np.bincount(row_of)
        # the hits of a query side by side, behind its best so far; what is left free counts as minus infinity
        place = np.arange(len(row)) - np.repeat(np.cumsum(new) - new, new) + kk
        both_s = np.full((len(some), kk + int(new.max())), _NEG_INF)
        both_i = np.full(both_s.shape, np.iinfo(np.int64).max)
        both_s[:, :kk], both_i[:, :kk] = best_s[some], best_i[some]
        both_s[row_of, place], both_i[row_of, place] = s[row, at], bids[at]
        best_s[some], best_i[some] = _topk_rows(both_s, both_i, kk)
    return best_s, best_i


def _block_search(k: int, qid: str, qvec: str, cid: str, cvec: str, exclude_same_id: bool,
                  chunk_rows: int, payload: list[str]):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        cols = [qid, cid, "score"] + payload
        if q.empty or c.empty:
            return pd.DataFrame({name: [] for name in cols})
        qm = np.vstack(q[qvec].to_numpy()).astype(np.float64)
        cm = np.vstack(c[cvec].to_numpy()).astype(np.float64)
        qids = q[qid].to_numpy()
        cids = c[cid].to_numpy().astype(np.int64)
        kk = min(k, len(cids))
        parts = [_best_of(qm[a:a + QUERY_ROWS], qids[a:a + QUERY_ROWS], cm, cids, kk, exclude_same_id, chunk_rows) for a in range(0, len(qids), QUERY_ROWS)]
        best_s, best_i = np.vstack([s for s, _ in parts]), np.vstack([i for _, i in parts])
        rows_q = np.repeat(qids, best_s.shape[1])
        out = pd.DataFrame({qid: rows_q, cid: best_i.ravel(), "score": best_s.ravel()})
        out = out[np.isfinite(out["score"].to_numpy())]
        if payload:
            pay = c[[cid] + payload].drop_duplicates(cid)
            pay = pay.assign(**{cid: pay[cid].astype(np.int64)})
            out = out.merge(pay, on=cid, how="left")
        return out[cols]
    return run


def _same_types(left: DataFrame, right: DataFrame, *keys: str) -> None:
    """cogroup() hashes both sides' keys as they are: keys of different types would send equal
    values to different partitions."""
    for k in keys:
        if left.schema[k].dataType != right.schema[k].dataType:
            raise TypeError(f"co-group key {k}: {left.schema[k].dataType} and {right.schema[k].dataType}")


def _block_rows(df: DataFrame, key: str, blocks: int, out: str) -> DataFrame:
    """One row per block of ``df`` by the hash of ``key``: column ``out``, an array of the block's rows. Block b is alone in partition b."""
    at = df.select(F.struct(*df.columns).alias("_row"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_b"))
    return at.groupBy("_b").agg(F.collect_list("_row").alias(out)).repartitionById(blocks, "_b").select(out)


def _meeting(search, qid: str, cid: str, payload: list[str]):
    """Rows (query block, corpus block) -> the block search's rows."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for q, c in zip(batch.column(0), batch.column(1), strict=True):
                q, c = (pa.RecordBatch.from_struct_array(x.values) for x in (q, c))
                out = search(q.to_pandas(), c.to_pandas())
                types = [(qid, q.schema.field(qid).type), (cid, pa.int64()), ("score", pa.float64()), *((p, c.schema.field(p).type) for p in payload)]
                yield from pa.Table.from_pandas(out, schema=pa.schema(types), preserve_index=False).to_batches()
    return run


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id",
               query_vec: str = "qvec", corpus_id: str = "id", corpus_vec: str = "vec",
               payload: tuple[str, ...] = (), exclude_same_id: bool = False,
               queries_per_block: int = 16_384, corpus_rows_per_block: int = 16_384,
               chunk_rows: int = 2048, min_corpus_blocks: int | None = None,
               rank_col: str = "rank") -> DataFrame:
    """Exact inner-product top-``k`` per query: columns ``query_id, corpus_id, score, rank``
    (+ payload columns of the corpus). Ties are broken by corpus id ascending.
    Ids must be integral (long)."""
    spark = queries.sparkSession
    nq = queries.count()
    nc = corpus.count()
    qb = max(1, math.ceil(nq / queries_per_block))
    floor_blocks = min_corpus_blocks if min_corpus_blocks is not None else spark.sparkContext.defaultParallelism
    cb = max(math.ceil(nc / corpus_rows_per_block), min(floor_blocks, max(1, nc // 256)))
    q = _block_rows(queries.select(query_id, query_vec), query_id, qb, "_q")
    c = _block_rows(corpus.select(corpus_id, corpus_vec, *payload), corpus_id, cb, "_c")
    fields = [queries.schema[query_id], corpus.schema[corpus_id]]
    schema = T.StructType([T.StructField(query_id, fields[0].dataType),
                           T.StructField(corpus_id, T.LongType()),
                           T.StructField("score", T.DoubleType())]
                          + [T.StructField(p, corpus.schema[p].dataType) for p in payload])
    fn = _block_search(k, query_id, query_vec, corpus_id, corpus_vec, exclude_same_id, chunk_rows, list(payload))
    partial = q.hint("shuffle_replicate_nl").join(c).mapInArrow(_meeting(fn, query_id, corpus_id, list(payload)), schema)
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(corpus_id).asc())
    return partial.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def exact_range_pairs(points: DataFrame, radius: float, *, id_col: str = "id", vec_col: str = "vec",
                      metric: str = "euclidean", points_per_block: int = 20_000,
                      chunk_rows: int = 4096, min_blocks: int | None = None) -> DataFrame:
    """All pairs ``(src, dst, dist)`` with ``src <> dst`` and distance ``<= radius``.

    Same block scheme as :func:`exact_topk` (block ``a`` of sources x block ``b`` of
    targets); the output is exactly the neighbour relation, nothing more."""
    spark = points.sparkSession
    n = points.count()
    floor_blocks = min_blocks if min_blocks is not None else spark.sparkContext.defaultParallelism
    nb = max(math.ceil(n / points_per_block), min(floor_blocks, max(1, n // 256)))
    base = points.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")) \
        .withColumn("_blk", F.pmod(F.xxhash64("_id"), F.lit(nb)).cast("int"))
    left = base.select(F.col("_id").alias("_ida"), F.col("_v").alias("_va"), F.col("_blk").alias("_a")) \
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    right = base.select(F.col("_id").alias("_idb"), F.col("_v").alias("_vb"), F.col("_blk").alias("_b")) \
        .withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    r2 = float(radius) ** 2

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"src": [], "dst": [], "dist": []})
        am = np.vstack(a["_va"].to_numpy()).astype(np.float64)
        bm = np.vstack(b["_vb"].to_numpy()).astype(np.float64)
        aid = a["_ida"].to_numpy().astype(np.int64)
        bid = b["_idb"].to_numpy().astype(np.int64)
        an = (am * am).sum(1)
        out_s, out_d, out_x = [], [], []
        for start in range(0, len(bid), chunk_rows):
            bb = bm[start:start + chunk_rows]
            bi = bid[start:start + chunk_rows]
            if metric == "euclidean":
                d2 = np.maximum(an[:, None] + (bb * bb).sum(1)[None, :] - 2.0 * (am @ bb.T), 0.0)
                hit = d2 <= r2
                vals = np.sqrt(d2)
            else:  # cosine distance on rows assumed unit-norm
                d = 1.0 - am @ bb.T
                hit = d <= radius
                vals = d
            hit &= aid[:, None] != bi[None, :]
            ii, jj = np.nonzero(hit)
            out_s.append(aid[ii]); out_d.append(bi[jj]); out_x.append(vals[ii, jj])
        return pd.DataFrame({"src": np.concatenate(out_s), "dst": np.concatenate(out_d),
                             "dist": np.concatenate(out_x)})

    schema = "src long, dst long, dist double"
    _same_types(left, right, "_a", "_b")
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(run, schema)
