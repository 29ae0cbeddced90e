"""Inverted file over vectors (VEC5): coarse cells, residual product codes, exact rerank, appends.

Build: about sqrt(n) k-means cells, fitted on a hash-drawn sample of about ``64 * cells`` rows; every row is then assigned to its
nearest centre and its residual is coded with one byte per four dimensions (codebooks of at most 256 words, fitted on about 16 384
sampled residuals, one task per slice of dimensions). The index is a folder::

    model/        centres and codebooks; at most MAX_CELLS centres, so it may be broadcast
    rows/batch=b  id, cell, code, vec, laid out by ranges of (cell, id): a file holds few cells, a hot cell many files
    cells/batch=b rows per cell, written last: a batch counts only when this table is there

Search has two steps, and neither makes a row per pair. Queries go to the cells of their ``probes`` best centres and are co-grouped there
with codes alone; a lookup table per query scores a block and its best ``depth`` leave the task. The best ``depth`` of a query then go back to
their blocks, where the vectors score them exactly. A cell of many rows is cut into slices by hash of the id, one that many queries probe is
cut by hash of the query too, so that no group grows with the data; both numbers follow from counts per cell.

``tune`` sets ``probes`` and ``depth`` from measured recall: it searches a hash-drawn sample of stored rows exactly, reads off how many centres
hold the aimed share of their neighbours, and raises ``depth`` until the codes keep them.

Defined results: vectors that are null, of another length than the index, or hold null or non-finite components are neither stored nor
answered; under cosine nor are zero vectors. Rows with null ids are left out. An id is stored once: of repeated ids one vector stays (the
largest), and ``append`` leaves stored ids as they are, which makes a repeated append harmless. Ties go to the smaller id. An index over no
rows answers nothing, and its first non-empty ``append`` fits it. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .knn import _same_types, _topk_rows, exact_topk

MAX_CELLS = 16_384  # bound of the broadcast model: MAX_CELLS * dim doubles
FIT_PER_CELL = 64  # sampled rows per centre
CODE_FIT_ROWS = 16_384  # sampled residuals per codebook
WIDTH = 4  # dimensions per code byte
SLICE_ROWS = 8_192  # rows of a cell in one group
PART_QUERIES = 2_048  # queries of a cell in one group
CHUNK = 2_048  # rows scored at once


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, dim))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre per row, smallest index among equals."""
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([np.argmax(x[i:i + CHUNK] @ centres.T - half, axis=1) for i in range(0, len(x), CHUNK)]
                          or [np.empty(0, dtype=np.int64)])


def fit_codebook(x: np.ndarray, words: int = 256, rounds: int = 12) -> np.ndarray:
    """Plain k-means over distinct rows, started at rows evenly spaced in sorted order."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= words:
        return distinct
    centres = distinct[np.linspace(0, len(distinct) - 1, words).astype(int)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=words)
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=words) for d in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _slices(dim: int) -> list[tuple[int, int]]:
    return [(a, min(dim, a + WIDTH)) for a in range(0, dim, WIDTH)]


def _encoder(model):
    def run(batches):
        centres, books = model.value
        dim = centres.shape[1]
        for b in batches:
            x = _matrix(b["vec"], dim)
            cell = _nearest(x, centres)
            rest = x - centres[cell]
            codes = np.stack([_nearest(rest[:, a:z], book) for (a, z), book in zip(_slices(dim), books)], axis=1).astype(np.uint8)
            yield pd.DataFrame({"id": b["id"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in codes], "vec": b["vec"]})
    return run


def _prober(model, probes: int):
    def run(batches):
        centres = model.value[0]
        ids = np.arange(len(centres))
        for b in batches:
            x = _matrix(b["qvec"], centres.shape[1])
            for i in range(0, len(x), CHUNK):
                score = x[i:i + CHUNK] @ centres.T
                _, cells = _topk_rows(score, np.broadcast_to(ids, score.shape), min(probes, len(ids)))
                yield pd.DataFrame({"query_id": b["query_id"].iloc[i:i + CHUNK], "qvec": b["qvec"].iloc[i:i + CHUNK], "cells": list(cells.astype(np.int32))})
    return run


def _code_scorer(model, depth: int, exclude_same_id: bool):
    def run(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "id": [], "cell": [], "approx": []})
        centres, books = model.value
        dim, cell = centres.shape[1], int(key[0])
        x = _matrix(q["qvec"], dim)
        qids, ids = q["query_id"].to_numpy(), c["id"].to_numpy()
        codes = np.frombuffer(b"".join(c["code"]), dtype=np.uint8).reshape(len(c), -1)
        tables = [x[:, a:z] @ book.T for (a, z), book in zip(_slices(dim), books)]
        base = x @ centres[cell]
        best_s, best_i = np.empty((len(x), 0)), np.empty((len(x), 0), dtype=np.int64)
        for i in range(0, len(ids), CHUNK):
            part, pid = codes[i:i + CHUNK], ids[i:i + CHUNK]
            score = np.repeat(base[:, None], len(pid), axis=1)
            for s, table in enumerate(tables):
                score += table[:, part[:, s]]
            if exclude_same_id:
                score[qids[:, None] == pid[None, :]] = -np.inf
            best_s, best_i = _topk_rows(np.hstack([best_s, score]), np.hstack([best_i, np.broadcast_to(pid, score.shape)]), depth)
        out = pd.DataFrame({"query_id": np.repeat(qids, best_s.shape[1]), "id": best_i.ravel(), "cell": cell, "approx": best_s.ravel()})
        return out[np.isfinite(out["approx"].to_numpy())]
    return run


def _reranker(dim: int):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        order = np.argsort(c["id"].to_numpy())
        ids = c["id"].to_numpy()[order]
        v = _matrix(c["vec"], dim)[order]
        out = []
        for qid, qvec, wanted in zip(q["query_id"], q["qvec"], q["ids"]):
            at = np.searchsorted(ids, np.asarray(wanted, dtype=np.int64))
            out.append(pd.DataFrame({"query_id": qid, "id": ids[at], "score": v[at] @ np.asarray(qvec, dtype=np.float64)}))
        return pd.concat(out, ignore_index=True)
    return run


def _clean(df: DataFrame, id_col: str, vec_col: str, metric: str, dim: int | None = None) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")) \
        .where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad)
    if dim is not None:
        out = out.where(F.size("vec") == dim)
    if metric == "cosine":
        from ..functions.vectors import l2_norm, l2_normalize
        out = out.where(l2_norm("vec") > 0).select("id", l2_normalize("vec").alias("vec"))
    return out


def _drawn(df: DataFrame, rows: int, n: int, salt: int) -> DataFrame:
    """About ``rows`` of the ``n`` rows, by a threshold on a hash of the id: the same rows in every run."""
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 40)) < int(rows / n * (1 << 40)))


class VectorIndex:
    """An index folder; see the module text. ``probes`` and ``depth`` are what ``search`` uses unless told otherwise."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "ip"):
        if metric not in ("ip", "cosine"):
            raise ValueError(f"metric {metric}: ip or cosine")
        self.spark, self.path, self.metric = spark, path.rstrip("/"), metric
        self.probes, self.depth = 8, 128
        self._model = None

    @classmethod
    def build(cls, df: DataFrame, path: str, *, id_col: str = "id", vec_col: str = "vec", metric: str = "ip", cells: int | None = None) -> VectorIndex:
        index = cls(df.sparkSession, path, metric)
        index.append(df, id_col=id_col, vec_col=vec_col, cells=cells)
        return index

    def _exists(self, part: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def model(self):
        """Broadcast (centres, codebooks); None when nothing has been stored."""
        if self._model is None and self._exists("model/_SUCCESS"):
            got = self.spark.read.parquet(f"{self.path}/model").orderBy("kind", "slot", "word").collect()  # at most MAX_CELLS + 64 dim rows
            centres = np.array([r.vec for r in got if r.kind == "centre"])
            books = [np.array([r.vec for r in got if r.kind == "code" and r.slot == s]) for s in range(len(_slices(centres.shape[1])))]
            self._model = self.spark.sparkContext.broadcast((centres, books))
        return self._model

    def _batches(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/cells") if self._exists("cells") else None

    def cells(self) -> DataFrame:
        """Rows per cell over all finished batches; at most MAX_CELLS rows."""
        return self._batches().groupBy("cell").agg(F.sum("n").alias("n"))

    def rows(self) -> DataFrame:
        """The stored rows of all finished batches."""
        done = [r.batch for r in self._batches().select("batch").distinct().collect()]  # one per append
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("batch").isin(done))

    def _fit(self, rows: DataFrame, n: int, cells: int | None) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        k = min(MAX_CELLS, max(1, cells or math.ceil(math.sqrt(n))))
        dim = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()["dim"]
        rows = rows.where(F.size("vec") == dim)
        sample = _drawn(rows, FIT_PER_CELL * k, n, 1).cache()
        if k > 1 and sample.count() > 1:
            fitted = KMeans(k=k, seed=42, featuresCol="f", maxIter=10).fit(sample.select(array_to_vector("vec").alias("f")))
            centres = np.array(fitted.clusterCenters())
        else:
            centres = np.array([rows.select("vec").first()["vec"]])
        held = self.spark.sparkContext.broadcast(centres)
        spans = _slices(dim)

        def rest(batches):
            for b in batches:
                x = _matrix(b["vec"], dim)
                x = x - held.value[_nearest(x, held.value)]
                for s, (a, z) in enumerate(spans):
                    yield pd.DataFrame({"slot": np.int32(s), "part": list(x[:, a:z])})

        def book(key, pdf):
            x = np.vstack(pdf["part"].to_numpy())
            words = fit_codebook(x[np.lexsort(x.T)])  # order of arrival must not matter
            return pd.DataFrame({"kind": "code", "slot": key[0], "word": np.arange(len(words), dtype=np.int32), "vec": list(words)})

        schema = "kind string, slot int, word int, vec array<double>"
        codes = _drawn(sample, CODE_FIT_ROWS, min(n, FIT_PER_CELL * k), 2).select("vec").mapInPandas(rest, "slot int, part array<double>") \
            .groupBy("slot").applyInPandas(book, schema)
        own = self.spark.createDataFrame([("centre", 0, i, [float(v) for v in c]) for i, c in enumerate(centres)], schema)
        own.unionByName(codes).write.mode("overwrite").parquet(f"{self.path}/model")
        sample.unpersist()

    def append(self, df: DataFrame, *, id_col: str = "id", vec_col: str = "vec", cells: int | None = None) -> int:
        """Store rows whose ids are new under the centres and codes as they are; fits them when the index has none. Returns the number of rows stored."""
        model = self.model()
        rows = _clean(df, id_col, vec_col, self.metric, None if model is None else model.value[0].shape[1])
        rows = rows.groupBy("id").agg(F.max("vec").alias("vec"))
        if model is None:
            n = rows.count()
            if n == 0:
                return 0
            self._fit(rows, n, cells)
            model = self.model()
            rows = rows.where(F.size("vec") == model.value[0].shape[1])
        batch = 0
        if self._batches() is not None:
            batch = self._batches().agg(F.max("batch")).first()[0] + 1
            rows = rows.join(self.rows().select("id"), "id", "left_anti")
        coded = rows.mapInPandas(_encoder(model), "id long, cell int, code binary, vec array<double>")
        target = f"{self.path}/rows/batch={batch}"  # an unfinished batch of this number is written anew
        coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(target)
        per_cell = self.spark.read.parquet(target).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        per_cell.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells/batch={batch}")
        return self.spark.read.parquet(f"{self.path}/cells/batch={batch}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def search(self, queries: DataFrame, k: int, *, query_id: str = "query_id", query_vec: str = "qvec", probes: int | None = None,
               depth: int | None = None, exclude_same_id: bool = False) -> DataFrame:
        """Per query the ``k`` best of what its probed cells and codes keep: query_id, id, score (exact), rank."""
        model = self.model()
        if model is None:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        centres = model.value[0]
        dim, depth = centres.shape[1], max(k, depth or self.depth)
        q = _clean(queries, query_id, query_vec, self.metric, dim).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
        sent = q.mapInPandas(_prober(model, probes or self.probes), "query_id long, qvec array<double>, cells array<int>") \
            .select("query_id", "qvec", F.explode("cells").alias("cell"))
        layout = sent.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).join(self.cells(), "cell") \
            .select("cell", F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("slices"), F.ceil(F.col("asked") / PART_QUERIES).cast("int").alias("parts"))
        layout = F.broadcast(layout)  # at most MAX_CELLS rows of three ints
        part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part")
        slice_ = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice")
        keys = ["cell", "slice", "part"]

        def stored(*columns):
            return self.rows().join(layout, "cell").select("cell", slice_, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *columns)

        asked = sent.join(layout, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), part, "query_id", "qvec")
        codes = stored("id", "code")
        _same_types(asked, codes, *keys)
        scored = asked.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInPandas(
            _code_scorer(model, depth, exclude_same_id), "query_id long, id long, cell int, approx double")
        w = Window.partitionBy("query_id").orderBy(F.desc("approx"), "id")
        kept = scored.withColumn("at", F.row_number().over(w)).where(F.col("at") <= depth)
        lists = kept.join(layout, "cell").select("cell", slice_, part, "query_id", "id").groupBy(*keys, "query_id").agg(F.collect_list("id").alias("ids"))
        lists = lists.join(q, "query_id")
        vectors = stored("id", "vec")
        _same_types(lists, vectors, *keys)
        exact = lists.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInPandas(_reranker(dim), "query_id long, id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def tune(self, k: int, *, aim: float = 0.95, queries: int = 256) -> dict[str, float]:
        """Set ``probes`` and ``depth`` so that about ``queries`` stored rows find the ``aim`` share of their exact ``k`` neighbours. One exact
        search of those rows over the index; at most ``queries * k`` pairs are looked at on the driver."""
        if self.model() is None:
            return {"probes": self.probes, "depth": self.depth, "recall": 1.0}
        model, total = self.model(), self.cells().agg(F.sum("n")).first()[0]
        drawn = _drawn(self.rows(), queries, total, 3).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
        true = exact_topk(drawn, self.rows().select("id", "vec", "cell"), k, payload=("cell",), exclude_same_id=True)
        ranks = drawn.mapInPandas(_prober(model, len(model.value[0])), "query_id long, qvec array<double>, cells array<int>")
        found = true.join(ranks, "query_id").select("query_id", "id", F.array_position("cells", F.col("cell")).alias("at")).collect()
        if not found:
            return {"probes": self.probes, "depth": self.depth, "recall": 1.0}
        at = sorted(r["at"] for r in found)
        self.probes = int(at[min(len(at) - 1, math.ceil((1 + aim) / 2 * len(at)) - 1)])
        pairs = {(r["query_id"], r["id"]) for r in found}
        self.depth = 16 * k
        while True:
            got = self.search(drawn, k, exclude_same_id=True).select("query_id", "id").collect()
            recall = sum((r["query_id"], r["id"]) in pairs for r in got) / len(pairs)
            if recall >= aim or self.depth >= total:
                return {"probes": self.probes, "depth": self.depth, "recall": recall}
            self.depth *= 4
