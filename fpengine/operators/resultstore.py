"""RT4: stored results per (query, kind, hash of the inputs), and a cascade that computes what is missing alone.

Layout under ``root``, a shared folder:

* ``<kind>/rows/batch=<id>/``  results, with query_id and input_hash
* ``<kind>/done/batch=<id>/``  (query_id, input_hash) of every query the batch computed, also those without a result
* ``_published/<kind>.<id>``   an empty file, made last; a batch without it does not exist for readers

A run that dies leaves a folder nobody reads, and the next run computes the same queries again. Two runs at once may
compute the same query; readers take the batch with the smaller id, so every result is there once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_tables, stage_table

KEY = ["query_id", "input_hash"]


def table_version(df: DataFrame) -> str:
    """One value for the content of a table, whatever the order of its rows: part of the hash of all that depends on it."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    # two sums of 32 bits each: they cannot overflow
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"), F.sum(F.shiftrightunsigned(h, 32)).alias("hi")).first()
    return f"{got['n']}-{got['lo'] or 0}-{got['hi'] or 0}"


class ResultStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self, kind: str) -> list[str]:
        """Published batches, oldest first; one per run that had something to compute."""
        p, fs = self._fs(f"{self.root}/_published")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(n[len(kind) + 1:] for n in names if n.startswith(kind + "."))

    def _read(self, kind: str, part: str) -> DataFrame | None:
        base = f"{self.root}/{kind}/{part}"
        paths = [f"{base}/batch={b}" for b in self.batches(kind)]
        return self.spark.read.option("basePath", base).parquet(*paths) if paths else None

    def missing(self, kind: str, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` whose (query_id, input_hash) has no published result of the kind."""
        done = self._read(kind, "done")
        return wanted if done is None else wanted.join(done.select(*KEY), KEY, "left_anti")

    def current(self, kind: str, wanted: DataFrame) -> DataFrame:
        """Published rows of the wanted (query_id, input_hash); results for other inputs are stale and stay out."""
        done, rows = self._read(kind, "done"), self._read(kind, "rows")
        if done is None:
            raise ValueError(f"no result of kind {kind} is published")
        pick = done.join(wanted.select(*KEY).distinct(), KEY).groupBy(*KEY).agg(F.min("batch").alias("batch"))
        return rows.join(pick, [*KEY, "batch"]).drop("batch")

    def publish(self, kind: str, todo: DataFrame, rows: DataFrame) -> str:
        """Write the results of the queries of ``todo`` and make them visible at once."""
        batch = f"b{len(self.batches(kind)):08d}-{uuid.uuid4().hex}"
        keys = todo.select(*KEY)
        rows.drop("input_hash").join(keys, "query_id").write.parquet(f"{self.root}/{kind}/rows/batch={batch}")
        keys.write.parquet(f"{self.root}/{kind}/done/batch={batch}")
        p, fs = self._fs(f"{self.root}/_published/{kind}.{batch}")
        fs.create(p, False).close()
        return batch


#: (kind, column of the wanted queries that holds its hash, (queries to compute, current rows by kind) -> rows with query_id)
Stage = tuple[str, str, Callable[[DataFrame, Callable[[str], DataFrame]], DataFrame]]


def cascade(store: ResultStore, queries: DataFrame, stages: Sequence[Stage]) -> dict[str, int]:
    """Run the stages in order, each for the queries alone that lack a result for their present inputs. ``queries`` has a unique,
    non-null query_id, the inputs, and a hash column per kind; a kind that reads another one's rows must have the other's
    hash in its own, so a changed input makes its dependants stale and no others. Returns how many queries each kind computed."""
    computed = {}
    hashes = {kind: col for kind, col, _ in stages}
    for kind, col, compute in stages:
        todo = stage_table(store.missing(kind, queries.withColumn("input_hash", F.col(col))), f"rt4-{kind}")
        computed[kind] = todo.count()
        if computed[kind]:
            def rows_of(other: str, todo: DataFrame = todo) -> DataFrame:
                return store.current(other, todo.withColumn("input_hash", F.col(hashes[other])))
            store.publish(kind, todo, compute(todo, rows_of))
        drop_tables(todo)
    return computed


def current_rows(store: ResultStore, queries: DataFrame, stages: Sequence[Stage], kind: str) -> DataFrame:
    """The rows of one kind for the present inputs of the queries."""
    col = next(c for k, c, _ in stages if k == kind)
    return store.current(kind, queries.withColumn("input_hash", F.col(col)))
