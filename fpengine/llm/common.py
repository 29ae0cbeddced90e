"""Helpers shared by the training-data operators: staged tables, components, text kernels."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fpengine.session import ensure_checkpoint_dir, prepare_session

#: white space of the contracts: space and the control characters 9 to 13
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: the setting that bounds an Arrow batch by bytes, and the bound where kernels ask for small ones
ARROW_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spark_of(df: DataFrame) -> SparkSession:
    spark = df.sparkSession
    prepare_session(spark)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for what runs inside; the session's own value comes back after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession):
    """Arrow batches of a few MB for what runs inside: by rows alone a batch holds 10 000 texts or bitmaps, and it stands in
    the JVM and, more than once, in the Python worker."""
    return setting(spark, ARROW_BYTES, BATCH)


def _bytes(size: str) -> int:
    """A size of Spark's settings (``10485760b``, ``256k``, ``-1``) in bytes."""
    number = size.strip().lower().rstrip("b").rstrip("i")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(number[-1:], 0)
    return int(number[:-1] if unit else number) << unit


def small_broadcasts(spark: SparkSession):
    """Joins inside broadcast a side of 1 MB at most (or of the session's own limit, if that is less). The limit counts compressed
    files, while the driver holds the rows, their hash table and its blocks, more than ten times as much for columns of ids, for several joins of a plan at once."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    return setting(spark, key, str(min(_bytes(spark.conf.get(key)), 1 << 20)))


SEGMENT = 8192  # places that a task puts together for ``packed``


def packed(rows: DataFrame, at: str, value: str, kind: str, length: int) -> np.ndarray:
    """Rows (place, value), places unique, as one array; the other places are 0. Tasks put the rows together in segments, so the driver receives the array's
    own bytes and not a row per place."""
    def run(pdf):
        x, place = np.zeros(SEGMENT, dtype=kind), pdf[at].to_numpy(dtype=np.int64)
        x[place % SEGMENT] = pdf[value].to_numpy()
        return pd.DataFrame({"seg": [place[0] // SEGMENT], "data": [x.tobytes()]})

    out = np.zeros(-(-length // SEGMENT) * SEGMENT, dtype=kind)
    for r in rows.groupBy(F.floor(F.col(at) / SEGMENT).alias("seg")).applyInPandas(run, "seg long, data binary").collect():
        out[r["seg"] * SEGMENT:(r["seg"] + 1) * SEGMENT] = np.frombuffer(r["data"], dtype=kind)
    return out[:length]


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back. This cuts
    the lineage like ``checkpoint()``: a lost executor costs no recomputation of what came
    before, and every branch reads the same rows. The files are columnar and compressed, so
    later reads can prune columns. The path is kept on the frame for ``discard``.
    The shuffle files of the written plan go with the end of the write: nothing reads them again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/fpengine-{tag}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hpath, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of plans that are done: it acts when
    the driver's JVM collects the handles, which by itself may take half an hour. The last plan's handles are only given up by the second
    collection (one alone left its files in place until the next call)."""
    import gc

    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()


def column_or_null(df: DataFrame, name: str, kind: str):
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def whole_text(col: str = "text"):
    """The text; a null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(key: str, mod: int):
    """crc32 of the key as text, modulo ``mod``; -1 for a null key (then never a fold)."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(mod)), F.lit(-1))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def words(col):
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null. Split at runs of white space, which takes time in proportion to the text;
    an end that is white space leaves an empty string there, which is dropped."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACES, -1), lambda w: w != "")


def n_words(col):
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.size(words(col)).cast("long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds_before_jump: int = 1) -> DataFrame:
    """Smallest reachable id of every id that occurs in ``edges`` (columns a, b; self-links and
    repeats allowed). Returns (id, component_id).

    Every round hooks each node to its smallest neighbour (partial aggregation, so a node with
    very many links is no hot group), follows the pointer once more, relabels both ends of all
    links and drops those that became loops. A node that is smaller than all its neighbours is
    the only kind that stays, so at most half of the nodes are left after a round and the
    number of rounds is logarithmic. Rounds go on until no link is left: there is no limit.
    Every round's tables are written to the shared checkpoint folder."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-links")
    comp = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")) \
            .select("id", F.least("id", "m").alias("p"))
        hook = stage(hook, "cc-hook")
        up = hook.select(F.col("id").alias("p"), F.col("p").alias("q"))
        jump = stage(hook.join(up, "p", "left").select("id", F.coalesce("q", "p").alias("f")), "cc-jump")
        fu = jump.select(F.col("id").alias("u"), F.col("f").alias("fu"))
        fv = jump.select(F.col("id").alias("v"), F.col("f").alias("fv"))
        nxt = e.join(fu, "u").join(fv, "v").where("fu <> fv") \
            .select(F.greatest("fu", "fv").alias("u"), F.least("fu", "fv").alias("v")).distinct()
        nxt = stage(nxt, "cc-links")
        if comp is None:
            new = jump.select("id", F.col("f").alias("component_id"))
        else:
            new = comp.join(jump.select(F.col("id").alias("component_id"), "f"), "component_id", "left") \
                .select("id", F.coalesce("f", "component_id").alias("component_id"))
        new = stage(new, "cc-comp")
        discard(e, hook, jump, *([comp] if comp is not None else []))
        e, comp = nxt, new
    discard(e)
    if comp is None:
        return e.sparkSession.createDataFrame([], "id long, component_id long")
    return comp


# --- numpy kernels over a batch of texts (used inside mapInArrow) --------------------------

_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_MINV = np.uint64(pow(int(_M), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits (a bijection)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, kept between batches."""
    have = _POW.get("m")
    if have is None or len(have) < n + 1:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for name, base in (("m", _M), ("i", _MINV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POW[name] = np.cumprod(p, dtype=np.uint64)
    return _POW["m"], _POW["i"]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = sum of values[t] * M^t over i <= t < j (modulo 2^64)."""
    m, _ = powers(len(values))
    s = np.empty(len(values) + 1, dtype=np.uint64)
    s[0] = 0
    np.cumsum(values * m[:len(values)], out=s[1:])
    return s


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the run stands and whatever is around it."""
    _, inv = powers(len(s))
    return mix64((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_blocks(batch, column: str = "text", most: int = 4_000_000):
    """Slices (first row, number of rows, bytes, offsets) of an Arrow batch, each of about
    ``most`` bytes at most or a single longer text, so that a kernel's memory is bounded by the
    longest text and not by the batch. bytes holds the texts one after the other."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if n == 0:
        return
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j - i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """ASCII A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


# --- neighbours in a global order ----------------------------------------------------------

def block_numbers(df: DataFrame, key: str, blocks: int | None = None):
    """A function of a column that numbers its ranges in the order of ``df``'s keys. Only the keys are range-partitioned to find the
    bounds; as many bounds as blocks reach the driver, four per shuffle partition unless ``blocks`` says otherwise."""
    spark = df.sparkSession
    count = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(key).alias("k"))
    got = keys.repartitionByRange(count, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("lo")).collect()
    bounds = sorted({r["lo"] for r in got})
    if not bounds:
        return lambda c: F.lit(0).cast("long")
    shared = spark.sparkContext.broadcast(np.array(bounds, dtype=object if isinstance(bounds[0], str) else np.int64))

    @pandas_udf("long")
    def block_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, k.to_numpy(), side="right") - 1)

    return lambda c: block_of(F.col(c))


def with_blocks(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_block``, the number of the row's range of keys."""
    return df.withColumn("_block", block_numbers(df, key)(key))


def ordered_blocks(df: DataFrame, key: str, unique: str):
    """Deal ``df`` into blocks of neighbouring keys so that every row meets the row before and the
    row after it in its own block, whatever the blocks are. Returns ``df`` with

    * ``_block``: number of the block,
    * ``_role``: 0 for the last row of the block before (a copy), 1 for the block's own rows, 2 for the
      first row of the block after (a copy; after the last block comes the first),

    dealt by block and sorted by block, role, key and ``unique``. Only the keys are range-partitioned to
    find the bounds; as many bounds as blocks reach the driver, and there are four blocks per shuffle
    partition. A key that repeats stays in one block, next to its equals."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = with_blocks(df, key)
    ends = d.groupBy("_block").agg(F.max(key).alias("hi"), F.min(key).alias("lo")).orderBy("_block").collect()
    ids = [r["_block"] for r in ends]
    extra = []
    for i, r in enumerate(ends):
        extra.append((r["hi"], r["_block"], ids[(i + 1) % len(ids)], 0))
        extra.append((r["lo"], r["_block"], ids[i - 1], 2))
    t = dict(df.dtypes)[key]
    if extra:  # two rows per block: small by construction
        copies = F.broadcast(spark.createDataFrame(extra, f"_ob_key {t}, _from long, _to long, _role2 int"))
        moved = d.join(copies, (F.col(key) == F.col("_ob_key")) & (F.col("_block") == F.col("_from")))
        moved = moved.withColumn("_block", F.col("_to")).withColumn("_role", F.col("_role2")).drop("_ob_key", "_from", "_to", "_role2")
        d = d.withColumn("_role", F.lit(1)).unionByName(moved.select(*d.columns, "_role"))
    else:
        d = d.withColumn("_role", F.lit(1))
    return d.repartition(parts, "_block").sortWithinPartitions("_block", "_role", key, unique)
