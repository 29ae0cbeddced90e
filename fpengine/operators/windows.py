"""Window-shaped operators (WIN1-WIN8) that stay distributed.

A ``row_number() OVER (PARTITION BY type ORDER BY ...)`` sends every row of a type to one
task; with a type that holds a third of the data that task holds a third of the data.
:func:`distributed_row_number` numbers rows instead through a range exchange on
``(by, order)``: each range partition numbers its own rows, a small table of per-partition
counts gives each partition its offset within the key, and the offsets are joined back.
No group of rows ever needs to fit into a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PID_SHIFT = 1 << 33  # monotonically_increasing_id() = partition_id << 33 | row index


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return left.join(r, cond).drop(*[f"_r_{k}" for k in keys])


def distributed_row_number(df: DataFrame, by: Sequence[str], order: Sequence, out: str = "rn",
                           num_partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by *by order by *order)`` without one task per key.

    ``order`` must make rows unique within ``by`` (add the key as a last tie-break) so that
    a recomputed partition gets the same numbers after an executor loss."""
    spark = df.sparkSession
    n_part = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = _cols(by) + _cols(order)
    ranged = df.repartitionByRange(n_part, *sort_cols).sortWithinPartitions(*sort_cols)
    x = (ranged.withColumn("_pid", F.spark_partition_id())
         .withColumn("_loc", F.monotonically_increasing_id() - F.col("_pid").cast("long") * F.lit(_PID_SHIFT)))
    # Range boundaries come from a sample whose rows depend on the input order; after a
    # shuffle that order can differ between two evaluations, so the numbered frame is
    # materialised once (reliable checkpoint) and both branches read the same rows.
    x = cut_lineage(x)
    stats = x.groupBy("_pid", *by).agg(F.min("_loc").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = _null_safe_join(x, stats.select("_pid", *by, "_first", "_off"), ["_pid", *by])
    return (joined.withColumn(out, F.col("_off") + F.col("_loc") - F.col("_first") + 1)
            .drop("_pid", "_loc", "_first", "_off"))


def seeded_order(key, seed: int = 42) -> Column:
    """Portable pseudo-random order: md5('<seed>|<key>') (same in Spark and DuckDB)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """WIN1 / SET2: first row per key by ``order`` (drop_duplicates keep='first').
    Uses ``max_by``-style aggregation: partial aggregation on the map side, so a hot key
    never has to be gathered in one task."""
    cols = [c for c in df.columns if c not in keys]
    ordk = F.struct(*[(o if isinstance(o, Column) else F.col(o)) for o in order])
    packed = df.select(*keys, ordk.alias("_o"), F.struct(*cols).alias("_v"))
    agg = packed.groupBy(*keys).agg(F.min_by("_v", "_o").alias("_v"))
    return agg.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols])


def kfold_test_membership(df: DataFrame, key: str, type_col: str, *, seed: int = 42, folds: int = 5,
                          big_n: int = 50_000, big_size: int = 20_000) -> DataFrame:
    """WIN2: per type, seeded shuffle; fold f's test set is the slice
    ``[f*size, f*size+size)`` of the shuffled positions, wrapping around the end
    (``size`` = ``big_size`` if n > ``big_n`` else n // folds). Folds overlap when
    5*size > n. Output: key, type, fold (1-based), position (0-based)."""
    numbered = distributed_row_number(df.select(key, type_col), [type_col],
                                      [seeded_order(key, seed), F.col(key)], out="_rn")
    counts = df.groupBy(type_col).agg(F.count(F.lit(1)).alias("_n"))
    size = F.when(F.col("_n") > big_n, F.lit(big_size)).otherwise(F.floor(F.col("_n") / folds))
    j = numbered.join(counts, type_col).withColumn("_size", size.cast("long")) \
        .withColumn("position", F.col("_rn") - 1)
    j = j.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.col("_f") * F.col("_size")
    end = start + F.col("_size")
    test = ((F.col("position") >= start) & (F.col("position") < end)) | (F.col("position") < end - F.col("_n"))
    return j.where(test).select(key, type_col, (F.col("_f") + 1).alias("fold"), "position")


def kfold_train(df: DataFrame, membership: DataFrame, key: str, fold: int) -> DataFrame:
    """Complement of a fold's test set (JN6 anti-join)."""
    return df.join(membership.where(F.col("fold") == fold).select(key), key, "left_anti")


def stratified_fold(df: DataFrame, key: str, label_col: str, *, seed: int = 42, folds: int = 5) -> DataFrame:
    """WIN3: fold id = (seeded rank within label) mod folds, so each fold holds every class
    in proportion."""
    numbered = distributed_row_number(df, [label_col], [seeded_order(key, seed), F.col(key)], out="_rn")
    return numbered.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(folds))).drop("_rn")


def dense_codes(df: DataFrame, col: str, out: str = "code") -> tuple[DataFrame, DataFrame]:
    """WIN4 / ML11: code = rank of the value among the sorted distinct values (0-based).
    Ranks are taken over the distinct values only, then joined back.
    Returns (df with code, mapping value -> code)."""
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    mapping = distributed_row_number(distinct.withColumn("_all", F.lit(0)), ["_all"], [F.col(col)], out="_rn") \
        .select(col, (F.col("_rn") - 1).alias(out))
    return df.join(mapping, col, "left"), mapping


def batch_ids(df: DataFrame, by: Sequence[str], order: Sequence, size: int, out: str = "batch") -> DataFrame:
    """WIN7: fixed-size batches, batch = floor((row_number - 1) / size) per key."""
    numbered = distributed_row_number(df, by, order, out="_rn")
    return numbered.withColumn(out, F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def next_match(df: DataFrame, by: Sequence[str], order: Sequence, predicate: Column, value: Column,
               out: str, num_partitions: int | None = None) -> DataFrame:
    """JN17: for every row, ``value`` of the first *later* row (same ``by`` key, in
    ``order``) for which ``predicate`` holds; null when there is none.

    Distributed forward as-of: rows are range-partitioned on (by, order); inside a
    partition a reversed running frame gives the nearest later match (groups bounded by
    the partition); a small per-(partition, key) table carries the first match of every
    later partition backwards."""
    spark = df.sparkSession
    n_part = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = _cols(by) + _cols(order)
    x = (df.withColumn("_mv", F.when(predicate, value))
         .repartitionByRange(n_part, *sort_cols).sortWithinPartitions(*sort_cols)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_loc", F.monotonically_increasing_id() - F.col("_pid").cast("long") * F.lit(_PID_SHIFT)))
    x = cut_lineage(x)  # see distributed_row_number
    later = Window.partitionBy("_pid", *by).orderBy(F.col("_loc").desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = x.withColumn("_local", F.last("_mv", ignorenulls=True).over(later))
    firsts = x.where(F.col("_mv").isNotNull()).groupBy("_pid", *by).agg(F.min_by("_mv", "_loc").alias("_first"))
    carry_w = Window.partitionBy(*by).orderBy(F.col("_pid").desc()).rowsBetween(Window.unboundedPreceding, -1)
    keys = x.select("_pid", *by).distinct().join(firsts, ["_pid", *by], "left")
    carry = keys.withColumn("_carry", F.last("_first", ignorenulls=True).over(carry_w)).select("_pid", *by, "_carry")
    res = _null_safe_join(local, carry, ["_pid", *by])
    return res.withColumn(out, F.coalesce("_local", "_carry")).drop("_mv", "_pid", "_loc", "_local", "_carry")
