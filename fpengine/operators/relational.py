"""Joins, set operations, filters and top-k helpers (JN*, SET*, FLT*, TOP*)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_status(keys: DataFrame, key: str, table: DataFrame, table_key: str, part_col: str,
                  part_order: Sequence[str]) -> DataFrame:
    """JN14: look a key up across the partitions of a table (partition = ``part_col``);
    status found/not_found and the first partition, in ``part_order``, that holds it."""
    rank = F.create_map(*[x for i, p in enumerate(part_order) for x in (F.lit(p), F.lit(i))])
    hits = table.select(F.col(table_key).alias(key), F.col(part_col).alias("_p")) \
        .withColumn("_r", F.element_at(rank, F.col("_p"))) \
        .groupBy(key).agg(F.min_by("_p", "_r").alias("first_partition"))
    return keys.join(hits, key, "left").withColumn(
        "status", F.when(F.col("first_partition").isNull(), F.lit("not_found")).otherwise(F.lit("found")))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """SNK4: existing rows plus the new rows whose key is not present yet."""
    return existing.unionByName(new.join(existing.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def union_first_wins(frames: Sequence[tuple[DataFrame, int]], key: Sequence[str]) -> DataFrame:
    """SET2: union with a source priority, then the first row per key (lowest priority
    number; ties by the remaining columns)."""
    from .windows import first_per_key
    tagged = [df.withColumn("_src", F.lit(p)) for df, p in frames]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    cols = [c for c in u.columns if c not in key and c != "_src"]
    return first_per_key(u, key, ["_src", *cols]).drop("_src")


def edges_with_endpoints(edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, src: str, dst: str,
                         src_key: str, dst_key: str) -> DataFrame:
    """JN16 / FLT6: keep an edge only when both endpoint nodes exist (two semi-joins)."""
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    e = e.join(src_nodes.select(F.col(src_key).alias(src)).distinct(), src, "left_semi")
    return e.join(dst_nodes.select(F.col(dst_key).alias(dst)).distinct(), dst, "left_semi")


def match_nodes(df: DataFrame, props: dict) -> DataFrame:
    """FLT8: conjunction of property equalities."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in props.items()]))


def complete_keys(df: DataFrame, key: str, kind_col: str, kinds: Sequence[str]) -> DataFrame:
    """FLT9: keys that have a record of every kind."""
    return df.where(F.col(kind_col).isin(list(kinds))).groupBy(key) \
        .agg(F.countDistinct(kind_col).alias("_k")).where(F.col("_k") == len(kinds)).select(key)


def confidence_cut(cands: Column, cut: float = 0.65) -> Column:
    """FLT7: keep candidates with confidence >= cut, else [('unknown', 0.0)]."""
    kept = F.filter(cands, lambda c: c["confidence"] >= cut)
    fallback = F.array(F.struct(F.lit("unknown").alias("name"), F.lit(0.0).alias("confidence")))
    return F.when(F.size(kept) > 0, kept).otherwise(fallback)


def top_k_global(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """TOP1/TOP3/TOP7: global top-k (TakeOrderedAndProject: each task keeps k rows)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], k: int, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """TOP2/TOP10: row_number <= k per group; Spark inserts a partial WindowGroupLimit
    before the shuffle, so each group receives at most k rows per map task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """TOP9: deterministic sample of min(n, rows) rows ordered by md5('<seed>|<key>')."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)).limit(n)


def wide_top3(arr: Column, prefix: str) -> list[Column]:
    """TOP6: array -> three columns, padded with nulls."""
    return [F.try_element_at(arr, F.lit(i)).alias(f"{prefix}{i}") for i in (1, 2, 3)]


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of ``left`` (staged, so cheap to read twice) with ``right``, whose ``key`` is unique. Keys that hold more than one of
    ``4 x shuffle partitions`` equal shares of the rows are at most that many: their rows of ``right`` are broadcast. All other
    keys, and so at most one share per key, go through a shuffle. Rows with a null key match nothing."""
    spark = left.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = left.count() // parts
    heavy = F.broadcast(left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > share + 1000).select(key))
    hot = F.broadcast(right.join(heavy, key, "left_semi").withColumn("_hot", F.lit(True)))
    first = left.join(hot, key, "left")
    names = [c for c in right.columns if c != key]
    done = F.col("_hot").isNotNull() | F.col(key).isNull()
    rest = first.where(~done).drop("_hot", *names).join(right, key, "left")
    return first.where(done).drop("_hot").unionByName(rest)
