"""JN8: neighbours by shared feature nodes, as a T-occurrence search.

A device has one feature node per column; values are hashed once. Devices with equal nodes throughout are one *profile*, and all matching is between
profiles. Nodes that at most ``degree`` profiles hold are *light*, the others *heavy* (the blank of a column, a market leader).

* Two profiles that share a light node meet in its short list; their full count is then read off both value arrays.
* Two profiles that share heavy nodes only have a count that their heavy parts alone decide. The distinct heavy parts are matched instead, by lists of
  pairs of nodes: of the nodes of a part the ``t - 2`` most frequent need no list, as two parts that share ``t`` nodes share two of the
  others. So a blank that a third of the devices hold is never a list of its own (only for t = 1, where it is an answer by itself).

Devices come in last: a list of the best ``m`` neighbours needs at most the ``m`` smallest ids of any profile or heavy part, so a hub never unfolds. A query's
answer is merged from the lists of its seeds without its excluded devices; it is final when its k-th entry ranks no later than the last entry
of every list that was cut. Queries that are not final look deeper, with lists four times as long, until all are: no depth is ever
the last one.

A query's lists travel as arrays, one row per seed profile, and are merged in its one row. Queries with more than ``FEW`` excluded devices (their seeds
are among them), and all once lists are longer than ``SHORT``, are merged row by row instead, so no row grows without bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_tables, stage_table
from .relational import lookup

LIGHT = 256  # a light node's list has at most this many profiles
FEW, SHORT = 64, 1024


def _count(a: str, b: str, n: int):
    """Number of equal places of two value arrays; null (light) places of either count nothing."""
    return reduce(lambda x, y: x + y, [F.coalesce((F.col(a)[i] == F.col(b)[i]).cast("int"), F.lit(0)) for i in range(n)])


def _profile_pairs(prof: DataFrame, seed_prof: DataFrame, light: DataFrame, n: int, t: int) -> DataFrame:
    """(sp, p, s): seed profiles and profiles that share a light node and at least ``t`` in all, and equal profiles."""
    at = prof.select("p", F.posexplode("f").alias("c", "v")).join(light, ["c", "v"]).select("c", "v", "p")
    mine = at.join(seed_prof.select("p"), "p").withColumnRenamed("p", "sp")
    meet = mine.join(at, ["c", "v"]).where("sp <> p").select("sp", "p").distinct()
    both = meet.join(prof.select(F.col("p").alias("sp"), F.col("f").alias("fa")), "sp").join(prof.select("p", "f"), "p")
    near = both.select("sp", "p", _count("fa", "f", n).alias("s")).where(F.col("s") >= t)
    return near.unionByName(seed_prof.select(F.col("p").alias("sp"), "p", F.lit(n).alias("s")))


def _part_pairs(parts: DataFrame, seed_parts: DataFrame, heavy: DataFrame, n: int, t: int) -> DataFrame:
    """(hs, h, s): heavy parts that share at least ``t`` heavy nodes (a part shares all its nodes with itself)."""
    at = parts.select("h", F.posexplode("hf").alias("c", "v")).where("v IS NOT NULL").join(heavy, ["c", "v"])
    rarest, whole = Window.partitionBy("h").orderBy("degree", "c"), Window.partitionBy("h")
    spare = max(t - 2, 0)
    listed = at.withColumn("r", F.row_number().over(rarest)).withColumn("n", F.count(F.lit(1)).over(whole)).where(F.col("r") <= F.col("n") - spare)
    if t == 1:
        keys = listed.select("h", F.xxhash64("c", "v").alias("key"))
    else:
        nodes = listed.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("x"))
        pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, n), lambda b: F.xxhash64(a["c"], a["v"], b["c"], b["v"]))))
        keys = nodes.select("h", F.explode(pairs).alias("key"))
    keys = stage_table(keys, "jn8-keys")
    mine = keys.join(seed_parts, "h").withColumnRenamed("h", "hs")
    meet = mine.join(keys, "key").select("hs", "h").distinct()
    both = meet.join(parts.select(F.col("h").alias("hs"), F.col("hf").alias("fa")), "hs").join(parts.select("h", "hf"), "h")
    return both.select("hs", "h", _count("fa", "hf", n).alias("s")).where(F.col("s") >= t)


def _merged(asked: DataFrame, lists: DataFrame, without: DataFrame, m: int, k: int) -> DataFrame:
    """(q, top, last): the ``k`` first devices (s: negative count, neighbor) of the lists of a query's seeds without its devices ``out``, and the
    first of the last entries of its lists of full length ``m``."""
    short = lists.groupBy("sp").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "neighbor"))).alias("x"))
    each = asked.join(short, "sp").groupBy("q").agg(F.array_sort(F.flatten(F.collect_list("x"))).alias("x"),
                                                    F.min(F.when(F.size("x") >= m, F.element_at("x", -1))).alias("last"))
    kept = F.filter("x", lambda e: ~F.coalesce(F.array_contains(F.coalesce("out", F.array()), e["neighbor"]), F.lit(False)))
    # a device's first entry is its best; the others go
    names = F.slice(F.array_distinct(F.transform("x", lambda e: e["neighbor"])), 1, k)
    left = each.join(without, "q", "left").select("q", kept.alias("x"), "last")
    return left.select("q", F.transform(names, lambda d: F.filter("x", lambda e: e["neighbor"].eqNullSafe(d))[0]).alias("top"), "last")


def shared_feature_neighbors(devices: DataFrame, id_col: str, feature_cols: Sequence[str], seeds: DataFrame, *, q: int = 1, k: int = 5,
                             type_col: str | None = None, query_col: str = "query_id", seed_col: str = "seed_id",
                             exclude: DataFrame | None = None, degree: int = LIGHT, depth: int | None = None) -> DataFrame:
    """For each query the ``k`` devices that share more than ``q`` feature nodes with one of its seeds: (query, neighbor_id, device_type, shared_count,
    rank), the best count over the seeds, by (count desc, id asc), without the query's seeds and the devices in ``exclude`` (query, neighbor_id).
    A null value is a node like any other. ``degree`` and the first ``depth`` set the work, not the result."""
    from .graph import feature_value
    n, t = len(feature_cols), q + 1
    spark = devices.sparkSession
    if t > n:
        return spark.createDataFrame([], f"{query_col} {seeds.schema[query_col].dataType.simpleString()}, neighbor_id "
                                         f"{devices.schema[id_col].dataType.simpleString()}, device_type string, shared_count long, rank int")
    values = F.array(*[F.xxhash64(F.lit(i), feature_value(c)) for i, c in enumerate(feature_cols)])
    kind = F.col(type_col).cast("string") if type_col else F.lit(None).cast("string")
    dev = stage_table(devices.select(F.col(id_col).alias("id"), kind.alias("device_type"), values.alias("f")), "jn8-dev")
    prof = stage_table(dev.groupBy("f").agg(F.min("id").alias("p")), "jn8-prof")
    nodes = stage_table(prof.select(F.posexplode("f").alias("c", "v")).groupBy("c", "v").agg(F.count(F.lit(1)).alias("degree")), "jn8-nodes")
    light, heavy = nodes.where(F.col("degree") <= degree).select("c", "v"), nodes.where(F.col("degree") > degree)
    # the heavy part of a profile: its value array with nulls at the light places
    weights = prof.select("p", F.posexplode("f").alias("c", "v")).join(heavy.select("c", "v"), ["c", "v"])
    held = weights.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("m"))
    hf = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at("m", i))
    prof2 = stage_table(prof.join(held, "p", "left").select("p", "f", F.when(F.col("m").isNotNull(), hf).alias("hf")), "jn8-prof2")
    parts = stage_table(prof2.where("hf IS NOT NULL").groupBy("hf").agg(F.min("p").alias("h")), "jn8-parts")
    prof3 = stage_table(prof2.join(parts, "hf", "left").select("p", "f", "h"), "jn8-prof3")
    own = stage_table(lookup(dev, prof3.select("f", "p", "h"), "f").select("id", "device_type", "p", "h"), "jn8-own")

    excluded = seeds.select(F.col(query_col).alias("q"), F.col(seed_col).alias("neighbor"), F.lit(True).alias("seed"))
    if exclude is not None:
        excluded = excluded.unionByName(exclude.select(F.col(query_col).alias("q"), F.col("neighbor_id").alias("neighbor"), F.lit(False).alias("seed")))
    excluded = stage_table(excluded.groupBy("q", "neighbor").agg(F.max("seed").alias("seed")), "jn8-excluded")
    known = excluded.where("seed").select("q", F.col("neighbor").alias("id")).join(own.select("id", "p", "h"), "id")
    asked = stage_table(known.select("q", F.col("p").alias("sp"), F.col("h").alias("hs")).distinct(), "jn8-asked")
    sp = asked.select(F.col("sp").alias("p"), F.col("hs").alias("h")).distinct()
    pairs = stage_table(_profile_pairs(prof3, prof3.join(sp.select("p"), "p", "left_semi"), light, n, t), "jn8-pairs")
    part_pairs = stage_table(_part_pairs(parts, sp.where("h IS NOT NULL").select("h").distinct(), heavy, n, t), "jn8-parts-pairs")

    def first(by: str, m: int) -> DataFrame:
        w = Window.partitionBy(by).orderBy("id")
        return own.where(F.col(by).isNotNull()).withColumn("r", F.row_number().over(w)).where(F.col("r") <= m).select(by, F.col("id").alias("neighbor"))

    def best(rows: DataFrame, by: str, m: int) -> DataFrame:
        w = Window.partitionBy(by).orderBy(F.col("s").desc(), F.col("neighbor").asc())
        return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= m)

    hubs = stage_table(excluded.groupBy("q").count().where(F.col("count") > FEW).select("q"), "jn8-hubs")
    without = stage_table(excluded.join(hubs, "q", "left_anti").groupBy("q").agg(F.collect_list("neighbor").alias("out")), "jn8-without")
    m, pending, done = depth or k + 1, asked, []
    while True:
        from_light = best(pairs.join(pending.select("sp").distinct(), "sp", "left_semi").join(first("p", m), "p").select("sp", "neighbor", "s"), "sp", m)
        from_heavy = best(part_pairs.join(pending.select("hs").distinct(), "hs", "left_semi").join(first("h", m), "h").select("hs", "neighbor", "s"), "hs", m)
        hs = pending.select("sp", "hs").distinct()
        either = from_light.select("sp", "neighbor", "s").unionByName(hs.join(from_heavy, "hs").select("sp", "neighbor", "s"))
        lists = stage_table(best(either.groupBy("sp", "neighbor").agg(F.max("s").alias("s")), "sp", m), "jn8-lists")
        rows = pending.join(hubs, "q", "left_semi") if m <= SHORT else pending
        fan = rows.join(lists.select("sp", "neighbor", "s"), "sp").groupBy("q", "neighbor").agg(F.max("s").alias("s"))
        top = stage_table(best(fan.join(excluded, ["q", "neighbor"], "left_anti"), "q", k), "jn8-top")
        key = F.struct((-F.col("s")).alias("s"), "neighbor")
        cut = rows.join(lists.where(F.col("r") == m).select("sp", key.alias("last")), "sp").groupBy("q").agg(F.min("last").alias("last"))
        kth = top.where(F.col("r") == k).select("q", key.alias("kth"))
        open_ = cut.join(kth, "q", "left").where("kth IS NULL OR kth > last").select("q")
        if m <= SHORT:
            merged = stage_table(_merged(pending.join(hubs, "q", "left_anti"), lists, without, m, k), "jn8-merged")
            top = top.unionByName(merged.select("q", F.posexplode("top").alias("r", "x")).select("q", "x.neighbor", (-F.col("x.s")).alias("s"), (F.col("r") + 1).alias("r")))
            open_ = open_.unionByName(merged.where(F.col("last").isNotNull() & ((F.size("top") < k) | (F.col("top")[k - 1] > F.col("last")))).select("q"))
        deeper = stage_table(open_, "jn8-deeper")
        drop_tables(lists)
        if deeper.isEmpty():
            done.append(top)
            break
        done.append(top.join(deeper, "q", "left_anti"))
        pending, m = stage_table(asked.join(deeper, "q", "left_semi"), "jn8-pending"), 4 * m
    drop_tables(dev, prof, nodes, prof2, prof3, pairs, part_pairs)
    top = reduce(DataFrame.unionByName, done)
    named = top.join(own.select(F.col("id").alias("neighbor"), "device_type"), "neighbor", "left")
    return named.select(F.col("q").alias(query_col), F.col("neighbor").alias("neighbor_id"), "device_type", F.col("s").cast("long").alias("shared_count"),
                        F.col("r").alias("rank"))
