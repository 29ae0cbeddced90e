"""Fuzzy join by containment without a shared key (JN13): all strings of one side that stand inside strings of the other, or hold them.

A contained string is looked up by its rarest gram of three characters (strings of one or two characters by themselves), rarest by the number of
distinct strings on the other side that hold it. A string one of whose grams occurs nowhere is out before the join. The join is on the gram,
its candidates are checked with ``contains``, and a gram held by very many strings is left to the skew join of an ordinary equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _distinct(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.select(F.col(col).cast("string").alias(out)).where(F.length(out) > 0).distinct()


def _grams(col: str, n: int):
    """Distinct runs of ``n`` characters, found in one pass over the string."""
    return F.array_distinct(F.regexp_extract_all(F.col(col), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def substring_pairs(parts: DataFrame, wholes: DataFrame, part: str, whole: str) -> DataFrame:
    """Distinct (part, whole) strings where the part stands inside the whole; null and empty strings match nothing."""
    s, t = _distinct(parts, part, "part"), _distinct(wholes, whole, "whole")
    sizes = sorted(r["n"] for r in s.select(F.least(F.length("part"), F.lit(GRAM)).alias("n")).distinct().collect())  # three numbers at most
    if not sizes:
        return s.select("part", F.col("part").alias("whole")).limit(0)
    held = t.select("whole", F.explode(F.concat(*[_grams("whole", n) for n in sizes])).alias("gram"))
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("part") < GRAM, F.array("part")).otherwise(_grams("part", GRAM))
    keyed = s.select("part", F.explode(own).alias("gram")).join(counts, "gram", "left")
    rarest = keyed.groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"),
                                       F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    return rarest.select("part", "gram").join(held, "gram").where(F.contains("whole", "part")).select("part", "whole")


def containment_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Distinct pairs (left, right) of strings of which either contains the other."""
    inside = substring_pairs(left, right, left_col, right_col).select(F.col("part").alias("left"), F.col("whole").alias("right"))
    holds = substring_pairs(right, left, right_col, left_col).select(F.col("whole").alias("left"), F.col("part").alias("right"))
    return inside.union(holds.where(F.col("left") != F.col("right")))
