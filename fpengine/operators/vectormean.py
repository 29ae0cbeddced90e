"""Means of whole vectors per key (AGG23, ML6, VEC9, VEC12): one partial sum per key and task, no row per element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str | Column, out: str = "mean") -> DataFrame:
    """(keys, ``out``): the element-wise mean of the vectors of every key.

    A task sends one partial sum per key, so a key that holds a third of all rows costs its reader one row per task.
    Rows whose vector is null do not count, and a key that has no other row is left out. The vectors of a key must
    have one length and no null element; anything else is an error, as a mean over fewer elements would hide it."""
    v = F.col(vec) if isinstance(vec, str) else vec
    some = df.select(*keys, V.as_double(v).alias("_mv")).where("_mv IS NOT NULL")
    mean = Summarizer.mean(array_to_vector("_mv"))
    return some.groupBy(*keys).agg(mean.alias("_mm")).select(*keys, vector_to_array("_mm").alias(out))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(variance + eps) over the elements of an array, without learnt scale and shift."""
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    # lambdas may not refer to row values (they would be computed per element): the statistics travel as a struct
    stats = F.struct((total / n).alias("m"), F.sqrt(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0)) + eps).alias("s"))
    return F.zip_with(v, F.array_repeat(stats, n), lambda x, t: (x - t["m"]) / t["s"])
