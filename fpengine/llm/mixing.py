"""Operator 9: mixing sources to target weights by entropy balancing.

Every source has a target number of words. The document rates r are those nearest to 1 in
relative entropy, sum of r ln r - r + 1, under one constraint per source: the sum of
rate * size equals the target, with rates of at most ``max_repeat``. The dual is convex and
separates by source; its solution tilts the rates exponentially in the size,
r = min(max_repeat, exp(lambda * size / mean size)). Newton iterations solve all sources' duals
together as DataFrame aggregations over the histogram (source, size, documents), which is far
smaller than the documents and has no hot row: a source with a third of all rows is only a
histogram of its sizes. Every step is kept inside a bracket, so it can't run away.

Rates become whole copies by error diffusion over the sizes of a source, from long to short: each
size takes the whole number of copies that brings the running total nearest to the running
target, so a source's error is at most about half of its shortest documents. Within one size the
copies go to documents in the order of a hash of the id, ranked by a range exchange, not in one
window.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
documents of size 0 are taken once, which adds no words; repeated ids are separate documents, ranked apart by source and text hash; an empty table
gives an empty result; extra columns are passed through by ``mix``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fpengine.llm.common import discard, n_words, spark_of, stage
from fpengine.operators.windows import distributed_row_number

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Newton stops when every source is this near to its target (as a share of it)
TOLERANCE = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, size). Sources in code point order,
    null last, weigh ``weights`` in turn and share all words; a target stops at ``max_repeat``
    times its source and the excess is shared again by weight until none is above.

    In the order of size / weight the sources that stop come first, and the level of the others
    follows from running sums, so no loop is needed. One row per source; the windows run over
    sources, not documents."""
    src = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull().cast("int"), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("weight", w)
    full = F.col("source_size") * F.lit(max_repeat)
    order = Window.orderBy(full / F.col("weight"), F.col("source").isNull().cast("int"), F.col("source"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    src = src.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(upto), F.lit(0)))
                         / F.sum("weight").over(rest)).withColumn("_rank", F.row_number().over(order))
    # the level that holds: the first one at which the source does not stop
    free = F.when(F.col("_level") * F.col("weight") <= full, F.col("_rank"))
    src = src.withColumn("_first", F.min(free).over(every))
    level = F.max(F.when(F.col("_rank") == F.col("_first"), F.col("_level"))).over(every)
    src = src.withColumn("_hold", level)
    target = F.when(F.col("_rank") < F.col("_first"), full.cast("double")).otherwise(F.col("weight") * F.col("_hold"))
    return src.select("source", "n_docs", "source_size", target.cast("double").alias("target"))


def balance(hist: DataFrame, targets: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Newton iterations on the dual: (source, lam, mean_size). ``hist``: (source, size, n)."""
    t = targets.where("source_size > 0") \
        .select(F.col("source").alias("_s"), "target", "source_size", (F.col("source_size") / F.col("n_docs")).alias("mean"))
    h = hist.where("size > 0")
    # lambda where every rate is max_repeat (or, below, where rates vanish) bounds the search
    state = stage(t.withColumn("lam", F.log(F.col("target") / F.col("source_size"))).withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6))
                  .withColumn("gap", F.lit(1.0)), "mix-state")
    while True:
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        r = F.least(raw, F.lit(float(max_repeat)))
        j = h.join(state, F.col("source").eqNullSafe(F.col("_s")))
        got = j.groupBy("_s", "target", "source_size", "mean", "lam", "lo", "hi").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("got"),
            F.sum(F.when(raw < max_repeat, F.col("n") * F.col("size") * x * raw).otherwise(0.0)).alias("slope"))
        full = F.col("target") >= F.col("source_size") * max_repeat * (1 - 1e-12)
        over = F.col("got") > F.col("target")
        lo = F.when(over, F.col("lo")).otherwise(F.col("lam"))
        hi = F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (step > lo) & (step < hi)
        # outside the bracket: halve it (or double the reach while one side is still open)
        other = F.when(lo <= -1e6, F.least(hi * 2, F.lit(-1.0))).when(hi >= 1e6, F.greatest(lo * 2, F.lit(1.0))).otherwise((lo + hi) / 2)
        gap = F.abs(F.col("got") - F.col("target")) / F.col("target")
        done = full | (gap <= TOLERANCE) | ((hi - lo) <= F.lit(1e-14) * F.greatest(F.abs(hi), F.abs(lo)))
        nxt = stage(got.select("_s", "target", "source_size", "mean",
                               F.when(full, F.lit(1e6)).when(done, F.col("lam")).when(inside, step).otherwise(other).alias("lam"),
                               lo.alias("lo"), hi.alias("hi"), F.when(done, F.lit(0.0)).otherwise(gap).alias("gap")), "mix-state")
        discard(state)
        state = nxt
        if state.where("gap > 0").isEmpty():
            return state.select(F.col("_s").alias("source"), "lam", F.col("mean").alias("mean_size"))


def _diffuse(max_repeat: int):
    """Whole copies per size of one source, long sizes first."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
        size, n = pdf["size"].to_numpy(), pdf["n"].to_numpy()
        rate = np.minimum(np.exp(np.minimum(pdf["lam"].to_numpy() * size / pdf["mean_size"].to_numpy(), 50.0)), max_repeat)
        want = np.cumsum(rate * size * n)
        copies, taken = np.zeros(len(pdf), dtype=np.int64), 0
        for i in range(len(pdf)):
            k = int(np.floor((want[i] - taken) / size[i] + 0.5)) if size[i] else int(n[i])
            copies[i] = min(max(k, 0), max_repeat * int(n[i]))
            taken += int(copies[i]) * int(size[i])
        pdf["copies"] = copies
        return pdf[["source", "size", "n", "copies"]]
    return run


def mix_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, _tie) for every row of ``docs``."""
    spark_of(docs)
    base = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                             F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tie"), F.rand(9).alias("_salt")), "mix-sizes")
    hist = stage(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    targets = stage(source_targets(base.select("source", "size"), weights, max_repeat), "mix-targets")
    lam = balance(hist, targets, max_repeat)
    h = hist.join(lam.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s") \
        .fillna({"lam": 0.0, "mean_size": 1.0})
    plan = stage(h.groupBy("source").applyInPandas(
        _diffuse(max_repeat), "source string, size long, n long, copies long"), "mix-plan")
    ranked = distributed_row_number(base, ["source", "size"],
                                    [F.xxhash64(F.col("doc_id").cast("string"), F.lit(9)), F.col("doc_id"), F.col("_tie"), F.col("_salt")], out="_rn")
    p = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "copies")
    j = ranked.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    each = (F.floor(F.col("copies") / F.col("n")) + F.when(F.col("_rn") <= F.col("copies") % F.col("n"), 1).otherwise(0)).cast("long")
    tt = targets.select(F.col("source").alias("_t"), "source_size", "target")
    out = j.withColumn("k", each).join(tt, F.col("source").eqNullSafe(F.col("_t")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("k").alias("copies"),
                      (F.col("k") * F.col("size")).cast("long").alias("taken"), "_tie")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed documents: every row repeated as often as the mix takes it, columns unchanged.
    Documents without words carry nothing to balance and stay once."""
    counts = mix_counts(docs, doc_id, text, source, weights, max_repeat)
    # rows of equal (id, source, text hash) share their copies: the whole part each, the rest goes to the first of them
    per = stage(counts.groupBy("doc_id", "source", "_tie").agg(F.sum("copies").alias("_mix_sum"), F.count(F.lit(1)).alias("_mix_n"))
                .select(F.col("doc_id").alias("_mix_d"), F.col("source").alias("_mix_s"), F.col("_tie").alias("_mix_t"), "_mix_sum", "_mix_n"),
                "mix-per")
    key = docs.withColumn("_mix_h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))

    def joined(p: DataFrame) -> DataFrame:
        return key.join(p, F.col(doc_id).eqNullSafe(F.col("_mix_d")) & F.col(source).eqNullSafe(F.col("_mix_s")) & (F.col("_mix_h") == F.col("_mix_t")))

    rest = F.col("_mix_sum") % F.col("_mix_n")
    whole = F.floor(F.col("_mix_sum") / F.col("_mix_n"))
    out = joined(per.where(rest == 0)).withColumn("_mix_k", whole.cast("int"))
    uneven = per.where(rest != 0)
    if not uneven.isEmpty():
        # any order among equals; a random one, written down once, so that a group of very many rows is spread over tasks
        odd = stage(joined(uneven).withColumn("_mix_r", F.rand(9)), "mix-uneven")
        odd = distributed_row_number(odd, ["_mix_d", "_mix_s", "_mix_t"], ["_mix_r"], out="_mix_rn")
        odd = odd.withColumn("_mix_k", (whole + F.when(F.col("_mix_rn") <= rest, 1).otherwise(0)).cast("int"))
        out = out.select(*[F.col(f"`{c}`") for c in docs.columns], "_mix_k").unionByName(odd.select(*[F.col(f"`{c}`") for c in docs.columns], "_mix_k"))
    kept = out.where("_mix_k > 0")
    return kept.withColumn("_mix_c", F.explode(F.sequence(F.lit(1), F.col("_mix_k")))).select(*[F.col(f"`{c}`") for c in docs.columns])
