"""Operator 12: filter interaction audit by decision diagrams.

Every document gets a mask of the filters that it fails. The masks are counted per part (rows, rows of good quality, toxic rows),
which leaves at most 2^filters weights per part, whatever its size. Per part the weights become an ordered decision
diagram: one level per filter, a pass edge and a fail edge per node, equal subgraphs shared, and every node carrying the weight of all
documents below it. A neighbouring pair of levels can be swapped by rebuilding only the nodes of those two levels; a walk of
single swaps visits every order of the filters. In each order the path of pass edges from the root gives the steps: at a level
the fail child's weight is what the filter removes there and the pass child's weight is what it keeps.

The filters of the audit (words: maximal ``[^\\x20\\x09-\\x0D]+``): A fewer than 200 words, B fewer distinct words than half of the words,
C more than 2% of the code points in ``[A-Z]``, D any of ``#$%&*|``, E the text of a smaller doc_id.

Identity of texts is SHA-256 with the length; only digests are shuffled, never texts. Keys that hold more than a small share of the rows
(copies of one text, one repeated id) are looked up from a broadcast table whose size that share bounds, so that no task gets them.

Defined results: a null text is empty; a null source is the part ''; a null doc_id has no labels, never fails E and makes no other
document fail it; rows that repeat an id and a text count each and do not fail E for one another; of repeated labels of an id the larger
count; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpengine.llm.common import discard, spark_of, stage, whole_text, words
from fpengine.operators.relational import lookup

FILTERS = "ABCDE"
OUT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
       "toxic_lost long, shapley long")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest): bits 0 to 3 of mask are the failures of A to D, which a text decides alone."""
    t = whole_text("text")
    d = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), t.alias("t"), words(t).alias("w"))
    n, chars = F.size("w"), F.length("t")
    tests = [n < 200, 100 * F.size(F.array_distinct("w")).cast("long") < 50 * n.cast("long"),
             100 * F.regexp_count("t", F.lit("[A-Z]")).cast("long") > 2 * chars.cast("long"), F.col("t").rlike("[#$%&*|]")]
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(tests)), F.lit(0))
    return d.select("doc_id", "part", mask.cast("int").alias("mask"), F.concat(F.unhex(F.sha2("t", 256)), F.hex(chars).cast("binary")).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the set of filters that they fail."""
    spark_of(docs)
    rows = stage(failures(docs), "audit-rows")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    per_id = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    full = stage(lookup(rows, copies, "digest").drop("digest"), "audit-copies")
    full = lookup(full, per_id, "doc_id")
    later = F.when(F.col("doc_id") > F.col("first_id"), F.lit(1 << 4)).otherwise(F.lit(0))
    out = stage(full.groupBy("part", (F.col("mask") + later).alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("toxic")), "audit-masks")
    discard(rows)
    return out


class Diagram:
    """Ordered decision diagram over failure masks. ``order[k]`` is the filter tested at level k; a node is a pair (pass child, fail
    child) of node numbers, shared within its level; the numbers of the last level's children are those of the weights."""

    def __init__(self, weights: dict[int, tuple[int, ...]], filters: int):
        self.order = list(range(filters))
        self.weights = sorted(set(weights.values()) | {(0,) * len(next(iter(weights.values())))})
        leaf = {w: i for i, w in enumerate(self.weights)}
        self.levels: list[list[tuple[int, int]]] = [[] for _ in range(filters)]
        none = leaf[(0,) * len(self.weights[0])]

        def build(level: int, mask: int) -> int:
            if level == filters:
                return leaf.get(weights.get(mask), none)
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _node(self, level: int, low: int, high: int) -> int:
        nodes = self.levels[level]
        if (low, high) not in nodes:
            nodes.append((low, high))
        return nodes.index((low, high))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below. Levels above and below the two stay as they are: every upper node
        keeps its number and its meaning, only the middle two decisions change places."""
        upper, lower = self.levels[level], self.levels[level + 1]
        self.levels[level], self.levels[level + 1] = [], []
        for low, high in upper:
            (ll, lh), (hl, hh) = lower[low], lower[high]
            node = (self._node(level + 1, ll, hl), self._node(level + 1, lh, hh))
            self.levels[level].append(node)  # distinct functions stay distinct, so numbers stay valid
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def weight(self) -> list[list[tuple[int, ...]]]:
        """Weight of every node, level by level, the weights of the masks last."""
        out = [self.weights]
        for nodes in reversed(self.levels):
            below = out[0]
            out.insert(0, [tuple(a + b for a, b in zip(below[low], below[high])) for low, high in nodes])
        return out

    def steps(self):
        """(filter, weight kept, weight removed) along the path of pass edges."""
        weight, at = self.weight(), self.root
        for level, f in enumerate(self.order):
            low, high = self.levels[level][at]
            yield f, weight[level + 1][low], weight[level + 1][high]
            at = low


def swaps(n: int):
    """Levels to swap, one after the other, so that all orders of ``n`` filters occur once: the last filter runs through each order
    of the others, downwards and upwards in turn, and the others move on by one swap in between."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        step = next(inner, None)
        if step is None:
            return
        yield step + (1 if down else 0)
        down = not down


def audit_part(weights: dict[int, tuple[int, int, int]], names: str = FILTERS) -> list[tuple]:
    """All orders and steps of one part: rows of the result without the part."""
    n = len(names)
    diagram = Diagram(weights, n)
    fails = [sum(w[0] for m, w in weights.items() if m >> f & 1) for f in range(n)]
    only = [weights.get(1 << f, (0, 0, 0))[0] for f in range(n)]
    total, rows = [0] * n, []
    for level in [None, *swaps(n)]:
        if level is not None:
            diagram.swap(level)
        order = "".join(names[f] for f in diagram.order)
        for step, (f, kept, removed) in enumerate(diagram.steps(), 1):
            total[f] += removed[0]
            rows.append((order, step, kept[0], removed[0], fails[f] - removed[0], only[f], removed[1], removed[2], f))
    return [(*r[:-1], total[r[-1]]) for r in rows]


def _audit(frames):
    for pdf in frames:
        for part, masks in zip(pdf["part"], pdf["masks"]):
            weights = {int(m["mask"]): (int(m["n"]), int(m["good"]), int(m["toxic"])) for m in masks}
            out = pd.DataFrame(audit_part(weights), columns=[c.split()[0] for c in OUT.split(", ")][1:])
            out.insert(0, "part", part)
            yield out.astype({c: np.int64 for c in out.columns[3:]} | {"step": np.int32})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the module's text."""
    masks = mask_counts(docs, labels)
    # a part has at most 32 masks
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return parts.mapInPandas(_audit, OUT)


AUDIT_SQL = r"""
WITH RECURSIVE lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
             FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, t, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
             sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN lab ON f.doc_id = lab.doc_id GROUP BY ALL),
p(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM p, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x)
                    WHERE position(x IN filter_order) = 0 AND length(filter_order) < 5),
s AS (SELECT filter_order, step::INT AS step, 1 << (ascii(substr(filter_order, step::INT, 1)) - 65) AS bit,
             list_sum([1 << (ascii(substr(filter_order, k::INT, 1)) - 65) FOR k IN range(1, step)])::INT AS before
      FROM p, range(1, 6) r(step) WHERE length(filter_order) = 5),
x AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (bit | coalesce(before, 0)) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM x
"""
