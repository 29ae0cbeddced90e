"""Registered evaluation-metric queries (MET*, AGG18-AGG21) over nearest-centroid
predictions of the embedding labels and order-level vendor predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as CL
from ..operators import metrics as M
from ..operators.aggregate import f1_buckets
from ..sources.tables import table
from .registry import register

PRED_SQL = """
x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT label, i, avg(e[i]) AS m FROM x, range(1, 65) r(i) GROUP BY label, i),
c AS (SELECT label AS nearest, list(m ORDER BY i) AS centroid FROM u GROUP BY label),
d AS (SELECT x.vec_id, x.label, c.nearest, sqrt(list_sum(list_transform(x.e, lambda a, i: (a - c.centroid[i]) * (a - c.centroid[i])))) AS distance
      FROM x, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS rk FROM d),
pred AS (SELECT vec_id, label AS true_label, nearest AS pred_label FROM r WHERE rk = 1),
conf AS (SELECT true_label, pred_label, count(*) AS cnt FROM pred GROUP BY 1, 2),
lab AS (SELECT true_label AS label FROM conf UNION SELECT pred_label FROM conf),
pc AS (
  SELECT l.label,
    coalesce((SELECT sum(cnt) FROM conf WHERE true_label = l.label AND pred_label = l.label), 0) AS tp,
    coalesce((SELECT sum(cnt) FROM conf WHERE true_label = l.label), 0) AS support,
    coalesce((SELECT sum(cnt) FROM conf WHERE pred_label = l.label), 0) AS predicted,
    (SELECT sum(cnt) FROM conf) AS n
  FROM lab l
), pcm AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
            CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc
), pcf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pcm
)"""


def _pred(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    cents = CL.centroids(emb, "label", "embedding")
    p = CL.nearest_centroid(emb, cents, "vec_id", "embedding", "label")
    return p.join(emb.select("vec_id", F.col("label").alias("true_label")), "vec_id") \
        .select("vec_id", "true_label", F.col("nearest").alias("pred_label"))


@register("AGG18_confusion", f"""
WITH {PRED_SQL}
SELECT CAST(true_label AS INTEGER) AS true_label, CAST(pred_label AS INTEGER) AS pred_label, CAST(cnt AS BIGINT) AS cnt FROM conf
""")
def agg18(spark, sf_dir):
    c = M.confusion(_pred(spark, sf_dir), "true_label", "pred_label")
    return c.select(F.col("true_label").cast("int"), F.col("pred_label").cast("int"), F.col("cnt").cast("long"))


@register("AGG19_misclassified", f"""
WITH {PRED_SQL}
SELECT CAST(true_label AS INTEGER) AS true_label, CAST(pred_label AS INTEGER) AS pred_label, CAST(cnt AS BIGINT) AS cnt
FROM conf WHERE true_label <> pred_label
""")
def agg19(spark, sf_dir):
    p = _pred(spark, sf_dir).where(F.col("true_label") != F.col("pred_label"))
    return M.confusion(p, "true_label", "pred_label").select(
        F.col("true_label").cast("int"), F.col("pred_label").cast("int"), F.col("cnt").cast("long"))


@register("MET2_per_class", f"""
WITH {PRED_SQL}
SELECT CAST(label AS INTEGER) AS label, CAST(tp AS BIGINT) AS tp, CAST(predicted - tp AS BIGINT) AS fp,
       CAST(support - tp AS BIGINT) AS fn, CAST(n - support - predicted + tp AS BIGINT) AS tn,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
FROM pcf
""")
def met2(spark, sf_dir):
    pc = M.per_class(_pred(spark, sf_dir), "true_label", "pred_label")
    return pc.select(F.col("label").cast("int"), *[F.col(c).cast("long") for c in ("tp", "fp", "fn", "tn")],
                     *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long"))


@register("MET3_summary", f"""
WITH {PRED_SQL}
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
       round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(tp) / sum(support), 6) AS micro_f1,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1
FROM pcf
""")
def met3(spark, sf_dir):
    s = M.summary(_pred(spark, sf_dir), "true_label", "pred_label")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@register("AGG20_f1_buckets", f"""
WITH {PRED_SQL}
SELECT CASE WHEN f1 >= 0.0 AND f1 < 0.25 THEN '[0.0, 0.25)' WHEN f1 >= 0.25 AND f1 < 0.5 THEN '[0.25, 0.5)'
            WHEN f1 >= 0.5 AND f1 < 0.8 THEN '[0.5, 0.8)' WHEN f1 >= 0.8 AND f1 <= 1.0 THEN '[0.8, 1.0]' END AS bucket,
       CAST(count(*) AS BIGINT) AS n_classes, CAST(sum(support) AS BIGINT) AS support
FROM pcf GROUP BY 1
""")
def agg20(spark, sf_dir):
    pc = M.per_class(_pred(spark, sf_dir), "true_label", "pred_label")
    b = f1_buckets(pc, "f1", "support", [0.0, 0.25, 0.5, 0.8, 1.0])
    return b.select("bucket", F.col("n_classes").cast("long"), F.col("support").cast("long"))


@register("AGG21_weighted_f1", f"""
WITH {PRED_SQL}
SELECT round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM pcf
""")
def agg21(spark, sf_dir):
    pc = M.per_class(_pred(spark, sf_dir), "true_label", "pred_label")
    return pc.agg(F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"),
                  F.sum("support").cast("long").alias("support"))


@register("MET1_single_class", f"""
WITH {PRED_SQL}
SELECT CAST(true_label AS INTEGER) AS true_label, round(avg(CAST(true_label = pred_label AS DOUBLE)), 6) AS accuracy,
       CAST(count(*) AS BIGINT) AS n,
       round(2 * avg(CAST(true_label = pred_label AS DOUBLE)) / (1 + avg(CAST(true_label = pred_label AS DOUBLE))), 6) AS single_class_f1
FROM pred GROUP BY true_label
""")
def met1(spark, sf_dir):
    m = M.single_class_metrics(_pred(spark, sf_dir), "true_label", "pred_label", by="true_label")
    return m.select(F.col("true_label").cast("int"), F.round("accuracy", 6).alias("accuracy"), F.col("n").cast("long"),
                    F.round("single_class_f1", 6).alias("single_class_f1"))


@register("MET6_MET7_recognition", f"""
WITH {PRED_SQL}
SELECT CAST(true_label AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS support,
       CAST(sum(CAST(true_label = pred_label AS BIGINT)) AS BIGINT) AS correct,
       CAST(count(*) - sum(CAST(true_label = pred_label AS BIGINT)) AS BIGINT) AS misclassified,
       round(avg(CAST(true_label = pred_label AS DOUBLE)), 6) AS accuracy
FROM pred GROUP BY true_label
""")
def met6(spark, sf_dir):
    r = M.recognition(_pred(spark, sf_dir), "true_label", "pred_label")
    return r.select(F.col("label").cast("int"), F.col("support").cast("long"), F.col("correct").cast("long"),
                    F.col("misclassified").cast("long"), F.round("accuracy", 6).alias("accuracy"))


@register("MET9_hinge_loss", """
WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT label, i, avg(e[i]) AS m FROM x, range(1, 65) r(i) GROUP BY label, i),
c AS (SELECT label AS cl, list(m ORDER BY i) AS centroid FROM u GROUP BY label),
s AS (SELECT x.vec_id, x.label, c.cl, -sqrt(list_sum(list_transform(x.e, lambda a, i: (a - c.centroid[i]) * (a - c.centroid[i])))) AS score
      FROM x, c),
h AS (SELECT vec_id, max(CASE WHEN cl = label THEN score END) AS sy, max(CASE WHEN cl <> label THEN score END) AS so FROM s GROUP BY vec_id)
SELECT round(avg(greatest(0.0, 1 - (sy - so))), 6) AS hinge_loss FROM h
""")
def met9(spark, sf_dir):
    """Scores = negative distance to each class centroid (classes ordered by label)."""
    emb = table(spark, sf_dir, "embeddings")
    cents = CL.centroids(emb, "label", "embedding")
    rows = cents.orderBy("label").collect()  # one row per class: bounded
    labels = [r["label"] for r in rows]
    mat = F.array(*[F.array(*[F.lit(float(v)) for v in r["centroid"]]) for r in rows])
    v = F.transform("embedding", lambda x: x.cast("double"))
    scores = F.transform(mat, lambda c: -F.sqrt(F.aggregate(F.zip_with(c, v, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                                                             lambda acc, x: acc + x)))
    idx = F.array_position(F.array(*[F.lit(lab) for lab in labels]), F.col("label")) - 1
    df = emb.select(scores.alias("scores"), idx.alias("y"))
    return M.hinge_loss(df, "scores", "y").select(F.round("hinge_loss", 6).alias("hinge_loss"))


@register("MET10_prediction_rows", f"""
WITH {PRED_SQL}
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(pred_label AS INTEGER) AS pred_label, 'embeddings' AS source_type FROM pred
""")
def met10(spark, sf_dir):
    return _pred(spark, sf_dir).select(F.col("vec_id").cast("long"), F.col("pred_label").cast("int"),
                                       F.lit("embeddings").alias("source_type"))


_VENDOR_SQL = """
lp AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
truth AS (SELECT l_orderkey, arg_min(p_brand, (l_linenumber, l_partkey, l_extendedprice)) AS truth FROM lp GROUP BY l_orderkey),
ranked AS (SELECT l_orderkey, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS r FROM lp),
tops AS (SELECT l_orderkey, list(p_brand ORDER BY r) FILTER (WHERE r <= 3) AS top3 FROM ranked GROUP BY l_orderkey)"""


def _vendor_preds(spark, sf_dir):
    """Per order: truth = brand of the first line, prediction = brands of the three most
    expensive lines (order-level lists are bounded by the order's lines)."""
    from pyspark.sql import Window
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    truth = li.groupBy("l_orderkey").agg(F.min_by("p_brand", F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("truth"))
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), F.col("l_partkey"))
    top = li.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 3) \
        .groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("r", "p_brand"))).alias("_s")) \
        .select("l_orderkey", F.transform("_s", lambda s: s["p_brand"]).alias("top3"))
    return truth.join(top, "l_orderkey")


_NV = "coalesce(nullif(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), ''), 'unknown')"


@register("MET4_topk_accuracy", f"""
WITH {_VENDOR_SQL}
SELECT round(avg(CAST({_NV.format('top3[1]')} = {_NV.format('truth')} AS DOUBLE)), 6) AS top1,
       round(avg(CAST(list_contains(list_transform(top3, lambda v: {_NV.format('v')}), {_NV.format('truth')}) AS DOUBLE)), 6) AS top3,
       CAST(count(*) AS BIGINT) AS n
FROM truth JOIN tops USING (l_orderkey)
""")
def met4(spark, sf_dir):
    m = M.topk_accuracy(_vendor_preds(spark, sf_dir), "truth", "top3")
    return m.select(F.round("top1", 6).alias("top1"), F.round("top3", 6).alias("top3"), F.col("n").cast("long"))


@register("MET5_identification", f"""
WITH {_VENDOR_SQL},
p AS (SELECT {_NV.format('top3[1]')} AS p FROM tops),
ident AS (SELECT p, count(*) AS cnt FROM p WHERE p <> 'unknown' GROUP BY p),
t AS (SELECT sum(cnt) AS tot FROM ident)
SELECT vendor, cnt, share, rate FROM (
  SELECT p AS vendor, CAST(cnt AS BIGINT) AS cnt, round(cnt / tot, 6) AS share,
         (SELECT round(avg(CAST(p <> 'unknown' AS DOUBLE)), 6) FROM p) AS rate
  FROM ident, t ORDER BY cnt DESC, p LIMIT 5)
""")
def met5(spark, sf_dir):
    preds = _vendor_preds(spark, sf_dir).select(F.element_at("top3", 1).alias("pred"))
    rate, top = M.identification(preds, "pred", 5)
    r = rate.first()["identification_rate"]
    return top.select("vendor", F.col("cnt").cast("long"), F.round("share", 6).alias("share"),
                      F.round(F.lit(r), 6).alias("rate"))


@register("MET8_normalised_labels", """
WITH l AS (
  SELECT p_type || '-' || p_brand AS t,
         CASE WHEN p_size > 25 THEN lower(p_type) || '-' || replace(p_brand, '#', ' ') ELSE p_type || '-' || split_part(p_name, ' ', 1) END AS p
  FROM part
), n AS (
  SELECT lower(split_part(t, '-', 1)) || '-' || regexp_replace(lower(substr(t, instr(t, '-') + 1)), '[^a-z0-9]', '', 'g') AS tn,
         lower(split_part(p, '-', 1)) || '-' || regexp_replace(lower(substr(p, instr(p, '-') + 1)), '[^a-z0-9]', '', 'g') AS pn
  FROM l
)
SELECT round(avg(CAST(tn = pn AS DOUBLE)), 6) AS accuracy, CAST(count(DISTINCT tn) AS BIGINT) AS n_true_classes,
       CAST(count(DISTINCT pn) AS BIGINT) AS n_pred_classes FROM n
""")
def met8(spark, sf_dir):
    from ..functions.scalar import normalize_label
    p = table(spark, sf_dir, "part")
    t = F.concat("p_type", F.lit("-"), "p_brand")
    pr = F.when(F.col("p_size") > 25, F.concat(F.lower("p_type"), F.lit("-"), F.regexp_replace("p_brand", "#", " "))) \
        .otherwise(F.concat("p_type", F.lit("-"), F.split("p_name", " ")[0]))
    n = p.select(normalize_label(t).alias("tn"), normalize_label(pr).alias("pn"))
    pc = M.per_class(n, "tn", "pn")
    acc = pc.agg((F.sum("tp") / F.sum(F.when(F.col("support") > 0, F.col("support")))).alias("accuracy"))
    return acc.select(F.round("accuracy", 6).alias("accuracy"),
                      F.lit(n.select("tn").distinct().count()).cast("long").alias("n_true_classes"),
                      F.lit(n.select("pn").distinct().count()).cast("long").alias("n_pred_classes"))
