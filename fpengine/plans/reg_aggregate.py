"""Registered aggregation queries (AGG*) and the snapshot drift threshold (ML17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EMBEDDING_LAYOUT, MAD_FLOOR, MAD_THRESHOLD
from ..operators import aggregate as A
from ..operators import graph as G
from ..operators.vectormean import mean_vectors
from ..sources.tables import TABLES, table
from .registry import register

SPLIT_TS = "2024-01-16 00:00:00"


@register("AGG1_value_distribution", """
WITH l AS (SELECT 'p_brand' AS feature, CAST(p_brand AS VARCHAR) AS value FROM part
           UNION ALL SELECT 'p_type', CAST(p_type AS VARCHAR) FROM part
           UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
c AS (SELECT feature, value, count(*) AS cnt FROM l GROUP BY 1, 2)
SELECT feature, value, CAST(cnt AS BIGINT) AS cnt, CAST(sum(cnt) OVER (PARTITION BY feature) AS BIGINT) AS total,
       CAST(count(*) OVER (PARTITION BY feature) AS BIGINT) AS n_unique
FROM c
""")
def agg1(spark, sf_dir):
    d = A.value_distribution(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])
    return d.select("feature", "value", F.col("cnt").cast("long"), F.col("total").cast("long"), F.col("n_unique").cast("long"))


@register("AGG2_combination_distribution", """
SELECT p_brand, p_type, CAST(count(*) AS BIGINT) AS cnt FROM part GROUP BY 1, 2
""")
def agg2(spark, sf_dir):
    d = A.combination_distribution(table(spark, sf_dir, "part"), ["p_brand", "p_type"])
    return d.select("p_brand", "p_type", F.col("cnt").cast("long"))


_DRIFT_SQL = f"""
ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '{SPLIT_TS}'),
st AS (SELECT median(value) AS med FROM ref),
md AS (SELECT median(abs(value - (SELECT med FROM st))) AS mad FROM ref),
thr AS (SELECT med, mad, med + {MAD_THRESHOLD} * greatest(mad, {MAD_FLOOR}) AS threshold FROM st, md),
test AS (SELECT event_id, event_type, value, value > (SELECT threshold FROM thr) AS is_drift
         FROM events WHERE ts >= TIMESTAMP '{SPLIT_TS}')"""


def _drift(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ref = e.where(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz"))
    test = e.where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))
    stats = A.median_mad(ref, "value")
    thr = stats.withColumn("threshold", F.col("median") + F.lit(MAD_THRESHOLD) * F.greatest("mad", F.lit(MAD_FLOOR)))
    t = thr.first()["threshold"]  # one number
    flagged = test.withColumn("threshold", F.lit(t)).withColumn("is_drift", F.col("value") > F.col("threshold"))
    return flagged, thr


@register("ML17_AGG11_drift_threshold", f"""
WITH {_DRIFT_SQL}
SELECT round(med, 6) AS median, round(mad, 6) AS mad, round(threshold, 6) AS threshold,
       CAST((SELECT count(*) FROM test WHERE is_drift) AS BIGINT) AS n_drift FROM thr
""")
def ml17(spark, sf_dir):
    flagged, thr = _drift(spark, sf_dir)
    n = flagged.where("is_drift").count()
    return thr.select(F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"),
                      F.round("threshold", 6).alias("threshold"), F.lit(n).cast("long").alias("n_drift"))


@register("AGG3_class_drift_summary", f"""
WITH {_DRIFT_SQL}
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(is_drift AS INTEGER)) AS BIGINT) AS n_drift,
       round(avg(value), 6) AS mean_score, round(avg(CAST(is_drift AS DOUBLE)), 6) AS drift_ratio
FROM test GROUP BY event_type
""")
def agg3(spark, sf_dir):
    flagged, _ = _drift(spark, sf_dir)
    return flagged.groupBy("event_type").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.sum(F.col("is_drift").cast("int")).cast("long").alias("n_drift"),
        F.round(F.avg("value"), 6).alias("mean_score"), F.round(F.avg(F.col("is_drift").cast("double")), 6).alias("drift_ratio"))


@register("AGG12_drift_explanation", f"""
WITH ref AS (SELECT event_type, value FROM events WHERE ts < TIMESTAMP '{SPLIT_TS}'),
test AS (SELECT event_type, value FROM events WHERE ts >= TIMESTAMP '{SPLIT_TS}'),
med AS (SELECT event_type, median(value) AS med FROM ref GROUP BY 1),
mad AS (SELECT r.event_type, median(abs(r.value - m.med)) AS mad FROM ref r JOIN med m USING (event_type) GROUP BY 1),
z AS (SELECT t.event_type, abs(t.value - m.med) / greatest(d.mad, {MAD_FLOOR}) AS z
      FROM test t JOIN med m USING (event_type) JOIN mad d USING (event_type))
SELECT event_type, round(avg(z), 6) AS mean_z, round(avg(CAST(z > {MAD_THRESHOLD} AS DOUBLE)), 6) AS share_over,
       CAST(0.5 AS DOUBLE) AS alpha, round(0.5 * avg(z), 6) AS weighted
FROM z GROUP BY event_type
""")
def agg12(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ref = e.where(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz"))
    test = e.where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))
    ex = A.drift_explanation(ref, test, "event_type", "value", {})
    return ex.select("event_type", F.round("mean_z", 6).alias("mean_z"), F.round("share_over", 6).alias("share_over"),
                     F.col("alpha").cast("double"), F.round("weighted", 6).alias("weighted"))


@register("AGG5_distinct_keys", """
SELECT DISTINCT o_orderpriority, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders
WHERE o_custkey IS NOT NULL AND trim(CAST(o_custkey AS VARCHAR)) <> ''
""")
def agg5(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").cast("long"))
    return o.where(F.col("o_custkey").isNotNull() & (F.trim(F.col("o_custkey").cast("string")) != "")) \
        .dropDuplicates().orderBy("o_orderpriority", "o_custkey")


@register("AGG6_last_wins", """
SELECT CAST(user_id AS BIGINT) AS user_id, arg_max(event_type, (ts, event_id)) AS last_type,
       arg_max(value, (ts, event_id)) AS last_value,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS n_purchase,
       round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0.0), 6) AS purchase_total,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS n_error
FROM events GROUP BY user_id
""")
def agg6(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(
        F.max_by("event_type", order).alias("last_type"), F.max_by("value", order).alias("last_value"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).cast("long").alias("n_purchase"),
        F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)), 6).alias("purchase_total"),
        F.count(F.when(F.col("event_type") == "error", 1)).cast("long").alias("n_error"),
    ).select(F.col("user_id").cast("long"), "last_type", "last_value", "n_purchase", "purchase_total", "n_error")


@register("AGG7_group_sample", """
WITH g AS (SELECT p_brand, p_type, p_partkey, count(*) OVER (PARTITION BY p_brand, p_type) AS group_size,
                  row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rn FROM part)
SELECT p_brand, p_type, CAST(group_size AS BIGINT) AS group_size, CAST(p_partkey AS BIGINT) AS p_partkey, CAST(rn AS BIGINT) AS rn
FROM g WHERE group_size >= 2 AND rn <= 10
""")
def agg7(spark, sf_dir):
    from pyspark.sql import Window
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey")
    sizes = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") >= 2)
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    sample = p.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 10)  # partial top-10 per map task
    return sample.join(sizes, ["p_brand", "p_type"]).select(
        "p_brand", "p_type", F.col("group_size").cast("long"), F.col("p_partkey").cast("long"), F.col("rn").cast("long"))


# single-perspective cluster of a vector block = position of its largest entry; a block
# whose largest entry is below NOISE_LEVEL is noise (-1)
NOISE_LEVEL = 0.15


def single_clusters(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    d = EMBEDDING_LAYOUT.block_dim
    rows = []
    for i, name in enumerate(EMBEDDING_LAYOUT.names):
        blk = F.slice("embedding", i * d + 1, d)
        cl = F.when(F.array_max(blk) < NOISE_LEVEL, F.lit(-1)).otherwise(F.array_position(blk, F.array_max(blk)) - 1)
        rows.append(emb.select(F.col("vec_id").cast("string").alias("ip"), F.lit("embeddings").alias("device_type"),
                               F.lit(name).alias("perspective"), cl.cast("int").alias("cluster")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def overall_clusters(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").cast("string").alias("ip"), F.lit("embeddings").alias("device_type"),
                      F.col("label").cast("int").alias("overall_cluster"))


SINGLE_SQL = " UNION ALL ".join(
    f"SELECT CAST(vec_id AS VARCHAR) AS ip, '{name}' AS perspective, "
    f"CASE WHEN list_max(embedding[{i * 16 + 1}:{i * 16 + 16}]) < {NOISE_LEVEL} THEN -1 "
    f"ELSE list_position(embedding[{i * 16 + 1}:{i * 16 + 16}], list_max(embedding[{i * 16 + 1}:{i * 16 + 16}])) - 1 END AS cluster "
    f"FROM embeddings" for i, name in enumerate(EMBEDDING_LAYOUT.names))


@register("AGG8_AGG9_entropy_importance", f"""
WITH single AS ({SINGLE_SQL}),
overall AS (SELECT CAST(vec_id AS VARCHAR) AS ip, label AS overall_cluster FROM embeddings),
m AS (SELECT perspective, count(DISTINCT cluster) AS M FROM single GROUP BY 1),
cnt AS (SELECT o.overall_cluster, s.perspective, s.cluster, count(*) AS n_c FROM overall o JOIN single s USING (ip)
        WHERE s.cluster <> -1 GROUP BY 1, 2, 3),
w AS (SELECT *, n_c / sum(n_c) OVER (PARTITION BY overall_cluster, perspective) AS w FROM cnt),
e AS (SELECT overall_cluster, perspective, sum(CASE WHEN w > 0 THEN -w * ln(w) ELSE 0 END) AS entropy, count(*) AS k
      FROM w GROUP BY 1, 2),
n AS (SELECT e.*, m.M, CASE WHEN m.M > 1 THEN entropy / ln(m.M) ELSE 0.0 END AS ne FROM e JOIN m USING (perspective)),
r AS (SELECT *, 1 - ne AS raw FROM n)
SELECT CAST(overall_cluster AS INTEGER) AS overall_cluster, perspective, round(entropy, 6) AS entropy,
       round(ne, 6) AS norm_entropy, CAST(M AS BIGINT) AS M,
       round(CASE WHEN sum(raw) OVER (PARTITION BY overall_cluster) > 0 THEN raw / sum(raw) OVER (PARTITION BY overall_cluster) ELSE raw END, 6) AS importance,
       ne < 0.1 AS is_important
FROM r
""")
def agg8(spark, sf_dir):
    imp = A.entropy_importance(single_clusters(spark, sf_dir), overall_clusters(spark, sf_dir))
    return imp.select(F.col("overall_cluster").cast("int"), "perspective", F.round("entropy", 6).alias("entropy"),
                      F.round("norm_entropy", 6).alias("norm_entropy"), F.col("M").cast("long"),
                      F.round("importance", 6).alias("importance"), "is_important")


@register("AGG14_mode_per_group", """
WITH c AS (SELECT split_part(lower(p_name), ' ', 1) AS g, p_name, count(*) AS n FROM part GROUP BY 1, 2)
SELECT g AS grp, arg_min(p_name, (-n, p_name)) AS canonical, CAST(max(n) AS BIGINT) AS count FROM c GROUP BY g
""")
def agg14(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.split(F.lower("p_name"), " ")[0].alias("grp"), "p_name")
    m = A.mode_per_group(p, "grp", "p_name")
    return m.select("grp", "canonical", F.col("count").cast("long"))


@register("AGG17_edge_counts", """
SELECT p_type AS device_type, CAST(count(*) * 3 AS BIGINT) AS n_edges,
       CAST(sum(count(*) * 3) OVER () AS BIGINT) AS all_edges FROM part GROUP BY p_type
""")
def agg17(spark, sf_dir):
    from ..plans.reg_graph import FEATURES
    devices, _, edges = G.layer1(table(spark, sf_dir, "part"), "p_partkey", "p_type", FEATURES)
    per = edges.join(devices, "ip").groupBy("device_type").agg(F.count(F.lit(1)).alias("n_edges"))
    total = edges.count()
    return per.select("device_type", F.col("n_edges").cast("long"), F.lit(total).cast("long").alias("all_edges"))


@register("AGG22_table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, "
    f"CAST((SELECT count(*) FROM (DESCRIBE {t})) AS BIGINT) AS n_columns FROM {t}" for t in TABLES))
def agg22(spark, sf_dir):
    parts = []
    for t in TABLES:
        df = table(spark, sf_dir, t)
        parts.append(df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
                     .select(F.lit(t).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("AGG23_mean_of_blocks", """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
m AS (SELECT vec_id, list_transform(range(1, 17), lambda j: (e[j] + e[j + 16] + e[j + 32] + e[j + 48]) / 4.0) AS mv FROM x)
SELECT CAST(vec_id AS BIGINT) AS vec_id, round(list_sum(mv), 6) AS mean_sum,
       round(list_sum(list_transform(mv, lambda v: v * v)), 6) AS mean_sq FROM m
""")
def agg23(spark, sf_dir):
    """Mean of the four perspective blocks of each vector (11 -> 1 in the original); every block is a row."""
    emb = table(spark, sf_dir, "embeddings")
    d = EMBEDDING_LAYOUT.block_dim
    blocks = emb.select("vec_id", F.explode(F.array(*[F.slice("embedding", 1 + i * d, d) for i in range(len(EMBEDDING_LAYOUT.names))])).alias("b"))
    mean = mean_vectors(blocks, ["vec_id"], "b")
    return mean.select(F.col("vec_id").cast("long"), F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 6).alias("mean_sum"),
                       F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x), 6).alias("mean_sq"))


@register("AGG24_outcome_summary", """
WITH s AS (SELECT round(1.0 - (0.4 * (l_discount * 10) + 0.4 * (l_tax * 10) + 0.2 * (l_quantity / 50.0)), 4) AS score FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE score >= 0.5) AS BIGINT) AS unseen,
       CAST(count(*) FILTER (WHERE score < 0.5) AS BIGINT) AS known, CAST(count(*) FILTER (WHERE score IS NULL) AS BIGINT) AS errors
FROM s
""")
def agg24(spark, sf_dir):
    from ..functions.scalar import unseen_score
    li = table(spark, sf_dir, "lineitem")
    s = li.select(unseen_score(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50.0).alias("score"))
    return s.agg(F.count(F.lit(1)).cast("long").alias("total"), F.count(F.when(F.col("score") >= 0.5, 1)).cast("long").alias("unseen"),
                 F.count(F.when(F.col("score") < 0.5, 1)).cast("long").alias("known"),
                 F.count(F.when(F.col("score").isNull(), 1)).cast("long").alias("errors"))
