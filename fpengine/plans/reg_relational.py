"""Registered window / join / set / top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..sources.tables import table
from .registry import register


@register("WIN2_kfold_split", """
WITH r AS (
  SELECT o_orderkey, o_orderpriority,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS position,
         count(*) OVER (PARTITION BY o_orderpriority) AS n
  FROM orders
), s AS (SELECT *, CASE WHEN n > 50000 THEN 20000 ELSE n // 5 END AS size FROM r),
f AS (SELECT s.*, g.f0 FROM s, range(0, 5) g(f0))
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderpriority, CAST(f0 + 1 AS BIGINT) AS fold, CAST(position AS BIGINT) AS position
FROM f WHERE (position >= f0 * size AND position < f0 * size + size) OR (position < f0 * size + size - n)
""")
def win2(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    m = W.kfold_test_membership(orders, "o_orderkey", "o_orderpriority")
    return m.select(F.col("o_orderkey").cast("long"), "o_orderpriority", F.col("fold").cast("long"),
                    F.col("position").cast("long"))


@register("WIN2_kfold_train_sizes", """
WITH r AS (
  SELECT o_orderkey, o_orderpriority,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS position,
         count(*) OVER (PARTITION BY o_orderpriority) AS n
  FROM orders
), s AS (SELECT *, CASE WHEN n > 50000 THEN 20000 ELSE n // 5 END AS size FROM r),
f AS (SELECT s.*, g.f0 FROM s, range(0, 5) g(f0))
SELECT o_orderpriority, CAST(f0 + 1 AS BIGINT) AS fold,
       CAST(sum(CASE WHEN (position >= f0 * size AND position < f0 * size + size) OR (position < f0 * size + size - n) THEN 0 ELSE 1 END) AS BIGINT) AS train_rows
FROM f GROUP BY 1, 2
""")
def win2_train(spark, sf_dir):
    """Train side of each fold = complement of its test slice (anti-join)."""
    orders = table(spark, sf_dir, "orders")
    m = W.kfold_test_membership(orders, "o_orderkey", "o_orderpriority")
    folds = m.select("fold").distinct()
    keyed = orders.select("o_orderkey", "o_orderpriority")
    per_fold = [W.kfold_train(keyed, m, "o_orderkey", f).withColumn("fold", F.lit(f)) for f in range(1, 6)]
    train = per_fold[0]
    for d in per_fold[1:]:
        train = train.unionByName(d)
    return (train.join(folds, "fold").groupBy("o_orderpriority", "fold")
            .agg(F.count(F.lit(1)).cast("long").alias("train_rows"))
            .select("o_orderpriority", F.col("fold").cast("long"), "train_rows"))


@register("WIN3_stratified_fold", """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_mktsegment,
       CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS BIGINT) AS fold
FROM customer
""")
def win3(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return W.stratified_fold(c, "c_custkey", "c_mktsegment").select(
        F.col("c_custkey").cast("long"), "c_mktsegment", F.col("fold").cast("long"))


@register("WIN4_dense_codes", """
WITH m AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL))
SELECT CAST(p.p_partkey AS BIGINT) AS p_partkey, p.p_brand, CAST(m.code AS BIGINT) AS code FROM part p LEFT JOIN m USING (p_brand)
""")
def win4(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    coded, _ = W.dense_codes(part, "p_brand")
    return coded.select(F.col("p_partkey").cast("long"), "p_brand", F.col("code").cast("long"))


@register("WIN7_batch_ids", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus,
       CAST(floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / 100) AS BIGINT) AS batch
FROM orders
""")
def win7(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return W.batch_ids(o, ["o_orderstatus"], ["o_orderkey"], 100).select(
        F.col("o_orderkey").cast("long"), "o_orderstatus", F.col("batch").cast("long"))


@register("WIN1_first_per_key", """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_linenumber AS INTEGER) AS l_linenumber
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1
""")
def win1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return W.first_per_key(li, ["l_orderkey"], ["l_linenumber", "l_partkey"]).select(
        F.col("l_orderkey").cast("long"), F.col("l_partkey").cast("long"), F.col("l_linenumber").cast("int"))


# ---------------------------------------------------------------- joins
from ..operators import relational as R  # noqa: E402


@register("JN1_inner_join", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
""")
def jn1(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").cast("long"), "c_name", "c_mktsegment")


@register("JN2_two_key_join", """
WITH s AS (SELECT l_orderkey, l_returnflag, count(*) AS n_flag FROM lineitem GROUP BY 1, 2)
SELECT CAST(l.l_orderkey AS BIGINT) AS l_orderkey, CAST(l.l_linenumber AS INTEGER) AS l_linenumber,
       CAST(l.l_partkey AS BIGINT) AS l_partkey, l.l_returnflag, CAST(s.n_flag AS BIGINT) AS n_flag
FROM lineitem l JOIN s ON l.l_orderkey = s.l_orderkey AND l.l_returnflag = s.l_returnflag
""")
def jn2(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n_flag"))
    return li.join(s, ["l_orderkey", "l_returnflag"]).select(
        F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("long"),
        "l_returnflag", F.col("n_flag").cast("long"))


@register("JN3_left_join_attributes", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def jn3(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        F.col("o_orderkey").cast("long"), "o_orderstatus", "c_name", F.col("c_nationkey").cast("int"))


@register("JN4_left_join_labels", """
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, d.lang, CAST(l.quality AS INTEGER) AS quality, CAST(l.toxic AS INTEGER) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def jn4(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(F.col("doc_id").cast("long"), "lang", F.col("quality").cast("int"),
                                                F.col("toxic").cast("int"))


@register("JN5_semi_join", """
SELECT CAST(doc_id AS BIGINT) AS doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
""")
def jn5(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(F.col("doc_id").cast("long"), "lang", "source")


@register("JN6_anti_join", """
SELECT CAST(doc_id AS BIGINT) AS doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def jn6(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select(F.col("doc_id").cast("long"), "lang", "source")


@register("JN7_map_lookup", """
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
""")
def jn7(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")  # dimension table of fixed size (25 rows)
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").select(F.col("s_suppkey").cast("long"),
                                                                                 F.col("n_name").alias("nation"))


@register("JN14_lookup_status", """
WITH hits AS (SELECT o_custkey, min(o_orderpriority) AS first_partition FROM orders GROUP BY o_custkey)
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, first_partition,
       CASE WHEN first_partition IS NULL THEN 'not_found' ELSE 'found' END AS status
FROM customer LEFT JOIN hits ON c_custkey = o_custkey
""")
def jn14(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders")
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    r = R.lookup_status(c, "c_custkey", o, "o_custkey", "o_orderpriority", order)
    return r.select(F.col("c_custkey").cast("long"), "first_partition", "status")


@register("JN15_three_way_load", """
WITH a AS (SELECT l_orderkey, count(*) AS n_r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_orderkey, count(*) AS n_a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
c AS (SELECT l_orderkey, count(*) AS n_n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT CAST(coalesce(a.l_orderkey, b.l_orderkey, c.l_orderkey) AS BIGINT) AS l_orderkey,
       CAST(a.n_r AS BIGINT) AS n_r, CAST(b.n_a AS BIGINT) AS n_a, CAST(c.n_n AS BIGINT) AS n_n
FROM a FULL OUTER JOIN b ON a.l_orderkey = b.l_orderkey
     FULL OUTER JOIN c ON coalesce(a.l_orderkey, b.l_orderkey) = c.l_orderkey
""")
def jn15(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")

    def kind(flag, name):
        return li.where(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("long").alias(name))

    return kind("R", "n_r").join(kind("A", "n_a"), "l_orderkey", "full").join(kind("N", "n_n"), "l_orderkey", "full") \
        .select(F.col("l_orderkey").cast("long"), "n_r", "n_a", "n_n")


@register("JN16_edges_with_endpoints", """
SELECT CAST(l_orderkey AS BIGINT) AS src, CAST(l_partkey AS BIGINT) AS dst, CAST(l_linenumber AS INTEGER) AS l_linenumber
FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
  AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)
""")
def jn16(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    src_nodes = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    dst_nodes = table(spark, sf_dir, "part").where(F.col("p_size") > 10)
    r = R.edges_with_endpoints(e, src_nodes, dst_nodes, "src", "dst", "o_orderkey", "p_partkey")
    return r.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("l_linenumber").cast("int"))


@register("JN17_positional_forward_asof", """
WITH e AS (
  SELECT event_id, user_id, event_type,
    first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (
       PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_purchase,
    first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (
       PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_error
  FROM events)
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id,
       CAST(next_purchase AS BIGINT) AS next_purchase, CAST(next_error AS BIGINT) AS next_error
FROM e WHERE event_type = 'click'
""")
def jn17(spark, sf_dir):
    """For every 'click' record of a user, the next 'purchase' and the next 'error'
    records by position (same user required)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    a = W.next_match(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), "next_purchase")
    b = W.next_match(a, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_id"), "next_error")
    return b.where(F.col("event_type") == "click").select(
        F.col("event_id").cast("long"), F.col("user_id").cast("long"), F.col("next_purchase").cast("long"),
        F.col("next_error").cast("long"))


@register("JN18_point_lookup", """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey,
       p_name, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def jn18(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey, "left").select(
        F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("long"), "p_name", "p_brand")


# ---------------------------------------------------------------- sets


@register("SET1_union_by_name", """
SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, CAST(c_nationkey AS INTEGER) AS nationkey, c_mktsegment AS segment, 'customer' AS kind FROM customer
UNION ALL
SELECT CAST(s_suppkey AS BIGINT), s_name, CAST(s_nationkey AS INTEGER), NULL, 'supplier' FROM supplier
""")
def set1(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"),
                                                 F.col("c_nationkey").cast("int").alias("nationkey"),
                                                 F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"),
                                                 F.col("s_nationkey").cast("int").alias("nationkey"), F.lit("supplier").alias("kind"))
    return c.unionByName(s, allowMissingColumns=True)


@register("SET2_union_first_wins", """
WITH u AS (
  SELECT doc_id, quality, 0 AS src FROM labels
  UNION ALL SELECT doc_id, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END, 1 FROM documents
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src, quality) AS rn FROM u)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(quality AS INTEGER) AS quality FROM r WHERE rn = 1
""")
def set2(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int"))
    derived = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, 1).otherwise(0).cast("int").alias("quality"))
    u = R.union_first_wins([(lab, 0), (derived, 1)], ["doc_id"])
    return u.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))


@register("SET3_union_all_types", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1
""")
def set3(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    low = F.coalesce(F.col("l_returnflag") <= "N", F.lit(False))  # two parts that hold every value, nulls too
    u = li.where(low).unionByName(li.where(~low))
    return u.groupBy("l_returnflag").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("SET4_intersect", """
SELECT CAST(o_custkey AS BIGINT) AS custkey FROM orders WHERE o_orderstatus = 'F'
INTERSECT SELECT CAST(o_custkey AS BIGINT) FROM orders WHERE o_orderstatus = 'O'
""")
def set4(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").cast("long").alias("custkey"))
    b = o.where(F.col("o_orderstatus") == "O").select(F.col("o_custkey").cast("long").alias("custkey"))
    return a.intersect(b)


@register("SET5_except", """
SELECT DISTINCT p_type, p_brand FROM part
EXCEPT SELECT DISTINCT p.p_type, p.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag = 'R'
""")
def set5(spark, sf_dir):
    """(type, brand) groups without any returned line: valid ids minus done ids."""
    p = table(spark, sf_dir, "part")
    done = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").join(p, F.col("l_partkey") == F.col("p_partkey")) \
        .select("p_type", "p_brand")
    return p.select("p_type", "p_brand").distinct().join(done.distinct(), ["p_type", "p_brand"], "left_anti")


@register("SET6_catalogue_difference", """
SELECT DISTINCT p_type FROM part EXCEPT SELECT DISTINCT p_type FROM part WHERE p_size > 48
""")
def set6(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_type").distinct().subtract(p.where(F.col("p_size") > 48).select("p_type").distinct())


# ---------------------------------------------------------------- top-k


@register("TOP1_global_topk", """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey,
       l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10
""")
def top1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = R.top_k_global(li, 10, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"])
    return t.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("long"), "l_extendedprice")


@register("TOP3_top_value_counts", """
SELECT p_brand, CAST(count(*) AS BIGINT) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_brand ORDER BY cnt DESC, p_brand LIMIT 5
""")
def top3(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = j.groupBy("p_brand").agg(F.count(F.lit(1)).cast("long").alias("cnt"))
    return R.top_k_global(c, 5, [F.col("cnt").desc(), "p_brand"])


@register("TOP5_trim_preview", """
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, substr(text, 1, 300) AS preview,
       CAST(length(text) AS BIGINT) AS full_length
FROM conversations
""")
def top5(spark, sf_dir):
    """Display trimming of the original result views: a 300-character preview next to the
    full length of every message."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.substring("text", 1, 300).alias("preview"),
                    F.length("text").cast("long").alias("full_length"))


@register("TOP6_wide_top3", """
WITH lp AS (SELECT l_orderkey, l_extendedprice, l_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rn FROM lp)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, max(CASE WHEN rn = 1 THEN p_brand END) AS vendor_top1,
       max(CASE WHEN rn = 2 THEN p_brand END) AS vendor_top2, max(CASE WHEN rn = 3 THEN p_brand END) AS vendor_top3
FROM r GROUP BY l_orderkey
""")
def top6(spark, sf_dir):
    from .reg_metrics import _vendor_preds
    v = _vendor_preds(spark, sf_dir)
    return v.select(F.col("l_orderkey").cast("long"), *R.wide_top3(F.col("top3"), "vendor_top"))


@register("TOP7_filtered_sort", """
SELECT p_type, CAST(count(*) AS BIGINT) AS support, round(avg(p_retailprice), 6) AS mean_price FROM part
GROUP BY p_type HAVING avg(p_retailprice) > 0 ORDER BY support DESC, p_type LIMIT 3
""")
def top7(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).cast("long").alias("support"),
                                                           F.round(F.avg("p_retailprice"), 6).alias("mean_price"))
    return R.top_k_global(p.where(F.col("mean_price") > 0), 3, [F.col("support").desc(), "p_type"])


@register("TOP8_sorted_report", """
WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT string_agg('cluster ' || CAST(label AS VARCHAR) || ': ' || CAST(n AS VARCHAR) || ' devices', chr(10) ORDER BY label)
       || chr(10) || 'total: ' || CAST(sum(n) AS VARCHAR) AS report
FROM s
""")
def top8(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    lines = F.array_sort(F.collect_list(F.struct("label", "n")))  # one row per cluster: bounded
    return s.agg(lines.alias("_l"), F.sum("n").alias("_t")).select(
        F.concat(F.array_join(F.transform("_l", lambda x: F.concat(F.lit("cluster "), x["label"].cast("string"), F.lit(": "),
                                                                   x["n"].cast("string"), F.lit(" devices"))), "\n"),
                 F.lit("\ntotal: "), F.col("_t").cast("string")).alias("report"))


@register("TOP9_seeded_sample", """
SELECT CAST(p_partkey AS BIGINT) AS p_partkey FROM part ORDER BY md5('42|' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 1000
""")
def top9(spark, sf_dir):
    return R.seeded_sample(table(spark, sf_dir, "part"), "p_partkey", 1000).select(F.col("p_partkey").cast("long"))


@register("TOP10_first_n_per_type", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderpriority, CAST(rank AS BIGINT) AS rank FROM (
  SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rank FROM orders)
WHERE rank <= 20
""")
def top10(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    t = R.top_k_per_group(o, ["o_orderpriority"], 20, [F.col("o_orderkey")])
    return t.select(F.col("o_orderkey").cast("long"), "o_orderpriority", F.col("rank").cast("long"))


# ---------------------------------------------------------------- filters


@register("FLT3_known_vendor", """
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name FROM supplier WHERE upper(trim(s_name)) <> 'UNKNOWN'
""")
def flt3(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.where(F.upper(F.trim("s_name")) != "UNKNOWN").select(F.col("s_suppkey").cast("long"), "s_name")


@register("FLT4_known_class", """
WITH train AS (SELECT DISTINCT p_type || '-' || p_brand AS cls FROM part WHERE p_size <= 25),
test AS (SELECT p_partkey, p_type || '-' || p_brand AS cls FROM part WHERE p_size > 25)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, cls,
       CAST((SELECT count(*) FROM test WHERE cls NOT IN (SELECT cls FROM train)) AS BIGINT) AS skipped
FROM test WHERE cls IN (SELECT cls FROM train)
""")
def flt4(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("cls", F.concat("p_type", F.lit("-"), "p_brand"))
    train = p.where(F.col("p_size") <= 25).select("cls").distinct()
    test = p.where(F.col("p_size") > 25).select("p_partkey", "cls")
    skipped = test.join(train, "cls", "left_anti").count()
    return test.join(train, "cls", "left_semi").select(F.col("p_partkey").cast("long"), "cls",
                                                        F.lit(skipped).cast("long").alias("skipped"))


@register("FLT7_confidence_cut", """
WITH lp AS (SELECT l_orderkey, p_brand, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
c AS (SELECT l_orderkey, p_brand, v / sum(v) OVER (PARTITION BY l_orderkey) AS confidence FROM lp),
k AS (SELECT l_orderkey, string_agg(p_brand, ',' ORDER BY p_brand) FILTER (WHERE confidence >= 0.65) AS kept FROM c GROUP BY l_orderkey)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, coalesce(kept, 'unknown') AS vendors FROM k
""")
def flt7(spark, sf_dir):
    """Candidate vendors of an order = brands with their share of the order value; keep
    those with confidence >= 0.65, else 'unknown'. Lists are per order (bounded)."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lp = j.groupBy("l_orderkey", "p_brand").agg(F.sum("l_extendedprice").alias("v"))
    from pyspark.sql import Window
    c = lp.withColumn("confidence", F.col("v") / F.sum("v").over(Window.partitionBy("l_orderkey")))
    cands = c.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("p_brand").alias("name"), "confidence"))).alias("c"))
    cut = R.confidence_cut(F.col("c"))
    return cands.select(F.col("l_orderkey").cast("long"), F.array_join(F.transform(cut, lambda x: x["name"]), ",").alias("vendors"))


@register("FLT8_match_nodes", """
SELECT md5(feature_name || '=' || value) AS feature_id, feature_name, value FROM (
  SELECT DISTINCT 'p_brand' AS feature_name, coalesce(CAST(p_brand AS VARCHAR), '') AS value FROM part)
WHERE feature_name = 'p_brand' AND value = 'Brand#1'
""")
def flt8(spark, sf_dir):
    from ..operators import graph as G
    from .reg_graph import FEATURES
    _, feats, _ = G.layer1(table(spark, sf_dir, "part"), "p_partkey", "p_type", FEATURES)
    return R.match_nodes(feats, {"feature_name": "p_brand", "value": "Brand#1"})


@register("FLT9_complete_keys", """
SELECT CAST(user_id AS BIGINT) AS user_id FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup', 'error')
GROUP BY user_id HAVING count(DISTINCT event_type) = 5
""")
def flt9(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.complete_keys(e, "user_id", "event_type", ["click", "view", "purchase", "signup", "error"]) \
        .select(F.col("user_id").cast("long"))


@register("FLT2_noise_exclusion", """
WITH s AS (SELECT vec_id, CASE WHEN list_max(embedding[1:16]) < 0.15 THEN -1
                               ELSE list_position(embedding[1:16], list_max(embedding[1:16])) - 1 END AS cluster FROM embeddings)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(cluster AS INTEGER) AS cluster FROM s WHERE cluster <> -1
""")
def flt2(spark, sf_dir):
    from .reg_aggregate import single_clusters
    s = single_clusters(spark, sf_dir).where(F.col("perspective") == "sw").where(F.col("cluster") != -1)
    return s.select(F.col("ip").cast("long").alias("vec_id"), F.col("cluster").cast("int"))


@register("WIN2_kfold_split_lineitem", """
WITH r AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('42|' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR)), l_orderkey, l_linenumber, l_partkey) - 1 AS position,
         count(*) OVER (PARTITION BY l_returnflag) AS n
  FROM lineitem
), s AS (SELECT *, CASE WHEN n > 50000 THEN 20000 ELSE n // 5 END AS size FROM r),
f AS (SELECT s.*, g.f0 FROM s, range(0, 5) g(f0))
SELECT l_returnflag, CAST(f0 + 1 AS BIGINT) AS fold, CAST(count(*) AS BIGINT) AS n_test,
       CAST(min(position) AS BIGINT) AS min_position, CAST(max(position) AS BIGINT) AS max_position
FROM f WHERE (position >= f0 * size AND position < f0 * size + size) OR (position < f0 * size + size - n)
GROUP BY 1, 2
""")
def win2_lineitem(spark, sf_dir):
    """Five folds over every lineitem per return flag (the row key is order, line, part)."""
    li = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string")).alias("row_key"), "l_returnflag")
    m = W.kfold_test_membership(li, "row_key", "l_returnflag")
    return m.groupBy("l_returnflag", F.col("fold").cast("long").alias("fold")).agg(
        F.count(F.lit(1)).cast("long").alias("n_test"), F.min("position").cast("long").alias("min_position"),
        F.max("position").cast("long").alias("max_position"))


@register("FLT6_relationship_filter", """
SELECT 'Has_' || translate(f, '-.', '__') AS rel_type, CAST(count(*) AS BIGINT) AS n_edges FROM (
  SELECT 'p_name' AS f FROM part UNION ALL SELECT 'p_brand' FROM part UNION ALL SELECT 'p_size' FROM part) GROUP BY 1
""")
def flt6(spark, sf_dir):
    """Edges of all kinds (Has_* feature edges and IN_COMMUNITY edges) are filtered to the
    Has_* relations whose two endpoints exist and are not null."""
    from ..operators import graph as G
    from .reg_graph import FEATURES
    part = table(spark, sf_dir, "part")
    devices, feats, edges = G.layer1(part, "p_partkey", "p_type", FEATURES)
    comm = part.select(F.col("p_partkey").cast("string").alias("ip"), F.md5(F.col("p_type")).alias("feature_id"),
                       F.lit("IN_COMMUNITY").alias("rel_type"))
    allrel = edges.unionByName(comm)
    has = allrel.where(F.col("rel_type").startswith("Has_"))
    kept = R.edges_with_endpoints(has, devices, feats, "ip", "feature_id", "ip", "feature_id")
    return kept.groupBy("rel_type").agg(F.count(F.lit(1)).cast("long").alias("n_edges"))
