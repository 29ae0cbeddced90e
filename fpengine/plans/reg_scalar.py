"""Registered scalar-function queries (FN*) over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.tables import table
from .registry import register

_NORM = "coalesce(nullif(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), ''), 'unknown')"


@register("FN1_normalize_vendor", f"""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, {_NORM.format('p_brand')} AS brand_norm, {_NORM.format('p_name')} AS name_norm FROM part
""")
def fn1(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("long"), S.normalize_vendor("p_brand").alias("brand_norm"),
                    S.normalize_vendor("p_name").alias("name_norm"))


@register("FN2_normalize_label", """
WITH l AS (SELECT p_partkey, p_type || '-' || p_brand AS label FROM part),
v AS (SELECT p_partkey, label, regexp_replace(lower(substr(label, instr(label, '-') + 1)), '[^a-z0-9]', '', 'g') AS vn FROM l)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, label,
       CASE WHEN instr(label, '-') > 0 THEN lower(split_part(label, '-', 1)) || '-' ||
            CASE WHEN vn = 'electroind' THEN 'electroindustries' ELSE vn END ELSE lower(label) END AS label_norm
FROM v
""")
def fn2(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit("-"), "p_brand").alias("label"))
    return p.select(F.col("p_partkey").cast("long"), "label", S.normalize_label("label").alias("label_norm"))


@register("FN3_comma_tokens", r"""
WITH t AS (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS tok
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ',')) AS x FROM documents))
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(count(t.tok) AS BIGINT) AS n_tokens,
       CAST(coalesce(sum(length(t.tok)), 0) AS BIGINT) AS token_chars
FROM documents d LEFT JOIN (SELECT * FROM t WHERE tok <> '') t USING (doc_id) GROUP BY d.doc_id
""")
def fn3(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    toks = S.comma_tokenizer("text")
    return d.select(F.col("doc_id").cast("long"), F.size(toks).cast("long").alias("n_tokens"),
                    F.aggregate(toks, F.lit(0).cast("long"), lambda a, t: a + F.length(t)).alias("token_chars"))


@register("FN5_chunk_text", """
WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS st FROM documents WHERE length(text) > 0)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(st // 450 AS BIGINT) AS chunk_no,
       CAST(length(substr(text, st + 1, 500)) AS BIGINT) AS chunk_len, md5(substr(text, st + 1, 500)) AS chunk_md5
FROM s
""")
def fn5(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = d.select("doc_id", F.posexplode(S.chunk_text("text")).alias("chunk_no", "chunk"))
    return c.select(F.col("doc_id").cast("long"), F.col("chunk_no").cast("long"),
                    F.length("chunk").cast("long").alias("chunk_len"), F.md5("chunk").alias("chunk_md5"))


@register("FN6_banner_hex", """
WITH h AS (SELECT p_partkey, p_size, ' ' || hex(p_name) || CASE WHEN p_size % 7 = 0 THEN 'Z' ELSE '' END || chr(10) AS banner FROM part)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, banner,
       try(decode(unhex(replace(replace(trim(banner, ' ' || chr(10)), ' ', ''), chr(10), '')))) AS decoded
FROM h
""")
def fn6(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    banner = F.concat(F.lit(" "), F.hex("p_name"), F.when(F.col("p_size") % 7 == 0, F.lit("Z")).otherwise(F.lit("")), F.lit("\n"))
    return p.select(F.col("p_partkey").cast("long"), banner.alias("banner")) \
        .select("p_partkey", "banner", S.parse_banner_hex("banner").alias("decoded"))


@register("FN7_bits16", """
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, lpad(bin(p_size), 16, '0') AS bits FROM part
""")
def fn7(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long"), S.bits16("p_size").alias("bits"))


@register("FN8_wrap_label", r"""
WITH t AS (SELECT page_id, regexp_replace(url, '[\r\n]+$', '') AS u FROM pages)
SELECT CAST(page_id AS BIGINT) AS page_id,
       CASE WHEN length(u) > 30 THEN array_to_string(list_transform(range(0, length(u), 30), lambda i: substr(u, i + 1, 30)), chr(10)) ELSE u END AS label
FROM t
""")
def fn8(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), S.wrap_label("url").alias("label"))


@register("FN9_json_from_text", """
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
""")
def fn9(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("long"),
                    F.get_json_object(S.json_from_fenced("props"), "$.k").cast("int").alias("k"))


@register("FN10_robust_json", """
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(value AS DOUBLE) AS value FROM events
""")
def fn10(spark, sf_dir):
    """Wrap each event's props in model-style chatter (a fence on some rows, prose on
    others), then recover the object with the robust extractor."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```")))\
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("the result is "), "props", F.lit(" as requested"))).otherwise(F.col("props"))
    got = S.robust_json(text)
    return e.select(F.col("event_id").cast("long"), F.get_json_object(got, "$.k").cast("int").alias("k"),
                    F.col("value").cast("double"))


@register("FN11_type_catalogue", """
WITH t AS (SELECT p_partkey, p_name, p_type FROM part)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey,
  CASE WHEN p_type IN ('ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD') THEN p_type END AS exact,
  coalesce(
    CASE WHEN instr(lower(p_name), 'economy') > 0 THEN 'ECONOMY' END, CASE WHEN instr(lower(p_name), 'large') > 0 THEN 'LARGE' END,
    CASE WHEN instr(lower(p_name), 'medium') > 0 THEN 'MEDIUM' END, CASE WHEN instr(lower(p_name), 'promo') > 0 THEN 'PROMO' END,
    CASE WHEN instr(lower(p_name), 'small') > 0 THEN 'SMALL' END, CASE WHEN instr(lower(p_name), 'standard') > 0 THEN 'STANDARD' END
  ) AS from_name,
  CASE WHEN coalesce(instr(lower(p_name), 'economy'), 0) + instr(lower(p_name), 'large') + instr(lower(p_name), 'medium')
            + instr(lower(p_name), 'promo') + instr(lower(p_name), 'small') + instr(lower(p_name), 'standard') > 0 THEN 3 END AS match_class
FROM t
""")
def fn11(spark, sf_dir):
    cat = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    p = table(spark, sf_dir, "part")
    exact, _ = S.type_catalogue_match(F.col("p_type"), cat)
    from_name, klass = S.type_catalogue_match(F.col("p_name"), cat)
    return p.select(F.col("p_partkey").cast("long"), exact.alias("exact"), from_name.alias("from_name"),
                    klass.cast("int").alias("match_class"))


@register("FN12_top3_vendors", """
WITH t AS (SELECT p_partkey, string_split(p_name || ' unknown ' || p_brand || ' ' || p_type, ' ') AS toks FROM part),
k AS (SELECT p_partkey, list_filter(toks, lambda v: v IS NOT NULL AND lower(trim(v)) <> 'unknown' AND trim(v) <> '') AS kept FROM t)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey,
       CASE WHEN len(kept) > 0 THEN array_to_string(kept[1:3], ',') ELSE 'unknown' END AS top3
FROM k
""")
def fn12(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    toks = F.split(F.concat_ws(" ", "p_name", F.lit("unknown"), "p_brand", "p_type"), " ")
    return p.select(F.col("p_partkey").cast("long"), F.array_join(S.top3_vendors(toks), ",").alias("top3"))


@register("FN13_simple_similarity", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem),
pr AS (SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS pa, b.l_partkey AS pb
       FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
SELECT CAST(pr.l_orderkey AS BIGINT) AS l_orderkey, CAST(pr.l_linenumber AS INTEGER) AS l_linenumber,
       CAST(pa AS BIGINT) AS part_a, CAST(pb AS BIGINT) AS part_b,
       round((coalesce(CAST(x.p_name = y.p_name AS INTEGER), 0) + coalesce(CAST(x.p_brand = y.p_brand AS INTEGER), 0)
              + coalesce(CAST(x.p_type = y.p_type AS INTEGER), 0) + coalesce(CAST(x.p_size = y.p_size AS INTEGER), 0)) / 5.0, 6) AS similarity
FROM pr JOIN part x ON x.p_partkey = pa JOIN part y ON y.p_partkey = pb
""")
def fn13(spark, sf_dir):
    """Similarity of the parts on consecutive lines of an order (the id is one of the five
    keys and never matches)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf_dir, "part")
    a = li.alias("a")
    b = li.select(F.col("l_orderkey").alias("o2"), (F.col("l_linenumber") - 1).alias("ln2"), F.col("l_partkey").alias("pb"))
    pr = a.join(b, (F.col("l_orderkey") == F.col("o2")) & (F.col("l_linenumber") == F.col("ln2")))
    x = part.select(*[F.col(c).alias(f"x_{c}") for c in part.columns])
    y = part.select(*[F.col(c).alias(f"y_{c}") for c in part.columns])
    j = pr.join(x, F.col("l_partkey") == F.col("x_p_partkey")).join(y, F.col("pb") == F.col("y_p_partkey"))
    cols = ["p_name", "p_brand", "p_type", "p_size"]
    sim = S.simple_similarity([F.col(f"x_{c}") for c in cols], [F.col(f"y_{c}") for c in cols], 5)
    return j.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"),
                    F.col("l_partkey").cast("long").alias("part_a"), F.col("pb").cast("long").alias("part_b"),
                    F.round(sim, 6).alias("similarity"))


@register("FN14_map_lines", """
SELECT CAST(event_id AS BIGINT) AS event_id, 'k: ' || json_extract_string(props, '$.k') AS lines FROM events
""")
def fn14(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,int>")
    return e.select(F.col("event_id").cast("long"), S.map_lines(m).alias("lines"))


@register("FN15_joint_vote", """
WITH a AS (SELECT event_id, event_type AS ta, value / 100.0 AS ca FROM events),
b AS (SELECT event_id - 1 AS event_id, event_type AS tb, value / 100.0 AS cb FROM events)
SELECT CAST(event_id AS BIGINT) AS event_id,
       CASE WHEN ta = tb OR ca >= cb THEN ta ELSE tb END AS decision,
       round(CASE WHEN ta = tb THEN least(1.0, CAST(round(CAST(CAST((ca + cb) / 2 + 0.05 AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE)) WHEN ca >= cb THEN ca ELSE cb END, 6) AS confidence
FROM a JOIN b USING (event_id)
""")
def fn15(spark, sf_dir):
    """Vote between each event's (type, value/100) and the next event's."""
    e = table(spark, sf_dir, "events")
    a = e.select("event_id", F.col("event_type").alias("ta"), (F.col("value") / 100.0).alias("ca"))
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("tb"), (F.col("value") / 100.0).alias("cb"))
    t, c = S.joint_vote("ta", "ca", "tb", "cb")
    return a.join(b, "event_id").select(F.col("event_id").cast("long"), t.alias("decision"), F.round(c, 6).alias("confidence"))


@register("FN16_unseen_score", """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey,
       round(1.0 - (0.4 * (l_discount * 10) + 0.4 * (l_tax * 10) + 0.2 * (l_quantity / 50.0)), 4) AS unseen_score
FROM lineitem
""")
def fn16(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("long"),
                     S.unseen_score(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50.0).alias("unseen_score"))


_TAG_SQL = " , ".join(
    "CASE WHEN " + " OR ".join(f"instr(lower(text), '{k}') > 0" for k in kws) + f" THEN '{tag}' END"
    for tag, kws in S.PROBLEM_KEYWORDS.items())


@register("FN18_query_tags", f"""
WITH t AS (SELECT conv_id, turn, list_filter([{_TAG_SQL}], lambda x: x IS NOT NULL) AS tags FROM conversations WHERE role = 'user')
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       CASE WHEN len(tags) > 0 THEN array_to_string(tags, ',') ELSE 'CUSTOM_PROBLEM' END AS tags
FROM t
""")
def fn18(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.array_join(S.tag_query("text"), ",").alias("tags"))


@register("FN19_search_keywords", r"""
WITH t AS (SELECT page_id, list_transform(string_split(coalesce(url, ''), '/'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS toks FROM pages),
g AS (SELECT page_id, list_transform(list_filter(toks, lambda x: instr(x, '.') > 0 AND length(x) >= 5), lambda x: substr(x, 1, 120)) AS good FROM t),
d AS (SELECT page_id, list_filter(good, lambda x, i: NOT list_contains(good[1:i - 1], x)) AS dist FROM g)
SELECT CAST(page_id AS BIGINT) AS page_id, array_to_string(dist[1:3], ';') AS keywords FROM d
""")
def fn19(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("long"), F.array_join(S.search_keywords("url", sep="/"), ";").alias("keywords"))


@register("FN20_role_split", """
SELECT CAST(conv_id AS BIGINT) AS conv_id,
       arg_max(CASE WHEN role = 'system' THEN text END, CASE WHEN role = 'system' THEN turn END) AS system_text,
       CAST(count(*) FILTER (WHERE role <> 'system') AS BIGINT) AS n_messages,
       CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS n_user
FROM conversations GROUP BY conv_id
""")
def fn20(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    is_sys = F.col("role") == "system"
    return c.groupBy("conv_id").agg(
        F.max_by(F.when(is_sys, F.col("text")), F.when(is_sys, F.col("turn"))).alias("system_text"),
        F.count(F.when(~is_sys, 1)).cast("long").alias("n_messages"),
        F.count(F.when(F.col("role") == "user", 1)).cast("long").alias("n_user"),
    ).select(F.col("conv_id").cast("long"), "system_text", "n_messages", "n_user")


@register("FN21_numeric_coercion", """
SELECT CAST(event_id AS BIGINT) AS event_id, coalesce(TRY_CAST(props AS DOUBLE), 0.0) AS props_num,
       coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k_num FROM events
""")
def fn21(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("long"), S.to_number("props").alias("props_num"),
                    S.to_number(F.get_json_object("props", "$.k")).alias("k_num"))


@register("FN22_basename", r"""
SELECT CAST(page_id AS BIGINT) AS page_id,
       regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', '') AS base FROM pages
""")
def fn22(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("long"), S.basename_no_ext("url").alias("base"))


@register("FN4_JN13_vendor_token_match", """
WITH fp AS (
  SELECT l_orderkey, list_distinct(list_filter(list_transform(string_split(string_agg(p_brand || ',' || p_name, ','), ','),
                                    lambda t: lower(trim(t))), lambda t: t <> '' AND t <> 'unknown')) AS toks
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
), v AS (SELECT o_orderkey, c_name AS vendor FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(v.o_orderkey AS BIGINT) AS o_orderkey,
       len(list_filter(fp.toks, lambda t: instr(lower(v.vendor), t) > 0 OR instr(t, lower(v.vendor)) > 0)) > 0 AS matched,
       CAST(len(fp.toks) AS BIGINT) AS n_tokens
FROM v JOIN fp ON v.o_orderkey = fp.l_orderkey
""")
def fn4_jn13(spark, sf_dir):
    """FN4 token sets of each order's parts (brand and name lists), and JN13: does the
    customer's name contain a token or the token contain the name. The fuzzy theta join is
    evaluated per order against its own bounded token set (no cross join)."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    lists = li.join(part, li.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(
        F.concat_ws(",", F.collect_list("p_brand")).alias("brands"), F.concat_ws(",", F.collect_list("p_name")).alias("names"))
    toks = lists.select("l_orderkey", S.token_set(["brands", "names"]).alias("toks"))
    v = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .select("o_orderkey", F.lower("c_name").alias("vendor"))
    j = v.join(toks, v.o_orderkey == toks.l_orderkey)
    hit = F.exists("toks", lambda t: (F.instr(F.col("vendor"), t) > 0) | (F.instr(t, F.col("vendor")) > 0))
    return j.select(F.col("o_orderkey").cast("long"), hit.alias("matched"), F.size("toks").cast("long").alias("n_tokens"))


@register("JN13_global_vendor_match", """
WITH vendor AS (
  SELECT DISTINCT v FROM (SELECT lower(p_brand) AS v FROM part UNION ALL SELECT unnest(string_split(lower(p_name), ' ')) FROM part) WHERE v <> ''
), tok AS (
  SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9#]+')) AS t FROM documents) WHERE t <> '' AND t <> 'unknown'
), token AS (SELECT t, count(*) AS n FROM tok GROUP BY t)
SELECT v AS vendor, t AS token, CAST(n AS BIGINT) AS n_documents FROM vendor JOIN token ON instr(t, v) > 0 OR instr(v, t) > 0
""")
def jn13(spark, sf_dir):
    """JN13 without a shared key: every vendor (brand or word of a part's name) against every token of every document,
    either containing the other, with the number of documents that hold the token."""
    from ..operators.substrings import containment_join
    part = table(spark, sf_dir, "part")
    vendor = part.select(F.lower("p_brand").alias("v")).union(part.select(F.explode(F.split(F.lower("p_name"), " "))))
    tok = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9#]+"))).alias("t")) \
        .where("t <> '' AND t <> 'unknown'").distinct()
    token = tok.groupBy("t").agg(F.count(F.lit(1)).alias("n_documents"))
    return containment_join(vendor, token, "v", "t").join(token, F.col("right") == F.col("t")) \
        .select(F.col("left").alias("vendor"), F.col("right").alias("token"), "n_documents")


@register("FN17_perspective_descriptions", """
WITH r AS (
  SELECT p_type AS cluster, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS software,
         CAST(min(p_size) AS VARCHAR) || '-' || CAST(max(p_size) AS VARCHAR) AS service_distribution,
         string_agg(DISTINCT split_part(p_name, ' ', 1), ',' ORDER BY split_part(p_name, ' ', 1)) AS tags
  FROM part GROUP BY p_type
)
SELECT cluster, 'sw' AS perspective, substr(software, 1, 500) AS description FROM r
UNION ALL SELECT cluster, 'sd', substr(service_distribution, 1, 500) FROM r
UNION ALL SELECT cluster, 'body', substr(tags, 1, 500) FROM r
UNION ALL SELECT cluster, 'htags', substr(tags, 1, 500) FROM r
UNION ALL SELECT cluster, 'hfavicons', substr(tags, 1, 500) FROM r
""")
def fn17(spark, sf_dir):
    """Cluster reports (one per part type) carry common patterns under report keys; each
    perspective takes the text of its key. Pattern lists are distinct values (bounded)."""
    p = table(spark, sf_dir, "part")
    rep = p.groupBy(F.col("p_type").alias("cluster")).agg(
        F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("software"),
        F.concat(F.min("p_size").cast("string"), F.lit("-"), F.max("p_size").cast("string")).alias("service_distribution"),
        F.array_join(F.array_sort(F.collect_set(F.split("p_name", " ")[0])), ",").alias("tags"))
    patterns = F.create_map(F.lit("software"), F.col("software"), F.lit("service_distribution"), F.col("service_distribution"),
                            F.lit("http_tags_favicons"), F.col("tags"))
    d = rep.select("cluster", F.explode(S.perspective_descriptions(patterns)).alias("perspective", "description"))
    return d


@register("WIN8_shares_and_others", """
WITH c AS (SELECT p_brand AS label, count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
t AS (SELECT *, cnt / sum(cnt) OVER () AS share, row_number() OVER (ORDER BY cnt DESC, label) AS r FROM c),
top AS (SELECT label, cnt, share FROM t WHERE r <= 10)
SELECT label, CAST(cnt AS BIGINT) AS cnt, round(share, 6) AS share FROM top
UNION ALL
SELECT 'others', CAST(greatest(0, (SELECT sum(cnt) FROM c) - (SELECT sum(cnt) FROM top)) AS BIGINT),
       round(greatest(0, (SELECT sum(cnt) FROM c) - (SELECT sum(cnt) FROM top)) / (SELECT sum(cnt) FROM c), 6)
""")
def win8(spark, sf_dir):
    """Share of each brand among all lines, the ten largest and an 'others' remainder.
    The ten largest come from a global top-k (each task keeps ten rows) and the total is one
    aggregated number, so no window spans the value-count table."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = j.groupBy(F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    total = c.agg(F.sum("cnt")).first()[0] or 0
    top = c.orderBy(F.col("cnt").desc(), "label").limit(10)
    top_sum = top.agg(F.sum("cnt")).first()[0] or 0
    rest = max(0, total - top_sum)
    others = spark.createDataFrame([("others", int(rest), round(rest / total, 6) if total else 0.0)],
                                   "label string, cnt long, share double")
    return top.select("label", F.col("cnt").cast("long"), F.round(F.col("cnt") / F.lit(float(total)), 6).alias("share")) \
        .unionByName(others)
