"""Registered scan / sink / streaming queries. Each writes data derived from the driver's
tables to a fresh folder under the shared checkpoint directory and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import insert_if_absent
from ..sources import io as IO
from ..sources.tables import table
from ..streaming import incremental as ST
from .reg_flatten import HOST_COLS, HOST_SQL, flat_fingerprints, host_fields, host_rows
from .reg_aggregate import _DRIFT_SQL
from ..session import stage_table
from .registry import register


def _paged_hosts(spark, sf_dir):
    """Rows of the hosts with their page; ``_host`` builds the nested host."""
    return host_rows(spark, sf_dir).withColumn("page_no", F.floor(F.col("o_orderkey").cast("string").cast("long") / 100).cast("int"))


def _host(row):
    return F.struct(*[c.alias(n) for n, c in host_fields(row).items()])


@register("SRC1_SRC2_page_scan", """
SELECT CAST(o_orderkey AS VARCHAR) AS ip, CAST(floor(o_orderkey / 100) AS INTEGER) AS page_no
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def src1(spark, sf_dir):
    """Hosts are written as scan pages (page number in the path), scanned back with the
    fixed page schema; hits without host are skipped, the page number comes from the path."""
    path = IO.scratch_path(spark, "pages")
    IO.write_pages(_paged_hosts(spark, sf_dir), path, build=_host)
    return IO.read_pages(spark, path).select(F.col("host.ip").alias("ip"), F.col("page_no").cast("int"))


@register("SRC3_csv_missing_columns", f"""
SELECT ip, "as-name", "loc-country", "os-info", CAST(NULL AS VARCHAR) AS "hw-versions" FROM ({HOST_SQL})
""")
def src3(spark, sf_dir):
    """Flat host blocks exported as CSV, scanned back with column pruning; a requested column
    the file does not have ('hw-versions') comes back as null."""
    path = IO.scratch_path(spark, "hosts-csv")
    flat = flat_fingerprints(spark, sf_dir).select(*[F.col(f"`{c}`") for c in HOST_COLS])
    IO.write_csv(flat, path)
    return IO.read_csv(spark, path, ["ip", "as-name", "loc-country", "os-info", "hw-versions"])


@register("SRC4_keyed_first_row", """
WITH k AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn
      FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM k))
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey FROM r WHERE rn = 1
""")
def src4(spark, sf_dir):
    """Scan a CSV export, keep the rows whose key is in a key set (semi-join) and the first
    row per key."""
    from ..operators.windows import first_per_key
    path = IO.scratch_path(spark, "lineitem-csv")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    IO.write_csv(li, path)
    scanned = IO.read_csv(spark, path, ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"])
    keys = scanned.where(F.col("l_returnflag") == "R").select("l_orderkey").distinct()
    kept = scanned.join(keys, "l_orderkey", "left_semi")
    first = first_per_key(kept.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("int").alias("ln"),
                                      F.col("l_partkey").cast("long").alias("pk")), ["l_orderkey"], ["ln", "pk"])
    return first.select("l_orderkey", "l_partkey")


@register("SRC5_tagged_union", """
SELECT l_returnflag AS device_type, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1
""")
def src5(spark, sf_dir):
    """Per-type files (one folder per type) read as one union, type taken from the path."""
    path = IO.scratch_path(spark, "typed")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    li.write.mode("overwrite").option("header", True).partitionBy("l_returnflag").csv(path)
    df = spark.read.option("header", True).option("recursiveFileLookup", "true").csv(path) \
        .withColumn("device_type", F.regexp_extract(F.input_file_name(), r"l_returnflag=([^/]+)/", 1))
    return df.groupBy("device_type").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("SRC6_node_edge_scan", """
SELECT 'Device' AS label, CAST(count(*) AS BIGINT) AS n FROM part
UNION ALL SELECT 'Feature', CAST(count(*) AS BIGINT) FROM (
  SELECT DISTINCT 'p_name' AS f, coalesce(p_name, '') AS v FROM part UNION SELECT DISTINCT 'p_brand', coalesce(p_brand, '') FROM part
  UNION SELECT DISTINCT 'p_size', coalesce(CAST(p_size AS VARCHAR), '') FROM part)
""")
def src6(spark, sf_dir):
    """Graph export as a node table with a label column, scanned back and split by label."""
    from ..operators import graph as G
    from .reg_graph import FEATURES
    devices, feats, _ = G.layer1(table(spark, sf_dir, "part"), "p_partkey", "p_type", FEATURES)
    nodes = devices.select(F.col("ip").alias("_id"), F.lit(":Device").alias("_labels")) \
        .unionByName(feats.select(F.col("feature_id").alias("_id"), F.lit(":Feature").alias("_labels")))
    path = IO.scratch_path(spark, "nodes")
    IO.write_csv(nodes, path)
    back = IO.read_csv(spark, path, ["_id", "_labels"])
    return back.groupBy(F.regexp_replace("_labels", "^:", "").alias("label")).agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("SRC7_text_list", """
SELECT DISTINCT trim(p_type) AS value FROM part WHERE trim(p_type) <> ''
""")
def src7(spark, sf_dir):
    path = IO.scratch_path(spark, "typelist")
    table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("value")).distinct() \
        .write.mode("overwrite").text(path)
    return IO.read_lines(spark, path).distinct()


@register("SRC8_file_listing")
def src8(spark, sf_dir):
    """Recursive listing of the written page files with their extension."""
    path = IO.scratch_path(spark, "pages-list")
    IO.write_pages(_paged_hosts(spark, sf_dir), path, build=_host)
    files = IO.list_files(spark, path, ["json"])
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n_files"))


@register("SNK3_SNK5_partitioned_store", """
SELECT l_returnflag AS kind, l_linestatus AS device_type, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2
""")
def snk3(spark, sf_dir):
    """Append per (kind, type) partition, then replace one partition only (dynamic
    partition overwrite): the rewritten partition holds its rows once, the others are kept."""
    path = IO.scratch_path(spark, "store")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("device_type"),
                                                 "l_orderkey", "l_linenumber")
    IO.write_partitioned(li, path, ["kind", "device_type"], mode="append")
    IO.write_partitioned(li.where(F.col("kind") == "R"), path, ["kind", "device_type"], mode="overwrite")
    return spark.read.parquet(path).groupBy("kind", "device_type").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("SNK4_insert_if_absent", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'first' ELSE 'second' END AS decided_by
FROM orders
""")
def snk4(spark, sf_dir):
    """Two decision batches merged by key: the second only inserts keys the first did not
    decide."""
    o = table(spark, sf_dir, "orders")
    first = o.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").cast("long"), F.lit("first").alias("decided_by"))
    second = o.select(F.col("o_orderkey").cast("long"), F.lit("second").alias("decided_by"))
    return insert_if_absent(first, second, ["o_orderkey"])


@register("SNK7_type_vendor_split", """
SELECT 'type' AS tbl, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT p_type) AS BIGINT) AS n_values FROM part
UNION ALL SELECT 'vendor', CAST(count(*) AS BIGINT), CAST(count(DISTINCT p_brand) AS BIGINT) FROM part
""")
def snk7(spark, sf_dir):
    """One result split into a type table and a vendor table (two selects of one frame)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    base = IO.scratch_path(spark, "split")
    p.select("p_partkey", "p_type").write.mode("overwrite").parquet(base + "/type")
    p.select("p_partkey", "p_brand").write.mode("overwrite").parquet(base + "/vendor")
    t = spark.read.parquet(base + "/type")
    v = spark.read.parquet(base + "/vendor")
    return t.agg(F.lit("type").alias("tbl"), F.count(F.lit(1)).cast("long").alias("n_rows"),
                 F.countDistinct("p_type").cast("long").alias("n_values")).unionByName(
        v.agg(F.lit("vendor").alias("tbl"), F.count(F.lit(1)).cast("long").alias("n_rows"),
              F.countDistinct("p_brand").cast("long").alias("n_values")))


@register("SNK2_SNK6_jsonl_and_skip_existing", """
SELECT CAST(count(*) AS BIGINT) AS n_rows FROM conversations
""")
def snk2(spark, sf_dir):
    """JSON-lines sink; a second write with mode 'ignore' leaves the existing table as is."""
    path = IO.scratch_path(spark, "jsonl")
    c = table(spark, sf_dir, "conversations")
    c.write.mode("overwrite").json(path)
    c.write.mode("ignore").json(path)
    return spark.read.json(path).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


@register("ST1_stream_new_pages", """
SELECT CAST(count(*) AS BIGINT) AS n_hosts FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def st1(spark, sf_dir):
    """Pages arrive in two drops; the second run of the checkpointed stream flattens only
    the new pages, so every host is flattened exactly once."""
    base = IO.scratch_path(spark, "st1")
    hosts = stage_table(_paged_hosts(spark, sf_dir), "st1-hosts")  # both drops read it
    half = F.col("o_orderstatus") == "F"   # first drop: finished orders
    IO.write_pages(hosts.where(half), base + "/in/a", build=_host)
    ST.stream_new_pages(spark, base + "/in", base + "/out", base + "/ckpt")
    IO.write_pages(hosts.where(~half), base + "/in/b", build=_host)
    ST.stream_new_pages(spark, base + "/in", base + "/out", base + "/ckpt")
    return spark.read.parquet(base + "/out").agg(F.count(F.lit(1)).cast("long").alias("n_hosts"))


@register("ST2_encode_new_texts", """
SELECT CAST(count(DISTINCT md5(text)) AS BIGINT) AS n_encoded FROM documents
""")
def st2(spark, sf_dir):
    """Texts encoded in an earlier run are not encoded again; each distinct text is
    encoded once (VEC8 encoder)."""
    from ..operators.encode import hashed_text_vectors
    docs = table(spark, sf_dir, "documents")

    def enc(todo):
        return hashed_text_vectors(todo, "text_key", "text", dim=64)

    first = ST.encode_new_texts(docs.where(F.col("lang") == "en"), None, "text", enc)
    second = ST.encode_new_texts(docs, first, "text", enc)
    return first.select("text_key").unionByName(second.select("text_key")).agg(
        F.countDistinct("text_key").cast("long").alias("n_encoded"))


@register("ST3_resume_point", """
WITH t AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type),
r AS (SELECT p_type, n, row_number() OVER (ORDER BY p_type) AS k FROM t)
SELECT p_type AS device, 'sw' AS perspective, CAST(n // 2 AS BIGINT) AS rows_so_far FROM r WHERE k = (SELECT max(k) FROM r)
""")
def st3(spark, sf_dir):
    """A load log built from the part types (every type loaded in batches of 100 and
    finished, except the last, which stopped half way) is parsed to the resume point. The
    log lines are generated in Spark from the per-type counts."""
    from pyspark.sql import Window
    t = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("p_type")  # one row per type
    t = t.withColumn("_i", F.row_number().over(order)).withColumn("_last", F.col("_i") == F.max("_i").over(Window.partitionBy()))
    t = t.withColumn("_stop", F.when(F.col("_last"), F.floor(F.col("n") / 2)).otherwise(F.col("n")))
    t = t.withColumn("_nb", F.ceil(F.col("_stop") / 100)) \
        .withColumn("_len", F.col("_nb") + F.when(F.col("_last"), 1).otherwise(2))
    t = t.withColumn("_base", F.coalesce(F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per log line, generated per type inside Spark
    lines = t.select("p_type", "_stop", "_nb", "_last", "_base", F.explode(F.sequence(F.lit(0), F.col("_len") - 1)).alias("_j"))
    done = F.least(F.col("_j") * 100, F.col("_stop"))
    step = done - F.least((F.col("_j") - 1) * 100, F.col("_stop"))
    text = (F.when(F.col("_j") == 0, F.concat(F.lit("Loading CSV: ipraw_"), "p_type", F.lit("_embedding_sw.csv (device="), "p_type", F.lit(")")))
            .when(F.col("_j") <= F.col("_nb"), F.concat(F.lit("Inserted batch: "), step.cast("string"), F.lit(" rows (total so far: "),
                                                        done.cast("string"), F.lit(")")))
            .otherwise(F.concat(F.lit("Finished ipraw_"), "p_type", F.lit("_embedding_sw.csv: "), F.col("_stop").cast("string"),
                                F.lit(" rows inserted into sw"))))
    log = lines.select((F.col("_base") + F.col("_j")).cast("long").alias("line_no"), text.alias("line"))
    res = ST.resume_point(log)
    return res.select("device", "perspective", F.col("rows_so_far").cast("long"))


@register("ST4_incremental_decisions", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT user_id) AS BIGINT) AS n_keys FROM (SELECT DISTINCT user_id FROM events)
""")
def st4(spark, sf_dir):
    """Event files stream in; each micro-batch decides per user and merges insert-if-absent
    into the decision table; re-running the stream adds nothing."""
    base = IO.scratch_path(spark, "st4")
    e = table(spark, sf_dir, "events")
    e.write.mode("overwrite").parquet(base + "/in")
    stream = spark.readStream.schema(e.schema).parquet(base + "/in")

    def decide(batch):
        return batch.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"))

    ST.incremental_decisions(stream, decide, base + "/table", ["user_id"], base + "/ckpt")
    ST.incremental_decisions(spark.readStream.schema(e.schema).parquet(base + "/in"), decide, base + "/table",
                             ["user_id"], base + "/ckpt2")
    t = spark.read.parquet(base + "/table")
    return t.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.countDistinct("user_id").cast("long").alias("n_keys"))


@register("ST4_keyed_decisions", """
WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 12 HOUR THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e),
s AS (SELECT user_id, k, min(ts) AS a, max(ts) + INTERVAL 12 HOUR AS b, arg_max(event_type, (ts, event_id)) AS decision, count(*) AS n
      FROM g GROUP BY 1, 2)
SELECT CAST(user_id AS BIGINT) AS user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_end,
       decision, CAST(n AS BIGINT) AS n FROM s
WHERE b <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR
""")
def st4_keyed(spark, sf_dir):
    """Decisions per user and session from two drops of events; the stream is started anew for the second, and sessions
    that span both come from the state it left."""
    from .reg_aggregate import SPLIT_TS
    base = IO.scratch_path(spark, "st4k")
    e = table(spark, sf_dir, "events")
    split = F.lit(SPLIT_TS).cast("timestamp_ntz")
    for drop, rows in (("a", e.where(F.col("ts") < split)), ("b", e.where(F.col("ts") >= split))):
        rows.write.mode("overwrite").parquet(f"{base}/in/{drop}")
        stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(base + "/in")
        ST.keyed_decisions(stream, "user_id", "ts", "event_id", "event_type", base + "/out", base + "/ckpt")
    t = spark.read.parquet(base + "/out")
    at = "yyyy-MM-dd HH:mm:ss"
    return t.select(F.col("user_id").cast("long"), F.date_format("session_start", at).alias("session_start"),
                    F.date_format("session_end", at).alias("session_end"), "decision", F.col("n").cast("long"))


@register("ST5_stream_drift_windows", f"""
WITH {_DRIFT_SQL}
SELECT strftime(date_trunc('day', e.ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('day', e.ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(is_drift AS INTEGER)) AS BIGINT) AS n_drift
FROM events e JOIN test USING (event_id) GROUP BY 1, 2
""")
def st5(spark, sf_dir):
    """Later events stream against the stored reference threshold; drifts are counted per day (UTC). They arrive in two
    drops, with a restart in between; the second one updates the days that are still open."""
    from .reg_aggregate import SPLIT_TS, _drift
    base = IO.scratch_path(spark, "st5")
    e = table(spark, sf_dir, "events")
    _, thr = _drift(spark, sf_dir)
    later = e.where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))
    second = F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz") + F.expr("INTERVAL 180 HOURS")
    for drop, rows in (("a", later.where(~second)), ("b", later.where(second))):
        rows.write.mode("overwrite").parquet(f"{base}/in/{drop}")
        stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(base + "/in")
        ST.stream_drift_counts(stream, thr, "ts", "value", base + "/out", base + "/ckpt")
    at = "yyyy-MM-dd HH:mm:ss"
    return ST.drift_windows(spark, base + "/out").select(F.date_format("window_start", at).alias("window_start"),
                                                         F.date_format("window_end", at).alias("window_end"),
                                                         F.col("n").cast("long"), F.col("n_drift").cast("long"))


@register("SNK8_drift_outputs", """
SELECT 'scores' AS output, CAST(count(*) AS BIGINT) AS n_rows FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'
UNION ALL SELECT 'explanation', 4
UNION ALL SELECT 'summary', CAST(count(DISTINCT event_type) AS BIGINT) FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'
""")
def snk8(spark, sf_dir):
    """The three outputs of the drift run: per-row scores (parquet), per-perspective
    explanation (JSON lines) and the per-class summary (CSV); each is read back and counted."""
    from .reg_learning import drift_pipeline
    from ..session import cut_lineage
    _, flagged, _, groups, _, _ = drift_pipeline(spark, sf_dir)
    flagged = cut_lineage(flagged)   # three sinks read the same scored rows
    base = IO.scratch_path(spark, "snk8")
    flagged.drop("x").write.mode("overwrite").parquet(base + "/scores")
    expl = flagged.select(F.inline(F.array(*[F.struct(F.lit(g).alias("perspective"), F.col(f"score_{g}").alias("score"))
                                             for g in sorted(groups)]))).groupBy("perspective").agg(F.avg("score").alias("mean_score"))
    expl.write.mode("overwrite").json(base + "/explanation")
    summ = flagged.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_drift").cast("int")).alias("n_drift"),
                                             F.avg("drift_score").alias("mean_score"))
    IO.write_csv(summ, base + "/summary")
    outs = [("scores", spark.read.parquet(base + "/scores")), ("explanation", spark.read.json(base + "/explanation")),
            ("summary", IO.read_csv(spark, base + "/summary", ["event_type", "n", "n_drift", "mean_score"]))]
    res = None
    for name, df in outs:
        d = df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(F.lit(name).alias("output"), "n_rows")
        res = d if res is None else res.unionByName(d)
    return res
