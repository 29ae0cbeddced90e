"""Scans and sinks (SRC1-SRC8, SNK1-SNK8).

Output locations are folders under the session's shared checkpoint directory unless a path
is given, so that nothing lands on a machine-local folder of a cluster node."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.flatten import PAGE, hosts_from_pages
from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex[:8]}"


def page_number(path_col=None) -> F.Column:
    """SRC2: page number from a file name like page12.json or page=12 (0 when absent)."""
    p = path_col if path_col is not None else F.input_file_name()
    n = F.regexp_extract(p, r"page(?:_no)?=?(\d+)", 1)
    return F.coalesce(F.nullif(n, F.lit("")).cast("int"), F.lit(0))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: scan JSON pages with a fixed schema; malformed records are kept aside in
    ``_corrupt_record`` (PERMISSIVE) instead of failing the job; hits without host are skipped."""
    schema = T.StructType(PAGE.fields + [T.StructField("_corrupt_record", T.StringType())])
    pages = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
             .option("recursiveFileLookup", "true").json(path))
    pages = pages.where(F.col("result.hits").isNotNull()).withColumn("page_no", page_number())
    hits = pages.select("page_no", F.explode("result.hits").alias("hit"))
    return hits.where(F.col("hit.host_v1").isNotNull()).select("page_no", F.col("hit.host_v1.resource").alias("host"))


def write_pages(hosts: DataFrame, path: str, page_col: str = "page_no", build: Callable[[Column], Column] | None = None) -> None:
    """Group hosts into scan pages (one JSON object per page, compressed) partitioned by page number. ``build`` makes the nested host of a row
    (a struct of all columns but the page's); it is applied on the page, so that rows travel as they are. Without it the column is ``host``."""
    row = F.struct(*[c for c in hosts.columns if c != page_col]) if build else F.col("host")
    pages = hosts.groupBy(page_col).agg(F.collect_list(row).alias("hits"))
    hits = F.transform("hits", lambda r: F.struct(F.struct((build(r) if build else r).alias("resource")).alias("host_v1")))
    pages.select(page_col, F.struct(F.lit(None).cast("string").alias("total_hits"), F.lit(None).cast("string").alias("next_page_token"),
                                    hits.alias("hits")).alias("result")) \
        .write.mode("overwrite").option("compression", "gzip").partitionBy(page_col).json(path)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], present: Sequence[str] | None = None) -> DataFrame:
    """SRC3: CSV with header, quoted multi-line cells; only ``columns`` are returned and any
    of them missing from the file comes back as a null column."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    """SNK1 export form: header, quoted, escaped quotes."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_tagged(spark: SparkSession, path: str, fmt: str = "csv", tag: str = "device_type",
                pattern: str = r"([^/=]+)=([^/]+)/[^/]*$") -> DataFrame:
    """SRC5: union of many files with the type taken from each file's path."""
    df = spark.read.option("header", True).format(fmt).load(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    return df.withColumn(tag, F.regexp_extract(F.input_file_name(), pattern, 2))


def list_files(spark: SparkSession, path: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """SRC8: recursive listing with lower-cased extension test (content is not read); of a compressed file the extension before ".gz" counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.withColumn("ext", F.lower(F.regexp_extract("path", r"(?i)\.([^./]+?)(?:\.gz)?$", 1)))
    if extensions:
        files = files.where(F.col("ext").isin([e.lower().lstrip(".") for e in extensions]))
    return files


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: text list, trimmed, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where(F.col("value") != "")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite", fmt: str = "parquet") -> None:
    """SNK1/SNK3/SNK5: partitioned write. With mode='overwrite' and the session's
    partitionOverwriteMode=dynamic only the partitions present in ``df`` are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    """SNK6 existence test: a table exists when it has at least one row."""
    try:
        return spark.read.parquet(path).limit(1).count() > 0
    except Exception:  # noqa: BLE001 - missing path
        return False


__all__ = ["scratch_path", "page_number", "read_pages", "write_pages", "read_csv", "write_csv", "read_tagged",
           "list_files", "read_lines", "write_partitioned", "exists", "hosts_from_pages"]
