"""Disk and memory of staged plans: shuffle files go with the write, Arrow batches are bounded by bytes."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fpengine.llm import jaccard
from fpengine.llm.common import ARROW_BYTES, discard, setting, small_batches, stage
from tests.conftest import SF001


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",")
    return {f for f in files if f.rpartition("/")[2].startswith("shuffle_")}


def _sized(batches):
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])


def test_a_staged_plan_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, None)
    before = _shuffle_files(spark)
    df = spark.range(50_000).select(F.xxhash64("id").alias("h"), "id").repartition(8, "h")
    df = stage(df, "test-shuffled")  # no collection of garbage is asked for
    until = time.time() + 10
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert df.count() == 50_000 and spark.conf.get(key, None) == own
    discard(df)


def test_a_plan_that_is_staged_twice_has_the_same_rows(spark):
    df = spark.range(1_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    first, second = stage(df, "test-first"), stage(df, "test-second")
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(first) == rows(second) == rows(df)
    discard(first, second)


def _long_texts(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.concat(F.lit("word"), F.col("id") * 1000 + k)))
    return spark.range(0, 3_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))  # about 4 KB a text, 12 MB a task


def test_small_batches_and_the_sessions_own_value(spark):
    with setting(spark, ARROW_BYTES, "64m"):
        with small_batches(spark):
            got = _long_texts(spark).mapInArrow(_sized, "n long, size long").collect()
        assert sum(r.n for r in got) == 3_000 and max(r.size for r in got) < 4_000_000
        assert spark.conf.get(ARROW_BYTES) == "64m"
        with pytest.raises(ZeroDivisionError), small_batches(spark):
            1 / 0
        assert spark.conf.get(ARROW_BYTES) == "64m"


def test_the_kernels_of_the_join_get_small_batches(spark, monkeypatch):
    def bounded(make):
        def made(*args):
            kernel = make(*args)

            def run(batches):
                def checked():
                    for b in batches:
                        assert b.nbytes < 4_000_000, f"a batch of {b.nbytes} bytes"
                        yield b
                yield from kernel(checked())
            return run
        return made

    for name in ("_scan", "_prefixes", "_sets"):
        monkeypatch.setattr(jaccard, name, bounded(getattr(jaccard, name)))
    with setting(spark, ARROW_BYTES, "64m"):
        got = jaccard.similar_components(_long_texts(spark)).collect()
    assert len(got) == 3_000 and all(r.component_id == r.doc_id and r.n_shingles == 296 for r in got)


def test_the_plans_of_pipeline_stages_get_small_batches(spark):
    with setting(spark, ARROW_BYTES, "64m"):
        for _, stage_of in corpus_pipeline.STAGES:
            spark.conf.set(ARROW_BYTES, "64m")
            stage_of(spark, spark.read.parquet(f"{SF001}/documents.parquet").limit(20), SF001)
            got = _long_texts(spark).mapInArrow(_sized, "n long, size long").collect()  # as the write of a result would
            assert max(r.size for r in got) < 4_000_000
