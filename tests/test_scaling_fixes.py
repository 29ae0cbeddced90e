"""Steps that once ran several times, or moved more than they need."""

from pyspark.sql import functions as F

from fpengine.operators import encode as EN
from fpengine.operators import flatten as FL
from fpengine.plans import reg_flatten, reg_io, reg_learning
from fpengine.sources import io as IO

from .conftest import SF001


def test_drift_features_are_assembled_once(spark):
    scored, *_ = reg_learning.drift_pipeline(spark, SF001)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_chunks_are_encoded_without_a_second_join(spark):
    docs = spark.createDataFrame([(1, "alpha beta " * 90), (2, "gamma"), (3, None)], "doc_id long, text string")
    out = EN.chunked_text_vectors(docs, "doc_id", "text", dim=16)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {r.doc_id: len(r.vec) for r in out.collect()}.keys() >= {1, 2}


def test_pages_are_compressed_and_read_back(spark, tmp_path):
    hosts = reg_flatten.build_hosts(spark, SF001).withColumn("page_no", F.floor(F.col("host.ip").cast("long") / 100).cast("int"))
    path = str(tmp_path / "pages")
    IO.write_pages(reg_io._paged_hosts(spark, SF001), path, build=reg_io._host)
    back = IO.read_pages(spark, path)
    as_json = lambda df: sorted(r[0] for r in df.select(F.to_json(F.col("host").cast(FL.HOST))).collect())
    assert as_json(back) == as_json(hosts)
    files = IO.list_files(spark, path, ["json"]).collect()
    assert files and all(f.path.endswith(".json.gz") and f.ext == "json" for f in files)


def test_host_blocks_move_no_services(spark):
    """A query on the host blocks needs of the lineitems only that there are some."""
    plan = reg_flatten.prj15(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "p_name" not in plan and "s_name" not in plan
    flat, struct = reg_flatten.flat_fingerprints(spark, SF001), FL.flatten_hosts(reg_flatten.build_hosts(spark, SF001))
    assert flat.columns == struct.columns
    assert sorted(map(str, flat.collect())) == sorted(map(str, struct.collect()))
