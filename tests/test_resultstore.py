"""The versioned result store and its cascade (RT4)."""

import pytest
from pyspark.sql import functions as F

from fpengine.operators.resultstore import ResultStore, cascade, current_rows, table_version


def _queries(spark, values):
    df = spark.createDataFrame(list(values.items()), "query_id long, x long")
    return df.withColumn("h_a", F.xxhash64("x")).withColumn("h_b", F.xxhash64("h_a", F.lit("b")))


def _stages(run, seen=None):
    def first(todo, rows):
        if seen is not None:
            seen.append(("a", sorted(r.query_id for r in todo.collect())))
        # query 3 has no result; query 4 has two
        return todo.where("query_id <> 3").select("query_id", F.explode(F.when(F.col("query_id") == 4, F.array(F.lit(0), F.lit(1)))
                                                  .otherwise(F.array(F.lit(0)))).alias("i"), (F.col("x") * 10).alias("v"), F.lit(run).alias("run"))

    def second(todo, rows):
        if seen is not None:
            seen.append(("b", sorted(r.query_id for r in todo.collect())))
        return rows("a").groupBy("query_id").agg(F.sum("v").alias("s")).withColumn("run", F.lit(run))
    return [("a", "h_a", first), ("b", "h_b", second)]


def test_second_run_computes_nothing_and_changes_alone_are_recomputed(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    values = {i: i for i in range(1, 9)}
    assert cascade(store, _queries(spark, values), _stages(1)) == {"a": 8, "b": 8}
    assert cascade(store, _queries(spark, values), _stages(2)) == {"a": 0, "b": 0}
    values = {**values, 5: 50, 9: 9}
    seen = []
    q = _queries(spark, values)
    assert cascade(store, q, _stages(3, seen)) == {"a": 2, "b": 2}
    assert seen == [("a", [5, 9]), ("b", [5, 9])]
    got = sorted((r.query_id, r.s, r.run) for r in current_rows(store, q, _stages(0), "b").collect())
    assert got == [(1, 10, 1), (2, 20, 1), (4, 80, 1), (5, 500, 3), (6, 60, 1), (7, 70, 1), (8, 80, 1), (9, 90, 3)]
    # the former input is found again without work
    assert cascade(store, _queries(spark, {5: 5}), _stages(4)) == {"a": 0, "b": 0}


def test_unpublished_batches_do_not_exist_and_double_work_counts_once(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    q = _queries(spark, {1: 1, 2: 2})

    def dies(todo, rows):
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        cascade(store, q, [_stages(1)[0], ("b", "h_b", dies)])
    todo = q.withColumn("input_hash", F.col("h_b"))
    todo.select("query_id", "input_hash").write.parquet(f"{tmp_path}/b/done/batch=b0")  # written, not published
    assert cascade(store, q, _stages(2)) == {"a": 0, "b": 2}
    again = todo.select("query_id", F.lit(99).cast("long").alias("s"), F.lit(9).alias("run"))
    store.publish("b", todo, again)
    assert sorted(r.s for r in current_rows(store, q, _stages(0), "b").collect()) == [10, 20]


def test_table_version(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 3)
    assert table_version(df) == table_version(df.repartition(7))
    assert table_version(df) != table_version(df.withColumn("v", F.when(F.col("id") == 5, 1).otherwise(F.col("v"))))
    assert table_version(df.where("false")) == "0-0-0"
