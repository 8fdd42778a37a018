from datetime import datetime

from pyspark.sql import functions as F

from quarry.operators import orphans as O
from quarry.operators.skew import hot_keys, key_filter, skew_join

T = lambda m, d=1: datetime(2025, m, d)


def tables(spark, retrievals):
    q = spark.createDataFrame([("q1", T(2)), ("q1", T(5)), ("q2", T(6))], "q_id string, created_at timestamp_ntz")
    e = spark.createDataFrame([("eval_1",)], "q_id string")
    c = spark.createDataFrame([("1_c000001", T(3)), ("1_c000002", T(6)), ("1_c000003", T(1))], "chunk_id string, cached_at timestamp_ntz")
    t = spark.createDataFrame([("1_c3", T(4)), ("1_c0009", T(8))], "chunk_id string, deleted_at timestamp_ntz")
    r = spark.createDataFrame(retrievals, "ret_id long, q_id string, retrieved_chunk_ids array<string>, logged_at timestamp_ntz")
    return r, q, e, c, t


def found(spark, retrievals):
    return {(r.row_id, r.ref_field, r.ref_key, r.ref_state) for r in O.retrieval_orphans(*tables(spark, retrievals)).collect()}


def test_states(spark):
    got = found(spark, [(1, "q1", ["1_C01 ", "1_c2", "1_c0003", None, "1_c9", "x_c1"], T(5)), (2, "q2", None, T(5)), (3, "eval_1", [], T(1)), (4, None, ["1_c000003"], T(3)), (1, "q1", ["1_C01 ", "1_c2", "1_c0003", None, "1_c9", "x_c1"], T(5))])
    assert got == {(1, "retrieved_chunk_ids", "1_c2", "late"), (1, "retrieved_chunk_ids", "1_c0003", "deleted"), (1, "retrieved_chunk_ids", "x_c1", "missing"), (2, "q_id", "q2", "late")}


def test_empty_tables_and_unknown_time(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, "none", ["y_c1"], None)]) == {(1, "q_id", "none", "missing"), (1, "retrieved_chunk_ids", "y_c1", "missing")}


def test_hot_missing_key(spark):
    rows = [(i, "gone" if i % 3 else "q1", ["1_c000003"] if i % 2 else [], T(5)) for i in range(3000)]
    got = found(spark, rows)
    assert sum(x[1] == "q_id" for x in got) == 2000 and sum(x[3] == "deleted" for x in got) == 1500


def test_counts(spark):
    r = O.retrieval_orphans(*tables(spark, [(1, "no", ["a_c1", "a_c1 "], T(5)), (2, "no", [], T(6))]))
    got = {tuple(x) for x in O.orphan_counts(r, {"q_id": "questions", "retrieved_chunk_ids": "chunks"}).collect()}
    assert got == {("questions", "2025-05", "missing", 1, 1), ("questions", "2025-06", "missing", 1, 1), ("chunks", "2025-05", "missing", 2, 1)}


def test_canonical_chunk_keys(spark):
    rows = ["1_c000", "1_c0", "1_C0010 ", "a_c01_c002", "x", "_c", " 7_c5"]
    got = [r.k for r in spark.createDataFrame([(x,) for x in rows], "x string").select(O.chunk_key(F.col("x")).alias("k")).collect()]
    assert got == ["1_c0", "1_c0", "1_c10", "a_c01_c2", "x", "_c", "7_c5"]


def test_skew_join_equals_join(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    facts = spark.createDataFrame([(7, "a"), (13, "b"), (5000, "c")], "k long, v string")
    hot = hot_keys(rows, ["k"])
    assert hot.count() <= 64
    assert sorted(map(tuple, skew_join(rows, facts, ["k"], hot).collect())) == sorted(map(tuple, rows.join(facts, "k").collect()))


def test_hot_live_key_meets_no_orphan_and_is_dropped_before_the_shuffle(spark):
    rows = [(i, "q1" if i % 3 else f"gone{i % 50}", ["1_c000003" if i % 2 else "1_c1"], T(5)) for i in range(6000)]
    got = found(spark, rows)
    assert sum(x[1] == "q_id" for x in got) == 2000 and sum(x[3] == "deleted" for x in got) == 3000


def test_key_filter_loses_no_wanted_key(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("k"), F.lit("x").alias("f"))
    wanted = spark.range(0, 20000, 20).select(F.col("id").alias("k"), F.lit("x").alias("f"))
    left = key_filter(rows, wanted, ["f", "k"])
    assert left.columns == rows.columns
    assert left.join(wanted, ["f", "k"]).count() == rows.join(wanted, ["f", "k"]).count() and left.count() < 4000
    assert key_filter(rows, wanted.limit(0), ["f", "k"]).count() == 0 and key_filter(rows.limit(0), wanted, ["f", "k"]).count() == 0
