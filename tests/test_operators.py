from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.operators import dag
from quarry.operators import dedup as D
from quarry.operators import graph as G
from quarry.operators import verify as Y
from quarry.sources import files as S
from quarry.streaming import events as E


@pytest.mark.parametrize("budget,want", [(50, {"big": 45, "small": 5}), (200, {"big": 90, "small": 10}), (0, {"big": 0, "small": 0})])
def test_allocate(spark, budget, want):
    c = spark.createDataFrame([("big", 90), ("small", 10)], "doc string, n long")
    assert {r.doc: r.alloc for r in D.allocate(c, "doc", "n", budget).collect()} == want


def test_allocate_keeps_the_sum(spark):
    c = spark.createDataFrame([(str(i), i % 7 + 1) for i in range(23)], "doc string, n long")
    got = D.allocate(c, "doc", "n", 40).collect()
    assert sum(r.alloc for r in got) == 40 and all(r.alloc <= r.n for r in got)


def test_greedy_unlike(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y"], 3), (1, "b", ["x", "y"], 5), (1, "c", ["z"], 1), (2, "d", [], 1), (2, "e", [], 1)], "doc_id long, q string, t array<string>, n int")
    assert {r.q: r.kept for r in D.greedy_unlike(rows, "doc_id", "q", "t", "n").collect()} == {"a": False, "b": True, "c": True, "d": True, "e": True}


def test_leave_one_out(spark):
    g = spark.createDataFrame([("q", ["dry weld", "gas"], "dry gas"), ("r", ["one"], "one")], "q string, items array<string>, answer string")
    rows = Y.leave_one_out(g)
    assert {(r.left_out, r.premise) for r in rows.collect()} == {(0, "gas"), (1, "dry weld")}
    got = Y.necessity(rows.withColumn("score", Y.support(F.col("premise"), F.col("answer"))), "q", 0.6).first()
    assert (got.n, got.n_necessary, got.necessity) == (2, 2, 1.0)


def test_scored_asks_once_and_keeps_known(spark):
    p = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "d"), (None, "d")], "premise string, hypothesis string")
    known = spark.createDataFrame([("c", "d", 0.9)], "premise string, hypothesis string, score double")
    got = {(r.premise, r.hypothesis): r.score for r in Y.scored(p, lambda rows: [0.5] * len(rows), known).collect()}
    assert got == {("a", "b"): 0.5, ("c", "d"): 0.9}


def test_bridges_need_two_pages_and_no_restatement(spark):
    rows = [("d_F1", 1, 13, 1, "The shielding gas protects the weld pool."), ("d_F2", 1, 14, 2, "Argon serves as shielding gas in most shops."), ("d_F3", 1, 14, 3, "The shielding gas protects the weld pool."), ("e_F1", 2, 13, 1, "A shielding gas is costly.")]
    f = spark.createDataFrame(rows, "fact_id string, doc_id long, page_start int, order_idx int, text string")
    pairs = {(r.fact_a, r.fact_b): r.norm for r in G.bridge_pairs(f).collect()}
    assert ("d_F1", "d_F2") in pairs and ("d_F1", "d_F3") not in pairs and all(a[0] == b[0] for a, b in pairs)


def test_paths_are_simple(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.9), ("b", "c", 0.4)], "fact_a string, fact_b string, score double")
    assert [r.path for r in G.paths(e).collect()] == [["a", "b", "c"]]


def test_dag(spark, tmp_path):
    assert dag.order(dag.STAGES)[0] == "profile" and dag.order(dag.STAGES)[-1] == "report"
    with pytest.raises(ValueError):
        dag.order({"a": ("b",), "b": ("a",)})
    with pytest.raises(ValueError):
        dag.order({"a": ("x",)})
    down = {(r.stage, r.dependent) for r in dag.downstream(spark, {"a": (), "b": ("a",), "c": ("b",)}).collect()}
    assert down == {("a", "b"), ("b", "c"), ("a", "c")}

    def bad(s, t):
        raise RuntimeError

    stages = {"a": (), "b": ("a",), "c": ("b",), "d": ("a",)}
    build = {"a": lambda s, t: s.range(3), "b": bad, "c": bad, "d": lambda s, t: t["a"].filter("id > 0")}
    assert dag.execute(spark, stages, build, str(tmp_path)) == {"a": "completed", "b": "failed", "c": "skipped", "d": "completed"}
    assert dag.execute(spark, {"a": ()}, {"a": bad}, str(tmp_path), frozenset({"a"})) == {"a": "completed"}


@pytest.mark.parametrize("suffix", ["jsonl", "parquet", "orc", "csv"])
def test_files_round_trip(spark, tmp_path, suffix):
    d = spark.createDataFrame([("q1", "Wie?\nSo", True), ("q2", None, None)], S.ANSWER)
    path = f"{tmp_path}/a.{suffix}"
    S.write(d if suffix != "csv" else d.withColumn("predicted_answer", F.regexp_replace("predicted_answer", "\n", " ")), path)
    S.write(d.limit(0), path, "append")
    got = sorted((r.q_id, r.abstained) for r in S.read(spark, path, S.ANSWER).collect())
    assert got == [("q1", True), ("q2", None)]


def test_malformed_lines_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"q_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        S.read(spark, f"{tmp_path}/x.jsonl", S.ANSWER).collect()
    with pytest.raises(ValueError):
        S.read(spark, f"{tmp_path}/x.jsonl")


def test_artifacts_are_written_once(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert S.write_artifact(d, str(tmp_path), "facts") == S.write_artifact(d.orderBy(F.desc("i")), str(tmp_path), "facts")


def test_html_blocks(spark):
    d = spark.createDataFrame([(1, "<h1>Title</h1><p>One <b>two</b></p><script>x()</script>"), (2, None)], "page_id long, html string")
    assert [(r.block_id, r.text, r.char_start) for r in S.html_blocks(d).collect()] == [(0, "Title", 0), (1, "One two", 7)]


def events(spark):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=37 * i), i % 3, ("view", "error", "click")[i % 2], float(i), '{"k": %d}' % i) for i in range(60)]
    return spark.createDataFrame(rows, E.EVENT)


@pytest.fixture()
def stream(spark, tmp_path):
    e = events(spark)
    for k in range(3):
        e.filter((F.col("event_id") >= 20 * k - (k > 0)) & (F.col("event_id") < 20 * (k + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return E.read_stream(spark, f"{tmp_path}/in")


def test_stream_fold_equals_batch(spark, stream):
    q = E.stream_fold(stream).writeStream.outputMode("update").format("memory").queryName("fold").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("fold").groupBy("run").agg(F.max_by(F.struct("*"), "n_events").alias("x")).select("x.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, E.fold(E.log(events(spark))).collect()))


def test_stream_windows_equal_batch(spark, stream):
    q = E.stream_tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumble").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumble").collect())) == sorted(map(tuple, E.tumbling(E.log(events(spark))).collect()))


def test_stream_upsert_equals_batch(spark, stream, tmp_path):
    E.upsert_latest(stream, f"{tmp_path}/state", f"{tmp_path}/ck").awaitTermination(120)
    newest = max(int(p.name[1:]) for p in (tmp_path / "state").iterdir())
    got = spark.read.parquet(f"{tmp_path}/state/v{newest}")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.latest(E.log(events(spark))).collect()))


def test_breach_and_sessions(spark):
    l = E.log(events(spark))
    b = E.breach(l, 100).collect()
    assert len(b) == 3 and all(r.spent > 100 for r in b)
    assert E.breach(l, 1e9).count() == 0 and E.sessions(l, "1 day").count() == 3


def test_sampled_pairs(spark, data):
    from quarry.functions import views as V
    from quarry.operators import graph as G
    from quarry.plans import registry

    pairs = G.neighbour_pairs(V.facts(spark.read.parquet(f"{data}/chunks.parquet"))).filter("shared >= 0.2").collect()
    used, want = set(), set()
    for r in sorted(pairs, key=lambda r: (r.doc_id, r.fact_a, r.distance)):
        if r.fact_a not in used and r.fact_b not in used:
            used |= {r.fact_a, r.fact_b}
            want.add((r.doc_id, r.fact_a, r.fact_b))
    assert {tuple(r) for r in registry.queries()["gr_sampled_pairs"](spark, data).collect()} == want


def test_greedy_chains_follow_the_best_next_fact(spark):
    from quarry.operators import graph as G

    p = spark.createDataFrame([("a", "b", 0.1, 1), ("a", "c", 0.3, 2), ("c", "d", 0.2, 1), ("c", "e", 0.2, 2), ("d", "e", 0.1, 1), ("e", "f", 0.1, 1)], "fact_a string, fact_b string, score double, distance int")
    got = {r.start: r.path for r in G.greedy_chains(p).collect()}
    assert got == {"a": ["a", "c", "d", "e"], "c": ["c", "d", "e", "f"], "d": ["d", "e", "f"], "e": ["e", "f"]}


def test_clusters_take_the_nearest_in_band_once(spark):
    from quarry.operators import graph as G

    pairs = spark.createDataFrame([("a", "x", 1, 1, 1, 0.5), ("w", "a", 1, 1, 1, 0.5), ("a", "y", 2, 1, 1, 0.9), ("b", "x", 1, 1, 1, 0.3), ("b", "z", 2, 1, 1, 0.3), ("c", "q", 1, 1, 2, 0.5)], "fact_a string, fact_b string, distance int, page_a int, page_b int, shared double")
    near = G.nearest_in_band(pairs)
    assert {r.fact: r.near for r in near.collect()}["a"] == ["w", "x"]
    bridges = spark.createDataFrame([("a", "b"), ("b", "x"), ("c", "a")], "fact_a string, fact_b string")
    got = {(r.fact_a, r.fact_b): (r.fact_a2, r.fact_b2, r.kind) for r in G.clusters(bridges, near).collect()}
    assert got == {("a", "b"): ("w", "x", "cluster_2plus2"), ("b", "x"): ("z", "a", "cluster_2plus2"), ("c", "a"): (None, None, "pair")}


def test_single_chains_take_a_page_each_before_they_fill(spark):
    from quarry.operators import graph as G

    rows = [(1, f"F{i}", f"The pump number {i} means a device that moves water upward.", p) for i, p in enumerate([1, 1, 1, 2, 3])] + [(1, "F8", "For example, such as a pump that moves water.", 4), (1, "F9", "Too short.", 5)]
    f = spark.createDataFrame(rows, "doc_id long, fact_id string, text string, page_start int")
    got = [r.fact_id for r in G.single_chains(f, F.lit(1), limit=4).orderBy("place").collect()]
    assert got == ["F0", "F3", "F4", "F1"]
