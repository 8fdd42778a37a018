"""Chain signals against plain Python, reasons in their order, and the yield of a document against a state machine."""

import random

from pyspark.sql import functions as F

from quarry.operators import chains as C

FACTS = [
    (1, "F1", "c1", "Preheating means that the plate is warmed before the first pass is laid.", 3), (1, "F2", "c1", "If the plate is thick, preheating is needed before welding the plate.", 4), (1, "F3", "c2", "The welder must record the preheating of each plate.", 9),
    (1, "F4", "c3", "x = 3 and y = 4, sum ∑ x", 70), (1, "F5", "c4", "This can be skipped.", None), (1, "F6", "c2", "The  welder must record the preheating of each plate.", 9),
]


def features(spark):
    return C.fact_features(spark.createDataFrame(FACTS, "doc_id int, fact_id string, chunk_id string, text string, page_start int"))


def chain(spark, ids, edges=None):
    d = features(spark).filter(F.col("fact_id").isin(ids)).agg(F.collect_list("f").alias("fs"))

    def one(i):
        return F.element_at(F.filter("fs", lambda f: f["fact_id"] == F.lit(i)), 1)

    pick = F.array(*(one(i) for i in ids))
    e = edges if edges is not None else [("condition", True, 0.5, 0.4, 0.3, 0.0)] * (len(ids) - 1)
    kind = "array<struct<type:string,typed:boolean,confidence:double,margin:double,contribution:double,action:double>>"
    return d.select(pick.alias("facts"), F.lit(60.0).alias("median")).crossJoin(spark.createDataFrame([(e,)], f"edges {kind}"))


def test_signals_of_a_typed_pair(spark):
    r = C.score(chain(spark, ["F1", "F2"])).first()
    assert r.length == 1 and r.fragment == 1 and r.role_variety == 1 and r.category == "typed_mh"
    assert (r.page_compactness, r.typed_edge_confidence, r.edge_joint_only_margin, r.answer_contribution_score, r.relation_type_strength) == (1 - 1 / 40, 0.5, 0.4, 0.3, 0.7)
    assert r.source_text_quality == 1 and r.multi_hop_questionability == 1.0
    pass1 = sum(C.WEIGHTS[k] * r[k] for k in C.WEIGHTS) / sum(C.WEIGHTS.values())
    assert abs(r.pass1 - pass1) < 1e-5


def test_missing_edges_single_facts_and_empty_chains(spark):
    r = C.score(chain(spark, ["F1", "F2"], [])).first()
    assert r.category == "untyped_mh" and r.relation_type_strength == r.typed_edge_confidence == r.edge_joint_only_margin == 0
    r = C.score(chain(spark, ["F4"], [])).first()
    assert r.category == "fb" and r.source_text_quality < 0.6 and r.multi_hop_questionability == 0
    r = C.score(chain(spark, ["F1"], []).withColumn("facts", F.slice("facts", 1, 0))).first()
    assert r.pass1 == 0
    r = C.score(chain(spark, ["F1", "F2", "F3"], [("condition", True, 0.5, 0.5, 0.5, 0.0), ("rule", False, 0.9, 0.1, 0.1, 0.0)])).first()
    assert r.typed_edge_confidence == 0.25 and abs(r.edge_joint_only_margin - 0.3) < 1e-6 and r.category == "untyped_mh"


def test_second_pass_is_bounded(spark):
    s = spark.createDataFrame([(1, i, 0.9 - i / 100, "typed_mh") for i in range(30)] + [(2, 0, 0.39, "fb"), (2, 1, 0.39, "typed_mh")], "doc int, i int, pass1 double, category string")
    got = C.second_pass(s, F.lit(0.0), ["doc"], ["i"], 8).collect()
    assert sorted(r.i for r in got if r.reranked) == list(range(12))
    assert all(abs(r.final - r.pass1 * 0.85) < 1e-6 for r in got if r.reranked)
    assert [r.kept for r in sorted(got, key=lambda r: (r.doc, r.i)) if r.doc == 2] == [True, False]


def test_reasons(spark):
    def why(ids, **options):
        return chain(spark, ids).select(C.filter_reason(F.col("facts"), **options).alias("r")).first().r

    assert why(["F1", "F2"]) is None
    assert why(["F1"]) == "question_mode_multihop" and why(["F1", "F2"], mode="singlehop") == "question_mode_singlehop" and why(["F1", "F2"], hops=(3, 4)) == "depth_out_of_range"
    assert why(["F3", "F6"]) == "duplicate_fact_text" and why(["F1", "F2"], chunks=2) == "insufficient_distinct_chunks" and why(["F1", "F3"], roles=3) == "insufficient_distinct_roles"
    assert why(["F1", "F3"], pages=3) == "insufficient_distinct_pages" and why(["F1", "F3"], char_gap=10) == "insufficient_char_gap"
    assert why(["F1", "F4"]) == "chain_quality:source_gap_too_large" and why(["F1", "F5"], gate=False) == "deictic_opener_unresolved"
    assert why(["F1", "F2"], self_contained=0.7) is None and why(["F1", "F2"], self_contained=0.7, unknown_too=True) == "c3_unknown_self_containment"


def test_yield_equals_the_whole_sequence(spark):
    r = random.Random(4)
    rows = [(doc, r.choice(["typed_mh", "untyped_mh", "fb"]) if doc < 5 else "fb", r.random() < 0.5, i) for doc in range(6) for i in range(120)]
    d = spark.createDataFrame(rows, "doc int, category string, good boolean, i int")
    for target, most in ((5, 20), (10, 60), (1, 3)):
        got = {(x.doc, x.i) for x in C.yields(d, "doc", target, most, ["i"]).collect()}
        want = set()
        for doc in range(6):
            mine = sorted((x for x in rows if x[0] == doc), key=lambda x: x[3])
            want |= {(doc, x[3]) for x, go in zip(mine, C.attempts([(x[1], x[2]) for x in mine], target, most)) if go}
        assert got == want
    assert C.yields(d.limit(0), "doc", 5, 20, ["i"]).count() == 0


def test_attempts():
    assert C.caps(10) == {"typed_mh": (0, 0), "untyped_mh": (3, 1), "fb": (12, 4)}
    assert C.attempts([("fb", True)] * 6, 10, 99) == [True] * 4 + [False] * 2
    assert C.attempts([("untyped_mh", False)] * 5, 10, 99) == [True] * 3 + [False] * 2
    assert C.attempts([("typed_mh", True)] * 12, 10, 99) == [True] * 10 + [False] * 2
    assert C.attempts([("typed_mh", False)] * 12, 10, 7) == [True] * 7 + [False] * 5
