"""The twenty pair checks and the reject rules on sentences whose verdict is known."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import pair_checks as C
from quarry.functions import predicates as P
from quarry.functions.reasons import reason_counts

SOUND = ("Why is the nitrogen purge of Kelvar pipes preferred over an argon purge?", "It is preferred because nitrogen keeps the root of the weld free of oxide at a lower cost.", ["Nitrogen keeps the root of the weld free of oxide while it costs less than argon."])
CASES = [
    (SOUND, set()),
    (("Why is this distribution better than the uniform distribution?", SOUND[1], ["One advantage of the curve is that its values are easily gener-"]), {"q1_deictic", "q4_generic", "q7_fragment"}),
    (("According to the facts, why are sample updates useful to planners?", SOUND[1], SOUND[2]), {"q4_generic"}),
    (("Which pressure does Kelvar need?", "It needs 45 bar.", ["Kelvar pipes need a purge pressure of 12 bar at any time."]), {"q2_short", "q6_number"}),
    ((SOUND[0], "We need to answer the question, and the facts are that nitrogen is cheap.", SOUND[2]), {"q8_leak"}),
    ((SOUND[0], SOUND[1], ["Technical Report 72-0164 by the Kelvar Laboratories of Bedford, Massachusetts."]), {"q9_weak_evidence"}),
    ((SOUND[0], "What does the purge of the Kelvar pipes protect in the root of the weld?", SOUND[2]), {"q10_question"}),
    ((SOUND[0], "The reason is given in chapter 4.3 of the handbook on nitrogen purges of pipes.", SOUND[2]), {"q6_number", "q11_heading"}),
    ((SOUND[0], "Insufficient information is available to say why nitrogen purges are preferred.", SOUND[2]), {"q12_abstains"}),
    ((SOUND[0], "The purge of the Kelvar pipes can now be explained by all that was said before.", SOUND[2]), {"q13_tautology"}),
    (("How does the Kelvar planner update its values?", "By sampled returns.", SOUND[2]), {"q2_short", "q14_short_fragment"}),
    (("Which page ranges list the nitrogen purge of Kelvar pipes?", SOUND[1], SOUND[2]), {"q15_artifact"}),
    (("Why would Kelvar prefer nitrogen? Output exactly one question", SOUND[1], SOUND[2]), {"q16_prompt"}),
    (("Which two gases does the Kelvar handbook allow for purging pipes?", "The handbook allows nitrogen for each purging of its pipes, nothing else", SOUND[2]), {"q17_two"}),
    (("How many purges does Kelvar require for pipes?", "Kelvar requires several purges for pipes until no oxide remains.", SOUND[2]), {"q18_count"}),
    (("Why does Kelvar refer to section ? for purging?", SOUND[1], SOUND[2]), {"q19_placeholder"}),
    (("Why is nitrogen the technique described by Kelvar?", SOUND[1], SOUND[2]), {"q20_phrase"}),
    ((SOUND[0], SOUND[1], []), set()),
]


def test_checks_fire_where_they_should_and_nowhere_else(spark):
    rows = [(i, q, a, [{"text": t, "chunk_id": "7_c0010", "doc_id": 7} for t in f]) for i, ((q, a, f), _) in enumerate(CASES)]
    d = spark.createDataFrame(rows, "i int, question string, answer string, facts array<struct<text:string,chunk_id:string,doc_id:bigint>>")
    for r in C.checked(d).collect():
        fired = {k for k in C.WEIGHTS if r[k]}
        assert fired == CASES[r.i][1], (CASES[r.i][0], fired)
        assert (r.quality == 0) == bool(fired & set(C.HARD)) and (fired or r.quality == 1)


def test_evidence_from_many_places_and_without_chunk(spark):
    d = spark.createDataFrame(
        [(1, [("Nitrogen keeps the root of the weld free.", "7_c0001", 7), ("Argon costs more than nitrogen in any case.", "7_c0009", 7)]), (2, [("Nitrogen keeps the root of the weld free.", "", 7)]), (3, None)],
        "i int, facts array<struct<text:string,chunk_id:string,doc_id:bigint>>",
    ).withColumns({"question": F.lit(None).cast("string"), "answer": F.lit(None).cast("string")})
    got = {r.i: r for r in C.checked(d).collect()}
    assert got[1].q5_scattered and not got[1].q7_fragment and got[2].q7_fragment and not got[2].q5_scattered
    assert got[3].quality == 0 and got[3].q14_short_fragment


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Figure 3.2: Layout of the purge line.", "caption_or_heading"), ("Exercises 12", "source_task_heading"), ("Exercise 3.5 Plan a purge for a maze of pipes.", "source_task_prompt"), ("212CHAPTER 8. PURGING OF PIPES", "caption_or_heading"),
        ("Repeat for each step and take action. Figure 6.12: The update.", "embedded_caption_fragment"), ("Repeat (for each purge): take action A and observe the result.", "algorithm_listing_fragment"), ("ROOT WELD PURGE keeps oxide away from the seam", "heading_prefix_fragment"),
        ("Barto and Duﬀ(1994) discussed purges in small pipes.", "named_citation_context"), ("Reprinted from Peng and Williams (1993).", "source_figure_attribution"), ("The method described in the previous section needs argon.", "unresolved_source_reference"),
        ("The backup diagram for the purge shows its structure.", "visual_only_fact"), ("See www.kelvar.example for the purge of pipes.", "front_matter_artifact"), ("The author served as program and general chair twice.", "author_bio"),
        ("Technical Report 72-0164 of the laboratories, pp. 10-12.", "bibliography_or_citation"), ("The purge is treated on 10-12.", "page_range_or_locator"), ("The purge is described in section 4.2.1", "dangling_section_reference"),
        ("Nitrogen keeps the root of the weld free of oxide.", None), ("Le débit du gaz reste réglé jusqu’à la fin.", None),
    ],
)
def test_strict_rules(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(P.strict_reason(F.col("t")).alias("r")).first().r == want


@pytest.mark.parametrize(
    ("text", "raw", "score", "front", "want"),
    [
        ("The following values shall be given for each purge line.", "Gas: x Flow: y Time: z Root: w", None, None, "table_artifact_raw"), ("Attention is drawn to the possibility that some elements are protected.", None, None, None, "iso_boilerplate"),
        ("We need to rewrite the passage for the reader of the pipes.", None, None, None, "cot_meta_leak"), ("The purge shall last for ten minutes in any pipe.", None, 0.7, None, "weak_self_containment"), ("The purge shall last for ten minutes in any pipe.", None, 0.8, None, None),
        ("The purge shall last for ten minutes in any pipe.", None, None, True, "front_matter_page"), ("4.2 The purge shall last for ten minutes in any pipe.", None, None, True, None), ("Table 4 Purge times of all pipes in minutes", None, None, None, "caption_or_heading"),
        ("pH values below 7.0 indicate acidity.", None, None, None, None), ("and correction is applicable; f) water", None, None, None, "fragment"), ("[12] Kelvar handbook of purging for pipes.", None, None, None, "numbered_reference"),
    ],
)
def test_relaxed_rules(spark, text, raw, score, front, want):
    d = spark.createDataFrame([(text, raw, score, front)], "t string, r string, s double, f boolean")
    assert d.select(P.relaxed_reason(F.col("t"), F.col("r"), F.col("s"), F.col("f")).alias("x")).first().x == want


def test_reasons_of_batches_equal_those_of_columns(spark):
    """The batched rules against the column rules: known verdicts, their mixtures, words in capitals."""
    known = [m.args[1] for f in (test_strict_rules, test_relaxed_rules) for m in f.pytestmark if m.name == "parametrize"]
    texts = [case[0] for cases in known for case in cases]
    rng = random.Random(3)
    pieces = [w for t in texts for w in t.split()] + ["ROOT", "A1-B", "ÉTÉ", "10-12", "ISO 9001,", "EN 10204,", "abc1", "...", "…", "•", "--", "a)", "is", "INDEX", ":", ""]
    texts += [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts += [" ".join(rng.choice(["ROOT", "WELD", "AB", "C", "x", "7", "the", "GAS-2"]) for _ in range(rng.randint(1, 9))) for _ in range(1000)] + [None, "", "  "]
    d = spark.createDataFrame([("line", t) for t in texts], "part string, text string")
    t = F.col("text")
    want = {(r.part, r.s, r.r): r.n for r in d.groupBy("part", F.coalesce(P.strict_reason(t), F.lit("kept")).alias("s"), F.coalesce(P.relaxed_reason(t), F.lit("kept")).alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {(r.part, r.strict, r.relaxed): r.n for r in reason_counts(d, "part", "text").collect()}
    assert got == want and len(want) > 30
