import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import predicates as P
from quarry.functions import text as T
from quarry.operators import chunking as C


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [("The ISO 15607 spec (v2)!", ["the", "iso", "15607", "spec", "v2"]), ("", []), (None, None)])
def test_tokens(spark, text, want):
    assert one(spark, text, T.tokens) == want


def test_bridge_tokens_fold_plurals(spark):
    assert one(spark, "Specifications of glass/gases", T.bridge_tokens) == ["specification", "of", "glass", "gase"]


def test_clean_and_keys(spark):
    assert one(spark, "The weld-\ning  speed­\n\n\n\nis • low ", T.clean) == "The welding speed\n\nis - low"
    assert one(spark, "doc_c0007", T.chunk_key) == "doc_c7" and one(spark, "doc_c000", T.chunk_key) == "doc_c0"
    assert one(spark, "What?  IS—it", T.dedup_key) == "what is it"


def test_windows(spark):
    got = one(spark, "a b c d e", lambda c: F.transform(T.windows(T.extract_all(c, r"\S+"), 3, 2), lambda w: F.array_join(w["items"], "")))
    assert got == ["abc", "cde", "e"] and one(spark, "", lambda c: F.size(T.windows(T.extract_all(c, r"\S+"), 3, 2))) == 0


def test_containment_definitions_differ(spark):
    d = spark.createDataFrame([(["a", "a", "b"], ["a"])], "u array<string>, h array<string>")
    r = d.select(T.share_held(F.col("u"), F.col("h")).alias("m"), T.share_held_set(F.col("u"), F.col("h")).alias("s"), T.jaccard(F.col("u"), F.array()).alias("j")).first()
    assert (round(r.m, 4), r.s, r.j) == (0.6667, 0.5, 0.0)


@pytest.mark.parametrize("text,want", [("You must not weld.", "constraint"), ("It shall be dry.", "rule"), ("Unless wet, weld.", "exception"), ("Weld when dry.", "condition"), ("Rust.", "definition")])
def test_roles(spark, text, want):
    assert one(spark, text, P.role) == want


def test_structural_quality(spark):
    assert one(spark, "(cid:12) x y z", P.structural_quality) == 0.0
    assert one(spark, "The weld shall not exceed 5 mm in any of the ten tested pieces.", P.structural_quality) == 1.0


@pytest.mark.parametrize("pages,order,want", [([34, 34], [310, 312], "single"), ([38, 38], [10, 50], "same_page"), ([30, 31], [1, 2], "cross_near"), ([11, 45], [1, 2], "cross_strict"), ([1, 2, 3], [1, 2, 3], "deep")])
def test_hop_class(spark, pages, order, want):
    d = spark.createDataFrame([(pages, order)], "p array<int>, o array<int>")
    assert d.select(P.hop_class(F.col("p"), F.col("o")).alias("y")).first().y == want


def test_reject_reasons(spark):
    assert one(spark, "References", P.strict_reason) == "reference_heading"
    assert one(spark, "  ", P.strict_reason) == "empty_text" and one(spark, None, P.strict_reason) == "empty_text"
    assert one(spark, "4 Technical content of things", P.relaxed_reason) == "bare_numbered_heading"
    assert one(spark, "Heating rates: ....... and more words here", P.relaxed_reason) == "table_artifact"
    assert one(spark, "The root pass is inspected before the coating has cured.", P.relaxed_reason) is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40))
def test_pack_units_never_splits_or_overfills(sizes):
    groups = C.pack_units(sizes, 50)
    assert groups == sorted(groups) and len(groups) == len(sizes)
    for g in set(groups):
        own = [n for n, x in zip(sizes, groups) if x == g]
        assert sum(own) <= 50 or len(own) == 1


def test_pack_lines_equals_fold(spark):
    rows = [(1, i, "x" * n, i // 3) for i, n in enumerate([30, 30, 60, 5, 5, 5, 200, 1])] + [(2, 0, "", 0)]
    d = spark.createDataFrame(rows, "doc_id long, line_idx int, text string, page_no int").withColumn("n_chars", F.length("text"))
    got = [(r.doc_id, r.idx, r.n_units, r.n_chars) for r in C.pack_lines(d, 64).orderBy("doc_id", "idx").collect()]
    want, sizes = [], [30, 30, 60, 5, 5, 5, 200, 1]
    g = C.pack_units(sizes, 64)
    want = [(1, k, g.count(k), sum(n for n, x in zip(sizes, g) if x == k)) for k in sorted(set(g))] + [(2, 0, 1, 0)]
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=300), st.integers(10, 60), st.integers(0, 9))
def test_recursive_ranges_cover(text, size, overlap):
    r = C.split_recursively(text, size, overlap)
    assert all(0 < b - a <= size for a, b in r)
    assert not text or (r[0][0] == 0 and r[-1][1] == len(text) and all(c <= b for (_, b), (c, _) in zip(r, r[1:])))


def test_sentence_packing_carries_overlap():
    got = C.pack_sentences(["aaaa.", "bbbb.", "cccc.", "d" * 25], 12, 5)
    assert all(len(c) <= 12 for c in got) and got[0] == "aaaa. bbbb." and got[1].startswith("bbbb.")


def test_empty_documents(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert C.split_documents(d, "recursive").count() == 0 and C.sliding(d).count() == 0 and C.split_sections(d, "clause").count() == 0
