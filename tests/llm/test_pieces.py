from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import pieces as P


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.; \né́", max_size=400), st.integers(1, 50), st.integers(0, 60))
def test_pieces_are_small_and_make_up_the_text(text, limit, overlap):
    got = P.split(text, limit, overlap)
    assert all(len(p) <= limit and p == text[s:e] for _, s, _, e, p in got)
    assert "".join(text[b:e] for _, _, b, e, _ in got) == text
    assert all(s <= b and b - s <= max(overlap, 0) for _, s, b, _, _ in got)
    assert len(text) > limit or len(got) == 1


def test_cuts_at_the_strongest_boundary_near_the_middle():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven twelve."
    assert [p for *_, p in P.split(text, 40, 0)] == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven twelve."]
    assert [p for *_, p in P.split("3.1 Scope of it all here\n3.2 More of the same", 30, 0)][1].startswith("3.2")


def test_overlap_starts_at_a_word():
    got = P.split("alpha beta gamma delta epsilon zeta eta theta", 20, 8)
    assert all(not p.startswith((" ", "lpha", "eta ga")) for *_, p in got) and got[1][1] < got[1][2]


def test_giant_text_without_boundary():
    got = P.split("x" * 100_000, 700, 100)
    assert all(len(p) <= 700 for *_, p in got) and got[-1][3] == 100_000


def test_the_number_of_pieces_grows_with_the_overlap():
    n = [len(P.split("word " * 400, 100, o)) for o in (0, 50, 90, 98, 99, 100, 5000)]
    assert n == sorted(n) and n[-1] == n[-2] == n[-3]


def test_operator_handles_nulls_ties_and_clashing_names(spark):
    rows = [("a", "x y " * 30, 20, 4), ("a", "x y " * 30, 20, 4), ("b", None, 20, 4), ("c", "", 5, 1), ("d", "long enough text", None, 1), ("e", "long enough text", 0, 1), ("f", "long enough text", 8, None), ("g", "short", 8, 2)]
    d = spark.createDataFrame([(*r, "mine") for r in rows], "chunk_id string, text string, chunk_size int, overlap int, piece string")
    got = P.split_oversized(d).collect()
    assert {r.chunk_id for r in got} == {"a", "f"} and all(r.piece != "mine" for r in got)
    assert P.split_oversized(d.limit(0)).count() == 0


def test_found_equals_definition(spark, data):
    import duckdb

    from quarry.llm import pieces_queries as Q

    con = duckdb.connect()
    for t in ("chunks", "chunk_results"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert {r.chunk_id for r in Q.p1_found(spark, data).collect()} == {r[0] for r in con.execute(Q.SQL["p1_found"]).fetchall()}
