"""Every core query against its SQL in DuckDB, on the smallest tables."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from parity import connect, norm  # noqa: E402

from quarry.plans import registry  # noqa: E402


#: Queries that SQL can't express, and the tests of what they do.
BY_BRUTE_FORCE = {
    "tx_recursive_chunks": ("test_text.py", "test_recursive_ranges_cover"), "tx_sentence_chunks": ("test_text.py", "test_sentence_packing_carries_overlap"), "rt_complementary": ("test_retrieval.py", "test_complementary_prefers_new_pages"), "dd_greedy_questions": ("test_operators.py", "test_greedy_unlike"),
    "nl_pair_scores": ("test_operators.py", "test_scored_asks_once_and_keeps_known"), "mx_fuzzy_alignment": ("test_alignment.py", "test_nearest_window_equals_trying_all"), "gr_sampled_pairs": ("test_operators.py", "test_sampled_pairs"), "gr_kmeans_groups": ("test_retrieval.py", "test_vector_clusters_find_blobs"), "gr_vector_groups": ("test_retrieval.py", "test_vector_groups_equal_brute_force"),
    "dd_yield": ("test_chains.py", "test_yield_equals_the_whole_sequence"),
}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql = registry.sql().get(name)
    if not sql:  # a brute-force test of its operator stands in, and it must find something
        file, test = BY_BRUTE_FORCE[name]
        assert f"def {test}(" in (Path(__file__).parent / file).read_text() and got
        return
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry_has_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "ev_leaderboard" in entry.queries()
