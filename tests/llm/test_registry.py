import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_every_problem_has_its_queries():
    from quarry.llm import registry

    names = set(registry.queries())
    assert {f"p{n}_found" for n in (1, 3, 4, 5, 6, 8, 9)} <= names and "p7_containers" in names
    assert set(registry.sql()) <= names


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "quarry.llm" not in p.read_text()


def test_found_columns(spark, data):
    from quarry.llm import registry

    want = {"p1_found": ["chunk_id"], "p3_found": ["chunk_id", "noise"], "p5_found": ["q_id_a", "q_id_b"], "p6_found": ["src_table", "row_id", "residue"], "p8_found": ["doc_id", "item_id"]}
    for n, cols in want.items():
        df = registry.queries()[n](spark, data)
        assert df.columns == cols
        rows = [tuple(r) for r in df.collect()]
        assert rows and len(rows) == len(set(rows))


def test_core_without_the_subpackage():
    code = "import sys; sys.modules['quarry.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_core_where_a_part_cannot_be_imported():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries() and len(e.queries()) > 150"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
