import pytest
from pyspark.sql import functions as F

from quarry.llm import scans as S
from quarry.llm.scans_queries import p3_text

SCHEMA = "chunk_id string, doc_id long, text string, source_path string, page_start int, page_end int"
PLAIN = "The pressure of the turbine after repair is measured against the post-weld limit at page one.\nEvery inspector records the pressure of the turbine before the coating has cured in the shop."


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"{d}_c{k}", d, PLAIN, f"library/x/plain_{d}.pdf", 1, 1) for d in range(100, 130) for k in range(2)]
    rows += [
        (f"7_c{k}", 7, f"The pressure of the turb-\nKelodarna Guide\nine after repair is measured.\n[{k + 3}]\nAll is well.", "library/x/kelodarna_7.pdf", k + 3, k + 3) for k in range(3)
    ]
    rows += [("8_c0", 8, "The inspector rec0rds the pressurc of the post-\nweld limit.", "library/x/name_8.pdf", 1, 1), ("8_c1", 8, "Clause 4.7 of 89 pages.\n209\n120\n385", None, None, None), ("9_c0", 9, None, None, 1, 1), ("9_c1", 9, "", None, 1, 1), ("8_c0", 8, "The inspector rec0rds the pressurc of the post-\nweld limit.", "library/x/name_8.pdf", 1, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_kinds(chunks):
    got = {}
    for r in S.Noise(chunks).kinds().collect():
        got.setdefault(r.chunk_id, set()).add(r.noise)
    seven = {"hyphen", "running_head", "page_number"}
    assert got == {"7_c0": seven, "7_c1": seven, "7_c2": seven, "8_c0": {"misread"}}


def test_corrections(chunks):
    words = S.vocabulary(chunks)
    assert {r.w: r.better for r in S.corrections(words, S.frequent(words)).collect()} == {"rec0rds": "records", "pressurc": "pressure"}


def test_empty_table(chunks):
    assert S.Noise(chunks.limit(0)).kinds().count() == 0


def test_hot_document(spark):
    rows = [(f"1_c{k}", 1, f"Some words here and\nKelodarna Guide\nmore words {k}.", "a/kelodarna_1.pdf", k, k) for k in range(500)] + [(f"2_c{k}", 2, "Other words.", None, 1, 1) for k in range(50)]
    got = S.Noise(spark.createDataFrame(rows, SCHEMA)).kinds()
    assert got.filter("noise = 'running_head'").count() == 500


def test_anagram_hashes_agree(spark):
    w = ["turbine", "überwacht", "a@b!", ""]
    got = [r.h for r in spark.createDataFrame([(x,) for x in w], "w string").select(S.anagram(F.col("w")).alias("h")).collect()]
    assert got == [S._python_anagram(x) for x in w]


def test_repair_gives_continuous_text():
    t = "The pressure of the turb-\nKelodarna Guide\nine after repair is measured in the\n- 4 -\nshop and is rec0rded.\n\n## Scope\nPost-\nweld limits."
    got = S.repair(t, {"kelodarna guide"}, {("dash", 4)}, {("turb", "ine")}, {"rec0rded": "recorded"})
    assert got == "The pressure of the turbine after repair is measured in the shop and is recorded.\n\n## Scope\nPost-weld limits."
    assert S.repair("", set(), set(), set(), {}) == ""


def _texts(n, word, doc=1000):
    return [(f"{doc + k}_c0", doc + k, f"Entry {k} names the {word} of the plant.", None, 1, 1) for k in range(n)]


def test_copies_are_no_evidence(spark):
    rows = _texts(25, "pressure") + [(f"{d}_c0", d, "A scanned page about pressurc.", None, 1, 1) for d in range(300)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    words = {r.w: (r.n, r.rows) for r in S.vocabulary(chunks.unionByName(chunks)).collect()}
    assert words["pressurc"] == (1, 300) and words["pressure"] == (25, 25)
    assert {(r.w, r.better) for r in S.Noise(chunks).misread.collect()} == {("pressurc", "pressure")}
    assert S.Noise(chunks).kinds().filter("noise = 'misread'").count() == 300


def test_repeated_rows_are_no_evidence_of_broken_words(spark):
    chunks = spark.createDataFrame([("1_c0", 1, "We follow the Post-\nHardening rule.", None, 1, 1)] * 2, SCHEMA)
    assert S.Noise(chunks).kinds().count() == 0


def test_rare_terms_are_corrections_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARE", 5)  # as in a table so large that no word is frequent
    rows = _texts(25, "pressure") + [("1_c0", 1, "A scanned page about pressurc.", None, 1, 1)] + [(f"{d}_c0", d, f"Page {d} of the tr1bunal.", None, 1, 1) for d in range(200, 206)]
    rows += [(f"{d}_c0", d, f"Page {d} of log4j.", None, 1, 1) for d in range(300, 306)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            assert {(r.w, r.better) for r in S.Noise(chunks).misread.collect()} == {("pressurc", "pressure"), ("tr1bunal", "trlbunal")}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_broken_over_pages_with_blank_lines():
    t = "The pressure of the plant is read at the turb-\n\n- 4 -\n\nine after repair is done.\n\n- 5 -\n\nAll is well."
    assert S.repair(t, set(), {("dash", 4), ("dash", 5)}, {("turb", "ine")}, {}) == "The pressure of the plant is read at the turbine after repair is done.\n\nAll is well."


def test_unmarked_chunks_of_scanned_documents_are_mended(spark, tmp_path):
    hard = "Each inspector of the plant records the pressure\nof the vessel before the shift ends."
    rows = [("1_c0", 1, hard, None, 1, 1, "ocr_page"), ("1_c1", 1, hard + " Twice.", None, 2, 2, None), ("2_c0", 2, hard, None, 1, 1, "plain_text"), ("1_c2", 1, None, None, 1, 1, "ocr_page")]
    spark.createDataFrame(rows, SCHEMA + ", extractor string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r.chunk_id: r.text for r in p3_text(spark, str(tmp_path)).collect()}
    assert got == {"1_c0": hard.replace("\n", " "), "1_c1": hard.replace("\n", " ") + " Twice."}
