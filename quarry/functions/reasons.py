"""Strict and relaxed reject reasons of whole Arrow batches; the rules are those of `predicates`, in the same order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import predicates as P
from quarry.functions.text import squeeze

KEPT = "kept"
_WORD = "[A-Za-z][A-Za-z0-9-]*"
_CAPITALS, _NEXT = "[A-Z][A-Z0-9-]+", "[^A-Za-z0-9-][^A-Za-z]*"
#: Three words in capitals in front, two long ones, nothing but words in capitals.
_THREE = rf"^[^A-Za-z]*{_CAPITALS}{_NEXT}{_CAPITALS}{_NEXT}{_CAPITALS}(?:[^A-Za-z0-9-]|$)"
_TWO = rf"^[^A-Za-z]*[A-Z][A-Z0-9-]{{3,}}{_NEXT}[A-Z][A-Z0-9-]{{3,}}(?:[^A-Za-z0-9-]|$)"
_ALL = rf"^[^A-Za-z]*(?:{_CAPITALS}(?:{_NEXT}|$))+$"


class _Texts:
    """A column of texts without nulls."""

    def __init__(self, texts: pa.Array) -> None:
        self.texts = texts

    def has(self, pattern: str, i: bool = True) -> np.ndarray:
        return pc.match_substring_regex(self.texts, ("(?i)" if i else "") + pattern).to_numpy(zero_copy_only=False)

    def count(self, pattern: str) -> np.ndarray:
        return pc.count_substring_regex(self.texts, pattern).to_numpy(zero_copy_only=False)

    def words(self) -> np.ndarray:
        return self.count(r"\S+")

    def only(self, at: np.ndarray) -> _Texts:
        return _Texts(self.texts.filter(pa.array(at)))


def _where(at: np.ndarray, texts: _Texts, rule) -> np.ndarray:
    """rule for the rows `at`, false elsewhere: what is dear is tried where it matters only."""
    out = np.zeros(len(at), bool)
    if at.any():
        out[at] = rule(texts.only(at))
    return out


def _heading_prefix(t: _Texts) -> np.ndarray:
    def long_enough(x: _Texts) -> np.ndarray:
        n = x.count(_WORD)
        return (n >= 5) & ~((n <= 6) & x.has(_ALL, False))

    return _where(t.has(_THREE, False) | t.has(_TWO, False), t, long_enough)


def _first(empty: np.ndarray, rules: Iterator[tuple[str, np.ndarray]]) -> np.ndarray:
    out = np.where(empty, "empty_text", None).astype(object)
    for reason, met in rules:
        out[met & (out == None)] = reason  # noqa: E711
    out[out == None] = KEPT  # noqa: E711
    return out


def strict(t: _Texts, plain: _Texts, empty: np.ndarray) -> np.ndarray:
    special = {
        "algorithm_listing_fragment": lambda: sum(t.has(p).astype(int) for p in P.LISTING) >= 2,
        "heading_prefix_fragment": lambda: _heading_prefix(plain),
        "bibliography_or_citation": lambda: _where(plain.has(P.BIBLIOGRAPHY), plain, lambda x: x.has(P.CITATION_PREFIX, False) | x.has(P.PAGE_RANGE)),
        "page_range_or_locator": lambda: _where(plain.has(P.PAGE_RANGE), plain, lambda x: x.words() <= 16),
    }
    return _first(empty, ((r, plain.has(p) if p else special[r]()) for r, p in P.STRICT))


def relaxed(t: _Texts, plain: _Texts, empty: np.ndarray) -> np.ndarray:
    clause, n = t.has(P.ISO_CLAUSE, False), t.words()
    low = t.has(r"^\p{Ll}+(?:\s|$)", False)
    colons = pc.count_substring(t.texts, ":").to_numpy(zero_copy_only=False)
    rules = (
        ("reference_heading", lambda: plain.has(P.REFERENCE_HEADING)),
        ("source_task_heading", lambda: plain.has(P.TASK_HEADING)),
        ("source_task_prompt", lambda: plain.has(P.TASK_PROMPT)),
        ("front_matter_artifact", lambda: plain.has(P.FRONT_MATTER)),
        ("bibliography", lambda: plain.has(P.BIBLIOGRAPHY)),
        ("iso_boilerplate", lambda: t.has(P.ISO_BOILERPLATE)),
        ("numbered_reference", lambda: t.has(P.NUMBERED_REFERENCE, False)),
        ("reference_list_dump", lambda: _where(t.has(P.STANDARD_ENTRY, False), t, lambda x: x.count(P.STANDARD_ENTRY) >= 3)),
        ("table_artifact", lambda: (colons >= P.TABLE_ARTIFACT_COLONS) | _where(t.has(P.GLUED, False), t, lambda x: x.count(P.GLUED) >= 3) | t.has(P.DOTTED, False)),
        ("bare_numbered_heading", lambda: t.has(r"^\s*\d{1,2}\s+[A-Z][A-Za-z]", False) & ~t.has(r"[.?!]\s*$", False) & (n <= 10)),
        ("dangling_anaphora", lambda: t.has(P.DANGLING, False)),
        ("printout_metadata", lambda: t.has(P.PRINTOUT, False)),
        ("cot_meta_leak", lambda: t.has(P.COT_META)),
        ("fragment", lambda: ~clause & (t.has(r"^\s*(?:[—–•*]|--?)\s+", False) | (n < 5) | (low & ((n < 8) | t.has(r"\b[a-z]\)\s", False))))),
        ("caption_or_heading", lambda: plain.has(P.CAPTION) & ~clause),
    )
    return _first(empty, ((r, c()) for r, c in rules))


def reason_counts(rows: DataFrame, part: str, text: str) -> DataFrame:
    """part, strict, relaxed, n: how many texts of a part have which first reasons of both tiers, `kept` without one.

    Texts are squeezed and written in ASCII once; the patterns run over whole batches, and each batch gives its counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pc.fill_null(b.column(1), "")
            plain = pc.coalesce(b.column(2), t)  # null where the text is in ASCII
            empty = pc.equal(t, "").to_numpy(zero_copy_only=False)
            s, r = (f(_Texts(t), _Texts(plain), empty) for f in (strict, relaxed))
            yield pa.table({"part": b.column(0), "strict": pa.array(s, pa.string()), "relaxed": pa.array(r, pa.string())}).group_by(["part", "strict", "relaxed"]).aggregate([([], "count_all")]).rename_columns(["part", "strict", "relaxed", "n"]).combine_chunks().to_batches()[0]

    t = rows.select(F.col(part).alias("part"), squeeze(F.col(text)).alias("t"))
    given = t.select("part", "t", F.when(F.col("t").rlike(P.OTHER), P.ascii_of(F.col("t"))).alias("plain"))
    return given.mapInArrow(run, "part string, strict string, relaxed string, n long").groupBy("part", "strict", "relaxed").agg(F.sum("n").alias("n"))
