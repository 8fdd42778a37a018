"""Splitting oversized texts at natural boundaries, by recursive bisection."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundary kinds, strongest first. A match's end is the place of a cut.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\n+(?=(?:\d+(?:\.\d+)*\.?|#{1,6})[ \t]+\S)",  # before a numbered clause or a heading
        r"\n[ \t]*\n\s*",  # between paragraphs
        r"[.!?…。]['\"»”’)\]]*\s+",  # after a sentence
        r"\n\s*|[;:]\s+",  # after a line or a part of a sentence
        r"\s+",  # after a word
    )
)
#: A cut lies within this share of a segment's length around its middle, if a boundary does.
WINDOW = 0.25

PIECE = "array<struct<piece_no:int,char_start:int,body_start:int,char_end:int,piece:string>>"


def _nearest(places: list[int], lo: int, mid: int, hi: int) -> int | None:
    """The place in [lo, hi] nearest to mid."""
    i = bisect_left(places, mid)
    near = [p for p in places[max(0, i - 1) : i + 1] if lo <= p <= hi]
    return min(near, key=lambda p: (abs(p - mid), p)) if near else None


def bodies(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Cuts text into consecutive segments: the first within limit, the others within limit minus overlap.

    Each step cuts the segment at the strongest boundary near its middle; halves still too long are cut again. A
    segment without any boundary is cut in the middle, not before a combining mark where it can be helped.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    room = limit - overlap
    kinds = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    out, stack = [], [(0, len(text))]
    while stack:
        a, b = stack.pop()
        if b - a <= (room if a else limit):
            out.append((a, b))
            continue
        mid, reach = (a + b) // 2, max(1, int((b - a) * WINDOW))
        at = None
        for k, places in enumerate(kinds):
            wide = reach if k < len(kinds) - 1 else (b - a) // 2
            at = _nearest(places, max(a + 1, mid - wide), mid, min(b - 1, mid + wide))
            if at is not None:
                break
        if at is None:
            at = mid
            while at > a + 1 and unicodedata.combining(text[at]):
                at -= 1
            at = at if at > a + 1 else mid
        stack += [(at, b), (a, at)]
    return out


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """(piece_no, char_start, body_start, char_end, piece) in order; offsets count code points of text.

    The bodies [body_start, char_end) follow each other without gap and make up the whole text. char_start reaches back
    by at most overlap, to the start of a word if one is there. An overlap of the limit or more counts as one less than the
    limit, so that each piece still brings a character.
    """
    overlap = max(0, min(overlap, limit - 1))
    cuts = bodies(text, limit, overlap)
    words = [m.end() for m in BOUNDARIES[-1].finditer(text)] if overlap and len(cuts) > 1 else []
    out = []
    for k, (a, b) in enumerate(cuts):
        start = max(0, a - overlap, b - limit) if k else a
        if start < a and start:
            i = bisect_left(words, start)
            start = words[i] if i < bisect_right(words, a) else start
        out.append((k, start, a, b, text[start:b]))
    return out


def _pieces(text: Column, size: Column, overlap: Column) -> Column:
    @F.pandas_udf(PIECE)
    def run(t: pd.Series, s: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("piece_no", "char_start", "body_start", "char_end", "piece"), p)) for p in split(x, int(n), int(v))] for x, n, v in zip(t, s, o)])

    return run(text, size, overlap)


def split_oversized(rows: DataFrame, text: str = "text", size: str = "chunk_size", overlap: str = "overlap") -> DataFrame:
    """The rows whose text has more code points than its size, one row per piece: all columns, then n_pieces and PIECE's.

    Rows with null text, with a size that is null or below 1, or within the size give no piece; a null or negative
    overlap counts as 0. Columns of rows named like those added are replaced. Only oversized rows reach Python.
    """
    made = ["n_pieces", "piece_no", "char_start", "body_start", "char_end", "piece"]
    big = rows.filter((F.col(size) >= 1) & (F.length(text) > F.col(size)))
    cut = big.withColumn("__p", _pieces(F.col(text), F.col(size), F.coalesce(F.col(overlap), F.lit(0))))
    kept = [F.col(c) for c in rows.columns if c.lower() not in made]
    return cut.select(*kept, F.size("__p").alias("n_pieces"), F.explode("__p").alias("__x")).select(*(F.col(c) for c in rows.columns if c.lower() not in made), "n_pieces", "__x.*")


def latest_sizes(chunk_results: DataFrame) -> DataFrame:
    """doc_id, chunk_size, overlap of each document's last result (repeated rows and reruns count once)."""
    last = F.max(F.struct("finished_at", "chunk_size", "overlap"))
    return chunk_results.filter("chunk_size is not null").groupBy("doc_id").agg(last.alias("r")).select("doc_id", "r.chunk_size", "r.overlap")
