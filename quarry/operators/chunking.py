"""Chunking: routing, splitting, packing and mapping ranges to pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import CLAUSE_START, HEADING_START, extract_all, paragraphs, sections, windows

# Size and overlap of each strategy.
STRATEGIES = {"clause": (400, 40), "heading": (700, 100), "recursive": (512, 80), "table_aware": (900, 0), "ocr_block": (600, 40)}
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ")


def route(scanned: Column, table_density: Column, doc_type: Column) -> Column:
    """The strategy for a document's profile."""
    return (
        F.when(scanned, "ocr_block")
        .when((table_density >= 0.4) | (doc_type == "REPORT"), "table_aware")
        .when(doc_type == "ISO_STANDARD", "clause")
        .when(doc_type == "TEXTBOOK", "heading")
        .otherwise("recursive")
    )


def table_density(text: Column) -> Column:
    """Share of a text's lines that are table rows."""
    rows = F.split(text, "\n")
    return F.size(F.filter(rows, lambda l: l.startswith("|"))) / F.size(rows)


def split_sections(documents: DataFrame, kind: str) -> DataFrame:
    """doc_id, idx, section: `clause` or `heading` sections; documents without any are left out, as is text before the first."""
    start = CLAUSE_START if kind == "clause" else HEADING_START
    return documents.filter("text is not null").select("doc_id", F.posexplode(sections(F.col("text"), start)).alias("idx", "section"))


def rechunk(chunks: DataFrame, kind: str) -> DataFrame:
    """doc_id, idx, text: chunks cut into sentences (30 characters at least) or paragraphs (50); where none is left, the chunk."""
    from quarry.functions.text import sentences

    pieces, least = (sentences(F.col("text")), 30) if kind == "sentence" else (paragraphs(F.col("text")), 50)
    kept = F.filter(pieces, lambda p: F.length(p) >= least)
    rows = chunks.select("doc_id", "chunk_id", F.posexplode(F.when(F.size(kept) > 0, kept).otherwise(F.array("text"))).alias("i", "text"))
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("chunk_id"), "chunk_id", "i")) - 1).alias("idx"), "text")


def sliding(documents: DataFrame, size: int = 256, overlap: int = 128) -> DataFrame:
    """doc_id, idx, text: windows of `size` words over a document, `size - overlap` words apart (one at least)."""
    step = max(1, size - overlap)
    rows = documents.filter("text is not null").select("doc_id", F.explode(windows(extract_all(F.col("text"), r"\S+"), size, step)).alias("w"))
    return rows.select("doc_id", (F.col("w.at") / step).cast("int").alias("idx"), F.array_join("w.items", " ").alias("text"))


def pack_units(sizes: list[int], limit: int) -> list[int]:
    """The group of each unit: units are added until the next would exceed the limit; a longer unit stands alone."""
    out, group, held = [], -1, None
    for n in sizes:
        if held is None or held + n > limit:
            group, held = group + 1, 0
        held += n
        out.append(group)
    return out


def pack_lines(rows: DataFrame, limit: int, key: str = "doc_id", order: str = "line_idx", size: str = "n_chars", page: str = "page_no") -> DataFrame:
    """doc_id, idx, n_units, n_chars, page_start, page_end: units packed greedily in order and never cut.

    A fold over each document's units, in the JVM; what it gathers is as long as the document.
    """
    units = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).alias("n"), F.col(page).alias("p")))).alias("u"))
    zero = F.expr("cast(array() as array<struct<n_units:int,n_chars:int,page_start:int,page_end:int>>)")

    def add(acc: Column, u: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(F.lit(1).alias("n_units"), u["n"].cast("int").alias("n_chars"), u["p"].cast("int").alias("page_start"), u["p"].cast("int").alias("page_end"))
        grown = F.struct((last["n_units"] + 1).alias("n_units"), (last["n_chars"] + u["n"]).cast("int").alias("n_chars"), F.least(last["page_start"], u["p"]).cast("int").alias("page_start"), F.greatest(last["page_end"], u["p"]).cast("int").alias("page_end"))
        fresh = F.when(F.size(acc) == 0, True).otherwise(last["n_chars"] + u["n"] > limit)
        return F.when(fresh, F.concat(acc, F.array(one))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown)))

    return units.select(key, F.posexplode(F.aggregate("u", zero, add)).alias("idx", "c")).select(key, "idx", "c.*")


def pack_sentences(sentences: list[str], size: int, overlap: int) -> list[str]:
    """Sentences filled up to `size` characters; each chunk starts with the last sentences of the one before, up to `overlap`."""
    out: list[str] = []
    held: list[str] = []
    fresh = False
    for s in sentences:
        for part in [s[i : i + size] for i in range(0, len(s), size)] or [s]:
            if held and len(" ".join([*held, part])) > size:
                if fresh:
                    out.append(" ".join(held))
                tail: list[str] = []
                while held and len(" ".join([held[-1], *tail])) <= overlap:
                    tail.insert(0, held.pop())
                held = tail if len(" ".join([*tail, part])) <= size else []
            held.append(part)
            fresh = True
    if held and fresh:
        out.append(" ".join(held))
    return out


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Ranges of at most `size` characters, cut after the strongest separator that leaves them short enough; neighbours share up to `overlap`."""
    out: list[tuple[int, int]] = []
    start, n = 0, len(text)
    while start < n:
        if n - start <= size:
            out.append((start, n))
            break
        end = start + size
        for sep in separators:
            at = text.rfind(sep, start + max(1, overlap + 1), end)
            if at > 0:
                end = at + len(sep.rstrip()) if sep.strip() else at + len(sep)
                break
        out.append((start, min(end, n)))
        start = max(end - overlap, start + 1)
    return out


def split_documents(documents: DataFrame, how: str, size: int = 512, overlap: int = 80) -> DataFrame:
    """doc_id, idx, char_start, char_end, text by `recursive` or `sentence` splitting, in Arrow batches.

    Null and empty texts give no chunk; a text within the size is one chunk.
    """
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for d, t in zip(p.doc_id, p.text):
                if how == "recursive":
                    out += [(d, i, a, b, t[a:b]) for i, (a, b) in enumerate(split_recursively(t, size, overlap))]
                else:
                    parts = [s.strip() for s in re.findall(r"[^.!?]+[.!?]*", t) if s.strip()]
                    out += [(d, i, None, None, c) for i, c in enumerate(pack_sentences(parts, size, overlap))]
            yield pd.DataFrame(out, columns=["doc_id", "idx", "char_start", "char_end", "text"]).astype({"char_start": "Int32", "char_end": "Int32"})

    use = documents.filter("text is not null and text <> ''").select("doc_id", "text")
    return use.mapInPandas(run, "doc_id long, idx int, char_start int, char_end int, text string")


def pages_of(ranges: DataFrame, units: DataFrame) -> DataFrame:
    """chunk_id, pages (sorted, distinct), unit_chars: the units (doc_id, char_start, char_end, page_no) that each range overlaps.

    An equi-join on the document with the overlap as a further condition; nothing is compared across documents.
    """
    r, u = ranges.alias("r"), units.alias("u")
    hit = (F.col("r.doc_id") == F.col("u.doc_id")) & (F.col("u.char_end") > F.col("r.char_start")) & (F.col("u.char_start") < F.col("r.char_end"))
    clipped = F.least("r.char_end", "u.char_end") - F.greatest("r.char_start", "u.char_start")
    return r.join(u, hit).groupBy("r.chunk_id").agg(F.array_sort(F.collect_set("u.page_no")).alias("pages"), F.sum(clipped).alias("unit_chars"))


def expand_short(facts: DataFrame, least: int = 12) -> DataFrame:
    """fact_id, text: facts of fewer than `least` words get the sentence before them in their chunk in front, else the one after behind."""
    w = Window.partitionBy("chunk_id").orderBy("order_idx")
    short = F.size(F.split(F.trim("text"), r"\s+")) < least
    before, after = F.lag("text").over(w), F.lead("text").over(w)
    return facts.select("fact_id", F.when(short & before.isNotNull(), F.concat_ws(" ", before, "text")).when(short & after.isNotNull(), F.concat_ws(" ", "text", after)).otherwise(F.col("text")).alias("text"))
