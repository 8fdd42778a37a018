"""Column functions on text: tokens, normal forms, splitters. All stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content of their own.
STOPWORDS = "a an and are as at be been but by for from had has have he her his if in into is it its of on or our over she shall should so such than that the their them then there these they this those to under up was we were what when where which who will with within without would you your".split()


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; null stays null."""
    return extract_all(F.lower(text), "[a-z0-9]+")


def fold_plural(token: Column) -> Column:
    """One trailing s goes from words longer than four letters, unless they end in ss."""
    return F.when((F.length(token) > 4) & F.endswith(token, F.lit("s")) & ~F.endswith(token, F.lit("ss")), F.regexp_replace(token, "s$", "")).otherwise(token)


def bridge_tokens(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""), fold_plural)


def content_tokens(text: Column) -> Column:
    """Distinct lower-cased words of four characters and more that start with a letter, without stopwords."""
    return F.array_except(F.array_distinct(F.transform(extract_all(text, "[A-Za-z][A-Za-z0-9_]{3,}"), F.lower)), F.array(*(F.lit(w) for w in STOPWORDS)))


def squeeze(text: Column) -> Column:
    """White space trimmed at the ends and collapsed to single blanks."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Soft hyphens and form feeds dropped, wrapped words joined, bullets to dashes, line ends and blanks collapsed."""
    c = F.regexp_replace(text, "[­\\f]", "")
    c = F.regexp_replace(c, r"([a-z])-\n([a-z])", "$1$2")
    c = F.regexp_replace(c, "[•●▪]", "-")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def strip_watermark(text: Column) -> Column:
    """Controlled-copy notices pulled into the text are dropped; white space is collapsed."""
    return squeeze(F.regexp_replace(text, r"(?i)(user name\s*:\s*\S+\s+)?(printed copies are uncontrolled|uncontrolled when printed)", " "))


def strip_list_marker(text: Column) -> Column:
    """A leading clause number or bullet and a trailing bullet are dropped."""
    c = F.regexp_replace(text, r"^\s*([0-9]+(\.[0-9]+)*\.?\s+|[-*•]\s+)", "")
    return strip(F.regexp_replace(c, r"\s*[•*]\s*$", ""))


def dedup_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def chunk_key(chunk_id: Column) -> Column:
    """`_c0007` and `_c7` are one; a single zero is kept."""
    return F.regexp_replace(chunk_id, r"_c0*([0-9]+)$", "_c$1")


def sentences(text: Column) -> Column:
    """Runs up to and with their end marks, trimmed; a rest without an end mark is the last."""
    return F.transform(extract_all(text, "[^.!?]+(?:[.!?]+|$)"), strip)


def paragraphs(text: Column) -> Column:
    return F.transform(F.split(text, r"\n\s*\n"), strip)


def sections(text: Column, start: str) -> Column:
    """The text cut before each line that matches `start` (a pattern for the beginning of a line); what precedes the first is dropped."""
    marked = F.regexp_replace(text, rf"(?m)^({start})", "\u0001$1")
    return F.slice(F.split(marked, "\u0001"), 2, 1_000_000)


CLAUSE_START = r"[0-9]+(?:\.[0-9]+)*\.?[ \t]{1,4}[A-Z]"
HEADING_START = r"(?:#{1,4}\s+.+|[A-Z][A-Z\t ]{5,}$|[0-9]+\.\s+[A-Z].+$)"


def word_count(text: Column) -> Column:
    return F.size(extract_all(text, r"\S+"))


def windows(items: Column, size: int, step: int) -> Column:
    """Slices of `size` items, one every `step` items, as structs of at and items; nothing for an empty array."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice(items, s + 1, size).alias("items")))


def ngrams(items: Column, n: int) -> Column:
    count = F.size(items) - n + 1
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(items, i, n), " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def share_held(unit: Column, held: Column) -> Column:
    """Share of the unit's tokens, repeats counted, that `held` has; 0 for an empty unit."""
    return F.when(F.size(unit) > 0, count_held(unit, held) / F.size(unit)).otherwise(F.lit(0.0))


def count_held(unit: Column, held: Column) -> Column:
    """How many of the unit's tokens, repeats counted, `held` has. The long side is hashed once; the rest is within the unit."""
    once = F.transform(F.array(F.array_intersect(unit, held)), lambda both: F.size(F.filter(unit, lambda t: F.array_contains(both, t))))
    return F.element_at(once, 1)


def share_held_set(unit: Column, held: Column) -> Column:
    """The same over distinct tokens."""
    u = F.array_distinct(unit)
    return F.when(F.size(u) > 0, F.size(F.array_intersect(u, held)) / F.size(u)).otherwise(F.lit(0.0))
