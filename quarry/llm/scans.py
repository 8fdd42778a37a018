"""Noise in text from scanned pages: broken words, misread characters, running heads and page numbers.

Misread words are found by anagram hashes: a word's hash is the sum of a power of its characters' codes, so reading `rn`
for `m` changes it by the same number in every word. Each word plus the difference of each confusion it could hold is
joined with the words that are frequent enough in SQL; of several variants the most frequent wins. Broken words are judged by how often
the joined and the hyphenated form occur elsewhere, heads by their return in chunks of the same document, page numbers by
their form and their distance from the pages of the chunk.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import stored

# Fixed values: (what is read, what was printed) in lower case.
CONFUSIONS = """0:o 1:l 1:i !:i !:l 5:s 6:b 8:b 9:g 3:e @:a c:e e:c f:t t:f b:h h:b q:g g:q ri:n rn:m cl:d ii:u vv:w n:ri m:rn d:cl u:ii w:vv li:h h:li l:i i:l o:0 l:1 i:1 s:5 b:8 b:6"""
READ_AS = [tuple(x.split(":")) for x in CONFUSIONS.split()]
#: A frequent word makes up at least this share of all words, so there are at most this many; and occurs FLOOR times. What
#: is corrected depends on FLOOR only; the share bounds the words that are known to be none when evidence is gathered.
SHARE, FLOOR = 200_000, 12
#: A correction occurs in at least so many of 64 groups of documents, so it is no name of one document.
GROUPS = 3
#: A correction is at least so many times as frequent as what it corrects; less is needed where letters and digits mix.
RATIO, MIXED = 20, 1
#: A running head recurs in at least so many chunks of its document.
RECUR = 3
#: Pages of a chunk up to which its page numbers tell how far they are from its pages.
SPAN = 50
HYPHENS = "-‐¬­"

_SPLIT = re.compile(r"[^\w@!]+|_+")
_JOIN = re.compile(rf"[{HYPHENS}](?<=[^\W\d_].)[ \t]*\n\s*")
_LEFT = re.compile(rf"([^\W_][^\W_]*(?:-[^\W_]+)*)([{HYPHENS}])[ \t]*$")
_RIGHT = re.compile(r"\s*([^\W_]+(?:[!@][^\W_]+)*)")
_PAGE = re.compile(r"^\s*(?:(?P<bare>\d{1,4})|(?P<square>\[\d{1,4}\])|(?P<dash>[-–—]\s?\d{1,4}\s?[-–—])|(?P<tilde>~\s?\d{1,4}\s?~)|(?P<word>(?:page|seite|página|p\.|s\.|pág\.)\s?\d{1,4}(?:\s(?:of|von|de|sur|/)\s\d{1,4})?)|(?P<part>\d{1,4}/\d{1,4}))\s*$", re.I)
#: Forms that are page numbers wherever they stand alone in a line.
PLAIN_FORMS = ("dash", "tilde", "word")
#: Forms that are page numbers unless there are more of them than pages.
COUNTED_FORMS = ("square", "part")
_NUMBER = re.compile(r"\d+")
_HEAD_NUMBER = re.compile(r"^\s*\d{1,4}\s{2,}|\s{2,}\d{1,4}\s*$")
_DIGIT_IN = re.compile(r"(?<=[^\W\d_])[0156!@]|[0156!@](?=[^\W\d_])")
_FIX = {"0": "o", "1": "l", "5": "s", "6": "b", "!": "i", "@": "a"}

EVIDENCE = "chunk_id string, doc_id long, kind string, a string, b string, x int, y int, lo int, hi int, h long"
NAMES = [c.split()[0] for c in EVIDENCE.split(", ")]
ARROW = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in EVIDENCE.split(", ")]


def tokens(text: Column) -> Column:
    """Distinct lower-cased words of a text with broken ones joined; marks that are misread letters count as letters."""
    joined = F.regexp_replace(F.lower(text), rf"[{HYPHENS}](?<=\p{{L}}.)[ \t]*\n\s*", "")
    other = r"[^a-z0-9\p{L}\p{N}@!\-]+"
    return F.array_remove(F.array_distinct(F.split(joined, rf"{other}|!+{other}|-{{2,}}")), "")


def anagram(word: Column) -> Column:
    """The sum of the fifth powers of the characters' codes (mod 1021)."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: s + F.pow(F.pmod(F.ascii(c), F.lit(1021)), F.lit(5)).cast("long"))


def _python_anagram(word: str) -> int:
    return sum((ord(c) % 1021) ** 5 for c in word)


def vocabulary(chunks: DataFrame) -> DataFrame:
    """w, n, rows, groups: in how many distinct texts and in how many rows each word occurs, and in how many of 64 groups of documents.

    Repeated rows count once in both, copies of a text under other ids in `rows` only. All rows are counted and what copies
    added is taken off, so no text is shuffled but those that have copies. Texts are told apart by 64 bits.
    """
    texts = chunks.filter("text is not null").select("chunk_id", "text", F.xxhash64("text").alias("h"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int").alias("g"))
    words = texts.select("g", F.explode(tokens(F.col("text"))).alias("w"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("rows"))
    ids = texts.groupBy("h", "chunk_id").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("ids"))
    copied = texts.select("h", "text").join(stored(ids.filter("c > 1")), "h").groupBy("h", "text").agg(F.min("c").alias("c"), F.min("ids").alias("ids"))
    less = copied.select(F.lit(None).cast("int").alias("g"), F.explode(tokens(F.col("text"))).alias("w"), (1 - F.col("c")).alias("n"), (F.col("ids") - F.col("c")).alias("rows"))
    return words.unionByName(less).groupBy("w").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, g)"))).alias("groups"))


def frequent(words: DataFrame) -> DataFrame:
    return words.filter((F.col("rows") >= FLOOR) & (F.col("rows") * SHARE >= words.agg(F.sum("rows")).scalar()))


def targets(words: DataFrame) -> DataFrame:
    """The words that may be corrections, however large the table is."""
    return words.filter(F.col("rows") >= FLOOR)


def corrections(words: DataFrame, right: DataFrame) -> DataFrame:
    """w, better: the misread words of the vocabulary with the most frequent word that each could have been.

    `right` are the words that may be corrections; they are written, so the plan broadcasts few and shuffles many. Numbers
    with letters for digits are corrected to the number, other words with one digit are misread by their shape. A word is RATIO times as frequent in distinct texts, so copies of a misread text don't shield
    it; or in rows, unless the misread form stands in more texts. Ties go to the first in alphabetical order.
    """
    spark = words.sparkSession
    reads = [(r, t, _python_anagram(t) - _python_anagram(r)) for r, t in READ_AS]
    table = F.broadcast(spark.createDataFrame(reads, "r string, t string, delta long"))
    known = stored(right.filter((F.col("groups") >= GROUPS) & ~F.col("w").rlike(r"[0-9@!]")).select(F.col("w").alias("better"), F.col("n").alias("m"), F.col("rows").alias("m_rows"), anagram(F.col("w")).alias("h")))
    odd = words.filter((F.length("w") >= 3) & F.col("w").rlike(r"\p{L}") & ~F.col("w").rlike(r"^\p{L}[0-9]{2,}\p{L}?$"))
    odd = odd.select("w", "n", "rows", F.col("w").rlike(r"[0-9@!]").alias("mixed"), anagram(F.col("w")).alias("hw"))
    held = odd.join(table, F.instr("w", F.col("r")) > 0)
    times = ((F.length("w") - F.length(F.replace("w", F.col("r"), F.lit("")))) / F.length("r")).cast("int")
    held = held.withColumn("k", F.explode(F.when(times > 1, F.array(F.lit(1), times)).otherwise(F.array(F.lit(1))))).withColumn("h", F.col("hw") + F.col("k") * F.col("delta"))
    ratio = F.when(F.col("mixed"), MIXED).otherwise(RATIO)
    outweighs = (F.col("m") >= F.col("n") * ratio) | ((F.col("m_rows") >= F.col("rows") * ratio) & (F.col("m") >= F.col("n")))
    met = held.join(known, "h").filter(outweighs & (F.col("w") != F.col("better")))
    once = F.exists(F.sequence(F.lit(1), F.length("w")), lambda p: (F.col("w").substr(p, F.length("r")) == F.col("r")) & (F.concat(F.col("w").substr(F.lit(1), p - 1), F.col("t"), F.col("w").substr(p + F.length("r"), F.length("w"))) == F.col("better")))
    fits = met.filter(F.when(F.col("k") == 1, once).otherwise(F.replace("w", F.col("r"), F.col("t")) == F.col("better")))
    letters = fits.groupBy("w").agg(F.min(F.struct(-F.col("m"), -F.col("m_rows"), "better")).alias("b")).select("w", "b.better")
    digits = F.translate("w", "olbsi", "01851")
    numbers = words.filter(F.col("w").rlike(r"^[0-9olbs]+$") & F.col("w").rlike(r"[0-9]") & F.col("w").rlike(r"[olbs]") & (F.length(F.regexp_replace("w", "[0-9]", "")) * 2 <= F.length("w")) & ~F.col("w").rlike(r"^\p{L}[0-9]{2,}\p{L}?$"))
    numbers = numbers.select("w", "n", digits.alias("better")).join(words.select(F.col("w").alias("better"), F.col("n").alias("m")), "better").filter("m >= n").select("w", "better")
    shaped = words.filter(F.col("w").rlike(r"^\p{L}+[0-9!]\p{L}+$") & (F.length("w") >= 5)).join(letters, "w", "left_anti").select("w", "n", F.translate("w", "0135689!", "olesbbgi").alias("better"))
    shaped = shaped.filter(~F.col("better").rlike("[0-9]") | (F.col("n") <= 3)).drop("n")  # digits that stand for no letter may belong there
    return letters.unionByName(numbers.join(letters, "w", "left_anti")).unionByName(shaped)


def head_key(line: str) -> str:
    """A line's letters, with misread ones put right, without numbers and marks."""
    s = _DIGIT_IN.sub(lambda m: _FIX[m[0]], _HEAD_NUMBER.sub("", line).lower())
    return re.sub(r"[\W\d_]+", " ", s).strip()


def name_of(path: str | None) -> str:
    """The name in a document's file name, without its number."""
    m = re.search(r"([^\W\d_]{4,})[_\-\d]*\.\w+$", path or "")
    return m[1].lower() if m else ""


def evidence(text: str, path: str | None, common: frozenset[str]) -> Iterator[tuple]:
    """(kind, a, b, x, y): what could be noise in a chunk; kinds head, page, hyphen and word."""
    lines = text.split("\n")
    name = name_of(path)
    pages: list[tuple[str, int]] = []
    skip = set()
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or len(s) > 70:
            continue
        if len(s) <= 24 and (m := _PAGE.match(s)):
            pages.append((m.lastgroup, int(_NUMBER.search(s)[0])))
            skip.add(i)
            continue
        if s[0] in "#|" or s[-1] in ".;:,!?-" or not (s[0].isupper() or s[0].isdigit()) or s[-1] in HYPHENS:
            continue
        key = head_key(line)
        if not key or key.count(" ") > 6 or len(key) < 4:
            continue
        named = bool(name) and name in key
        before = next((x.strip() for x in reversed(lines[:i]) if x.strip()), "")
        after = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
        breaks = bool(before) and bool(after) and (before[-1] in HYPHENS or (before[-1] not in ".!?:;|" and after[0].islower()))
        number = _HEAD_NUMBER.search(line)
        if named or breaks:
            skip.add(i)
        yield "head", key, _NUMBER.search(number[0])[0] if number else None, int(named), int(breaks)
    alike = Counter(f for f, _ in pages)
    for form, n in pages:
        yield "page", form, None, n, alike[form]
    for i, line in enumerate(lines[:-1]):
        if line.rstrip()[-1:] not in HYPHENS or not (m := _LEFT.search(line)):
            continue
        for j in range(i + 1, len(lines)):
            if j in skip or not lines[j].strip():
                continue
            if r := _RIGHT.match(lines[j]):
                yield "hyphen", m[1].lower(), r[1].lower(), int(m[2] == "-"), int(r[1][0].isupper() and not m[1][-1].isupper())
            break
    low = _JOIN.sub("", text.lower())
    for w in set(_SPLIT.split(low)) - common:
        w = w.rstrip("!")
        if len(w) > 1:
            yield "word", w, None, None, None


def gather(chunks: DataFrame, common: DataFrame) -> DataFrame:
    """All evidence of all chunks, as written rows; h tells the texts of broken words apart. `common` (at most SHARE rows) are words that are surely none."""
    held = chunks.sparkSession.sparkContext.broadcast(frozenset(r.w for r in common.select("w").toLocalIterator()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            out: list[list] = [[] for _ in range(10)]
            for c, d, t, s, lo, hi, h in zip(*(x.to_pylist() for x in p.columns)):
                hi = lo if hi is None else hi
                lo = hi if lo is None else lo
                for e in evidence(t, s, held.value):
                    for column, v in zip(out, (c, d, *e, lo, hi, h if e[0] == "hyphen" else None)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, ARROW)], names=NAMES)

    use = chunks.filter("text is not null and chunk_id is not null").select("chunk_id", "doc_id", "text", "source_path", "page_start", "page_end", F.xxhash64("text").alias("h"))
    return stored(use.mapInArrow(run, EVIDENCE), by=("kind",))


def running_heads(found: DataFrame) -> DataFrame:
    """doc_id, key: the lines that recur in RECUR chunks of a document and name it or mostly stand inside a sentence."""
    h = found.filter("kind = 'head'").groupBy("doc_id", "a", "chunk_id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return h.groupBy("doc_id", "a").agg(F.count(F.lit(1)).alias("c"), F.avg("x").alias("x"), F.avg("y").alias("y")).filter((F.col("c") >= RECUR) & ((F.col("x") > 0.5) | (F.col("y") > 0.5))).select("doc_id", F.col("a").alias("key"))


def page_numbers(found: DataFrame, heads: DataFrame) -> DataFrame:
    """chunk_id, form, n: printed page numbers, alone in a line or in a running head.

    A dashed or worded form always is one, one in brackets or with the number of pages unless more of them stand in the
    chunk than it has pages. A bare number is one if it lies within the chunk's pages or as far from them as in another
    chunk of the document, and is not one of a column of numbers. How far is only told by chunks of at most SPAN pages;
    others are as good as unnumbered.
    """
    alone = found.filter("kind = 'page'").select("chunk_id", "doc_id", F.col("a").alias("form"), F.col("x").alias("n"), F.col("y").alias("alike"), "lo", "hi").distinct()
    span = F.col("hi") - F.col("lo")
    few = F.col("alike") <= F.least(F.greatest(F.coalesce(span, F.lit(1)), F.lit(0)) + 1, F.lit(3))
    sure = alone.filter(F.col("form").isin(*PLAIN_FORMS) | (few & F.col("form").isin(*COUNTED_FORMS)))
    rest = alone.filter((F.col("form") == "bare") & few)
    there = rest.filter(F.col("lo").isNotNull() & (span >= 0))
    inside = there.filter((F.col("n") >= F.col("lo")) & (F.col("n") <= F.col("hi")))
    far = there.filter(span <= SPAN).withColumn("o", F.explode(F.expr("transform(sequence(lo, hi), p -> n - p)")))
    shared = far.groupBy("doc_id", "form", "o").agg(F.countDistinct("chunk_id").alias("c")).filter("c > 1").drop("c")
    moved = far.join(shared, ["doc_id", "form", "o"], "left_semi")
    lost = rest.filter(F.col("lo").isNull() | (span > SPAN)).join(inside.unionByName(moved.select(inside.columns)).select("doc_id", "form").distinct(), ["doc_id", "form"], "left_semi")
    named = found.filter("kind = 'head' and b is not null").join(heads.withColumnRenamed("key", "a"), ["doc_id", "a"], "left_semi").select("chunk_id", F.lit("head").alias("form"), F.col("b").cast("int").alias("n"))
    parts = [x.select("chunk_id", "form", "n") for x in (sure, inside, moved, lost, named)]
    return reduce(DataFrame.unionByName, parts).distinct()


def broken_words(found: DataFrame, words: DataFrame) -> DataFrame:
    """chunk_id, a, b: words broken over a line end. A compound divided at its own hyphen is none.

    The joined and the hyphenated form are looked up; the one in more distinct texts decides. Where neither occurs elsewhere, a plain hyphen
    between two known words or before a capital is taken for the compound's own.
    """
    h = found.filter("kind = 'hyphen'").select("chunk_id", "a", "b", "x", "y", "h").distinct()
    forms = h.select("a", "b", "x", "y").distinct().withColumn("joined", F.concat("a", "b")).withColumn("whole", F.concat_ws("-", "a", "b"))
    n = words.select(F.col("w"), F.col("n"))
    seen = (
        forms.join(n.toDF("joined", "nj"), "joined", "left").join(n.toDF("whole", "nw"), "whole", "left").join(n.toDF("a", "na"), "a", "left").join(n.toDF("b", "nb"), "b", "left").fillna(0, ["nj", "nw", "na", "nb"])
    )
    # the vocabulary joins what is broken, so each text with a broken form has put it there once
    own = h.groupBy("a", "b").agg(F.count_distinct("h").alias("own"))
    seen = seen.join(own, ["a", "b"])
    elsewhere = F.col("nj") - F.col("own")
    own_hyphen = F.when(F.col("nw") > F.greatest(elsewhere, F.lit(0)), True).when(elsewhere > 0, False).otherwise((F.col("x") == 1) & ((F.col("y") == 1) | ((F.col("na") >= FLOOR) & (F.col("nb") >= FLOOR))))
    return h.join(seen.filter(~own_hyphen).select("a", "b", "x", "y"), ["a", "b", "x", "y"], "left_semi").select("chunk_id", "a", "b").distinct()


def misread_words(found: DataFrame, better: DataFrame) -> DataFrame:
    """chunk_id, w, better."""
    return found.filter("kind = 'word'").select("chunk_id", F.col("a").alias("w")).join(better, "w").distinct()


class Noise:
    """The noise of a table of chunks, in written tables: heads, pages, broken, misread.

    Null texts and ids have none; repeated rows count once; a document of any number of chunks is counted, never gathered.
    """

    def __init__(self, chunks: DataFrame) -> None:
        words = stored(vocabulary(chunks))
        common = stored(frequent(words))
        better = stored(corrections(words, targets(words)))
        self.found = gather(chunks, common.join(better, "w", "left_anti"))
        self.heads = running_heads(self.found)
        self.pages = page_numbers(self.found, self.heads)
        self.broken = broken_words(self.found, words)
        self.misread = misread_words(self.found, better)

    def kinds(self) -> DataFrame:
        """chunk_id, noise, distinct."""
        headed = self.found.filter("kind = 'head'").join(self.heads.withColumnRenamed("key", "a"), ["doc_id", "a"], "left_semi")
        parts = (("running_head", headed), ("page_number", self.pages), ("hyphen", self.broken), ("misread", self.misread))
        return reduce(DataFrame.unionByName, [p.select("chunk_id", F.lit(k).alias("noise")) for k, p in parts]).distinct()


def _runs_on(prior: str, line: str) -> bool:
    """Whether a line carries on the sentence of the line before it."""
    return prior[0] not in "#|" and not re.match(r"\s*(?:[#|]|[-*•]\s|\d+(?:\.\d+)*\.?\s+\S)", line) and (prior[-1] not in ".!?:" or line.lstrip()[0].islower()) and len(prior) > 30


def repair(text: str, heads: set[str], pages: set[tuple[str, int]], broken: set[tuple[str, str]], better: dict[str, str]) -> str:
    """The text in continuous paragraphs: page matter dropped, broken words joined, misread words corrected, lines joined.

    Empty lines, headings, table rows and list items keep their line; an empty line at page matter goes if a sentence runs on.
    """
    kept: list[str] = []
    removed = blank = False
    for line in text.split("\n"):
        s = line.strip()
        m = _PAGE.match(s) if s else None
        if (m and (m.lastgroup, int(_NUMBER.search(s)[0])) in pages) or (s and s[0] not in "#|" and head_key(line) in heads):
            removed = True
            while kept and not kept[-1]:
                blank = not kept.pop()
            continue
        if removed and not s:
            blank = True
            continue
        if removed and blank and kept and not (_LEFT.search(kept[-1]) and _RIGHT.match(line)) and not _runs_on(kept[-1], line):
            kept.append("")
        removed = blank = False
        kept.append(line.rstrip())
    out: list[str] = []
    for line in kept:
        prior = out[-1] if out else ""
        if prior and line.strip() and (m := _LEFT.search(prior)) and (r := _RIGHT.match(line)):
            if (m[1].lower(), r[1].lower()) in broken:
                out[-1] = prior[: m.start(2)] + line.lstrip()
            else:
                out[-1] = prior + line.lstrip()
        elif prior and line.strip() and _runs_on(prior, line):
            out[-1] = prior + " " + line.lstrip()
        else:
            out.append(line)

    def put(m: re.Match) -> str:
        w = m[0]
        mark = "!" if w.endswith("!") else ""
        b = better.get(w.rstrip("!").lower())
        if b is None:
            return w
        return (b.upper() if w.isupper() and len(w) > 2 else b[0].upper() + b[1:] if w[0].isupper() else b) + mark

    body = "\n".join(out)
    return re.sub(r"[\w@!]+(?:-[\w@!]+)*", put, body) if better else body
