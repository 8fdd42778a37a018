"""Held-out test passages inside training text: BM25 over an inverted index of test items, pruned by block maxima.

Every document is cut into overlapping windows, each a query against the index of test items. An item's threshold is
the least BM25 score of any run of RUN words of its own passage, so a window that holds such a run always scores at
least that much; impacts are stored divided by their item's threshold, and the search keeps what reaches 1. As in
block-max WAND a window is dropped by the maxima of its terms, then each block of items by the terms' maxima in the
block, and only what is left is scored. The bounds are taken for many windows at once, in arrays, instead of cursor by
cursor: terms that many blocks have as rows over all blocks, the others as lists of their blocks. The runs of the items
kept are then verified word by word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarry.llm.batches import parts

RUN = 12
#: A window's words; windows start every WINDOW - RUN + 1 words, so every run of RUN words lies in one.
WINDOW = 16
K1, B = 1.2, 0.75
#: Items of a block, which share the maximum of each term.
BLOCK = 8
#: Test items of one index, of about 4 KB each when sent to every executor; the documents are read once for each index.
ITEMS = 50_000
#: A term in at least one of so many blocks has a row over all blocks, and over all items; every term has while the rows need
#: no more than so many bytes. Terms without a row have lists, with the same result.
DENSE, ROWS = 8, 1 << 26
#: Windows, and bounds of windows and blocks, that are held at once.
_CHUNK, _CELLS = 8192, 1 << 21

_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[\u00ad\u200b]")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits of the lower-cased text without soft hyphens and zero-width spaces."""
    return _WORD.findall(_HIDDEN.sub("", text).lower())


def vocabulary(items: list[tuple]) -> dict[str, int]:
    """Term numbers of all words of the items' passages; items are (item_id, passage, question, answer)."""
    terms: dict[str, int] = {}
    for it in items:
        for w in words(it[1] or ""):
            terms.setdefault(w, len(terms))
    return terms


@dataclass
class Index:
    """Impacts by term and item, and their maxima by term and block.

    rows[row[term]] has a common term's maxima over all blocks, row 0 none; those of the others are in near_blocks and
    near_values from starts[term] to starts[term + 1]. In the same way item_rows[item_row[term]] has a common term's impacts
    over all items; all impacts are item_values by their sorted keys term * items + number.
    """

    terms: dict[str, int]
    items: list[int]
    top: np.ndarray
    row: np.ndarray
    rows: np.ndarray
    near_blocks: np.ndarray
    near_values: np.ndarray
    starts: np.ndarray
    item_row: np.ndarray
    item_rows: np.ndarray
    item_keys: np.ndarray
    item_values: np.ndarray
    codes: np.ndarray
    hashes: np.ndarray
    words: list[np.ndarray]
    word_hashes: list[np.ndarray]
    pairs: list[tuple[str, str]]

    @property
    def blocks(self) -> int:
        return -(-len(self.items) // BLOCK)


def _hash(ids: np.ndarray, codes: np.ndarray, run: int) -> np.ndarray:
    """A hash of the run of words that starts at each place but the last run - 1."""
    n = len(ids) - run + 1
    h = np.zeros(max(0, n), np.uint64)
    for o in range(run):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[ids[o : o + n]]
    return h


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted keys, 0 where there is none."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.float32(0))


def build(items: list[tuple], df: np.ndarray | None = None, n_docs: int = 0, run: int = RUN) -> Index:
    """Index of (item_id, passage, question, answer). Items with fewer than `run` words can't be found and are left out.

    df: number of documents that hold each term, of n_docs; without it the items' own frequencies count.
    """
    terms = vocabulary(items)
    kept = [(i, w, q, a) for i, p, q, a in items if len(w := words(p or "")) >= run]
    docs = [np.array([terms[x] for x in w], dtype=np.int32) for _, w, _, _ in kept]
    distinct = [np.unique(d, return_counts=True) for d in docs]
    if df is None:
        n_docs = len(docs)
        df = np.bincount(np.concatenate([t for t, _ in distinct]), minlength=len(terms)) if docs else np.zeros(len(terms))
    mean = sum(map(len, docs)) / max(1, len(docs))
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    rng = np.random.default_rng(7)
    codes = rng.integers(1, 2**63, len(terms) + 1, dtype=np.uint64)
    hashes, item_terms, item_values = [], [], []
    gain = np.zeros(len(terms))
    for d, (t, n) in zip(docs, distinct):
        x = idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(d) / mean))
        gain[t] = x
        runs = np.sort(np.lib.stride_tricks.sliding_window_view(d, run), axis=1)
        once = np.ones(runs.shape, bool)
        once[:, 1:] = runs[:, 1:] != runs[:, :-1]
        least = (gain[runs] * once).sum(axis=1).min() * (1 - 1e-4)
        item_terms.append(t)
        item_values.append(x / least)
        hashes.append(_hash(d, codes, run))
    blocks = max(1, -(-len(docs) // BLOCK))
    t = np.concatenate(item_terms).astype(np.int64) if docs else np.zeros(0, np.int64)
    v = np.concatenate(item_values).astype(np.float32) if docs else np.zeros(0, np.float32)
    k = np.repeat(np.arange(len(docs)), [len(x) for x in item_terms])
    order = np.lexsort((k, t))
    t, v, k = t[order], v[order], k[order]
    keys = t * blocks + k // BLOCK
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    maxima = np.maximum.reduceat(v, first) if len(keys) else v
    keys = keys[first]
    top = np.zeros(len(terms) + 1, np.float32)
    np.maximum.at(top, t, v)
    of, block = keys // blocks, keys % blocks
    every = (len(terms) + 1) * blocks * BLOCK * 4 <= ROWS
    least = 1 if every else max(1, -(-blocks // DENSE))
    common = np.flatnonzero(np.bincount(of, minlength=len(terms) + 1) >= least)
    row = np.zeros(len(terms) + 1, np.int64)
    row[common] = np.arange(1, len(common) + 1)
    rows = np.zeros((len(common) + 1, blocks), np.float32)
    rows[row[of], block] = np.where(row[of] > 0, maxima, 0)
    many = np.flatnonzero(np.bincount(t, minlength=len(terms) + 1) >= (1 if every else max(1, -(-len(docs) // DENSE))))
    item_row = np.zeros(len(terms) + 1, np.int64)
    item_row[many] = np.arange(1, len(many) + 1)
    item_rows = np.zeros((len(many) + 1, blocks, BLOCK), np.float32)
    item_rows[item_row[t], k // BLOCK, k % BLOCK] = np.where(item_row[t] > 0, v, 0)
    rare = row[of] == 0
    starts = np.searchsorted(of[rare], np.arange(len(terms) + 2))
    return Index(
        terms, [i for i, *_ in kept], top, row, rows, block[rare], maxima[rare], starts, item_row, item_rows, t * max(1, len(docs)) + k, v, codes, np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64), docs, hashes, [(q or "", a or "") for _, _, q, a in kept]
    )


def numbers(terms: dict[str, int], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The term numbers of all texts' words in one row (len(terms): another word), and where each text starts."""
    get, none, flat, starts = terms.get, len(terms), [], [0]
    for t in texts:
        if t:
            flat += [get(w, none) for w in words(t)]
        starts.append(len(flat))
    return np.array(flat, dtype=np.int32), np.array(starts)


def candidates(index: Index, ids: np.ndarray, first: np.ndarray, last: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, score) of every item that reaches its threshold in the windows [first, last) of ids."""
    none, blocks, n = len(index.terms), index.blocks, len(index.items)
    reach = np.r_[0.0, np.cumsum(index.top[ids], dtype=np.float64)]
    alive = np.flatnonzero(reach[last] - reach[first] >= 1 - 1e-6)
    out = []
    for part in np.array_split(alive, max(1, -(-len(alive) // max(1, min(_CHUNK, _CELLS // max(1, blocks)))))):
        at = first[part, None] + np.arange(window)
        w = np.sort(np.where(at < last[part, None], ids[np.minimum(at, len(ids) - 1)], none), axis=1)
        w[:, 1:][w[:, 1:] == w[:, :-1]] = none
        bound = np.zeros((len(part), blocks), np.float32)
        for o in range(window):
            bound += index.rows[index.row[w[:, o]]]
        flat = w.ravel()
        sizes = index.starts[flat + 1] - index.starts[flat]
        of = np.repeat(np.arange(len(flat)), sizes)
        place = index.starts[flat[of]] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        np.add.at(bound.ravel(), (of // window) * blocks + index.near_blocks[place], index.near_values[place])
        i, b = np.nonzero(bound >= 1)
        score = np.zeros((len(i), BLOCK), np.float32)
        for o in range(window):
            t = w[i, o].astype(np.int64)
            r = index.item_row[t]
            score += index.item_rows[r, b]
            few = np.flatnonzero((r == 0) & (t < none))
            if len(few):
                k = b[few, None] * BLOCK + np.arange(BLOCK)
                score[few] += np.where(k < n, _look(index.item_keys, index.item_values, t[few, None] * n + np.minimum(k, n - 1)), 0)
        j, k = np.nonzero(score >= 1)
        out.append((part[i[j]], b[j] * BLOCK + k, score[j, k]))
    return tuple(np.concatenate([x[c] for x in out]) for c in range(3)) if out else (np.zeros(0, np.int64),) * 3


def scan(index: Index, texts: list[str | None], run: int = RUN, window: int = WINDOW) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(text number, item number, word, score, question overlap, answer overlap) of each window holding a run of an item.

    The overlaps are the shares of the item's question's and answer's words that the document holds.
    """
    ids, starts = numbers(index.terms, texts)
    step, sizes = window - run + 1, np.diff(starts)
    n = np.where(sizes >= run, 1 + np.maximum(0, -(-(sizes - window) // step)), 0)
    text = np.repeat(np.arange(len(texts)), n)
    if not len(text) or not len(index.items):
        return
    first = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
    last = np.minimum(first + window, starts[text + 1])
    win, item, score = candidates(index, ids, first, last, window)
    hashed = _hash(ids, index.codes, run)
    known = np.isin(hashed, index.hashes)
    held: dict[int, set] = {}
    for o in range(step):
        place = first[win] + o
        ok = np.flatnonzero((place + run <= last[win]) & known[np.minimum(place, len(known) - 1)])
        for c in ok:
            p, k = int(place[c]), int(item[c])
            if any((index.words[k][x : x + run] == ids[p : p + run]).all() for x in np.flatnonzero(index.word_hashes[k] == hashed[p]).tolist()):
                t = int(text[win[c]])
                if t not in held:
                    held[t] = set(words(texts[t]))
                have = held[t]
                q, a = (set(words(x)) for x in index.pairs[k])
                yield t, k, p - int(starts[t]), float(score[c]), len(q & have) / max(1, len(q)), len(a & have) / max(1, len(a))


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, word_at, score, question_overlap, answer_overlap: one row per document and item it holds a run of.

    items: item_id, passage, question, answer: the stated set of test items, read to the driver in blocks of ITEMS, each of
    which is an index sent to every executor. All items up to ITEMS are searched in one pass over the documents. Null or short texts and passages are never found; repeated documents come out once; an empty table of
    either side gives no rows. Every document is searched whole.
    """
    rows = items.select("item_id", "passage", "question", "answer").filter("item_id is not null").distinct().orderBy("item_id", "passage")
    spark, found = documents.sparkSession, None
    schema = f"{doc_id} {documents.schema[doc_id].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, word_at int, score double, question_overlap double, answer_overlap double"
    block: list = []
    blocks = []
    for r in rows.toLocalIterator():
        block.append(tuple(r))
        if len(block) == ITEMS:
            blocks.append(block)
            block = []
    for some in [*blocks, block] if block or not blocks else blocks:
        held = spark.sparkContext.broadcast(build(some))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = held.value
            for p in parts(batches):
                ids = p.iloc[:, 0].values
                got = {}
                for t, item, at, score, q, a in scan(index, p.iloc[:, 1].tolist()):
                    key = (ids[t], index.items[item])
                    if key not in got or score > got[key][1]:
                        got[key] = (at, score, q, a)
                yield pd.DataFrame([(*k, *v) for k, v in got.items()], columns=[doc_id, "item_id", "word_at", "score", "question_overlap", "answer_overlap"])

        part = documents.select(doc_id, text).mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates([doc_id, "item_id"])
