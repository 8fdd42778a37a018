"""Subject areas of documents: one-versus-rest linear classifiers over the sentences' hashed words and word pairs."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import parts
from quarry.llm.linear import best_threshold, scores, train

BITS = 17
#: Labelled documents that the classifiers are fitted on, at most; every document is classified.
SAMPLE = 4000
#: Documents without regard to labels that are fitted on besides, at most.
UNLABELLED = 2000
#: Sentences of the sample that are fitted on, at most.
SENTENCES = 60_000
#: Passes over the sentences, and batches at least, of a fit.
EPOCHS, STEPS = 10, 1000
#: By how much a document's sentences must on average speak against its label (log probability) for it to be given up.
DOUBT = 2.5
#: A document has a subject from this share of its sentences on.
SHARE = 0.25

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "cf fig figs vgl bild abb z b e g i d h u a p ej pp no nr vol art abs ca approx env etc dr prof st resp bzw ggf usw sog inkl evtl"
_ABBREVIATED = frozenset(ABBREVIATIONS.split())


def _code(word: str) -> int:
    return zlib.crc32(word.encode()) & 0x7FFFFFFF


@dataclass
class Tokens:
    """Word codes of all sentences in a row; starts of the sentences; the document of each sentence."""

    codes: np.ndarray
    starts: np.ndarray
    doc: np.ndarray


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        c = _code(word)
        if len(self) < 1 << 18:
            self[word] = c
        return c


_CODES = _Codes()


def sentences(texts: list[str | None]) -> Tokens:
    """The sentences of the texts, as word codes. Headings, table rows and pieces of fewer than four words are left out.

    A sentence ends at a full stop, question or exclamation mark before white space, but not after an abbreviation or
    before a lower-case letter or a digit; or at an empty line, heading, list item or table row. Line ends are white space.
    """
    codes: list[int] = []
    starts, doc = [0], []
    get = _CODES.__getitem__
    for k, text in enumerate(texts):
        if not text:
            continue
        for s in split(text):
            codes += map(get, s)
            starts.append(len(codes))
            doc.append(k)
    return Tokens(np.array(codes, dtype=np.int64), np.array(starts), np.array(doc, dtype=np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(t: Tokens, n: int) -> Tokens:
    """n of the sentences in their order, drawn by a hash of their words and their document's, so from all documents alike."""
    own = np.add.reduceat(_mixed(t.codes.astype(np.uint64)), t.starts[:-1])
    whole = np.zeros(int(t.doc[-1]) + 1, dtype=np.uint64)
    np.add.at(whole, t.doc, own)
    keep = np.sort(np.argsort(_mixed(own ^ _mixed(whole[t.doc])), kind="stable")[:n])
    sizes = np.diff(t.starts)
    words = np.repeat(np.isin(np.arange(len(t.doc)), keep), sizes)
    return Tokens(t.codes[words], np.concatenate([[0], np.cumsum(sizes[keep])]), t.doc[keep])


_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(?<=[.!?])[\"'»”)\]]*\s+(?=[\"'«“(\[¿¡]?[^\W\d_a-zà-öø-ÿß])|(?<=[.!?])\s*\n\s*(?=\d)|\n[ \t]*\n\s*|\n(?=[ \t]*(?:\||#|\d+(?:\.\d+)*\.?[ \t]+[^\W\d_]))|\n(?<=\|\n)")
_ROW = re.compile(r"\s*\|")


def split(text: str) -> list[list[str]]:
    """The sentences of a text as lists of lower-cased words."""
    out: list[list[str]] = []
    held: list[str] = []
    for part in _BREAK.split(text):
        if not part or _ROW.match(part):
            continue
        w = _WORD.findall(part.lower())
        if not w:
            continue
        end = part.rstrip("\"'»”)] \n")[-1:]
        held += w
        if end == "." and w[-1] in _ABBREVIATED:
            continue
        if end in ".!?" and len(held) >= 4:
            out.append(held)
        elif len(held) >= 8:
            out.append(held)
        held = []
    if len(held) >= 4:
        out.append(held)
    return out


def features(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and pairs of neighbouring words of each sentence: ids and starts."""
    n = len(t.codes)
    uni = (t.codes * 2654435761 >> 7) & ((1 << BITS) - 1)
    pair = np.zeros(n, np.int64)
    if n > 1:
        pair[:-1] = ((t.codes[:-1] * 40503 + t.codes[1:] * 2654435761) >> 9) & ((1 << BITS) - 1)
    last = t.starts[1:] - 1
    pair[last] = uni[last]  # the last word counts twice instead of a pair over the end
    return np.stack([uni, pair], axis=1).ravel(), t.starts * 2


@dataclass
class Model:
    subjects: list[str]
    w: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray


def about(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, subject number or -1, margin over the threshold) of each sentence."""
    t = sentences(texts)
    if not len(t.doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    z = scores(model.w, model.bias, *features(t)) - model.thresholds
    best = z.argmax(axis=1)
    top = z[np.arange(len(z)), best]
    return t.doc, np.where(top >= 0, best, -1), top


def shares(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(documents, subjects) share of sentences, and the number of sentences of each document."""
    doc, s, _ = about(model, texts)
    n = np.bincount(doc, minlength=len(texts))
    k = len(model.subjects)
    on = s >= 0
    hits = np.bincount(doc[on] * k + s[on], minlength=len(texts) * k).reshape(len(texts), k)
    return hits / np.maximum(1, n)[:, None], n


def fit(rows: list[tuple[str, tuple[str, ...]]], subjects: list[str], more: list[str] | None = None, rounds: int = 3) -> Model:
    """Fits on (text, labels) and on unlabelled texts: weak labels go to all sentences of a document, which are then relabelled.

    The first fit sees the sentences of documents with one label. Each further round gives every document, with or without
    label, the subject its sentences speak for together, and every sentence that subject unless it clearly speaks for
    another; so wrong labels and passing mentions do little harm, and words that no labelled document has are learned.
    Thresholds are calibrated on every fifth labelled document, which is not fitted on.
    """
    k = len(subjects)
    number = {s: i for i, s in enumerate(subjects)}
    rows = [(t, {number[x] for x in l if x in number}) for t, l in rows]
    rows = [r for r in rows if r[1]]
    model = Model(subjects, np.zeros((1 << BITS, k), np.float32), np.full(k, -1.0, np.float32), np.zeros(k, np.float32))
    fitted, held = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    single = [r for r in fitted if len(r[1]) == 1]
    if not single:
        return model
    t = sentences([x for x, _ in single] + (more or []))
    if len(t.doc) > SENTENCES:
        t = drawn(t, SENTENCES)
    ids, starts = features(t)
    known = int(np.searchsorted(t.doc, len(single)))
    given = np.array([next(iter(l)) for _, l in single])
    label, use = given[t.doc[:known]], known
    for turn in range(rounds):
        share = np.bincount(label, minlength=k) / len(label)
        even = np.sqrt(1 / np.maximum(share, 0.01))  # rare subjects count more
        model.w, model.bias = train(ids[: starts[use]], starts[: use + 1], np.eye(k, dtype=np.float32)[label], 1 << BITS, epochs=EPOCHS, steps=STEPS, weight=(even / even.mean())[label].astype(np.float32))
        z = scores(model.w, model.bias, ids, starts)
        z = z - z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        whole = np.zeros((int(t.doc[-1]) + 1, k), np.float32)
        np.add.at(whole, t.doc, np.maximum(z, -6))
        whole /= np.maximum(1, np.bincount(t.doc, minlength=len(whole)))[:, None]
        of_doc = whole.argmax(axis=1)
        n = min(len(given), len(of_doc))
        doubt = whole[np.arange(n), of_doc[:n]] - whole[np.arange(n), given[:n]] > DOUBT
        of_doc[:n] = np.where(doubt, of_doc[:n], given[:n])  # a given label stays unless its sentences speak clearly against it
        of, best = of_doc[t.doc], z.argmax(axis=1)
        label, use = np.where(z[np.arange(len(z)), best] > z[np.arange(len(z)), of] + 2.0, best, of), len(t.doc)
    texts, truth = [x for x, _ in held], [l for _, l in held]
    t = sentences(texts)
    if len(t.doc):
        z = scores(model.w, model.bias, *features(t))
        best = z.argmax(axis=1)
        right = np.array([b in truth[d] for b, d in zip(best, t.doc)])
        for s in range(k):
            mine = best == s
            if mine.sum() >= 20:
                model.thresholds[s] = min(0.0, best_threshold(z[mine, s], right[mine]))
    return model


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text, subjects: the labelled documents with their labels, spelled alike; null labels are dropped."""
    said = labels.select("doc_id", F.lower(F.trim("subject")).alias("s")).filter("s is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("subjects"))
    return documents.select("doc_id", "text").join(said, "doc_id").filter("text is not null")


def fit_on(documents: DataFrame, labels: DataFrame, subjects: list[str], sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents and as many without label, chosen by a hash of their id."""
    few = labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = labelled(documents, labels.join(few, "doc_id")).collect()
    ids = documents.filter("text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(UNLABELLED)
    more = documents.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id")
    held = {r.text for r in known}
    return fit([(r.text, tuple(r.subjects)) for r in known], subjects, [r.text for r in more.collect() if r.text not in held])


def classify(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """doc_id, subject, share, sentences: every subject that at least `share` of a document's sentences are about.

    Null, empty and wordless texts have no sentence and no subject. Repeated rows come out once. Whole texts are read.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    ids = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for p in parts(batches):
            part, n = shares(m, p.iloc[:, 1].tolist())
            d, s = np.nonzero((part >= share - 1e-9) & (part > 0))
            yield pd.DataFrame({"doc_id": p.iloc[:, 0].values[d], "subject": np.array(m.subjects, dtype=object)[s], "share": part[d, s], "sentences": n[d]})

    return documents.select(doc_id, text).mapInPandas(run, f"doc_id {ids}, subject string, share double, sentences long").dropDuplicates(["doc_id", "subject"])
