"""Broken prompt and response pairs: a multi-label linear classifier on hashed n-grams and features of the pair.

It is trained on sound pairs broken on purpose: cut off, copied, answered in another language, refused and emptied; refusals
and sound denials are drawn from grammars that no table was used for. Pairs that look broken after a first fit leave the
sound side before the second. Thresholds are calibrated on held-out pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.declines import DENIALS, REFUSALS, draw
from quarry.llm.declines import vocabulary as declining
from quarry.llm.linear import best_threshold, scores, train
from quarry.llm.residue import kind_of

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")
LANGUAGES = ("en", "de", "fr", "es")
BITS = 18
#: Pairs that the classifiers are fitted on, at most; every pair is classified.
SAMPLE = 4000
#: Documents that the languages are learned from, at most.
SPOKEN = 600
#: What a sound held-out pair counts against a broken one when thresholds are calibrated.
SOUND = 8.0
#: Where in the gap between sound and broken held-out pairs a threshold lies; low, as real defects differ more than made ones.
LOW = 0.25
#: Length of the vector of a text's n-grams; a feature of the pair has 1.
GRAMS = 3.0
#: Margins per defect from which a sound pair of the sample is doubted and not fitted on; a log holds refusals among its answers.
DOUBT = np.array([0.0, 0.0, -2.5, 0.0, 0.0], np.float32)

# What stands for "no value", in lower case without marks at the ends.
NO_VALUE = frozenset(
    """n/a|na|n.a|none|null|nil|nan|no value|no answer|not available|not applicable|unknown|undefined|empty|void|missing|blank|tbd
keine|keine angabe|keine angaben|k.a|k. a|entfällt|nichts|leer|ohne angabe|unbekannt|nicht vorhanden
néant|aucun|aucune|rien|vide|sans objet|s.o|non disponible|non renseigné|inconnu
ninguno|ninguna|nada|vacío|sin datos|sin valor|no aplica|no disponible|desconocido""".replace("\n", "|").split("|")
)
OPEN_ENDS = "-…(,–"

_TOKEN = re.compile(r"\d+(?:[.,/]\d+)*|[^\W\d_]+|[^\w\s]|_")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"^[\W_]+|[\W_]+$")
_MASK = (1 << BITS) - 1


@lru_cache(maxsize=1 << 17)
def _h(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode()) & _MASK


def bare(text: str) -> str:
    return _MARKS.sub("", re.sub(r"\\[tnr]", " ", text.lower()))


def is_empty(text: str | None) -> bool:
    """Null, or only blanks, marks or a word for "no value"."""
    return text is None or not (b := bare(text)) or b in NO_VALUE


@dataclass
class Model:
    vocabulary: frozenset[str]
    lang_w: np.ndarray
    lang_bias: np.ndarray
    w: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray


class _Kept(dict):
    """Values of a function of a word, kept for so many words."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        v = self.make(word)
        if len(self) < 1 << 17:
            self[word] = v
        return v


def _of_word(word: str) -> tuple[int, ...]:
    low = word.lower()
    if not (word[0].islower() or word.isupper()):
        return (_h("w", low),)
    p = f"<{low}>"
    return (_h("w", low), *(_h("c", p[i : i + 3]) for i in range(len(p) - 2)))


_SPOKEN = _Kept(_of_word)


def _lang_features(text: str) -> list[int]:
    return [f for word in _WORD.findall(text) for f in _SPOKEN[word]]


def language(model: Model, texts: list[str | None]) -> np.ndarray:
    """(texts, languages) scores; zero rows for texts without a word to go by."""
    f = [_lang_features(t) if t else [] for t in texts]
    starts = np.r_[0, np.cumsum([len(x) for x in f])].astype(np.int64)
    z = scores(model.lang_w, model.lang_bias, np.array([y for x in f for y in x], dtype=np.int64), starts)
    z[np.diff(starts) == 0] = 0
    return z


def _of_token(t: str) -> tuple[str, int]:
    """How a token is written if it is no known word, and its number."""
    form = "#" if t[0].isdigit() else t.lower() if not t[0].isalpha() else "XX" if t.isupper() and len(t) > 1 else "Xx" if t[0].isupper() else "xx"
    return form, zlib.crc32(form.encode())


def _stem(word: str) -> int:
    """The first five letters of a word in lower case; 0 for others, which may be names."""
    return _h("s", word[:5]) if word.islower() and len(word) > 3 else 0


_STEMS = _Kept(_stem)
_FORMS, _KNOWN = _Kept(_of_token), _Kept(lambda low: (low, zlib.crc32(low.encode())))


def _masked(vocabulary: frozenset[str], text: str) -> list[tuple[str, int]]:
    return [_KNOWN[low] if t[0].isalpha() and (low := t.lower()) in vocabulary else _FORMS[t] for t in _TOKEN.findall(text)]


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


_R = (0.2, 0.4, 0.55, 0.7, 0.8, 0.9, 0.97)
_N = (1, 2, 3, 4, 6, 8, 12, 18, 30, 60)
_GAP = (-4, -2, -1, -0.3, 0, 0.5, 2)


def pair_features(model: Model, q: str | None, a: str | None, lq: np.ndarray, la: np.ndarray) -> tuple[list[int], list[float]]:
    """Feature numbers and values of one pair. n-grams share GRAMS units of length, features of the pair count 1 each."""
    a = a or ""
    t = _masked(model.vocabulary, a)
    c = [x for _, x in t]
    grams = [(x * 0x9E3779B1 >> 7) & _MASK for x in c]
    grams += [s for w in _WORD.findall(a) if (s := _STEMS[w])]
    grams += [(x * 0x85EBCA6B + y * 0xC2B2AE35 >> 9) & _MASK for x, y in zip(c, c[1:])]
    grams += [(x * 0x27D4EB2F + y * 0x165667B1 + z * 0x9E3779B1 >> 11) & _MASK for x, y, z in zip(c, c[1:], c[2:])]
    end = a.rstrip()
    mark = "..." if end.endswith("...") else end[-1] if end and not end[-1].isalnum() else ""
    body = [x for x, _ in t if x[0].isalnum() or x == "#"]
    n = _bucket(len(body), _N)
    bodies = ["^", "^", "^", *body[-4:]]
    raw = _WORD.findall(end)
    shape = bodies[-1] if bodies[-1] in ("xx", "Xx", "XX", "#") else "v"
    f = [
        _h("n", n), _h("mark", mark), _h("mark", mark, n), _h("last", bodies[-1]), _h("last", bodies[-1], mark), _h("last2", *bodies[-2:]), _h("last3", *bodies[-3:]), _h("last4", *bodies[-4:]),
        _h("shape", shape, bool(mark)), _h("shape", shape, bool(mark), n), _h("short", min(4, len(raw[-1]) if raw else 0), mark == ""), _h("open", a.count("(") > a.count(")")), _h("first2", *(x for x, _ in t[:2])), _h("novalue", is_empty(a)), _h("openend", end[-1:] in OPEN_ENDS and bool(end), min(n, 4)),
    ]
    if q:
        qw, aw = {x for x in _TOKEN.findall(q.lower()) if x[0].isalnum()}, [x for x in _TOKEN.findall(a.lower()) if x[0].isalnum()]
        both = [x in qw for x in aw]
        r1, r2 = sum(both) / max(1, len(aw)), len(qw & set(aw)) / max(1, len(qw))
        new = len({x for x in aw if x[0].isdigit() and x not in qw})
        b1, b2 = _bucket(r1, _R), _bucket(r2, _R)
        f += [_h("r1", b1), _h("r2", b2), _h("r12", b1, b2), _h("new", min(new, 2), b1), _h("r12new", b1, b2, min(new, 2)), _h("newend", min(3, both[::-1].index(True) if True in both else 3), b1)]
        if lq.any() and la.any():
            i = int(lq.argmax())
            z = la.tolist()
            gap = _bucket(z.pop(i) - max(z), _GAP)
            f += [_h("lang", gap), _h("lang", gap, _bucket(len(raw), (1, 2, 4, 8)))]
    else:
        f.append(_h("noq"))
    return grams + f, [GRAMS / max(1.0, len(grams) ** 0.5)] * len(grams) + [1.0] * len(f)


def _matrix(model: Model, pairs: list[tuple[str | None, str | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lq, la = language(model, [q for q, _ in pairs]), language(model, [a for _, a in pairs])
    rows = [pair_features(model, q, a, x, y) for (q, a), x, y in zip(pairs, lq, la)]
    starts = np.r_[0, np.cumsum([len(r[0]) for r in rows])].astype(np.int64)
    return np.array([x for r in rows for x in r[0]], dtype=np.int64), starts, np.array([x for r in rows for x in r[1]], dtype=np.float32)


def _rows(ids: np.ndarray, starts: np.ndarray, value: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some rows of a matrix."""
    n = np.diff(starts)[rows]
    at = np.repeat(starts[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    return ids[at], np.r_[0, np.cumsum(n)], value[at]


def _cut(rng: np.random.Generator, a: str) -> str | None:
    """The answer broken off; up to five words only with a mark of breaking off, as without one they may be a short answer."""
    words = a.split()
    if len(words) < 7:
        return None
    if rng.random() < 0.1:
        return " ".join(words[: int(rng.integers(2, 6))]).rstrip(".,;:!?") + (" …", " ...", " (", ",", "-", " –")[int(rng.integers(6))]
    keep = int(rng.integers(max(5, len(words) // 3), len(words)))
    s = " ".join(words[:keep])
    if s[-1] in ".!?;":
        return None
    kind = rng.random()
    if kind < 0.35 and len(words[keep]) >= 4:
        return s + " " + words[keep][: int(rng.integers(1, len(words[keep]) - 1))] + ("-" if rng.random() < 0.4 else "")
    return s.rstrip(",") + ("", "", "", " …", " ...", " (", ",")[int(rng.integers(7))] if keep > 5 else None


def _short(rng: np.random.Generator, a: str) -> str | None:
    """A short answer: one to five words of a sound one, around a number or a name if it has any."""
    words = a.rstrip(" .!").split()
    held = [i for i, w in enumerate(words) if w[0].isdigit()] or [i for i, w in enumerate(words) if w[0].isupper()]
    if not held:
        return None
    i, n = held[int(rng.integers(len(held)))], int(rng.integers(1, 6))
    first = max(0, i - int(rng.integers(0, n)))
    s = " ".join(words[first : first + n]).strip(" ,;:(-–")
    return s[:1].upper() + s[1:] + ("", ".")[int(rng.integers(2))] if s and s[-1].isalnum() else None


def _copied(rng: np.random.Generator, q: str) -> str:
    s = q
    if rng.random() < 0.25:
        s = s.lower() if rng.random() < 0.6 else s.upper()
    if rng.random() < 0.25:
        s = s.rstrip(" ?.") + ("", ".")[int(rng.integers(2))]
    if rng.random() < 0.3:
        w = s.split()
        k = int(rng.integers(1, 3))
        s = " ".join(w[k:])
    if rng.random() < 0.1:
        s = f"{s.rstrip('?')}. {s}"
    if rng.random() < 0.1:
        w = s.split()
        i = int(rng.integers(max(1, len(w) - 1)))
        w[i : i + 2] = w[i : i + 2][::-1]
        s = " ".join(w)
    return ("{}", "{}", "{}", '"{}"', "You asked: {}", "Question: {}", "{} Answer:", "The question was: {}")[int(rng.integers(8))].format(s)


def _broken(model: Model, pairs: list[tuple[str, str]], seed: int) -> tuple[list[tuple[str | None, str | None]], np.ndarray, np.ndarray, np.ndarray]:
    """Pairs made from sound ones, their labels, which sound pair each is (-1: made), and which pair each was made from."""
    rng = np.random.default_rng(seed)
    lang = language(model, [q for q, _ in pairs]).argmax(axis=1)
    by = [np.flatnonzero(lang == i) for i in range(len(LANGUAGES))]
    out, y, of, made_from = [], [], [], []

    def add(q, a, defect: str | tuple | None, source: int = -1) -> None:
        out.append((q, a))
        y.append([d == defect or (isinstance(defect, tuple) and d in defect) for d in DEFECTS])
        of.append(source)
        made_from.append(i)

    for i, (q, a) in enumerate(pairs):
        add(q, a, None, i)
        if a.rstrip()[-1:] in ".!" and rng.random() < 0.5:
            add(q, a.rstrip(" .!"), None, i)
        for _ in range(2):
            if (c := _cut(rng, a)) and not kind_of(c):
                add(q, c, "truncated")
        if rng.random() < 0.6:
            add(q, _copied(rng, q), "copy")
        if rng.random() < 0.15:  # a full restatement with an answer is none
            add(q, f"{q.rstrip(' ?.')}: {a}", None, i)
        here = by[lang[i]]
        if len(here) > 1:
            add(q, pairs[int(rng.choice(here))][1], None, -1) if rng.random() < 0.3 else None
        other = [k for k in range(len(LANGUAGES)) if k != lang[i] and len(by[k])]
        if other:
            b = pairs[int(rng.choice(by[int(rng.choice(other))]))][1]
            if len(_WORD.findall(b)) >= 5:
                add(q, b, "other_language")
                if rng.random() < 0.1 and (c := _cut(rng, b)) and len(c.split()) > 8 and not kind_of(c):
                    add(q, c, ("other_language", "truncated"))
        own = LANGUAGES[lang[i]]
        for _ in range(2):
            if rng.random() < 0.6:
                add(q, draw(rng, REFUSALS[own]), "refusal")
        if rng.random() < 0.15:  # a refusal that names what was asked
            w = q.rstrip(" ?.").split()
            k = int(rng.integers(2, 6))
            add(q, f"{draw(rng, REFUSALS[own]).rstrip('.!')} ({' '.join(w[-k:])}).", "refusal")
        if rng.random() < 0.4:
            add(q, draw(rng, DENIALS[own]), None)
        if rng.random() < 0.35 and (c := _short(rng, a)):
            add(q, c, None)
        if rng.random() < 0.3:
            e = ["", " ", "-", "—", "...", "?", "[]", '""', "\\n", "--", ".", "***", "\n", *sorted(NO_VALUE)][int(rng.integers(13 + len(NO_VALUE)))]
            k = int(rng.integers(4))
            add(q, (e, e.upper(), e.capitalize() + ".", f"({e})")[k] if e.strip() and e[0].isalpha() else e, "empty")
    return out, np.array(y, dtype=np.float32), np.array(of), np.array(made_from)


def fit(pairs: list[tuple[str, str]], spoken: list[tuple[str, str]]) -> Model:
    """Fits on (question, answer) pairs, mostly sound, and on (text, language) examples."""
    words = Counter(w for q, a in pairs for t in {q, a} for w in {x.lower() for x in _WORD.findall(t)})
    vocabulary = frozenset(w for w, n in words.items() if n >= 4) | declining()
    k = len(LANGUAGES)
    model = Model(vocabulary, np.zeros((1 << BITS, k), np.float32), np.zeros(k, np.float32), np.zeros((1 << BITS, len(DEFECTS)), np.float32), np.full(len(DEFECTS), -1.0, np.float32), np.zeros(len(DEFECTS), np.float32))
    model.w[_h("novalue", True), 0] = 2.0  # all that is known without a pair to fit on
    texts, label = [t for t, l in spoken if l in LANGUAGES], [LANGUAGES.index(l) for _, l in spoken if l in LANGUAGES]
    pairs = [(q, a) for q, a in pairs if q and a and not is_empty(a) and not kind_of(a) and not kind_of(q)]
    if not texts or not pairs:
        return model

    def speak(texts: list[str], label: list[int]) -> None:
        f = [_lang_features(t) for t in texts]
        starts = np.r_[0, np.cumsum([len(x) for x in f])].astype(np.int64)
        model.lang_w, model.lang_bias = train(np.array([y for x in f for y in x], dtype=np.int64), starts, np.eye(k, dtype=np.float32)[label], 1 << BITS, steps=150)

    speak(texts, label)
    own = [t for p in pairs for t in p]
    for _ in range(2):  # question and answer mostly speak the same language; together they are surer
        z = language(model, own)
        z = np.repeat(z[0::2] + z[1::2], 2, axis=0)
        order = np.sort(z, axis=1)
        sure = order[:, -1] - order[:, -2] > 1
        speak(texts + [t for t, x in zip(own, sure) if x], label + z.argmax(axis=1)[sure].tolist())

    fold = np.array([zlib.crc32(a.encode()) % 5 for _, a in pairs])  # equal answers stay together
    fitted, held = [p for p, k in zip(pairs, fold) if k], [p for p, k in zip(pairs, fold) if not k]
    made, y, of, source = _broken(model, fitted, 11)
    ids, starts, value = _matrix(model, made)
    half = np.array([zlib.crc32(a.encode()) % 2 for _, a in fitted])
    doubtful = np.zeros(len(fitted), bool)
    for side in range(2):  # sound pairs are doubted by a fit that has not seen their answers
        w, bias = train(ids, starts, y, 1 << BITS, epochs=3, rate=0.3, value=value, weight=(half[source] != side).astype(np.float32))
        mine = np.flatnonzero((of >= 0) & (half[source] == side))
        z = scores(w, bias, *_rows(ids, starts, value, mine))
        doubtful[of[mine[(z > DOUBT).any(axis=1)]]] = True
    made, y, *_ = _broken(model, [p for p, x in zip(fitted, doubtful) if not x], 11)
    ids, starts, value = _matrix(model, made)
    model.w, model.bias = train(ids, starts, y, 1 << BITS, epochs=4, rate=0.3, value=value)
    z = scores(model.w, model.bias, *_matrix(model, held))
    made, y, *_ = _broken(model, [p for p, x in zip(held, (z > DOUBT).any(axis=1)) if not x], 12)
    z = scores(model.w, model.bias, *_matrix(model, made))
    for d in range(len(DEFECTS)):
        if y[:, d].sum() >= 20:
            model.thresholds[d] = min(1.0, max(-1.0, best_threshold(z[:, d], y[:, d] > 0, SOUND, LOW)))
    return model


def labels(model: Model, pairs: list[tuple[str | None, str | None]]) -> list[list[tuple[str, float]]]:
    """Every defect that the classifier finds in each pair, with its margin, the likeliest first; none for sound pairs.

    What is residue has no other defect than `empty`; without a question, or with residue for one, nothing is a copy or in another language. An
    `empty` that the classifier finds is checked exactly; what is empty has no other defect.
    """
    if not pairs:
        return []
    z = scores(model.w, model.bias, *_matrix(model, pairs)) - model.thresholds
    out: list[list[tuple[str, float]]] = []
    for (q, a), row in zip(pairs, z.tolist()):
        if max(row) < 0:
            out.append([])
            continue
        if row[0] >= 0 and is_empty(a):
            out.append([("empty", row[0])])
            continue
        if max(row[1:]) < 0 or kind_of(a):
            out.append([])
            continue
        asked = bool(q) and (max(row[3:]) < 0 or not kind_of(q))
        got = [(d, v) for d, v in list(zip(DEFECTS, row))[1 : None if asked else 3] if v >= 0]
        out.append(sorted(got, key=lambda x: -x[1]))
    return out


def judge(model: Model, pairs: list[tuple[str | None, str | None]]) -> list[tuple[str, float] | None]:
    """The likeliest defect and its margin of each pair, None for sound pairs and residue."""
    return [x[0] if x else None for x in labels(model, pairs)]


def defects(rows: DataFrame, model: Model, row_id: str, question: str, answer: str, abstained: str | None = None) -> DataFrame:
    """row_id, defect, margin, distinct, one row per defect of a pair. Where `abstained` is true nothing is a defect; null counts as false.

    Null questions, empty answers, repeated rows and empty tables are all allowed; null ids are left out.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)
    ids = rows.schema[row_id].dataType.simpleString()
    use = rows.filter(F.col(row_id).isNotNull())
    if abstained:
        use = use.filter(~F.coalesce(F.col(abstained), F.lit(False)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = labels(held.value, [(q if isinstance(q, str) else None, a if isinstance(a, str) else None) for q, a in zip(p.iloc[:, 1], p.iloc[:, 2])])
            yield pd.DataFrame([(i, *x) for i, g in zip(p.iloc[:, 0], got) for x in g], columns=["row_id", "defect", "margin"])

    return use.select(row_id, question, answer).mapInPandas(run, f"row_id {ids}, defect string, margin double").dropDuplicates(["row_id", "defect"])
