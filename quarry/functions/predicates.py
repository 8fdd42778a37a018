"""Classifiers and reject reasons as columns: first matching rule, scores as sums of terms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import content_tokens, extract_all, jaccard, squeeze

# Patterns of the rules, in the order in which they are tried.
ROLES = (
    ("constraint", r"\b(shall not|must not|is prohibited|is not allowed|is forbidden)\b"),
    ("rule", r"\b(must|shall|is required to|is mandatory)\b"),
    ("exception", r"\b(except|unless|however|notwithstanding|with the exception)\b"),
    ("condition", r"\b(if|when|provided that|in case|in the event)\b"),
    ("consequence", r"\b(therefore|thus|consequently|as a result|causes|leads to|results in)\b"),
    ("example", r"\b(for example|for instance|such as|e\.g\.|i\.e\.|including)\b"),
    ("definition", r"\b(is defined as|are defined as|means|refers to|is\s+(?:a|an|the)\s+\w+|are\s+(?:a|an|the)\s+\w+)\b"),
)
BOILERPLATE = (
    r"all rights reserved", r"no part of this (?:publication|document) may be reproduced", r"\bcopyright\b", r"©", r"\bisbn\b", r"\bdoi:\s", r"member bod(?:y|ies)\b", r"national standards? bod(?:y|ies)",
    r"technical committee\b", r"\bsubcommittee\b", r"the secretariat\b", r"patent rights?\b", r"identifying (?:any or all such )?patent", r"use of (?:the )?trade names?",
    r"does not imply (?:any )?(?:endorsement|recommendation|approval)", r"official (?:english )?version of (?:an?|this|the)\b", r"\bthe official version\b", r"prepared by (?:technical )?committee",
    r"in accordance with the .{0,40}directives", r"shall be (?:sent|addressed) to .{0,40}(?:secretariat|committee)", r"\bforeword\b", r"iso copyright office|www\.iso\.org|ecma-international\.org|www\.ecma",
    r"this (?:document|standard) supersedes", r"rights of use\b", r"adopted by (?:cen|iso|iec)\b", r"representation on (?:the )?technical committee",
)
PAGE_RANGE = r"\b(pp\.|pages?)\s*\d+\s*(?:--|-|–|—|to)\s*\d+\b|\b\d+\s*(?:--|-|–|—)\s*\d+\b|\b\d+\s*:\s*\d+\s*(?:--|-|–|—)\s*\d+\b"
BIBLIOGRAPHY = r"\b(proceedings|workshop|conference|journal|transactions|university press|morgan kaufmann|springer|elsevier|wiley|mit press|acm|ieee|cambridge university press|technical report|tech\.?\s+report|dissertation|ph\.?\s*d\.?|\bthesis\b|isbn|doi|arxiv|vol\.|no\.)\b"
REFERENCE_HEADING = r"^\s*(references|bibliography|works cited|further reading|index)\s*$"
TASK_HEADING = r"^\s*(exercise|exercises|problem|problems|questions|review questions)(?:\s+\d+(?:\.\d+)*)?\s*$"
TASK_PROMPT = r"^\s*(exercise|problem|question)\s+\d+(?:\.\d+)*\b|^\s*(show|prove|derive|calculate|compute)\b"
CAPTION = r"^\s*(figure|fig\.|table|chapter|section|appendix)\s+\d+(?:\.\d+)*[\s:.-]+|^\s*\d{1,4}\s*(chapter|section|appendix)\s+\d+(?:\.\d+)*"
URL_OR_EMAIL = r"\b(?:https?://|www\.|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
FRONT_MATTER = r"\b(copyright|creative commons|cc[- ]?by|license(?:d)?|free\s+pdf|low\s+cost\s+print|printed\s+version|textbook equity|saylor\.org|open textbook challenge|about the authors?|foreword|with contributions from|translated from|translator|published by|publisher|isbn|table of contents|contents|preface|dear reader|study guide|examinations?--study guides?|library of congress|catalog(?:ue|ing)?|all rights reserved|springer(?:\s+vieweg)?)\b"
ISO_CLAUSE = r"^\s*\d+(?:\.\d+)+\s+\S"
ISO_BOILERPLATE = r"\b(attention is drawn to the possibility|subject of patent rights|shall not be held responsible for identifying|cen[-‑– ]?cenelec internal regulations|national standards (?:bodies|organi[sz]ations) of|cen members are the national standards|the secretariat of which is held by|this (?:european|international) standard shall be given the status)\b"
COT_META = r"\b(we need to rewrite the passage|rewrite the passage so it can be understood|the passage (?:is|reads)\s*:\s*[\"'])"
CITATION_PREFIX = r"^\s*(?:\[\d+\]|\(\d{4}[a-z]?\)|[A-Z][A-Za-z-]+,\s+[A-Z]\.)"
NUMBERED_REFERENCE = r"^\s*\[\d{1,3}\]\s+\S"
# The strict rules in the order in which they are tried: (reason, pattern), case ignored; no pattern: see `special`.
STRICT = (
    ("reference_heading", REFERENCE_HEADING),
    ("source_task_heading", TASK_HEADING),
    ("source_task_prompt", TASK_PROMPT),
    ("caption_or_heading", CAPTION),
    ("embedded_caption_fragment", r"\b(?:figure|fig\.|table)\s+\d+(?:\.\d+)*\s*:"),
    ("algorithm_listing_fragment", None),
    ("section_prefix_fragment", r"^\s*[*∗]?\s*\d+(?:\.\d+)+\s+[A-Z]"),
    ("heading_prefix_fragment", None),
    ("source_wording", r"\b(the|this|that)\s+(above|following|preceding|given|provided)\s+(statement|text|passage|paragraph|description|example)\b"),
    ("source_figure_attribution", r"\breprinted\s+from\b|\b(?:results?|data)\s+in\s+(?:figure|table)\s+\d+(?:\.\d+)*\s+(?:are\s+)?(?:due\s+to|from)\b"),
    ("unresolved_source_reference", r"\b(?:algorithm|method|example|case)\s+(?:discussed|described|shown|introduced)\s+in\s+(?:the\s+)?(?:previous|preceding|following)\s+(?:section|figure|diagram)\b|^\s*(?:this|that)\s+(?:idea|example|diagram|relationship|case)\b|^\s*another\s+way\s+of\s+(?:saying|seeing)\s+this\b|^\s*(?:in\s+other\s+words|we\s+have\s+just\s+shown\s+that|this\s+means\s+that)\b|^\s*if\s+we\s+look\s+closely\s+at\s+(?:this|that|the)\s+example\b|\bas\s+in\s+the\s+(?:left|right)\s+(?:diagram|figure)\b"),
    ("visual_only_fact", r"^\s*(?:for\s+example,\s+)?(?:the\s+)?backup\s+diagram\s+(?:for|corresponding\s+to|showing)\b"),
    ("front_matter_artifact", URL_OR_EMAIL + "|" + FRONT_MATTER),
    ("author_bio", r"\b(holds a full professorship|received his ph\.?d|received her ph\.?d|\bco-?author of\b|peer-reviewed publications|served as program and general chair|chief consultant|founder and executive partner|you can find (?:more|further) information)\b"),
    ("source_release_header", r"\b(Computer Networking\s*:\s*Principles,\s*Protocols and Practice,\s*Release|Release\s+\d+(?:\.\d+)?)\b"),
    ("caption_or_heading", r"^[A-Z][A-Za-z0-9 ,:;'/()&+-]{4,80}\s+\d{1,4}\s+[A-Z][A-Za-z0-9 ,:;'/()&+-]{4,}"),
    ("dangling_section_reference", r"\b(?:in|section)\s+\d+(?:\.\d+)+\.?$"),
    ("named_citation_context", r"^\s*[A-Z][A-Za-z-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z-]+)?\s*\(\d{4}[a-z]?\)\s+(?:discussed|considered|introduced|proposed|studied|showed|reported)\b"),
    ("bibliography_or_citation", None),
    ("page_range_or_locator", None),
)
# Two of these in one text make a listing.
LISTING = (r"\brepeat\s*\(for each", r"\binitialize\s+[A-Z]", r"\btake action\b", r"\bchoose\s+[A-Z].*\busing policy\b", r"\bargmax\b|(?:←|<-)")
#: A fact scored below this for standing on its own is dropped by the relaxed rules.
SELF_CONTAINED = 0.75
TABLE_ARTIFACT_COLONS, GLUED = 4, r"[A-Za-z]{3,}\d"
DOTTED = r"\.{4,}|…"
STANDARD_ENTRY = r"(?i)\b(?:ISO|EN|DIN|IEC|ASTM|BS|AWS)(?:/TR|/TS)?\s*\d{2,5}(?:[-‑]\d+)?\s*,"
DANGLING = r"(?i)\b(?:in|of|on|to|from|for|with|by|than|as|into|within)\s+(?:those|these|that|them)\s*(?:[,.;:)]|$)"
PRINTOUT = r"(?i)\bprintout\b|\bdate and time\b[^.]*\d{1,2}:\d{2}|\b\d{4}-\d{2}-\d{2}\s*,?\s*\d{1,2}:\d{2}:\d{2}\b"
DEICTIC_OPENER = r"(?i)^\s*(?:this|it|these|those|that|they)\s+(?:can|is|are|was|were|will|would|may|might|makes?|means?|allows?|enables?|provides?|leads?|causes?|ensures?|results?|shows?|suggests?|implies?|indicates?|represents?|demonstrates?|has|have|had|does|do|did)\b"
YES_NO = r"(?i)^(is|are|am|does|do|did|was|were|has|have|had|can|could|should|will|would|shall|may|might|must)\b"
ABSTENTION = r"(?i)\b(insufficient information|not enough information|cannot be answered|cannot answer|no information is provided|unable to answer|does not contain (?:enough|sufficient) information)\b"
GENERIC = r"(?i)\b(?:the|this|that)\s+(?:[a-z]+\s+){0,2}(description|result|figure|table|example|equation|method|approach|algorithm|theorem|chapter|section|paragraph|case|paper|study|distribution|formula|expression|graph|plot|diagram|model|process|procedure|operation|operator|function)\b"
SOURCE_META = r"\b(copyright|license|creative commons|free pdf|low[- ]cost print|website|url|textbook equity|saylor|author|authors|translated|translator|publisher|isbn|study guide|examination study guides?|catalog|about the authors|foreword|preface|table of contents)\b"
SOURCE_FRAME = r"\baccording to the statement\b|\bprovided facts\b"
WEAK_START = r"(?i)^(before we are done|in other words|moreover|however|of course|as a hint|these methods|this method|this problem|this number|this is|such methods|we consider|we use this problem)\b"
LABELS = ("CAUSES", "REQUIRES", "DEFINES", "CONDITION", "EXCEPTION", "CONSTRAINS", "EXAMPLE", "CONSEQUENCE")


def first_match(text: Column, rules: tuple, otherwise: str | None) -> Column:
    out = F.lit(otherwise)
    for reason, pattern in reversed(rules):
        out = F.when(text.rlike("(?i)" + pattern), F.lit(reason)).otherwise(out)
    return out


def role(text: Column) -> Column:
    return first_match(text, ROLES, "definition")


def boilerplate(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(BOILERPLATE)), F.lit(False))


def structural_quality(text: Column) -> Column:
    """0 for what extraction garbled, else 0.5 and up to 0.5 for the marks of a statement."""
    words = extract_all(F.lower(text), "[a-z0-9_]+")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    broken = text.contains("�") | text.rlike(r"\(cid:\d+\)") | (F.size(words) < 3) | (letters / F.greatest(F.length(text), F.lit(1)) < 0.6) | (F.size(F.array_distinct(words)) < 3)
    n = F.size(extract_all(text, r"\S+"))

    def term(c: Column, x: float) -> Column:
        return F.when(c, x).otherwise(0.0)

    score = (
        F.lit(0.5)
        + term(text.rlike("[.:;]"), 0.1)
        + term(text.rlike(r"(?i)\b(is|are|was|were|shall|must|should|can|could|will|would)\b"), 0.1)
        + term(text.rlike(r"(?i)\b(not|no|never|neither|nor)\b"), 0.1)
        + term(n >= 5, 0.1)
        + term(n >= 10, 0.05)
        + term(text.rlike(r"\d"), 0.05)
    )
    return F.when(F.coalesce(broken, F.lit(True)), 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 6))


def table_artifact(text: Column) -> Column:
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    return (colons >= TABLE_ARTIFACT_COLONS) | (F.size(extract_all(text, GLUED)) >= 3) | text.rlike(DOTTED)


def reference_dump(text: Column) -> Column:
    return F.size(extract_all(text, STANDARD_ENTRY)) >= 3


def bare_heading(text: Column) -> Column:
    return text.rlike(r"^\s*\d{1,2}\s+[A-Z][A-Za-z]") & ~text.rlike(r"[.?!]\s*$") & (F.size(extract_all(text, r"\S+")) <= 10)


def _ascii_letters() -> tuple[str, str]:
    """Accented Latin letters and what they are without accents."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0xA0, 0x250)]
    return "".join(a for a, b in pairs if len(b) == 1), "".join(b for _, b in pairs if len(b) == 1)


ACCENTED, PLAIN = _ascii_letters()
LIGATURES = tuple((chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xFB00, 0xFB05))
OTHER = r"[^\x00-\x7F]"


def ascii_of(text: Column) -> Column:
    """The text without accents and without what is no ASCII character; ligatures become their letters."""
    for a, b in LIGATURES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), OTHER, "")


def heading_prefix(text: Column) -> Column:
    """Whether a text of five words and more begins with three words in capitals, or two long ones."""
    words = extract_all(text, "[A-Za-z][A-Za-z0-9-]*")
    low = F.array_position(F.transform(F.slice(words, 1, 6), lambda w: (F.length(w) > 1) & (F.upper(w) == w)), F.lit(False)).cast("int")
    run = F.when(low > 0, low - 1).otherwise(F.least(F.size(words), F.lit(6)))
    long = F.forall(F.slice(words, F.lit(1), run), lambda w: F.length(w) > 3)
    return (F.size(words) >= 5) & (run < F.size(words)) & ((run >= 3) | ((run >= 2) & long))


def strict_reason(text: Column, excluded: Column | None = None) -> Column:
    """The first of the strict rules a text breaks, or null. White space is collapsed and accents are dropped first.

    excluded: whether the fact lies in a part of its document that is left out.
    """
    t = squeeze(text)
    plain = ascii_of(t)
    has = lambda p: plain.rlike("(?i)" + p)
    special = {
        "algorithm_listing_fragment": sum((t.rlike("(?i)" + p).cast("int") for p in LISTING), F.lit(0)) >= 2,
        "heading_prefix_fragment": heading_prefix(plain),
        "bibliography_or_citation": has(BIBLIOGRAPHY) & (plain.rlike(CITATION_PREFIX) | has(PAGE_RANGE)),
        "page_range_or_locator": has(PAGE_RANGE) & (F.size(extract_all(plain, r"\S+")) <= 16),
    }
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(STRICT):
        out = F.when(has(pattern) if pattern else special[reason], reason).otherwise(out)
    if excluded is not None:
        out = F.when(excluded, "excluded_source_section").otherwise(out)
    return F.when(t.isNull() | (t == ""), "empty_text").otherwise(out)


def relaxed_reason(text: Column, raw: Column | None = None, self_containment: Column | None = None, front: Column | None = None) -> Column:
    """The first of the rules for standards and reports that a text breaks, or null.

    raw: the text before it was rewritten; self_containment: a score, null where unknown; front: whether the fact stands
    on a page of front matter.
    """
    t = squeeze(text)
    plain = ascii_of(t)
    n = F.size(extract_all(t, r"\S+"))
    clause = t.rlike(ISO_CLAUSE)
    low = t.rlike(r"^\p{Ll}+(\s|$)")
    fragment = ~clause & (t.rlike(r"^\s*(?:[—–•*]|--?)\s+") | (n < 5) | (low & ((n < 8) | t.rlike(r"\b[a-z]\)\s"))))
    nothing = F.lit(False)
    before = squeeze(raw) if raw is not None else F.lit(None).cast("string")
    was = (before != "") & (before != t) if raw is not None else nothing
    rules = (
        ("table_artifact_raw", was & table_artifact(before)),
        ("reference_list_dump_raw", was & reference_dump(before)),
        ("reference_heading", plain.rlike("(?i)" + REFERENCE_HEADING)),
        ("source_task_heading", plain.rlike("(?i)" + TASK_HEADING)),
        ("source_task_prompt", plain.rlike("(?i)" + TASK_PROMPT)),
        ("front_matter_artifact", plain.rlike("(?i)" + FRONT_MATTER)),
        ("bibliography", plain.rlike("(?i)" + BIBLIOGRAPHY)),
        ("iso_boilerplate", t.rlike("(?i)" + ISO_BOILERPLATE)),
        ("numbered_reference", t.rlike(NUMBERED_REFERENCE)),
        ("reference_list_dump", reference_dump(t)),
        ("table_artifact", table_artifact(t)),
        ("bare_numbered_heading", bare_heading(t)),
        ("dangling_anaphora", t.rlike(DANGLING)),
        ("printout_metadata", t.rlike(PRINTOUT)),
        ("cot_meta_leak", t.rlike("(?i)" + COT_META)),
        ("fragment", fragment),
        ("weak_self_containment", nothing if self_containment is None else F.coalesce(self_containment < SELF_CONTAINED, nothing)),
        ("front_matter_page", nothing if front is None else F.coalesce(front, nothing) & ~clause),
        ("caption_or_heading", plain.rlike("(?i)" + CAPTION) & ~clause),
    )
    out = F.lit(None).cast("string")
    for reason, c in reversed(rules):
        out = F.when(c, reason).otherwise(out)
    return F.when(t.isNull() | (t == ""), "empty_text").otherwise(out)


def minimal_reason(text: Column) -> Column:
    t = squeeze(text)
    plain = ascii_of(t)
    return F.when(t.isNull() | (t == ""), "empty_text").when(plain.rlike("(?i)" + REFERENCE_HEADING), "reference_heading").when(plain.rlike("(?i)" + BIBLIOGRAPHY), "bibliography").when(F.length(t) < 20, "too_short")


def tier(doc_type: Column) -> Column:
    return F.when(doc_type.isin("TEXTBOOK", "NARRATIVE"), "strict").when(doc_type.isin("ISO_STANDARD", "REPORT"), "relaxed").otherwise("minimal")


def adaptive_reason(text: Column, doc_type: Column, front: Column | None = None) -> Column:
    t = tier(doc_type)
    return F.when(t == "strict", strict_reason(text)).when(t == "relaxed", relaxed_reason(text, front=front)).otherwise(minimal_reason(text))


def structure_reason(question: Column, answer: Column) -> Column:
    """Why a pair is no proper question with an answer, or null."""
    q, a = F.trim(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(answer, F.lit("")))
    return (
        F.when(F.length(q) < 15, "question too short")
        .when(F.size(extract_all(q, r"\S+")) < 4, "question has fewer than 4 words")
        .when(F.length(a) < 1, "answer is empty")
        .when(~q.contains("?"), "not a question")
        .when(q.rlike(YES_NO), "yes/no question")
    )


def question_reject_reason(question: Column, answer: Column) -> Column:
    """Why a question is about its source instead of its subject, or null; nulls count as empty."""
    both = F.concat_ws(" ", F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("")))
    return F.when(both.rlike("(?i)" + SOURCE_META), "source_meta_question").when(F.coalesce(question, F.lit("")).rlike("(?i)" + SOURCE_FRAME), "source_framed_question")


def tautology(question: Column, answer: Column) -> Column:
    """Less than a quarter of the answer's content words are new."""
    a, q = content_tokens(answer), content_tokens(question)
    return F.coalesce((F.size(a) > 0) & (F.size(F.array_except(a, q)) / F.size(a) < 0.25), F.lit(False))


def compound(question: Column) -> Column:
    marks = F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit("")))
    return F.coalesce((F.size(extract_all(question, r"\S+")) > 26) | question.rlike(r"(?i)\band (what|which|how|why|who|when|where)\b") | (marks > 1), F.lit(False))


def numbered_words(question: Column) -> Column:
    return F.coalesce(question.rlike(r"[A-Za-z]+\(\d+\)|[A-Za-z]{2,}\d+\s+[A-Za-z]{2,}\d+"), F.lit(False))


def echo(question: Column, answer: Column) -> Column:
    words = lambda c: F.array_distinct(extract_all(F.lower(c), r"[\p{L}\p{N}_]+"))
    return F.coalesce(jaccard(words(question), words(answer)) > 0.7, F.lit(False))


def abstains(answer: Column) -> Column:
    return F.coalesce(answer.rlike(ABSTENTION), F.lit(False))


def surface_state(surface: Column) -> Column:
    """`ok` or why a phrase can't serve as a bridge."""
    s = squeeze(F.coalesce(surface, F.lit("")))
    return F.when(s == "", "empty").when(F.length(s) < 5, "too_short").when(~s.rlike("[A-Za-z]{3,}"), "no_content_token").otherwise("ok")


def hop_class(pages: Column, order: Column, window: int = 3) -> Column:
    """single, same_page, cross_near, cross_strict or deep, by the pages and places in reading order of a chain's facts."""
    depth = F.size(pages)
    known = F.forall(pages, lambda p: p.isNotNull())
    spread = F.when(known, F.array_max(pages) - F.array_min(pages))
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(order) - 1, F.lit(1))), lambda i: F.abs(F.try_element_at(order, i + 1) - F.try_element_at(order, i)))
    far = F.coalesce(F.array_max(gaps), F.lit(0)) > window
    return (
        F.when(depth >= 3, "deep")
        .when(depth <= 1, "single")
        .when(F.coalesce(spread, F.lit(0)) == 0, F.when(far, "same_page").otherwise("single"))
        .when(spread >= 2, "cross_strict")
        .otherwise("cross_near")
    )


def edge_label(raw: Column) -> Column:
    c = F.upper(F.trim(raw))
    return F.when(c.isin(*LABELS), c).otherwise("UNKNOWN")
