"""Twenty weighted checks of question-answer pairs against their evidence, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.predicates import WEAK_START
from quarry.functions.text import extract_all, jaccard, squeeze

# Patterns (case ignored), word lists, weights and the checks that fail a pair outright.
DEICTIC = r"\b(?:this|that|these|those|it|they|them|its|their|such)\b"
STARTERS = "why what how where when who whom whose which is are was were do does did can could may might must shall should will would has have had explain describe state list name give show in of".split()
REFERENT = r"\b(?:according to\s+)?(?:the|this|that)\s+(?:[a-z]+\s+){0,2}(?:description|result|figure|table|example|equation|method|approach|algorithm|theorem|chapter|section|paragraph|case|paper|study|distribution|formula|expression|graph|plot|diagram|model|process|procedure|operation|operator|function)\b"
SOURCE_REFERENT = r"\b(?:according to|based on|from|in)\s+(?:the\s+)?(?:description|text|passage|statement|provided information|facts?|given facts?|given statements?)\b|\b(?:in|from)\s+the\s+given\s+statements?\b"
CONTRAST = r"\b(?:rather than|instead of|other than|as opposed to|not the)\s+"
NAMED = r"\s*[A-Z0-9]|\s+(?:in|of|from)\s+[A-Z0-9]"
NUMBER = r"\b\d+(?:\.\d+)?\b"
NUMBER_WORD = r"\b(?:zero|one|two|three|four|five|six|seven|eight|nine|ten|single|a|an|both)\b"
TWO = r"\b(?:what|which|list|name|state)\s+two\b"
HOW_MANY = r"\bhow many\b|\bwhat number\b"
BROKEN_END = r"\b\w{3,}-\s*$"
WEAK_END = r"(?:^|[^\p{L}\p{N}_])(?:and|or|of|the|with|during|to|from|by|as|provide|include|suggest|describe|discuss|enable|allow|require|use|make|give|show|demonstrate|indicate|identify|present|produce|create|support|apply|involve|contain|represent|define)\.?$"
PAGE_PREFIX = r"^\d+\s+\d+\s+[A-Z]"
LEAK = r"\b(?:we need to answer|wait the facts|the facts\s*:|the facts are|the instruction:|the question asks|however we can infer|not explicitly|so we might|need to explain|i think|let's)\b"
SOURCES = r"\b(?:proceedings|workshop|conference|pp\.|eds?\.\)|\bed\.\)|technical report|tech\.?\s+report|dissertation|ph\.?\s*d\.?|\bthesis\b|university press|morgan kaufmann|springer|elsevier|journal|transactions|advances in neural information processing systems)\b|\b\d+\s*:\s*\d+\s*(?:--|-|–|—)\s*\d+\b"
FIGURE = r"\b(?:figure|chapter)\s+\d+(?:\.\d+)?\b|^[A-Z][A-Z\s]{8,}\s+\d+\s*!?$|\b\d+\s*!$"
ASKING = r"\?\s*$|\b(?:what|why|how|which|when|where|who)\b.+\?"
HEADING_LEAK = r"\b(?:chapter|section|figure|table|appendix)\s+\d+(?:\.\d+)*\b|^\s*[*∗]?\s*\d+(?:\.\d+)+\s+[A-Z]|^\s*(?:[A-Z][A-Z0-9()-]*\s+){1,5}[A-Z][A-Z0-9()-]*\s*[:.-]\s+"
CAPITALS = r"^\s*[A-Z][A-Z ]{8,}\s*$"
ABSTAINS = r"\b(?:insufficient information|not enough information|cannot be answered|cannot answer|no information is provided)\b"
TAUTOLOGY = r"\b(?:can now be explained|is explained by the facts|the facts explain|the answer is that|this means that it means)\b"
ARTIFACT = r"\b(?:page ranges?|references? titled|which chapter is titled|page numbers?|on which pages?|entries titled|exercise numbers?|publishing house|publisher|city for the \d{4} work|work authored by|work titled|title of the review|publications? mentioned|university'?s department|on pages?\s+\d+|journal|volume|conference|proceedings|provided notation|specific headings?|terms follow|given excerpt|mentioned in the statement|statement about|sentence stating|in the source|source text|listed in the source|as listed in the source|provided definition|provided fact|according to the definition)\b"
PROMPT_LEAK = r"""\b(?:check length|count words|meets min(?:imum)?|word count|that's \d+ words|output exactly one question|maybe we can ask|we could ask|we can ask|we should ask|we have a conflict|the user first gave|the instruction says|higher-level instruction|intent constraint|single-fact question|there'?s only one fact|there is only one fact|unable to create|could you please supply|only a single fact|we need to rewrite|only assert relationships|no second entity|answer unknown|return only|do not include|provided facts|given facts|source-grounding rules|we need a specific answer|combine with (?:second|first|the)|that's from (?:first|second|the)\s+fact|so question:|that's a phrase|so maybe:|we need to name|we need to identify|we need to specify|Count:\s*["']?\w|word\s+\d+\s*["'(])\b|\bAnswer:\s*['"]"""
PLACEHOLDER = r"(?:^|\W)(?:[A-Za-z]*\?{2,}|chapter[s]?\s+\?|section[s]?\s+\?|figure[s]?\s+\?|table[s]?\s+\?|appendix\s+\?)(?:\W|$)"
PHRASE = r"""\bdescribed by the phrase\b|\bwhat is said to\b|\bthe technique described\b|\bthe method described\b|\bthat situation\b|\bwhat (?:was|is|are|were) (?:said to|described as|referred to as)\b|\b(?:referred|referenced)\s+(?:to\s+)?in the phrase\b|\bin the phrase\s*["']|\bthe phrase\s*["']"""
SHORT_ENTITY, LONG_ANSWER = r"^(?:what|which|who|when|where)\b", r"\b(?:why|how|explain|describe|compare|relate)\b"
WEIGHTS = {
    "q1_deictic": 0.25, "q2_short": 0.10, "q3_echo": 0.10, "q4_generic": 0.35, "q5_scattered": 0.05, "q6_number": 0.10, "q7_fragment": 0.15, "q8_leak": 0.85, "q9_weak_evidence": 0.85, "q10_question": 0.85,
    "q11_heading": 0.85, "q12_abstains": 0.85, "q13_tautology": 0.85, "q14_short_fragment": 0.45, "q15_artifact": 0.85, "q16_prompt": 0.85, "q17_two": 0.85, "q18_count": 0.85, "q19_placeholder": 0.85, "q20_phrase": 0.85,
}
SOFT = ("q2_short", "q3_echo", "q5_scattered", "q6_number")
HARD = tuple(k for k in WEIGHTS if k not in SOFT)

WORD = r"[\p{L}\p{N}_]+"


def deictic(text: Column) -> Column:
    """Whether a demonstrative comes before any name or word of five letters that it could stand for."""
    before = F.filter(extract_all(F.regexp_extract(text, rf"(?is)^(.*?){DEICTIC}", 1), WORD), lambda w: ~F.lower(w).isin(*STARTERS))
    return text.rlike("(?i)" + DEICTIC) & ~F.exists(before, lambda w: w.rlike(r"^[A-Z][a-z]+$") | (F.length(w) >= 5))


def generic(text: Column) -> Column:
    """Whether a text leans on `the method`, `this figure` and the like, unless it is named or set against another."""
    rest = F.regexp_replace(F.regexp_replace(text, f"(?i){CONTRAST}{REFERENT}", " "), f"(?i:{REFERENT})(?:{NAMED})", " ")
    return text.rlike("(?i)" + SOURCE_REFERENT) | rest.rlike("(?i)" + REFERENT)


def bad_fragment(fact: Column) -> Column:
    """Whether a piece of evidence has no chunk or is cut off, too short or unresolved."""
    t = squeeze(F.coalesce(fact["text"], F.lit("")))
    return (
        (F.coalesce(fact["chunk_id"], F.lit("")) == "") | (t == "") | t.rlike(BROKEN_END) | t.rlike("(?i)" + WEAK_END) | t.rlike(PAGE_PREFIX) | (F.size(extract_all(t, r"\w+")) < 5) | deictic(t)
    )


def weak(fact: Column) -> Column:
    t = squeeze(F.coalesce(fact["text"], F.lit("")))
    return t.rlike(WEAK_START) | t.rlike("(?i)" + SOURCES) | t.rlike("(?i)" + FIGURE)


def checks(question: Column, answer: Column, facts: Column) -> dict[str, Column]:
    """Name to boolean column; facts: array<struct<text, chunk_id, doc_id>>. Nulls count as empty texts and no evidence."""
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    f = F.coalesce(facts, F.array().cast("array<struct<text:string,chunk_id:string,doc_id:bigint>>"))
    words = lambda c: F.array_distinct(extract_all(F.lower(c), WORD))
    has = lambda c, p: c.rlike("(?i)" + p)
    said = squeeze(a)
    place = F.filter(F.transform(f, lambda x: F.regexp_extract(x["chunk_id"], r"^.+_c0*(\d+)$", 1)), lambda x: x != "")
    places = F.transform(place, lambda x: x.cast("long"))
    docs = F.array_distinct(F.filter(F.transform(f, lambda x: x["doc_id"]), lambda x: x.isNotNull()))
    seen = F.flatten(F.transform(f, lambda x: extract_all(F.coalesce(x["text"], F.lit("")), NUMBER)))
    short_entity = has(squeeze(q), SHORT_ENTITY) & ~has(q, LONG_ANSWER)
    parts = F.filter(F.split(said, r"\s+(?:and|plus)\s+|[.;]"), lambda p: F.trim(p) != "")
    whole = F.concat_ws(" ", q, a, F.transform(f, lambda x: F.coalesce(x["text"], F.lit(""))))
    return {
        "q1_deictic": deictic(q),
        "q2_short": F.length(F.regexp_replace(a, r"^\s+|\s+$", "")) < 40,
        "q3_echo": jaccard(words(q), words(a)) > 0.7,
        "q4_generic": generic(q),
        "q5_scattered": (F.size(docs) > 1) | F.coalesce(F.array_max(places) - F.array_min(places) > 5, F.lit(False)),
        "q6_number": (F.size(f) > 0) & (F.size(F.array_except(extract_all(a, NUMBER), seen)) > 0),
        "q7_fragment": F.exists(f, bad_fragment),
        "q8_leak": has(a, LEAK),
        "q9_weak_evidence": F.exists(f, weak),
        "q10_question": has(a, ASKING),
        "q11_heading": has(a, HEADING_LEAK) | a.rlike(CAPITALS),
        "q12_abstains": has(a, ABSTAINS),
        "q13_tautology": has(a, TAUTOLOGY),
        "q14_short_fragment": (said == "") | (~short_entity & (F.size(extract_all(said, WORD)) < 6)),
        "q15_artifact": has(q, ARTIFACT),
        "q16_prompt": has(q, PROMPT_LEAK),
        "q17_two": has(q, TWO) & ~has(said, r"\b(?:two|both)\b") & (F.size(parts) < 2),
        "q18_count": has(q, HOW_MANY) & ~(a.rlike(NUMBER) | has(a, NUMBER_WORD)),
        "q19_placeholder": has(whole, PLACEHOLDER),
        "q20_phrase": has(q, PHRASE),
    }


def quality(found: dict[str, Column]) -> Column:
    """1 less the weights of the checks that fired; 0 where a hard one did."""
    penalty = sum((F.when(c, WEIGHTS[k]).otherwise(0.0) for k, c in found.items()), F.lit(0.0))
    hard = F.lit(False)
    for k in HARD:
        hard = hard | found[k]
    return F.when(hard, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - penalty / sum(WEIGHTS.values())), 3))


def checked(rows: DataFrame) -> DataFrame:
    """rows of question, answer and facts with a column per check and `quality`."""
    with_checks = rows.withColumns(checks(F.col("question"), F.col("answer"), F.col("facts")))
    return with_checks.withColumn("quality", quality({k: F.col(k) for k in WEIGHTS}))
