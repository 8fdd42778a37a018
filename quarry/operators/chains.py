"""Chains of facts: twelve weighted signals, a bounded second pass, reasons to drop a chain, and the yield of a document."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.predicates import DEICTIC_OPENER, role, strict_reason
from quarry.functions.text import content_tokens, extract_all, squeeze

# Weights of the signals, strengths of relations and priors of pairs of roles.
WEIGHTS = {"length": 0.06, "fragment": 0.10, "page_compactness": 0.05, "role_variety": 0.08, "lexical_bridge": 0.10, "typed_edge_confidence": 0.16, "edge_joint_only_margin": 0.25, "answer_contribution_score": 0.30, "relation_type_strength": 0.20, "source_text_quality": 0.20, "compositional_actionability": 0.0, "multi_hop_questionability": 0.18}
STRENGTH = {"mechanism": 1.00, "causal": 0.95, "procedural": 0.90, "temporal": 0.82, "quantitative": 0.80, "contrast": 0.78, "comparison": 0.76, "intersection": 0.72, "condition": 0.70, "consequence": 0.70, "rule": 0.68, "exception": 0.66, "constraint": 0.64, "definition": 0.38, "descriptive": 0.32, "list": 0.20}
ACTIONABLE = {"mechanism": 1.00, "causal": 0.96, "procedural": 0.92, "condition": 0.86, "consequence": 0.86, "temporal": 0.82, "quantitative": 0.78, "contrast": 0.76, "comparison": 0.74, "intersection": 0.68, "rule": 0.62, "exception": 0.60, "constraint": 0.60, "definition": 0.26, "descriptive": 0.22, "list": 0.14}
UNKNOWN_RELATION = 0.40
ACTIONABLE_ROLES = {
    ("definition", "condition"): 0.86, ("condition", "definition"): 0.80, ("definition", "rule"): 0.72, ("rule", "definition"): 0.64, ("condition", "rule"): 0.82, ("rule", "condition"): 0.78, ("condition", "condition"): 0.74, ("mechanism", "condition"): 0.84,
    ("condition", "mechanism"): 0.84, ("definition", "mechanism"): 0.78, ("mechanism", "definition"): 0.72, ("definition", "definition"): 0.20, ("definition", "example"): 0.28, ("example", "definition"): 0.24, ("example", "example"): 0.18,
}
QUESTIONABLE_ROLES = {
    ("definition", "condition"): 1.00, ("definition", "rule"): 0.86, ("condition", "definition"): 0.74, ("rule", "definition"): 0.70, ("condition", "consequence"): 0.76, ("definition", "consequence"): 0.68, ("definition", "example"): 0.58, ("example", "definition"): 0.54,
    ("condition", "rule"): 0.72, ("rule", "condition"): 0.70, ("definition", "definition"): 0.42,
}
RELATION_BONUS = {"contrast": 0.12, "comparison": 0.12, "causal": 0.10, "procedural": 0.10, "intersection": 0.08, "descriptive": 0.02, "definition": 0.00}
OTHER_BONUS = 0.04
STOPWORDS = "the a an is are was were be been being in on at to for of and or but not with this that it its by from as into than then these those which while where when".split()
MATH = r"(?:[∑∏πλγτ∗∞≈≤≥¯]|\b(?:lim|frac|sum)\b|[A-Za-z]\s*[=<>]\s*[A-Za-z0-9])"
EQUATION = r"^\s*(?:[A-Za-z]\s*,|\(?\d+(?:\.\d+)?\)?|[A-Za-z]\s*[=<>]|[∑∏πλγτ∗∞≈≤≥¯])"
SYMBOLS = "[=<>∑∏πλγτ∗∞≈≤≥¯]"
ACTION = r"(?i)\b(?:causes?|leads?|requires?|depends?|enables?|prevents?|limits?|changes?|updates?|chooses?|observes?|approximates?|estimates?|improves?|reduces?|produces?|results?|follows?|affects?|determines?|controls?|uses?|applies?|turns?|assigns?|receives?|selects?|maximi[sz]es?|minimi[sz]es?)\b"
UNRESOLVED = r"(?i)^\s*(?:this|these|that|those|it|its|such|they|their|in these cases|accordingly)\b"
CONDITION_CUE = r"(?i)\b(?:if|when|whenever|unless|provided|only if|in cases?|under|once)\b"
SETUP_CUE = r"(?i)\b(?:is|are|means|defines?|represents?|refers? to|to use|once one has|we know)\b"
WEAK_START = r"(?i)^(before we are done|in other words|moreover|however|of course|as a hint|these methods|this method|this problem|this number|this is|such methods|we consider|we use this problem)\b"
#: Pages over which a chain is no longer compact; least scores of the passes; share of the second score.
MAX_PAGE_GAP, MIN_PASS1, MIN_FINAL, SECOND_SHARE, RERANKED = 40, 0.40, 0.45, 0.15, 80


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _six(x: Column) -> Column:
    """Six places; a value between two is moved up, so that engines agree."""
    return F.round(x + 1e-9, 6)


def _of(key: Column, values: dict, otherwise: Column) -> Column:
    for k, v in values.items():
        otherwise = F.when(key == k, F.lit(v)).otherwise(otherwise)
    return otherwise


def _mean(values: Column) -> Column:
    """0 for an empty array."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(0.0)


def math_risk(text: Column) -> Column:
    """How likely a text is a piece of a formula, from 0 to 1."""
    t = squeeze(text)
    symbols = F.size(extract_all(t, SYMBOLS))
    risk = F.when(t.rlike(EQUATION), 0.65).otherwise(0.0) + F.least(F.lit(0.5), F.size(extract_all(t, MATH)) * 0.12) + F.least(F.lit(0.45), symbols / F.greatest(F.length(t), F.lit(1)) * 10.0)
    return F.when(t == "", 1.0).otherwise(_clamp(risk))


def action(text: Column) -> Column:
    return _clamp(F.size(extract_all(F.coalesce(text, F.lit("")), ACTION)) / 2)


def fact_features(facts: DataFrame) -> DataFrame:
    """fact_id and `f`, all that a chain needs to know of a fact: each text is looked at once, whatever chains it is in.

    facts: fact_id, doc_id, chunk_id, text, page_start; page_end, char_start, self_containment where there are such columns.
    """
    t, has = F.col("text"), lambda c, kind: F.col(c) if c in facts.columns else F.lit(None).cast(kind)
    words = F.filter(F.array_distinct(extract_all(F.lower(t), "[a-z][a-z0-9_]{2,}")), lambda w: ~w.isin(*STOPWORDS))
    f = F.struct(
        "fact_id", "doc_id", "chunk_id", "page_start", has("page_end", "int").alias("page_end"), has("char_start", "int").alias("char_start"), has("self_containment", "double").alias("self_containment"), role(t).alias("role"), F.length(F.trim(t)).alias("n"),
        F.lower(squeeze(t)).alias("norm"), strict_reason(t).isNotNull().alias("fragment"), (1 - math_risk(t)).alias("clean"), action(t).alias("action"), words.alias("words"), content_tokens(t).alias("content"), t.rlike(UNRESOLVED).alias("unresolved"), t.rlike(CONDITION_CUE).alias("condition"),
        t.rlike(SETUP_CUE).alias("setup"), squeeze(t).rlike(DEICTIC_OPENER).alias("deictic"), squeeze(t).rlike(WEAK_START).alias("weak"),
    )
    return facts.select("fact_id", f.alias("f"))


def signals(facts: Column, edges: Column, median: Column) -> dict[str, Column]:
    """The twelve signals of a chain, each from 0 to 1.

    facts: the features in order; edges: between neighbours, structs of type (lower case), typed, confidence, margin,
    contribution, action; a null edge counts 0. median: of the lengths of the document's facts. Chains of one fact have no
    edge signals; an empty chain has all 0.
    """
    n = F.size(facts)
    at = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    pairs = F.filter(F.transform(at, lambda i: F.struct(F.try_element_at(facts, i).alias("a"), F.try_element_at(facts, i + 1).alias("b"), F.try_element_at(edges, i).alias("e"))), lambda p: p["b"].isNotNull())
    zero = lambda c: _clamp(F.coalesce(c.cast("double"), F.lit(0.0)))
    of_edges = lambda g: _mean(F.transform(pairs, lambda p: zero(g(p["e"]))))
    label = lambda p: F.coalesce(p["e"]["type"], F.lit(""))
    roles = lambda p: F.concat_ws("|", p["a"]["role"], p["b"]["role"])
    by_pair = lambda d: {"|".join(k): v for k, v in d.items()}
    differ = lambda p, x, y: F.when(p["a"]["role"] != p["b"]["role"], x).otherwise(y)
    both_define = lambda p: (p["a"]["role"] == "definition") & (p["b"]["role"] == "definition")
    pages = F.filter(F.concat(F.transform(facts, lambda f: f["page_start"]), F.transform(facts, lambda f: f["page_end"])), lambda p: p.isNotNull())
    span = F.when(F.size(pages) >= 2, F.array_max(pages) - F.array_min(pages)).otherwise(0)
    overlap = lambda p: F.when((F.size(p["a"]["words"]) > 0) & (F.size(p["b"]["words"]) > 0), F.size(F.array_intersect(p["a"]["words"], p["b"]["words"])) / F.least(F.size(p["a"]["words"]), F.size(p["b"]["words"]))).otherwise(0.0)
    quality = _clamp(_mean(F.transform(facts, lambda f: f["clean"])))
    margin = of_edges(lambda e: e["margin"])
    weak = F.size(F.filter(pairs, lambda p: (label(p) == "definition") & both_define(p)))
    risky = F.size(F.filter(facts, lambda f: f["unresolved"]))
    act = (
        0.28 * _mean(F.transform(pairs, lambda p: _of(label(p), ACTIONABLE, F.lit(UNKNOWN_RELATION))))
        + 0.18 * _mean(F.transform(pairs, lambda p: _of(roles(p), by_pair(ACTIONABLE_ROLES), differ(p, 0.58, 0.42))))
        + 0.20 * margin
        + 0.18 * _mean(F.transform(pairs, lambda p: 0.5 * p["a"]["action"] + 0.5 * p["b"]["action"]))
        + 0.16 * of_edges(lambda e: e["action"])
    )
    act = act * (0.70 + 0.30 * quality) - 0.14 * weak - _clamp(0.18 * risky)

    def asked(p: Column) -> Column:
        bonus = F.when((p["b"]["role"] == "condition") & p["b"]["condition"], 0.16).otherwise(0.0) + F.when((p["a"]["role"] == "condition") & p["a"]["condition"], 0.08).otherwise(0.0) + F.when((p["a"]["role"] == "definition") & p["a"]["setup"], 0.08).otherwise(0.0)
        lookup = F.when(label(p).isin("definition", "descriptive") & both_define(p), 0.18).otherwise(0.0)
        return _clamp(_of(roles(p), by_pair(QUESTIONABLE_ROLES), differ(p, 0.50, 0.34)) + bonus + _of(label(p), RELATION_BONUS, F.lit(OTHER_BONUS)) - lookup)

    multi = n > 1
    out = {
        "length": _clamp(_mean(F.transform(facts, lambda f: f["n"].cast("double"))) / F.greatest(F.lit(1.0), median)),
        "fragment": 1 - F.size(F.filter(facts, lambda f: f["fragment"])) / n,
        "page_compactness": 1 - _clamp(span / MAX_PAGE_GAP),
        "role_variety": _clamp(F.size(F.array_distinct(F.filter(F.transform(facts, lambda f: f["role"]), lambda r: r.isNotNull()))) / n),
        "lexical_bridge": _mean(F.transform(pairs, overlap)),
        "typed_edge_confidence": of_edges(lambda e: F.when(e["typed"], e["confidence"])),
        "edge_joint_only_margin": margin,
        "answer_contribution_score": of_edges(lambda e: e["contribution"]),
        "relation_type_strength": _mean(F.transform(pairs, lambda p: F.when(p["e"].isNull(), 0.0).otherwise(_of(label(p), STRENGTH, F.lit(UNKNOWN_RELATION))))),
        "source_text_quality": quality,
        "compositional_actionability": F.when(multi, _clamp(act)).otherwise(0.0),
        "multi_hop_questionability": F.when(multi, _clamp(_mean(F.transform(pairs, asked)) * (0.75 + 0.25 * quality))).otherwise(0.0),
    }
    return {k: _six(F.when(n > 0, _clamp(c)).otherwise(0.0)) for k, c in out.items()}


def category(facts: Column, edges: Column) -> Column:
    typed = F.forall(edges, lambda e: F.coalesce(e["typed"], F.lit(False)))
    return F.when(F.size(facts) <= 1, "fb").when((F.size(edges) > 0) & typed, "typed_mh").otherwise("untyped_mh")


def score(chains: DataFrame) -> DataFrame:
    """chains (facts, edges, median) with the signals, `pass1`, their weighted mean, and `category`."""
    s = chains.withColumns(signals(F.col("facts"), F.col("edges"), F.col("median")))
    pass1 = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    return s.withColumns({"pass1": _six(_clamp(pass1)), "category": category(F.col("facts"), F.col("edges"))})


def second_pass(scored: DataFrame, compat: Column, by: list[str], order: list[str], attempts: int, most: int = RERANKED) -> DataFrame:
    """scored with `reranked`, `final` and `kept`: the best chains of each group by pass1 are scored a second time.

    At most `most`, and one and a half times `attempts`, of those that reach MIN_PASS1; compat: the second score, from 0 to 1.
    """
    limit = max(0, min(most, math.ceil(1.5 * max(0, attempts))))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("pass1"), *order))
    again = (F.col("pass1") >= MIN_PASS1) & (rank <= limit)
    final = F.when(F.col("reranked"), _six(_clamp(F.col("pass1") * (1 - SECOND_SHARE) + _clamp(compat) * SECOND_SHARE))).otherwise(F.col("pass1"))
    return scored.withColumn("reranked", again).withColumn("final", final).withColumn("kept", (F.col("final") >= MIN_FINAL) | (F.col("category") == "fb"))


def filter_reason(
    facts: Column, mode: str = "multihop", hops: tuple[int, int] = (2, 4), chunks: int = 1, roles: int = 1, pages: int = 1, char_gap: int = 0, gate: bool = True, max_page_gap: int = MAX_PAGE_GAP, self_contained: float | None = None, unknown_too: bool = False
) -> Column:
    """Why a chain is dropped, or null: the first of its rules on depth, repeats, distinct chunks, roles and pages, distance, quality and self-containment."""
    n = F.size(facts)
    get = lambda c: F.transform(facts, lambda f: f[c])
    some = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull()))
    paged, starts = some(F.concat(get("page_start"), get("page_end"))), F.filter(get("char_start"), lambda x: x.isNotNull())
    gap = F.when(F.size(starts) >= 2, F.array_max(starts) - F.array_min(starts)).otherwise(0)
    at = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    apart = F.exists(at, lambda i: F.coalesce(F.size(F.array_intersect(F.try_element_at(facts, i)["content"], F.try_element_at(facts, i + 1)["content"])) < 1, F.lit(False)))
    far = F.coalesce(F.array_max(paged) - F.array_min(paged) > max_page_gap, F.lit(False))
    rules = [
        ("question_mode_singlehop", (n != 1) if mode == "singlehop" else F.lit(False)),
        ("question_mode_multihop", (n < 2) if mode == "multihop" else F.lit(False)),
        ("depth_out_of_range", (n < hops[0]) | (n > hops[1])),
        ("duplicate_fact_text", F.size(F.array_distinct(get("norm"))) < n),
        ("insufficient_distinct_chunks", F.size(some(get("chunk_id"))) < chunks),
        ("insufficient_distinct_roles", F.size(some(get("role"))) < roles),
        ("insufficient_distinct_pages", (F.size(paged) > 0) & (F.size(paged) < pages)),
        ("insufficient_char_gap", (gap < char_gap) if char_gap > 0 else F.lit(False)),
    ]
    if gate:
        rules += [
            ("chain_quality:weak_context_fragment", F.exists(facts, lambda f: f["weak"])),
            ("chain_quality:source_gap_too_large", far),
            ("chain_quality:empty_fact_terms", (n > 1) & F.exists(facts, lambda f: F.size(f["content"]) == 0)),
            ("chain_quality:unconnected_fact", (n > 1) & apart),
        ]
    if self_contained is not None:
        rules.append(("c3_low_self_containment", F.exists(facts, lambda f: F.coalesce(f["self_containment"] < self_contained, F.lit(False)))))
        if unknown_too:
            rules.append(("c3_unknown_self_containment", F.exists(facts, lambda f: f["self_containment"].isNull())))
    rules.append(("deictic_opener_unresolved", F.exists(facts, lambda f: f["deictic"])))
    out = F.lit(None).cast("string")
    for reason, c in reversed(rules):
        out = F.when(c, reason).otherwise(out)
    return out


# Share of typed chains wanted; shares of the target that other categories may fill; attempts per acceptance.
FLOOR, UNTYPED_CAP, FALLBACK_CAP, TRIES = 0.60, 0.10, 0.40, 3


def caps(target: int) -> dict[str, tuple[int, int]]:
    """Category to the most attempts and acceptances; 0: no cap."""
    out = {"typed_mh": (0, 0)}
    for name, share in (("untyped_mh", UNTYPED_CAP), ("fb", FALLBACK_CAP)):
        accept = math.ceil(round(target * share, 9))
        out[name] = (accept * TRIES, accept)
    return out


def attempts(rows: list[tuple[str, bool]], target: int, most: int) -> list[bool]:
    """Which of a document's chains are tried: (category, would be accepted) in rank order.

    Ends when the target is met with the floor of typed chains, or after `most` attempts; a category at its cap is passed over.
    """
    cap, tried, taken = caps(target), dict.fromkeys(("typed_mh", "untyped_mh", "fb"), 0), dict.fromkeys(("typed_mh", "untyped_mh", "fb"), 0)
    out = []
    for kind, good in rows:
        total = sum(taken.values())
        done = sum(tried.values()) >= most or (total >= max(1, target) and taken["typed_mh"] / max(1, total) >= FLOOR)
        a, b = cap[kind]
        go = not done and not (b and taken[kind] >= b) and not (a and tried[kind] >= a)
        tried[kind] += go
        taken[kind] += go and good
        out.append(go)
    return out


def yields(chains: DataFrame, by: str, target: int, most: int, order: list[str]) -> DataFrame:
    """The chains that are tried, with `accepted`: chains has `by`, category, good and the columns of `order`.

    A category can't be tried more often than its cap, or `most` times, so only that many chains of a group, its first, can
    be tried at all; the rest is dropped before a group's chains meet in one task.
    """
    first = F.row_number().over(Window.partitionBy(by, "category").orderBy(*order))
    limit = F.lit(most)
    for kind, (a, _) in caps(target).items():
        limit = F.when(F.col("category") == kind, min(most, a) if a else most).otherwise(limit)
    few = chains.withColumn("__n", first).filter(F.col("__n") <= limit).drop("__n")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        go = attempts(list(zip(p.category, p.good.astype(bool))), target, most)
        return p[go].assign(accepted=p[go].good.astype(bool))

    return few.groupBy(by).applyInPandas(run, few.withColumn("accepted", F.lit(True)).schema)
