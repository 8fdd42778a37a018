"""Queries on classifiers, filters with drop counts, and gates."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import pair_checks as C
from quarry.functions import predicates as P
from quarry.functions import text as T
from quarry.functions import views as V
from quarry.functions.reasons import reason_counts
from quarry.plans.named import register
from quarry.plans.oracle import tok, with_
from quarry.session import table

QUERIES, SQL, q = register()


def _like(c: str, pattern: str, i: bool = True) -> str:
    return f"regexp_matches({c}, '{'(?i)' if i else ''}{pattern.replace(chr(39), chr(39) * 2)}')"


def _case(c: str, rules: tuple, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {_like(c, p)} THEN '{r}'" for r, p in rules) + f" ELSE {otherwise} END"


def _words(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '\S+'))"


_SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_TABLE = lambda c: f"(length({c}) - length(replace({c}, ':', '')) >= 4 OR len(regexp_extract_all({c}, '{P.GLUED}')) >= 3 OR {_like(c, P.DOTTED, False)})"
_DUMP = lambda c: f"len(regexp_extract_all({c}, '{P.STANDARD_ENTRY}')) >= 3"
_BARE = lambda c: rf"(regexp_matches({c}, '^\s*\d{{1,2}}\s+[A-Z][A-Za-z]') AND NOT regexp_matches({c}, '[.?!]\s*$') AND {_words(c)} <= 10)"
_LETTERS = lambda c: functools.reduce(lambda x, p: f"replace({x}, '{p[0]}', '{p[1]}')", P.LIGATURES, c)
_ASCII = lambda c: f"regexp_replace(translate({_LETTERS(c)}, '{P.ACCENTED}', '{P.PLAIN}'), '[^\\x00-\\x7F]', '', 'g')"
_PREFIX = """(SELECT len(w) >= 5 AND r < len(w) AND (r >= 3 OR (r >= 2 AND len(list_filter(w[1:r], lambda x: length(x) <= 3)) = 0)) FROM (SELECT w, coalesce(nullif(list_position(list_transform(w[1:6], lambda x: length(x) > 1 AND upper(x) = x), false), 0), least(len(w), 6) + 1) - 1 AS r FROM (SELECT regexp_extract_all(ta, '[A-Za-z][A-Za-z0-9-]*') AS w)))"""
_SPECIAL = {
    "algorithm_listing_fragment": "(" + " + ".join(f"{_like('t', p)}::INT" for p in P.LISTING) + ") >= 2",
    "heading_prefix_fragment": _PREFIX,
    "bibliography_or_citation": f"{_like('ta', P.BIBLIOGRAPHY)} AND ({_like('ta', P.CITATION_PREFIX, False)} OR {_like('ta', P.PAGE_RANGE)})",
    "page_range_or_locator": f"{_like('ta', P.PAGE_RANGE)} AND {_words('ta')} <= 16",
}
_STRICT = "CASE WHEN t IS NULL OR t = '' THEN 'empty_text' " + " ".join(f"WHEN {_like('ta', p) if p else _SPECIAL[r]} THEN '{r}'" for r, p in P.STRICT) + " END"
_CLAUSE = _like("t", P.ISO_CLAUSE, False)


def _relaxed(front: str = "false") -> str:
    return rf"""CASE WHEN t IS NULL OR t = '' THEN 'empty_text' WHEN {_like('ta', P.REFERENCE_HEADING)} THEN 'reference_heading' WHEN {_like('ta', P.TASK_HEADING)} THEN 'source_task_heading' WHEN {_like('ta', P.TASK_PROMPT)} THEN 'source_task_prompt'
  WHEN {_like('ta', P.FRONT_MATTER)} THEN 'front_matter_artifact' WHEN {_like('ta', P.BIBLIOGRAPHY)} THEN 'bibliography' WHEN {_like('t', P.ISO_BOILERPLATE)} THEN 'iso_boilerplate' WHEN {_like('t', P.NUMBERED_REFERENCE, False)} THEN 'numbered_reference' WHEN {_DUMP('t')} THEN 'reference_list_dump'
  WHEN {_TABLE('t')} THEN 'table_artifact' WHEN {_BARE('t')} THEN 'bare_numbered_heading' WHEN {_like('t', P.DANGLING, False)} THEN 'dangling_anaphora' WHEN {_like('t', P.PRINTOUT, False)} THEN 'printout_metadata' WHEN {_like('t', P.COT_META)} THEN 'cot_meta_leak'
  WHEN NOT {_CLAUSE} AND (regexp_matches(t, '^\s*(?:[—–•*]|--?)\s+') OR {_words('t')} < 5 OR (regexp_matches(t, '^\p{{Ll}}+(\s|$)') AND ({_words('t')} < 8 OR regexp_matches(t, '\b[a-z]\)\s')))) THEN 'fragment'
  WHEN coalesce({front}, false) AND NOT {_CLAUSE} THEN 'front_matter_page' WHEN {_like('ta', P.CAPTION)} AND NOT {_CLAUSE} THEN 'caption_or_heading' END"""


_MINIMAL = f"CASE WHEN t IS NULL OR t = '' THEN 'empty_text' WHEN {_like('ta', P.REFERENCE_HEADING)} THEN 'reference_heading' WHEN {_like('ta', P.BIBLIOGRAPHY)} THEN 'bibliography' WHEN length(t) < 20 THEN 'too_short' END"


def _plain(rows: str, more: str = "") -> str:
    """rows of `text` with t, the text squeezed, and ta, its ASCII form."""
    return f"(SELECT *, {_ASCII('t')} AS ta FROM (SELECT {_SQ.format('text')} AS t{more} FROM {rows}))"


@q("fi_roles", with_("fa", f"SELECT {_case('text', P.ROLES, chr(39) + 'definition' + chr(39))} AS role, count(*) AS n FROM fa GROUP BY 1"))
def fi_roles(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(table(spark, d, "chunks")).groupBy(P.role(F.col("text")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


_QUALITY = rf"""CASE WHEN text LIKE '%�%' OR regexp_matches(text, '\(cid:\d+\)') OR len(regexp_extract_all(lower(text), '[a-z0-9_]+')) < 3 OR length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / greatest(length(text), 1) < 0.6 OR len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) < 3 THEN 0.0::DOUBLE
  ELSE round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN regexp_matches(text, '[.:;]') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\b(is|are|was|were|shall|must|should|can|could|will|would)\b') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\b(not|no|never|neither|nor)\b') THEN 0.1 ELSE 0 END
  + CASE WHEN {_words('text')} >= 5 THEN 0.1 ELSE 0 END + CASE WHEN {_words('text')} >= 10 THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(text, '\d') THEN 0.05 ELSE 0 END), 6) END"""


@q("fi_structural_quality", with_("fa", f"SELECT fact_id, {_QUALITY} AS quality FROM fa"))
def fi_structural_quality(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(table(spark, d, "chunks")).select("fact_id", P.structural_quality(F.col("text")).alias("quality"))


@q("fi_boilerplate", f"SELECT doc_id, {_like('text', '|'.join(P.BOILERPLATE))} AS boilerplate FROM documents")
def fi_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.boilerplate(F.col("text")).alias("boilerplate"))


@q("fi_artifacts", with_("li", f"SELECT count(*) AS n, count_if({_TABLE('text')}) AS n_table, count_if({_DUMP('text')}) AS n_dump, count_if({_BARE('text')}) AS n_heading, count_if({_like('text', P.DANGLING, False)}) AS n_dangling, count_if({_like('text', P.PRINTOUT, False)}) AS n_printout FROM li"))
def fi_artifacts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return V.lines(table(spark, d, "documents")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(P.table_artifact(t)).alias("n_table"), F.count_if(P.reference_dump(t)).alias("n_dump"), F.count_if(P.bare_heading(t)).alias("n_heading"), F.count_if(t.rlike(P.DANGLING)).alias("n_dangling"), F.count_if(t.rlike(P.PRINTOUT)).alias("n_printout")
    )


@q("fi_strict_reasons", with_("fa", f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT {_STRICT} AS reason FROM {_plain('fa')}) GROUP BY 1"))
def fi_strict_reasons(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(table(spark, d, "chunks")).groupBy(F.coalesce(P.strict_reason(F.col("text")), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_PARTS = """(SELECT text, 'unit' AS part FROM fa UNION ALL SELECT text, 'line' FROM li)"""


@q("fi_reject_reasons", with_("fa li", f"SELECT part, coalesce(strict, 'kept') AS strict, coalesce(relaxed, 'kept') AS relaxed, count(*) AS n FROM (SELECT part, {_STRICT} AS strict, {_relaxed()} AS relaxed FROM {_plain(_PARTS, ', part')}) GROUP BY 1, 2, 3"))
def fi_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Both tiers over facts and over all lines of documents, headings, tables and lists included."""
    rows = V.facts(table(spark, d, "chunks")).select("text", F.lit("unit").alias("part")).unionByName(V.lines(table(spark, d, "documents")).select("text", F.lit("line").alias("part")))
    return reason_counts(rows, "part", "text")


@q("fi_adaptive_reasons", with_("fa", f"""SELECT tier, coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT tier, CASE tier WHEN 'strict' THEN {_STRICT} WHEN 'relaxed' THEN {_relaxed('front')} ELSE {_MINIMAL} END AS reason FROM
  {_plain('fa JOIN (SELECT doc_id, doc_type FROM documents) USING (doc_id)', ", page_start <= 1 AND doc_type = 'ISO_STANDARD' AS front, CASE WHEN doc_type IN ('TEXTBOOK', 'NARRATIVE') THEN 'strict' WHEN doc_type IN ('ISO_STANDARD', 'REPORT') THEN 'relaxed' ELSE 'minimal' END AS tier")}) GROUP BY 1, 2"""))
def fi_adaptive_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a standard is its front matter."""
    kind = F.coalesce("doc_type", F.lit("UNKNOWN"))
    f = V.facts(table(spark, d, "chunks")).join(table(spark, d, "documents").select("doc_id", "doc_type"), "doc_id")
    front = (F.col("page_start") <= 1) & (kind == "ISO_STANDARD")
    return f.groupBy(P.tier(kind).alias("tier"), F.coalesce(P.adaptive_reason(F.col("text"), kind, front), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@q("fi_kept_facts", with_("fa", f"SELECT fact_id, t AS text FROM {_plain('fa', ', fact_id')} WHERE {_relaxed()} IS NULL"))
def fi_kept_facts(spark: SparkSession, d: str) -> DataFrame:
    f = V.facts(table(spark, d, "chunks"))
    return f.filter(P.relaxed_reason(F.col("text")).isNull()).select("fact_id", T.squeeze(F.col("text")).alias("text"))


@q("fi_excluded_pages", with_("fa", "SELECT fact_id, page_start FROM fa JOIN documents USING (doc_id) WHERE NOT coalesce((doc_type = 'REPORT' AND page_start BETWEEN 1 AND 1) OR (doc_type = 'TEXTBOOK' AND page_start BETWEEN 3 AND 4), false)"))
def fi_excluded_pages(spark: SparkSession, d: str) -> DataFrame:
    """Facts outside the excluded page ranges of their kind of document."""
    ranges = F.broadcast(spark.createDataFrame([("REPORT", 1, 1), ("TEXTBOOK", 3, 4)], "kind string, a int, b int"))
    f = V.facts(table(spark, d, "chunks")).join(table(spark, d, "documents").select("doc_id", "doc_type"), "doc_id")
    return f.join(ranges, (F.col("doc_type") == F.col("kind")) & F.col("page_start").between(F.col("a"), F.col("b")), "left_anti").select("fact_id", "page_start")


@q("fi_deictic_facts", with_("fa", f"SELECT doc_id, count(*) AS n FROM fa WHERE {_like('text', P.DEICTIC_OPENER, False)} GROUP BY 1"))
def fi_deictic_facts(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(table(spark, d, "chunks")).filter(F.col("text").rlike(P.DEICTIC_OPENER)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# What speaks for a kind of document.
SIGNALS = (("ISO_STANDARD", r"(?i)\b(shall|clause|normative|conform)"), ("TEXTBOOK", r"(?i)\b(chapter|exercise|theorem|definition)"), ("REPORT", r"(?i)\b(results|findings|summary|percent)"))


def _n(p: str) -> str:
    return f"len(regexp_extract_all(text, '{p}'))"


@q("fi_profile", f"""SELECT doc_id, CASE WHEN greatest(a, b, c) < 3 THEN 'UNKNOWN' WHEN a >= b AND a >= c THEN 'ISO_STANDARD' WHEN b >= c THEN 'TEXTBOOK' ELSE 'REPORT' END AS guess, greatest(a, b, c)::INT AS signal
  FROM (SELECT doc_id, {_n(SIGNALS[0][1])} AS a, {_n(SIGNALS[1][1])} AS b, {_n(SIGNALS[2][1])} AS c FROM documents)""")
def fi_profile(spark: SparkSession, d: str) -> DataFrame:
    n = [F.size(T.extract_all(F.col("text"), p)) for _, p in SIGNALS]
    top = F.greatest(*n)
    guess = F.when(top < 3, "UNKNOWN").when(n[0] == top, SIGNALS[0][0]).when(n[1] == top, SIGNALS[1][0]).otherwise(SIGNALS[2][0])
    return table(spark, d, "documents").select("doc_id", guess.alias("guess"), top.alias("signal"))


@q("fi_preflight", with_("li", """SELECT doc_id, count(*) AS n_sampled, round(avg(CASE WHEN starts_with(text, '|') THEN 1.0 ELSE 0.0 END), 6) AS table_density, round(avg(length(text)), 6) AS mean_chars
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM li) WHERE n <= 8 OR (line_idx * 8 // n) <> ((line_idx - 1) * 8 // n) OR line_idx = 0 GROUP BY 1"""))
def fi_preflight(spark: SparkSession, d: str) -> DataFrame:
    """A systematic sample of at most about 8 evenly spaced units of each document, and what it shows."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    l = V.lines(table(spark, d, "documents")).withColumn("n", n)
    taken = (F.col("n") <= 8) | (F.expr("(line_idx * 8) div n") != F.expr("((line_idx - 1) * 8) div n")) | (F.col("line_idx") == 0)
    return l.filter(taken).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sampled"), F.round(F.avg(F.when(F.col("text").startswith("|"), 1.0).otherwise(0.0)), 6).alias("table_density"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@q("fi_provenance", "SELECT coalesce(CASE WHEN chunk_id IS NULL THEN 'chunk_id' WHEN doc_id IS NULL THEN 'doc_id' WHEN char_start IS NULL THEN 'char_start' WHEN char_end IS NULL THEN 'char_end' WHEN page_start IS NULL THEN 'page_start' WHEN page_end IS NULL THEN 'page_end' WHEN extractor IS NULL THEN 'extractor' END, 'complete') AS missing, count(*) AS n FROM chunks GROUP BY 1")
def fi_provenance(spark: SparkSession, d: str) -> DataFrame:
    missing = F.lit("complete")
    for c in ("extractor", "page_end", "page_start", "char_end", "char_start", "doc_id", "chunk_id"):
        missing = F.when(F.col(c).isNull(), c).otherwise(missing)
    return table(spark, d, "chunks").groupBy(missing.alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@q("fi_pair_structure", with_("qu", rf"""SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN length(q) < 15 THEN 'question too short' WHEN {_words('q')} < 4 THEN 'question has fewer than 4 words' WHEN length(a) < 1 THEN 'answer is empty' WHEN q NOT LIKE '%?%' THEN 'not a question'
  WHEN {_like('q', P.YES_NO, False)} THEN 'yes/no question' END AS reason FROM (SELECT trim(coalesce(question, ''), ' ') AS q, trim(coalesce(answer, ''), ' ') AS a FROM qu)) GROUP BY 1"""))
def fi_pair_structure(spark: SparkSession, d: str) -> DataFrame:
    return V.questions(table(spark, d, "questions")).groupBy(F.coalesce(P.structure_reason(F.col("question"), F.col("answer")), F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@q("fi_question_domain", f"""SELECT coalesce(CASE WHEN {_like("concat_ws(' ', coalesce(question, ''), coalesce(answer, ''))", P.SOURCE_META)} THEN 'source_meta_question' WHEN {_like("coalesce(question, '')", P.SOURCE_FRAME)} THEN 'source_framed_question' END, 'kept') AS reason, 'pair' AS part, count(*) AS n FROM questions GROUP BY 1
  UNION ALL SELECT coalesce(CASE WHEN {_like("concat_ws(' ', coalesce(title, ''), coalesce(text, ''))", P.SOURCE_META)} THEN 'source_meta_question' WHEN {_like("coalesce(title, '')", P.SOURCE_FRAME)} THEN 'source_framed_question' END, 'kept'), 'document', count(*) FROM documents GROUP BY 1""")
def fi_question_domain(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, and documents with their titles, that are about their source."""
    parts = ((table(spark, d, "questions"), "question", "answer", "pair"), (table(spark, d, "documents"), "title", "text", "document"))
    a, b = (t.groupBy(F.coalesce(P.question_reject_reason(F.col(x), F.col(y)), F.lit("kept")).alias("reason")).agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n")) for t, x, y, part in parts)
    return a.unionByName(b)


_CONTENT = "list_filter(list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_]{{3,}}'), lambda x: lower(x))), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "], x))"
_TAUT = "coalesce(question IS NOT NULL AND len(ac) > 0 AND len(list_filter(ac, lambda x: NOT list_contains(qc, x))) / len(ac) < 0.25, false)"
_ECHO = r"coalesce(CASE WHEN len(qw) > 0 AND len(aw) > 0 THEN len(list_intersect(qw, aw)) / len(list_distinct(list_concat(qw, aw))) ELSE 0.0 END > 0.7, false)"
_PAIR = r"SELECT *, {0} AS ac, {1} AS qc, list_distinct(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+')) AS qw, list_distinct(regexp_extract_all(lower(answer), '[\p{{L}}\p{{N}}_]+')) AS aw FROM qu".format(_CONTENT.format("answer"), _CONTENT.format("question"))
_COMPOUND = rf"coalesce({_words('question')} > 26 OR regexp_matches(question, '(?i)\band (what|which|how|why|who|when|where)\b') OR length(question) - length(replace(question, '?', '')) > 1, false)"
_FLAGS = {
    "tautology": _TAUT,
    "echo": _ECHO,
    "compound": _COMPOUND,
    "numbered": r"coalesce(regexp_matches(question, '[A-Za-z]+\(\d+\)|[A-Za-z]{2,}\d+\s+[A-Za-z]{2,}\d+'), false)",
    "generic": f"coalesce({_like('question', P.GENERIC, False)}, false)",
    "short": "coalesce(length(trim(answer, ' ')) < 40, false)",
    "abstains": f"coalesce({_like('answer', P.ABSTENTION, False)}, false)",
    "is_question": r"coalesce(regexp_matches(answer, '\?\s*$'), false)",
}


def flags(rows: DataFrame) -> DataFrame:
    """rows of question and answer with one boolean per gate of a pair."""
    a, u = F.col("answer"), F.col("question")
    return rows.withColumns({
        "tautology": P.tautology(u, a), "echo": P.echo(u, a), "compound": P.compound(u), "numbered": P.numbered_words(u), "generic": F.coalesce(u.rlike(P.GENERIC), F.lit(False)),
        "short": F.coalesce(F.length(F.trim(a)) < 40, F.lit(False)), "abstains": P.abstains(a), "is_question": F.coalesce(a.rlike(r"\?\s*$"), F.lit(False)),
    })


_FLAGGED = f"SELECT *, {', '.join(f'{s} AS {k}' for k, s in _FLAGS.items())} FROM ({_PAIR})"


@q("fi_pair_flags", with_("qu", f"SELECT q_id, {', '.join(_FLAGS)} FROM ({_FLAGGED})"))
def fi_pair_flags(spark: SparkSession, d: str) -> DataFrame:
    """The gates that look at question and answer alone: tautology, compound and numbered questions, and more."""
    return flags(V.questions(table(spark, d, "questions"))).select("q_id", *_FLAGS)


def with_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Questions with `facts`, their evidence chunks, as many as the question names."""
    t = table(spark, d, "questions")
    held = V.gold(t).join(V.chunk_rows(table(spark, d, "chunks")), "chunk_id").groupBy("q_id").agg(F.collect_list(F.struct("text", "chunk_id", "doc_id")).alias("facts"))
    return V.questions(t).join(held, "q_id", "left")


_DEIXIS = lambda c: f"({_like(c, C.DEICTIC)} AND len(list_filter(regexp_extract_all(regexp_extract({c}, '(?is)^(.*?){C.DEICTIC}', 1), '{C.WORD}'), lambda w: NOT list_contains([{', '.join(repr(x) for x in C.STARTERS)}], lower(w)) AND (regexp_matches(w, '^[A-Z][a-z]+$') OR length(w) >= 5))) = 0)"
_EACH = lambda c: f"len(list_filter(fx, lambda x: {c})) > 0"
_SET = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '{C.WORD}'))"
_NAMELESS = f"regexp_replace(regexp_replace(q, '(?i){C.CONTRAST}{C.REFERENT}', ' ', 'g'), '(?i:{C.REFERENT})(?:{C.NAMED})', ' ', 'g')"
_CHECKS = {
    "q1_deictic": _DEIXIS("q"),
    "q2_short": r"length(regexp_replace(a, '^\s+|\s+$', '', 'g')) < 40",
    "q3_echo": f"CASE WHEN len({_SET('q')}) > 0 AND len({_SET('a')}) > 0 THEN len(list_intersect({_SET('q')}, {_SET('a')})) / len(list_distinct(list_concat({_SET('q')}, {_SET('a')}))) > 0.7 ELSE false END",
    "q4_generic": f"{_like('q', C.SOURCE_REFERENT)} OR {_like(_NAMELESS, C.REFERENT)}",
    "q5_scattered": "n_docs > 1 OR coalesce(list_max(fp) - list_min(fp) > 5, false)",
    "q6_number": f"len(fx) > 0 AND len(list_filter(regexp_extract_all(a, '{C.NUMBER}'), lambda n: NOT list_contains(flatten(list_transform(fx, lambda x: regexp_extract_all(x, '{C.NUMBER}'))), n))) > 0",
    "q7_fragment": _EACH(f"x = '' OR regexp_matches(x, '{C.BROKEN_END}') OR {_like('x', C.WEAK_END)} OR regexp_matches(x, '{C.PAGE_PREFIX}') OR len(regexp_extract_all(x, '\\w+')) < 5 OR {_DEIXIS('x')}"),
    "q8_leak": _like("a", C.LEAK),
    "q9_weak_evidence": _EACH(f"{_like('x', P.WEAK_START, False)} OR {_like('x', C.SOURCES)} OR {_like('x', C.FIGURE)}"),
    "q10_question": _like("a", C.ASKING),
    "q11_heading": f"{_like('a', C.HEADING_LEAK)} OR {_like('a', C.CAPITALS, False)}",
    "q12_abstains": _like("a", C.ABSTAINS),
    "q13_tautology": _like("a", C.TAUTOLOGY),
    "q14_short_fragment": f"sa = '' OR (NOT ({_like('sq', C.SHORT_ENTITY)} AND NOT {_like('q', C.LONG_ANSWER)}) AND len(regexp_extract_all(sa, '{C.WORD}')) < 6)",
    "q15_artifact": _like("q", C.ARTIFACT),
    "q16_prompt": _like("q", C.PROMPT_LEAK),
    "q17_two": rf"{_like('q', C.TWO)} AND NOT regexp_matches(sa, '(?i)\b(?:two|both)\b') AND len(list_filter(regexp_split_to_array(sa, '\s+(?:and|plus)\s+|[.;]'), lambda p: trim(p, ' ') <> '')) < 2",
    "q18_count": f"{_like('q', C.HOW_MANY)} AND NOT (regexp_matches(a, '{C.NUMBER}') OR {_like('a', C.NUMBER_WORD)})",
    "q19_placeholder": _like("concat_ws(' ', q, a, array_to_string(ft, ' '))", C.PLACEHOLDER),
    "q20_phrase": _like("q", C.PHRASE),
}
_EVIDENCE = f"""SELECT u.q_id, u.hop_type, coalesce(u.question, '') AS q, coalesce(u.answer, '') AS a, coalesce(e.ft, []) AS ft, coalesce(e.fx, []) AS fx, coalesce(e.fp, []) AS fp, coalesce(e.n_docs, 0) AS n_docs FROM qu u LEFT JOIN
  (SELECT q_id, list(text) AS ft, list({_SQ.format('text')}) AS fx, list(regexp_extract(chunk_id, '^.+_c0*([0-9]+)$', 1)::BIGINT) FILTER (regexp_matches(chunk_id, '^.+_c0*[0-9]+$')) AS fp, count(DISTINCT doc_id) AS n_docs FROM go JOIN ch USING (chunk_id) GROUP BY 1) e USING (q_id)"""
_CHECKED = f"SELECT q_id, hop_type, {', '.join(f'({s}) AS {k}' for k, s in _CHECKS.items())} FROM (SELECT *, {_SQ.format('q')} AS sq, {_SQ.format('a')} AS sa FROM ({_EVIDENCE}))"
_PENALTY = " + ".join(f"CASE WHEN {k} THEN {w}::DOUBLE ELSE 0 END" for k, w in C.WEIGHTS.items())
_SCORED = f"SELECT *, CASE WHEN {' OR '.join(C.HARD)} THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, 1 - ({_PENALTY}) / {sum(C.WEIGHTS.values())}::DOUBLE), 3) END AS quality FROM ({_CHECKED})"


@q("fi_pair_quality", with_("qu go ch", f"SELECT q_id, {', '.join(C.WEIGHTS)}, quality FROM ({_SCORED})"))
def fi_pair_quality(spark: SparkSession, d: str) -> DataFrame:
    """All twenty weighted checks of every pair against its evidence."""
    return C.checked(with_evidence(spark, d)).select("q_id", *C.WEIGHTS, "quality")


@q("fi_worst_pairs", with_("qu go ch", f"SELECT q_id, quality FROM ({_SCORED}) ORDER BY quality, q_id LIMIT 20"))
def fi_worst_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.checked(with_evidence(spark, d)).select("q_id", "quality").orderBy("quality", "q_id").limit(20)


@q("fi_unsupported_numbers", with_("qu go ch", r"""SELECT q_id, count(*) AS n FROM (SELECT DISTINCT q_id, unnest(regexp_extract_all(answer, '\b\d+(?:\.\d+)?\b')) AS x FROM qu) a
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT go.q_id, unnest(regexp_extract_all(ch.text, '\b\d+(?:\.\d+)?\b')) AS x FROM go JOIN ch USING (chunk_id)) b WHERE b.q_id = a.q_id AND b.x = a.x) GROUP BY 1"""))
def fi_unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of an answer that none of the question's evidence chunks has."""
    number = r"\b\d+(?:\.\d+)?\b"
    t = table(spark, d, "questions")
    said = V.questions(t).select("q_id", F.explode(T.extract_all(F.col("answer"), number)).alias("x")).distinct()
    seen = V.gold(t).join(V.chunk_rows(table(spark, d, "chunks")), "chunk_id").select("q_id", F.explode(T.extract_all(F.col("text"), number)).alias("x")).distinct()
    return said.join(seen, ["q_id", "x"], "left_anti").groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))


_GRAM = "list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], ' '))"


@q("fi_premise_leak", with_("qu go ch", f"""SELECT go.q_id, ch.chunk_id, len(list_intersect(list_distinct({_GRAM.format('qt', 5)}), list_distinct({_GRAM.format('ct', 5)}))) > 0 AS run_of_5, len(list_intersect(list_distinct(qt), list_distinct(ct)))::INT AS n_shared
  FROM go JOIN (SELECT q_id, {tok('question')} AS qt FROM qu WHERE question IS NOT NULL) USING (q_id) JOIN (SELECT chunk_id, {tok('text')} AS ct FROM ch) ch USING (chunk_id)"""))
def fi_premise_leak(spark: SparkSession, d: str) -> DataFrame:
    """Whether a question gives its evidence away: a common run of five tokens, and the number of shared ones."""
    t = table(spark, d, "questions")
    rows = V.gold(t).join(V.questions(t).filter("question is not null").select("q_id", T.tokens(F.col("question")).alias("qt")), "q_id").join(V.chunk_rows(table(spark, d, "chunks")).select("chunk_id", T.tokens(F.col("text")).alias("ct")), "chunk_id")
    run = F.size(F.array_intersect(T.ngrams(F.col("qt"), 5), T.ngrams(F.col("ct"), 5))) > 0
    return rows.select("q_id", "chunk_id", run.alias("run_of_5"), F.size(F.array_intersect("qt", "ct")).alias("n_shared"))


@q("fi_abstention", f"SELECT coalesce(lower(trim(model_name)), 'unknown') AS model, count(*) AS n, count_if({_FLAGS['abstains'].replace('answer,', 'predicted_answer,')}) AS n_abstaining, count_if(abstained) AS n_marked FROM (SELECT DISTINCT * FROM answers) GROUP BY 1")
def fi_abstention(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "answers").distinct()
    return a.groupBy(F.coalesce(F.lower(F.trim("model_name")), F.lit("unknown")).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.count_if(P.abstains(F.col("predicted_answer"))).alias("n_abstaining"), F.count_if("abstained").alias("n_marked"))


@q("fi_hop_class", with_("qu ch go", """SELECT q_id, depth, CASE WHEN depth >= 3 THEN 'deep' WHEN depth <= 1 THEN 'single' WHEN coalesce(CASE WHEN known = depth THEN spread END, 0) = 0 THEN CASE WHEN gap > 3 THEN 'same_page' ELSE 'single' END WHEN spread >= 2 THEN 'cross_strict' ELSE 'cross_near' END AS hop_class
  FROM (SELECT q_id, count(*)::INT AS depth, count(page_start) AS known, max(page_start) - min(page_start) AS spread, max(gap) AS gap FROM (SELECT q_id, page_start, abs(i - lag(i) OVER (PARTITION BY q_id ORDER BY length(chunk_id), chunk_id)) AS gap FROM (SELECT q_id, chunk_id, page_start, regexp_extract(chunk_id, '([0-9]+)$', 1)::INT AS i FROM go JOIN ch USING (chunk_id))) GROUP BY 1)"""))
def fi_hop_class(spark: SparkSession, d: str) -> DataFrame:
    c = V.chunk_rows(table(spark, d, "chunks")).select("chunk_id", "page_start")
    rows = V.gold(table(spark, d, "questions")).join(c, "chunk_id").groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct(F.length("chunk_id").alias("n"), "chunk_id", "page_start"))).alias("s"))
    order = F.transform("s", lambda x: F.regexp_extract(x["chunk_id"], "([0-9]+)$", 1).cast("int"))
    return rows.select("q_id", F.size("s").alias("depth"), P.hop_class(F.col("s.page_start"), order).alias("hop_class"))


@q("fi_hop_label", with_("fa", f"SELECT label, count(*) AS n FROM (SELECT array_to_string(list({_case('text', P.ROLES, chr(39) + 'definition' + chr(39))} ORDER BY order_idx), '->') AS label FROM fa GROUP BY doc_id, (order_idx - 1) // 3) GROUP BY 1"))
def fi_hop_label(spark: SparkSession, d: str) -> DataFrame:
    """Chains of three facts that follow each other in a document, named by their roles."""
    f = V.facts(table(spark, d, "chunks")).groupBy("doc_id", F.expr("(order_idx - 1) div 3").alias("k")).agg(F.array_sort(F.collect_list(F.struct("order_idx", P.role(F.col("text")).alias("role")))).alias("s"))
    return f.groupBy(F.array_join("s.role", "->").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@q("fi_bridge_surfaces", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN s = '' THEN 'empty' WHEN length(s) < 5 THEN 'too_short' WHEN NOT regexp_matches(s, '[A-Za-z]{3,}') THEN 'no_content_token' ELSE 'ok' END AS state FROM (SELECT trim(regexp_replace(coalesce(answer, ''), '\\s+', ' ', 'g')) AS s FROM questions)) GROUP BY 1""")
def fi_bridge_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").groupBy(P.surface_state(F.col("answer")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@q("fi_bridge_hidden", with_("qu", """SELECT q_id, NOT contains(' ' || key || ' ', ' ' || bridge || ' ') AS hidden FROM (SELECT q_id, trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) AS key, trim(regexp_replace(lower(split_part(answer, '.', 1)), '[^a-z0-9]+', ' ', 'g')) AS bridge FROM qu WHERE question IS NOT NULL AND answer IS NOT NULL)"""))
def fi_bridge_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Whether the answer's first phrase is hidden from the question, compared by whole words."""
    u = V.questions(table(spark, d, "questions")).filter("question is not null and answer is not null")
    key, bridge = T.dedup_key(F.col("question")), T.dedup_key(F.split_part("answer", F.lit("."), F.lit(1)))
    return u.select("q_id", (~F.contains(F.concat(F.lit(" "), key, F.lit(" ")), F.concat(F.lit(" "), bridge, F.lit(" ")))).alias("hidden"))


@q("fi_edge_labels", f"SELECT CASE WHEN upper(trim(event_type)) IN ({', '.join(repr(x) for x in P.LABELS)}) THEN upper(trim(event_type)) ELSE 'UNKNOWN' END AS label, count(*) AS n FROM events GROUP BY 1")
def fi_edge_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(P.edge_label(F.col("event_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@q("fi_chain_gate", with_("fa", f"""SELECT verdict, count(*) AS n FROM (SELECT a.fact_id, CASE WHEN lower({_SQ.format('a.text')}) = lower({_SQ.format('b.text')}) THEN 'duplicate_fact_text' WHEN {_like('a.text', P.WEAK_START, False)} OR {_like('b.text', P.WEAK_START, False)} THEN 'weak_context_fragment'
  WHEN abs(a.page_start - b.page_start) > 40 THEN 'source_gap_too_large' WHEN len(a.c) = 0 OR len(b.c) = 0 THEN 'empty_fact_terms' WHEN len(list_intersect(a.c, b.c)) < 1 THEN 'unconnected_fact' ELSE 'ok' END AS verdict
  FROM (SELECT *, {_CONTENT.format('text')} AS c FROM fa) a JOIN (SELECT *, {_CONTENT.format('text')} AS c FROM fa) b ON a.doc_id = b.doc_id AND b.order_idx = a.order_idx + 1) GROUP BY 1"""))
def fi_chain_gate(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on chains of two neighbouring facts."""
    w = Window.partitionBy("doc_id").orderBy("order_idx")
    f = V.facts(table(spark, d, "chunks")).withColumn("c", T.content_tokens(F.col("text")))
    f = f.withColumn("b", F.lead(F.struct("text", "page_start", "c")).over(w)).filter("b is not null")
    verdict = (
        F.when(F.lower(T.squeeze(F.col("text"))) == F.lower(T.squeeze(F.col("b.text"))), "duplicate_fact_text")
        .when(F.col("text").rlike(P.WEAK_START) | F.col("b.text").rlike(P.WEAK_START), "weak_context_fragment")
        .when(F.abs(F.col("page_start") - F.col("b.page_start")) > 40, "source_gap_too_large")
        .when((F.size("c") == 0) | (F.size("b.c") == 0), "empty_fact_terms")
        .when(F.size(F.array_intersect(F.col("c"), F.col("b.c"))) < 1, "unconnected_fact")
        .otherwise("ok")
    )
    return f.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@q("fi_verification_gate", with_("qu", f"SELECT q_id, question IS NOT NULL AS has_question, coalesce(answer, '') <> '' AS has_answer, len(coalesce(gold_chunk_ids, [])) > 0 AS has_evidence, question IS NOT NULL AND coalesce(answer, '') <> '' AND len(coalesce(gold_chunk_ids, [])) > 0 AS passed FROM qu"))
def fi_verification_gate(spark: SparkSession, d: str) -> DataFrame:
    u = V.questions(table(spark, d, "questions"))
    checks = {"has_question": F.col("question").isNotNull(), "has_answer": F.coalesce("answer", F.lit("")) != "", "has_evidence": F.size(F.coalesce("gold_chunk_ids", F.array())) > 0}
    passed = F.lit(True)
    for c in checks.values():
        passed = passed & c
    return u.select("q_id", *(c.alias(k) for k, c in checks.items()), passed.alias("passed"))
