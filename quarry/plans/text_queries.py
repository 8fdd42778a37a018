"""Queries on sources, tokens, normal forms and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import views as V
from quarry.operators import chunking as C
from quarry.plans.named import register
from quarry.plans.oracle import tok, with_
from quarry.session import table

QUERIES, SQL, q = register()


@q("io_page_ranges", with_("ch", "SELECT doc_id, s AS first_page, least(s + 3, n) AS last_page FROM (SELECT doc_id, n, unnest(range(1, n + 1, 4)) AS s FROM (SELECT doc_id, max(page_end)::BIGINT AS n FROM ch GROUP BY 1) WHERE n >= 1)"))
def io_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    n = V.chunk_rows(table(spark, d, "chunks")).groupBy("doc_id").agg(F.max("page_end").cast("long").alias("n")).filter("n >= 1")
    return n.select("doc_id", "n", F.explode(F.expr("sequence(1L, n, 4L)")).alias("first_page")).select("doc_id", "first_page", F.least(F.col("first_page") + 3, "n").alias("last_page"))


@q("io_dropped_pages", with_("ch", """SELECT doc_id, page_no FROM (SELECT doc_id, unnest(range(1, max(page_end)::BIGINT + 1)) AS page_no FROM ch GROUP BY doc_id HAVING max(page_end) >= 1)
  EXCEPT SELECT doc_id, unnest(range(page_start::BIGINT, page_end::BIGINT + 1)) FROM ch WHERE page_start <= page_end"""))
def io_dropped_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a document that no chunk covers."""
    c = V.chunk_rows(table(spark, d, "chunks"))
    every = c.groupBy("doc_id").agg(F.max("page_end").alias("n")).filter("n >= 1").select("doc_id", F.explode(F.expr("sequence(1L, cast(n as bigint))")).alias("page_no"))
    seen = c.filter("page_start <= page_end").select("doc_id", F.explode(F.expr("sequence(cast(page_start as bigint), cast(page_end as bigint))")).alias("page_no"))
    return every.join(seen.distinct(), ["doc_id", "page_no"], "left_anti")


@q("io_line_offsets", with_("li", "SELECT doc_id, line_idx, char_start, length(text) AS n_chars, page_no FROM li"))
def io_line_offsets(spark: SparkSession, d: str) -> DataFrame:
    return V.lines(table(spark, d, "documents")).select("doc_id", "line_idx", "char_start", "n_chars", "page_no")


@q("io_artifact_key", "SELECT doc_id, sha256(concat_ws('|', doc_id::VARCHAR, coalesce(title, ''), text))[1:16] AS artifact FROM documents WHERE text IS NOT NULL")
def io_artifact_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")), "text"), 256), 1, 16).alias("artifact"))


@q("io_backend", "SELECT CASE WHEN lower(source_path) LIKE '%.pdf' THEN 'pdf' WHEN lower(source_path) LIKE '%.docx' THEN 'docx' WHEN source_path IS NULL THEN 'none' ELSE 'text' END AS backend, coalesce(upper(doc_type), 'UNKNOWN') AS doc_type, count(*) AS n FROM documents GROUP BY 1, 2")
def io_backend(spark: SparkSession, d: str) -> DataFrame:
    p = F.lower("source_path")
    backend = F.when(p.endswith(".pdf"), "pdf").when(p.endswith(".docx"), "docx").when(F.col("source_path").isNull(), "none").otherwise("text")
    return table(spark, d, "documents").groupBy(backend.alias("backend"), F.coalesce(F.upper("doc_type"), F.lit("UNKNOWN")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))


@q("io_pairs_by_document", with_("qu", "SELECT doc_id, count(*) AS n_pairs, count(answer) AS n_answered FROM qu GROUP BY 1"))
def io_pairs_by_document(spark: SparkSession, d: str) -> DataFrame:
    return V.questions(table(spark, d, "questions")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("answer").alias("n_answered"))


@q("io_fact_store_merge", with_("fa", r"""SELECT coalesce(b.fact_id, a.fact_id) AS fact_id, coalesce(b.text, a.text) AS text, b.fact_id IS NOT NULL AS overridden FROM
  (SELECT fact_id, text FROM fa WHERE length(text) < 90) a FULL JOIN (SELECT fact_id, '* ' || text AS text FROM fa WHERE length(text) >= 60) b ON a.fact_id = b.fact_id"""))
def io_fact_store_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two stores merged: one of the facts under 90 characters, and one of those from 60 on, whose text wins."""
    f = V.facts(table(spark, d, "chunks"))
    a, b = f.filter(F.length("text") < 90).select("fact_id", "text"), f.filter(F.length("text") >= 60).select(F.col("fact_id").alias("b"), F.concat(F.lit("* "), "text").alias("bt"))
    return a.join(b, F.col("fact_id") == F.col("b"), "full").select(F.coalesce("b", "fact_id").alias("fact_id"), F.coalesce("bt", "text").alias("text"), F.col("b").isNotNull().alias("overridden"))


@q("io_foreign_chunk_rows", "SELECT DISTINCT chunk_id, doc_id, nullif(trim(text), '') AS text, coalesce(page_start, page_end) AS page_start, coalesce(page_end, page_start) AS page_end, coalesce(extractor, 'unknown') AS backend FROM chunks")
def io_foreign_chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "doc_id", F.nullif(F.trim("text"), F.lit("")).alias("text"), F.coalesce("page_start", "page_end").alias("page_start"), F.coalesce("page_end", "page_start").alias("page_end"), F.coalesce("extractor", F.lit("unknown")).alias("backend")).distinct()


@q("io_import_by_prefix", "SELECT q.q_id, d.doc_id FROM (SELECT DISTINCT q_id, split_part(q_id, '_', 1) AS p FROM questions) q JOIN documents d ON d.doc_id::VARCHAR = q.p")
def io_import_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose id begins with a document's id, met by the part before the first underscore."""
    ids = table(spark, d, "questions").select("q_id", F.split_part("q_id", F.lit("_"), F.lit(1)).alias("p")).distinct()
    return ids.join(table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("p")), "p").select("q_id", "doc_id")


@q("tx_tokens", f"SELECT t AS token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({tok('text')}) AS t FROM documents) GROUP BY 1")
def tx_tokens(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("token").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@q("tx_bridge_tokens", with_("fa", "SELECT t AS token, count(*) AS n FROM (SELECT CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS t FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM fa) WHERE w <> '') GROUP BY 1"))
def tx_bridge_tokens(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(table(spark, d, "chunks")).select(F.explode(T.bridge_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


@q("tx_content_tokens", f"SELECT w AS token, count(*) AS n_docs FROM (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{{3,}}'), lambda x: lower(x)))) AS w FROM documents) WHERE NOT list_contains({_STOP}, w) GROUP BY 1")
def tx_content_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(T.content_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


@q("tx_clean", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{00ad}\f]', '', 'g'), '([a-z])-\n([a-z])', '\1\2', 'g'), '[•●▪]', '-', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents""")
def tx_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("h"))


@q("tx_strip_watermark", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text || ' Printed copies are uncontrolled', '(?i)(user name\s*:\s*\S+\s+)?(printed copies are uncontrolled|uncontrolled when printed)', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents""")
def tx_strip_watermark(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_watermark(F.concat("text", F.lit(" Printed copies are uncontrolled")))).alias("h"))


@q("tx_list_markers", with_("li", r"SELECT doc_id, line_idx, regexp_replace(regexp_replace(regexp_replace(text, '^\s*([0-9]+(\.[0-9]+)*\.?\s+|[-*•]\s+)', ''), '\s*[•*]\s*$', ''), '^\s+|\s+$', '', 'g') AS text FROM li WHERE regexp_matches(text, '^\s*[0-9•*-]')"))
def tx_list_markers(spark: SparkSession, d: str) -> DataFrame:
    return V.lines(table(spark, d, "documents")).filter(F.col("text").rlike(r"^\s*[0-9•*-]")).select("doc_id", "line_idx", T.strip_list_marker(F.col("text")).alias("text"))


@q("tx_question_key", with_("qu", "SELECT trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) AS key, count(*) AS n, min(q_id) AS q_id FROM qu WHERE question IS NOT NULL GROUP BY 1"))
def tx_question_key(spark: SparkSession, d: str) -> DataFrame:
    return V.questions(table(spark, d, "questions")).filter("question is not null").groupBy(T.dedup_key(F.col("question")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("q_id").alias("q_id"))


@q("tx_chunk_key", r"SELECT DISTINCT id, regexp_replace(id, '_c0*([0-9]+)$', '_c\1') AS key FROM (SELECT unnest(retrieved_chunk_ids) AS id FROM retrievals) WHERE id IS NOT NULL")
def tx_chunk_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrievals").select(F.explode("retrieved_chunk_ids").alias("id")).filter("id is not null").select("id", T.chunk_key(F.col("id")).alias("key")).distinct()


@q("tx_fact_document", with_("fa", r"SELECT fact_id, regexp_extract(fact_id, '^(.+?)_F[0-9]+$', 1) AS doc, regexp_extract(fact_id, '([0-9]+)$', 1)::INT AS order_idx FROM fa"))
def tx_fact_document(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(table(spark, d, "chunks")).select("fact_id", F.regexp_extract("fact_id", "^(.+?)_F[0-9]+$", 1).alias("doc"), F.regexp_extract("fact_id", "([0-9]+)$", 1).cast("int").alias("order_idx"))


@q("tx_route", """SELECT strategy, count(*) AS n FROM (SELECT CASE WHEN scanned THEN 'ocr_block' WHEN density >= 0.4 OR doc_type = 'REPORT' THEN 'table_aware' WHEN doc_type = 'ISO_STANDARD' THEN 'clause' WHEN doc_type = 'TEXTBOOK' THEN 'heading' ELSE 'recursive' END AS strategy
  FROM (SELECT coalesce(lower(trim(source)) LIKE 'scan%', false) AS scanned, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|')))::DOUBLE / len(string_split(text, chr(10))) AS density, coalesce(doc_type, 'UNKNOWN') AS doc_type FROM documents)) GROUP BY 1""")
def tx_route(spark: SparkSession, d: str) -> DataFrame:
    scanned = F.coalesce(F.lower(F.trim("source")).startswith("scan"), F.lit(False))
    s = C.route(scanned, C.table_density(F.col("text")), F.coalesce("doc_type", F.lit("UNKNOWN")))
    return table(spark, d, "documents").groupBy(s.alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


_CUT = r"""SELECT doc_id, unnest(range(len(s) - 1))::INT AS idx, unnest(s[2:]) AS section FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^({0})', chr(1) || '\1', 'g'), chr(1)) AS s FROM documents) WHERE len(s) > 1"""


@q("tx_clause_sections", _CUT.format(T.CLAUSE_START))
def tx_clause_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.split_sections(table(spark, d, "documents"), "clause")


@q("tx_heading_sections", _CUT.format(T.HEADING_START))
def tx_heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.split_sections(table(spark, d, "documents"), "heading")


@q("tx_recursive_chunks")
def tx_recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.split_documents(table(spark, d, "documents"), "recursive")


@q("tx_sentence_chunks")
def tx_sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.split_documents(table(spark, d, "documents"), "sentence", 700, 100)


@q("tx_pack_units", """WITH RECURSIVE """ + with_("li", "")[5:] + """, r AS (
  SELECT doc_id, line_idx, 0 AS idx, length(text) AS held FROM li WHERE line_idx = 0
  UNION ALL SELECT li.doc_id, li.line_idx, CASE WHEN held + length(text) > 900 THEN idx + 1 ELSE idx END, CASE WHEN held + length(text) > 900 THEN length(text) ELSE held + length(text) END FROM r JOIN li ON li.doc_id = r.doc_id AND li.line_idx = r.line_idx + 1)
  SELECT r.doc_id, r.idx, count(*)::INT AS n_units, sum(length(li.text))::INT AS n_chars, min(li.page_no) AS page_start, max(li.page_no) AS page_end FROM r JOIN li USING (doc_id, line_idx) GROUP BY 1, 2""")
def tx_pack_units(spark: SparkSession, d: str) -> DataFrame:
    return C.pack_lines(V.lines(table(spark, d, "documents")), 900)


@q("tx_rechunk_sentences", with_("ch", r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(chunk_id), chunk_id, i)::INT - 1 AS idx, text FROM (SELECT doc_id, chunk_id, unnest(k) AS text, unnest(range(len(k))) AS i FROM (
  SELECT doc_id, chunk_id, CASE WHEN len(k) > 0 THEN k ELSE [text] END AS k FROM (SELECT doc_id, chunk_id, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 30) AS k FROM ch)))"""))
def tx_rechunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    return C.rechunk(V.chunk_rows(table(spark, d, "chunks")), "sentence")


@q("tx_rechunk_paragraphs", with_("ch", r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(chunk_id), chunk_id, i)::INT - 1 AS idx, text FROM (SELECT doc_id, chunk_id, unnest(k) AS text, unnest(range(len(k))) AS i FROM (
  SELECT doc_id, chunk_id, CASE WHEN len(k) > 0 THEN k ELSE [text] END AS k FROM (SELECT doc_id, chunk_id, text, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 50) AS k FROM ch)))"""))
def tx_rechunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return C.rechunk(V.chunk_rows(table(spark, d, "chunks")), "paragraph")


@q("tx_sliding_windows", r"""SELECT doc_id, (s // 128)::INT AS idx, array_to_string(t[s + 1:s + 256], ' ') AS text FROM (SELECT doc_id, t, unnest(range(0, len(t), 128)) AS s FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS t FROM documents))""")
def tx_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.sliding(table(spark, d, "documents"))


@q("tx_chunk_pages", with_("ch li", """SELECT chunk_id, list_sort(list(DISTINCT li.page_no)) AS pages, sum(least(ch.char_end, li.char_start + length(li.text)) - greatest(ch.char_start, li.char_start))::BIGINT AS unit_chars
  FROM ch JOIN li ON li.doc_id = ch.doc_id AND li.char_start + length(li.text) > ch.char_start AND li.char_start < ch.char_end GROUP BY 1"""))
def tx_chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    units = V.lines(table(spark, d, "documents")).select("doc_id", "char_start", (F.col("char_start") + F.col("n_chars")).alias("char_end"), "page_no")
    return C.pages_of(V.chunk_rows(table(spark, d, "chunks")).select("chunk_id", "doc_id", "char_start", "char_end"), units)


@q("tx_facts", with_("fa", "SELECT fact_id, chunk_id, doc_id, text, page_start, order_idx FROM fa"))
def tx_facts(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(table(spark, d, "chunks"))


@q("tx_expand_short_facts", with_("fa", r"""SELECT fact_id, CASE WHEN len(string_split_regex(trim(text), '\s+')) < 12 AND b IS NOT NULL THEN b || ' ' || text WHEN len(string_split_regex(trim(text), '\s+')) < 12 AND a IS NOT NULL THEN text || ' ' || a ELSE text END AS text
  FROM (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a FROM fa WINDOW w AS (PARTITION BY chunk_id ORDER BY order_idx))"""))
def tx_expand_short_facts(spark: SparkSession, d: str) -> DataFrame:
    return C.expand_short(V.facts(table(spark, d, "chunks")))


@q("tx_decompose_answers", with_("qu", r"""SELECT q_id, i::INT AS idx, CASE WHEN c LIKE '%.' THEN c ELSE c || '.' END AS claim FROM (SELECT q_id, unnest(l) AS c, unnest(range(len(l))) AS i FROM (SELECT q_id, list_filter(list_transform(string_split_regex(answer, '[.!?;]\s+|,?\s+(?:and|but|while)\s+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 5) AS l FROM qu))"""))
def tx_decompose_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers cut into claims at sentence ends and conjunctions."""
    parts = F.filter(F.transform(F.split("answer", r"[.!?;]\s+|,?\s+(?:and|but|while)\s+"), T.strip), lambda x: F.length(x) >= 5)
    rows = V.questions(table(spark, d, "questions")).select("q_id", F.posexplode(parts).alias("idx", "c"))
    return rows.select("q_id", "idx", F.when(F.col("c").endswith("."), F.col("c")).otherwise(F.concat("c", F.lit("."))).alias("claim"))


@q("tx_compose_answers", with_("fa", """SELECT a.fact_id, rtrim(a.text, '.') || '; ' || CASE WHEN regexp_matches(b.text, '^[A-Z][a-z]') THEN lower(b.text[1]) || b.text[2:] ELSE b.text END AS answer FROM fa a JOIN fa b ON a.doc_id = b.doc_id AND b.order_idx = a.order_idx + 1"""))
def tx_compose_answers(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring facts joined into one answer; the second starts small unless its second letter is large."""
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("order_idx"))
    f = V.facts(table(spark, d, "chunks")).withColumn("b", after).filter("b is not null")
    second = F.when(F.col("b").rlike("^[A-Z][a-z]"), F.concat(F.lower(F.substring("b", 1, 1)), F.expr("substring(b, 2)"))).otherwise(F.col("b"))
    return f.select("fact_id", F.concat(F.rtrim("text", F.lit(".")), F.lit("; "), second).alias("answer"))


@q("tx_candidate_spans", with_("fa", r"""SELECT fact_id, unnest(CASE WHEN len(n) > 0 THEN n ELSE c END) AS span FROM (SELECT fact_id, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?') AS n, regexp_extract_all(text, '[A-Z][a-z]{3,}') AS c FROM fa)"""))
def tx_candidate_spans(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a fact, else its capitalised words: what a changed copy could replace."""
    n, c = T.extract_all(F.col("text"), r"[0-9]+(?:\.[0-9]+)?"), T.extract_all(F.col("text"), "[A-Z][a-z]{3,}")
    return V.facts(table(spark, d, "chunks")).select("fact_id", F.explode(F.when(F.size(n) > 0, n).otherwise(c)).alias("span"))
