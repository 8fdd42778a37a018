"""The derived tables of quarry.functions.views in DuckDB's SQL."""

from __future__ import annotations

_KEY = r"regexp_replace(trim(lower({0})), '_c0*([0-9]+)$', '_c\1')"

CTES = {
    "ch": f"""SELECT k AS chunk_id, nullif(r.doc_id, -1) AS doc_id, r.text AS text, nullif(r.char_start, -1) AS char_start, nullif(r.char_end, -1) AS char_end, nullif(r.page_start, -1) AS page_start, nullif(r.page_end, -1) AS page_end FROM (SELECT {_KEY.format('chunk_id')} AS k,
      max(struct_pack(at := coalesce(cached_at, TIMESTAMP '1970-01-01'), doc_id := coalesce(doc_id, -1), text := text, char_start := coalesce(char_start, -1), char_end := coalesce(char_end, -1), page_start := coalesce(page_start, -1), page_end := coalesce(page_end, -1))) AS r FROM chunks WHERE text IS NOT NULL GROUP BY 1)""",
    "li": """SELECT doc_id, line_idx, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, (line_idx // 3 + 1)::INT AS page_no
      FROM (SELECT doc_id, unnest(l) AS text, unnest(range(len(l)))::INT AS line_idx FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))""",
    "fa": r"""SELECT printf('%d_F%06d', doc_id, order_idx) AS fact_id, chunk_id, doc_id, text, page_start, order_idx FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(chunk_id), chunk_id, i)::INT AS order_idx FROM (
      SELECT chunk_id, doc_id, page_start, i, regexp_replace(s, '^\s+|\s+$', '', 'g') AS text FROM (
      SELECT chunk_id, doc_id, page_start, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT *, regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)') AS l FROM ch))) WHERE length(text) >= 30)""",
    "qu": "SELECT q_id, min(doc_id) AS doc_id, min(question) AS question, min(answer) AS answer, coalesce(min(hop_type), 'single') AS hop_type, max(gold_chunk_ids) AS gold_chunk_ids FROM questions GROUP BY 1",
    "go": f"SELECT DISTINCT q_id, {_KEY.format('g')} AS chunk_id FROM (SELECT q_id, unnest(gold_chunk_ids) AS g FROM qu) WHERE g IS NOT NULL",
    "rr": f"""SELECT ret_id, min(q_id) AS q_id, min(mode) AS mode, min(top_k) AS top_k, max(ids) AS ids FROM (
      SELECT ret_id, q_id, coalesce(lower(trim(search_mode)), 'unknown') AS mode, top_k,
        list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(retrieved_chunk_ids, lambda x: x IS NOT NULL), lambda x: [{_KEY.format('x')}])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS ids
      FROM retrievals WHERE q_id IS NOT NULL AND retrieved_chunk_ids IS NOT NULL) GROUP BY 1""",
    "rk": "SELECT ret_id, q_id, mode, unnest(range(1, len(ids) + 1))::INT AS rank, unnest(ids) AS chunk_id FROM rr",
}
NEEDS = {"fa": ("ch",), "go": ("qu",), "rk": ("rr",)}


def with_(names: str, body: str) -> str:
    """body with the named tables in front."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


def tok(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
