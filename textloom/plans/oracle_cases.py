"""DuckDB SQL of the queries in ``cases``. Written apart from the Spark code on purpose."""

from __future__ import annotations

from . import oracle as o

NORMAL = o.NORMAL.format("text")
ENDS = "' ' || chr(10)"

#: The widths of a window: the widest, then a tenth less, rounded up, again and again.
_WIDTHS = ["least(2700, len(t) - pos)"]
for _ in range(5):
    _WIDTHS.append(f"({_WIDTHS[-1]} - ceil({_WIDTHS[-1]} * 0.1::DOUBLE))")
HARD = f"""d AS (SELECT doc_id, {NORMAL} AS t FROM documents
), w AS (
  SELECT doc_id, t, 0::BIGINT AS pos, -1::BIGINT AS k, ''::VARCHAR AS x, 0::BIGINT AS first FROM d
  UNION ALL
  SELECT doc_id, t, pos + instr(substr(t, pos + 1), b) - 1 + len(b), k + 1, b, pos + instr(substr(t, pos + 1), b) - 1
  FROM (SELECT *, list_filter([{', '.join(f"trim(substr(t, pos + 1, ({w})::BIGINT), {ENDS})" for w in _WIDTHS)}], lambda b: len(b) <= 1800)[1] AS b FROM w WHERE pos < len(t))
)"""
#: As ``OVERLAPPED``, drawn back by a tenth of the tokens of the span before, at least by one token and eight characters.
RATIO = o.OVERLAPPED.replace("right(o.x, 32)", "right(o.x, greatest(8, 4 * greatest(1, floor(((len(o.x) + 3) // 4) * 0.1::DOUBLE)))::BIGINT)")

FLOWING = ["it goes on and on,", "half a word of a long para-", "this line comes to its end!", "这是一段比较长的中文文字还没有结束", "中文的句子到这里就结束了。", "1. a list row of the page", "第三章 概述", "continues in lower case with"]
BLOCKS = f"""{o.PAGE_BLOCKS}, g AS (
  SELECT doc_id, page_no, block_no, floor(x0 / 100) * 100.0::DOUBLE AS x0, y0, x1, y1, is_table, block_no % 8 AS k, {o.ROLE} AS role, [{', '.join(repr(t) for t in FLOWING)}][block_no % 8 + 1] AS text FROM b
)"""


def fold(typed: str) -> str:
    """Blocks g in column order, folded page by page; ``typed`` says which may join, and rows are numbered by ``place``."""
    return f"""c AS (SELECT *, list_sort(list((x0 + x1) / 2) OVER (PARTITION BY doc_id, page_no)) AS mids FROM g WHERE {typed}
), o AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CASE WHEN (x0 + x1) / 2 <= mids[len(mids) // 2 + 1] THEN 0 ELSE 1 END, round_even(y0 / 12, 0), x0, block_no, x1, y1) - 1 AS place FROM c
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY place) AS n FROM o WHERE free
), f AS (
  SELECT doc_id, page_no, n, place AS head, k AS head_k, role, x0, y0, x1, y1, text FROM r WHERE n = 1
  UNION ALL
  SELECT doc_id, page_no, n, CASE WHEN j THEN a_head ELSE place END, CASE WHEN j THEN a_k ELSE k END, CASE WHEN j THEN a_role ELSE role END, CASE WHEN j THEN least(a_x0, x0) ELSE x0 END, CASE WHEN j THEN least(a_y0, y0) ELSE y0 END,
         CASE WHEN j THEN greatest(a_x1, x1) ELSE x1 END, CASE WHEN j THEN greatest(a_y1, y1) ELSE y1 END,
         CASE WHEN NOT j THEN text WHEN right(a_text, 1) = '-' AND regexp_matches(text, '^[\\p{{L}}\\p{{N}}]') THEN left(a_text, len(a_text) - 1) || text
              WHEN regexp_matches(a_text, '[一-鿿]$') AND regexp_matches(text, '^[一-鿿]') THEN a_text || text ELSE a_text || ' ' || text END
  FROM (SELECT b.*, a.head AS a_head, a.head_k AS a_k, a.role AS a_role, a.x0 AS a_x0, a.y0 AS a_y0, a.x1 AS a_x1, a.y1 AS a_y1, a.text AS a_text,
               a.role = 'body' AND b.role = 'body' AND b.y0 - a.y1 >= -2 AND b.y0 - a.y1 <= greatest(18.0, least(greatest(a.y1 - a.y0, 1.0), greatest(b.y1 - b.y0, 1.0)) * 1.6)
               AND (abs(a.x0 - b.x0) <= 18 OR abs(a.x1 - b.x1) <= 48) AND b.k NOT IN (5, 6) AND a.text NOT SIMILAR TO '(?s).*[。！？!?；;：:]' AND a.paragraph AND b.paragraph AS j
        FROM (SELECT *, NOT typed OR head_k NOT IN (5, 6) AS paragraph FROM f, (SELECT {'true' if typed != 'true' else 'false'} AS typed)) a
        JOIN (SELECT *, NOT typed OR k NOT IN (5, 6) AS paragraph FROM r, (SELECT {'true' if typed != 'true' else 'false'} AS typed)) b ON b.doc_id = a.doc_id AND b.page_no = a.page_no AND b.n = a.n + 1)
)"""


LAST = "arg_max({0}, n) AS {0}"
MERGED = f"{BLOCKS.replace('is_table, ', 'true AS free, ')}, {fold('true')}"
FREE = BLOCKS.replace("is_table, ", "is_table, NOT EXISTS (SELECT 1 FROM b t WHERE t.is_table AND t.doc_id = b.doc_id AND t.page_no = b.page_no AND floor(b.x0 / 100) * 100.0 < t.x1 AND b.x1 > floor(t.x0 / 100) * 100.0 AND b.y0 < t.y1 AND b.y1 > t.y0) AS free, ")
PAGES = f"""{FREE}, {fold('NOT is_table')}, texts AS (
  SELECT doc_id, page_no, head, {', '.join(LAST.format(c) for c in ('x0', 'y0', 'text'))}, any_value(head_k) AS k, arg_max(role, n) AS role FROM f GROUP BY doc_id, page_no, head
), parts AS (
  SELECT doc_id, page_no, CASE WHEN k = 5 THEN 'list' WHEN k = 6 THEN 'title' ELSE 'paragraph' END AS node_type, role, text FROM texts
  UNION ALL SELECT doc_id, page_no, 'table', NULL, 't | ' || block_no FROM g WHERE is_table
), counted AS (SELECT *, CASE WHEN len(text) <= 100 THEN count(*) OVER (PARTITION BY doc_id, text) ELSE 0 END AS n FROM parts)"""

PLAIN = f"""p AS (
  SELECT doc_id // 3 AS doc_id, doc_id % 3 + 1 AS page_no, 'Running head ' || (doc_id // 3) || repeat(chr(10), 2) || replace(text, chr(10), repeat(chr(10), 2)) || repeat(chr(10), 3) || '3 / 7' AS t FROM documents
), l AS (
  SELECT doc_id, page_no, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS raw FROM (SELECT doc_id, page_no, unnest(string_split(t, chr(10))) AS raw FROM p)
), c AS (SELECT *, CASE WHEN len(raw) <= 100 THEN count(*) OVER (PARTITION BY doc_id, raw) ELSE 0 END AS n FROM l WHERE raw <> '')"""

LINES = f"""l AS (
  SELECT doc_id, line_no AS block_id, raw AS text, len(raw) AS n_chars, {o.TOKENS.format('raw')} AS tokens, line_no // 6 AS path, line_no % 9 = 0 OR line_no % 13 = 5 AS barred,
         row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) WHERE raw <> ''
), f AS (
  SELECT doc_id, block_id, k, 0::BIGINT AS group_id, n_chars::BIGINT AS held, tokens::BIGINT AS tokens, path::BIGINT AS path, barred, NULL::BOOLEAN AS merge, NULL::VARCHAR AS strategy, NULL::DOUBLE AS score FROM l WHERE k = 1
  UNION ALL
  SELECT doc_id, block_id, k, CASE WHEN m THEN group_id ELSE group_id + 1 END, CASE WHEN m THEN a_held + 1 + n_chars ELSE n_chars END, CASE WHEN m THEN a_tokens + tokens ELSE tokens END, path,
         CASE WHEN m THEN a_barred OR barred ELSE barred END, m, s, CASE WHEN s IN ('similarity_high', 'similarity_low', 'llm_gray') THEN z END
  FROM (
    SELECT *, CASE WHEN s IN ('rule_block', 'similarity_low') THEN false WHEN s = 'similarity_high' THEN true ELSE least(a_held, 1200) % 13 > 0 AND least(n_chars, 1200) % 2 = 0 END AS m FROM (
      SELECT *, CASE WHEN NOT ok THEN 'rule_block' WHEN (a_held + n_chars) % 17 = 0 THEN 'llm_fallback' WHEN z >= 0.6 THEN 'similarity_high' WHEN z <= 0.3 THEN 'similarity_low' ELSE 'llm_gray' END AS s FROM (
        SELECT l.*, a.group_id, a.held AS a_held, a.tokens AS a_tokens, a.barred AS a_barred, ((7 * a.held + 3 * l.n_chars) % 101) / 100.0::DOUBLE AS z,
               NOT a.barred AND NOT l.barred AND a.path = l.path AND a.tokens + l.tokens <= {o.MAX_TOKENS} AS ok
        FROM f a JOIN l ON l.doc_id = a.doc_id AND l.k = a.k + 1)))
)"""

MARKED_WHOLE = f"""{o.MARKED_LINES}, placed AS (SELECT *, (sum(len(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - len(raw) - 1)::BIGINT AS pos FROM lines
), {o.RUNS.replace('FROM lines', 'FROM placed')}, {o.NODES}, raws AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS node_pos, min(pos) AS pos, string_agg(raw, chr(10) ORDER BY line_no) AS whole FROM runs WHERE class <> 'blank' GROUP BY doc_id, run
)"""
#: The lines of a document's file as paragraphs, then its table.
DOCX = """l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents
), p AS (SELECT *, trim(raw) AS bare FROM l WHERE trim(raw) <> ''
), n AS (
  SELECT doc_id, k, CASE WHEN k % 7 = 0 THEN 'title' WHEN regexp_matches(bare, '^(?:[-*+]|\\d+[.)])\\s+') THEN 'list' ELSE 'paragraph' END AS node_type, CASE WHEN k % 7 = 0 THEN k // 7 % 3 + 1 ELSE 0 END AS level, bare AS text,
         CASE WHEN k % 7 = 0 THEN 'docx_heading' ELSE 'docx_paragraph' END AS parser_strategy FROM p
  UNION ALL
  SELECT doc_id, 1000000, 'table', 0, string_agg(k || ' | ' || trim(raw), chr(10) ORDER BY k), 'docx_table' FROM l WHERE k % 5 = 0 GROUP BY doc_id
)"""
XLSX = "string_agg(k || ' |  | ' || CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END || ' | ' || trim(raw) || ' | ' || k || '.5', chr(10) ORDER BY k)"
SHEET = f"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents), s AS (SELECT doc_id, {XLSX} AS t FROM l GROUP BY doc_id)"
#: The chunks of a store after every other document was saved again with every other chunk.
STORED = f"""{o.MARKED_FACTS}, {o.SERIAL}, kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS row FROM serial WHERE doc_id % 2 = 1 OR chunk_index % 2 = 1
), heads AS (
  SELECT d.doc_id, 'file ' || d.doc_id AS filename, CASE WHEN count(k.doc_id) = 0 THEN 'failed' ELSE 'completed' END AS status, count(k.doc_id) AS total_chunks FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id
)"""

SQL = {
    "decode_malformed": "SELECT doc_id, len(text) + 2 AS n_chars, md5(text || 'zy') AS text_hash FROM documents",
    "node_offsets": f"WITH {MARKED_WHOLE} SELECT doc_id, node_pos, node_type, pos + instr(whole, text) - 1 AS start, pos + instr(whole, text) - 1 + len(text) AS \"end\", md5(text) AS text_hash FROM nodes JOIN raws USING (doc_id, node_pos)",
    "hard_split_text": f"WITH RECURSIVE {HARD} SELECT doc_id, k AS \"window\", first AS start, first + len(x) AS \"end\", md5(x) AS text_hash FROM w WHERE k >= 0",
    "overlap_ratio": f"WITH RECURSIVE {RATIO} SELECT doc_id, k - 1 AS span, first + doc_id % 7 * 1000 AS start, past + doc_id % 7 * 1000 AS \"end\", md5(x) AS text_hash FROM drawn",
    "boundary_fold": f"""WITH RECURSIVE {LINES}, m AS (SELECT doc_id, group_id, arg_max(strategy, k) FILTER (WHERE merge) AS merge_strategy, arg_max(score, k) FILTER (WHERE merge AND score IS NOT NULL) AS merge_score FROM f GROUP BY ALL)
SELECT doc_id, block_id, group_id, merge, strategy, score AS similarity_score, merge_strategy, merge_score FROM f JOIN m USING (doc_id, group_id)""",
    "model_decisions": """WITH p AS (
  SELECT conv_id AS doc_id, turn AS block_id, text, lag(text) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), q AS (
  SELECT doc_id, block_id, block_id % 4 > 0 AS passes, len(before) % 19 = 0 OR len(text) % 19 = 0 AS failed, least(len(text), 1200) % 11 > 0 AND least(len(before), 1200) % 2 = 1 AS word,
         list_cosine_similarity([(len(before) % 7 + 1)::DOUBLE, (len(before) % 5 + 1)::DOUBLE], [(len(text) % 7 + 1)::DOUBLE, (len(text) % 5 + 1)::DOUBLE]) AS z FROM p WHERE before IS NOT NULL
), s AS (SELECT *, CASE WHEN NOT passes THEN 'rule_block' WHEN failed THEN 'llm_fallback' WHEN z >= 0.99 THEN 'similarity_high' WHEN z <= 0.8 THEN 'similarity_low' ELSE 'llm_gray' END AS strategy FROM q)
SELECT doc_id, block_id, CASE strategy WHEN 'similarity_high' THEN true WHEN 'llm_gray' THEN word WHEN 'llm_fallback' THEN word ELSE false END AS merge, strategy,
  CASE WHEN strategy IN ('similarity_high', 'similarity_low', 'llm_gray') THEN round(z, 4) END AS similarity_score FROM s""",
    "counted_tokens": r"SELECT conv_id, turn, len(regexp_extract_all(left(text, 40), '\S+')) AS tokens FROM conversations",
    "paragraph_merge": f"WITH RECURSIVE {MERGED} SELECT doc_id, page_no, head AS place, {', '.join(LAST.format(c) for c in ('x0', 'y0', 'x1', 'y1', 'text'))} FROM f GROUP BY doc_id, page_no, head",
    "page_assembly": f"WITH RECURSIVE {PAGES} SELECT doc_id, page_no AS source_page, node_type, CASE WHEN node_type = 'title' THEN 1 ELSE 0 END AS level, md5(text) AS text_hash FROM counted WHERE NOT (n >= 2 AND coalesce(role, 'header_zone') IN ('header_zone', 'footer_zone'))",
    "plain_pages": rf"WITH {PLAIN} SELECT doc_id, page_no AS source_page, {o.PAGE_CLASS} AS node_type, md5(raw) AS text_hash FROM c WHERE n < 2 AND NOT regexp_matches(raw, '(?i)^(?:page\s*\d+|第\s*\d+\s*页|\d+\s*/\s*\d+)$')",
    "ocr_router": """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN (CASE WHEN doc_id % 3 = 0 THEN left(text, 30) ELSE text END) END AS own, CASE WHEN doc_id % 4 > 0 THEN 'read: ' || text END AS ocr FROM documents
), c AS (SELECT doc_id, CASE WHEN coalesce(len(own), 0) < 40 AND ocr IS NOT NULL THEN ocr ELSE own END AS t FROM p) SELECT doc_id, md5(t) AS text_hash FROM c WHERE t IS NOT NULL""",
    "picture_nodes": f"""WITH b AS (SELECT item_id, text, item_id % 12 + 1 AS page, len(text) AS n FROM benchmark WHERE item_id % 12 < 10)
SELECT item_id, 'page_' || page AS place, CASE WHEN n % 2 = 1 THEN 'table' ELSE 'paragraph' END AS node_type, n % 3 AS level, md5(trim(text, {ENDS})) AS text_hash, CASE WHEN n % 4 = 0 THEN 7 ELSE item_id % 5 END AS "order", 'picture 1,2,3,4' AS region FROM b WHERE n % 10 <> 3
UNION ALL SELECT item_id, 'failed', NULL, NULL, NULL, NULL, 'no answer' FROM b WHERE n % 10 = 3""",
    "docx_files": f"WITH {DOCX} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS node_pos, node_type, level, md5(text) AS text_hash, parser_strategy FROM n",
    "xlsx_files": f"WITH {SHEET} SELECT doc_id, 0 AS node_pos, 'title' AS node_type, 1 AS level, md5('lines') AS text_hash, 'lines' AS sheet_name FROM s UNION ALL SELECT doc_id, 1, 'table', 0, md5(t), 'lines' FROM s",
    "read_errors": f"""WITH {SHEET} SELECT doc_id, 'title' AS node_type, md5('lines') AS text_hash, NULL::VARCHAR AS error, 200 AS status FROM s WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 'table', md5(t), NULL, 200 FROM s WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, NULL, NULL, CASE WHEN doc_id % 3 = 0 THEN 'parse_error' ELSE 'missing_reader' END, 500 FROM s WHERE doc_id % 3 <> 1""",
    "barred_addresses": """WITH a AS (
  SELECT l_orderkey, l_linenumber, [0, 8, 10, 100, 127, 169, 172, 192, 198, 203, 223, 224, 240, 255][l_partkey % 14 + 1] AS a, [0, 15, 16, 18, 19, 31, 32, 51, 88, 168, 254][l_suppkey % 11 + 1] AS b, [0, 2, 99, 100, 113][l_orderkey % 5 + 1] AS c, l_orderkey % 256 AS d FROM lineitem
) SELECT l_orderkey, l_linenumber, a || '.' || b || '.' || c || '.' || d AS address,
  a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND (b = 168 OR (b = 0 AND (c = 2 OR (c = 0 AND d NOT IN (9, 10)))))) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113) AS barred FROM a""",
    "store_pages": f"WITH {STORED} SELECT h.doc_id::VARCHAR AS document_id, filename, status, total_chunks, chunk_index, chunk_type, CASE WHEN k.doc_id IS NOT NULL THEN {o.PREVIEW.format('text')} END AS preview_text FROM heads h LEFT JOIN (SELECT * FROM kept WHERE row BETWEEN 5 AND 8) k USING (doc_id)",
    "store_lookups": f"WITH {STORED} SELECT doc_id::VARCHAR AS document_id, 'file ' || doc_id AS filename, chunk_index, md5(trim(text, {ENDS})) AS text_hash FROM kept ORDER BY sha256(doc_id || ':' || chunk_index) LIMIT 1",
    "exempt_requests": "SELECT ['/health', '/metrics', '/chunk', '/health/x'][user_id % 4 + 1] AS path, user_id % 4 < 2 AS exempt, count(*) AS n FROM events GROUP BY ALL",
    "pipeline_metrics": f"""WITH RECURSIVE {o.OVERLAPPED}, n AS (SELECT *, lag(past) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM drawn)
SELECT doc_id, count(*) AS n_spans, count(*) FILTER (WHERE first < before) AS n_overlaps, sum((len(x) + 3) // 4)::BIGINT AS tokens FROM n GROUP BY doc_id""",
    "parsed_node_texts": f"WITH RECURSIVE {o.TURNS} SELECT doc_id, chunk_index, chunk_type, path AS section_path, tokens, md5(trim(text, {ENDS})) AS text_hash FROM chunks",
    "normal_node_texts": f"WITH {o.MARKED_NODES}, {o.NORMALISED} SELECT doc_id, node_pos, node_type, level, md5(text) AS text_hash FROM tidy",
}
