"""The registered queries in DuckDB SQL, from a few shared table expressions. Written apart from the Spark code on purpose."""

from __future__ import annotations

#: The separators and budgets that both sides must share.
SEPARATORS = ["\n\n", "\n", "\t", "。", "！", "？", ". ", "! ", "? ", "；", "; ", "，", ", ", " ", "-", "_"]
MAX_TOKENS, MIN_TOKENS = 450, 100
US = "chr(31)"


def literal(text: str) -> str:
    """A text as SQL, control characters by number."""
    parts = [f"chr({ord(c)})" if ord(c) < 32 else "'" + c.replace("'", "''") + "'" for c in text]
    return " || ".join(parts)


TOKENS = "((len(trim({0}, ' ' || chr(9) || chr(10))) + 3) // 4)"
NORMAL = "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10))"
TABLE_NORMAL = "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10))"
PREVIEW = "CASE WHEN len(trim(replace({0}, chr(10), ' '))) > 200 THEN rtrim(left(trim(replace({0}, chr(10), ' ')), 200)) || '...' ELSE trim(replace({0}, chr(10), ' ')) END"

#: The prose with headings and list rows put in by line number.
MARKED = """marked AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE
      WHEN (i - 1) % 11 = 0 THEN repeat('#', (((i - 1) // 11) % 3 + 1)::INT) || ' ' || left(l, 24)
      WHEN (i - 1) % 5 = 0 THEN '- ' || l ELSE l END), chr(10)) AS text
  FROM documents
)"""


def lines(source: str, classes: str) -> str:
    return f"""lines AS (
  SELECT doc_id, line_no, raw, {classes} AS class FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {source}
  )
)"""


MARKDOWN_CLASS = r"""CASE WHEN regexp_matches(trim(raw), '^#{1,6}\s+.*$') THEN 'title'
    WHEN len(raw) - len(replace(raw, '|', '')) >= 2 THEN 'table'
    WHEN regexp_matches(trim(raw), '^(?:[-*+]|\d+[.)])\s+.') THEN 'list'
    WHEN trim(raw) = '' THEN 'blank' ELSE 'paragraph' END"""
ITEM = r"'^\s*(?:[-*+•●]|\d+[.)]|（\d+）)\s+'"
NUMBERED = r"第[一二三四五六七八九十百千万\d]+[章节部分篇]|[一二三四五六七八九十]+[、.]|\d+(?:\.\d+){0,3}[、.]?"
MARKS = "'[。！？!?；;，,]'"
OFFICE_CLASS = rf"""CASE WHEN trim(raw) = '' THEN 'blank' WHEN regexp_matches(trim(raw), {ITEM}) THEN 'list'
    WHEN len(trim(raw)) <= 24 AND NOT regexp_matches(trim(raw), {MARKS}) AND regexp_matches(trim(raw), '^(?:{NUMBERED})?\s*\S+$') THEN 'title'
    ELSE 'paragraph' END"""
PAGE_CLASS = rf"""CASE WHEN len(raw) - len(replace(raw, '|', '')) >= 2 THEN 'table' WHEN regexp_matches(trim(raw), {ITEM}) THEN 'list'
    WHEN len(trim(raw)) <= 28 AND NOT regexp_matches(trim(raw), '[@|]|\d{{4}}\.\d{{2}}|\d{{11}}') AND NOT regexp_matches(trim(raw), {MARKS})
      AND len(trim(raw)) - len(replace(trim(raw), ' ', '')) <= 3
      AND (regexp_matches(trim(raw), '^(?:{NUMBERED})\s*\S+') OR len(trim(raw)) <= 12) THEN 'title' ELSE 'paragraph' END"""

RUNS = """runs AS (
  SELECT *, sum(CASE WHEN before IS NULL OR before <> class OR class = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (
    SELECT *, lag(class) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines
  )
)"""
NODES = r"""nodes AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS node_pos, node_type,
         CASE WHEN node_type = 'title' THEN len(regexp_extract(body, '^(#{1,6})\s+(.*)$', 1)) ELSE 0 END AS level,
         CASE WHEN node_type = 'title' THEN trim(regexp_extract(body, '^(#{1,6})\s+(.*)$', 2)) ELSE body END AS text
  FROM (SELECT doc_id, run, any_value(class) AS node_type, trim(string_agg(raw, chr(10) ORDER BY line_no), ' ' || chr(10)) AS body
        FROM runs WHERE class <> 'blank' GROUP BY doc_id, run)
)"""
NORMALISED = f"""tidy AS (
  SELECT * FROM (
    SELECT doc_id, node_pos, node_type, CASE WHEN node_type = 'title' THEN greatest(level, 1) ELSE level END AS level,
           CASE WHEN node_type = 'table' THEN {TABLE_NORMAL.format('text')} ELSE {NORMAL.format('text')} END AS text
    FROM nodes
  ) WHERE text <> ''
)"""
PATHS = """pathed AS (
  SELECT *, coalesce(list_reduce(list_transform(titles, lambda t: {'level': t.level, 'path': [t.text]}),
      lambda a, t: {'level': t.level, 'path': list_concat(a.path[1:t.level - 1], t.path)}, {'level': 0::BIGINT, 'path': []::VARCHAR[]}).path, []) AS path
  FROM (SELECT *, list({'level': level, 'text': text}) FILTER (WHERE node_type = 'title')
          OVER (PARTITION BY doc_id ORDER BY node_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS titles FROM tidy)
)"""
BLOCKS = f"""blocked AS (
  SELECT *, sum(CASE WHEN before IS NULL OR (before <> 'title' AND (before IN ('table', 'list') OR size > 1200 OR node_type IN ('table', 'title'))) THEN 1 ELSE 0 END)
              OVER (PARTITION BY doc_id ORDER BY node_pos) - 1 AS block_id,
         {TOKENS.format('text')} AS tokens
  FROM (SELECT *, lag(node_type) OVER w AS before, lag(len(text)) OVER w AS size FROM pathed WINDOW w AS (PARTITION BY doc_id ORDER BY node_pos))
)"""


def facts(source: str, name: str = "facts", group: str = "block_id") -> str:
    return f"""{name} AS (
  SELECT doc_id, {group} AS block_id, string_agg(text, chr(10) ORDER BY node_pos) AS text,
         coalesce(array_to_string(arg_max(path, node_pos) FILTER (WHERE len(path) > 0), ' > '), '') AS path, sum(tokens)::BIGINT AS tokens, count(*) AS n_nodes,
         count(*) FILTER (WHERE node_type = 'title') AS n_title, count(*) FILTER (WHERE node_type = 'paragraph') AS n_paragraph,
         count(*) FILTER (WHERE node_type = 'table') AS n_table, count(*) FILTER (WHERE node_type = 'list') AS n_list
  FROM {source} GROUP BY doc_id, {group}
)"""


CHUNK_TYPE = """CASE WHEN n_title = n_nodes THEN 'title' WHEN n_paragraph = n_nodes THEN 'paragraph' WHEN n_table = n_nodes THEN 'table'
    WHEN n_list = n_nodes THEN 'list' WHEN n_table > 0 THEN 'table' WHEN n_list > 0 THEN 'list' ELSE 'mixed' END"""
KIND = """CASE WHEN {0}.n_nodes = 1 THEN (CASE WHEN {0}.n_title = 1 THEN 'title' WHEN {0}.n_paragraph = 1 THEN 'paragraph' WHEN {0}.n_table = 1 THEN 'table' ELSE 'list' END)
    WHEN {0}.n_title = {0}.n_nodes THEN 'title' WHEN {0}.n_table > 0 THEN 'table' WHEN {0}.n_list > 0 THEN 'list' ELSE 'mixed' END"""
#: Merging one block after another, as a recursion over the blocks of all documents at once.
GROUPS = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS k FROM facts
), folded AS (
  SELECT doc_id, block_id, k, 0::BIGINT AS group_id, path, tokens, n_nodes::BIGINT AS n_nodes, n_title::BIGINT AS n_title, n_paragraph::BIGINT AS n_paragraph, n_table::BIGINT AS n_table, n_list::BIGINT AS n_list
  FROM numbered WHERE k = 1
  UNION ALL
  SELECT doc_id, block_id, k, CASE WHEN joins THEN group_id ELSE group_id + 1 END, path, tokens + CASE WHEN joins THEN a_tokens ELSE 0 END,
         (n_nodes + CASE WHEN joins THEN a_nodes ELSE 0 END)::BIGINT, (n_title + CASE WHEN joins THEN a_title ELSE 0 END)::BIGINT,
         (n_paragraph + CASE WHEN joins THEN a_paragraph ELSE 0 END)::BIGINT, (n_table + CASE WHEN joins THEN a_table ELSE 0 END)::BIGINT, (n_list + CASE WHEN joins THEN a_list ELSE 0 END)::BIGINT
  FROM (
    SELECT b.*, a.group_id, a.tokens AS a_tokens, a.n_nodes AS a_nodes, a.n_title AS a_title, a.n_paragraph AS a_paragraph, a.n_table AS a_table, a.n_list AS a_list,
           a.path = b.path AND (
             (a.n_title = a.n_nodes AND {KIND.format('b')} <> 'title')
             OR ({KIND.format('a')} <> 'title' AND {KIND.format('b')} <> 'title'
                 AND NOT ({KIND.format('a')} = 'table' AND {KIND.format('b')} IN ('paragraph', 'list'))
                 AND NOT ({KIND.format('b')} = 'table' AND {KIND.format('a')} IN ('paragraph', 'list'))
                 AND b.tokens < {MIN_TOKENS} AND a.tokens + b.tokens <= {MAX_TOKENS})
           ) AS joins
    FROM folded a JOIN numbered b ON b.doc_id = a.doc_id AND b.k = a.k + 1
  )
)"""


def split_passes(source: str, name: str, most: int = MAX_TOKENS) -> str:
    """Sixteen passes over a column ``s`` of spans, one for each separator; ``source`` has it with one span."""
    steps, before = [], source
    for k, separator in enumerate(SEPARATORS):
        sep = literal(separator)
        pieces = f"list_filter(list_transform(string_split(x, {sep}), lambda p, i: trim(CASE WHEN i < len(string_split(x, {sep})) THEN p || {sep} ELSE p END, ' ' || chr(9) || chr(10))), lambda p: p <> '')"
        now = name if k == len(SEPARATORS) - 1 else f"{name}_{k}"
        steps.append(f"{now} AS (SELECT * REPLACE (flatten(list_transform(s, lambda x: CASE WHEN len(x) > {4 * most} AND contains(x, {sep}) THEN (CASE WHEN len({pieces}) > 1 THEN {pieces} ELSE [x] END) ELSE [x] END)) AS s) FROM {before})")
        before = now
    return ", ".join(steps)


def packed(most: int = MAX_TOKENS) -> str:
    return f"""list_reduce(list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN len(a[-1]) + len(x[1]) <= {4 * most}
    THEN list_concat(a[1:len(a) - 1], [a[-1] || x[1]]) ELSE list_concat(a, x) END)"""


MARKED_LINES = f"{MARKED}, {lines('marked', MARKDOWN_CLASS)}"
MARKED_NODES = f"{MARKED_LINES}, {RUNS}, {NODES}"
MARKED_BLOCKS = f"{MARKED_NODES}, {NORMALISED}, {PATHS}, {BLOCKS}"
MARKED_FACTS = f"{MARKED_BLOCKS}, {facts('blocked')}"
SERIAL = f"""serial AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS chunk_index, {CHUNK_TYPE} AS chunk_type FROM facts WHERE trim(text) <> ''
)"""

#: From merged blocks to parts: items are nodes, or the spans of a text over the budget; parts are packed item by item.
PARTS = f"""grouped AS (
  SELECT n.*, f.group_id, sum(n.tokens) OVER g AS total, count(*) OVER g AS n_all,
         coalesce(min(CASE WHEN node_type <> 'title' THEN node_pos END) OVER g, 1000000000) AS first_content
  FROM blocked n JOIN folded f USING (doc_id, block_id) WINDOW g AS (PARTITION BY n.doc_id, f.group_id)
), fitting AS (SELECT * FROM grouped WHERE total <= {MAX_TOKENS} OR first_content = 1000000000
), over AS (SELECT *, node_pos < first_content AS lead, node_type IN ('paragraph', 'list') AND tokens > {MAX_TOKENS} AS long_text FROM grouped WHERE total > {MAX_TOKENS} AND first_content < 1000000000
), spans_in AS (SELECT doc_id, node_pos, [trim(text, ' ' || chr(10))] AS s FROM over WHERE long_text AND NOT lead
), {split_passes('spans_in', 'spans')}, items AS (
  SELECT o.doc_id, o.group_id, o.node_pos, 0::BIGINT AS span, o.text, o.tokens, o.node_type, o.path, false AS solo FROM over o WHERE NOT lead AND NOT long_text
  UNION ALL
  SELECT o.doc_id, o.group_id, o.node_pos, span, t, {TOKENS.format('t')}, o.node_type, o.path, true FROM over o
  JOIN (SELECT doc_id, node_pos, unnest(p) AS t, generate_subscripts(p, 1)::BIGINT AS span FROM (SELECT doc_id, node_pos, {packed()} AS p FROM spans)) USING (doc_id, node_pos)
), ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, group_id ORDER BY node_pos, span) AS k FROM items
), placed AS (
  SELECT doc_id, group_id, node_pos, span, k, tokens, solo, 0::BIGINT AS part, tokens::BIGINT AS held FROM ordered WHERE k = 1
  UNION ALL
  SELECT doc_id, group_id, node_pos, span, k, tokens, solo, CASE WHEN fits THEN part ELSE part + 1 END, (CASE WHEN fits THEN held + tokens ELSE tokens END)::BIGINT FROM (
    SELECT o.*, p.part, p.held, NOT o.solo AND NOT p.solo AND p.held + o.tokens <= {MAX_TOKENS} AS fits
    FROM placed p JOIN ordered o ON o.doc_id = p.doc_id AND o.group_id = p.group_id AND o.k = p.k + 1
  )
), all_parts AS (
  SELECT doc_id, group_id * 100000 AS part_id, node_pos * 100000 AS node_pos, node_type, text, tokens, path FROM fitting
  UNION ALL
  SELECT doc_id, group_id * 100000, node_pos * 100000, node_type, text, tokens, path FROM over WHERE lead
  UNION ALL
  SELECT doc_id, group_id * 100000 + part, node_pos * 100000 + span, i.node_type, i.text, i.tokens, i.path FROM ordered i JOIN placed USING (doc_id, group_id, node_pos, span)
), {facts('all_parts', 'chunk_facts', 'part_id')}"""
CHUNK_ROWS = f"""{GROUPS}, {PARTS}, chunks AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS chunk_index, {CHUNK_TYPE} AS chunk_type FROM chunk_facts WHERE trim(text) <> ''
)"""
CHUNKS = f"{MARKED_FACTS}, {CHUNK_ROWS}"
TURNS = f"""nodes AS (
  SELECT conv_id AS doc_id, turn * 2 AS node_pos, 'title' AS node_type, 1::BIGINT AS level, role || ' ' || turn AS text FROM conversations
  UNION ALL SELECT conv_id, turn * 2 + 1, 'paragraph', 0, text FROM conversations
), {NORMALISED}, {PATHS}, {BLOCKS}, {facts('blocked')}, {CHUNK_ROWS}"""

#: Spans of at most 60 tokens that are drawn back over 32 characters. Only white space is lost in splitting, so the n-th
#: character that is none stands where the n-th of the text does.
OVERLAPPED = f"""d AS (SELECT doc_id, t, [t] AS s FROM (SELECT doc_id, {NORMAL.format('text')} AS t FROM documents)
), {split_passes('d', 'p', 60)}, q AS (
  SELECT doc_id, unnest(q) AS x, generate_subscripts(q, 1) AS k FROM (SELECT doc_id, {packed(60)} AS q FROM p)
), places AS (
  SELECT doc_id, t, list_filter(range(len(t)), lambda i: t[i + 1] <> ' ' AND t[i + 1] <> chr(10)) AS pos FROM d
), counted AS (
  SELECT doc_id, k, x, len(regexp_replace(x, '\\s', '', 'g')) AS n, (sum(len(regexp_replace(x, '\\s', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS upto FROM q
), located AS (
  SELECT doc_id, k, x, first, past, greatest(first - 40, 0) AS c0, substr(t, greatest(first - 40, 0) + 1, past - greatest(first - 40, 0)) AS c
  FROM (SELECT doc_id, k, x, pos[upto - n + 1] AS first, pos[upto] + 1 AS past, t FROM counted JOIN places USING (doc_id))
), drawn AS (
  SELECT doc_id, k, x, first, past FROM located WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN s IS NULL THEN x ELSE trim(substr(c, s - c0 + 1), ' ' || chr(10)) END, coalesce(s, first), past FROM (
    SELECT *, CASE WHEN back >= first THEN NULL ELSE list_filter(range(back, first + 1), lambda s: len(trim(substr(c, s - c0 + 1), ' ' || chr(10))) <= 240)[1] END AS s FROM (
      SELECT l.*, greatest(l.first - len(trim(right(o.x, 32), ' ' || chr(10))), 0) AS back FROM drawn o JOIN located l ON l.doc_id = o.doc_id AND l.k = o.k + 1
    )
  )
)"""

PAGE_BLOCKS = """b AS (
  SELECT l_orderkey AS doc_id, l_suppkey % 2 + 1 AS page_no, l_partkey * 10 + l_linenumber AS block_no, (l_partkey * 37 % 500)::DOUBLE AS x0,
         (l_suppkey * 53 % 760)::DOUBLE AS y0, (l_partkey * 37 % 500)::DOUBLE + 20 + l_quantity * 4 AS x1, (l_suppkey * 53 % 760)::DOUBLE + 8 + l_linenumber * 5 AS y1,
         CASE WHEN (l_partkey + l_linenumber) % 7 = 0 THEN '' ELSE 'part ' || l_partkey END AS text,
         CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS block_type, l_linenumber % 4 = 0 AS is_table
  FROM lineitem
)"""
OVERLAP = "EXISTS (SELECT 1 FROM b t WHERE t.is_table AND t.doc_id = b.doc_id AND t.page_no = b.page_no AND b.x0 < t.x1 AND b.x1 > t.x0 AND b.y0 < t.y1 AND b.y1 > t.y0)"
FLOWING = f"""{PAGE_BLOCKS}, g AS (
  SELECT doc_id, page_no, block_no, floor(x0 / 100) * 100.0::DOUBLE AS x0, y0, x1, y1, CASE WHEN y1 <= 800.0 * 0.12 THEN 'h' WHEN y0 >= 800.0 * (1 - 0.12) THEN 'f' ELSE 'body' END AS role,
         CASE block_no % 3 WHEN 0 THEN 'it goes on and on,' WHEN 1 THEN 'half a word of a long para-' ELSE 'this one comes to an end.' END || ' and ' || doc_id AS text FROM b
), c AS (SELECT *, list_sort(list((x0 + x1) / 2) OVER (PARTITION BY doc_id, page_no)) AS mids FROM g
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CASE WHEN (x0 + x1) / 2 <= mids[len(mids) // 2 + 1] THEN 0 ELSE 1 END, round_even(y0 / 12, 0), x0, block_no, x1, y1) - 1 AS place FROM c
), f AS (
  SELECT doc_id, page_no, place, place AS head, role, x0, y0, x1, y1, text FROM r WHERE place = 0
  UNION ALL
  SELECT doc_id, page_no, place, CASE WHEN j THEN a_head ELSE place END, CASE WHEN j THEN a_role ELSE role END, CASE WHEN j THEN least(a_x0, x0) ELSE x0 END, CASE WHEN j THEN least(a_y0, y0) ELSE y0 END,
         CASE WHEN j THEN greatest(a_x1, x1) ELSE x1 END, CASE WHEN j THEN greatest(a_y1, y1) ELSE y1 END, CASE WHEN j THEN a_text || ' ' || text ELSE text END
  FROM (SELECT b.*, a.head AS a_head, a.role AS a_role, a.x0 AS a_x0, a.y0 AS a_y0, a.x1 AS a_x1, a.y1 AS a_y1, a.text AS a_text,
               a.role = 'body' AND b.role = 'body' AND b.y0 - a.y1 >= -2 AND b.y0 - a.y1 <= greatest(18.0, least(greatest(a.y1 - a.y0, 1.0), greatest(b.y1 - b.y0, 1.0)) * 1.6)
               AND (abs(a.x0 - b.x0) <= 18 OR abs(a.x1 - b.x1) <= 48) AS j
        FROM f a JOIN r b ON b.doc_id = a.doc_id AND b.page_no = a.page_no AND b.place = a.place + 1)
)"""
SHARE = "greatest((x1 - x0) * (y1 - y0), 0.0) / 480000.0"
ROLE = "CASE WHEN y1 <= 800.0 * 0.12 THEN 'header_zone' WHEN y0 >= 800.0 * (1 - 0.12) THEN 'footer_zone' ELSE 'body' END"
DECISIONS = """pairs AS (
  SELECT b.vec_id, (a.label + b.label) % 5 > 0 AS passes, CASE WHEN b.vec_id % 17 > 0 THEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END AS score, b.vec_id % 2 = 0 AS word
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
), decided AS (
  SELECT vec_id AS right_block,
         CASE WHEN NOT passes THEN false WHEN score IS NULL THEN word WHEN score >= 0.3 THEN true WHEN score <= 0.1 THEN false ELSE word END AS merge,
         CASE WHEN NOT passes THEN 'rule_block' WHEN score IS NULL THEN 'llm_fallback' WHEN score >= 0.3 THEN 'similarity_high' WHEN score <= 0.1 THEN 'similarity_low' ELSE 'llm_gray' END AS strategy,
         CASE WHEN passes THEN round(score, 4) END AS similarity_score
  FROM pairs
)"""
#: The file types of the made-up files.
SUFFIXES = [".pdf", ".doc", ".docx", ".txt", ".md", ".xls", ".xlsx", ".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff", ".csv", ".html", ".PDF"]
FILES = f"files AS (SELECT doc_id, lower([{', '.join(repr(s) for s in SUFFIXES)}][doc_id % {len(SUFFIXES)} + 1]) AS suffix, n_chars * 1000 AS length FROM documents)"
IMAGES = "('.png', '.jpg', '.jpeg', '.webp', '.bmp', '.tif', '.tiff')"
HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
ADMISSION = f"CASE WHEN suffix IN ('.csv', '.html') THEN 'unsupported_file_type' WHEN length > 20971520 THEN 'file_too_large' END"

SQL = {
    "token_count": f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents",
    "normalize_text": f"SELECT doc_id, len({NORMAL.format('text')}) AS n_chars, md5({NORMAL.format('text')}) AS text_hash FROM documents",
    "normalize_table": f"WITH d AS (SELECT doc_id, {TABLE_NORMAL.format("replace(text, ' ', '  ')")} AS t FROM documents) SELECT doc_id, len(t) AS n_chars, md5(t) AS text_hash FROM d",
    "preview_text": f"SELECT doc_id, {PREVIEW.format('text')} AS preview FROM documents",
    "decode_utf8": "SELECT doc_id, len(text) AS n_chars, md5(text) AS text_hash FROM documents",
    "line_class": f"WITH {MARKED_LINES} SELECT doc_id, line_no, class FROM lines",
    "markdown_nodes": f"WITH {MARKED_NODES} SELECT doc_id, node_pos, node_type, level, md5(text) AS text_hash FROM nodes",
    "normalize_nodes": f"WITH {MARKED_NODES}, {NORMALISED} SELECT doc_id, node_type, count(*) AS n, sum(len(text))::BIGINT AS n_chars, sum(level)::BIGINT AS levels FROM tidy GROUP BY ALL",
    "office_nodes": f"""WITH {MARKED}, {lines('marked', OFFICE_CLASS)}, {RUNS}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS node_pos, node_type, CASE WHEN node_type = 'title' THEN 1 ELSE 0 END AS level, md5(text) AS text_hash
FROM (SELECT doc_id, run, any_value(class) AS node_type, CASE WHEN any_value(class) = 'paragraph' THEN string_agg(trim(raw), ' ' ORDER BY line_no) ELSE string_agg(trim(raw), chr(10) ORDER BY line_no) END AS text
      FROM runs WHERE class <> 'blank' GROUP BY doc_id, run)""",
    "page_node_types": f"WITH {lines('documents', PAGE_CLASS)} SELECT doc_id, line_no, class AS node_type FROM lines WHERE trim(raw) <> ''",
    "section_path": f"WITH {MARKED_NODES}, {NORMALISED}, {PATHS} SELECT doc_id, node_pos, array_to_string(path, ' > ') AS section_path FROM pathed",
    "segment_blocks": f"WITH {MARKED_FACTS} SELECT doc_id, block_id::BIGINT AS block_id, path, tokens, n_nodes, md5(text) AS text_hash FROM facts",
    "merge_short_blocks": f"WITH RECURSIVE {MARKED_FACTS}, {GROUPS} SELECT doc_id, block_id::BIGINT AS block_id, group_id FROM folded",
    "serialize_blocks": f"""WITH {MARKED_FACTS}, {SERIAL} SELECT doc_id, chunk_index, sha256(doc_id || ':' || chunk_index) AS chunk_id, chunk_type, path AS section_path,
  {PREVIEW.format('text')} AS preview_text, md5(text) AS text_hash FROM serial""",
    "separator_split": f"WITH d AS (SELECT doc_id, [{NORMAL.format('text')}] AS s FROM documents), {split_passes('d', 'p')} SELECT doc_id, len(s) AS n_spans, md5(array_to_string(s, {US})) AS spans_hash FROM p",
    "span_pack": f"WITH d AS (SELECT doc_id, [{NORMAL.format('text')}] AS s FROM documents), {split_passes('d', 'p')}, q AS (SELECT doc_id, {packed()} AS s FROM p) SELECT doc_id, len(s) AS n_spans, md5(array_to_string(s, {US})) AS spans_hash FROM q",
    "hard_split": f"""WITH RECURSIVE w AS (
  SELECT doc_id, len(text) AS rest, least(len(text), 2700) AS w, 0 AS n, NULL::BIGINT AS emitted FROM documents
  UNION ALL
  SELECT doc_id, CASE WHEN w > {4 * MAX_TOKENS} THEN rest ELSE rest - w END, CASE WHEN w > {4 * MAX_TOKENS} THEN w - ceil(w * 0.1)::BIGINT ELSE least(rest - w, 2700) END,
         CASE WHEN w > {4 * MAX_TOKENS} THEN n ELSE n + 1 END, CASE WHEN w > {4 * MAX_TOKENS} THEN NULL ELSE w END
  FROM w WHERE rest > 0
) SELECT doc_id, (n - 1)::BIGINT AS "window", emitted AS width FROM w WHERE emitted IS NOT NULL""",
    "node_pack": f"""WITH RECURSIVE l AS (
  SELECT doc_id, line_no, {TOKENS.format('raw')} AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
), p AS (
  SELECT doc_id, line_no, 0::BIGINT AS pack, n::BIGINT AS held FROM l WHERE line_no = 0
  UNION ALL
  SELECT l.doc_id, l.line_no, CASE WHEN held + n <= {MAX_TOKENS} THEN pack ELSE pack + 1 END, (CASE WHEN held + n <= {MAX_TOKENS} THEN held + n ELSE n END)::BIGINT
  FROM p JOIN l ON l.doc_id = p.doc_id AND l.line_no = p.line_no + 1
) SELECT doc_id, line_no, pack FROM p""",
    "chunk_documents": f"""WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index, sha256(doc_id || ':' || chunk_index) AS chunk_id, chunk_type, path AS section_path, tokens,
  {PREVIEW.format('text')} AS preview_text, md5(text) AS text_hash FROM chunks""",
    "document_summary": f"""WITH RECURSIVE {CHUNKS} SELECT d.doc_id, CASE WHEN n IS NULL THEN 'failed' ELSE 'completed' END AS status, coalesce(n, 0) AS total_chunks
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c USING (doc_id)""",
    "chunk_parsed_nodes": f"WITH RECURSIVE {TURNS} SELECT doc_id, count(*) AS n_chunks, sum(tokens)::BIGINT AS tokens, sum(len(trim(text, ' ' || chr(10))))::BIGINT AS n_chars FROM chunks GROUP BY doc_id",
    "overlap_chunks": f"""WITH RECURSIVE {OVERLAPPED} SELECT doc_id, k - 1 AS span, first::BIGINT AS start, past::BIGINT AS "end", md5(x) AS text_hash FROM drawn""",
    "layout_merge": f"WITH RECURSIVE {FLOWING} SELECT doc_id, page_no, head AS place, arg_max(x0, place) AS x0, arg_max(y0, place) AS y0, arg_max(x1, place) AS x1, arg_max(y1, place) AS y1, arg_max(text, place) AS text FROM f GROUP BY doc_id, page_no, head",
    "paged_chunks": f"WITH {MARKED_FACTS}, {SERIAL} SELECT doc_id::VARCHAR AS document_id, chunk_index, chunk_type, {PREVIEW.format('text')} AS preview_text FROM serial WHERE chunk_index BETWEEN 6 AND 10",
    "page_lists": "SELECT l_orderkey, coalesce(array_to_string(list_sort(list_distinct(list(l_linenumber) FILTER (WHERE l_linenumber % 3 > 0))), ','), '') AS pages FROM lineitem GROUP BY l_orderkey",
    "json_columns": f"WITH {MARKED_NODES}, {NORMALISED}, {PATHS} SELECT doc_id, node_pos, array_to_string(path, ' > ') AS section_path, CASE WHEN node_pos % 2 = 0 THEN 1 ELSE 0 END AS n_pages FROM pathed",
    "cosine_adjacent": "SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "boundary_decisions": f"WITH {DECISIONS} SELECT * FROM decided",
    "decision_counts": f"WITH {DECISIONS} SELECT strategy, CASE WHEN merge THEN 'merge' ELSE 'keep' END AS result, count(*) AS n FROM decided GROUP BY ALL",
    "boundary_gate": f"""WITH {MARKED_FACTS}, g AS (
  SELECT doc_id, block_id::BIGINT AS block_id, lag(block_id) OVER w IS NOT NULL AS second,
         n_title = 0 AND n_table = 0 AND lag(n_title) OVER w = 0 AND lag(n_table) OVER w = 0 AND lag(path) OVER w = path AND lag(tokens) OVER w + tokens <= {MAX_TOKENS} AS eligible
  FROM facts WINDOW w AS (PARTITION BY doc_id ORDER BY block_id)
) SELECT doc_id, block_id, eligible, CASE WHEN eligible THEN 'rule_keep' ELSE 'rule_block' END AS strategy FROM g WHERE second""",
    "layout_column_order": f"""WITH {PAGE_BLOCKS}, m AS (
  SELECT *, list_sort(list((x0 + x1) / 2) FILTER (WHERE text <> '') OVER (PARTITION BY doc_id, page_no)) AS c FROM b
), k AS (SELECT *, c[len(c) // 2 + 1] AS middle FROM m WHERE len(c) > 0)
SELECT doc_id, page_no, block_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CASE WHEN text = '' THEN 99 WHEN (x0 + x1) / 2 <= middle THEN 0 ELSE 1 END,
  CASE WHEN text = '' THEN 99 ELSE round_even(y0 / 12, 0) END, CASE WHEN text = '' THEN 99 ELSE x0 END, block_no) - 1 AS place FROM k""",
    "layout_role": f"WITH {PAGE_BLOCKS} SELECT doc_id, block_no, {ROLE} AS role FROM b",
    "bbox_exclusion": f"WITH {PAGE_BLOCKS} SELECT doc_id, page_no, block_no FROM b WHERE NOT is_table AND NOT {OVERLAP}",
    "image_regions": f"""WITH {PAGE_BLOCKS}, typed AS (
  SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_no) - 1 AS "order", x0, y0, x1, y1, 'pdf_image_region' AS strategy
  FROM b WHERE NOT is_table AND block_type = 1 AND {SHARE} >= 0.01 AND NOT {OVERLAP}
) SELECT * FROM typed UNION ALL
SELECT doc_id, page_no, block_no, x0, y0, x1, y1, 'pdf_image_region_heuristic' FROM b WHERE NOT is_table AND text = '' AND {SHARE} >= 0.03 AND NOT {OVERLAP}
  AND NOT EXISTS (SELECT 1 FROM typed t WHERE t.doc_id = b.doc_id AND t.page_no = b.page_no)""",
    "reading_order": f"""WITH {PAGE_BLOCKS} SELECT doc_id, page_no, block_no AS "order", row_number() OVER (PARTITION BY doc_id, page_no ORDER BY
  CASE WHEN block_no % 13 > 0 THEN y0 ELSE 1e9 END, CASE WHEN block_no % 13 > 0 THEN x0 ELSE 1e9 END, block_no, CASE WHEN is_table THEN 1 WHEN block_type = 1 THEN 2 ELSE 0 END, text) - 1 AS place FROM b""",
    "repeated_noise": rf"""WITH {lines('documents', "''")}, c AS (
  SELECT *, CASE WHEN trim(raw) <> '' AND len(trim(raw)) <= 100 THEN count(*) OVER (PARTITION BY doc_id, trim(raw)) ELSE 0 END AS n FROM lines
) SELECT doc_id, line_no, md5(raw) AS text_hash FROM c WHERE n < 2 AND NOT regexp_matches(trim(raw), '(?i)^(?:page\s*\d+|第\s*\d+\s*页|\d+\s*/\s*\d+)$')""",
    "sheet_nodes": """WITH r AS (SELECT c_nationkey, c_custkey // 1000 AS part, string_agg(c_custkey || ' | ' || trim(c_name) || ' | ' || c_nationkey || ' | ' || trim(c_mktsegment), chr(10) ORDER BY c_custkey) AS t FROM customer GROUP BY ALL)
SELECT 'nation ' || c_nationkey || ' part ' || part AS sheet_name, md5(t) AS text_hash, len(t) AS n_chars FROM r""",
    "legacy_sheet_rows": "SELECT p_partkey, floor(p_retailprice)::BIGINT || ' | ' || trim(p_name) || ' | ' || p_size AS row FROM part",
    "model_json_nodes": """SELECT item_id, 0 AS node_pos, CASE item_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'paragraph' ELSE 'list' END AS node_type,
  greatest(item_id % 4 - 1, 0) AS level, md5(trim(text, ' ' || chr(10))) AS text_hash FROM benchmark""",
    "file_admission": f"""WITH {FILES} SELECT doc_id, {ADMISSION} AS error, CASE {ADMISSION} WHEN 'unsupported_file_type' THEN 400 WHEN 'file_too_large' THEN 413 ELSE 200 END AS status,
  CASE WHEN suffix IN {IMAGES} THEN 'vision' WHEN suffix IN ('.csv', '.html') THEN 'unsupported' WHEN suffix IN ('.txt', '.md') THEN 'text' ELSE suffix[2:] END AS parser FROM files""",
    "host_allowlist": rf"SELECT page_id, {HOST} AS host, regexp_matches({HOST}, '^(.*\.)?example\.(com|net)$') AS allowed FROM pages",
    "url_errors": rf"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'scheme' WHEN NOT regexp_matches({HOST}, '^(.*\.)?example\.org$') THEN 'not_allowed' END AS error FROM pages",
    "content_type_check": f"""WITH {FILES} SELECT doc_id, CASE
  WHEN k = 5 THEN false WHEN suffix IN {IMAGES} THEN k IN (2, 3) WHEN suffix = '.txt' THEN k IN (0, 3) WHEN suffix = '.md' THEN k IN (0, 3, 4) WHEN suffix = '.pdf' THEN k IN (1, 3)
  WHEN suffix IN ('.csv', '.html') THEN true ELSE k = 3 END AS ok FROM (SELECT *, doc_id % 6 AS k FROM files)""",
    "ocr_fallback": f"WITH {lines('documents', chr(39) * 2)} SELECT doc_id, coalesce(sum(len(raw)) FILTER (WHERE len(raw) <= 60), 0)::BIGINT AS n_chars, coalesce(sum(len(raw)) FILTER (WHERE len(raw) <= 60), 0) < 40 AS needs_ocr FROM lines GROUP BY doc_id",
    "empty_documents": f"""WITH {FILES}, {lines('documents', chr(39) * 2)} SELECT doc_id, CASE WHEN suffix = '.pdf' OR suffix IN {IMAGES} THEN 'ocr_required' ELSE 'invalid_value' END AS error
FROM files WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE len(raw) <= 60)""",
    "data_urls": "SELECT item_id, 'data:text/plain;base64,' || base64(encode(text)) AS url FROM benchmark",
    "rate_limit_hits": """WITH e AS (SELECT user_id, list(epoch_us(ts) ORDER BY epoch_us(ts)) AS hits FROM events GROUP BY user_id
), f AS (
  SELECT user_id, list_reduce(list_transform(hits, lambda h: {'log': [h], 'out': [h]}), lambda a, x: {
    'log': CASE WHEN len(list_filter(a.log, lambda h: x.log[1] - h <= 86400000000)) < 2 THEN list_concat(list_filter(a.log, lambda h: x.log[1] - h <= 86400000000), x.log)
           ELSE list_filter(a.log, lambda h: x.log[1] - h <= 86400000000) END,
    'out': list_concat(a.out, [CASE WHEN len(list_filter(a.log, lambda h: x.log[1] - h <= 86400000000)) < 2 THEN x.log[1] ELSE -x.log[1] END])
  }) AS r FROM e
) SELECT user_id, abs(o) AS micros, o > 0 AS allowed FROM (SELECT user_id, unnest(r.out) AS o FROM f)""",
    "request_metrics": """SELECT 'POST' AS method, '/' || event_type AS path, CASE WHEN user_id % 9 = 0 THEN 500 ELSE 200 END AS status, count(*) AS n, sum(floor(value))::BIGINT AS seconds,
  count(*) FILTER (WHERE floor(value) <= 1) AS le_1, count(*) FILTER (WHERE floor(value) <= 10) AS le_10, count(*) FILTER (WHERE floor(value) <= 50) AS le_50 FROM events GROUP BY ALL""",
}

#: The same with each heading as a further line before its own, so that no character is lost; for the queries named _whole.
WHOLE = """marked AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE
      WHEN (i - 1) % 11 = 0 THEN repeat('#', (((i - 1) // 11) % 3 + 1)::INT) || ' ' || left(l, 24) || chr(10) || l
      WHEN (i - 1) % 5 = 0 THEN '- ' || l ELSE l END), chr(10)) AS text
  FROM documents
)"""
SQL |= {f"{name}_whole": sql.replace(MARKED, WHOLE) for name, sql in SQL.items() if MARKED in sql}
WHOLE_NODES = f"{lines('documents', MARKDOWN_CLASS)}, {RUNS}, {NODES}"
SQL |= {
    "ocr_fallback_whole": f"""WITH {WHOLE_NODES}, held AS (SELECT doc_id, sum(len(text)) AS n FROM nodes GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_chars, coalesce(n, 0) < 40 AS needs_ocr FROM documents LEFT JOIN held USING (doc_id)""",
    "empty_documents_whole": f"""WITH {FILES}, {WHOLE_NODES} SELECT doc_id, CASE WHEN suffix = '.pdf' OR suffix IN {IMAGES} THEN 'ocr_required' ELSE 'invalid_value' END AS error
FROM files WHERE doc_id NOT IN (SELECT doc_id FROM nodes)""",
}
