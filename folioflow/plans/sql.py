"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from folioflow.functions.text import TOKEN

_SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_BM25 = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents WHERE text IS NOT NULL),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY ALL),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM benchmark) GROUP BY ALL),
lex AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS lexical
  FROM q JOIN idf USING (term) JOIN tf USING (term), size GROUP BY ALL),
bm AS (SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY round(lexical, 6) DESC, doc_id) AS rank, doc_id, round(lexical, 6) AS score FROM lex) WHERE rank <= 10)
"""
_COSINE = """
sem AS (SELECT b.item_id, e.vec_id, coalesce(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])
    / nullif(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0), 0) AS s
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e)
"""
_DETAILS = """,
gold AS (SELECT item_id, count(*) AS g FROM (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) GROUP BY item_id),
hit AS (SELECT bm.item_id, rank FROM bm JOIN benchmark b USING (item_id) JOIN documents d ON d.doc_id = bm.doc_id WHERE contains(d.text, b.text)),
det AS (SELECT g.item_id, min(rank) AS first_hit, count(rank) FILTER (rank <= 1) / max(g)::DOUBLE AS r1, count(rank) FILTER (rank <= 3) / max(g)::DOUBLE AS r3,
    count(rank) FILTER (rank <= 5) / max(g)::DOUBLE AS r5, count(rank) / max(g)::DOUBLE AS r10
  FROM gold g LEFT JOIN hit h ON h.item_id = g.item_id GROUP BY g.item_id)
"""


def _hybrid(keep: str) -> str:
    return f"""{_BM25}, {_COSINE},
cand AS (SELECT s.item_id, s.vec_id AS doc_id, round(s.s, 6) AS semantic, round(coalesce(l.lexical, 0), 6) AS lexical
  FROM sem s JOIN documents d ON d.doc_id = s.vec_id AND d.text IS NOT NULL AND {keep} LEFT JOIN lex l ON l.item_id = s.item_id AND l.doc_id = s.vec_id),
w AS (SELECT *, min(lexical) OVER p AS l0, max(lexical) OVER p AS l1, min(semantic) OVER p AS s0, max(semantic) OVER p AS s1 FROM cand WINDOW p AS (PARTITION BY item_id)),
f AS (SELECT item_id, doc_id, lexical, semantic, round(0.4::DOUBLE * CASE WHEN l1 = l0 THEN 1 ELSE (lexical - l0) / (l1 - l0) END + 0.6::DOUBLE * CASE WHEN s1 = s0 THEN 1 ELSE (semantic - s0) / (s1 - s0) END, 6) AS score FROM w)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, semantic DESC, doc_id) AS rank, doc_id, score, lexical, semantic FROM f) WHERE rank <= 10"""


def _values(rows: tuple[tuple, ...]) -> str:
    literal = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({i}, {', '.join(map(literal, r))})" for i, r in enumerate(rows))


def _packed(items: str, joint: str, cut: str, room: int) -> str:
    """Greedy packing of (doc_id, i, x) by recursion; ``cut`` may forbid a cut between two items."""
    return f"""WITH RECURSIVE items AS ({items}),
s AS (SELECT doc_id, i, 0 AS seq, x AS held, x AS last FROM items WHERE i = 1
  UNION ALL
  SELECT s.doc_id, n.i, CASE WHEN {cut} THEN s.seq + 1 ELSE s.seq END, CASE WHEN {cut} THEN n.x ELSE s.held || {joint} || n.x END, n.x
  FROM s JOIN items n ON n.doc_id = s.doc_id AND n.i = s.i + 1)
SELECT doc_id, seq::BIGINT AS seq, length(held)::BIGINT AS n, md5(held) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY i DESC) AS k FROM s) WHERE k = 1""".replace("{room}", str(room))


def _header_flatten(header: tuple) -> str:
    """Cells placed one after another by recursion; each takes the first column that no cell above or before covers."""
    cells = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in header)
    return f"""WITH RECURSIVE v(table_id, r, cell_seq, rowspan, colspan, t) AS (VALUES {cells}),
o AS (SELECT table_id, r, greatest(coalesce(try_cast(rowspan AS INT), 1), 1) AS h, greatest(coalesce(try_cast(colspan AS INT), 1), 1) AS w, trim(t) AS t, row_number() OVER (PARTITION BY table_id ORDER BY r, cell_seq) AS k FROM v),
s AS (SELECT table_id, 0::BIGINT AS k, []::STRUCT(r INT, c INT, k BIGINT, t VARCHAR)[] AS grid, -1 AS row, 0 AS nxt FROM (SELECT DISTINCT table_id FROM o)
  UNION ALL
  SELECT table_id, k, list_concat(grid, list_transform(range(0, h * w), lambda i: {{'r': (r + i // w)::INT, 'c': (col + i % w)::INT, 'k': k, 't': t}})), r, col + w
  FROM (SELECT s.table_id, o.k, s.grid, o.r, o.h, o.w, o.t, (list_filter(range(CASE WHEN s.row = o.r THEN s.nxt ELSE 0 END, 200), lambda q: len(list_filter(s.grid, lambda g: g.r = o.r AND g.c = q)) = 0))[1]::INT AS col
    FROM s JOIN o ON o.table_id = s.table_id AND o.k = s.k + 1)),
g AS (SELECT table_id, unnest(grid) AS x FROM s JOIN (SELECT table_id AS tid, max(k) AS m FROM o GROUP BY table_id) ON tid = table_id AND m = s.k),
top AS (SELECT table_id, x.r AS r, x.c AS c, arg_max(x.t, x.k) AS t FROM g GROUP BY ALL),
d AS (SELECT *, lag(t) OVER (PARTITION BY table_id, c ORDER BY r) AS above FROM top WHERE t <> '')
SELECT p.table_id, p.c, coalesce(string_agg(d.t, ' - ' ORDER BY d.r) FILTER (d.above IS NULL OR d.above <> d.t), '') AS name FROM (SELECT DISTINCT table_id, c FROM top) p LEFT JOIN d USING (table_id, c) GROUP BY p.table_id, p.c"""


def statements(abbreviations: tuple, glossary: tuple, header: tuple, room: int) -> dict[str, str]:
    """Name to SQL."""
    lines = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, x FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) y WHERE x <> ''"
    lines = lines.replace("unnest(l) AS x", "regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS x")
    at_end = "(regexp_matches(s.last, '[.:;!?]$') OR regexp_matches(n.x, '^(?:[-*•]|\\d+\\.)'))"
    marked = lambda mark: f"regexp_replace(text, '(^|\\n)([A-M])', '\\1{mark}\\2', 'g')"
    numbered = lambda text, keep="text IS NOT NULL": f"SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split({text}, chr(10)) AS l FROM documents WHERE {keep})"
    folded = "text"
    order = sorted(range(len(abbreviations)), key=lambda i: (-len(abbreviations[i][0]), i))
    for i in order:
        term, definition = abbreviations[i]
        folded = f"regexp_replace({folded}, '(^|[^\\p{{L}}\\p{{N}}_(])({term})($|[^\\p{{L}}\\p{{N}}_){_SPACE}]|[{_SPACE}]+[^{_SPACE}(]|[{_SPACE}]+$)', '\\1\\2 ({definition})\\3')"
    pairs = _values(glossary)
    toc = """WITH base AS (SELECT source, lang, ascii(lang) * 256 + ascii(substr(lang, 2, 1)) AS o, doc_id AS start FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
r AS (SELECT *, lead(start) OVER (PARTITION BY source, o ORDER BY start) AS nx, row_number() OVER (PARTITION BY source, o ORDER BY start) - 1 AS section_ord FROM base),
c AS (SELECT source, o, lead(min(start)) OVER (PARTITION BY source ORDER BY o) AS nc FROM base GROUP BY source, o),
ranges AS (SELECT source, o, lang AS chapter, section_ord, 's' || start AS section, start, greatest(start, coalesce(nx - 1, nc - 1, 2000)) AS "end" FROM r JOIN c USING (source, o))"""
    return {
        "tokenize_stats": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS t FROM documents)",
        "bm25_topk": f"{_BM25} SELECT item_id, rank, doc_id, score FROM bm",
        "cosine_topk": f"WITH {_COSINE} SELECT item_id, rank, vec_id, score FROM (SELECT item_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, vec_id) AS rank FROM sem) WHERE rank <= 10",
        "minmax_scores": "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (p - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS p, min(l_extendedprice) OVER w AS lo, max(l_extendedprice) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))",
        "hybrid_topk": _hybrid("true"),
        "hybrid_filtered_topk": _hybrid("d.lang = 'en'"),
        "eval_details": f"{_BM25}{_DETAILS} SELECT item_id, first_hit, round(r1, 4) AS recall_1, round(r3, 4) AS recall_3, round(r5, 4) AS recall_5, round(r10, 4) AS recall_10 FROM det",
        "recall_at_k": f"{_BM25}{_DETAILS} SELECT count(*) AS n_questions, round(avg(r1), 4) AS recall_1, round(avg(r3), 4) AS recall_3, round(avg(r5), 4) AS recall_5, round(avg(r10), 4) AS recall_10 FROM det",
        "sentence_line_split": _packed(lines, "chr(10)", f"(length(s.held) + 1 + length(n.x) > {room} AND {at_end})", room),
        # A paragraph over the room is packed alone; as it has one line, it is a segment of its own.
        "paragraph_pack": _packed(lines, "chr(10) || chr(10)", f"(length(s.held) + 2 + length(n.x) > {room} OR length(n.x) > {room} OR length(s.held) > {room})", room),
        "heading_blocks": f"""WITH l AS ({numbered(marked('### '))}),
h AS (SELECT *, sum(CASE WHEN regexp_matches(x, '^###\\s+.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l),
g AS (SELECT doc_id, b, coalesce(regexp_replace(max(CASE WHEN regexp_matches(x, '^###\\s+.') THEN regexp_extract(x, '^###\\s+(.+)$', 1) END), '^\\s+|\\s+$', '', 'g'), '') AS heading,
  regexp_replace(coalesce(string_agg(CASE WHEN regexp_matches(x, '^###\\s+.') THEN NULL ELSE x END, chr(10) ORDER BY i), ''), '^\\s+|\\s+$', '', 'g') AS body FROM h GROUP BY doc_id, b),
k AS (SELECT *, max(b) OVER (PARTITION BY doc_id) AS m FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS block, heading, md5(body) AS digest FROM k WHERE b > 0 OR body <> '' OR m = 0""",
        "heading_carry": f"""WITH p AS (SELECT source, doc_id, lang, CASE WHEN starts_with(text, 'T') THEN text ELSE {marked('### ')} END AS c FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
h AS (SELECT *, list_extract(regexp_extract_all(c, '(?m)^###\\s+(.+)$', 1), -1) AS own0, NOT regexp_matches(c, '^\\s*###') AS cont, coalesce(nullif(lang, ''), nullif(source, ''), 'Tài liệu') AS seed FROM p),
w AS (SELECT *, nullif(regexp_replace(regexp_replace(list_extract(string_split(own0, ' > '), -1), '\\s*\\(Tiếp tục\\)\\s*$', ''), '^\\s+|\\s+$', '', 'g'), '') AS own, CASE WHEN cont THEN seed END AS given FROM h),
v AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER o, first_value(given IGNORE NULLS) OVER o, seed) AS inh FROM w WINDOW o AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, doc_id, CASE WHEN cont THEN inh END AS inherited, md5(CASE WHEN cont THEN '### ' || inh || ' (Tiếp tục)' || chr(10) || chr(10) || c ELSE c END) AS digest FROM v""",
        "layout_h3": f"""WITH p AS (SELECT conv_id, turn, role, {marked('### ')} AS c FROM conversations),
n AS (SELECT *, CASE WHEN nullif(role, '') <> last_value(nullif(role, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS j FROM p),
r AS (SELECT *, sum(j) OVER (PARTITION BY conv_id ORDER BY turn) AS run, nullif(regexp_replace(list_extract(list_filter(list_transform(string_split(c, chr(10)), lambda x: regexp_extract(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^###\\s+([^#\\s].*)$', 1)), lambda x: x <> ''), -1), '^\\*\\*|\\*\\*$|^\\s+|\\s+$', '', 'g'), '') AS own FROM n)
SELECT conv_id, turn, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id, run ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_h3 FROM r""",
        "toc_ranges": f'{toc} SELECT source, chapter, section_ord, section, start, "end" FROM ranges',
        "toc_lookup": f"""{toc}, m AS (SELECT d.doc_id, r.section, r.chapter, row_number() OVER (PARTITION BY d.doc_id ORDER BY r.o, r.section_ord) AS k FROM documents d JOIN ranges r ON r.source = d.source AND d.doc_id - 3 BETWEEN r.start AND r."end")
SELECT d.doc_id AS page_id, coalesce(m.section, 'Nội dung') AS toc_section, coalesce(m.chapter, 'Nội dung') AS toc_chapter FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id AND m.k = 1""",
        "spread_mapping": """SELECT conv_id + 2 AS pdf_page, part::BIGINT AS part, CASE part WHEN 0 THEN (2 * conv_id) || ',' || (2 * conv_id + 1) WHEN 1 THEN (2 * conv_id)::VARCHAR ELSE (2 * conv_id + 1)::VARCHAR END AS logical_page, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS digest
FROM (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS part, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations) WHERE t <> '' GROUP BY conv_id, part""",
        "heading_sanitize": f"""WITH l AS ({numbered("regexp_replace(" + marked('# ') + ", '(^|\\n)(T)', '\\1```' || chr(10) || '\\2', 'g')")}),
f AS (SELECT *, sum(CASE WHEN regexp_matches(x, '^\\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l)
SELECT doc_id, md5(string_agg(CASE WHEN n % 2 = 1 OR regexp_matches(x, '^\\s*```') THEN x ELSE regexp_replace(x, '^#{{1,2}}\\s+(.+)$', '### \\1') END, chr(10) ORDER BY i)) AS digest FROM f GROUP BY doc_id""",
        "abbrev_expand": f"SELECT doc_id, md5({folded}) AS digest FROM documents WHERE text IS NOT NULL",
        "abbrev_dictionary": f"""WITH v(seq, t, d) AS (VALUES {pairs}),
p AS (SELECT seq, trim(t) AS t, trim(d) AS d FROM v WHERE t <> 'Thuật ngữ' AND d <> 'Định nghĩa' AND trim(t) <> ''),
x AS (SELECT seq, CASE WHEN regexp_matches(t, '^(.*?)\\s*\\(([^)]+)\\)$') THEN trim(regexp_extract(t, '^(.*?)\\s*\\(([^)]+)\\)$', 2)) ELSE t END AS term, CASE WHEN regexp_matches(t, '^(.*?)\\s*\\(([^)]+)\\)$') THEN trim(regexp_extract(t, '^(.*?)\\s*\\(([^)]+)\\)$', 1)) ELSE d END AS def, regexp_matches(t, '^(.*?)\\s*\\(([^)]+)\\)$') AS inv FROM p)
SELECT min(seq)::BIGINT AS ord, term, arg_max(def, seq) AS definition FROM x WHERE inv OR def <> '' GROUP BY term""",
        "containment_match": """WITH p AS (SELECT item_id, len(t) AS n, unnest(t) AS k FROM (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_.,]+'), lambda x: length(x) >= 2)) AS t FROM benchmark)),
w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_.,]+'), lambda x: length(x) >= 2)) AS k FROM documents),
s AS (SELECT item_id, doc_id, count(*) / max(n)::DOUBLE AS o FROM p JOIN w USING (k) GROUP BY ALL)
SELECT item_id, doc_id, round(o, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o DESC, doc_id) AS r FROM s) WHERE r = 1 AND o >= 0.6""",
        "adjacency_groups": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events), j AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 3600000000 THEN 1 ELSE 0 END AS g FROM e),
r AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM j)
SELECT user_id, run::BIGINT AS run, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM r GROUP BY user_id, run""",
        "rect_intersection": """SELECT a.l_orderkey, count(*) AS n_pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
AND a.l_linenumber * 10.0::DOUBLE < b.l_linenumber * 10.0::DOUBLE + b.l_quantity AND b.l_linenumber * 10.0::DOUBLE < a.l_linenumber * 10.0::DOUBLE + a.l_quantity
AND a.l_discount * 100 < b.l_discount * 100 + 2 AND b.l_discount * 100 < a.l_discount * 100 + 2 GROUP BY a.l_orderkey""",
        "header_flatten": _header_flatten(header),
        "contextual_text": "SELECT doc_id, md5('Chương: ' || coalesce(source, '') || ' | Mục: ' || coalesce(lang, '') || ' | Tiêu đề: ' || chr(10) || chr(10) || coalesce(text, '')) AS digest FROM documents",
        "context_format": """SELECT conv_id, md5(chr(10) || chr(10) || repeat('=', 50) || chr(10) || chr(10) || string_agg('[Trang ' || conv_id || ', ' || turn || ' | Chương: ' || role || ' | Tiêu đề: h]' || chr(10) || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) || repeat('-', 40) || chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || repeat('=', 50) || chr(10) || chr(10)) AS digest FROM conversations GROUP BY conv_id""",
        "history_window": """SELECT conv_id, turn, md5(coalesce(array_to_string(list_transform(list_filter(range(1, 5), lambda k: l[5 - k] IS NOT NULL), lambda k: l[5 - k]), chr(10)), '')) AS digest FROM (
SELECT conv_id, turn, [lag(s, 1) OVER w, lag(s, 2) OVER w, lag(s, 3) OVER w, lag(s, 4) OVER w] AS l FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Người dùng' ELSE 'Trợ lý' END || ': ' || coalesce(text, '') AS s FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
        "checkpoint_prefix": "WITH j AS (SELECT doc_id, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id), s AS (SELECT min(doc_id) AS stop FROM j WHERE embedding IS NULL) SELECT doc_id FROM j, s WHERE stop IS NULL OR doc_id < stop",
        "markdown_change_flags": """SELECT doc_id, k = 1 OR a AS new_chapter, k = 1 OR a OR b AS new_section FROM (SELECT doc_id, row_number() OVER w AS k, lang IS DISTINCT FROM lag(lang) OVER w AS a, substr(text, 1, 1) IS DISTINCT FROM lag(substr(text, 1, 1)) OVER w AS b FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))""",
        "json_tolerant_parse": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
        "incremental_index": "SELECT doc_id, md5(text) AS digest FROM documents",
        "html_heading_text": "SELECT page_id, length(h)::BIGINT AS n, md5(h) AS digest FROM (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h FROM pages)",
    }
