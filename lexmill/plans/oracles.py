"""DuckDB twins of the queries, written for that dialect by hand."""

from __future__ import annotations

from lexmill.plans.fixture import BLOCKS_SQL, CHUNKS_SQL, DOCUMENTS_SQL, JOINED_SQL


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _clean(c: str) -> str:
    invisible = " || ".join(f"chr({n})" for n in (0x200B, 0x200C, 0x200D, 0xAD, 0xA0, 0xFEFF, 0x200F, 0x200E))
    c = f"translate({c}, {invisible}, '')"
    for _ in range(2):  # neighbouring single line ends share a character
        c = rf"regexp_replace({c}, '([^\n])\n([^\n])', '\1 \2', 'g')"
    c = f"regexp_replace({c}, ' +', ' ', 'g')"
    return _strip(f"replace(replace({c}, '•', chr(10)), ';', '.')")


CLEANED = BLOCKS_SQL + f", cleaned AS (SELECT doc_id, block_idx, page, y0, y1, height, {_clean('text')} AS text FROM blocks)"
_LEVELS = {1: r"^(part|chapter)\s+[ivx\d]+\b", 2: r"^sub-?chapter\s+[\d.]+\b", 3: r"^section\s+\d+\b", 6: r"^sub-?section\s+[\d.]+\b"}
HEADS = BLOCKS_SQL + ", heads AS (SELECT *, CASE {} END AS lv, CASE {} END AS hd FROM blocks)".format(
    " ".join(f"WHEN regexp_matches(text, '{p}', 'i') THEN {n}" for n, p in _LEVELS.items()), " ".join(f"WHEN regexp_matches(text, '{p}', 'i') THEN regexp_extract(text, '{p}', 0, 'i')" for p in _LEVELS.values())
)
_AT = ", ".join(f"coalesce(max(CASE WHEN lv = {n} THEN block_idx END) OVER w, -1) AS at{n}, last_value(CASE WHEN lv = {n} THEN hd END IGNORE NULLS) OVER w AS last{n}" for n in _LEVELS)
_KEPT = []
for _n in _LEVELS:
    _lower = [f"at{k}" for k in _LEVELS if k < _n] or ["-1"]
    _KEPT.append(f"CASE WHEN at{_n} > greatest({', '.join(_lower)}) THEN last{_n} END")
CARRIED = HEADS + f""", reached AS (
  SELECT *, {_AT} FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), carried AS (SELECT doc_id, block_idx, page, y0, y1, height, text, list_filter([{', '.join(_KEPT)}], lambda h: h IS NOT NULL) AS hs FROM reached)"""
_ENTRY = r"^((?:part|chapter|section|sub-chapter)\s+[ivxlcdm\d.]+)\.?\s*(.*?)\s*[.\-_\s]{3,}\s*(\d+)\s*$"
TOC = f""", begun AS (SELECT doc_id, min(block_idx) AS b FROM blocks WHERE contains(lower(text), 'table of contents') GROUP BY doc_id),
toc AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1)::INT AS toc_idx, regexp_extract(t, '{_ENTRY}', 3, 'is')::INT AS page,
    CASE WHEN h LIKE 'Part%' THEN 1 WHEN h LIKE 'Chapter%' THEN 2 WHEN h LIKE 'Sub-chapter%' THEN 3 WHEN h LIKE 'Section%' THEN 4 ELSE 1 END AS level, h AS header,
    regexp_extract(t, '{_ENTRY}', 2, 'is') AS title
  FROM (SELECT doc_id, block_idx, t, {_strip(f"regexp_extract(t, '{_ENTRY}', 1, 'is')")} AS h
        FROM (SELECT blocks.doc_id, block_idx, {_strip('text')} AS t FROM blocks JOIN begun ON blocks.doc_id = begun.doc_id AND block_idx > b WHERE NOT contains(lower(text), 'table of contents'))
        WHERE regexp_matches(t, '{_ENTRY}', 'is'))
), titles AS (SELECT doc_id, lower(trim(rtrim(trim(header), '.'))) AS k, arg_min(title, toc_idx) AS title FROM toc GROUP BY doc_id, k)"""
ENRICHED = CARRIED + TOC + """, named AS (
  SELECT c.doc_id, c.block_idx, string_agg(coalesce(h || ': ' || title, h), ', ' ORDER BY n) AS e
  FROM (SELECT doc_id, block_idx, unnest(hs) AS h, unnest(range(len(hs))) AS n FROM carried) c
  LEFT JOIN titles t ON t.doc_id = c.doc_id AND t.k = lower(trim(rtrim(trim(h), '.'))) GROUP BY c.doc_id, c.block_idx
), enriched AS (SELECT c.*, array_to_string(hs, ', ') AS headers, coalesce(e, '') AS enriched_headers FROM carried c LEFT JOIN named n ON n.doc_id = c.doc_id AND n.block_idx = c.block_idx)"""
_KEEP = "NOT (y0 < 0.05 * height OR (y1 > 0.95 * height AND y1 - y0 < 0.1 * height)) AND length(text) >= 5"


def _merged(source: str, columns: str) -> str:
    firsts = "".join(f", arg_min({c}, block_idx) AS {c}" for c in columns.split())
    return f""", islands AS (
  SELECT *, sum(CASE WHEN prev LIKE '%:' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING) AS grp
  FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY block_idx) AS prev FROM {source})
), merged AS (SELECT doc_id, min(block_idx) AS block_idx, string_agg(text, chr(10) ORDER BY block_idx) AS text{firsts} FROM islands GROUP BY doc_id, grp)"""


PROCESSED = ENRICHED + f", kept AS (SELECT * FROM (SELECT * REPLACE ({_clean('text')} AS text) FROM enriched) WHERE {_KEEP})" + _merged("kept", "page headers enriched_headers")


def _slides(source: str, columns: str, least: int, most: int, step: int) -> str:
    return f""", fit AS (SELECT * FROM (SELECT *, {_strip('text')} AS body FROM {source}) WHERE length(body) >= {least} AND body <> ''),
windows AS (
  SELECT {columns}, unnest(list_filter(list_transform(range(1 + ceil((length(body) - {most}) / {step})::INT), lambda k: {_strip(f'substr(body, k * {step} + 1, {most})')}), lambda c: c <> '')) AS text,
    unnest(range(len(list_filter(list_transform(range(1 + ceil((length(body) - {most}) / {step})::INT), lambda k: {_strip(f'substr(body, k * {step} + 1, {most})')}), lambda c: c <> ''))))::INT AS chunk_id
  FROM fit WHERE length(body) > {most}
), slides AS (SELECT {columns}, text, chunk_id FROM windows UNION ALL SELECT {columns}, text, -1 FROM fit WHERE length(body) <= {most})"""


def _pairs(source: str, flag: str) -> str:
    """Roles of rows in greedy pairs: 1 left, 2 right."""
    return f""", flagged AS (SELECT *, {flag} AS flag, row_number() OVER w AS n FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)),
lefts AS (SELECT *, flag AND (n - max(CASE WHEN NOT flag THEN n ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS l FROM flagged),
roles AS (SELECT *, CASE WHEN l THEN 1 WHEN lag(l, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY block_idx) THEN 2 ELSE 0 END AS role FROM lefts)"""


_LIST = r"^\s*((\d+|[a-zA-Z])[.)]|[•\-●‣▪▫⁃])\s+"
_WORDS = "'appendix','bibliography','caution','chapter','conclusion','definition','example','figure','important','note','reference','reminder','section','summary','table','tip','warning'"
_HEADY = r"^\d+\.?\s+[A-Z]|^[A-Z][A-Z\s]+$|^[A-Z][a-z]+(\s+[A-Z][a-z]+)*$"


def _keyword(c: str) -> str:
    return rf"regexp_extract(lower({_strip(c)}), '^\S+') IN ({_WORDS})"


def _heady(c: str) -> str:
    return f"regexp_matches({_strip(c)}, '{_HEADY}')"


_A, _B = _strip("text"), _strip("next_text")
_CONTINUES = rf"""coalesce({_A} <> '' AND {_B} <> '' AND page + 1 = next_page AND right({_A}, 1) NOT IN ('.', '!', '?', ':', ';')
  AND NOT regexp_matches({_B}, '{_LIST}') AND NOT {_keyword('next_text')} AND NOT {_heady('next_text')}
  AND ({_A} LIKE '%-' OR regexp_matches({_B}, '^\p{{Ll}}') OR (right({_A}, 1) NOT IN (',', ';', ':', '—', '–') AND NOT regexp_matches({_B}, '^\p{{Lu}}'))), FALSE)"""

_REFERENCES = [r"article\s+\d+(?:\([^)]+\))?(?:\s+of\s+[^.]+)?", r"section\s+\d+(?:\.\d+)*", r"sub-section\s+\d+(?:\.\d+)*", r"cssf\s+regulation\s+\d+-\d+", r"delegated\s+regulation\s+\([^)]+\)\s+\d+/\d+", r"circular\s+cssf\s+\d+/\d+", r"point\s+\d+", r"\d{4}\s+law"]


def _references(c: str) -> str:
    return "list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all({c}, '{p}', 0, 'i')" for p in _REFERENCES) + "])))"


_CITED = [r"\b\d+\s+U\.S\.C\.\s+§\s+\d+", r"\b\d+\s+CFR\s+\d+\.\d+", r"Section\s+\d+(?:\.\d+)*", r"Article\s+\d+", r"Regulation\s+\d+"]


def _citations(c: str) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all({c}, '{p}')" for p in _CITED) + "])"


def _kind(c: str) -> str:
    tests = (("means:|defined as:|shall mean", "definition"), ("shall|must|required to|obligated to", "requirement"), ("penalty|fine|sanction|violation|non-compliance", "penalty"), ("procedure|process|steps|methodology", "procedure"))
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN '{k}'" for p, k in tests) + " ELSE 'general' END"


_MARKERS = (("article", r"article\s+\d+"), ("section", r"section\s+\d+(?:\.\d+)*"), ("subsection", r"subsection\s+[a-z]+"), ("paragraph", r"paragraph\s+\d+"), ("clause", r"clause\s+\d+"), ("definition", r"definition\s+\d+|means:|defined as:|shall mean"), ("requirement", "shall|must|required to|obligated to"), ("penalty", "penalty|fine|sanction|violation|non-compliance"), ("procedure", "procedure|process|steps|methodology"))
_MARK_KIND = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}', 'i') THEN {i}" for i, (_, p) in enumerate(_MARKERS, 1)) + " ELSE 0 END"
_MARK_TEXT = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}', 'i') THEN regexp_extract(x, '{p}', 0, 'i')" for _, p in _MARKERS) + " ELSE '' END"

_HEADING = r"^(?:Part\s+\w+|Chapter\s+\d+|Sub-chapter\s+\d+\.\d+|Section\s+\d+\.\d+\.\d+).*?$"
_TERMS = r"""terms AS (
  SELECT *, regexp_extract_all(query, '\b\d+\b') AS numbers, regexp_extract_all(lower(query), '\b(?:article|section|sub-section|point|paragraph)\s+\d+\b') AS refs,
    list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: length(w) > 3 AND w NOT IN ('with', 'this', 'that')) AS words FROM queries
)"""
HITS = CHUNKS_SQL + f""", {_TERMS}, scored AS (
  SELECT query_id, query, id, content, headers, page, round(list_cosine_similarity(embedding, q_embedding)
    + 0.1 * len(list_filter(list_concat(numbers, words), lambda t: contains(lower(content), t)))
    + 0.5 * len(list_filter(numbers, lambda t: contains(lower(content), t))) + 0.7 * len(list_filter(refs, lambda t: contains(lower(content), t))), 6) AS score
  FROM chunks CROSS JOIN terms WHERE embedding IS NOT NULL AND q_embedding IS NOT NULL
), hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 5)"""
CONTEXT = HITS + """, firsts AS (SELECT query_id, headers, min(rank) AS rank FROM hits WHERE headers <> '' GROUP BY query_id, headers),
more AS (
  SELECT f.query_id, f.rank, arg_min(c.content, c.id) AS content FROM firsts f JOIN chunks c ON c.headers = f.headers
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = f.query_id AND h.content = c.content) GROUP BY f.query_id, f.rank
), contexts AS (
  SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank, part) AS context
  FROM (SELECT query_id, rank, 0 AS part, content FROM hits UNION ALL SELECT query_id, rank, 1, content FROM more) GROUP BY query_id
)"""


def _preview(c: str) -> str:
    return f"CASE WHEN length({c}) > 200 THEN substr({c}, 1, 200) || '...' ELSE {c} END"


_WORDLIST = r"list_filter(regexp_split_to_array(lower({}), '[^\pL\pN\pM_]+'), lambda w: w <> '')"
BM25 = CHUNKS_SQL + f""", worded AS (SELECT id, {_WORDLIST.format('content')} AS w FROM chunks), asked AS (
  SELECT DISTINCT query_id, unnest({_WORDLIST.format('query')}) AS word FROM queries
), sizes AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM worded),
tf AS (SELECT id, n, word, count(*) AS tf FROM (SELECT id, len(w) AS n, unnest(w) AS word FROM worded) WHERE word IN (SELECT word FROM asked) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
bm AS (
  SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean))), 6) AS score
  FROM tf JOIN df USING (word) JOIN asked USING (word) CROSS JOIN sizes GROUP BY query_id, id
)"""
NEAR = CHUNKS_SQL + ", near AS (SELECT query_id, id, round(list_cosine_similarity(embedding, q_embedding), 6) AS score FROM chunks CROSS JOIN queries WHERE embedding IS NOT NULL AND q_embedding IS NOT NULL)"


def _packed(pieces: str, sep: str, size: int, most: int) -> str:
    return f"""list_reduce(list_transform({pieces}, lambda p: {{'out': []::VARCHAR[], 'cur': p}}),
      lambda a, x: CASE WHEN length(a.cur) + {size} + length(x.cur) > {most} THEN {{'out': list_append(a.out, a.cur), 'cur': x.cur}} ELSE {{'out': a.out, 'cur': a.cur || {sep} || x.cur}} END)"""


_SENTENCES = r"string_split(regexp_replace(text, '([.!?])[\s\x{00A0}]+', '\1' || chr(1), 'g'), chr(1))"
PACKED = JOINED_SQL + f""", source AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS text FROM joined),
tiers AS (
  SELECT doc_id, text, {_packed("string_split(text, chr(10) || chr(10))", "chr(10) || chr(10)", 2, 2000)} AS p,
    CASE WHEN len({_SENTENCES}) > 1 THEN {_packed(_SENTENCES, "' '", 1, 2000)} END AS s,
    {_packed(r"list_filter(regexp_split_to_array(text, '[\s\x{00A0}]+'), lambda w: w <> '')", "' '", 1, 2000)} AS w
  FROM source WHERE length(text) > 2000
), chosen AS (
  SELECT doc_id, CASE WHEN contains(text, chr(10) || chr(10)) AND len(list_filter(list_append(p.out, p.cur), lambda c: length(c) > 2000)) = 0 THEN list_append(p.out, p.cur)
    WHEN s IS NOT NULL AND len(list_filter(list_append(s.out, s.cur), lambda c: length(c) > 2000)) = 0 THEN list_append(s.out, s.cur) ELSE list_append(w.out, w.cur) END AS c FROM tiers
)"""

_BREAKS = (r"\n\n+", r"\n\d+\.\s+", r"\n[•\-*]\s+", r"\n[A-Z][a-z]+:")
BREAKS = JOINED_SQL + """, parts AS (SELECT doc_id, CASE {} WHEN regexp_matches(text, '\\n\\([a-z]\\)') THEN string_split(regexp_replace(text, '\\n(\\([a-z]\\))', chr(1) || '\\1', 'g'), chr(1)) END AS p FROM joined),
folded AS (
  SELECT doc_id, list_reduce(list_prepend({{'out': []::VARCHAR[], 'cur': ''}}, list_transform(p, lambda x: {{'out': []::VARCHAR[], 'cur': x}})),
    lambda a, x: CASE WHEN length(a.cur) + length(x.cur) <= 1000 THEN {{'out': a.out, 'cur': a.cur || x.cur || chr(10) || chr(10)}}
      WHEN {} <> '' THEN {{'out': list_append(a.out, {}), 'cur': x.cur || chr(10) || chr(10)}} ELSE {{'out': a.out, 'cur': x.cur || chr(10) || chr(10)}} END) AS f
  FROM parts WHERE p IS NOT NULL
), sections AS (SELECT doc_id, CASE WHEN {} <> '' THEN list_append(f.out, {}) ELSE f.out END AS c FROM folded)""".format(
    " ".join(f"WHEN regexp_matches(text, '{p}') THEN regexp_split_to_array(text, '{p}')" for p in _BREAKS), _strip("a.cur"), _strip("a.cur"), _strip("f.cur"), _strip("f.cur")
)

_STATE = "{{'out': {out}, 'cur': {cur}, 'start': {start}, 'path': {path}, 'i': 0::BIGINT, 'kind': 0, 'mark': ''}}"
_PUT = "CASE WHEN {body} <> '' THEN list_append(a.out, {{'content': {body}, 'start': a.start, 'stop': {stop}, 'path': a.path}}) ELSE a.out END"
_EMPTY = "[]::STRUCT(content VARCHAR, start BIGINT, stop BIGINT, path VARCHAR[])[]"
_GROWN = "a.cur || x.cur || chr(10)"
SEGMENTS = JOINED_SQL + f""", lined AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: {{'out': {_EMPTY}, 'cur': x, 'start': 0::BIGINT, 'path': []::VARCHAR[], 'i': (i - 1)::BIGINT, 'kind': {_MARK_KIND}, 'mark': {_MARK_TEXT}}}) AS ls FROM joined
), folded AS (
  SELECT doc_id, len(ls) AS n, list_reduce(list_prepend({_STATE.format(out=_EMPTY, cur="''", start="0::BIGINT", path="[]::VARCHAR[]")}, ls), lambda a, x:
    CASE WHEN x.kind > 0 THEN {_STATE.format(out=_PUT.format(body=_strip('a.cur'), stop='x.i'), cur="x.cur || chr(10)", start="x.i", path="CASE WHEN x.kind <= 5 THEN list_append(a.path[1:x.kind - 1], x.mark) ELSE a.path END")}
      WHEN length({_GROWN}) > 2000 THEN {_STATE.format(out=_PUT.format(body=_strip(_GROWN), stop='x.i'), cur="''", start="x.i + 1", path="a.path")}
      ELSE {_STATE.format(out="a.out", cur=_GROWN, start="a.start", path="a.path")} END) AS a
  FROM lined
), segments AS (SELECT doc_id, {_PUT.format(body=_strip('a.cur'), stop='n')} AS s FROM folded)"""

SMALL = BLOCKS_SQL + f""", small AS (
  SELECT doc_id, block_idx, 'chunk_' || block_idx || '_' || (block_idx + 1) AS chunk_id, text AS content, {_citations('text')} AS cited, block_idx + 1 AS end_position, embedding::DOUBLE[] AS embedding
  FROM blocks JOIN embeddings ON vec_id = (doc_id + block_idx // 3) % 500
), led AS (
  SELECT *, lead(content) OVER w AS nc, lead(chunk_id) OVER w AS ni, lead(cited) OVER w AS nt, lead(end_position) OVER w AS ne, lead(embedding) OVER w AS nv
  FROM small WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)
)""" + _pairs("led", "coalesce(length(content) < 200 AND list_cosine_similarity(embedding, nv) > 0.7, FALSE)")

_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda x: (length(lower(s.content)) - length(replace(lower(s.content), x, '')))::DOUBLE)"
HYBRID = SEGMENTS + f""", rows AS (SELECT doc_id, unnest(range(len(s)))::INT AS block_idx, unnest(s) AS s FROM segments), seg AS (
  SELECT doc_id, block_idx, s.content AS content, s.start AS start_position, s.stop AS end_position, 'chunk_' || s.start || '_' || s.stop AS chunk_id, {_kind('s.content')} AS chunk_type, {_LETTERS} AS v FROM rows
), led AS (
  SELECT *, lead(content) OVER w AS nc, lead(chunk_id) OVER w AS ni, lead(end_position) OVER w AS ne, lead(v) OVER w AS nv FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)
)""" + _pairs("led", "coalesce(length(content) < 200 AND list_sum(v) > 0 AND list_sum(nv) > 0 AND list_cosine_similarity(v, nv) > 0.7, FALSE)") + """, pairs AS (
  SELECT doc_id, block_idx AS chunk_idx, chunk_type, start_position, CASE WHEN role = 1 THEN 'merged_' || chunk_id || '_' || ni ELSE chunk_id END AS chunk_id,
    CASE WHEN role = 1 THEN content || chr(10) || chr(10) || nc ELSE content END AS content, CASE WHEN role = 1 THEN ne ELSE end_position END AS end_position FROM roles WHERE role < 2
), behind AS (SELECT *, floor(length(content) * 0.15)::INT AS n, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS prev FROM pairs),
hybrid AS (
  SELECT doc_id, chunk_idx, chunk_id, chunk_type, CASE WHEN length(prev) > n THEN CASE WHEN n = 0 THEN prev ELSE right(prev, n) END || chr(10) || content ELSE content END AS content, start_position::INT AS start_position, end_position::INT AS end_position FROM behind
)"""


def _visible(c: str) -> str:
    for tag in ("script", "style", "head", "noscript", "template"):
        c = rf"regexp_replace({c}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', '', 'g'), '<![^>]*>', '', 'g')"
    c = rf"regexp_replace({c}, '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|body|html|title|pre)\b[^>]*>', chr(10), 'g')"
    c = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for name, code in (("nbsp", 160), ("lt", 60), ("gt", 62), ("quot", 34), ("copy", 169), ("middot", 183), ("amp", 38)):
        c = f"regexp_replace({c}, '&{name};?', chr({code}), 'g')"
    lines = rf"list_transform(string_split({c}, chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{{A0}}]+', ' ', 'g')))"
    return f"array_to_string(list_filter({lines}, lambda x: x <> ''), chr(10))"


_TOC_LINE = r"(?:Part|Chapter|Sub-chapter|Section|ANNEX|APPEBDIX)\s+[\dIVXLCDM]+\..+?\s*\.{3,}\s*\d+"
_STARTS = (r"Part\s+[IVXLCDM]+\.", r"Chapter\s+\d+\.", r"Sub-chapter\s+\d+\.\d+\.", r"Section\s+\d+\.\d+\.\d+\.")
STRIPPED = JOINED_SQL + f""", parted AS (
  SELECT doc_id, text, strpos(text, 'TABLE OF CONTENTS') AS place, substr(text, strpos(text, 'TABLE OF CONTENTS') + 17) AS tail FROM joined
), lined AS (SELECT *, regexp_extract_all(tail, '{_TOC_LINE}') AS found, regexp_split_to_array(tail, '{_TOC_LINE}') AS gaps FROM parted),
cut AS (SELECT doc_id, text, place > 0 AND len(found) > 0 AS has, gaps[-1] AS rest FROM lined),
stripped AS (SELECT doc_id, CASE WHEN NOT has THEN text {' '.join(f"WHEN regexp_matches(rest, '{p}', 'i') THEN substr(rest, strpos(rest, regexp_extract(rest, '{p}', 0, 'i')))" for p in _STARTS)} ELSE rest END AS text FROM cut)"""


def _dotted(c: str) -> str:
    return rf"regexp_replace({c}, '(?m)^[\s.\-•_]{{5,}}$', '', 'g')"


def _spaces(c: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace({c}, '\n{{2,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')")


def _prompt_sql() -> str:
    from lexmill.operators.retrieval import GENERAL_PROMPT, OFFICER_PROMPT

    return f"""WITH {CONTEXT}, asked AS (
  SELECT q.query_id, q.query, context, {_references('context')} AS refs FROM queries q JOIN contexts c ON c.query_id = q.query_id
)
SELECT query_id, 0 AS n, 'system' AS role, CASE WHEN regexp_matches(lower(query), 'compliance officer|appointment|requirements') THEN '{OFFICER_PROMPT}' ELSE '{GENERAL_PROMPT}' END AS content FROM asked
UNION ALL SELECT query_id, 1, 'user', 'Excerpts:' || chr(10) || context || chr(10) || chr(10) || 'References: ' || CASE WHEN len(refs) > 0 THEN array_to_string(refs, ', ') ELSE 'None' END || chr(10) || chr(10) || 'Question: ' || query FROM asked"""


ORACLE_SQL = {
    "clean_text": f"WITH {CLEANED} SELECT doc_id, block_idx, text FROM cleaned",
    "layout_filter": f"WITH {CLEANED} SELECT doc_id, block_idx, page, length(text)::INT AS n FROM cleaned WHERE {_KEEP}",
    "header_detect": f"WITH {HEADS} SELECT doc_id, block_idx, lv AS heading_level, hd AS heading FROM heads WHERE lv IS NOT NULL",
    "header_carry": f"WITH {CARRIED} SELECT doc_id, block_idx, array_to_string(hs, ', ') AS headers FROM carried",
    "toc_extract": f"WITH {BLOCKS_SQL}{TOC} SELECT doc_id, toc_idx, page, level, header, title FROM toc",
    "toc_enrich": f"WITH {ENRICHED} SELECT doc_id, block_idx, enriched_headers FROM enriched",
    "colon_merge": f"WITH {CLEANED}{_merged('cleaned', 'page')} SELECT doc_id, block_idx, page, text FROM merged",
    "page_reattach": f"WITH {CLEANED}, led AS (SELECT *, lead(text) OVER w AS next_text, lead(page) OVER w AS next_page FROM cleaned WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)){_pairs('led', _CONTINUES)} SELECT doc_id, block_idx, page, CASE WHEN role = 1 THEN next_page ELSE 0 END AS next_page, CASE WHEN role = 1 AND {_A} LIKE '%-' THEN substr({_A}, 1, length({_A}) - 1) || {_B} WHEN role = 1 THEN {_A} || ' ' || {_B} ELSE text END AS text FROM roles WHERE role < 2",
    "process_pipeline": f"WITH {PROCESSED} SELECT doc_id, block_idx, page, text, headers, enriched_headers FROM merged",
    "slide_chunk_500": f"WITH {PROCESSED}{_slides('merged', 'doc_id, block_idx, enriched_headers', 100, 500, 425)} SELECT doc_id, block_idx, chunk_id, enriched_headers, text FROM slides",
    "slide_chunk_1500": f"WITH {DOCUMENTS_SQL}{_slides('docs', 'doc_id', 100, 1500, 1275)} SELECT doc_id, chunk_id, text FROM slides",
    "pack_chunk": f"WITH {PACKED} SELECT doc_id, -1 AS chunk_id, text FROM source WHERE length(text) <= 2000 UNION ALL SELECT doc_id, unnest(range(len(c)))::INT, unnest(c) FROM chosen",
    "heading_chunk": rf"WITH {JOINED_SQL}, cut AS (SELECT doc_id, regexp_extract_all(text, '(?m){_HEADING}') AS h, regexp_split_to_array(text, '(?m){_HEADING}')[2:] AS c FROM joined), rows AS (SELECT doc_id, unnest(range(len(h)))::INT AS chunk_idx, unnest(h) AS h, unnest(c) AS c FROM cut) SELECT doc_id, chunk_idx, {_strip('h')} AS heading, {_strip('c')} AS content FROM rows WHERE {_strip('c')} <> ''",
    "heading_gate": rf"WITH {JOINED_SQL}, g AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '(?m){_HEADING}'))::INT AS n_headings FROM joined) SELECT doc_id, n_headings, n_headings >= 3 AND n / n_headings BETWEEN 100 AND 10000 AS structured FROM g",
    "semantic_break_chunk": f"WITH {BREAKS} SELECT doc_id, unnest(range(len(c)))::INT AS chunk_idx, unnest(c) AS content, 'Section ' || unnest(range(1, len(c) + 1)) AS heading FROM sections",
    "chunk_stats": f"WITH {DOCUMENTS_SQL}{_slides('docs', 'doc_id', 100, 500, 425)} SELECT count(*) AS n_chunks, avg(length(text)) AS avg_length, min(length(text))::INT AS min_length, max(length(text))::INT AS max_length, sum(length(text))::BIGINT AS total_length FROM slides",
    "marker_segments": f"WITH {SEGMENTS}, rows AS (SELECT doc_id, unnest(range(len(s)))::INT AS chunk_idx, unnest(s) AS s FROM segments) SELECT doc_id, chunk_idx, 'chunk_' || s.start || '_' || s.stop AS chunk_id, array_to_string(s.path, '|') AS path, s.content AS content FROM rows",
    "chunk_classify": f"WITH {BLOCKS_SQL} SELECT doc_id, {_kind('text')} AS kind, count(*) AS n FROM blocks GROUP BY ALL",
    "citations": f"WITH {BLOCKS_SQL}, r AS (SELECT doc_id, block_idx, {_references('text')} AS r FROM blocks) SELECT doc_id, block_idx, array_to_string(r, '|') AS refs FROM r WHERE len(r) > 0",
    "chunk_citations": f"WITH {BLOCKS_SQL}, r AS (SELECT doc_id, block_idx, {_citations('text')} AS r FROM blocks) SELECT doc_id, block_idx, array_to_string(r, '|') AS cited FROM r WHERE len(r) > 0",
    "cross_refs": rf"WITH {BLOCKS_SQL} SELECT doc_id, ref, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'see\s+(?:section|article|clause)\s+\d+(?:\.\d+)*', 0, 'i')) AS ref FROM blocks) GROUP BY ALL",
    "small_merge": f"WITH {SMALL} SELECT doc_id, block_idx AS chunk_idx, CASE WHEN role = 1 THEN 'merged_' || chunk_id || '_' || ni ELSE chunk_id END AS chunk_id, CASE WHEN role = 1 THEN content || chr(10) || chr(10) || nc ELSE content END AS content, array_to_string(CASE WHEN role = 1 THEN list_concat(cited, nt) ELSE cited END, '|') AS cited, CASE WHEN role = 1 THEN ne ELSE end_position END AS end_position FROM roles WHERE role < 2",
    "overlap_prefix": f"WITH {BLOCKS_SQL}, o AS (SELECT doc_id, block_idx, text, floor(length(text) * 0.15)::INT AS n, lag(text) OVER w AS prev, lag('chunk_' || block_idx || '_' || page) OVER w AS prev_id FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)), p AS (SELECT doc_id, block_idx AS chunk_idx, CASE WHEN length(prev) > n THEN CASE WHEN n = 0 THEN prev ELSE right(prev, n) END || chr(10) || text ELSE text END AS content, CASE WHEN length(prev) > n THEN prev_id ELSE '' END AS overlap_with FROM o) SELECT * FROM p WHERE length(content) >= 200",
    "hybrid_chunks": f"WITH {HYBRID} SELECT * FROM hybrid WHERE length(content) >= 200",
    "html_pages": f"SELECT page_id, {_visible('html')} AS text FROM pages",
    "embed_text": f"WITH {CHUNKS_SQL} SELECT id, CASE WHEN headers <> '' THEN headers || chr(10) || chr(10) || content ELSE content END AS embedding_text, {_preview('content')} AS preview FROM chunks",
    "query_terms": f"WITH {CHUNKS_SQL}, {_TERMS} SELECT query_id, query, array_to_string(list_concat(numbers, words), '|') AS terms, array_to_string(numbers, '|') AS numbers, array_to_string(refs, '|') AS refs, regexp_matches(lower(query), 'compliance officer|appointment|requirements') AS officers FROM terms",
    "cosine_topk": f"WITH {NEAR} SELECT id, score FROM near WHERE query_id = 20 ORDER BY score DESC, id LIMIT 10",
    "batch_topk": f"WITH {NEAR} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, id, score FROM near QUALIFY rank <= 5",
    "boosted_topk": f"WITH {HITS} SELECT query_id, rank::INT AS rank, id, score FROM hits",
    "bm25_scores": f"WITH {BM25} SELECT query_id, id, score FROM bm",
    "hybrid_search": f"WITH {BM25}, near AS (SELECT query_id, id, round(list_cosine_similarity(embedding, q_embedding), 6) AS score FROM chunks CROSS JOIN queries WHERE embedding IS NOT NULL AND q_embedding IS NOT NULL), ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM near QUALIFY r <= 50 UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= 50), fused AS (SELECT query_id, id, round(sum(1 / (60 + r)), 9) AS score FROM ranked GROUP BY query_id, id) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, id, score FROM fused QUALIFY rank <= 5",
    "related_context": f"WITH {CONTEXT} SELECT query_id, context FROM contexts",
    "prompt_build": _prompt_sql(),
    "answer_sources": f"WITH {CONTEXT}, a AS (SELECT query_id, string_agg(id || ':' || page || ':' || headers, '|' ORDER BY rank) AS sources, {_references('string_agg(content, chr(10) || chr(10) ORDER BY rank)')} AS r, count(*) / 5 AS confidence FROM hits GROUP BY query_id) SELECT a.query_id, {_preview('context')} AS answer, sources, array_to_string(r, '|') AS refs, confidence FROM a JOIN contexts c ON c.query_id = a.query_id",
    "quality_score": r"WITH odd AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || ' ﬁ ﬂ' ELSE text END AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(CASE WHEN t = '' THEN 0.0::DOUBLE WHEN length(t) < 100 THEN 0.1 WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) < 50 THEN 0.3 ELSE greatest(0.1, 1.0 - 0.1 * len(list_filter(['�', '□', '▢', 'ﬀ', 'ﬁ', 'ﬂ'], lambda a: contains(t, a)))) END, 4)::DOUBLE AS score FROM odd",
    "engine_route": "SELECT CASE WHEN length(text) * 5000 < 1000000 THEN 'pymupdf,unstructured,pdfminer' WHEN length(text) * 5000 > 10000000 THEN 'azure_document_intelligence,unstructured,pymupdf' ELSE 'pymupdf,unstructured,pdfminer,azure_document_intelligence' END AS engines, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "polygon_bbox": f"WITH {BLOCKS_SQL} SELECT doc_id, block_idx, CASE WHEN block_idx % 5 > 0 THEN 72.0 ELSE 0 END::DOUBLE AS x0, CASE WHEN block_idx % 5 > 0 THEN y0 ELSE 0 END AS y0, CASE WHEN block_idx % 5 > 0 THEN 540.0 ELSE 0 END::DOUBLE AS x1, CASE WHEN block_idx % 5 > 0 THEN y1 ELSE 0 END AS y1 FROM blocks",
    "page_runs": f"WITH {BLOCKS_SQL}, e AS (SELECT doc_id, block_idx, text, coalesce(last_value(CASE WHEN block_idx % 3 = 0 THEN page END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING), 1) AS p FROM blocks) SELECT doc_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY p)) AS page_no, string_agg(text, chr(10) ORDER BY block_idx) AS text FROM e GROUP BY doc_id, p",
    "index_stats": f"WITH {CHUNKS_SQL} SELECT count(*) AS total_documents FROM chunks WHERE embedding IS NOT NULL",
    "index_filter": f"WITH {CHUNKS_SQL} SELECT id, page, headers FROM chunks WHERE page BETWEEN 10 AND 19 AND headers <> ''",
    "dotted_lines": f"WITH {DOCUMENTS_SQL} SELECT doc_id, {_dotted('''('....... -' || chr(10) || text || chr(10) || ' . - _ • .' || chr(10) || 'end')''')} AS text FROM docs",
    "ws_normalize": f"WITH {DOCUMENTS_SQL} SELECT doc_id, {_spaces('''(' ' || chr(9) || ' ' || replace(text, chr(10), chr(10) || chr(10) || chr(10) || ' ' || chr(9)) || '  ')''')} AS text FROM docs",
    "toc_strip": f"WITH {STRIPPED} SELECT doc_id, text FROM stripped",
    "clean_regulation": f"WITH {STRIPPED} SELECT doc_id, {_spaces(_dotted('text'))} AS text FROM stripped",
    "block_predicates": rf"WITH {BLOCKS_SQL} SELECT doc_id, block_idx, regexp_matches(replace(text, chr(160), ' '), '{_LIST}')::INT AS list_item, ({_keyword('text')})::INT AS keyword, {_heady('text')}::INT AS heading_like, ({_strip('text')} LIKE '%-')::INT AS hyphen, regexp_matches({_strip('text')}, '^\p{{Ll}}')::INT AS lower FROM blocks",
    "processed_documents": f"WITH {PROCESSED} SELECT m.doc_id, max(page)::INT AS total_pages, coalesce(max(t.n), 0)::INT AS n_entries, count(*)::INT AS n_blocks FROM merged m LEFT JOIN (SELECT doc_id, count(*) AS n FROM toc GROUP BY doc_id) t ON t.doc_id = m.doc_id GROUP BY m.doc_id",
}
