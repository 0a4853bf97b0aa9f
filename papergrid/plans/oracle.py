"""The queries' results in SQL (DuckDB), written apart from the operators: name -> statement."""

from __future__ import annotations

from ..functions.labels import ARTIFACT_LABELS, CANONICAL, FOOT_LABELS, HEAD_LABELS, HEADING_LEVEL
from ..functions.text import DASHES, MEDIA_TYPES, PERIODS
from ..sources.derive import BLOCK_LABELS, LABELS


def _list(names) -> str:
    return ", ".join("'" + n + "'" for n in names)


def _case(c: str, pairs: dict, default: str = "NULL") -> str:
    value = lambda v: str(v) if isinstance(v, int) else "'" + v + "'"
    return "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {value(v)}" for k, v in pairs.items()) + f" ELSE {default} END"


_SPLIT = "unnest(string_split({0}, {1})) AS {2}, unnest(range(len(string_split({0}, {1})))) AS {3}"
W = f"""
wl AS (SELECT doc_id, {_SPLIT.format("text", "chr(10)", "line", "line_no")} FROM documents),
ww AS (SELECT doc_id, line_no, {_SPLIT.format("line", "' '", "word", "word_no")} FROM wl),
wp AS (SELECT *, 8 * coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM ww),
word_boxes AS MATERIALIZED (SELECT doc_id, line_no::INT AS line_no, word_no::INT AS word_no, x::INT AS x1, (20 * line_no)::INT AS y1, (x + 8 * length(word))::INT AS x2, (20 * line_no + 16)::INT AS y2, word FROM wp WHERE word <> '')"""
N = "nl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice)::INT AS ord FROM lineitem)"
RL = """
rn AS (SELECT l_orderkey AS table_id, count(*)::INT AS n FROM lineitem GROUP BY 1),
rule_lines AS MATERIALIZED (
  SELECT table_id, 'h' AS orient, 0 AS x1, (40 * k)::INT AS y1, 400 AS x2, (40 * k)::INT AS y2 FROM (SELECT table_id, unnest(range(n + 1)) AS k FROM rn)
  UNION ALL SELECT table_id, 'v', x, CASE WHEN x = 250 AND table_id % 3 = 0 THEN 40 ELSE 0 END, x, 40 * n FROM rn, (VALUES (0), (100), (250), (400)) AS v(x))"""
CT = (
    N
    + """,
cell_text AS MATERIALIZED (
  SELECT l_orderkey AS table_id, (3 * (ord - 1) + k)::INT AS box_id, x AS x1, 40 * (ord - 1) + 10 AS y1, (x + 8 * length(t))::INT AS x2, 40 * (ord - 1) + 26 AS y2, t AS text
  FROM (SELECT l_orderkey, ord, 0 AS k, 10 AS x, l_partkey::VARCHAR AS t FROM nl UNION ALL SELECT l_orderkey, ord, 1, 110, CAST(trunc(l_quantity) AS INT)::VARCHAR FROM nl UNION ALL SELECT l_orderkey, ord, 2, 260, l_returnflag FROM nl))"""
)
LO = (
    N
    + f""",
lb AS (SELECT l_orderkey AS page_id, 2 * ord AS obj_id, [{_list(LABELS)}][l_partkey % 10 + 1] AS label, round_even(l_discount * 100, 0)::INT AS confidence_pct,
              ((l_partkey * 37) % 700)::INT AS x1, ((l_suppkey * 53) % 900)::INT AS y1, ((l_partkey * 37) % 700 + 60 + l_partkey % 200)::INT AS x2, ((l_suppkey * 53) % 900 + 30 + l_suppkey % 150)::INT AS y2 FROM nl),
layout_objects AS MATERIALIZED (SELECT * FROM lb UNION ALL SELECT page_id, obj_id + 1, label, (7 * confidence_pct + 3) % 100, x1 + 2, y1 + 1, x2 + 2, y2 + 1 FROM lb WHERE obj_id % 4 = 0)"""
)
KV = """
kv_boxes AS MATERIALIZED (
  SELECT conv_id, turn::INT AS turn, 'key' AS part, 0 AS x1, (20 * turn)::INT AS y1, (8 * length(role))::INT AS x2, (20 * turn + 16)::INT AS y2, role AS text FROM conversations
  UNION ALL SELECT conv_id, turn::INT, 'value', 200, (20 * turn)::INT, (200 + 8 * length(text))::INT, (20 * turn + 16)::INT, text FROM conversations)"""
TT = (
    N
    + """,
tagged_tree AS MATERIALIZED (
  SELECT l_orderkey AS page_id, 0 AS seq, 'Table' AS type, '' AS text FROM nl WHERE ord = 1
  UNION ALL SELECT l_orderkey, 4 * (ord - 1) + 1, 'TR', '' FROM nl UNION ALL SELECT l_orderkey, 4 * (ord - 1) + 2, 'TD', l_partkey::VARCHAR FROM nl
  UNION ALL SELECT l_orderkey, 4 * (ord - 1) + 3, 'TD', CAST(trunc(l_quantity) AS INT)::VARCHAR FROM nl UNION ALL SELECT l_orderkey, 4 * (ord - 1) + 4, 'TD', l_returnflag FROM nl)"""
)
HB = f"""
h0 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
h1 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?i)<(/?)(h1|p|li|footer|nav)( [^>]*)?>', chr(1) || '\\1\\2' || chr(2), 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g') AS h FROM h0),
h2 AS (SELECT page_id, regexp_extract_all(h, chr(1) || '[A-Za-z0-9]+' || chr(2) || '[^' || chr(1) || ']*') AS bs FROM h1),
h3 AS (SELECT page_id, unnest(bs) AS b, unnest(range(len(bs)))::INT AS block_ord FROM h2),
html_blocks AS MATERIALIZED (SELECT page_id, block_ord, lower(regexp_extract(b, chr(1) || '([A-Za-z0-9]+)' || chr(2), 1)) AS tag, {_case("lower(regexp_extract(b, chr(1) || '([A-Za-z0-9]+)' || chr(2), 1))", BLOCK_LABELS)} AS label,
                trim(regexp_replace(b, '^' || chr(1) || '[A-Za-z0-9]+' || chr(2), '')) AS text FROM h3)"""


def gaps(source: str, keys: str, lo: str, hi: str, least: int, name: str = "gap") -> str:
    return f"""
{name}_p AS (SELECT {keys}, {lo} AS l, max({hi}) OVER (PARTITION BY {keys} ORDER BY {lo} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name} AS (SELECT DISTINCT {keys}, reach + 1 AS first, l - 1 AS last, ((reach + 1 + l - 1) // 2)::INT AS centre FROM {name}_p WHERE l - 1 - reach >= {least})"""


def islands(source: str, keys: str, lo: str, hi: str, order: str, overlap: int, name: str) -> str:
    o = f"PARTITION BY {keys} ORDER BY {lo}, {hi}{', ' + order if order else ''}"
    return f"""
{name}_n AS (SELECT *, coalesce((max({hi}) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {lo} <= {overlap})::INT, 0) AS new FROM {source}),
{name} AS (SELECT * EXCLUDE new, (sum(new) OVER ({o} {'ROWS' if order else 'RANGE'} BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INT AS gid FROM {name}_n)"""


CELLS = """
hl AS (SELECT * FROM rule_lines WHERE orient = 'h'), vl AS (SELECT * FROM rule_lines WHERE orient = 'v'),
b0 AS (SELECT a.table_id, greatest(a.x1, b.x1) AS x1, least(a.x2, b.x2) AS x2, a.y1, min(b.y2) AS y2 FROM hl a JOIN hl b ON a.table_id = b.table_id AND a.y1 < b.y1 AND a.x1 <= b.x2 AND b.x1 <= a.x2 GROUP BY ALL),
b1 AS (SELECT table_id, x1, x2, max(y1) AS y1, y2 FROM b0 GROUP BY ALL),
c0 AS (SELECT b1.table_id, b1.x1, b1.x2, b1.y1, b1.y2, v.x1 AS x FROM b1 JOIN vl v ON v.table_id = b1.table_id AND v.x1 BETWEEN b1.x1 - greatest(5, (b1.x2 - b1.x1) * 0.025) AND b1.x2 + greatest(5, (b1.x2 - b1.x1) * 0.025)
        AND b1.y2 - b1.y1 - (least(b1.y2, v.y2) - greatest(b1.y1, v.y1)) <= greatest(5, least(10, 0.1 * (b1.y2 - b1.y1)))),
c1 AS (SELECT *, lead(x) OVER (PARTITION BY table_id, x1, x2, y1, y2 ORDER BY x) AS nx FROM c0),
cells AS MATERIALIZED (SELECT table_id, (row_number() OVER (PARTITION BY table_id ORDER BY x1, x2, y2, y1 DESC, x) - 1)::INT AS cell_id, x AS x1, y1, nx AS x2, y2 FROM c1 WHERE nx IS NOT NULL)"""
PAIRS = "pr AS MATERIALIZED (SELECT a.table_id, a.cell_id AS ai, b.cell_id AS bi, a, b FROM {0} a JOIN {0} b ON a.table_id = b.table_id)"
ADJ = """
adj AS MATERIALIZED (SELECT table_id, ai AS a_cell_id, bi AS b_cell_id FROM pr WHERE ai < bi AND (
  (least(a.y2, b.y2) - greatest(a.y1, b.y1) > 5 AND least(abs(a.x1 - b.x1), abs(a.x1 - b.x2), abs(a.x2 - b.x1), abs(a.x2 - b.x2)) <= least(5, least(a.x2 - a.x1, b.x2 - b.x1) // 20))
  OR (least(a.x2, b.x2) - greatest(a.x1, b.x1) > 5 AND least(abs(a.y1 - b.y1), abs(a.y1 - b.y2), abs(a.y2 - b.y1), abs(a.y2 - b.y2)) <= least(5, least(a.y2 - a.y1, b.y2 - b.y1) // 20))))"""
RC = (
    N
    + """,
rr AS (SELECT l_orderkey AS table_id, ord, l_partkey AS p, l_suppkey AS q, 40 * (ord - 1) + CASE WHEN ord > 4 THEN 100 ELSE 0 END AS t FROM nl),
rc AS (
  SELECT table_id, 4 * ord AS cell_id, (p % 7 - 3)::INT AS x1, (t + q % 7 - 3)::INT AS y1, (100 + (p + 1) % 7 - 3)::INT AS x2, (t + 40 + (q + 1) % 7 - 3)::INT AS y2 FROM rr
  UNION ALL SELECT table_id, 4 * ord + 1, 97 + (p + 1) % 7, t + (q + 2) % 7 - 3, 247 + (p + 2) % 7, t + 37 + (q + 3) % 7 FROM rr
  UNION ALL SELECT table_id, 4 * ord + 2, 247 + (p + 2) % 7, t + (q + 4) % 7 - 3, 397 + (p + 3) % 7, t + 37 + (q + 5) % 7 FROM rr
  UNION ALL SELECT table_id, 4 * ord + 3, 4, t + 4, 396, t + 36 FROM rr WHERE ord % 4 = 1),
rough_cells AS MATERIALIZED (SELECT table_id, cell_id::INT AS cell_id, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2 FROM rc)"""
)
GRID = """
gy AS (SELECT table_id, a, lead(a) OVER (PARTITION BY table_id ORDER BY a) AS b, (row_number() OVER (PARTITION BY table_id ORDER BY a) - 1)::INT AS row_id FROM (SELECT table_id, y1 AS a FROM cells UNION SELECT table_id, y2 FROM cells)),
gx AS (SELECT table_id, a, lead(a) OVER (PARTITION BY table_id ORDER BY a) AS b, (row_number() OVER (PARTITION BY table_id ORDER BY a) - 1)::INT AS col_id FROM (SELECT table_id, x1 AS a FROM cells UNION SELECT table_id, x2 FROM cells)),
slots AS (SELECT gy.table_id, row_id, col_id, gx.a AS l, gy.a AS t, gx.b AS r, gy.b AS b FROM gy JOIN gx USING (table_id) WHERE gy.b IS NOT NULL AND gx.b IS NOT NULL),
sc AS (SELECT s.*, c.x1, c.y1, c.x2, c.y2, row_number() OVER (PARTITION BY s.table_id, row_id, col_id ORDER BY (c.x2 - c.x1) * (c.y2 - c.y1), cell_id) AS n
       FROM slots s JOIN cells c ON c.table_id = s.table_id AND greatest(0, least(r, c.x2) - greatest(l, c.x1)) * greatest(0, least(b, c.y2) - greatest(t, c.y1)) >= 0.9 * (r - l) * (b - t) AND least(c.y2, b) - greatest(c.y1, t) >= 0.9 * (b - t)),
grid AS MATERIALIZED (SELECT table_id, row_id, col_id, x1, y1, x2, y2 FROM sc WHERE n = 1)"""
SPANS = """
spans AS MATERIALIZED (SELECT table_id, min(row_id) AS row_id, min(col_id) AS col_id, max(row_id) - min(row_id) + 1 AS rowspan, max(col_id) - min(col_id) + 1 AS colspan, x1, y1, x2, y2 FROM grid GROUP BY table_id, x1, y1, x2, y2)"""
INSIDE = "least(t.x2, c.x2) > greatest(t.x1, c.x1) AND least(t.y2, c.y2) > greatest(t.y1, c.y1) AND ((c.x1 <= t.x1 AND c.y1 <= t.y1 AND c.x2 >= t.x2 AND c.y2 >= t.y2) OR (least(t.x2, c.x2) - greatest(t.x1, c.x1)) * (least(t.y2, c.y2) - greatest(t.y1, c.y1)) >= {0} * (t.x2 - t.x1) * (t.y2 - t.y1))"
FILLED = f"""
pm AS MATERIALIZED (SELECT t.*, c.row_id, c.col_id, {INSIDE.format(0.8)} AS inside FROM cell_text t JOIN spans c ON t.table_id = c.table_id),
pt AS (SELECT * EXCLUDE inside, row_number() OVER (PARTITION BY table_id, box_id ORDER BY row_id, col_id) AS n FROM pm WHERE inside),
pl AS (SELECT *, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM pt WHERE n = 1 WINDOW w AS (PARTITION BY table_id, row_id, col_id ORDER BY y1, x1, box_id)),
pc AS (SELECT table_id, row_id, col_id, string_agg(CASE WHEN px2 IS NOT NULL AND (abs(x1 - px2) >= 5 OR py2 < y1) THEN ' ' ELSE '' END || text, '' ORDER BY y1, x1, box_id) AS content FROM pl GROUP BY ALL),
filled AS (SELECT spans.*, coalesce(content, '') AS content FROM spans LEFT JOIN pc USING (table_id, row_id, col_id))"""
LT = f"""
lw AS (SELECT *, lag(word) OVER (PARTITION BY doc_id, line_no ORDER BY word_no) AS prev FROM word_boxes),
line_texts AS MATERIALIZED (SELECT doc_id, line_no, string_agg(CASE WHEN prev IS NULL OR regexp_matches(prev, '[{DASHES}\\s]$') OR regexp_matches(word, '^[{DASHES}\\s]') THEN '' ELSE ' ' END || word, '' ORDER BY word_no) AS line_text FROM lw GROUP BY ALL)"""
ENDS = "regexp_matches({0}, '[" + PERIODS + "]\\s*$')"
ESC = "regexp_replace({0}, '([\\\\`*_~#+\\-!])', '\\\\\\1', 'g')"
RENDER = (
    "CASE WHEN {c} IN ('Unknown', 'abandon', 'number') THEN NULL "
    + " ".join(f"WHEN {{c}} = '{k}' THEN '{'#' * v} ' || " + ESC.format("{t}").replace("{t}", "{{t}}") + " || chr(10) || chr(10)" for k, v in HEADING_LEVEL.items()).replace("{{t}}", "{t}")
    + " WHEN {c} = 'List-item' THEN '- ' || "
    + ESC.format("{t}")
    + " || chr(10) WHEN {c} = 'Table' THEN {t} || chr(10) || chr(10) ELSE "
    + ESC.format("{t}")
    + " || chr(10) || chr(10) END"
)


def render(c: str, t: str) -> str:
    return RENDER.replace("{c}", c).replace("{t}", t)


CANON = _case("lower(label)", CANONICAL, "'Unknown'")
LIST_TAG, BULLET = "^[ \\t]*([0-9]{1,3}|[A-Za-z])[.)]([ \\t]|$)", "^[ \\t]*[•●○▪■◦‣·*–-]([ \\t]|$)"


def q(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + "\n" + select


_SEC = f"CASE WHEN label IN ({_list(HEAD_LABELS)}) THEN 0 WHEN label IN ({_list(FOOT_LABELS)}) THEN 2 ELSE 1 END"
_IOU = "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
_I = _IOU.format(a="a", b="b")
_STRUCT = "{'obj_id': obj_id, 'is_table': lower(label) = 'table', 'confidence_pct': confidence_pct, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
_II = _IOU.format(a="k", b="x[1]")
_HIT = f"list_filter(acc, lambda k: {_II} > 0.8 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - {_II}))"
_NMS_STEP = f"CASE WHEN len({_HIT}) = 0 THEN acc || x WHEN x[1].confidence_pct > {_HIT}[1].confidence_pct THEN list_filter(acc, lambda m: m.obj_id <> {_HIT}[1].obj_id) || x ELSE acc END"
_HELD = f"list_filter(acc, lambda k: (k.x1 <= x[1].x1 + 2 AND k.y1 <= x[1].y1 + 2 AND k.x2 >= x[1].x2 - 2 AND k.y2 >= x[1].y2 - 2) OR {_II} >= 0.9 * (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1))"
_HOLD_STEP = f"CASE WHEN len({_HELD}) = 0 OR (NOT {_HELD}[1].is_table AND x[1].is_table) THEN acc || x ELSE acc END"
_ROW = lambda cell, by: f"string_agg({cell}, '{by}' ORDER BY col_id)"
_HTML_CELL = lambda tag: f"'<' || {tag} || CASE WHEN rowspan > 1 THEN ' rowspan=\"' || rowspan || '\"' ELSE '' END || CASE WHEN colspan > 1 THEN ' colspan=\"' || colspan || '\"' ELSE '' END || '>' || content || '</' || {tag} || '>'"

ORACLES = {
    "column_gaps": q(W, gaps("word_boxes", "doc_id", "x1", "x2", 6), select="SELECT * FROM gap"),
    "column_positions": q(LO, gaps("layout_objects", "page_id", "x1", "x2", 30), select="SELECT page_id, centre AS position, 'gap' AS kind FROM gap UNION ALL SELECT page_id, min(x1), 'left' FROM layout_objects GROUP BY 1 UNION ALL SELECT page_id, max(x2), 'right' FROM layout_objects GROUP BY 1"),
    "text_line_groups": q(LO, islands("layout_objects", "page_id", "y1", "y2", "obj_id", 0, "g"), select="SELECT page_id, obj_id, gid AS line_id FROM g"),
    "band_line_groups": q(LO, islands("layout_objects", "page_id", "y1", "y2", "obj_id", -3, "g"), select="SELECT page_id, obj_id, gid AS line_id FROM g"),
    "y_band_split": q(LO, islands("layout_objects", "page_id", "y1", "y2", "obj_id", 2, "g"), select="SELECT page_id, gid AS band_id, min(y1) AS top, max(y2) AS bottom, count(*) AS n FROM g GROUP BY 1, 2"),
    "blank_bands": q(LO, islands("layout_objects", "page_id", "y1", "y2", "", -15, "g"), select="SELECT page_id, gid AS region_id, min(y1) AS first, max(y2) AS last, count(*) AS n FROM g GROUP BY 1, 2"),
    "merged_spans": q(LO, islands("layout_objects", "page_id", "x1", "x2", "", -1, "g"), select="SELECT page_id, gid AS group_id, min(x1) AS first, max(x2) AS last, count(*) AS n FROM g GROUP BY 1, 2"),
    "close_value_groups": q(
        LO, "d AS (SELECT DISTINCT page_id, x1 AS v FROM layout_objects), e AS (SELECT *, coalesce((v - lag(v) OVER (PARTITION BY page_id ORDER BY v) >= 10)::INT, 0) AS new FROM d), f AS (SELECT *, (sum(new) OVER (PARTITION BY page_id ORDER BY v))::INT AS group_id FROM e)",
        select="SELECT page_id, group_id, min(v) AS low, max(v) AS high, count(*) AS n, round_even(sum(v)::DOUBLE / count(*), 0)::INT AS delimiter FROM f GROUP BY 1, 2",
    ),
    "whitespace_sweep": q(
        LO, "e AS (SELECT page_id, x1 AS a FROM layout_objects UNION SELECT page_id, x2 FROM layout_objects), s AS (SELECT page_id, a, lead(a) OVER (PARTITION BY page_id ORDER BY a) AS b FROM e), m AS (SELECT s.page_id, a, b, y1, y2 FROM s JOIN layout_objects o ON o.page_id = s.page_id AND o.x1 < b AND o.x2 > a)",
        gaps("m", "page_id, a, b", "y1", "y2", 50), "r AS (SELECT *, coalesce((lag(b) OVER (PARTITION BY page_id, first, last ORDER BY a) <> a)::INT, 0) AS new FROM gap), t AS (SELECT *, sum(new) OVER (PARTITION BY page_id, first, last ORDER BY a) AS run FROM r)",
        select="SELECT page_id, min(a) AS x1, first AS y1, max(b) AS x2, last AS y2 FROM t GROUP BY page_id, first, last, run",
    ),
    "row_histogram": q(W, select="SELECT doc_id, y::INT AS y, sum(w)::BIGINT AS weight FROM (SELECT doc_id, unnest(range(y1, y2)) AS y, x2 - x1 AS w FROM word_boxes) GROUP BY 1, 2"),
    "filled_runs": q(
        LO, "h AS (SELECT page_id, px::INT AS px, sum(w) AS weight FROM (SELECT page_id, unnest(range(y1, y2)) AS px, x2 - x1 AS w FROM layout_objects) GROUP BY 1, 2), i AS (SELECT *, coalesce((px - lag(px) OVER (PARTITION BY page_id ORDER BY px) > 6)::INT, 0) AS new FROM h), j AS (SELECT *, (sum(new) OVER (PARTITION BY page_id ORDER BY px))::INT AS run_id FROM i)",
        select="SELECT page_id, run_id, min(px) AS first, max(px) AS last, sum(weight)::BIGINT AS weight FROM j GROUP BY 1, 2",
    ),
    "char_width_mode": q(
        W, "h AS (SELECT doc_id, x2 - x1 AS w, count(*) AS n FROM word_boxes GROUP BY 1, 2), m AS (SELECT doc_id, arg_max(w, n * 1000000 - w) AS mode_width, sum(w * n)::BIGINT AS total, sum(n)::BIGINT AS boxes FROM h GROUP BY 1)",
        select="SELECT doc_id, mode_width, boxes, CASE WHEN 3 * mode_width * boxes > 2 * total THEN mode_width::BIGINT * 1000 ELSE total * 1000 // boxes END AS char_milli FROM m",
    ),
    "average_char_width": q(KV, select="SELECT conv_id, coalesce(sum(x2 - x1) * 1000 // nullif(sum(length(text)), 0), 10000)::BIGINT AS char_milli FROM kv_boxes GROUP BY 1"),
    "width_histogram": q(LO, select="SELECT label, x2 - x1 AS width, count(*) AS n FROM layout_objects GROUP BY 1, 2"),
    "median_box": q(LO, select="SELECT label, (2 * median(x2 - x1))::BIGINT AS width2, (2 * median(y2 - y1))::BIGINT AS height2 FROM layout_objects GROUP BY 1"),
    "line_sep_mode": q(
        LO, "k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY obj_id) AS rn FROM layout_objects), s AS (SELECT i.page_id, i.obj_id, min((j.y1 + j.y2) - (i.y1 + i.y2)) AS sep2 FROM k i JOIN k j ON i.page_id = j.page_id AND i.rn > 1 AND j.rn > 1 AND least(i.x1 + i.y2 - i.y1, j.x1 + j.y2 - j.y1) > greatest(i.x1, j.x1) AND j.y1 + j.y2 > i.y1 + i.y2 GROUP BY 1, 2)",
        "c AS (SELECT page_id, (2 * (sep2 // 4) + 1)::INT AS sep, count(*) AS n, min(obj_id) AS first FROM s GROUP BY 1, 2)",
        select="SELECT page_id, sep AS line_sep, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS r FROM c) WHERE r = 1",
    ),
    "iou_pairs": q(
        LO, f"pp AS MATERIALIZED (SELECT a.page_id, a.obj_id AS a_obj_id, b.obj_id AS b_obj_id, {_I} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM layout_objects a JOIN layout_objects b ON a.page_id = b.page_id)",
        select="SELECT page_id, a_obj_id, b_obj_id FROM pp WHERE a_obj_id < b_obj_id AND i > 0.8 * (s - i)",
    ),
    "box_overlap_join": q(
        LO, f"pp AS MATERIALIZED (SELECT t.page_id, t.obj_id AS element_id, c.obj_id AS object_id, {INSIDE.format(0.7)} AS inside FROM layout_objects t JOIN layout_objects c ON t.page_id = c.page_id WHERE c.label = 'table' AND t.label <> 'table')",
        select="SELECT page_id, element_id, object_id FROM pp WHERE inside",
    ),
    "label_normalize": q(LO, select=f"SELECT page_id, obj_id, {CANON} AS canonical, {_case(CANON, HEADING_LEVEL)} AS level FROM layout_objects"),
    "table_pages": q(LO, select="SELECT o_orderkey AS page_id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT page_id FROM layout_objects WHERE label = 'table')"),
    "padded_boxes": q(LO, select="SELECT page_id, obj_id, x1, y1, x2 + CASE WHEN label = 'table' THEN 12 ELSE 8 END AS x2, y2 + CASE WHEN label = 'table' THEN 12 ELSE 8 END AS y2 FROM layout_objects"),
    "points_to_pixels": q(LO, select="SELECT page_id, obj_id, 2 * x1 AS x1, 2 * y1 AS y1, 2 * x2 AS x2, 2 * y2 AS y2 FROM layout_objects"),
    "clip_windows": q(LO, select="SELECT page_id, obj_id, least(greatest(x1, 0), 800) AS x1, least(greatest(y1, 0), 1000) AS y1, least(greatest(x2 + 4, 0), 800) AS x2, least(greatest(y2, 0), 1000) AS y2 FROM layout_objects"),
    "nms": q(
        LO, "t AS (SELECT * FROM layout_objects WHERE lower(label) = 'table'), k AS (SELECT * FROM layout_objects o WHERE NOT (lower(label) = 'table' AND EXISTS (SELECT 1 FROM t WHERE t.page_id = o.page_id AND t.obj_id <> o.obj_id AND t.confidence_pct > o.confidence_pct AND o.x1 <= t.x1 AND o.y1 <= t.y1 AND o.x2 >= t.x2 AND o.y2 >= t.y2)))",
        f"g AS (SELECT page_id, list([{_STRUCT}] ORDER BY obj_id) AS os FROM k GROUP BY 1), r AS (SELECT page_id, list_reduce(os, lambda acc, x: {_NMS_STEP}) AS kept FROM g)",
        select="SELECT page_id, (pos - 1)::INT AS pos, o.obj_id, o.confidence_pct FROM (SELECT page_id, unnest(kept) AS o, unnest(range(1, len(kept) + 1)) AS pos FROM r)",
    ),
    "containment_filter": q(
        LO, f"g AS (SELECT page_id, list([{_STRUCT}] ORDER BY (x2 - x1) * (y2 - y1) DESC, obj_id) AS os FROM layout_objects GROUP BY 1), r AS (SELECT page_id, list_reduce(os, lambda acc, x: {_HOLD_STEP}) AS kept FROM g)",
        select="SELECT page_id, (pos - 1)::INT AS pos, o.obj_id FROM (SELECT page_id, unnest(kept) AS o, unnest(range(1, len(kept) + 1)) AS pos FROM r)",
    ),
    "reading_order": q(
        LO, f"s AS MATERIALIZED (SELECT *, {_SEC} AS section FROM layout_objects WHERE label NOT IN ({_list(ARTIFACT_LABELS)})), body AS MATERIALIZED (SELECT * FROM s WHERE section = 1)", gaps("body", "page_id", "x1", "x2", 30),
        "nb AS (SELECT * FROM body WHERE page_id NOT IN (SELECT page_id FROM gap))", islands("nb", "page_id", "y1", "y2", "obj_id", 2, "bi"), gaps("bi", "page_id, gid", "x1", "x2", 5, "bg"),
        "bt AS (SELECT * REPLACE (gid + d AS gid) FROM bi, (VALUES (0), (1)) AS v(d))", gaps("bt", "page_id, gid", "x1", "x2", 5, "tg"),
        "bc AS (SELECT b.page_id, b.gid, (SELECT count(*) FROM bg WHERE bg.page_id = b.page_id AND bg.gid = b.gid) AS own, (SELECT count(*) FROM tg WHERE tg.page_id = b.page_id AND tg.gid = b.gid) AS two FROM (SELECT DISTINCT page_id, gid FROM bi) b)",
        "bl AS (SELECT *, coalesce((NOT (own > 0 AND own = lag(own) OVER w AND own = two))::INT, 1) AS new FROM bc WINDOW w AS (PARTITION BY page_id ORDER BY gid)), bm AS (SELECT page_id, gid, (sum(new) OVER (PARTITION BY page_id ORDER BY gid) - 1)::INT AS band_id FROM bl)",
        "bb AS MATERIALIZED (SELECT bi.*, band_id FROM bi JOIN bm USING (page_id, gid))", gaps("bb", "page_id, band_id", "x1", "x2", 5, "mg"),
        "c AS (SELECT s.page_id, s.obj_id, s.section, s.x2, s.y1, CASE WHEN s.section = 1 THEN (SELECT count(*) FROM gap g WHERE g.page_id = s.page_id AND g.centre <= s.x2) ELSE 0 END::INT AS column_id, coalesce(bb.band_id, 0)::INT AS band_id, (SELECT count(*) FROM mg WHERE mg.page_id = bb.page_id AND mg.band_id = bb.band_id AND mg.centre < bb.x1)::INT AS band_column FROM s LEFT JOIN bb ON s.page_id = bb.page_id AND s.obj_id = bb.obj_id)",
        select="SELECT page_id, obj_id, section, column_id, band_id, band_column, (row_number() OVER (PARTITION BY page_id ORDER BY section, column_id, band_id, band_column, CASE WHEN section = 1 THEN y1 ELSE x2 END, obj_id) - 1)::INT AS reading_pos FROM c",
    ),
    "attach_cells": q(
        LO, CT.replace(N + ",", ""), "b AS (SELECT page_id, obj_id, row_number() OVER (PARTITION BY page_id ORDER BY obj_id)::INT AS k FROM layout_objects WHERE lower(label) = 'table'), t AS (SELECT table_id AS page_id, y1 AS top, count(*) AS n_cells FROM cell_text GROUP BY 1, 2), u AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY top)::INT AS k FROM t)",
        select="SELECT b.page_id, b.obj_id, b.k, top, n_cells FROM b LEFT JOIN u USING (page_id, k)",
    ),
    "column_count": q(CT, gaps("cell_text", "table_id", "x1", "x2", 20), select="SELECT table_id, (1 + coalesce(g, 0))::INT AS n_cols FROM (SELECT DISTINCT table_id FROM cell_text) LEFT JOIN (SELECT table_id, count(*) AS g FROM gap GROUP BY 1) USING (table_id)"),
    "cells_from_lines": q(RL, CELLS, select="SELECT * FROM cells"),
    "cell_dedup": q(
        RC, "k AS (SELECT table_id, cell_id, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, greatest(x2, 0) AS x2, greatest(y2, 0) AS y2, (x2 - x1) * (y2 - y1) AS a FROM rough_cells)",
        "ex AS (SELECT table_id, x1 AS e FROM k UNION SELECT table_id, x2 FROM k), ey AS (SELECT table_id, y1 AS e FROM k UNION SELECT table_id, y2 FROM k)",
        "f AS (SELECT k.table_id, k.cell_id, row_number() OVER (PARTITION BY k.table_id, ex.e, ey.e ORDER BY a, cell_id) AS n FROM k JOIN ex ON k.table_id = ex.table_id JOIN ey ON k.table_id = ey.table_id WHERE ex.e >= x1 AND ex.e < x2 AND ey.e >= y1 AND ey.e < y2)",
        select="SELECT * FROM rough_cells WHERE (table_id, cell_id) IN (SELECT (table_id, cell_id) FROM f WHERE n = 1)",
    ),
    "cell_adjacency": q(RL, CELLS, PAIRS.format("cells"), ADJ, select="SELECT * FROM adj"),
    "table_components": q(
        RC, PAIRS.format("rough_cells"), ADJ, "both_ways AS (SELECT table_id, a_cell_id AS u, b_cell_id AS v FROM adj UNION ALL SELECT table_id, b_cell_id, a_cell_id FROM adj), reach AS (SELECT table_id, u, v FROM both_ways UNION SELECT r.table_id, r.u, w.v FROM reach r JOIN both_ways w ON r.table_id = w.table_id AND r.v = w.u)",
        select="SELECT table_id, u AS cell_id, least(u, min(v)) AS component FROM reach GROUP BY 1, 2",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "snapped_cells": q(
        RC, "z AS (SELECT table_id, least((max(x2) - min(x1)) * 0.02, 10.0) AS tx, least((max(y2) - min(y1)) * 0.02, 10.0) AS ty FROM rough_cells GROUP BY 1)",
        "e AS (SELECT table_id, 'x' AS axis, x1 AS e FROM rough_cells UNION SELECT table_id, 'x', x2 FROM rough_cells UNION SELECT table_id, 'y', y1 FROM rough_cells UNION SELECT table_id, 'y', y2 FROM rough_cells)",
        "n AS (SELECT e.*, coalesce((e - lag(e) OVER w >= CASE WHEN axis = 'x' THEN tx ELSE ty END)::INT, 0) AS new FROM e JOIN z USING (table_id) WINDOW w AS (PARTITION BY table_id, axis ORDER BY e))",
        "m AS (SELECT *, sum(new) OVER (PARTITION BY table_id, axis ORDER BY e) AS grp FROM n), d AS MATERIALIZED (SELECT table_id, axis, round_even(sum(e)::DOUBLE / count(*), 0)::INT AS d FROM m GROUP BY table_id, axis, grp)",
        "u AS (SELECT table_id, cell_id, unnest(['x1', 'y1', 'x2', 'y2']) AS side, unnest([x1, y1, x2, y2]) AS v FROM rough_cells)",
        "w AS (SELECT u.table_id, cell_id, side, arg_min(d.d, abs(d.d - v) * 100000 + d.d) AS s FROM u JOIN d ON u.table_id = d.table_id AND u.side[1] = d.axis GROUP BY 1, 2, 3)",
        "o AS (SELECT table_id, cell_id, max(s) FILTER (WHERE side = 'x1') AS x1, max(s) FILTER (WHERE side = 'y1') AS y1, max(s) FILTER (WHERE side = 'x2') AS x2, max(s) FILTER (WHERE side = 'y2') AS y2 FROM w GROUP BY 1, 2)",
        select="SELECT * FROM o WHERE x2 > x1 AND y2 > y1",
    ),
    "grid_pivot": q(RL, CELLS, GRID, select="SELECT * FROM grid"),
    "grid_gaps": q(
        RL, CELLS.replace("cells AS", "every AS").replace("FROM cells", "FROM every"), "cells AS MATERIALIZED (SELECT * FROM every WHERE cell_id % 5 <> 2)", GRID,
        "bare AS (SELECT * FROM slots WHERE (table_id, row_id, col_id) NOT IN (SELECT (table_id, row_id, col_id) FROM grid)), nr AS (SELECT b.*, c.cell_id, unnest([0, 1]) AS k, unnest([c.x1, c.x2]) AS x FROM bare b LEFT JOIN cells c ON b.table_id = c.table_id AND c.y1 <= b.t AND c.y2 >= b.b)",
        "fb AS (SELECT table_id, row_id, col_id, l, t, r, b, arg_min(x, [least(abs(x - l), abs(x - r)), cell_id, k]) AS x FROM nr GROUP BY ALL)",
        select="SELECT * FROM grid UNION ALL SELECT table_id, row_id, col_id, coalesce(x, l), t, coalesce(x, r), b FROM fb",
    ),
    "span_compress": q(RL, CELLS, GRID, SPANS, select="SELECT * FROM spans"),
    "text_to_cell": q(RL, CT, CELLS, GRID, select=f"SELECT table_id, box_id, row_id, col_id FROM (SELECT t.table_id, t.box_id, c.row_id, c.col_id, row_number() OVER (PARTITION BY t.table_id, t.box_id ORDER BY c.row_id, c.col_id) AS n FROM cell_text t JOIN grid c ON t.table_id = c.table_id AND {INSIDE.format(0.8)}) WHERE n = 1"),
    "cell_contents": q(RL, CT, CELLS, GRID, SPANS, FILLED, select="SELECT table_id, row_id, col_id, rowspan, colspan, content FROM filled"),
    "empty_row_col_drop": q(
        RL, CT, CELLS, GRID, "f AS (SELECT DISTINCT c.table_id, row_id, col_id FROM grid c JOIN cell_text t ON c.table_id = t.table_id WHERE t.box_id // 3 % 4 <> 1 AND c.x1 <= t.x1 AND c.y1 <= t.y1 AND c.x2 >= t.x2 AND c.y2 >= t.y2)",
        select="SELECT table_id, (dense_rank() OVER (PARTITION BY table_id ORDER BY row_id) - 1)::INT AS row_id, (dense_rank() OVER (PARTITION BY table_id ORDER BY col_id) - 1)::INT AS col_id, x1, y1, x2, y2 FROM grid WHERE (table_id, row_id) IN (SELECT (table_id, row_id) FROM f) AND (table_id, col_id) IN (SELECT (table_id, col_id) FROM f)",
    ),
    "row_coherency": q(
        RL, CELLS, GRID, "r AS (SELECT table_id, row_id, min(y1) AS top FROM grid GROUP BY 1, 2), d AS (SELECT table_id, lead(top) OVER (PARTITION BY table_id ORDER BY row_id) - top AS d FROM r), s AS (SELECT table_id, list_sort(list(d)) AS ds FROM d WHERE d IS NOT NULL GROUP BY 1), w AS (SELECT table_id, col_id, min(x2) - max(x1) AS w FROM grid GROUP BY 1, 2)",
        select="SELECT m.table_id, ds[len(ds) // 2 + 1]::INT AS row_step, col_width2 FROM (SELECT table_id, (2 * median(w))::INT AS col_width2 FROM w GROUP BY 1) m LEFT JOIN s USING (table_id)",
    ),
    "table_markdown": q(
        RL, CT, CELLS, GRID, SPANS, FILLED, f"r AS (SELECT table_id, row_id, ' | ' || {_ROW('content', ' | ')} || ' | ' || chr(10) AS line, ' | ' || {_ROW(chr(39) + '---' + chr(39), ' | ')} || ' | ' || chr(10) AS rule FROM filled GROUP BY 1, 2)",
        select="SELECT table_id, '##' || chr(10) || string_agg(line || CASE WHEN row_id = 0 THEN rule ELSE '' END, '' ORDER BY row_id) AS markdown FROM r GROUP BY 1",
    ),
    "table_html": q(
        RL, CT, CELLS, GRID, SPANS, FILLED, "n AS (SELECT table_id, max(row_id) + 1 AS rows FROM filled GROUP BY 1)",
        f"r AS (SELECT table_id, row_id, '<tr>' || {_ROW(_HTML_CELL('CASE WHEN row_id = 0 AND rows > 1 THEN ' + chr(39) + 'th' + chr(39) + ' ELSE ' + chr(39) + 'td' + chr(39) + ' END'), '')} || '</tr>' AS line, any_value(rows) AS rows FROM filled JOIN n USING (table_id) GROUP BY 1, 2)",
        select="SELECT table_id, '<table>' || string_agg(CASE WHEN row_id = 0 AND rows > 1 THEN '<thead>' || line || '</thead>' ELSE line END, '' ORDER BY row_id) || '</table>' AS html FROM r GROUP BY 1",
    ),
    "table_json": q(RL, CT, CELLS, GRID, SPANS, FILLED, select="SELECT table_id, row_id, (row_number() OVER (PARTITION BY table_id, row_id ORDER BY col_id) - 1)::INT AS item, content, rowspan, colspan FROM filled"),
    "table_dump": q(
        RL, CELLS, GRID, "r AS (SELECT table_id, row_id, count(*) AS cols, '  Row ' || (row_id + 1) || ':' || chr(10) || string_agg('    Cell[' || row_id || ',' || col_id || '] - X1: ' || x1 || ', Y1: ' || y1 || ', X2: ' || x2 || ', Y2: ' || y2 || chr(10), '' ORDER BY col_id) AS line FROM grid GROUP BY 1, 2)",
        select="SELECT table_id, 'Table Title: Untitled' || chr(10) || 'Number of Rows: ' || count(*) || chr(10) || 'Number of Columns: ' || max(CASE WHEN row_id = 0 THEN cols END) || chr(10) || 'Borderless: False' || chr(10) || 'Rows:' || chr(10) || string_agg(line, '' ORDER BY row_id) AS dump FROM r GROUP BY 1",
    ),
    "edge_lines": q(
        RL, "b AS (SELECT *, min(y1) OVER w AS y0, max(y1) OVER w AS y9, min(x1) OVER w AS x0, max(x1) OVER w AS x9 FROM rule_lines WINDOW w AS (PARTITION BY table_id, orient))",
        select="SELECT table_id, 'top' AS side, x1, y1, x2, y2 FROM b WHERE orient = 'h' AND y1 - y0 <= 4 UNION ALL SELECT table_id, 'bottom', x1, y1, x2, y2 FROM b WHERE orient = 'h' AND y9 - y1 <= 4 UNION ALL SELECT table_id, 'left', x1, y1, x2, y2 FROM b WHERE orient = 'v' AND x1 - x0 <= 4 UNION ALL SELECT table_id, 'right', x1, y1, x2, y2 FROM b WHERE orient = 'v' AND x9 - x1 <= 4",
    ),
    "cell_edges": q(
        RL, CELLS, "e AS (SELECT table_id, 'h' AS orient, y1 AS coord, x1 AS a, x2 AS b FROM cells UNION ALL SELECT table_id, 'h', y2, x1, x2 FROM cells UNION ALL SELECT table_id, 'v', x1, y1, y2 FROM cells UNION ALL SELECT table_id, 'v', x2, y1, y2 FROM cells)",
        select="SELECT table_id, orient, coord, min(a) AS first, max(b) AS last FROM e GROUP BY 1, 2, 3",
    ),
    "noise_line_drop": q(
        RL, CT, select="""SELECT DISTINCT * FROM rule_lines l WHERE (x2 - x1 >= 50 OR y2 - y1 >= 50)
        AND NOT EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = l.table_id AND l.x1 BETWEEN t.x1 - 4 AND t.x2 + 4 AND l.y1 BETWEEN t.y1 - 2 AND t.y2 + 2 AND l.x2 BETWEEN t.x1 - 4 AND t.x2 + 4 AND l.y2 BETWEEN t.y1 - 2 AND t.y2 + 2)
        AND NOT EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = l.table_id AND CASE WHEN l.y1 = l.y2 THEN l.y1 > t.y1 + 4 AND l.y1 < t.y2 - 4 AND l.x1 < t.x2 AND l.x2 > t.x1 WHEN l.x1 = l.x2 THEN l.x1 > t.x1 + 4 AND l.x1 < t.x2 - 4 AND l.y1 < t.y2 AND l.y2 > t.y1 ELSE true END)""",
    ),
    "upright_line_semi": q(
        RL, "sv AS (SELECT * FROM rule_lines WHERE orient = 'v' AND x1 = 0 AND table_id % 2 = 0), st AS MATERIALIZED (SELECT * FROM rule_lines UNION ALL SELECT table_id, 'v', 450, y1, 450, y2 FROM sv UNION ALL SELECT table_id, 'h', 30, -60, 90, -60 FROM sv)",
        select="SELECT * FROM st v WHERE orient = 'v' AND EXISTS (SELECT 1 FROM st h WHERE h.orient = 'h' AND h.table_id = v.table_id AND v.x1 BETWEEN h.x1 - 2 AND h.x2 + 2 AND h.y1 BETWEEN v.y1 - 2 AND v.y2 + 2)",
    ),
    "dup_line_drop": q(
        RL, CT, "d AS (SELECT * FROM rule_lines WHERE orient = 'h' UNION ALL SELECT table_id, 'h', 5, y1 + 3, x2, y2 + 3 FROM rule_lines WHERE orient = 'h'), n AS (SELECT *, row_number() OVER w AS n, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2 FROM d WINDOW w AS (PARTITION BY table_id ORDER BY y1, x1, x2))",
        "g AS (SELECT table_id, CASE WHEN nx2 - nx1 > x2 - x1 THEN n ELSE n + 1 END AS gone FROM n WHERE ny1 - y1 <= 10 AND NOT EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = n.table_id AND t.y1 >= n.y1 AND t.y2 <= n.ny1 AND t.x1 < greatest(n.x2, n.nx2) AND t.x2 > least(n.x1, n.nx1)))",
        select="SELECT table_id, orient, x1, y1, x2, y2 FROM n WHERE (table_id, n) NOT IN (SELECT (table_id, gone) FROM g)",
    ),
    "row_separators": q(CT, islands("cell_text", "table_id", "y1", "y2", "box_id", 0, "g"), "l AS (SELECT table_id, gid AS line_id, min(y1) AS top, max(y2) AS bottom FROM g GROUP BY 1, 2), n AS (SELECT *, lead(top) OVER (PARTITION BY table_id ORDER BY line_id) AS below FROM l)", select="SELECT table_id, line_id, ((bottom + below) // 2)::INT AS y FROM n WHERE below IS NOT NULL"),
    "inferred_rows": q(
        RL, CT, islands("cell_text", "table_id", "y1", "y2", "box_id", 0, "g"), "l AS (SELECT table_id, gid AS line_id, min(y1) AS top, max(y2) AS bottom, min(x1) AS x1, max(x2) AS x2 FROM g GROUP BY 1, 2), n AS (SELECT *, lead(top) OVER (PARTITION BY table_id ORDER BY line_id) AS below FROM l)",
        select="SELECT table_id, 'h' AS orient, x1, ((bottom + below) // 2)::INT AS y1, x2, ((bottom + below) // 2)::INT AS y2 FROM n WHERE below IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rule_lines r WHERE r.table_id = n.table_id AND orient = 'h' AND r.y1 % 80 = 0 AND r.y1 BETWEEN n.bottom - 2 AND n.below + 2)",
    ),
    "extended_uprights": q(
        RL, CT, "v AS (SELECT table_id, x1, y1, x2, y2 - 15 AS y2 FROM rule_lines WHERE orient = 'v'), s AS (SELECT table_id, x1, y1, x2 FROM cell_text UNION ALL SELECT table_id, x1, y1, x2 FROM rule_lines WHERE orient = 'h')",
        select="SELECT v.table_id, v.x1, v.y1, v.x2, coalesce((SELECT min(s.y1) FROM s WHERE s.table_id = v.table_id AND s.x1 <= v.x1 AND s.x2 >= v.x1 AND s.y1 >= v.y2), v.y2) AS y2 FROM v",
    ),
    "aligned_borders": q(RL, select="SELECT table_id, orient, CASE WHEN orient = 'h' THEN CASE WHEN y1 % 12 <= 10 THEN 0 ELSE y1 % 12 END ELSE x1 END AS x1, CASE WHEN orient = 'v' AND y1 <= 10 THEN 0 ELSE y1 END AS y1, x2, y2 FROM rule_lines"),
    "implicit_columns": q(
        RL, CT, CELLS, GRID, gaps("cell_text", "table_id", "x1", "x2", 20), "e AS (SELECT table_id, x1 AS e FROM grid WHERE col_id = 0 UNION SELECT table_id, x2 FROM grid WHERE col_id = 0)",
        select="SELECT table_id, ((first + last) // 2)::INT AS x1, 0 AS y1, ((first + last) // 2)::INT AS x2, 40 AS y2 FROM gap WHERE last - first >= 20 AND NOT EXISTS (SELECT 1 FROM e WHERE e.table_id = gap.table_id AND e.e BETWEEN first AND last)",
    ),
    "consecutive_merge": q(
        "n AS (SELECT l_orderkey, count(*)::INT AS n FROM lineitem GROUP BY 1), o AS (SELECT o_custkey AS page_id, o_orderkey AS table_ord, n FROM orders JOIN n ON o_orderkey = l_orderkey)",
        "t AS (SELECT *, coalesce(sum(40 * n + 20) OVER (PARTITION BY page_id ORDER BY table_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS y1 FROM o), u AS (SELECT *, y1 + 40 * n AS y2, lag(y1 + 40 * n) OVER w AS py2, lag(n = 3) OVER w AS p3 FROM t WINDOW w AS (PARTITION BY page_id ORDER BY y1, table_ord))",
        "b AS (SELECT *, (py2 IS NULL OR p3 <> (n = 3) OR EXISTS (SELECT 1 FROM u c WHERE c.page_id = u.page_id AND c.table_ord % 5 = 0 AND c.y2 + 2 >= u.py2 AND c.y2 + 12 <= u.y1))::INT AS new FROM u)",
        select="SELECT page_id, table_ord, y1, (sum(new) OVER (PARTITION BY page_id ORDER BY y1, table_ord) - 1)::INT AS merged_id FROM b",
    ),
    "kv_table": q(
        KV, islands("kv_boxes", "conv_id", "y1", "y2", "part", 0, "g"), gaps("kv_boxes", "conv_id", "x1", "x2", 20, "pg"), gaps("g", "conv_id, gid", "x1", "x2", 20, "lg"),
        "p AS (SELECT conv_id, gid, count(*) AS n, min(centre) AS split FROM lg GROUP BY 1, 2), f AS (SELECT conv_id FROM p GROUP BY 1 HAVING max(n) = 1), ok AS (SELECT conv_id FROM f WHERE (SELECT count(*) FROM pg WHERE pg.conv_id = f.conv_id) <= 1)",
        "b AS (SELECT conv_id, min(x1) AS l, max(x2) AS r FROM kv_boxes GROUP BY 1), s AS (SELECT g.*, split, CASE WHEN split IS NOT NULL THEN x1 < split ELSE NOT (x1 - l >= (r - l) / 8 AND r - x2 < (r - l) / 8) END AS is_key FROM g JOIN ok USING (conv_id) JOIN b USING (conv_id) LEFT JOIN p USING (conv_id, gid))",
        select="SELECT conv_id, gid AS line_id, min(y1) AS y1, max(y2) AS y2, any_value(split) AS split, coalesce(string_agg(CASE WHEN is_key THEN text END, ' ' ORDER BY x1, text), '') AS key_text, coalesce(string_agg(CASE WHEN NOT is_key THEN text END, ' ' ORDER BY x1, text), '') AS value_text FROM s GROUP BY 1, 2",
    ),
    "tagged_tree_tables": q(
        TT, "k AS (SELECT *, (sum((type = 'Table')::INT) OVER w - 1)::INT AS table_ord, sum((type = 'TR')::INT) OVER w AS r FROM tagged_tree WINDOW w AS (PARTITION BY page_id ORDER BY seq))",
        select="SELECT page_id, table_ord, (r - 1)::INT AS row_id, (row_number() OVER (PARTITION BY page_id, table_ord, r ORDER BY seq) - 1)::INT AS col_id, text FROM k WHERE type = 'TD'",
    ),
    "html_blocks": q(HB, select="SELECT * FROM html_blocks"),
    "doc_markdown": q(HB, f"c AS (SELECT page_id, block_ord, {render(CANON, 'text')} AS md FROM html_blocks WHERE trim(text) <> '')", select="SELECT page_id, count(*)::INT AS n_chunks, string_agg(md || chr(10), '' ORDER BY block_ord) AS markdown FROM c WHERE md IS NOT NULL GROUP BY 1"),
    "line_texts": q(W, LT, select="SELECT * FROM line_texts"),
    "paragraph_fold": q(
        W, LT, f"p AS (SELECT *, {ENDS.format('line_text')} AS e, regexp_matches(line_text, '{LIST_TAG}') OR regexp_matches(line_text, '{BULLET}') AS tag FROM line_texts), n AS (SELECT *, (coalesce(lag(e) OVER w, false) OR (tag AND lag(e) OVER w IS NOT NULL))::INT AS new FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), r AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS para_id FROM n)",
        f"a AS (SELECT doc_id, para_id, count(*)::INT AS n_lines, string_agg(line_text, ' ' ORDER BY line_no) AS t, bool_or(e) AS e, arg_min(line_text, line_no) AS f FROM r GROUP BY 1, 2)",
        select=f"SELECT doc_id, para_id, n_lines, CASE WHEN regexp_full_match(t, '\\s*') THEN chr(10) ELSE t || CASE WHEN e THEN '' ELSE ' ' END || chr(10) || chr(10) END AS text, CASE WHEN regexp_matches(f, '{LIST_TAG}') OR regexp_matches(f, '{BULLET}') THEN regexp_extract(f, '^[ \\t]*([^ \\t]+)', 1) END AS list_tag FROM a",
    ),
    "list_tag_detect": q(
        "i AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN (turn + 1)::VARCHAR || '. ' WHEN turn % 3 = 1 THEN '• ' ELSE '' END || text AS t FROM conversations)",
        select=f"SELECT conv_id, turn, CASE WHEN regexp_matches(t, '{LIST_TAG}') OR regexp_matches(t, '{BULLET}') THEN regexp_extract(t, '^[ \\t]*([^ \\t]+)', 1) END AS list_tag, regexp_matches(t, '{LIST_TAG}') AS ordered, {ENDS.format('t')} AS ends, regexp_matches(ltrim(t), '^[A-Z0-9]') OR regexp_matches(t, '{LIST_TAG}') OR regexp_matches(t, '{BULLET}') AS begins FROM i",
    ),
    "md_escape": "SELECT conv_id, turn, " + ESC.format("text") + " AS escaped FROM conversations",
    "media_types": f"""SELECT page_id, m AS media_type, 'data:' || m || ';base64,' || to_base64(encode(url)) AS uri, url AS back
        FROM (SELECT page_id, url, {_case("lower(regexp_extract('img/' || page_id || ['.PNG', '.jpg', '.webp', '.pdf', ''][page_id % 5 + 1], '([.][^./]*)$', 1))", MEDIA_TYPES, "'image/jpeg'")} AS m FROM pages)""",
    "chunk_render": q(LO, select=f"SELECT page_id, obj_id, {render(CANON, chr(40) + chr(39) + 'obj #' + chr(39) + ' || obj_id' + chr(41))} AS md FROM layout_objects"),
    "line_geometry": q(RL, select="SELECT table_id, count(*) FILTER (WHERE y1 = y2 AND x1 <> x2) AS level, count(*) FILTER (WHERE x1 = x2 AND y1 <> y2) AS upright, sum(x2 - x1 + y2 - y1)::BIGINT AS length FROM rule_lines GROUP BY 1"),
}

_BOUNDS = "bd AS (SELECT table_id, min(x1) - 4 AS l, min(y1) - 4 AS t, max(x2) + 4 AS r, max(y2) + 4 AS m FROM cell_text GROUP BY 1)"
_SEPS = islands("cell_text", "table_id", "y1", "y2", "box_id", 0, "g") + ", sl AS (SELECT table_id, gid, min(y1) AS top, max(y2) AS bottom FROM g GROUP BY 1, 2), sn AS (SELECT *, lead(top) OVER (PARTITION BY table_id ORDER BY gid) AS below FROM sl), sp AS (SELECT table_id, ((bottom + below) // 2)::INT AS y FROM sn WHERE below IS NOT NULL)"
_TAB = "{'obj_id': obj_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
_TAB_HIT = f"len(list_filter(acc, lambda k: {_II} >= 0.1 * (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) OR {_II} >= 0.1 * (k.x2 - k.x1) * (k.y2 - k.y1)))"
_SWEEP = ORACLES["whitespace_sweep"].replace("WHERE l - 1 - reach >= 50", "WHERE l - 1 - reach >= 120")

ORACLES |= {
    "implied_lines": q(
        CT, _BOUNDS, gaps("cell_text", "table_id", "x1", "x2", 20), _SEPS,
        select="""SELECT table_id, 'h' AS orient, l AS x1, t AS y1, r AS x2, t AS y2 FROM bd UNION ALL SELECT table_id, 'h', l, m, r, m FROM bd UNION ALL SELECT table_id, 'v', l, t, l, m FROM bd UNION ALL SELECT table_id, 'v', r, t, r, m FROM bd
        UNION ALL SELECT table_id, 'v', centre, t, centre, m FROM gap JOIN bd USING (table_id) UNION ALL SELECT table_id, 'h', l, y, r, y FROM sp JOIN bd USING (table_id)""",
    ),
    "borderless_table": q(
        CT, _BOUNDS, gaps("cell_text", "table_id", "x1", "x2", 20), _SEPS,
        "xs AS (SELECT table_id, l AS a FROM bd UNION SELECT table_id, r FROM bd UNION SELECT table_id, centre FROM gap), ys AS (SELECT table_id, t AS a FROM bd UNION SELECT table_id, m FROM bd UNION SELECT table_id, y FROM sp)",
        "cx AS (SELECT table_id, a AS x1, lead(a) OVER w AS x2, (row_number() OVER w - 1)::INT AS col_id FROM xs WINDOW w AS (PARTITION BY table_id ORDER BY a)), cy AS (SELECT table_id, a AS y1, lead(a) OVER w AS y2, (row_number() OVER w - 1)::INT AS row_id FROM ys WINDOW w AS (PARTITION BY table_id ORDER BY a))",
        "gr AS (SELECT table_id, row_id, col_id, x1, y1, x2, y2 FROM cx JOIN cy USING (table_id) WHERE x2 IS NOT NULL AND y2 IS NOT NULL), st AS (SELECT table_id, list_sort(list(d)) AS ds FROM (SELECT table_id, lead(y1) OVER (PARTITION BY table_id ORDER BY row_id) - y1 AS d FROM (SELECT DISTINCT table_id, row_id, y1 FROM gr)) WHERE d IS NOT NULL GROUP BY 1)",
        "ok AS (SELECT table_id FROM gr GROUP BY 1 HAVING max(row_id) >= 1 AND max(col_id) >= 2), wd AS (SELECT table_id, 2 * median(x2 - x1) AS w2 FROM gr WHERE row_id = 0 GROUP BY 1)",
        select="SELECT gr.* FROM gr JOIN ok USING (table_id) JOIN st USING (table_id) JOIN wd USING (table_id) WHERE ds[len(ds) // 2 + 1] * 3 >= 40 AND w2 >= 48",
    ),
    "table_dedup": q(
        LO, f"g AS (SELECT page_id, list([{_TAB}] ORDER BY (x2 - x1) * (y2 - y1) DESC, obj_id) AS os FROM layout_objects GROUP BY 1), r AS (SELECT page_id, list_reduce(os, lambda acc, x: CASE WHEN {_TAB_HIT} = 0 THEN acc || x ELSE acc END) AS kept FROM g)",
        select="SELECT page_id, (pos - 1)::INT AS pos, o.obj_id FROM (SELECT page_id, unnest(kept) AS o, unnest(range(1, len(kept) + 1)) AS pos FROM r)",
    ),
    "split_regions": q(
        LO, islands("layout_objects", "page_id", "y1", "y2", "", -15, "gb"), "gc AS (SELECT * RENAME (gid AS band_id) FROM gb)", islands("gc", "page_id, band_id", "x1", "x2", "", -15, "gd"),
        "rg AS (SELECT page_id, band_id, gid AS part_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM gd GROUP BY 1, 2, 3)",
        select="SELECT * FROM rg WHERE page_id NOT IN (SELECT page_id FROM rg WHERE x2 - x1 < 72 OR y2 - y1 < 36)",
    ),
    "merged_positions": q(
        RL, CT, gaps("cell_text", "table_id", "x1", "x2", 20), "ru AS MATERIALIZED (SELECT table_id, x1 AS position, min(y1) AS y1, arg_min(y2, [y1, y2]) AS y2 FROM rule_lines WHERE orient = 'v' AND (x1 = 250 OR (x1 = 400 AND table_id % 3 = 1)) GROUP BY 1, 2), de AS (SELECT DISTINCT table_id, centre AS position FROM gap)",
        "mo AS (SELECT table_id FROM de GROUP BY 1 HAVING count(*) > coalesce((SELECT count(*) FROM ru WHERE ru.table_id = de.table_id), 0)), ev AS (SELECT *, true AS ruled FROM ru UNION ALL SELECT table_id, position, NULL, NULL, false FROM de WHERE table_id IN (SELECT table_id FROM mo) AND (table_id, position) NOT IN (SELECT (table_id, position) FROM ru))",
        "be AS MATERIALIZED (SELECT *, lag(ruled) OVER w AS lr, lag(position) OVER w AS lp, lag(y1) OVER w AS ly1, lag(y2) OVER w AS ly2, lead(ruled) OVER w AS nr, lead(position) OVER w AS np, lead(y1) OVER w AS ny1, lead(y2) OVER w AS ny2 FROM ev WINDOW w AS (PARTITION BY table_id ORDER BY position))",
        select="""SELECT table_id, position, ruled FROM be WHERE ruled OR (
          (NOT coalesce(lr, false) OR (position - lp >= 4 AND EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = be.table_id AND t.x1 >= lp AND t.x2 <= position AND t.y1 >= ly1 AND t.y2 <= ly2)))
          AND (NOT coalesce(nr, false) OR (np - position >= 4 AND EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = be.table_id AND t.x1 >= position AND t.x2 <= np AND t.y1 >= ny1 AND t.y2 <= ny2))))""",
    ),
    "snapped_uprights": q(RL, select="SELECT table_id, x1, y1, x2, y2 FROM rule_lines WHERE orient = 'v'"),
    "outer_cells": q(
        RL, CELLS, "bd AS (SELECT table_id, min(x1) AS cl, max(x2) AS cr, min(y1) AS ct, max(y2) AS cb FROM cells WHERE x1 >= 100 AND x2 <= 250 GROUP BY 1)",
        "hs AS (SELECT bd.*, r.x1, r.x2, r.y1 AS y FROM rule_lines r JOIN bd ON r.table_id = bd.table_id WHERE orient = 'h' AND r.y1 BETWEEN ct - 5 AND cb + 5)",
        "lf AS (SELECT table_id, 'left' AS side, max(x1) OVER (PARTITION BY table_id) AS a, cl AS b, y, lead(y) OVER (PARTITION BY table_id ORDER BY y) AS below FROM hs WHERE 20 * (cl - x1) >= cr - cl), rt AS (SELECT table_id, 'right' AS side, cr AS a, min(x2) OVER (PARTITION BY table_id) AS b, y, lead(y) OVER (PARTITION BY table_id ORDER BY y) AS below FROM hs WHERE 20 * (x2 - cr) >= cr - cl)",
        select="SELECT table_id, side, a AS x1, y AS y1, b AS x2, below AS y2 FROM (SELECT * FROM lf UNION ALL SELECT * FROM rt) WHERE below > y AND b > a",
    ),
    "whitespace_dedup": _SWEEP.replace(
        "SELECT page_id, min(a) AS x1, first AS y1, max(b) AS x2, last AS y2 FROM t GROUP BY page_id, first, last, run",
        """, ws AS (SELECT page_id, min(a) AS x1, first AS y1, max(b) AS x2, last AS y2 FROM t GROUP BY page_id, first, last, run), wn AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x1, y1, x2, y2) AS n FROM ws),
        wq AS (SELECT a.page_id, a.n AS an, b.n AS bn, a.y2 - a.y1 AS ha, b.y2 - b.y1 AS hb, b.x1 AS bx1, b.x2 AS bx2 FROM wn a JOIN wn b ON a.page_id = b.page_id AND a.n <> b.n AND (a.x2 = b.x1 OR b.x2 = a.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)
          WHERE NOT EXISTS (SELECT 1 FROM layout_objects e WHERE e.page_id = a.page_id AND e.x1 < greatest(a.x2, b.x2) AND e.x2 > least(a.x1, b.x1) AND e.y1 < least(a.y2, b.y2) AND e.y2 > greatest(a.y1, b.y1)))
        SELECT page_id, least(x1, coalesce((SELECT min(bx1) FROM wq WHERE wq.page_id = wn.page_id AND an = n AND ha = hb AND an < bn), x1)) AS x1, y1, greatest(x2, coalesce((SELECT max(bx2) FROM wq WHERE wq.page_id = wn.page_id AND an = n AND ha = hb AND an < bn), x2)) AS x2, y2
        FROM wn WHERE NOT EXISTS (SELECT 1 FROM wq WHERE wq.page_id = wn.page_id AND an = n AND (ha < hb OR (ha = hb AND an > bn)))""",
    ),
    "coherent_rows": q(
        RL, CT, CELLS, GRID, "ht AS (SELECT c.table_id, c.row_id, count(DISTINCT c.col_id) AS n FROM grid c WHERE c.x2 > c.x1 AND EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = c.table_id AND (t.box_id // 3 % 3 <> 0 OR t.box_id % 3 = 0) AND 2 * greatest(0, least(t.x2, c.x2) - greatest(t.x1, c.x1)) * greatest(0, least(t.y2, c.y2) - greatest(t.y1, c.y1)) >= (t.x2 - t.x1) * (t.y2 - t.y1)) GROUP BY 1, 2), sq AS (SELECT table_id, min(row_id) AS lo, max(row_id) AS hi FROM ht WHERE n >= 2 GROUP BY 1)",
        select="SELECT table_id, row_id - lo AS row_id, col_id, x1, y1, x2, y2 FROM grid JOIN sq USING (table_id) WHERE row_id BETWEEN lo AND hi",
    ),
    "raster_components": q(KV, select="SELECT conv_id, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area FROM kv_boxes WHERE x2 > x1"),
    "raster_lines": q(KV, select="SELECT conv_id, 'h' AS orient, 5 AS x1, y1 + 18 AS y1, 400 AS x2, y1 + 18 AS y2 FROM kv_boxes WHERE part = 'key'"),
}

HF = """
hf AS MATERIALIZED (SELECT table_id, orient, CASE WHEN orient = 'h' AND table_id % 2 = 0 THEN 102 ELSE x1 END AS x1, CASE WHEN orient = 'h' AND table_id % 5 = 0 AND y1 = 40 THEN 60 ELSE y1 END AS y1, x2, CASE WHEN orient = 'h' AND table_id % 5 = 0 AND y1 = 40 THEN 60 ELSE y2 END AS y2
  FROM rule_lines WHERE (orient = 'v' AND x1 > 0) OR (orient = 'h' AND y1 > 0)),
fr AS (SELECT table_id, min(x1) - 5 AS fl, min(y1) - 5 AS ft, max(x2) + 5 AS fr, max(y2) + 5 AS fb FROM rule_lines GROUP BY 1),
ro AS (SELECT fr.*, min(x1) FILTER (WHERE orient = 'v') AS rl, max(x1) FILTER (WHERE orient = 'v') AS rr, min(y1) FILTER (WHERE orient = 'h') AS rt, max(y1) FILTER (WHERE orient = 'h') AS rb FROM fr LEFT JOIN hf USING (table_id) GROUP BY ALL),
sd AS (SELECT table_id, unnest(['left', 'right', 'top', 'bottom']) AS side, unnest([rl, rr, rt, rb]) AS ruled, unnest([fl, fr, ft, fb]) AS f FROM ro),
mid AS (SELECT table_id, 'x' AS ax, x1 + x2 AS m FROM cell_text UNION ALL SELECT table_id, 'y', y1 + y2 FROM cell_text),
ed AS MATERIALIZED (SELECT table_id, side, ruled, ruled IS NULL OR EXISTS (SELECT 1 FROM mid WHERE mid.table_id = sd.table_id AND ax = CASE WHEN side IN ('left', 'right') THEN 'x' ELSE 'y' END AND m > 2 * least(ruled, f) AND m < 2 * greatest(ruled, f)) AS added, f FROM sd),
edges AS MATERIALIZED (SELECT table_id, side, ruled, CASE WHEN added THEN f ELSE ruled END AS edge, added FROM ed),
eb AS MATERIALIZED (SELECT table_id, max(edge) FILTER (WHERE side = 'left') AS el, max(edge) FILTER (WHERE side = 'top') AS et, max(edge) FILTER (WHERE side = 'right') AS er, max(edge) FILTER (WHERE side = 'bottom') AS eb FROM edges GROUP BY 1)"""
SU = """
su AS MATERIALIZED (SELECT * FROM (SELECT table_id, orient, CASE WHEN orient = 'v' AND x1 = 100 AND table_id % 5 = 0 THEN 116 ELSE x1 END AS x1, y1, CASE WHEN orient = 'v' AND x1 = 100 AND table_id % 5 = 0 THEN 116 ELSE x2 END AS x2,
  CASE WHEN orient = 'v' AND x1 IN (100, 250) THEN CASE WHEN table_id % 2 = 0 THEN least(40, y2) ELSE y2 - 3 END ELSE y2 END AS y2 FROM rule_lines) WHERE y2 > y1 OR orient = 'h')"""
MC = "mc AS MATERIALIZED (SELECT * FROM cells WHERE x1 >= 100 AND x2 <= 250), ms AS (SELECT table_id, max(x2) - min(x1) AS w, max(y2) - min(y1) AS h FROM mc GROUP BY 1)"
CL = "cl AS MATERIALIZED (SELECT l.* FROM {0} l JOIN ms USING (table_id) WHERE EXISTS (SELECT 1 FROM mc WHERE mc.table_id = l.table_id AND CASE WHEN orient = 'h' THEN 20 * least(abs(l.y1 - mc.y1), abs(l.y1 - mc.y2)) <= h ELSE 20 * least(abs(l.x1 - mc.x1), abs(l.x1 - mc.x2)) <= w END))"
CB = """
cc AS (SELECT table_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM mc GROUP BY 1),
le AS (SELECT table_id, orient, min(CASE WHEN orient = 'h' THEN x1 ELSE y1 END) AS lo, max(CASE WHEN orient = 'h' THEN x2 ELSE y2 END) AS hi FROM cl GROUP BY 1, 2),
lr AS (SELECT *, CASE WHEN orient = 'h' THEN x1 ELSE y1 END AS p, CASE WHEN orient = 'h' THEN x2 ELSE y2 END AS q, row_number() OVER (PARTITION BY table_id, orient ORDER BY CASE WHEN orient = 'h' THEN y1 ELSE x1 END, CASE WHEN orient = 'h' THEN x1 ELSE y1 END, CASE WHEN orient = 'h' THEN x2 ELSE y2 END) AS a, count(*) OVER (PARTITION BY table_id, orient) AS z FROM cl),
lf AS (SELECT le.*, (SELECT bool_and(20 * (p - lo) <= hi - lo) FROM lr WHERE lr.table_id = le.table_id AND lr.orient = le.orient AND (a = 1 OR a = z)) AS at_lo, (SELECT bool_and(20 * (hi - q) <= hi - lo) FROM lr WHERE lr.table_id = le.table_id AND lr.orient = le.orient AND (a = 1 OR a = z)) AS at_hi FROM le),
bounds AS MATERIALIZED (SELECT cc.table_id, CASE WHEN h.at_lo AND cc.x1 - h.lo > 16 THEN h.lo ELSE cc.x1 END AS x1, CASE WHEN v.at_lo AND cc.y1 - v.lo > 16 THEN v.lo ELSE cc.y1 END AS y1, CASE WHEN h.at_hi AND h.hi - cc.x2 > 16 THEN h.hi ELSE cc.x2 END AS x2, CASE WHEN v.at_hi AND v.hi - cc.y2 > 16 THEN v.hi ELSE cc.y2 END AS y2
  FROM cc LEFT JOIN lf h ON h.table_id = cc.table_id AND h.orient = 'h' LEFT JOIN lf v ON v.table_id = cc.table_id AND v.orient = 'v')"""
SL = "sl0 AS (SELECT *, max(y2) OVER (PARTITION BY table_id) AS m FROM rule_lines), sl AS MATERIALIZED (SELECT * EXCLUDE m FROM sl0 WHERE orient = 'v' OR y1 % 80 = 0 OR y1 = m)"
IR = """
bn AS (SELECT table_id, first, last, last - first + 1 AS tall FROM band), um AS (SELECT table_id, list_sort(list(tall)) AS ts FROM bn GROUP BY 1),
ir AS MATERIALIZED (SELECT bn.table_id, ((first + last) // 2)::INT AS y FROM bn JOIN um USING (table_id) WHERE 2 * tall >= CASE WHEN len(ts) >= 3 THEN ts[(len(ts) + 1) // 2] ELSE 0 END
  AND NOT EXISTS (SELECT 1 FROM sl WHERE sl.table_id = bn.table_id AND orient = 'h' AND sl.y1 BETWEEN first - 1 AND last + 1))"""
_STRAY = "sv AS (SELECT * FROM rule_lines WHERE orient = 'v' AND x1 = 0 AND table_id % 2 = 0), st AS MATERIALIZED (SELECT * FROM rule_lines UNION ALL SELECT table_id, 'v', 450, y1, 450, y2 FROM sv UNION ALL SELECT table_id, 'h', 30, -60, 90, -60 FROM sv)"
_CROSS = "EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = l.table_id AND {0})"


def _frame_step(source: str, name: str, orient: str, end: str, side: str, clash: str) -> str:
    """One side of framed_lines: the ends at the outermost ruled line go to the edge unless that is an added one behind text."""
    to = f"CASE WHEN l.orient = '{orient}' AND abs(l.{end} - e.ruled) < 4 AND NOT (e.added AND {_CROSS.format(clash)}) THEN e.edge ELSE l.{end} END"
    cols = ", ".join(f"{to} AS {c}" if c == end else f"l.{c}" for c in ("x1", "y1", "x2", "y2"))
    return f"{name} AS MATERIALIZED (SELECT l.table_id, l.orient, {cols} FROM {source} l JOIN edges e ON e.table_id = l.table_id AND e.side = '{side}')"


def _level(x1: str, x2: str) -> str:
    return f"CASE WHEN l.y1 = l.y2 THEN l.y1 > t.y1 AND l.y1 < t.y2 AND {x1} < t.x2 AND {x2} > t.x1 ELSE true END"


def _upright(y1: str, y2: str) -> str:
    return f"CASE WHEN {y1} = {y2} THEN {y1} > t.y1 AND {y1} < t.y2 AND l.x1 < t.x2 AND l.x2 > t.x1 WHEN l.x1 = l.x2 THEN l.x1 > t.x1 AND l.x1 < t.x2 AND {y1} < t.y2 AND {y2} > t.y1 ELSE true END"


_DRAW = """
vn AS MATERIALIZED (SELECT *, row_number() OVER w AS n, lag(x1) OVER w AS lx FROM su WHERE orient = 'v' WINDOW w AS (PARTITION BY table_id ORDER BY x1, y1, y2)), hy AS (SELECT DISTINCT table_id, y1 AS y FROM su WHERE orient = 'h'),
cand AS MATERIALIZED (SELECT v.*, y, least(y, y1) AS tlo, y1 AS thi, y2 AS blo, greatest(y, y2) AS bhi FROM vn v JOIN hy USING (table_id)),
up AS (SELECT table_id, n, min(y) AS y FROM cand c WHERE abs(y - y1) <= 4 OR (y < y1 AND lx < x1 AND NOT EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = c.table_id AND t.x1 + 4 < c.x1 AND t.x2 - 4 > c.x1 AND t.y1 < thi AND t.y2 > tlo)
  AND EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = c.table_id AND t.x1 >= lx AND t.x2 <= c.x1 AND t.y1 >= tlo AND t.y2 <= thi)) GROUP BY 1, 2),
dn AS (SELECT table_id, n, max(y) AS y FROM cand c WHERE abs(y - y2) <= 4 OR (y > y2 AND lx < x1 AND NOT EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = c.table_id AND t.x1 + 4 < c.x1 AND t.x2 - 4 > c.x1 AND t.y1 < bhi AND t.y2 > blo)
  AND EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = c.table_id AND t.x1 >= lx AND t.x2 <= c.x1 AND t.y1 >= blo AND t.y2 <= bhi)) GROUP BY 1, 2)"""

ORACLES |= {
    "dup_upright_drop": q(
        RL, CT, "uv AS (SELECT * FROM rule_lines WHERE orient = 'v'), d AS (SELECT * FROM uv UNION ALL SELECT table_id, orient, x1 + CASE WHEN table_id % 2 = 0 THEN 4 ELSE 30 END, y1, x1 + CASE WHEN table_id % 2 = 0 THEN 4 ELSE 30 END, y2 FROM uv)",
        "n AS MATERIALIZED (SELECT *, row_number() OVER w AS n, lead(x1) OVER w AS nx, lead(y1) OVER w AS ny1, lead(y2) OVER w AS ny2 FROM d WINDOW w AS (PARTITION BY table_id ORDER BY x1, y1, y2))",
        "g AS (SELECT table_id, CASE WHEN ny2 - ny1 > y2 - y1 THEN n ELSE n + 1 END AS gone FROM n WHERE nx - x1 <= 40 AND NOT EXISTS (SELECT 1 FROM cell_text t WHERE t.table_id = n.table_id AND t.x1 >= n.x1 AND t.x2 <= nx AND t.y1 < greatest(n.y2, ny2) AND t.y2 > least(n.y1, ny1)))",
        select="SELECT table_id, orient, x1, y1, x2, y2 FROM n WHERE (table_id, n) NOT IN (SELECT (table_id, gone) FROM g)",
    ),
    "lines_in_gaps": q(RL, CT, gaps("cell_text", "table_id", "x1", "x2", 20), _STRAY, "tl AS (SELECT table_id, min(y1) - 20 AS a, max(y2) + 20 AS b FROM cell_text GROUP BY 1)", select="SELECT * FROM st WHERE EXISTS (SELECT 1 FROM gap JOIN tl USING (table_id) WHERE gap.table_id = st.table_id AND first <= st.x1 AND st.x2 <= last AND a <= st.y1 AND st.y2 <= b)"),
    "frame_edges": q(RL, CT, HF, select="SELECT * FROM edges"),
    "added_borders": q(RL, CT, HF, select="SELECT table_id, side, CASE WHEN side IN ('left', 'right') THEN 'v' ELSE 'h' END AS orient, CASE WHEN side IN ('left', 'right') THEN edge ELSE el END AS x1, CASE WHEN side IN ('left', 'right') THEN et ELSE edge END AS y1, CASE WHEN side IN ('left', 'right') THEN edge ELSE er END AS x2, CASE WHEN side IN ('left', 'right') THEN eb ELSE edge END AS y2 FROM edges JOIN eb USING (table_id) WHERE added"),
    "framed_lines": q(
        RL, CT, HF, _frame_step("hf", "s1", "h", "x1", "left", _level("e.edge", "l.x2")), _frame_step("s1", "s2", "h", "x2", "right", _level("l.x1", "e.edge")), _frame_step("s2", "s3", "v", "y1", "top", _upright("e.edge", "l.y2")), _frame_step("s3", "s4", "v", "y2", "bottom", _upright("l.y1", "e.edge")),
        select="SELECT * FROM s4",
    ),
    "drawn_uprights": q(RL, CT, SU, _DRAW, select="SELECT v.table_id, v.x1, coalesce(up.y, v.y1) AS y1, v.x2, coalesce(dn.y, v.y2) AS y2 FROM vn v LEFT JOIN up USING (table_id, n) LEFT JOIN dn USING (table_id, n)"),
    "stretched_uprights": q(
        RL, CT, SU, "v AS MATERIALIZED (SELECT DISTINCT table_id, x1, y1, x2, y2 FROM su WHERE orient = 'v'), re AS (SELECT table_id, min(y1) AS top, max(y1) AS bottom FROM su WHERE orient = 'h' GROUP BY 1)",
        "nb AS MATERIALIZED (SELECT v.*, (SELECT min([t.y1, t.y2]) FROM cell_text t WHERE t.table_id = v.table_id AND t.x1 + 2 <= v.x1 AND t.x2 - 2 >= v.x1 AND t.y1 > v.y1) AS b, (SELECT max([t.y2, t.y1]) FROM cell_text t WHERE t.table_id = v.table_id AND t.x1 + 2 <= v.x1 AND t.x2 - 2 >= v.x1 AND t.y2 < v.y2) AS a FROM v)",
        "sb AS (SELECT *, (SELECT max(h.y1) FROM su h WHERE h.orient = 'h' AND h.table_id = nb.table_id AND h.y1 <= b[1] AND h.y1 >= nb.y2) AS hb, (SELECT min(h.y1) FROM su h WHERE h.orient = 'h' AND h.table_id = nb.table_id AND h.y1 >= a[1] AND h.y1 <= nb.y1) AS ha FROM nb)",
        select="SELECT table_id, x1, (CASE WHEN y1 > top THEN CASE WHEN a IS NULL THEN top ELSE coalesce(ha, a[1] + (a[1] - a[2]) // 2) END ELSE y1 END)::INT AS y1, x2, (CASE WHEN y2 < bottom THEN CASE WHEN b IS NULL THEN bottom ELSE coalesce(hb, b[1] - (b[2] - b[1]) // 2) END ELSE y2 END)::INT AS y2 FROM sb LEFT JOIN re USING (table_id)",
    ),
    "cluster_lines": q(RL, CELLS, MC, _STRAY, CL.format("st"), select="SELECT * FROM cl"),
    "cluster_bounds": q(RL, CELLS, MC, CL.format("rule_lines"), CB, select="SELECT * FROM bounds"),
    "semi_bordered_cells": q(
        RL, CELLS, MC, CL.format("rule_lines"), CB,
        "ev AS (SELECT table_id, x1, y1, x2, y2 FROM bounds UNION ALL SELECT table_id, x1, y1, x2, y2 FROM mc), xs AS (SELECT table_id, list_sort(list(DISTINCT e)) AS xs FROM (SELECT table_id, x1 AS e FROM ev UNION SELECT table_id, x2 FROM ev) GROUP BY 1), ys AS (SELECT table_id, list_sort(list(DISTINCT e)) AS ys FROM (SELECT table_id, y1 AS e FROM ev UNION SELECT table_id, y2 FROM ev) GROUP BY 1)",
        "sp AS (SELECT DISTINCT * FROM (SELECT b.table_id, unnest(['h', 'h', 'v', 'v']) AS o, unnest([xs[1], xs[-2], ys[1], ys[-2]]) AS a, unnest([xs[2], xs[-1], ys[2], ys[-1]]) AS b, unnest([b.y1, b.y1, b.x1, b.x1]) AS lo, unnest([b.y2, b.y2, b.x2, b.x2]) AS hi FROM bounds b JOIN xs USING (table_id) JOIN ys USING (table_id)))",
        "cu AS (SELECT s.table_id, o, a, b, CASE WHEN o = 'h' THEN l.y1 ELSE l.x1 END AS cut FROM sp s JOIN cl l ON l.table_id = s.table_id AND l.orient = o WHERE 10 * (least(CASE WHEN o = 'h' THEN l.x2 ELSE l.y2 END, b) - greatest(CASE WHEN o = 'h' THEN l.x1 ELSE l.y1 END, a)) >= 9 * (b - a) UNION SELECT table_id, o, a, b, lo FROM sp UNION SELECT table_id, o, a, b, hi FROM sp)",
        "pa AS (SELECT *, lead(cut) OVER (PARTITION BY table_id, o, a, b ORDER BY cut) AS to_ FROM cu), nw AS MATERIALIZED (SELECT DISTINCT table_id, CASE WHEN o = 'h' THEN a ELSE cut END AS x1, CASE WHEN o = 'h' THEN cut ELSE a END AS y1, CASE WHEN o = 'h' THEN b ELSE to_ END AS x2, CASE WHEN o = 'h' THEN to_ ELSE b END AS y2 FROM pa WHERE to_ > cut AND b > a)",
        "fx AS MATERIALIZED (SELECT * FROM nw a WHERE NOT EXISTS (SELECT 1 FROM mc b WHERE b.table_id = a.table_id AND " + _I + " >= 0.5 * least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1))))",
        select="SELECT * FROM fx a WHERE NOT EXISTS (SELECT 1 FROM fx b WHERE b.table_id = a.table_id AND (a.x1, a.y1, a.x2, a.y2) <> (b.x1, b.y1, b.x2, b.y2) AND (a.x2 - a.x1) * (a.y2 - a.y1) <= (b.x2 - b.x1) * (b.y2 - b.y1) AND " + _I + " >= 0.5 * least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)))",
    ),
    "implicit_rows": q(RL, CT, gaps("cell_text", "table_id", "y1", "y2", 1, "band"), SL, IR, "fm AS (SELECT table_id, min(x1) - 5 AS x1, max(x2) + 5 AS x2 FROM rule_lines GROUP BY 1)", select="SELECT table_id, 'h' AS orient, x1, y AS y1, x2, y AS y2 FROM ir JOIN fm USING (table_id)"),
    "implicit_grid": q(
        RL, CT, gaps("cell_text", "table_id", "y1", "y2", 1, "band"), SL, IR, "fm AS (SELECT table_id, min(x1) AS x1, max(x2) AS x2 FROM sl GROUP BY 1), drawn AS MATERIALIZED (SELECT * FROM sl UNION ALL SELECT table_id, 'h', x1, y, x2, y FROM ir JOIN fm USING (table_id))",
        CELLS.replace("FROM rule_lines", "FROM drawn"), GRID, select="SELECT * FROM grid",
    ),
}

_PICTURES = "CASE WHEN {0} = 'Picture' THEN true WHEN {0} = 'Unknown' THEN false ELSE NOT EXISTS (SELECT 1 FROM te t WHERE t.page_id = c.page_id AND t.obj_id <> c.obj_id AND {1}) END"

ORACLES |= {
    "structure_text": q(
        N, "cl AS (SELECT l_orderkey AS page_id, 12 * (ord - 1) AS b, l_partkey::VARCHAR AS p, l_suppkey::VARCHAR AS s, CAST(trunc(l_quantity) AS INT)::VARCHAR AS q, l_returnflag AS f FROM nl)",
        select="SELECT page_id, (b + k)::INT AS seq, t AS text FROM (SELECT page_id, b, unnest([2, 5, 10, 12]) AS k, unnest([p || chr(10), 'a ' || s || chr(10) || q || chr(10), f, '']) AS t FROM cl)",
    ),
    "element_join": q(
        "i AS (SELECT conv_id, turn, turn // 2 AS line, CASE WHEN turn % 3 = 0 THEN (turn + 1)::VARCHAR || '. ' WHEN turn % 3 = 1 THEN '• ' ELSE '' END || coalesce(text, '') AS t FROM conversations), j AS (SELECT *, lag(t) OVER w AS pt, lag(line) OVER w AS pl FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY turn))",
        f"k AS (SELECT conv_id, turn, CASE WHEN (regexp_matches(t, '{LIST_TAG}') OR regexp_matches(t, '{BULLET}')) AND (pt IS NULL OR pl <> line) THEN chr(10) || chr(10) || '- ' || regexp_replace(t, '^[ \\t]*[^ \\t]+', '') WHEN pt IS NOT NULL AND pl <> line AND NOT regexp_matches(pt, '[ \\n]$') THEN ' ' || t ELSE t END AS part FROM j)",
        select="SELECT conv_id, string_agg(part, '' ORDER BY turn) AS text FROM k GROUP BY 1",
    ),
    "text_elements": q(LO, select=f"SELECT page_id, obj_id, x1, y1, x2, y2 FROM layout_objects WHERE {CANON} NOT IN ('Picture', 'Chart', 'isolate_formula', 'Unknown')"),
    "picture_chunks": q(
        LO, f"cn AS MATERIALIZED (SELECT *, {CANON} AS canon FROM layout_objects), te AS (SELECT * FROM cn WHERE canon NOT IN ('Picture', 'Chart', 'isolate_formula', 'Unknown'))",
        f"sh AS (SELECT *, {_PICTURES.format('canon', INSIDE.format(0.7))} AS shown FROM cn c)",
        select="SELECT page_id, obj_id, least(greatest(x1, 0), 800) AS x1, least(greatest(y1, 0), 1000) AS y1, least(greatest(x2 + 4, 0), 800) AS x2, least(greatest(y2, 0), 1000) AS y2, '![](img/' || page_id || '-' || obj_id || '.png)' || chr(10) || chr(10) AS md FROM sh WHERE shown",
    ),
    "page_html": q(
        RL, CT, CELLS, GRID, SPANS, FILLED, f"hr AS (SELECT table_id, row_id, '<tr>' || {_ROW(_HTML_CELL(chr(39) + 'td' + chr(39)), '')} || '</tr>' AS line FROM filled GROUP BY 1, 2), ht AS (SELECT table_id, string_agg(line, '' ORDER BY row_id) AS rows FROM hr GROUP BY 1), fc AS (SELECT table_id, arg_min(y1, [row_id, col_id]) AS top FROM filled GROUP BY 1)",
        "pg AS (SELECT o_custkey AS page_id, table_id, top + table_id % 7 * 1000 AS top, '<table><caption>Order ' || o_orderstatus || '</caption>' || rows || '</table>' AS html FROM ht JOIN fc USING (table_id) JOIN orders ON o_orderkey = table_id)",
        select="SELECT page_id, '<html><head><meta charset=\"utf-8\"><meta pageNo=\"1\"></head><body>' || string_agg(html, '' ORDER BY top, table_id) || '</body></html>' AS html FROM pg GROUP BY 1",
    ),
}


PT = (
    CT
    + """,
page_texts AS MATERIALIZED (
  SELECT table_id, box_id, x1, (y1 + CASE WHEN box_id // 3 > 4 THEN 60 ELSE 0 END)::INT AS y1, x2, (y2 + CASE WHEN box_id // 3 > 4 THEN 60 ELSE 0 END)::INT AS y2 FROM cell_text WHERE table_id % 4 <> 0 OR box_id % 3 <> 1 OR box_id < 9
  UNION ALL SELECT DISTINCT table_id, -1, 5, -60, 330, -40 FROM cell_text WHERE table_id % 2 = 0
  UNION ALL SELECT table_id, -2, 5, (max(y2) + 90)::INT, 300, (max(y2) + 110)::INT FROM cell_text WHERE table_id % 3 = 0 GROUP BY 1)"""
)
XT = (
    N
    + """,
column_texts AS MATERIALIZED (
  SELECT l_orderkey AS table_id, (3 * ord + k)::INT AS box_id, (200 * k)::INT AS x1, (30 * (ord - 1))::INT AS y1, (150 + 200 * k + CASE WHEN k = 1 AND l_orderkey % 3 = 0 THEN 60 ELSE 0 END)::INT AS x2, (30 * ord - 10)::INT AS y2 FROM nl, (VALUES (0), (1)) AS v(k)
  UNION ALL SELECT l_orderkey, (3 * ord + 2)::INT, 20, -50, 330, -30 FROM nl WHERE ord = 1 AND l_orderkey % 2 = 0)"""
)


def hull_sql(source: str, name: str, margin: int = 10) -> str:
    return f"{name} AS MATERIALIZED (SELECT table_id, min(x1) - {margin} AS x1, min(y1) - {margin} AS y1, max(x2) + {margin} AS x2, max(y2) + {margin} AS y2 FROM {source} GROUP BY 1)"


def blanks_sql(e: str, b: str, keys: str, wide: int, tall: str, share: float, name: str, level: bool = False) -> str:
    """Upright blanks of elements ``e`` in bounds ``b``; ``tall`` may name a column of the bounds."""
    k, x, y = keys.split(", "), *(("y", "x") if level else ("x", "y"))
    on = lambda p, r: " AND ".join(f"{p}.{c} = {r}.{c}" for c in k)
    box_ = lambda r: f"{r}.{x}1 AS x1, {r}.{y}1 AS y1, {r}.{x}2 AS x2, {r}.{y}2 AS y2"
    cols = ", ".join(f"e.{c}" for c in k)
    out = f"min(a) AS {x}1, top AS {y}1, max(b) AS {x}2, y1 AS {y}2"
    return f"""
{name}_e AS MATERIALIZED (SELECT {cols}, {box_("e")} FROM {e} e), {name}_b AS MATERIALIZED (SELECT {cols.replace("e.", "b.")}, {box_("b")}, {tall} AS tall, (SELECT min(y1) FROM {name}_e e WHERE {on("e", "b")}) AS lo, (SELECT max(y2) FROM {name}_e e WHERE {on("e", "b")}) AS hi FROM {b} b),
{name}_v AS MATERIALIZED (SELECT {keys}, x1, y1, x2, y2 FROM {name}_e UNION ALL SELECT {keys}, x1, lo, x2, lo FROM {name}_b WHERE lo IS NOT NULL UNION ALL SELECT {keys}, x1, hi, x2, hi FROM {name}_b WHERE lo IS NOT NULL),
{name}_d AS (SELECT {keys}, x1 AS a FROM {name}_v UNION SELECT {keys}, x2 FROM {name}_v), {name}_s AS MATERIALIZED (SELECT * FROM (SELECT {keys}, a, lead(a) OVER (PARTITION BY {keys} ORDER BY a) AS b FROM {name}_d) WHERE b - a >= {wide}),
{name}_m AS MATERIALIZED (SELECT {cols}, s.a, s.b, e.x1, e.x2, e.y1, e.y2 FROM {name}_v e JOIN {name}_s s ON {on("e", "s")}), {name}_n AS (SELECT {keys}, a, b, y1, max(y2) AS y2 FROM {name}_m WHERE x1 < b AND x2 > a GROUP BY {keys}, a, b, y1),
{name}_g AS MATERIALIZED (SELECT * FROM (SELECT *, max(y2) OVER (PARTITION BY {keys}, a, b ORDER BY y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {name}_n) WHERE top IS NOT NULL AND y1 > top),
{name}_f AS (SELECT e.* FROM {name}_g e JOIN {name}_b b ON {on("e", "b")} WHERE e.y1 - e.top >= b.tall AND 100 * (e.y1 - e.top) >= {round(100 * share)} * (b.hi - b.lo)),
{name}_r AS (SELECT *, sum(new) OVER (PARTITION BY {keys}, top, y1 ORDER BY a) AS run FROM (SELECT *, coalesce((lag(b) OVER (PARTITION BY {keys}, top, y1 ORDER BY a) <> a)::INT, 0) AS new FROM {name}_f)),
{name} AS MATERIALIZED (SELECT {keys}, {out} FROM {name}_r GROUP BY {keys}, top, y1, run)"""


def column_blanks_sql(e: str, b: str, keys: str, wide: int, tall: str, share: float, name: str) -> str:
    k = keys.split(", ")
    on = lambda p, r: " AND ".join(f"{p}.{c} = {r}.{c}" for c in k)
    return f"""{blanks_sql(e, b, keys, wide, tall, share, name + "0")},
{name}1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x1, y1, x2, y2) AS n FROM {name}0 a WHERE NOT EXISTS (SELECT 1 FROM {name}0 b WHERE {on("a", "b")} AND (a.x1 = b.x1 OR a.x1 = b.x2 OR a.x2 = b.x1 OR a.x2 = b.x2) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) AND a.y2 - a.y1 < b.y2 - b.y1)),
{name}2 AS MATERIALIZED (SELECT {", ".join("a." + c for c in k)}, a.n AS an, b.n AS bn, a.y2 - a.y1 AS ha, b.y2 - b.y1 AS hb, b.x1 AS bx1, b.x2 AS bx2 FROM {name}1 a JOIN {name}1 b ON {on("a", "b")} WHERE a.n <> b.n AND (a.x2 = b.x1 OR b.x2 = a.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)
  AND NOT EXISTS (SELECT 1 FROM {e} e WHERE {on("e", "a")} AND e.x1 < greatest(a.x2, b.x2) AND e.x2 > least(a.x1, b.x1) AND e.y1 < least(a.y2, b.y2) AND e.y2 > greatest(a.y1, b.y1))),
{name} AS MATERIALIZED (SELECT {keys}, least(x1, coalesce((SELECT min(bx1) FROM {name}2 q WHERE {on("q", "w")} AND an = n AND ha = hb AND an < bn), x1)) AS x1, y1, greatest(x2, coalesce((SELECT max(bx2) FROM {name}2 q WHERE {on("q", "w")} AND an = n AND ha = hb AND an < bn), x2)) AS x2, y2
  FROM {name}1 w WHERE NOT EXISTS (SELECT 1 FROM {name}2 q WHERE {on("q", "w")} AND an = n AND (ha < hb OR (ha = hb AND an > bn))))"""


_PH = hull_sql("page_texts", "bounds")
_AREAS = (
    islands("page_texts", "table_id", "y1", "y2", "", -29, "ai")
    + """,
ae AS MATERIALIZED (SELECT ai.table_id, ai.gid AS area_id, ai.x1, ai.y1, ai.x2, ai.y2, greatest(min(ai.x1) OVER (PARTITION BY table_id) - 8, 0) AS ax1, min(ai.y1) OVER (PARTITION BY table_id, ai.gid) AS ay1, least(max(ai.x2) OVER (PARTITION BY table_id) + 8, bounds.x2) AS ax2, max(ai.y2) OVER (PARTITION BY table_id, ai.gid) AS ay2 FROM ai JOIN bounds USING (table_id))"""
)
_AREA_BLANKS = (
    "ab AS MATERIALIZED (SELECT table_id, area_id, any_value(ax1) AS x1, any_value(ay1) AS y1, any_value(ax2) AS x2, any_value(ay2) AS y2, min(x1) AS l, max(x2) AS r FROM ae GROUP BY 1, 2), "
    + column_blanks_sql("ae", "ab", "table_id, area_id", 8, "least(40, b.y2 - b.y1)", 0.66, "aw").strip()
    + """,
am AS MATERIALIZED (SELECT w.*, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, l, r, w.x1 <> b.x1 AND w.x2 <> b.x2 AS inn FROM aw w JOIN ab b USING (table_id, area_id)), tm AS (SELECT table_id, area_id, max(y2 - y1) AS t FROM am WHERE inn GROUP BY 1, 2),
ak AS MATERIALIZED (SELECT table_id, area_id, x1, y1, x2, y2, y1 = by1 AS top, y2 = by2 AS bottom FROM am JOIN tm USING (table_id, area_id) WHERE 10 * (least(x2, l) - greatest(x1, bx1)) < x2 - x1 AND 10 * (least(x2, bx2) - greatest(x1, r)) < x2 - x1 AND (y1 = by1 OR y2 = by2 OR 100 * (y2 - y1) >= 66 * t)
  UNION ALL SELECT table_id, area_id, x1, y1, l, y2, true, true FROM ab JOIN tm USING (table_id, area_id) UNION ALL SELECT table_id, area_id, r, y1, x2, y2, true, true FROM ab JOIN tm USING (table_id, area_id))"""
)


def _seam(side: str, shift: int, name: str) -> str:
    return islands(f"(SELECT table_id, area_id, x1, x2 FROM ak WHERE {side})", "table_id, area_id", "x1", "x2", "", 0, f"{name}i") + f""",
{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY table_id, area_id ORDER BY first) AS n, count(*) OVER (PARTITION BY table_id, area_id) AS z FROM (SELECT table_id, area_id + {shift} AS area_id, min(x1) AS first, max(x2) AS last FROM {name}i GROUP BY table_id, {name}i.area_id, gid))"""


def _share(one: str, other: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT table_id, area_id, count(*) FILTER (WHERE m = 1) AS fit, count(*) AS of_ FROM (SELECT a.table_id, a.area_id, (SELECT count(*) FROM {other} b WHERE b.table_id = a.table_id AND b.area_id = a.area_id AND 2 * (least(a.last, b.last) - greatest(a.first, b.first)) >= 8) AS m FROM {one} a WHERE n > 1 AND n < z) GROUP BY 1, 2)"


_XH = hull_sql("column_texts", "bounds")
_COLUMN_BLANKS = (
    blanks_sql("column_texts", "bounds", "table_id", 0, "1", 0.5, "tb0").strip()
    + """,
hl AS (SELECT table_id, 140 AS x1, 260 AS x2, 5 AS y FROM bounds WHERE table_id % 5 = 0),
tb1 AS MATERIALIZED (SELECT w.*, b.y1 AS by1, b.y2 AS by2, (SELECT list(DISTINCT y) FROM hl WHERE hl.table_id = w.table_id AND y > w.y1 AND y < w.y2 AND 2 * (least(w.x2, hl.x2) - greatest(w.x1, hl.x1)) >= w.x2 - w.x1) AS c FROM tb0 w JOIN bounds b USING (table_id) WHERE w.x2 - w.x1 >= 8 OR w.x1 = b.x1 OR w.x2 = b.x2),
tb2 AS (SELECT *, list_sort(list_concat([y1, y2], coalesce(c, []))) AS ys FROM tb1), tb3 AS (SELECT *, unnest(range(1, len(ys))) AS i FROM tb2),
tb4 AS MATERIALIZED (SELECT table_id, x1, ys[i] AS y1, x2, ys[i + 1] AS y2, row_number() OVER (PARTITION BY table_id ORDER BY x1 + x2, x1, ys[i]) AS n FROM tb3 WHERE c IS NULL OR 2 * (ys[i + 1] - ys[i]) >= by2 - by1),
tb5 AS MATERIALIZED (SELECT *, lag(x2) OVER w AS px2, lag(y1) OVER w AS py1, lag(y2) OVER w AS py2 FROM tb4 WINDOW w AS (PARTITION BY table_id ORDER BY n)),
tb6 AS (SELECT *, EXISTS (SELECT 1 FROM column_texts e WHERE e.table_id = t.table_id AND e.x1 >= least(px2, t.x1) AND e.x2 <= greatest(px2, t.x1) AND e.y1 >= greatest(py1, t.y1) AND e.y2 <= least(py2, t.y2))::INT AS new FROM tb5 t), tb7 AS (SELECT *, sum(new) OVER (PARTITION BY table_id ORDER BY n) AS g FROM tb6),
tcb AS MATERIALIZED (SELECT table_id, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY table_id, g ORDER BY y2 - y1 DESC, x2 - x1 DESC, n DESC) AS k FROM tb7) WHERE k = 1)"""
)
_COLUMN_GROUPS = """
gm AS MATERIALIZED (SELECT t.*, t.x1 = b.x1 OR t.x2 = b.x2 OR t.x1 = b.x2 OR t.x2 = b.x1 AS edge FROM tcb t JOIN bounds b USING (table_id)), gs AS (SELECT table_id, x1, y1, x2, y2, 'top' AS side, y1 AS pos FROM gm WHERE NOT edge UNION ALL SELECT table_id, x1, y1, x2, y2, 'bottom', y2 FROM gm WHERE NOT edge),
gn AS (SELECT *, coalesce((20 * (pos - lag(pos) OVER w) > greatest(y2 - y1, lag(y2 - y1) OVER w))::INT, 0) AS new FROM gs WINDOW w AS (PARTITION BY table_id, side ORDER BY pos, x1)), gg AS MATERIALIZED (SELECT *, (sum(new) OVER (PARTITION BY table_id, side ORDER BY pos, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INT AS group_id FROM gn),
ga AS MATERIALIZED (SELECT table_id, side, group_id, x1, y1, x2, y2 FROM gg UNION ALL SELECT k.table_id, k.side, k.group_id, e.x1, e.y1, e.x2, e.y2 FROM (SELECT DISTINCT table_id, side, group_id FROM gg) k JOIN gm e ON e.table_id = k.table_id AND e.edge),
gw AS (SELECT *, lead(x1) OVER (PARTITION BY table_id, side, group_id ORDER BY x1 + x2, x1, y1) - x2 AS w FROM ga), gf AS (SELECT table_id, side, group_id, min(y1) AS g1, max(y2) AS g2 FROM gw GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 3 AND 4 AND 4 * max(w) <= 5 * min(w)),
gr AS MATERIALIZED (SELECT ga.* FROM ga JOIN gf USING (table_id, side, group_id) WHERE NOT EXISTS (SELECT 1 FROM gm o WHERE o.table_id = gf.table_id AND NOT edge AND 5 * (least(o.y2, g2) - greatest(o.y1, g1)) > o.y2 - o.y1
  AND NOT EXISTS (SELECT 1 FROM gg WHERE gg.table_id = gf.table_id AND gg.side = gf.side AND gg.group_id = gf.group_id AND (gg.x1, gg.y1, gg.x2, gg.y2) = (o.x1, o.y1, o.x2, o.y2))))"""

ORACLES |= {
    "upright_blanks": q(PT, _PH, blanks_sql("page_texts", "bounds", "table_id", 8, "20", 0.25, "w"), select="SELECT * FROM w"),
    "level_blanks": q(PT, _PH, blanks_sql("page_texts", "bounds", "table_id", 1, "1", 0.66, "w", level=True), select="SELECT * FROM w"),
    "column_blanks": q(PT, _PH, column_blanks_sql("page_texts", "bounds", "table_id", 8, "20", 0.25, "w"), select="SELECT * FROM w"),
    "page_areas": q(PT, _PH, _AREAS, select="SELECT table_id, area_id, any_value(ax1) AS x1, any_value(ay1) AS y1, any_value(ax2) AS x2, any_value(ay2) AS y2, count(*) AS n FROM ae GROUP BY 1, 2"),
    "area_blanks": q(PT, _PH, _AREAS, _AREA_BLANKS, select="SELECT * FROM ak"),
    "area_chains": q(
        PT, _PH, _AREAS, _AREA_BLANKS, _seam("bottom", 1, "us"), _seam("top", 0, "ds"), _share("us", "ds", "uf"), _share("ds", "us", "df"),
        "an AS (SELECT table_id, area_id, ab.y1, ab.y2, count(*) AS n_blanks FROM ab JOIN ak USING (table_id, area_id) GROUP BY ALL), ag AS (SELECT *, CASE WHEN lag(area_id) OVER w = area_id - 1 THEN y1 - lag(y2) OVER w END AS gap FROM an WINDOW w AS (PARTITION BY table_id ORDER BY area_id))",
        "uz AS (SELECT DISTINCT table_id, area_id, z AS u FROM us), dz AS (SELECT DISTINCT table_id, area_id, z AS d FROM ds), ah AS (SELECT ag.*, u, d, CASE WHEN u >= d THEN uf.fit ELSE df.fit END AS fit, CASE WHEN u >= d THEN uf.of_ ELSE df.of_ END AS of_ FROM ag LEFT JOIN uz USING (table_id, area_id) LEFT JOIN dz USING (table_id, area_id) LEFT JOIN uf USING (table_id, area_id) LEFT JOIN df USING (table_id, area_id))",
        "ai2 AS (SELECT *, (NOT coalesce(2 * gap <= 200 AND 100 * fit >= of_ * CASE WHEN least(u, d) < 4 THEN 100 WHEN gap < 40 THEN 66 ELSE 80 END AND u IS NOT NULL AND d IS NOT NULL, false))::INT AS new FROM ah), aj AS (SELECT *, (sum(new) OVER (PARTITION BY table_id ORDER BY area_id) - 1)::INT AS segment_id FROM ai2)",
        select="SELECT table_id, area_id, y1, y2, n_blanks, segment_id FROM (SELECT *, max(n_blanks) OVER (PARTITION BY table_id, segment_id) AS most FROM aj) WHERE most > 3",
    ),
    "row_delimiters": q(
        PT, _PH, blanks_sql("page_texts", "bounds", "table_id", 0, "1", 0.66, "w", level=True),
        "fu AS (SELECT table_id, list_sort(list(y2 - y1)) AS ts FROM (SELECT *, max(x2 - x1) OVER (PARTITION BY table_id) AS m FROM w) WHERE x2 - x1 = m GROUP BY 1), te AS MATERIALIZED (SELECT w.* FROM w LEFT JOIN fu USING (table_id) WHERE 2 * (y2 - y1) >= CASE WHEN len(ts) >= 3 THEN ts[(len(ts) + 1) // 2] ELSE 2 END)",
        "kd AS (SELECT a.table_id, a.x1, ((a.y1 + a.y2) // 2)::INT AS y, a.x2 FROM te a JOIN bounds b USING (table_id) WHERE a.y1 <> b.y1 AND a.y2 <> b.y2 AND NOT EXISTS (SELECT 1 FROM te c WHERE c.table_id = a.table_id AND (a.y1 = c.y1 OR a.y1 = c.y2 OR a.y2 = c.y1 OR a.y2 = c.y2) AND a.x2 - a.x1 < c.x2 - c.x1))",
        "eh AS (SELECT table_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM page_texts GROUP BY 1), ev AS (SELECT * FROM kd UNION SELECT table_id, x1, y1, x2 FROM eh UNION SELECT table_id, x1, y2, x2 FROM eh), en AS MATERIALIZED (SELECT * FROM (SELECT *, min(x1) OVER w AS lo, max(x2) OVER w AS hi, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY table_id)) WHERE n >= 3)",
        select="""SELECT table_id, greatest(coalesce((SELECT max(e.x2) FROM page_texts e WHERE e.table_id = en.table_id AND e.y1 + (e.y2 - e.y1) // 6 < y AND y < e.y2 - (e.y2 - e.y1) // 6 AND least(e.x2, en.x1) > greatest(e.x1, lo)), lo), lo) AS x1, y AS y1,
          least(coalesce((SELECT min(e.x1) FROM page_texts e WHERE e.table_id = en.table_id AND e.y1 + (e.y2 - e.y1) // 6 < y AND y < e.y2 - (e.y2 - e.y1) // 6 AND least(e.x2, hi) > greatest(e.x1, en.x2)), hi), hi) AS x2, y AS y2 FROM en""",
    ),
    "text_column_blanks": q(XT, _XH, _COLUMN_BLANKS, select="SELECT * FROM tcb"),
    "column_groups": q(XT, _XH, _COLUMN_BLANKS, _COLUMN_GROUPS, select="SELECT * FROM gr"),
    "column_segments": q(XT, _XH, _COLUMN_BLANKS, _COLUMN_GROUPS, "sg AS (SELECT *, ((x1 + x2) // 2)::INT AS m, lead((x1 + x2) // 2) OVER w AS nx, lead(y1) OVER w AS n1, lead(y2) OVER w AS n2 FROM gr WINDOW w AS (PARTITION BY table_id, side, group_id ORDER BY x1 + x2, x1, y1))", select="SELECT table_id, side, group_id, m AS x1, greatest(y1, n1) AS y1, nx::INT AS x2, least(y2, n2) AS y2 FROM sg WHERE nx IS NOT NULL AND least(y2, n2) > greatest(y1, n1)"),
}


GL = (
    CT
    + """,
gc AS (SELECT table_id, box_id, x1, y1, unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, ''))))::INT AS i FROM cell_text),
gd AS (SELECT *, ascii(c) AS a, x1 + 8 * i AS at_ FROM gc),
ge AS (SELECT table_id, 'char' AS kind, 100 * box_id + 2 * i AS glyph_id, at_ AS x1, y1, at_ + a % 3 + 5 AS x2, y1 + a % 4 + 11 AS y2, (a % 3 + 5) * (a % 4 + 11) - a % 7 AS area FROM gd
  UNION ALL SELECT table_id, 'speck', 100 * box_id + 2 * i + 1, at_ + a % 3 + 6, y1 + 9, at_ + a % 3 + 7, y1 + 11, 2 FROM gd WHERE i % 2 = 0
  UNION ALL SELECT table_id, 'dash', -k - 1, 20 * k, -20 + k % 2, 20 * k + 14, -17 + k % 2, 42 FROM (SELECT DISTINCT table_id FROM cell_text WHERE table_id % 3 = 0), range(8) AS r(k)
  UNION ALL SELECT table_id, 'dash', -k - 21, -30, 12 * k, -28, 12 * k + 9, 18 FROM (SELECT DISTINCT table_id FROM cell_text WHERE table_id % 5 = 0), range(6) AS r(k)),
glyphs AS MATERIALIZED (SELECT table_id, kind, glyph_id::INT AS glyph_id, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2, area::INT AS area FROM ge)"""
)
_DOTTED = """
dh AS (SELECT table_id, x1, y1, x2, y2, 'h' AS orient, x2 - x1 AS l, floor((y1 + y2) / 2)::INT AS m FROM glyphs WHERE x2 - x1 >= 2 * (y2 - y1) UNION ALL SELECT table_id, x1, y1, x2, y2, 'v', y2 - y1, floor((x1 + x2) / 2)::INT FROM glyphs WHERE y2 - y1 >= 2 * (x2 - x1)),
dn AS (SELECT *, coalesce((m - lag(m) OVER (PARTITION BY table_id, orient ORDER BY m) > 2)::INT, 0) AS new FROM dh), dr AS (SELECT *, sum(new) OVER (PARTITION BY table_id, orient ORDER BY m) AS r FROM dn),
dotted AS MATERIALIZED (SELECT table_id, orient, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM dr GROUP BY table_id, orient, r HAVING count(*) >= 5 AND 100 * sum(l) >= 66 * greatest(CASE WHEN orient = 'h' THEN max(x2) - min(x1) ELSE max(y2) - min(y1) END, 1))"""

ORACLES |= {
    "element_boxes": q(GL, select="SELECT table_id, glyph_id FROM glyphs WHERE (2 * least(x2 - x1, y2 - y1) >= 12 AND greatest(x2 - x1, y2 - y1) >= 12) OR (x2 - x1 >= 2 * (y2 - y1) AND x2 - x1 >= 12)"),
    "noise_drop": q(
        GL, "gs AS (SELECT table_id, avg(y2 - y1) AS h, median(x2 - x1) AS w FROM glyphs GROUP BY 1)",
        select="SELECT table_id, glyph_id FROM glyphs JOIN gs USING (table_id) WHERE (x2 - x1 >= 2 * (y2 - y1) AND 2 * (x2 - x1) >= w AND 2 * (x2 - x1) <= 3 * w) OR NOT (3 * (y2 - y1) < h OR 100 * area < 8 * (x2 - x1) * (y2 - y1))",
    ),
    "dotted_lines": q(GL, _DOTTED, select="SELECT * FROM dotted"),
    "dotted_drop": q(GL, _DOTTED, select=f"SELECT table_id, glyph_id FROM glyphs a WHERE NOT EXISTS (SELECT 1 FROM dotted b WHERE b.table_id = a.table_id AND 4 * ({_I}) >= (a.x2 - a.x1) * (a.y2 - a.y1))"),
    "near_pieces": q(
        GL, select="""SELECT table_id, glyph_id FROM glyphs a WHERE kind <> 'char' AND EXISTS (SELECT 1 FROM glyphs b WHERE b.table_id = a.table_id AND b.kind = 'char' AND b.x1 < 200 AND least(a.y2, b.y2) > greatest(a.y1, b.y1) AND 2 * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) >= least(a.y2 - a.y1, b.y2 - b.y1)
          AND greatest(a.x2 - a.x1, a.y2 - a.y1) <= 3 * greatest(b.x2 - b.x1, b.y2 - b.y1) AND least(abs(a.x1 - b.x1), abs(a.x1 - b.x2), abs(a.x2 - b.x1), abs(a.x2 - b.x2)) <= 8)""",
    ),
    "refit_boxes": q(GL, select=f"SELECT a.table_id, a.box_id, min(b.x1) AS x1, min(b.y1) AS y1, max(b.x2) AS x2, max(b.y2) AS y2 FROM cell_text a JOIN glyphs b ON a.table_id = b.table_id AND b.kind = 'char' WHERE 2 * ({_I}) >= (b.x2 - b.x1) * (b.y2 - b.y1) GROUP BY 1, 2"),
}
