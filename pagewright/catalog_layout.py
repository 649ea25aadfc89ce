"""Queries of page layout: furniture, typography, titles and geometry over ``sources.layout_lines``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import sources
from .functions import lines as L
from .operators import furniture, typography
from .registry import query

WIDTH, HEIGHT = sources.SHEET
_MASK = "regexp_replace(lower(text), '[0-9]+', '#', 'g')"
_FOLIO = "regexp_matches(trim(text), '^[0-9]+(-[0-9]+)?$')"

_CANDIDATES_SQL = (
    sources.LAYOUT_SQL
    + f""",
cd AS (SELECT doc_id, page_no, row_no, text, size, {_MASK} AS signature, (y + h / 2) / {HEIGHT} AS position, {_FOLIO} AS folio, CASE WHEN {_FOLIO} THEN y / {HEIGHT} ELSE (y + h / 2) / {HEIGHT} END AS foot FROM layout_lines),
candidates AS (SELECT doc_id, page_no, row_no, CASE WHEN position >= 0.90 THEN 'top' ELSE 'bottom' END AS edge, signature, position, size, folio FROM cd WHERE (position >= 0.90 OR foot <= 0.07) AND length(text) < 100 AND regexp_matches(text, '[^{L.WS}]'))"""
)


@query(f"WITH {_CANDIDATES_SQL} SELECT doc_id, page_no, row_no, edge, signature, round(position, 9) AS position, size, folio FROM candidates")
def furniture_candidates(spark, sf_dir):
    return furniture.candidates(sources.layout_lines(spark, sf_dir), HEIGHT).withColumn("position", F.round("position", 9))


_PLAN_SQL = (
    "RECURSIVE "
    + _CANDIDATES_SQL
    + """,
ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id, edge, signature ORDER BY page_no, row_no) AS k FROM candidates),
fold AS (SELECT doc_id, edge, signature, k, page_no, row_no, position AS p0, size AS s0, folio AS f0, 1 AS run FROM ord WHERE k = 1
  UNION ALL SELECT o.doc_id, o.edge, o.signature, o.k, o.page_no, o.row_no, CASE WHEN g.on THEN g.p0 ELSE o.position END, CASE WHEN g.on THEN g.s0 ELSE o.size END, CASE WHEN g.on THEN g.f0 ELSE o.folio END, CASE WHEN g.on THEN g.run ELSE g.run + 1 END
  FROM (SELECT f.*, o.page_no - f.page_no BETWEEN 1 AND 2 AND abs(o.position - f.p0) <= CASE WHEN f.f0 AND o.folio THEN 0.04 ELSE 0.004 END AND abs(o.size - f.s0) <= greatest(0.5, f.s0 * CASE WHEN f.f0 AND o.folio THEN 0.25 ELSE 0.1 END) AS on
    FROM fold f JOIN ord o ON o.doc_id IS NOT DISTINCT FROM f.doc_id AND o.edge = f.edge AND o.signature = f.signature AND o.k = f.k + 1) g
  JOIN ord o ON o.doc_id IS NOT DISTINCT FROM g.doc_id AND o.edge = g.edge AND o.signature = g.signature AND o.k = g.k + 1),
planned AS (SELECT doc_id, page_no, row_no FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, edge, signature, run) AS n FROM fold) WHERE n >= 3)"""
)


def _planned(spark, sf_dir):
    lines = sources.layout_lines(spark, sf_dir)
    return lines, furniture.plan(furniture.candidates(lines, HEIGHT))


@query(f"WITH {_PLAN_SQL} SELECT doc_id, page_no, row_no FROM planned")
def furniture_plan(spark, sf_dir):
    return _planned(spark, sf_dir)[1]


@query(f"WITH {_PLAN_SQL}, m AS (SELECT l.*, p.doc_id IS NOT NULL AS gone FROM layout_lines l LEFT JOIN planned p USING (doc_id, page_no, row_no)), k AS (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY doc_id, page_no) AS kept FROM m) SELECT doc_id, page_no, row_no, text FROM k WHERE NOT gone OR kept = 0")
def furniture_dropped(spark, sf_dir):
    return furniture.dropped(*_planned(spark, sf_dir)).select("doc_id", "page_no", "row_no", "text")


@query(
    f"""WITH {_PLAN_SQL}, w AS (SELECT doc_id, page_no, list_filter(regexp_split_to_array(text, '[{L.WS}]+'), lambda t: t <> '') AS w FROM layout_lines JOIN planned USING (doc_id, page_no, row_no)),
e AS (SELECT doc_id, page_no, unnest(list_distinct([w[1], w[-1]])) AS t FROM w), o AS (SELECT DISTINCT doc_id, page_no, CAST(t AS INTEGER) - page_no AS "offset" FROM e WHERE regexp_matches(t, '^[0-9]{{1,9}}$')),
n AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM layout_lines GROUP BY doc_id)
SELECT doc_id, "offset", count(*) AS n FROM o JOIN n USING (doc_id) GROUP BY doc_id, "offset", pages HAVING count(*) >= greatest(6, (pages + 3) // 4)"""
)
def folio_offsets(spark, sf_dir):
    return furniture.drop_folios(*_planned(spark, sf_dir))


@query(
    f"""WITH {sources.LAYOUT_SQL}, k AS (SELECT DISTINCT doc_id, page_no, CASE WHEN y + h / 2 > {HEIGHT} * 0.93 THEN 'top:' WHEN y + h / 2 < {HEIGHT} * 0.07 THEN 'bottom:' END || {_MASK} AS key FROM layout_lines WHERE length(text) < 100),
n AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM layout_lines GROUP BY doc_id)
SELECT doc_id, key, count(*) AS n FROM k JOIN n USING (doc_id) WHERE key IS NOT NULL GROUP BY doc_id, key, pages HAVING pages >= 3 AND count(*) >= greatest(3, (pages + 1) // 2)"""
)
def synthetic_margins(spark, sf_dir):
    return furniture.synthetic_margins(sources.layout_lines(spark, sf_dir), HEIGHT)


# --- typography ---------------------------------------------------------------------------------------------

_BODY = """{n} AS (SELECT {k}, body, CASE WHEN lines >= 3 AND chars >= 200 THEN body END AS established FROM (SELECT {k}, CAST(round(size) AS INTEGER) AS body, sum(length(text)) AS chars, count(*) AS lines, row_number() OVER (PARTITION BY {k} ORDER BY sum(length(text)) DESC, round(size)) AS r FROM layout_lines GROUP BY {k}, round(size)) WHERE r = 1)"""
_THRESHOLDS_SQL = (
    sources.LAYOUT_SQL
    + ",\n"
    + _BODY.format(n="of_doc", k="doc_id")
    + ",\n"
    + _BODY.format(n="of_page", k="doc_id, page_no")
    + """,
thresholds AS (SELECT doc_id, page_no, p.body, round(greatest(greatest(4, p.body) * 1.25, greatest(4, p.body, coalesce(p.established, 0)) * 1.1, CASE WHEN p.established IS NULL THEN d.body * 1.1 ELSE 0 END), 6) AS threshold FROM of_page p JOIN of_doc d USING (doc_id))"""
)


@query(f"WITH {_THRESHOLDS_SQL} SELECT doc_id, page_no, body, CAST(threshold AS DOUBLE) AS threshold FROM thresholds")
def heading_thresholds(spark, sf_dir):
    return typography.heading_thresholds(sources.layout_lines(spark, sf_dir))


@query(f"WITH {_THRESHOLDS_SQL} SELECT doc_id, page_no, row_no, size, bold FROM layout_lines JOIN thresholds USING (doc_id, page_no) WHERE size >= threshold AND length(text) < 200 AND regexp_matches(text, '\\p{{L}}')")
def title_sized(spark, sf_dir):
    return typography.title_sized(sources.layout_lines(spark, sf_dir))


_TAGGED = "tagged AS (SELECT *, CAST(round(size * 2) AS INTEGER) AS size_key, CASE WHEN size = 16 THEN CASE WHEN page_no % 3 = 0 THEN 2 ELSE 1 END ELSE 3 END AS level FROM layout_lines WHERE bold)"
_TIERS_SQL = f"""{sources.LAYOUT_SQL}, {_TAGGED},
lv AS (SELECT doc_id, size_key, bold, level, count(*) AS n FROM tagged GROUP BY ALL), bs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size_key, bold ORDER BY n DESC, level) AS r FROM lv),
tiers AS (SELECT doc_id, size_key, bold, level FROM bs JOIN (SELECT doc_id, size_key, bold, count(DISTINCT page_no) AS pages FROM tagged GROUP BY ALL) USING (doc_id, size_key, bold) WHERE r = 1 AND pages >= 3)"""


def _tagged(lines):
    level = F.when(F.col("size") == 16, F.when(F.col("page_no") % 3 == 0, 2).otherwise(1)).otherwise(3)
    return lines.where("bold").select("doc_id", "page_no", typography.size_key(F.col("size")).alias("size_key"), "bold", level.alias("level"))


@query(f"WITH {_TIERS_SQL} SELECT * FROM tiers")
def heading_tiers(spark, sf_dir):
    return typography.heading_tiers(_tagged(sources.layout_lines(spark, sf_dir)))


@query(f"WITH {_TIERS_SQL} SELECT l.doc_id, l.page_no, l.row_no, (SELECT arg_max(t.level, t.size_key) FROM tiers t WHERE t.doc_id = l.doc_id AND t.bold = l.bold AND t.size_key <= round(l.size * 2)) AS level FROM layout_lines l")
def ranked_levels(spark, sf_dir):
    lines = sources.layout_lines(spark, sf_dir)
    return typography.ranked_levels(lines, typography.heading_tiers(_tagged(lines)))


@query(
    f"""WITH {_THRESHOLDS_SQL}, s AS (SELECT *, regexp_extract(text, '{L.SECTION}', 1) AS section, regexp_replace(text, '^[0-9.]+[{L.WS}]+', '') AS rest FROM layout_lines JOIN thresholds USING (doc_id, page_no)),
t AS (SELECT doc_id, CAST(round(size * 2) AS INTEGER) AS size_key, page_no, y, CAST(section AS INTEGER) AS number FROM s WHERE regexp_matches(section, '^[0-9]+$') AND regexp_matches(text, '{L.SECTION}') AND length(text) <= 120 AND length(rest) - length(regexp_replace(rest, '\\p{{L}}', '', 'g')) >= 3 AND NOT regexp_matches(section, '^0+$') AND size >= body * 1.1),
o AS (SELECT *, number - lag(number) OVER w AS step, row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY doc_id, size_key ORDER BY page_no, y DESC))
SELECT doc_id, size_key, count(*) AS n FROM o GROUP BY doc_id, size_key HAVING count(*) >= 3 AND min(number) FILTER (k = 1) = 1 AND min(step) >= 1 AND max(step) <= 3"""
)
def numbered_outline(spark, sf_dir):
    return typography.numbered_sections(sources.layout_lines(spark, sf_dir))


@query(f"WITH {sources.LAYOUT_SQL} SELECT doc_id, CAST(round(size) AS INTEGER) AS rounded, list_sort(list(h))[count(*) // 4 + 1] AS quartile, list_sort(list(h))[count(*) // 2 + 1] AS median FROM layout_lines GROUP BY doc_id, round(size)")
def line_heights(spark, sf_dir):
    return typography.line_heights(sources.layout_lines(spark, sf_dir))


@query(
    f"""WITH {sources.LAYOUT_SQL}, u AS (SELECT doc_id, page_no, min(x) AS "left", max(x + w) AS "right", min(y) AS foot, max(y + h) AS top FROM layout_lines GROUP BY ALL)
SELECT *, "left" >= {WIDTH} / 7 AND {WIDTH} - "right" >= {WIDTH} / 7 AND abs("left" - ({WIDTH} - "right")) <= {WIDTH} / 50 AS type_page FROM u"""
)
def page_rects(spark, sf_dir):
    return typography.page_rects(sources.layout_lines(spark, sf_dir), WIDTH)


_SHARED_ROW = "least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= least(a.h, b.h) * 0.5"


@query(
    f"""WITH {sources.LAYOUT_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, row_no) AS k FROM layout_lines)
SELECT a.doc_id, a.page_no, a.row_no, abs(a.size - b.size) <= b.size * 0.1 AS alike, {_SHARED_ROW} AS one_row, b.x < a.x + a.w AND b.x + b.w > a.x AS one_column,
 abs(a.size - b.size) <= greatest(a.size, b.size) * 0.1 AND NOT ({_SHARED_ROW}) AND b.y < a.y AND b.y + b.h >= a.y - greatest(a.size, b.size) AND a.y - b.y <= greatest(a.size, b.size) * 2.2
  AND least(abs(a.x - b.x), abs(a.x + a.w - b.x - b.w), abs(a.x + a.w / 2 - b.x - b.w / 2)) <= greatest(a.size, b.size) * 0.6 AS stacks,
 regexp_matches(a.text, '[-­]$') AND regexp_matches(b.text, '^\\p{{Ll}}') AND abs(a.x - b.x) <= greatest(a.size, 4) * 0.25 AND a.y - b.y - b.h >= greatest(a.size, 4) * -0.2 AND a.y - b.y - b.h <= greatest(a.size, 4) * 0.8 AS broken
FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND b.k = a.k + 1"""
)
def line_pairs(spark, sf_dir):
    order = Window.partitionBy("doc_id", "page_no").orderBy(F.desc("y"), "row_no")
    rect = F.struct("x", "y", "w", "h", "size", "text")
    pairs = sources.layout_lines(spark, sf_dir).select("doc_id", "page_no", "row_no", rect.alias("a"), F.lead(rect).over(order).alias("b")).where("b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    return pairs.select("doc_id", "page_no", "row_no", typography.same_size(a, b).alias("alike"), typography.same_row(a, b).alias("one_row"), typography.shares_column(a, b).alias("one_column"), typography.stacks_under(a, b).alias("stacks"), typography.continues_broken_word(a, b).alias("broken"))


@query(
    f"""WITH {sources.LAYOUT_SQL}, r AS (SELECT doc_id, page_no, row_no, text, y + h / 2 AS middle, x, CASE WHEN row_no % 3 = 0 THEN 0.5 ELSE y END AS y, w * CASE WHEN row_no % 2 = 0 THEN 1.3 ELSE 1.0 END AS w, h * ((row_no + 4) % 4) * CASE WHEN row_no = 7 THEN 16.0 ELSE 0.25 END AS h, ['upright', 'clockwise', 'counterclockwise'][1 + (row_no + 3) % 3] AS turn FROM layout_lines)
SELECT doc_id, page_no, row_no, h <= 6 AND w >= greatest(12, h * 3) AS thin, w >= {WIDTH} * 0.9 AND (y <= 1 OR y + h >= {HEIGHT} - 1) AS edge_band, w * h > {WIDTH} * {HEIGHT} * 0.75 AS covers,
 length(regexp_replace(text, '[\\t\\n\\r ]', '', 'g')) <= 4 AND regexp_matches(text, '\\p{{N}}') AND NOT regexp_matches(text, '\\p{{L}}') AND (middle / {HEIGHT} <= 0.10 OR middle / {HEIGHT} >= 0.90) AS folio,
 CASE turn WHEN 'clockwise' THEN -(y + h) WHEN 'counterclockwise' THEN y ELSE x END AS ux, CASE turn WHEN 'clockwise' THEN x WHEN 'counterclockwise' THEN -(x + w) ELSE y END AS uy, CASE turn WHEN 'upright' THEN w ELSE h END AS uw, CASE turn WHEN 'upright' THEN h ELSE w END AS uh FROM r"""
)
def rect_rules(spark, sf_dir):
    """Rules over rectangles: lines stand for them, some flattened, widened, set at the foot or turned."""
    k = F.col("row_no")
    h = F.col("h") * ((k + 4) % 4) * F.when(k == 7, 16.0).otherwise(0.25)
    turn = F.get(F.array(F.lit("upright"), F.lit("clockwise"), F.lit("counterclockwise")), (k + 3) % 3)
    r = sources.layout_lines(spark, sf_dir).select("doc_id", "page_no", "row_no", "text", (F.col("y") + F.col("h") / 2).alias("middle"), "x", F.when(k % 3 == 0, 0.5).otherwise(F.col("y")).alias("y"), (F.col("w") * F.when(k % 2 == 0, 1.3).otherwise(1.0)).alias("w"), h.alias("h"), turn.alias("turn"))
    x, y, w, h = (F.col(c) for c in "xywh")
    up = typography.upright(F.col("turn"), F.struct(x, y, w, h))
    return r.withColumn("up", up).select(
        "doc_id", "page_no", "row_no", typography.is_thin_rule(w, h).alias("thin"), typography.is_edge_band(y, w, h, WIDTH, HEIGHT).alias("edge_band"), typography.covers_page(w, h, WIDTH, HEIGHT).alias("covers"),
        typography.is_folio_in_margin(F.col("text"), F.col("middle"), HEIGHT).alias("folio"), F.col("up.x").alias("ux"), F.col("up.y").alias("uy"), F.col("up.w").alias("uw"), F.col("up.h").alias("uh"),
    )
