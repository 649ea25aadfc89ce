"""Queries of geometry inside a page, and of what a whole book is."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import functions as X
from . import sources
from .catalog_layout import _PLAN_SQL, HEIGHT, WIDTH, _planned
from .functions import lines as L
from .operators import geometry
from .registry import query

_AT = "ord_lines AS (SELECT *, CAST(row_no + 1 AS INTEGER) AS ord FROM layout_lines)"


def _lines(spark, sf_dir):
    return sources.layout_lines(spark, sf_dir).withColumn("ord", (F.col("row_no") + 1).cast("int"))


@query(
    f"""WITH {sources.LAYOUT_SQL}, {_AT}, p AS (SELECT doc_id, page_no, ord, text, x, y, w, h, size FROM ord_lines UNION ALL SELECT doc_id, page_no, ord + 200, text, x + CASE WHEN ord % 3 = 0 THEN 0.04 ELSE 0.0 END, y + CASE WHEN ord % 5 = 0 THEN 0.2 ELSE 0.0 END, w, h, size FROM ord_lines WHERE ord % 2 = 0)
SELECT doc_id, page_no, ord FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.text = b.text AND b.ord < a.ord AND abs(a.size - b.size) <= 0.01 AND abs(a.x - b.x) <= 0.05 AND abs(a.y - b.y) <= 0.05 AND abs(a.w - b.w) <= 0.05 AND abs(a.h - b.h) <= 0.05)"""
)
def without_overprints(spark, sf_dir):
    """Every second line is printed twice, some of the copies a little off."""
    lines = _lines(spark, sf_dir).select("doc_id", "page_no", "ord", "text", "x", "y", "w", "h", "size")
    ord = F.col("ord")
    again = lines.where(ord % 2 == 0).withColumn("x", F.col("x") + F.when(ord % 3 == 0, 0.04).otherwise(0.0)).withColumn("y", F.col("y") + F.when(ord % 5 == 0, 0.2).otherwise(0.0)).withColumn("ord", ord + 200)
    return geometry.without_overprints(lines.unionByName(again)).select("doc_id", "page_no", "ord")


@query(
    f"""WITH RECURSIVE {sources.LAYOUT_SQL}, {_AT}, p AS (SELECT doc_id, page_no, CAST(ord * 3 + j AS INTEGER) AS ord, y + (j - 1) * h * 0.3 AS y, h FROM ord_lines, (SELECT unnest([0, 1, 2]) AS j)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, ord) AS k FROM p),
f AS (SELECT doc_id, page_no, k, ord, y, h, 1 AS "row" FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.page_no, o.k, o.ord, CASE WHEN f.y + f.h IS NOT NULL AND least(f.y + f.h, o.y + o.h) - greatest(f.y, o.y) >= least(f.h, o.h) * 0.5 THEN f.y ELSE o.y END, CASE WHEN least(f.y + f.h, o.y + o.h) - greatest(f.y, o.y) >= least(f.h, o.h) * 0.5 THEN f.h ELSE o.h END,
    CASE WHEN least(f.y + f.h, o.y + o.h) - greatest(f.y, o.y) >= least(f.h, o.h) * 0.5 THEN f."row" ELSE f."row" + 1 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_no = f.page_no AND o.k = f.k + 1)
SELECT doc_id, page_no, ord, "row" FROM f"""
)
def printed_rows(spark, sf_dir):
    """Each line in three pieces, a little above and below one another."""
    j = F.col("j")
    pieces = _lines(spark, sf_dir).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("doc_id", "page_no", (F.col("ord") * 3 + j).alias("ord"), (F.col("y") + (j - 1) * F.col("h") * 0.3).alias("y"), "h")
    return geometry.printed_rows(pieces)


@query(
    f"""WITH {sources.LAYOUT_SQL}, {_AT}, p AS (SELECT doc_id, page_no, ord AS point, x + w * (ord % 3) * 0.5 AS px, y + h / 2 AS py FROM ord_lines), r AS (SELECT doc_id, page_no, ord AS rect, x, y - CASE WHEN ord % 2 = 0 THEN 12.0 ELSE 0.0 END AS y, w, h + CASE WHEN ord % 2 = 0 THEN 12.0 ELSE 0.0 END AS h FROM ord_lines)
SELECT p.doc_id, p.page_no, point, min(rect) AS owner FROM p JOIN r ON p.doc_id = r.doc_id AND p.page_no = r.page_no AND px BETWEEN x AND x + w AND py BETWEEN y AND y + h GROUP BY ALL HAVING count(*) = 1"""
)
def point_owners(spark, sf_dir):
    """A point of each line against the lines' rectangles, every second of which reaches down into the next line."""
    lines, ord = _lines(spark, sf_dir), F.col("ord")
    points = lines.select("doc_id", "page_no", ord.alias("point"), (F.col("x") + F.col("w") * (ord % 3) * 0.5).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))
    reach = F.when(ord % 2 == 0, 12.0).otherwise(0.0)
    return geometry.owners(points, lines.select("doc_id", "page_no", ord.alias("rect"), "x", (F.col("y") - reach).alias("y"), "w", (F.col("h") + reach).alias("h")))


@query(
    f"""WITH {sources.LAYOUT_SQL}, {_AT}, m AS (SELECT a.doc_id, a.page_no, a.ord, a.y AS foot, b.ord AS below, b.y + b.h AS top FROM ord_lines a JOIN ord_lines b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.ord <> b.ord AND b.x < a.x + a.w AND b.x + b.w > a.x
  AND NOT (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= least(a.h, b.h) * 0.5) AND b.y + b.h <= a.y + a.h * 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, ord ORDER BY top DESC, below) AS k FROM m) SELECT doc_id, page_no, ord, below, round(foot - top, 6) AS gap FROM r WHERE k = 1"""
)
def nearest_below(spark, sf_dir):
    return geometry.nearest_below(_lines(spark, sf_dir))


@query(
    f"""WITH {sources.LAYOUT_SQL}, {_AT}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, ord) AS k FROM ord_lines WHERE y >= {HEIGHT} / 2)
SELECT doc_id, page_no, string_agg(lower(trim(regexp_replace(text, '[{L.WS}]+', ' ', 'g'))), ' ' ORDER BY k) AS opening FROM k WHERE k <= 6 GROUP BY ALL"""
)
def top_lines(spark, sf_dir):
    return geometry.top_lines(_lines(spark, sf_dir), HEIGHT)


@query(f"WITH {_PLAN_SQL}, k AS (SELECT l.* FROM layout_lines l ANTI JOIN planned p ON l.doc_id = p.doc_id AND l.page_no = p.page_no AND l.row_no = p.row_no) SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[\\p{{L}}-]+'))) AS word FROM k")
def vocabulary_kept(spark, sf_dir):
    """The words of a book without its running heads and feet."""
    lines, planned = _planned(spark, sf_dir)
    kept = lines.join(planned, ["doc_id", "page_no", "row_no"], "left_anti")
    return kept.select("doc_id", F.explode(X.vocabulary_words(F.col("text"))).alias("word")).distinct()


@query(
    f"""WITH {_PLAN_SQL}, a AS (SELECT doc_id, count(DISTINCT page_no) AS pages, count(DISTINCT page_no) FILTER (row_no BETWEEN 0 AND 7) AS reflowed, count(*) AS lines FROM layout_lines GROUP BY doc_id), w AS (SELECT doc_id, count(DISTINCT page_no) AS warnings FROM planned GROUP BY doc_id)
SELECT doc_id, '{{"lines":' || lines || ',"pageCount":' || pages || ',"reflowedPages":' || reflowed || ',"warnings":' || coalesce(warnings, 0) || '}}' AS report FROM a LEFT JOIN w USING (doc_id)"""
)
def book_reports(spark, sf_dir):
    """A book's report as JSON, its fields in order; a page that lost furniture has a warning."""
    lines, planned = _planned(spark, sf_dir)
    a = lines.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pageCount"), F.countDistinct(F.when(F.col("row_no").between(0, 7), F.col("page_no"))).alias("reflowedPages"), F.count("*").alias("lines"))
    w = planned.groupBy("doc_id").agg(F.countDistinct("page_no").alias("warnings"))
    zero = F.lit(0).cast("bigint")
    return a.join(w, "doc_id", "left").select("doc_id", F.to_json(F.struct("lines", "pageCount", "reflowedPages", F.coalesce("warnings", zero).alias("warnings"))).alias("report"))


_LETTERS = "regexp_replace(text, '[^\\p{L}]', '', 'g')"
_LATIN = X.LATIN.replace("\\x{0}", "\\x{1}")


@query(
    f"""WITH t AS (SELECT source, CAST(sum(length({_LETTERS}) - length(regexp_replace({_LETTERS}, '[{X.RIGHT_TO_LEFT}]', '', 'g'))) AS BIGINT) AS rtl, CAST(sum(length({_LETTERS}) - length(regexp_replace({_LETTERS}, '[{_LATIN}]', '', 'g'))) AS BIGINT) AS latin FROM (SELECT source, text || CASE WHEN doc_id % 2 = 0 AND source IS NOT NULL THEN repeat('س', 5000) ELSE '' END AS text FROM documents WHERE text IS NOT NULL) GROUP BY source)
SELECT source, rtl, latin, rtl > 0 AND rtl >= latin AS right_to_left FROM t"""
)
def book_directions(spark, sf_dir):
    """A source's documents as a book's blocks, some with a passage in Arabic letters: which way the book runs."""
    arabic = F.when((F.col("doc_id") % 2 == 0) & F.col("source").isNotNull(), F.repeat(F.lit("س"), 5000)).otherwise("")
    texts = sources.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", F.concat("text", arabic).alias("text"))
    t = texts.groupBy("source").agg(F.sum(X.right_to_left_letters(F.col("text"))).alias("rtl"), F.sum(X.latin_letters(F.col("text"))).alias("latin"))
    return t.withColumn("right_to_left", (F.col("rtl") > 0) & (F.col("rtl") >= F.col("latin")))


@query(
    f"""WITH {sources.LAYOUT_SQL}, p AS (SELECT doc_id, page_no, CASE WHEN doc_id % 3 = 0 AND page_no % 5 = 0 THEN {HEIGHT} ELSE {WIDTH} END AS height, bool_or(size = 16 OR page_no % 3 = 0) AS titled, bool_or(regexp_matches(text, '\\p{{L}}')) AS worded FROM layout_lines GROUP BY doc_id, page_no)
SELECT doc_id, count(*) AS pages, count(*) >= 3 AND bool_and(height < {HEIGHT}) AND count(*) FILTER (worded) > 0 AND count(*) FILTER (titled AND worded) * 3 >= count(*) FILTER (worded) * 2 AS deck FROM p GROUP BY doc_id"""
)
def slide_decks(spark, sf_dir):
    """Three pages at least, all wide, two thirds of those with words titled; some books have upright pages among them."""
    d, p = F.col("doc_id"), F.col("page_no")
    pages = sources.layout_lines(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.bool_or((F.col("size") == 16) | (p % 3 == 0)).alias("titled"), F.bool_or(F.col("text").rlike(r"\p{L}")).alias("worded"))
    wide = ~((d % 3 == 0) & (p % 5 == 0))
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.bool_and(wide).alias("wide"), F.count_if("worded").alias("worded"), F.count_if(F.col("titled") & F.col("worded")).alias("titled"))
    return counted.select("doc_id", "pages", ((F.col("pages") >= 3) & F.col("wide") & (F.col("worded") > 0) & (F.col("titled") * 3 >= F.col("worded") * 2)).alias("deck"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, year(ts) BETWEEN 1980 AND 2099 AS allowed FROM events")
def time_stamps(spark, sf_dir):
    ts = F.col("ts")
    return sources.table(spark, sf_dir, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.year(ts).between(1980, 2099).alias("allowed"))


# Punctuation that all encodings share.
_SHARED = "!#$%&()*+,-./:;=?@[]"


@query(
    f"""WITH c AS (SELECT event_id, event_id % 300 - 20 AS code FROM events)
SELECT event_id, CASE WHEN code BETWEEN 65 AND 90 OR code BETWEEN 97 AND 122 OR code BETWEEN 48 AND 57 OR (code BETWEEN 33 AND 126 AND contains('{_SHARED}', chr(CAST(code AS INTEGER)))) THEN chr(CAST(code AS INTEGER)) END AS shared FROM c"""
)
def shared_characters(spark, sf_dir):
    """The character that a code stands for in every encoding: letters, digits, some punctuation."""
    code = (F.col("event_id") % 300 - 20).alias("code")
    c = F.col("code")
    plain = c.between(65, 90) | c.between(97, 122) | c.between(48, 57) | (c.between(33, 126) & F.lit(_SHARED).contains(F.char(c)))
    return sources.table(spark, sf_dir, "events").select("event_id", code).select("event_id", F.when(plain, F.char(c)).alias("shared"))
