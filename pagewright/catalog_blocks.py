"""Queries of blocks: lists, notes, packing, progress, options, outlines and checks of a document's model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import sources
from .operators import blocks, html_blocks, list_items, spine
from .registry import query


@query()
def list_blocks(spark, sf_dir):
    """Every block with what lists make of it; an ordered fold, so tests hold it against written cases."""
    return list_items.build_lists(sources.list_blocks(spark, sf_dir))


@query()
def spine_pack(spark, sf_dir):
    """A source's documents are a book's lines here; files are small, since the tables' documents are."""
    lines = sources.doc_lines(spark, sf_dir).where("line <> ''")
    heading = (F.col("line_no") % 7 == 0) & (F.length("line") < 60)
    chapter = heading & (F.col("line_no") % 35 == 0)
    markup = F.concat(F.lit("<p>"), F.col("line"), F.lit("</p>\n"))
    sized = lines.select("doc_id", F.col("line_no").alias("seq"), F.octet_length(markup).cast("bigint").alias("bytes"), heading.alias("heading"), chapter.alias("chapter"))
    return spine.pack(sized, target=1200)


_NOTES = """e AS (SELECT doc_id, line_no AS note, 1 + line_no % 7 AS number, line_no // 8 - (coalesce(doc_id, 0) % 3) AS first_page, line_no // 8 + 1 AS last_page FROM doc_lines WHERE line_no % 2 = 0),
r AS (SELECT doc_id, line_no, 1 + (line_no * 3) % 7 AS number, line_no // 8 AS page FROM doc_lines WHERE line_no % 2 = 1)"""


@query(f"WITH {sources.DOC_LINES_SQL}, {_NOTES} SELECT r.doc_id, r.line_no, min(e.note) AS note FROM r JOIN e ON r.doc_id = e.doc_id AND r.number = e.number AND r.page BETWEEN e.first_page AND e.last_page GROUP BY r.doc_id, r.line_no HAVING count(*) = 1")
def note_targets(spark, sf_dir):
    lines = sources.doc_lines(spark, sf_dir)
    n, page = F.col("line_no"), F.floor(F.col("line_no") / 8)
    entries = lines.where(n % 2 == 0).select("doc_id", n.alias("note"), (1 + n % 7).alias("number"), (page - F.coalesce("doc_id", F.lit(0)) % 3).alias("first_page"), (page + 1).alias("last_page"))
    references = lines.where(n % 2 == 1).select("doc_id", "line_no", (1 + (n * 3) % 7).alias("number"), page.alias("page"))
    return blocks.note_targets(references, entries)


@query(
    """WITH l AS (SELECT page_id, i, t[i] AS title, CASE WHEN i % 4 = 0 THEN NULL ELSE (i * 2 + page_id) % 12 + 1 END AS page FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages WHERE html IS NOT NULL))),
s AS (SELECT page_id, count(*) AS entries, count(DISTINCT title) AS titles, max(CASE WHEN i % 5 = 0 THEN (page_id % 5) ELSE 1 END) AS depth FROM l GROUP BY page_id)
SELECT page_id, entries, titles, CAST(depth AS INTEGER) AS depth, entries >= 2 AND entries <= 10000 AND entries <= (page_id % 4) * 3 AND depth < 4 AND titles * 2 > entries AS navigation FROM s"""
)
def outline_navigation(spark, sf_dir):
    """A page's links as an outline's entries; a book's pages and the entries' depth are set by page_id."""
    return html_blocks.outline_navigation(sources.table(spark, sf_dir, "pages"))


@query(
    f"""WITH {sources.LAYOUT_SQL}, c AS (SELECT doc_id, page_no, CAST(regexp_extract(text, '^([0-9]+) ', 1) AS INTEGER) AS number FROM layout_lines WHERE size = 16 AND regexp_matches(text, '^[0-9]+ ')),
o AS (SELECT *, row_number() OVER w AS k, page_no - lag(page_no) OVER w AS step FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY page_no))
SELECT doc_id, count(*) AS n, count(*) >= 2 AND bool_and(number = k) AND coalesce(min(step) > 0, true) AS ordered FROM o GROUP BY doc_id"""
)
def chapters_in_order(spark, sf_dir):
    titles = sources.layout_lines(spark, sf_dir).where("size = 16").select("doc_id", "page_no", F.regexp_extract("text", "^([0-9]+) ", 1).try_cast("int").alias("number")).where("number IS NOT NULL")
    return blocks.chapters_in_order(titles)


@query(
    """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, round(least(0.82, 0.02 + 0.80 * CASE WHEN k * 2 <= n THEN 0.6875 * (k * 2) / n ELSE 0.6875 + 0.3125 * (k * 2 - n) / n END), 9) AS pipeline, round(0.82 + 0.17 * k / n, 9) AS writing FROM p"""
)
def progress_shares(spark, sf_dir):
    """A user's events stand for pages: the first half is read, the second rebuilt, all are written."""
    events = sources.table(spark, sf_dir, "events")
    by = Window.partitionBy("user_id")
    steps = events.select("user_id", "event_id", F.row_number().over(by.orderBy("ts", "event_id")).alias("k"), F.count("*").over(by).alias("n"))
    return steps.select("user_id", "event_id", F.round(blocks.pipeline_progress(F.col("k"), F.col("n")), 9).alias("pipeline"), F.round(blocks.writing_progress(F.col("k"), F.col("n")), 9).alias("writing"))


@query(
    r"""WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'en_US' WHEN c_custkey % 7 = 0 THEN 'e' ELSE 'en-US' END AS language, 40 + c_custkey % 700 AS dpi, c_custkey % 120000 * 2 AS pages, c_custkey * 1000 AS characters, CAST(c_custkey AS BIGINT) * 400000 AS pixels, 1975 + c_custkey % 130 AS year FROM customer)
SELECT c_custkey, CASE WHEN NOT regexp_matches(language, '^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$') THEN 'language' WHEN dpi NOT BETWEEN 72 AND 600 THEN 'dpi' WHEN pages NOT BETWEEN 1 AND 100000 THEN 'pages' WHEN characters NOT BETWEEN 1 AND 100000000 THEN 'characters'
 WHEN pixels NOT BETWEEN 1 AND 48000000 THEN 'pixels' WHEN year NOT BETWEEN 1980 AND 2099 THEN 'date' END AS refused FROM o"""
)
def option_bounds(spark, sf_dir):
    """Options made from customers' keys: the first that is out of its bounds."""
    k = F.col("c_custkey")
    options = sources.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 5 == 0, "en_US").when(k % 7 == 0, "e").otherwise("en-US").alias("language"), (40 + k % 700).alias("dpi"), (k % 120000 * 2).alias("pages"), (k * 1000).alias("characters"), (k.cast("bigint") * 400000).alias("pixels"), (1975 + k % 130).alias("year"),
    )
    return options.select("c_custkey", blocks.refused_option(F.col).alias("refused"))


_PARTS = """p AS (SELECT doc_id, line_no, line, CASE WHEN line_no % 9 = 0 THEN 'heading' WHEN line_no % 9 = 4 THEN 'image' WHEN line_no % 9 = 5 THEN 'asset' WHEN line_no % 9 = 7 THEN 'table' WHEN line_no % 9 = 8 THEN 'note' ELSE 'paragraph' END AS kind,
  length(line) % 8 AS level, 'a' || (line_no // 3 + length(line) % 2) AS asset, len(string_split(line, ' ')) AS width, length(line) % 5 AS other, 'note-' || CASE WHEN length(line) % 3 = 0 THEN 'X' ELSE '' END || (line_no % 27) AS note FROM doc_lines)"""


@query(
    f"""WITH {sources.DOC_LINES_SQL}, {_PARTS}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, asset ORDER BY line_no) AS ka, row_number() OVER (PARTITION BY doc_id, kind, note ORDER BY line_no) AS kn FROM p),
f AS (SELECT doc_id, asset, min(line_no) AS at FROM p WHERE kind = 'asset' GROUP BY ALL)
SELECT doc_id, line_no, 'heading_level' AS code FROM p WHERE kind = 'heading' AND level NOT BETWEEN 1 AND 6 UNION ALL SELECT doc_id, line_no, 'duplicate_asset' FROM a WHERE kind = 'asset' AND ka > 1
UNION ALL SELECT p.doc_id, p.line_no, 'missing_asset' FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.asset = f.asset AND f.at < p.line_no WHERE kind = 'image' AND f.asset IS NULL
UNION ALL SELECT doc_id, line_no, 'table' FROM p WHERE kind = 'table' AND (width < 2 OR other = 0) UNION ALL SELECT doc_id, line_no, 'note' FROM a WHERE kind = 'note' AND (NOT regexp_matches(note, '^note-[0-9a-z-]*$') OR length(note) > 80 OR kn > 1)"""
)
def model_violations(spark, sf_dir):
    """Lines stand for a document's parts, some of which break its rules."""
    n, size = F.col("line_no"), F.length("line")
    kind = F.when(n % 9 == 0, "heading").when(n % 9 == 4, "image").when(n % 9 == 5, "asset").when(n % 9 == 7, "table").when(n % 9 == 8, "note").otherwise("paragraph")
    parts = sources.doc_lines(spark, sf_dir).select(
        "doc_id", "line_no", kind.alias("kind"), (size % 8).alias("level"), F.concat(F.lit("a"), (F.floor(n / 3) + size % 2).cast("string")).alias("asset"), F.size(F.split("line", " ")).alias("width"), (size % 5 != 0).alias("rectangular"),
        F.concat(F.lit("note-"), F.when(size % 3 == 0, "X").otherwise(""), (n % 27).cast("string")).alias("note"),
    )
    return blocks.model_violations(parts)


@query(
    """WITH s AS (SELECT doc_id, i, l[i] AS t, count(*) OVER (PARTITION BY doc_id, l[i]) AS uses FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)))
SELECT doc_id, CAST(i AS INTEGER) AS at, uses = 1 AS once FROM s"""
)
def phrases_once(spark, sf_dir):
    """Whether each line of a document, as a phrase of its book, occurs once in it."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    each = sources.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(lines).alias("i", "t"))
    return each.select("doc_id", (F.col("i") + 1).alias("at"), (F.count("*").over(Window.partitionBy("doc_id", "t")) == 1).alias("once"))


@query(
    f"""WITH {sources.DOC_LINES_SQL}, c AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \n]+') AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, text, w[1] AS a, w[1 + len(w) // 2] AS b, w[-1] AS c FROM c WHERE len(w) >= 3),
f AS (SELECT *, strpos(text, a) AS x FROM p), g AS (SELECT *, strpos(substring(text, x + length(a)), b) AS y FROM f)
SELECT doc_id, x > 0 AND y > 0 AND strpos(substring(text, x + length(a) + y - 1 + length(b)), c) > 0 AS in_order, strpos(regexp_replace(text, '[ \n]+', '', 'g'), a || b) > 0 AS squeezed FROM g"""
)
def ordered_phrases(spark, sf_dir):
    """Whether three words of a text occur each after the one before, and two of them with no space between."""
    words = sources.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0)).alias("w")).where("size(w) >= 3")
    phrases = words.select("doc_id", "text", F.array(F.get("w", F.lit(0)), F.get("w", F.floor(F.size("w") / 2).cast("int")), F.get("w", F.size("w") - 1)).alias("p"))
    joined = F.concat(F.get("p", F.lit(0)), F.get("p", F.lit(1)))
    return phrases.select("doc_id", blocks.ordered_in(F.col("text"), F.col("p")).alias("in_order"), (F.instr(F.regexp_replace("text", "[ \n]+", ""), joined) > 0).alias("squeezed"))
