"""Relations the operators read, derived from the provided tables.

``doc_lines`` has one row per printed line; ``doc_pages`` sets eight lines to a page and
gives each a place and a size that are pure functions of its text (the tables carry no
geometry, so it is ours and stands for nothing in the source); ``wrapped_lines`` re-wraps
texts at a fixed measure, breaking words with a mark, for the line-join operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import named

LINES_PER_PAGE = 8
MEASURE = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return documents.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


DOC_LINES_SQL = """doc_lines AS (
  SELECT doc_id, lang, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line
  FROM (SELECT doc_id, lang, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))"""


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no (from 0), row_no, line, x, y (from the foot), size, bold."""
    lines = doc_lines(spark, sf_dir).where("line <> ''")
    row = F.col("line_no") % LINES_PER_PAGE
    size = F.when((F.length("line") < 40) & (F.col("line_no") % 7 == 0), 14.0).when(F.length("line") % 5 == 0, 9.5).otherwise(11.0)
    return lines.select(
        "doc_id",
        F.floor(F.col("line_no") / LINES_PER_PAGE).cast("int").alias("page_no"),
        row.cast("int").alias("row_no"),
        "line",
        (F.lit(72.0) + (F.length("line") % 3) * 18.0).alias("x"),
        (F.lit(780.0) - row * 18.0).alias("y"),
        size.alias("size"),
        ((F.length("line") < 40) & (F.col("line_no") % 7 == 0)).alias("bold"),
    )


DOC_PAGES_SQL = (
    DOC_LINES_SQL
    + f""",
doc_pages AS (
  SELECT doc_id, CAST(line_no // {LINES_PER_PAGE} AS INTEGER) AS page_no, CAST(line_no % {LINES_PER_PAGE} AS INTEGER) AS row_no, line,
    72.0 + (length(line) % 3) * 18.0 AS x, 780.0 - (line_no % {LINES_PER_PAGE}) * 18.0 AS y,
    CASE WHEN length(line) < 40 AND line_no % 7 = 0 THEN 14.0 WHEN length(line) % 5 = 0 THEN 9.5 ELSE 11.0 END AS size,
    length(line) < 40 AND line_no % 7 = 0 AS bold
  FROM doc_lines WHERE line <> '')"""
)


#: What ends a broken word at a line's end, by the line's place; all others get the mark.
BREAKS = {3: "\u00ad", 4: "–", 5: "—", 7: "中"}
KINDS = 9


def wrapped_texts(spark: SparkSession, sf_dir: str, mark: str = "-", planted: bool = False) -> DataFrame:
    """doc_id, words (distinct, of the document), lines: its text re-wrapped at MEASURE characters, a broken word marked at the line's end.

    ``planted`` sets other breaks among the marks (``BREAKS``), and an ideograph where a line of place 8 begins.
    """
    documents = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit("[\\p{L}-]+"), F.lit(0))), F.lower))
    cut = documents.select("doc_id", words.alias("words"), F.regexp_extract_all(F.regexp_replace("text", "[ \n]+", " "), F.lit(f"(?s).{{1,{MEASURE}}}"), F.lit(0)).alias("cut"))

    def marked(pieces):
        def one(piece, i):
            kind = F.pmod(i, F.lit(KINDS))
            end = F.lit(mark)
            for k, break_ in BREAKS.items() if planted else ():
                end = F.when(kind == k, F.lit(break_)).otherwise(end)
            broken = piece.rlike("\\p{L}\\z") & F.coalesce(F.get(pieces, i + 1), F.lit("")).rlike("^\\p{L}")
            line = F.when(broken, F.concat(piece, end)).otherwise(piece)
            return F.when(kind == 8, F.concat(F.lit("文"), line)).otherwise(line) if planted else line

        return F.transform(pieces, one)

    return cut.select("doc_id", "words", named(F.col("cut"), marked).alias("lines"))


def wrapped_lines(spark: SparkSession, sf_dir: str, mark: str = "-") -> DataFrame:
    """doc_id, line_no, line, next_line of ``wrapped_texts``."""
    pairs = named(F.col("lines"), lambda lines: F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.get(lines, i + 1).alias("next_line"))))  # beside its lines a row would copy the whole text for each
    return wrapped_texts(spark, sf_dir, mark).select("doc_id", F.posexplode_outer(pairs).alias("line_no", "p")).where("line_no IS NOT NULL").select("doc_id", "line_no", "p.line", "p.next_line")


def wrapped_lines_sql(mark: str = "-", planted: bool = False) -> str:
    end = "CASE line_no % 9 " + " ".join(f"WHEN {k} THEN '{b}'" for k, b in BREAKS.items()) + f" ELSE '{mark}' END" if planted else f"'{mark}'"
    head = "CASE WHEN line_no % 9 = 8 THEN '文' ELSE '' END || " if planted else ""
    return rf"""cut AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[ \n]+', ' ', 'g'), '(?s).{{1,{MEASURE}}}') AS p FROM documents WHERE text IS NOT NULL),
wrapped AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, p[i] AS s, coalesce(p[i + 1], '') AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM cut)),
marked AS (SELECT doc_id, line_no, {head}CASE WHEN regexp_matches(s, '\p{{L}}$') AND regexp_matches(n, '^\p{{L}}') THEN s || {end} ELSE s END AS line FROM wrapped),
wrapped_lines AS (SELECT doc_id, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM marked)"""


#: Printed forms that lines are set in (``%`` stands for the line), so that every rule meets what it is about.
FORMS = (
    "%", "• %", "- %", "+ %", "+ 50% %", "* %", "* * %", "− %", "a) %", "B. %", "12. %", "1999. %", "7) %", "-%", "1.%", "12.", "b)",
    "Figure 3 %", "Table 12 %", "% = 4", "% = https://a.example/?q=1", "www.a.example/x %", "— – -", "――― ", "_ _ _", "% ---", "• ", "–",
    "% half-", "way of %", "% soft\u00ad", "ly %", "% 1990–", "1999 %", "% he said—", "“%”", "% 中文", "中 文 字 %", "% سلام", "، %", "(%) [x]", ") % (", "12-3", "47", "% 123", "U. S. 45 %",
    "McDonald %", "→ %", "−→ x", "3 Heading of %", "3.2 Heading of %", "0.1 Heading of %", "Chapter 4: %", "CHAPTER  XIV. %", "chapter iiii %", "Chapter 12 - %", "Chapter mcm – %",
    "Practice %", "Some Exercises and %", "cc. %", "12345. %", "12 %", "iv", "No Author", "not available", "(2)", "7,100", "12†", "1% ad valorem.", "g12", "glyph7", "uni0041", "cid99x", "abc12",
    "Сор %", "СССР and XCM %", "MOСKBA %", "HET ПОМ %", "\tspaced   out\u00a0text %  ",
)


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, line_no, line: every line of documents, set in one of ``FORMS`` by its place."""
    lines = doc_lines(spark, sf_dir)
    form = F.get(F.array(*[F.lit(f) for f in FORMS]), F.pmod(F.coalesce("doc_id", F.lit(0)) + F.col("line_no"), F.lit(len(FORMS))).cast("int"))
    return lines.select("doc_id", "lang", "line_no", F.replace(form, F.lit("%"), F.col("line")).alias("line"))


def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, line_no, line, next_line of ``printed``."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("line_no")
    return printed(spark, sf_dir).withColumn("next_line", F.lead("line").over(order))


def _forms_sql() -> str:
    return ", ".join("'" + f.replace("'", "''") + "'" for f in FORMS)


PRINTED_LINES_SQL = (
    DOC_LINES_SQL
    + f""",
printed AS (SELECT doc_id, lang, line_no, replace(([{_forms_sql()}])[1 + CAST((coalesce(doc_id, 0) + line_no) % {len(FORMS)} AS INTEGER)], '%', line) AS line FROM doc_lines),
printed_lines AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM printed)"""
)


#: The sheet that ``layout_lines`` sets pages on, in points.
SHEET = (595.0, 842.0)


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no (from 1), row_no, text, x, y (of the foot), w, h, size, bold: documents set as a book.

    Each page has eight lines of text below a running head, with its folio at the foot; the heads of even and odd pages
    differ and every fifth page's stand a little lower.  A page's first line is a numbered section's title on even pages
    (numbers skip, or start late, in some documents) and its sixth a bold label on every third.
    """
    doc, line, row = F.coalesce("doc_id", F.lit(0)), F.col("line"), F.col("line_no") % LINES_PER_PAGE
    page = F.floor(F.col("line_no") / LINES_PER_PAGE).cast("int")
    lines = doc_lines(spark, sf_dir).where("line <> ''").select("doc_id", page.alias("p"), row.cast("int").alias("row_no"), "line", doc.alias("d"))
    title = (F.col("row_no") == 0) & (F.col("p") % 2 == 0)
    label = (F.col("row_no") == 5) & (F.col("p") % 3 == 0)
    number = F.floor(F.col("p") / 2) + 1 + F.when(F.col("d") % 11 == 0, 1).otherwise(0) + F.when((F.col("d") % 7 == 0) & (F.col("p") > 2), 4).otherwise(0)
    size = F.when(title, 16.0).when(F.length(line) % 5 == 0, 9.5).otherwise(11.0)
    text = F.when(title, F.concat(number.cast("string"), F.lit(" "), F.substring(line, 1, 30))).when(label, F.substring(line, 1, 24)).otherwise(line)
    indent = F.when(F.col("row_no") % 4 == 0, 18.0).otherwise(0.0)
    body = lines.select("doc_id", (F.col("p") + 1).alias("page_no"), "row_no", text.alias("text"), (F.lit(72.0) + indent).alias("x"), (F.lit(690.0) - F.col("row_no") * 18.0).alias("y"), size.alias("size"), (title | label).alias("bold"))
    pages = lines.select("doc_id", "p", "d").distinct()
    part = F.concat(F.lit("Part "), (F.floor(F.col("p") / 4) + 1).cast("string"), F.lit(" of the report"))
    head = F.when(F.col("p") % 2 == 0, F.concat(F.lit("Report "), F.col("d").cast("string"))).otherwise(part)
    nine, plain = F.lit(9.0).alias("size"), F.lit(False).alias("bold")
    heads = pages.select("doc_id", (F.col("p") + 1).alias("page_no"), F.lit(-1).alias("row_no"), head.alias("text"), F.lit(72.0).alias("x"), (F.lit(800.0) - F.when(F.col("p") % 5 == 4, 8.0).otherwise(0.0)).alias("y"), nine, plain)
    feet = pages.select("doc_id", (F.col("p") + 1).alias("page_no"), F.lit(99).alias("row_no"), (F.col("p") + 1).cast("string").alias("text"), F.lit(290.0).alias("x"), (F.lit(30.0) + (F.col("p") % 7) * 3.0).alias("y"), nine, plain)
    every = body.unionByName(heads).unionByName(feet)
    return every.select("*", F.least(F.lit(450.0), F.length("text") * F.col("size") * 0.5).alias("w"), (F.col("size") * 1.2).alias("h"))


LAYOUT_SQL = (
    DOC_LINES_SQL
    + f""",
set_lines AS (SELECT doc_id, coalesce(doc_id, 0) AS d, CAST(line_no // {LINES_PER_PAGE} AS INTEGER) AS p, CAST(line_no % {LINES_PER_PAGE} AS INTEGER) AS row_no, line FROM doc_lines WHERE line <> ''),
kinds AS (SELECT *, row_no = 0 AND p % 2 = 0 AS title, row_no = 5 AND p % 3 = 0 AS label FROM set_lines),
pages AS (SELECT DISTINCT doc_id, d, p FROM set_lines),
every AS (SELECT doc_id, p + 1 AS page_no, row_no, CASE WHEN title THEN CAST(p // 2 + 1 + CASE WHEN d % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN d % 7 = 0 AND p > 2 THEN 4 ELSE 0 END AS VARCHAR) || ' ' || substring(line, 1, 30) WHEN label THEN substring(line, 1, 24) ELSE line END AS text,
   72.0 + CASE WHEN row_no % 4 = 0 THEN 18.0 ELSE 0.0 END AS x, 690.0 - row_no * 18.0 AS y, CASE WHEN title THEN 16.0 WHEN length(line) % 5 = 0 THEN 9.5 ELSE 11.0 END AS size, title OR label AS bold FROM kinds
  UNION ALL SELECT doc_id, p + 1, -1, CASE WHEN p % 2 = 0 THEN 'Report ' || d ELSE 'Part ' || (p // 4 + 1) || ' of the report' END, 72.0, 800.0 - CASE WHEN p % 5 = 4 THEN 8.0 ELSE 0.0 END, 9.0, false FROM pages
  UNION ALL SELECT doc_id, p + 1, 99, CAST(p + 1 AS VARCHAR), 290.0, 30.0 + (p % 7) * 3.0, 9.0, false FROM pages),
layout_lines AS (SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, CAST(row_no AS INTEGER) AS row_no, text, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(size AS DOUBLE) AS size, bold, least(450.0, length(text) * CAST(size AS DOUBLE) * 0.5) AS w, CAST(size AS DOUBLE) * 1.2 AS h FROM every)"""
)


def list_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, page, kind, text, recognized, edge, size: lines as blocks, each five in a row a list of one kind, or prose.

    Numbers skip in every seventh group; each page opens with its mark, and every fifth page with a heading.
    """
    lines = doc_lines(spark, sf_dir).where("line <> ''")
    n, doc = F.col("line_no"), F.coalesce("doc_id", F.lit(0))
    group, at = F.floor(n / 5), n % 5
    family = (doc + group) % 6
    value = at + 1 + F.when(((doc + group) % 7 == 3) & (at >= 2), 1).otherwise(0)
    letter = F.get(F.array(*[F.lit(c) for c in "abcdef"]), value.cast("int") - 1)
    marker = F.when(family == 0, "• ").when(family == 1, F.concat(value.cast("string"), F.lit(". "))).when(family == 2, F.concat(value.cast("string"), F.lit(") "))).when(family == 3, F.concat(letter, F.lit(". "))).when(family == 4, "- ")
    page = (F.floor(n / LINES_PER_PAGE) + 1).cast("int")
    text = F.concat(F.coalesce(marker, F.lit("")), "line")
    items = lines.select("doc_id", (n * 3 + 2).cast("int").alias("seq"), page.alias("page"), F.when(marker.isNull(), "paragraph").otherwise("preformatted").alias("kind"), text.alias("text"), F.lit(False).alias("recognized"), F.when(family == 3, 90.0).otherwise(72.0).alias("edge"), F.lit(11.0).alias("size"))
    first = items.groupBy("doc_id", "page").agg(F.min("seq").alias("s"))
    none = F.lit(None).cast("double")
    marks = first.select("doc_id", (F.col("s") - 2).alias("seq"), "page", F.lit("page").alias("kind"), F.lit("").alias("text"), F.lit(False).alias("recognized"), none.alias("edge"), none.alias("size"))
    heads = first.where("page % 5 = 0").select("doc_id", (F.col("s") - 1).alias("seq"), "page", F.lit("heading").alias("kind"), F.lit("Some Exercises").alias("text"), F.lit(False).alias("recognized"), none.alias("edge"), none.alias("size"))
    return items.unionByName(marks).unionByName(heads)
