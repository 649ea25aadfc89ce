"""Named queries over the provided tables, each with the same result in plain SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as X
from . import sources, streaming
from .functions import lines as L
from .registry import QUERIES, SQL, listed as _in, query
from .operators import checks, html_blocks, line_joins, page_layout, reading_order, text_quality

# --- text quality -----------------------------------------------------------------------------------

_STATISTICS_SQL = rf"""
WITH ew AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '\p{{L}}{{2,}}')) AS w FROM documents WHERE regexp_matches(lower(lang), '^(en|eng)([-_].*)?$')) WHERE regexp_matches(lower(w), '^[a-z]{{2,}}$')),
cp AS (SELECT pair FROM (SELECT substring(w, i, 2) AS pair FROM (SELECT w, unnest(range(1, length(w))) AS i FROM ew)) GROUP BY pair ORDER BY count(*) DESC, pair LIMIT {text_quality.COMMON_PAIRS}),
w AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '\p{{L}}{{2,}}'))) AS w FROM documents),
a AS (SELECT doc_id, count(*) AS words, count(*) FILTER (w IN ({_in(text_quality.STOP_WORDS)})) AS stops FROM w GROUP BY doc_id),
p AS (SELECT doc_id, substring(w, i, 2) AS pair FROM (SELECT doc_id, w, unnest(range(1, length(w))) AS i FROM w WHERE regexp_matches(w, '^[a-z]+$'))),
b AS (SELECT doc_id, count(*) AS pairs, count(*) FILTER (pair NOT IN (SELECT pair FROM cp)) AS rare FROM p GROUP BY doc_id),
s AS (SELECT d.doc_id, d.lang, coalesce(words, 0) AS words, round(CASE WHEN coalesce(words, 0) > 0 THEN stops / words ELSE 0.0 END, 9) AS stop_rate,
  round(CASE WHEN coalesce(pairs, 0) > 0 THEN rare / pairs ELSE 0.0 END, 9) AS rare_rate FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id))
"""


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = sources.table(spark, sf_dir, "documents")
    return text_quality.encoding_statistics(documents, text_quality.common_pairs(documents))


@query(_STATISTICS_SQL + "SELECT * FROM s")
def encoding_statistics(spark, sf_dir):
    return _statistics(spark, sf_dir)


@query(_STATISTICS_SQL + "SELECT doc_id, coalesce(regexp_matches(lower(lang), '^(en|eng)([-_].*)?$') AND words >= 20 AND stop_rate < 0.05 AND rare_rate >= 0.30, false) AS implausible FROM s")
def implausible_encoding(spark, sf_dir):
    return text_quality.implausible(_statistics(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir)


@query(f"WITH {sources.DOC_LINES_SQL}, w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[\\p{{L}}-]+') AS w FROM doc_lines) SELECT doc_id, line_no, CAST(len(w) AS INTEGER) AS n_words, lower(w[1]) AS first_word FROM w")
def line_words(spark, sf_dir):
    words = X.vocabulary_words(F.col("line"))
    return sources.doc_lines(spark, sf_dir).select("doc_id", "line_no", F.size(words).alias("n_words"), F.get(words, F.lit(0)).alias("first_word"))


@query(f"WITH {sources.DOC_LINES_SQL} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, lower(unnest(regexp_extract_all(line, '[\\p{{L}}-]+'))) AS word FROM doc_lines) GROUP BY word")
def vocabulary(spark, sf_dir):
    return text_quality.vocabulary(sources.doc_lines(spark, sf_dir))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+'), lambda t: t <> '') AS t FROM documents)
SELECT doc_id, len(t) AS tokens, len(list_filter(t, lambda x: regexp_matches(x, '[0-9]'))) AS numeric_tokens,
 len(list_filter(t, lambda x: regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '\p{L}'))) AS number_tokens FROM t""")
def numeric_tokens(spark, sf_dir):
    return text_quality.token_counts(sources.table(spark, sf_dir, "documents"))


_LETTERS = r"regexp_replace({t}, '[^\p{{L}}]', '', 'g')"
_LATIN = X.LATIN.replace("\\x{0}", "\\x{1}")


def _held(t: str, pattern: str) -> str:
    return f"(length({t}) - length(regexp_replace({t}, '{pattern}', '', 'g')))"


_T = _LETTERS.format(t="text")


@query(f"SELECT doc_id, {_held(_T, f'[{_LATIN}]')} AS latin, {_held(_T, f'[{X.RIGHT_TO_LEFT}]')} AS rtl, {_held(_T, f'[{X.RIGHT_TO_LEFT}]')} > 0 AND {_held(_T, f'[{X.RIGHT_TO_LEFT}]')} >= {_held(_T, f'[{_LATIN}]')} AS reads_rtl FROM documents")
def script_letters(spark, sf_dir):
    t = F.col("text")
    return sources.table(spark, sf_dir, "documents").select("doc_id", X.latin_letters(t).cast("bigint").alias("latin"), X.right_to_left_letters(t).cast("bigint").alias("rtl"), X.reads_right_to_left(t).alias("reads_rtl"))


@query(f"SELECT doc_id, {_held(_T, f'[^{_LATIN}]')} AS foreign_letters FROM documents")
def foreign_letters(spark, sf_dir):
    return sources.table(spark, sf_dir, "documents").select("doc_id", X.foreign_letters(F.col("text")).cast("bigint").alias("foreign_letters"))


_INK = f"regexp_replace(text, '[{L.WS}]', '', 'g')"


@query(f"SELECT doc_id, length({_INK}) + {_held(_INK, f'[{L.FULL_WIDTH}]')} AS advances FROM documents")
def text_advances(spark, sf_dir):
    return sources.table(spark, sf_dir, "documents").select("doc_id", L.advances(F.col("text")).cast("bigint").alias("advances"))


# --- line predicates ----------------------------------------------------------------------------------

_WEB = "contains(x, '://') OR starts_with(lower(x), 'www.') OR regexp_matches(x, '[?&][A-Za-z_][A-Za-z0-9_.-]*=')"
_ITEM = "coalesce(list_sum(list_transform(regexp_extract_all({t}, '\\p{{L}}{{3,}}'), lambda w: length(w))), 0)"


@query(
    f"""WITH {sources.PRINTED_LINES_SQL},
w AS (SELECT *, list_filter(regexp_split_to_array(line, '[ \\t\\r\\n]+'), lambda x: x <> '' AND NOT ({_WEB})) AS kept FROM printed_lines)
SELECT doc_id, line_no, len(regexp_extract_all(line, '\\p{{L}}{{2,}}')) >= 4 AS sentence,
 {_ITEM.format(t='line')} > 0 AND {_ITEM.format(t='line')} * 100 >= length(line) * 35 AS item,
 regexp_matches(coalesce(array_to_string(kept, ' '), ''), '=[^=]*[^= ][^=]*$') AND len(kept) <= 12 AS equation,
 regexp_matches(line, '^(Figure|Table)[ \\t]+[0-9]') AS caption, regexp_matches(regexp_replace(line, '[{L.WS}]', '', 'g'), '^[{L.STROKES}]{{2,}}$') AS rule,
 regexp_matches(line, '[\\p{{L}}\\p{{N}}][-\\x{{AD}}]$') AS broken, regexp_matches(line, '^[0-9]+(-[0-9]+)?$') AS folio FROM w"""
)
def line_predicates(spark, sf_dir):
    t = F.col("line")
    rules = (("sentence", X.reads_as_sentence), ("item", X.reads_as_item), ("equation", X.states_an_equation), ("caption", X.is_caption), ("rule", L.is_typed_rule), ("broken", X.ends_broken), ("folio", X.is_folio))
    return sources.printed_lines(spark, sf_dir).select("doc_id", "line_no", *[f(t).alias(n) for n, f in rules])


_PLUS = f"regexp_matches(t, '^\\+[ \\t]+(\\p{{L}}{{2}}|[0-9]+%)') AND {_ITEM.format(t='substring(t, 3)')} > 0 AND {_ITEM.format(t='substring(t, 3)')} * 100 >= length(substring(t, 3)) * 35"


@query(
    f"""WITH {sources.PRINTED_LINES_SQL}, v AS (SELECT doc_id, line_no, line AS t FROM printed_lines),
f AS (SELECT doc_id, line_no, t, CASE WHEN regexp_matches(t, '^[\\x{{2022}}*+-][ \\t]') AND NOT regexp_matches(t, '^\\*[ \\t]+\\*') AND (NOT starts_with(t, '+') OR ({_PLUS})) THEN 'bullet'
 WHEN regexp_matches(t, '^[A-Za-z][.)][ \\t]+') THEN 'letter' WHEN regexp_matches(t, '^[0-9]{{1,3}}[.)][ \\t]+') THEN 'number' END AS family FROM v)
SELECT doc_id, line_no, family, CASE family WHEN 'letter' THEN ascii(lower(t)) - 96 WHEN 'number' THEN CAST(regexp_extract(t, '^([0-9]{{1,3}})', 1) AS INTEGER) END AS value FROM f"""
)
def list_markers(spark, sf_dir):
    return sources.printed_lines(spark, sf_dir).select("doc_id", "line_no", X.marker_family(F.col("line")).alias("family"), X.marker_value(F.col("line")).alias("value"))


@query(
    f"""WITH {sources.PRINTED_LINES_SQL}, s AS (SELECT doc_id, line_no, regexp_replace(line, '^[ ()*\\x{{2020}}\\x{{2021}}]+|[ ()*\\x{{2020}}\\x{{2021}}]+$', '', 'g') AS s FROM printed_lines)
SELECT doc_id, line_no, s <> '' AND (regexp_matches(s, '^[-\\x{{2013}}\\x{{2014}}]+$') OR (regexp_matches(s, '\\p{{N}}') AND {_held('s', '\\p{L}')} <= 1)) AS is_value FROM s"""
)
def value_cells(spark, sf_dir):
    return sources.printed_lines(spark, sf_dir).select("doc_id", "line_no", X.is_value(F.col("line")).alias("is_value"))


_CLEAN = "trim(regexp_replace(regexp_replace({t}, '[\\x{{1}}-\\x{{8}}\\x{{B}}\\x{{C}}\\x{{E}}-\\x{{1F}}\\x{{FFFE}}\\x{{FFFF}}]', '', 'g'), '[ \\t\\r\\n\\x{{A0}}]+', ' ', 'g'))"


@query(
    f"""WITH {sources.PRINTED_LINES_SQL}, c AS (SELECT doc_id, line_no, line, {_CLEAN.format(t='line')} AS s FROM printed_lines)
SELECT doc_id, line_no, CASE WHEN length(line) <= 4000 AND length(s) <= 1000 AND regexp_matches(s, '[\\p{{L}}\\p{{N}}]') AND lower(s) NOT IN ({_in(X.PLACEHOLDERS)}) THEN s END AS title FROM c"""
)
def stated_values(spark, sf_dir):
    return sources.printed_lines(spark, sf_dir).select("doc_id", "line_no", X.stated(F.col("line")).alias("title"))


@query(
    f"""WITH {sources.DOC_LINES_SQL}, k AS (SELECT doc_id, line_no, i, {_CLEAN.format(t='p[i]')} AS k FROM (SELECT doc_id, line_no, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, line_no, regexp_split_to_array(line, '[,;]') AS p FROM doc_lines))),
g AS (SELECT doc_id, lower(k) AS l, arg_min(k, line_no * 1000000 + i) AS k, min(line_no * 1000000 + i) AS i FROM k WHERE regexp_matches(k, '[\\p{{L}}\\p{{N}}]') AND length(k) <= 1000 AND lower(k) NOT IN ({_in(X.PLACEHOLDERS)}) GROUP BY doc_id, lower(k)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o FROM g)
SELECT doc_id, CAST(o AS INTEGER) AS ord, k AS keyword FROM r WHERE o <= 64"""
)
def keyword_distinct(spark, sf_dir):
    from pyspark.sql import Window

    parts = sources.doc_lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode(F.split("line", "[,;]")).alias("i", "p"))
    at = F.col("line_no").cast("bigint") * 1_000_000 + F.col("i") + 1
    said = parts.select("doc_id", at.alias("i"), X.stated(F.col("p")).alias("k")).where("k IS NOT NULL")
    once = said.groupBy("doc_id", F.lower("k").alias("l")).agg(F.min_by("k", "i").alias("keyword"), F.min("i").alias("i"))
    ranked = once.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")))
    return ranked.where("ord <= 64").select("doc_id", "ord", "keyword")


# --- pages --------------------------------------------------------------------------------------------

_SIG = "CASE WHEN length(line) < 100 THEN regexp_replace(lower(line), '[0-9]+', '#', 'g') END"


@query(
    f"""WITH {sources.DOC_LINES_SQL}, m AS (SELECT DISTINCT lang, doc_id, {_SIG} AS signature FROM doc_lines),
t AS (SELECT lang, count(DISTINCT doc_id) AS docs FROM doc_lines GROUP BY lang)
SELECT lang, signature, count(*) AS n_docs FROM m JOIN t USING (lang) WHERE signature <> '' GROUP BY lang, signature, docs HAVING count(*) >= greatest(3, floor((docs + 1) / 200))"""
)
def recurring_lines(spark, sf_dir):
    return page_layout.recurring_lines(sources.doc_lines(spark, sf_dir))


@query(
    f"""WITH {sources.DOC_PAGES_SQL}, n AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM doc_pages GROUP BY doc_id)
SELECT doc_id, row_no, count(DISTINCT page_no) AS filled FROM doc_pages JOIN n USING (doc_id) GROUP BY doc_id, row_no, pages HAVING count(DISTINCT page_no) >= greatest(6, ceil(pages / 4))"""
)
def margin_slots(spark, sf_dir):
    return page_layout.margin_slots(sources.doc_pages(spark, sf_dir))


@query(
    f"""WITH {sources.DOC_PAGES_SQL}, w AS (SELECT doc_id, size, CAST(sum(length(line)) AS BIGINT) AS chars, count(*) AS lines FROM doc_pages GROUP BY doc_id, size),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, size) AS k FROM w)
SELECT doc_id, CAST(size AS DOUBLE) AS size, chars, lines >= 3 AND chars >= 200 AS established FROM r WHERE k = 1"""
)
def body_size(spark, sf_dir):
    return page_layout.body_size(sources.doc_pages(spark, sf_dir))


@query(
    f"""WITH {sources.DOC_PAGES_SQL}, s AS (SELECT doc_id, size, y - lead(y) OVER (PARTITION BY doc_id, page_no, size, x ORDER BY y DESC) AS step FROM doc_pages),
b AS (SELECT doc_id, CAST(round(step * 2) AS INTEGER) AS half_points, count(*) AS pairs FROM s WHERE step <= 3 * size GROUP BY ALL HAVING count(*) >= 4),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pairs DESC, half_points) AS k FROM b) SELECT doc_id, half_points, pairs FROM r WHERE k = 1"""
)
def stated_leading(spark, sf_dir):
    return page_layout.stated_leading(sources.doc_pages(spark, sf_dir))


@query(f"WITH {sources.DOC_PAGES_SQL} SELECT doc_id, CAST(round(size * 2) AS INTEGER) AS size_key, count(DISTINCT page_no) AS n_pages FROM doc_pages WHERE bold GROUP BY ALL HAVING count(DISTINCT page_no) >= 3")
def label_styles(spark, sf_dir):
    return page_layout.label_styles(sources.doc_pages(spark, sf_dir))


# --- line joins ---------------------------------------------------------------------------------------

_SUBS = _in(line_joins.SUBSTITUTES)


@query(
    f"""WITH {sources.wrapped_lines_sql('=')}, e AS (SELECT DISTINCT doc_id, line_no, line, next_line, mark FROM (SELECT *, unnest(string_split(line, '')) AS mark FROM wrapped_lines) WHERE mark IN ({_SUBS})),
f AS (SELECT *, length(line) - length(replace(line, mark, '')) AS uses, regexp_matches(line, '\\p{{L}}.$') AND right(line, 1) = mark AS final FROM e),
t AS (SELECT doc_id, mark, sum(uses) AS total, count(*) FILTER (final) AS fin, count(*) FILTER (final AND next_line IS NOT NULL) AS cont, count(*) FILTER (final AND regexp_matches(next_line, '^\\p{{Ll}}')) AS low FROM f GROUP BY ALL),
q AS (SELECT * FROM t WHERE total >= 8 AND fin * 100 >= total * 95 AND low * 10 >= cont * 9)
SELECT doc_id, min(mark) AS mark, CAST(min(total) AS BIGINT) AS total FROM q GROUP BY doc_id HAVING count(*) = 1"""
)
def line_end_substitute(spark, sf_dir):
    return line_joins.line_end_substitute(sources.wrapped_lines(spark, sf_dir, "="))


_CASES = " ".join(
    f"WHEN {when} THEN '{then}'"
    for when, then in (
        ("ends_with(line, '\u00ad')", "remove"),
        (f"(regexp_matches(line, '[{L.FULL_WIDTH}][{L.WS}]*$') AND regexp_matches(n, '^[{L.WS}]*[{L.FULL_WIDTH}]'))", "concatenate"),
        (f"(regexp_matches(line, '[{L.CLOSES_UP}]–$') AND regexp_matches(n, '^[{L.CLOSES_UP}]'))", "concatenate"),
        (f"(regexp_matches(line, '[^{L.WS}\\p{{Pd}}]—$') AND regexp_matches(n, '^[{L.CLOSES_UP}\"''\\p{{Pi}}]'))", "concatenate"),
        ("NOT ends_with(line, '-')", "space"),
        ("j.word IS NOT NULL AND c.word IS NULL AND (regexp_matches(n, '^\\p{Ll}') OR (length(p) >= 2 AND length(s) >= 2))", "remove"),
    )
)
_DECIDED_SQL = (
    sources.wrapped_lines_sql(planted=True)
    + rf""",
words AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[\p{{L}}-]+'))) AS word FROM documents WHERE text IS NOT NULL),
asked AS (SELECT doc_id, line_no, line, next_line AS n, CASE WHEN ends_with(line, '-') THEN lower(regexp_extract(line, '(\p{{L}}*)-$', 1)) END AS p, lower(regexp_extract(next_line, '^(\p{{L}}*)', 1)) AS s FROM wrapped_lines WHERE next_line IS NOT NULL),
decided AS (SELECT a.doc_id, a.line_no, CASE {_CASES} ELSE 'concatenate' END AS operation
  FROM asked a LEFT JOIN words j ON j.doc_id = a.doc_id AND j.word = p || s LEFT JOIN words c ON c.doc_id = a.doc_id AND c.word = p || '-' || s)"""
)


@query(f"WITH {_DECIDED_SQL} SELECT * FROM decided")
def hyphen_join(spark, sf_dir):
    return line_joins.hyphen_join(sources.wrapped_texts(spark, sf_dir, planted=True))


@query(
    f"""WITH {_DECIDED_SQL}, t AS (SELECT w.doc_id, string_agg(CASE operation WHEN 'remove' THEN left(line, length(line) - 1) WHEN 'space' THEN line || ' ' ELSE line END, '' ORDER BY w.line_no) AS t
 FROM wrapped_lines w LEFT JOIN decided USING (doc_id, line_no) GROUP BY w.doc_id) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM t"""
)
def paragraph_join(spark, sf_dir):
    return line_joins.paragraph_join(sources.wrapped_texts(spark, sf_dir, planted=True))


@query(
    r"""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn, coalesce(NOT regexp_matches(text, '[.!?:]$') AND regexp_matches(n, '^\p{Ll}'), false) AS continues FROM p WHERE n IS NOT NULL"""
)
def continuation_pairs(spark, sf_dir):
    return line_joins.continuation_pairs(sources.table(spark, sf_dir, "conversations"))


# --- pages of the web -----------------------------------------------------------------------------------


@query(f"SELECT page_id, kind, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '{html_blocks.BLOCK}', 1)) AS kind FROM pages) GROUP BY ALL")
def page_blocks(spark, sf_dir):
    return html_blocks.block_counts(sources.table(spark, sf_dir, "pages"))


@query(
    r"""WITH t AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1), CASE WHEN url IS NULL THEN [] ELSE [url, upper(substring(url, 1, 5)) || substring(url, 6), url || ' x', url || chr(2), url || repeat('x', 2000), 'mailto:' || page_id || '@example.org', 'ftp:' || url] END)) AS target FROM pages WHERE html IS NOT NULL)
SELECT DISTINCT page_id, target, regexp_matches(lower(target), '^(https?|mailto):') AND length(target) <= 2000 AND NOT regexp_matches(target, '[\x{0}-\x{20}\x{85}\x{A0}\x{2028}\x{2029}\x{3000}\x{FFFE}\x{FFFF}]') AS external FROM t WHERE target <> ''"""
)
def link_targets(spark, sf_dir):
    # a page's links are relative: its own address, and spoilt forms of it, are judged beside them
    url = F.col("url")
    made = F.array(url, F.concat(F.upper(F.substring(url, 1, 5)), F.substring(url, 6, 1 << 30)), F.concat(url, F.lit(" x")), F.concat(url, F.lit("\x02")), F.concat(url, F.repeat(F.lit("x"), 2000)), F.concat(F.lit("mailto:"), F.col("page_id").cast("string"), F.lit("@example.org")), F.concat(F.lit("ftp:"), url))
    return html_blocks.link_targets(sources.table(spark, sf_dir, "pages").withColumn("more", F.when(url.isNotNull(), made)))


@query(r"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM pages WHERE html IS NOT NULL)")
def page_text(spark, sf_dir):
    return html_blocks.plain_text_length(sources.table(spark, sf_dir, "pages"))


# --- checks -----------------------------------------------------------------------------------------------


@query("WITH p(phrase) AS (VALUES " + ", ".join(f"('{p}')" for p in checks.CONTRACT) + ") SELECT phrase, (SELECT count(*) FROM documents WHERE contains(lower(text), phrase)) AS n_docs FROM p")
def contract_checks(spark, sf_dir):
    return checks.contract_checks(sources.table(spark, sf_dir, "documents"))


@query(
    """WITH a AS (SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 3 THEN text || '.' ELSE text END) AS digest FROM documents WHERE doc_id % 10 <> 2)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.digest IS DISTINCT FROM b.digest"""
)
def run_diff(spark, sf_dir):
    # two made-up runs over the whole table: one lacks some documents, the other lacks others and changes some
    documents = sources.table(spark, sf_dir, "documents")
    before = documents.where("doc_id % 10 <> 1").select("doc_id", F.md5("text").alias("digest"))
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return checks.run_diff(before, documents.where("doc_id % 10 <> 2").select("doc_id", F.md5(changed).alias("digest")))


_BLOCKS = "CASE WHEN length(line) < 40 THEN 'heading' ELSE 'paragraph' END"


@query(
    """WITH t AS (SELECT user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events)
SELECT user_id, count(*) AS n_breaks FROM t WHERE value < top GROUP BY user_id"""
)
def progress_monotone(spark, sf_dir):
    return streaming.progress_breaks(sources.table(spark, sf_dir, "events"))


# --- lists, notes, order, text repairs ------------------------------------------------------------------

_ITEMS = "SELECT doc_id, page_no, row_no + 8 * page_no AS seq, CASE WHEN length(line) % 3 = 0 THEN 'letter' ELSE 'number' END AS family, CASE WHEN row_no % 6 = 0 THEN 1 ELSE length(line) % 4 + row_no END AS value FROM {lines}"


@query()
def page_order(spark, sf_dir):
    # two columns: even rows stand left, odd rows right
    lines = sources.doc_pages(spark, sf_dir)
    right = F.col("row_no") % 2
    return reading_order.reading_order(lines.select("doc_id", "page_no", "row_no", (F.lit(72.0) + right * 240.0).alias("x"), (F.lit(700.0) - F.floor(F.col("row_no") / 2) * 14.0).alias("y"), F.lit(200.0).alias("w"), F.lit(11.0).alias("h")))


_XML = "regexp_replace(html, '[\\x{1}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{FFFE}\\x{FFFF}]', '', 'g')"
for _plain, _escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
    _XML = f"replace({_XML}, '{_plain}', '{_escaped}')"


@query(f"SELECT page_id, md5({_XML}) AS digest FROM pages")
def xml_text(spark, sf_dir):
    return sources.table(spark, sf_dir, "pages").select("page_id", F.md5(X.xml_text(F.col("html"))).alias("digest"))


from . import catalog_blocks, catalog_compare, catalog_geometry, catalog_judges, catalog_layout, catalog_rules  # noqa: E402, F401  (they register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
