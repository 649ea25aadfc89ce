"""Queries of the line rules, over every line of documents set in the printed forms of ``sources.FORMS``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import functions as X
from . import sources
from .functions import lines as L
from .registry import listed, query

_CLEAN = f"trim(regexp_replace(regexp_replace({{t}}, '[\\x{{{{1}}}}-\\x{{{{8}}}}\\x{{{{B}}}}\\x{{{{C}}}}\\x{{{{E}}}}-\\x{{{{1F}}}}\\x{{{{FFFE}}}}\\x{{{{FFFF}}}}]', '', 'g'), '[{L.WS.replace('{', '{{').replace('}', '}}')}]+', ' ', 'g'))"


def _held(t: str, pattern: str) -> str:
    return f"(length({t}) - length(regexp_replace({t}, '{pattern}', '', 'g')))"


def _m(t: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({t}, '{quoted}')"


def _squeezed(t: str) -> str:
    return f"regexp_replace({t}, '[{L.WS}]', '', 'g')"


def _collapsed(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{L.WS}]+', ' ', 'g'))"


_ITEM = "coalesce(list_sum(list_transform(regexp_extract_all({t}, '\\p{{L}}{{3,}}'), lambda w: length(w))), 0)"
_PLUS_BODY = _ITEM.format(t="substring(line, 3)")
_PLUS = f"{_m('line', rf'^[+][{L.WS}]+(\p{{L}}{{2}}|[0-9]+%)')} AND {_PLUS_BODY} > 0 AND {_PLUS_BODY} * 100 >= length(substring(line, 3)) * 35"


@query(
    f"""WITH {sources.PRINTED_LINES_SQL}
SELECT doc_id, line_no, {_m('line', L.LIST)} AS is_list, {_m('line', L.MARKED)} AS marked, {_m('trim(line)', f'^[{L.BULLET_GLYPHS}]$')} AS bullet_glyph,
 {_m('line', L.OPENS_BULLET)} AS opens_bullet, {_PLUS} AS plus_bullet,
 CASE WHEN {_m('line', rf'^([0-9]+|[A-Za-z])[.)][{L.WS}]')} THEN (CASE WHEN {_m('line', '^[0-9]')} THEN 'number' ELSE 'letter' END) || regexp_extract(line, '^([0-9]+|[A-Za-z])([.)])', 2) END AS kind,
 CASE WHEN {_m('line', '^([0-9]+|[A-Za-z])[.)]$')} THEN (CASE WHEN {_m('line', '^[0-9]')} THEN 'number' ELSE 'letter' END) || right(line, 1) END AS whole_kind,
 CASE WHEN {_m('line', L.MARKED)} THEN CASE WHEN {_m('line', '^[0-9]')} THEN TRY_CAST(regexp_extract(line, '^([0-9]+)', 1) AS BIGINT) ELSE CAST(ascii(lower(line)) AS BIGINT) END END AS marked_value,
 CASE WHEN {_m('line', L.ENDNOTE)} THEN regexp_extract(line, '^([A-Za-z0-9]{{1,4}}\\.)', 1) END AS endnote,
 CASE WHEN {_m('line', L.FOOTNOTE)} AND {_held('line', r'\p{L}')} > 0 THEN CAST(regexp_extract(line, '^([1-9][0-9]{{0,2}})', 1) AS INTEGER) END AS footnote FROM printed_lines"""
)
def printed_markers(spark, sf_dir):
    t = F.col("line")
    return sources.printed_lines(spark, sf_dir).select(
        "doc_id", "line_no", t.rlike(L.LIST).alias("is_list"), t.rlike(L.MARKED).alias("marked"), L.is_bullet_glyph(t).alias("bullet_glyph"), t.rlike(L.OPENS_BULLET).alias("opens_bullet"), L.is_plus_bullet(t).alias("plus_bullet"),
        L.marker_kind(t).alias("kind"), L.marker_kind(t, whole=True).alias("whole_kind"), L.marked_value(t).alias("marked_value"), L.endnote_marker(t).alias("endnote"), L.footnote_number(t).alias("footnote"),
    )


_ROMAN = "CAST(" + " + ".join(f"(length(v) - length(replace(v, '{s}', ''))) // {len(s)} * {n}" for s, n in (("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1))) + "".join(f" - (length(v) - length(replace(v, '{s}', ''))) // {len(s)} * {2 * n}" for s, n in (("IV", 1), ("IX", 1), ("XL", 10), ("XC", 10), ("CD", 100), ("CM", 100))) + " AS INTEGER)"
_DIGITS = "regexp_matches(numeral, '^[0-9]+$')"


@query(
    f"""WITH {sources.PRINTED_LINES_SQL},
c AS (SELECT *, {_collapsed('line')} AS label FROM printed_lines), n AS (SELECT *, regexp_extract(label, '{L.CHAPTER}', 2) AS numeral, trim(regexp_extract(label, '{L.CHAPTER}', 4)) AS title FROM c),
u AS (SELECT *, upper(numeral) AS v FROM n), r AS (SELECT *, CASE WHEN {_DIGITS} THEN TRY_CAST(numeral AS INTEGER) WHEN v <> '' AND {_m('v', L.CANONICAL)} THEN {_ROMAN} END AS number FROM u),
f AS (SELECT *, length(line) <= 512 AND {_m('label', L.CHAPTER)} AND number IS NOT NULL AND title <> '' AS fits FROM r),
s AS (SELECT *, regexp_extract(line, '{L.SECTION}', 1) AS section, regexp_replace(line, '^[0-9.]+[{L.WS}]+', '') AS rest, {_CLEAN.format(t='line')} AS clean FROM f)
SELECT doc_id, line_no, CASE WHEN fits THEN number END AS chapter, CASE WHEN fits THEN title END AS chapter_title, CASE WHEN fits AND NOT {_DIGITS} THEN 'chapter ' || lower(numeral) END AS chapter_marker,
 CASE WHEN {_m('line', L.SECTION)} AND length(line) <= 120 AND {_held('rest', r'\p{L}')} >= 3 AND NOT {_m('section', r'(^|[.])0+([.]|$)')} THEN section END AS section,
 CASE WHEN length(line) <= 4000 AND length(clean) <= 32 AND {_m('clean', r'[\p{L}\p{N}]')} AND lower(clean) NOT IN ({listed(X.PLACEHOLDERS)}) THEN clean END AS page_label,
 CASE WHEN length(line) <= 2048 AND length(clean) <= 512 AND {_m('clean', r'[\p{L}\p{N}]')} THEN clean END AS outline_title,
 lower(label) AS normal, {_m('lower(line)', L.EXERCISE)} AS exercises FROM s"""
)
def printed_titles(spark, sf_dir):
    t = F.col("line")
    named = sources.printed_lines(spark, sf_dir).withColumn("chapter", L.chapter_label(t))
    return named.select(
        "doc_id", "line_no", F.col("chapter.number").alias("chapter"), F.col("chapter.title").alias("chapter_title"), F.col("chapter.marker").alias("chapter_marker"), L.section_number(t).alias("section"),
        L.page_label(t).alias("page_label"), L.outline_title(t).alias("outline_title"), L.normal_phrase(t).alias("normal"), L.names_exercises(t).alias("exercises"),
    )


_TWO = "regexp_extract_all(lower(line), '[a-z]+')"
_NEAR = "(a = b OR (abs(length(a) - length(b)) <= greatest(1, least(length(a), length(b)) // {d}) AND levenshtein(a, b) <= greatest(1, least(length(a), length(b)) // {d})))"
_HUNDREDTHS = "CAST(floor(least(1.0, greatest(0.0, share)) * 10000 + 0.5) AS BIGINT)"
_GLYPH = "regexp_extract(line, '^(\\p{L}+)[0-9]+$', 1)"


@query(
    f"""WITH {sources.PRINTED_LINES_SQL},
p AS (SELECT *, {_TWO}[1] AS a, {_TWO}[2] AS b, CASE WHEN length(line) = 0 THEN 0.0 ELSE {_held('line', r'\p{L}')} / length(line) END AS share, regexp_extract_all(line, '[(){{}}\\[\\]]') AS br FROM printed_lines)
SELECT doc_id, line_no, {_m(_squeezed('line'), f'^[{L.STROKES}]{{2,}}$')} AS typed_rule, {_m('line', L.RULE_END)} AS ends_on_rule, {_m('line', L.ARROW)} AS arrow, {_m('line', '^[0-9]+(-[0-9]+)?$')} AS folio,
 {_m("regexp_extract(line, '^(\\p{L}+)', 1)", r'^(\p{Lu}\p{Ll}+){2,}$')} AS compound_name, {_m('line', L.GLYPH_NAME)} AND lower({_GLYPH}) NOT IN ('u', 'uni') AND (length({_GLYPH}) <= 2 OR lower({_GLYPH}) IN ({listed(L.GLYPH_PREFIXES)})) AS index_glyph,
 CAST({_HUNDREDTHS} // 100 AS VARCHAR) || '.' || lpad(CAST({_HUNDREDTHS} % 100 AS VARCHAR), 2, '0') || '%' AS letters, CAST(length({_squeezed('line')}) + {_held(_squeezed('line'), f'[{L.FULL_WIDTH}]')} AS INTEGER) AS advances,
 coalesce({_NEAR.format(d=2)}, false) AS nearly_two, coalesce({_NEAR.format(d=5)}, false) AS nearly_five,
 coalesce(list_min(list_transform(range(1, len(br) + 1), lambda i: list_sum(list_transform(br[1:i], lambda c: CASE WHEN c IN ('(', '[', '{{') THEN 1 ELSE -1 END)))) < 0, false) AND {_m('line', r'[(\[{]')} AS visual_order FROM p"""
)
def printed_shapes(spark, sf_dir):
    t = F.col("line")
    words = X.runs(F.lower(t), "[a-z]+")
    two = sources.printed_lines(spark, sf_dir).select("*", F.get(words, F.lit(0)).alias("a"), F.get(words, F.lit(1)).alias("b"))
    share = F.when(F.length(t) == 0, 0.0).otherwise(X.held(t, r"\p{L}") / F.length(t))
    near = lambda d: F.coalesce(L.nearly(F.col("a"), F.col("b"), d), F.lit(False))
    return two.select(
        "doc_id", "line_no", L.is_typed_rule(t).alias("typed_rule"), t.rlike(L.RULE_END).alias("ends_on_rule"), t.rlike(L.ARROW).alias("arrow"), X.is_folio(t).alias("folio"),
        X.is_compound_name(F.regexp_extract(t, r"^(\p{L}+)", 1)).alias("compound_name"), L.is_index_glyph_name(t).alias("index_glyph"), L.percent(share).alias("letters"), L.advances(t).alias("advances"),
        near(2).alias("nearly_two"), near(5).alias("nearly_five"), L.reads_visual_order(t).alias("visual_order"),
    )


def _repair_sql(kind: str) -> str:
    if kind == "latin":
        mapped = f"translate(x, '{L.LATIN_FOR[0]}', '{L.LATIN_FOR[1]}')"
        one = f"CASE WHEN regexp_matches({mapped}, '[{L.CYRILLIC}]') THEN x ELSE {mapped} END"
    else:
        latin = "regexp_replace(x, '[^A-Za-z]', '', 'g')"
        one = f"CASE WHEN regexp_matches({latin}, '^[{L.CYRILLIC_FOR[0]}]+$') AND (regexp_matches(x, '[{L.CYRILLIC}]') OR (regexp_matches({latin}, '^[A-Z]+$') AND NOT regexp_matches({latin}, '^[XCM]+$'))) THEN translate(x, '{L.CYRILLIC_FOR[0]}', '{L.CYRILLIC_FOR[1]}') ELSE x END"
    return f"array_to_string(list_transform(string_split(line, ' '), lambda x: {one}), ' ')"


_IDEO = f"([{L.IDEOGRAPHS}]) +([{L.IDEOGRAPHS}])"


@query(
    f"""WITH {sources.PRINTED_LINES_SQL}, p AS (SELECT doc_id, line_no, line, CASE WHEN (coalesce(doc_id, 0) + line_no) % 3 = 0 THEN 'ru-RU' ELSE lang END AS lang FROM printed_lines),
r AS (SELECT *, {_repair_sql('latin')} AS latin, {_repair_sql('cyrillic')} AS cyrillic FROM p)
SELECT doc_id, line_no, latin, cyrillic, CASE WHEN regexp_matches(lower(lang), '^(en|eng)([-_].*)?$') THEN latin WHEN regexp_extract(lower(lang), '^([^-_]*)', 1) IN ({listed(L.CYRILLIC_LANGUAGES)}) THEN cyrillic ELSE line END AS repaired,
 CASE WHEN length(line) > 2 THEN regexp_replace(regexp_replace(line, '{_IDEO}', '\\1\\2', 'g'), '{_IDEO}', '\\1\\2', 'g') ELSE line END AS joined FROM r"""
)
def repaired_scripts(spark, sf_dir):
    t = F.col("line")
    # every third line is declared Russian, so that all three branches of the dispatcher are taken
    lang = F.when((F.coalesce("doc_id", F.lit(0)) + F.col("line_no")) % 3 == 0, "ru-RU").otherwise(F.col("lang"))
    return sources.printed_lines(spark, sf_dir).select("doc_id", "line_no", L.latin_repaired(t).alias("latin"), L.cyrillic_repaired(t).alias("cyrillic"), L.repaired_script(t, lang).alias("repaired"), L.joined_ideographs(t).alias("joined"))


_EN, _EM = (_m("line", f"[{L.CLOSES_UP}]–$") + " AND " + _m("n", f"^[{L.CLOSES_UP}]")), (_m("line", rf"[^{L.WS}\p{{Pd}}]—$") + " AND " + _m("n", rf"^[{L.CLOSES_UP}\"'\p{{Pi}}]"))
_CJK = _m("line", f"[{L.FULL_WIDTH}][{L.WS}]*$") + " AND " + _m("n", f"^[{L.WS}]*[{L.FULL_WIDTH}]")
_RTL = _m("line", rf"[{L.RTL_LETTERS}][{L.WS}]*$") + f" AND regexp_matches(regexp_extract(line, '(.)[{L.WS}]*$', 1), '\\p{{L}}') AND " + _m("n", "^[" + L.WS + "]*[" + L.ATTACHING.replace("]", "\\]") + "]")


@query(
    f"""WITH {sources.PRINTED_LINES_SQL}, p AS (SELECT doc_id, line_no, line, next_line AS n FROM printed_lines WHERE next_line IS NOT NULL)
SELECT doc_id, line_no, {_EN} AS en_dash, {_EM} AS em_dash, {_CJK} AS wide, {_RTL} AS arabic, {_m('line', L.CITES_LEFT)} AND {_m('n', L.CITES_RIGHT)} AS citation,
 {_m('line', '[-­]$')} AND {_m('n', r'^\p{Ll}')} AS broken_word FROM p"""
)
def printed_pairs(spark, sf_dir):
    """Only what the rules read of a line's two ends is dealt to find the next one, not its text."""
    line, order = F.col("line"), Window.partitionBy("doc_id").orderBy("line_no")
    ends = sources.printed(spark, sf_dir).select("doc_id", "line_no", L.last_of(line).alias("end"), L.first_of(line).alias("begin"))
    a, b = F.col("end"), F.col("next")
    return ends.select("doc_id", "line_no", "end", F.lead("begin").over(order).alias("next")).where("next IS NOT NULL").select(
        "doc_id", "line_no", L.breaks_at_closed_en_dash(a, b).alias("en_dash"), L.breaks_at_closed_em_dash(a, b).alias("em_dash"), L.wide_without_space(a, b).alias("wide"), L.arabic_without_space(a, b).alias("arabic"),
        L.continues_citation(a, b).alias("citation"), (a.rlike(r"[-­]\z") & b.rlike(r"^\p{Ll}")).alias("broken_word"),
    )


_EDGES = "list_distinct(list_concat([w[1], w[-1]], CASE WHEN len(w) >= 3 AND w[-2] = 'of' AND regexp_matches(w[-1], '^[0-9]{1,9}$') THEN [w[-3]] ELSE [] END))"


@query(
    f"""WITH {sources.PRINTED_LINES_SQL}, w AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[{L.WS}]+'), lambda t: t <> '') AS w FROM printed_lines),
e AS (SELECT doc_id, line_no, unnest({_EDGES}) AS t FROM w WHERE len(w) > 0),
v AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(t, '^[0-9]{{1,9}}$') THEN CAST(t AS BIGINT) WHEN regexp_matches(t, '^[^-]+-[0-9]{{1,9}}$') THEN CAST(regexp_extract(t, '-([0-9]+)$', 1) AS BIGINT) END AS value FROM e)
SELECT DISTINCT doc_id, line_no, value - line_no // {sources.LINES_PER_PAGE} - 1 AS "offset" FROM v WHERE value IS NOT NULL"""
)
def boundary_offsets(spark, sf_dir):
    """What a line's first and last number say beyond the page's own number; ``n of m`` names n too."""
    w = F.col("w")
    of = (F.size(w) >= 3) & (F.get(w, F.size(w) - 2) == "of") & F.get(w, F.size(w) - 1).rlike("^[0-9]{1,9}$")
    edges = F.concat(F.array(F.get(w, F.lit(0)), F.get(w, F.size(w) - 1)), F.when(of, F.array(F.get(w, F.size(w) - 3))).otherwise(F.array().cast("array<string>")))
    each = sources.printed_lines(spark, sf_dir).select("doc_id", "line_no", L.tokens(F.col("line")).alias("w")).where("size(w) > 0").select("doc_id", "line_no", F.explode(F.array_distinct(edges)).alias("t"))
    value = F.when(F.col("t").rlike("^[0-9]{1,9}$"), F.col("t")).when(F.col("t").rlike("^[^-]+-[0-9]{1,9}$"), F.regexp_extract("t", "-([0-9]+)$", 1)).try_cast("bigint")
    page = F.floor(F.col("line_no") / sources.LINES_PER_PAGE) + 1
    return each.select("doc_id", "line_no", (value - page).alias("offset")).where(F.col("offset").isNotNull()).distinct()
