"""Queries that compare runs of a conversion, and of styled text."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import functions as X
from . import sources
from .operators import checks, compare, inline
from .registry import query

_RUNS = """b AS (SELECT doc_id, 'image-' || doc_id AS name, md5(coalesce(text, '')) AS sha, length(text) AS n, lang FROM documents WHERE doc_id % 10 <> 1),
c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'picture-' ELSE 'image-' END || doc_id AS name, md5(coalesce(text, '') || CASE WHEN doc_id % 10 = 5 THEN '.' ELSE '' END) AS sha, length(text) AS n, CASE WHEN doc_id % 20 = 7 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 2),
k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'yy' ELSE lang END AS lang FROM b)"""


def _runs(spark, sf_dir):
    """A baseline, a candidate and a control run made of documents: some are missing, renamed, or changed."""
    documents, d = sources.table(spark, sf_dir, "documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    before = documents.where(d % 10 != 1).select("doc_id", F.concat(F.lit("image-"), d.cast("string")).alias("name"), F.md5(text).alias("sha"), F.length("text").alias("n"), "lang")
    name = F.concat(F.when(d % 10 == 3, "picture-").otherwise("image-"), d.cast("string"))
    after = documents.where(d % 10 != 2).select("doc_id", name.alias("name"), F.md5(F.concat(text, F.when(d % 10 == 5, ".").otherwise(""))).alias("sha"), F.length("text").alias("n"), F.when(d % 20 == 7, "xx").otherwise(F.col("lang")).alias("lang"))
    return before, after, before.withColumn("lang", F.when(d % 3 == 0, "yy").otherwise(F.col("lang")))


@query(
    f"""WITH {_RUNS}, x AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS k FROM b), y AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS k FROM c)
SELECT x.name, y.name AS other, CASE WHEN x.name IS NULL THEN 'added' WHEN y.name IS NULL THEN 'removed' ELSE 'renamed' END AS change FROM x FULL JOIN y ON x.sha = y.sha AND x.k = y.k WHERE x.name IS DISTINCT FROM y.name"""
)
def image_changes(spark, sf_dir):
    before, after, _ = _runs(spark, sf_dir)
    return compare.image_changes(before.withColumn("ord", F.col("doc_id")), after.withColumn("ord", F.col("doc_id")))


_CHANGED = "SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, concat_ws(',', {f}) AS fields FROM b l FULL JOIN {r} r ON l.doc_id = r.doc_id"
_FIELDS = "CASE WHEN l.lang IS DISTINCT FROM r.lang THEN 'lang' END, CASE WHEN l.n IS DISTINCT FROM r.n THEN 'n' END, CASE WHEN l.sha IS DISTINCT FROM r.sha THEN 'sha' END"


@query(f"WITH {_RUNS}, d AS ({_CHANGED.format(f=_FIELDS, r='c')}) SELECT * FROM d WHERE fields <> ''")
def changed_fields(spark, sf_dir):
    before, after, _ = _runs(spark, sf_dir)
    return compare.changed(before, after, "doc_id", ["sha", "n", "lang"])


@query(f"WITH {_RUNS}, d AS ({_CHANGED.format(f=_FIELDS, r='c')}) SELECT * FROM d WHERE fields <> '' AND doc_id NOT IN (SELECT doc_id FROM b JOIN k USING (doc_id) WHERE b.lang IS DISTINCT FROM k.lang)")
def attributed_changes(spark, sf_dir):
    before, after, control = _runs(spark, sf_dir)
    fields = ["sha", "n", "lang"]
    return compare.attributed(compare.changed(before, after, "doc_id", fields), compare.changed(before, control, "doc_id", fields), "doc_id")


@query(
    f"""WITH {sources.DOC_LINES_SQL}, p AS (SELECT doc_id, line_no // 5 AS page_no, list((line_no + 2) // 4) AS ids FROM doc_lines GROUP BY ALL),
s AS (SELECT *, lag(ids) OVER w AS b, lead(ids) OVER w AS a FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)), e AS (SELECT *, unnest(list_distinct(ids)) AS id FROM s)
SELECT doc_id, page_no, id, coalesce(list_contains(b, id), false) AS from_before, coalesce(list_contains(a, id), false) AS goes_on FROM e"""
)
def paragraph_spans(spark, sf_dir):
    n = F.col("line_no")
    pages = sources.doc_lines(spark, sf_dir).groupBy("doc_id", F.floor(n / 5).alias("page_no")).agg(F.collect_list(F.floor((n + 2) / 4)).alias("ids"))
    return compare.paragraph_spans(pages)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(median(value), 4) AS median, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def sweep_summary(spark, sf_dir):
    return compare.summary(sources.table(spark, sf_dir, "events"), "event_type", "value")


@query(
    """WITH e AS (SELECT user_id, count(*) AS n, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM events GROUP BY user_id)
SELECT user_id, round((b - a) / (n - 1), 6) AS growth, (b - a) / (n - 1) <= 1.5 AS passes FROM e WHERE n >= 2"""
)
def growth_gate(spark, sf_dir):
    return compare.growth_gate(sources.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 1.5)


@query(
    """SELECT doc_id, CASE WHEN strlen(text) <> strlen(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END THEN 'bytes' WHEN sha256(text) <> CASE WHEN doc_id % 5 = 0 THEN sha256(text || ' ') ELSE sha256(text) END THEN 'sha256' END AS wrong FROM documents WHERE text IS NOT NULL"""
)
def verified_sources(spark, sf_dir):
    """Each document against a record of it, some of which are spoilt."""
    documents, d, t = sources.table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("doc_id"), F.col("text")
    said = F.sha2(F.when(d % 5 == 0, F.concat(t, F.lit(" "))).otherwise(t).cast("binary"), 256)
    return compare.verified(documents.select("doc_id", "text"), t, F.octet_length(t) + F.when(d % 7 == 0, 1).otherwise(0), said).select("doc_id", "wrong")


@query(
    f"""WITH {sources.DOC_LINES_SQL}, q AS (SELECT DISTINCT doc_id AS case_id, line_no // 3 AS page FROM doc_lines WHERE line_no % 2 = 0), w AS (SELECT DISTINCT doc_id AS case_id, line_no // 3 AS page FROM doc_lines WHERE length(line) % 3 <> 0)
SELECT case_id, count(*) AS required, count(w.page) AS warned, count(*) = count(w.page) AS passed FROM q LEFT JOIN w USING (case_id, page) GROUP BY case_id"""
)
def missing_warnings(spark, sf_dir):
    lines, page = sources.doc_lines(spark, sf_dir), F.floor(F.col("line_no") / 3).alias("page")
    required = lines.where("line_no % 2 = 0").select(F.col("doc_id").alias("case_id"), page).distinct()
    return compare.missing_warnings(required, lines.where("length(line) % 3 <> 0").select(F.col("doc_id").alias("case_id"), page))


# --- styled text --------------------------------------------------------------------------------------------

_STYLED = """st AS (SELECT doc_id, line_no, list_transform(range(1, len(w) + 1), lambda i: {'text': w[i] || CASE WHEN i < len(w) THEN ' ' ELSE '' END, 'style': CAST((i * 5 + line_no) % 32 AS INTEGER), 'href': CASE WHEN (i // 2 + line_no) % 4 = 0 THEN 'https://a.example/?x=1&y=' || (i // 4) END}) AS runs
  FROM (SELECT doc_id, line_no, string_split(line, ' ') AS w FROM doc_lines))"""


def _styled(spark, sf_dir):
    """Each line's words as runs of changing styles, some of them links."""
    n, w = F.col("line_no"), F.col("w")

    def run(x, i):
        k = i + 1
        text = F.concat(x, F.when(k < F.size(w), " ").otherwise(""))
        link = F.when((F.shiftright(k, 1) + n) % 4 == 0, F.concat(F.lit("https://a.example/?x=1&y="), F.shiftright(k, 2).cast("string")))
        return F.struct(text.alias("text"), ((k * 5 + n) % 32).cast("int").alias("style"), link.alias("href"))

    words = sources.doc_lines(spark, sf_dir).select("doc_id", "line_no", F.split("line", " ").alias("w"))  # a column of its own: a run asks how many there are
    return words.select("doc_id", "line_no", F.transform(w, run).alias("runs"))


def _xml(t: str) -> str:
    out = f"regexp_replace({t}, '[\\x{{1}}-\\x{{8}}\\x{{B}}\\x{{C}}\\x{{E}}-\\x{{1F}}\\x{{FFFE}}\\x{{FFFF}}]', '', 'g')"
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        out = f"replace({out}, '{plain}', '{escaped}')"
    return out


_TAGS = "CASE WHEN r.style & {bit} <> 0{more} THEN '<{tag}>' || {x} || '</{tag}>' ELSE {x} END"


def _markup_sql() -> str:
    steps, x = [], _xml("r.text")
    for i, (bit, tag, more) in enumerate(((1, "em", ""), (2, "strong", ""), (4, "u", ""), (8, "sup", ""), (16, "sub", " AND r.style & 8 = 0"))):
        steps.append(f"list_transform(m{i}, lambda r: {{'text': {_TAGS.format(bit=bit, tag=tag, more=more, x=x)}, 'style': r.style, 'href': r.href}}) AS m{i + 1}")
        x = "r.text"
    ctes, before = [], "SELECT doc_id, line_no, runs AS m0 FROM st"
    for i, step in enumerate(steps):
        ctes.append(f"k{i} AS (SELECT doc_id, line_no, {step} FROM ({before}))")
        before = f"SELECT * FROM k{i}"
    link = f"CASE WHEN r.href IS NOT NULL THEN '<a href=\"' || {_xml('r.href')} || '\">' || r.text || '</a>' ELSE r.text END"
    return ", ".join(ctes) + f", mk AS (SELECT doc_id, line_no, coalesce(array_to_string(list_transform(m5, lambda r: {link}), ''), '') AS html FROM k4)"


@query(f"WITH {sources.DOC_LINES_SQL}, {_STYLED}, {_markup_sql()} SELECT doc_id, line_no, length(html) AS n, md5(html) AS digest FROM mk")
def inline_markup(spark, sf_dir):
    html = F.col("html")  # written once, measured twice
    written = _styled(spark, sf_dir).select("doc_id", "line_no", inline.markup(F.col("runs")).alias("html"))
    return written.select("doc_id", "line_no", F.length(html).cast("bigint").alias("n"), F.md5(html).alias("digest"))


@query(
    f"""WITH {sources.DOC_LINES_SQL}, {_STYLED}, t AS (SELECT *, coalesce(array_to_string(list_transform(runs, lambda r: r.text), ''), '') AS text FROM st)
SELECT doc_id, line_no, text, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS trimmed, CASE WHEN text = '' THEN '' ELSE left(text, length(text) - 1) || '-' END AS ended, left(text, greatest(length(text) - 1, 0)) AS shorter, substring(text, 4) AS rest,
 len(list_filter(runs, lambda r: r.href IS NULL AND r.style & 2 = 0 AND regexp_matches(r.text, '[^ \\t\\r\\n]'))) = 0 AS bold FROM t"""
)
def inline_ends(spark, sf_dir):
    r = F.col("runs")
    text = inline.plain_text
    return _styled(spark, sf_dir).select(
        "doc_id", "line_no", text(r).alias("text"), text(inline.trimmed(r)).alias("trimmed"), text(inline.ends_replaced(r, F.lit("-"))).alias("ended"), text(inline.ends_replaced(r, F.lit(""))).alias("shorter"),
        text(inline.dropped(r, F.lit(3))).alias("rest"), inline.wholly_bold(r).alias("bold"),
    )


@query(
    f"""WITH {sources.DOC_LINES_SQL}, l AS (SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'note' ELSE 'external' END AS kind, CASE line_no % 3 WHEN 0 THEN CAST(line_no AS VARCHAR) ELSE left(line, 20) END AS target FROM doc_lines)
SELECT doc_id, line_no, CASE kind WHEN 'page' THEN rpad('page-' || target, CAST(greatest(48, length('page-' || target)) AS INTEGER), '-') WHEN 'note' THEN CASE WHEN length('note:' || {_xml('target')} || ':') >= 128 THEN 'note:' || {_xml('target')} || ':' ELSE rpad('note:' || {_xml('target')} || ':', 128, '-') END ELSE {_xml('target')} END AS href FROM l"""
)
def deferred_links(spark, sf_dir):
    n = F.col("line_no")
    kind = F.when(n % 3 == 0, "page").when(n % 3 == 1, "note").otherwise("external")
    target = F.when(n % 3 == 0, n.cast("string")).otherwise(F.substring("line", 1, 20))
    return sources.doc_lines(spark, sf_dir).select("doc_id", "line_no", inline.href(kind, target).alias("href"))


@query(
    f"""WITH {sources.DOC_LINES_SQL}, b AS (SELECT doc_id, line_no, ['heading', 'aside', 'quotation', 'preformatted', 'listItem', 'paragraph'][1 + line_no % 6] AS kind, {_xml('line')} AS p, 1 + line_no % 4 AS level, 'h' || line_no || CASE WHEN line_no % 5 = 0 THEN '"' ELSE '' END AS ident FROM doc_lines)
SELECT doc_id, line_no, CASE kind WHEN 'heading' THEN '<h' || level || ' id="' || replace(ident, '"', '&quot;') || '">' || p || '</h' || level || '>' WHEN 'aside' THEN '<aside><p>' || p || '</p></aside>' WHEN 'quotation' THEN '<blockquote><p>' || p || '</p></blockquote>'
 WHEN 'preformatted' THEN '<pre>' || p || '</pre>' WHEN 'listItem' THEN '<li>' || p || '</li>' ELSE '<p>' || p || '</p>' END || chr(10) AS html FROM b"""
)
def block_markup(spark, sf_dir):
    n = F.col("line_no")
    kind = F.get(F.array(*[F.lit(k) for k in ("heading", "aside", "quotation", "preformatted", "listItem", "paragraph")]), n % 6)
    ident = F.concat(F.lit("h"), n.cast("string"), F.when(n % 5 == 0, '"').otherwise(""))
    html = inline.block_markup(kind, X.xml_text(F.col("line")), 1 + n % 4, ident, X.reads_right_to_left(F.col("line")))
    return sources.doc_lines(spark, sf_dir).select("doc_id", "line_no", html.alias("html"))


# --- contracts of content --------------------------------------------------------------------------------------

_KINDS = "['heading', 'paragraph', 'aside', 'quotation', 'preformatted']"
_CONTRACT_SQL = (
    sources.DOC_LINES_SQL
    + f""",
nl AS (SELECT doc_id, line_no, line_no // 5 AS page, {_KINDS}[1 + line_no % 5] AS kind, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS text FROM doc_lines WHERE line <> ''),
blocks AS (SELECT doc_id, page, kind, text FROM nl UNION ALL SELECT doc_id, page, 'page', string_agg(text, ' ' ORDER BY line_no) FROM nl GROUP BY doc_id, page),
ph AS (SELECT doc_id, page, kind, line_no, trim(substring(text, 4, 14)) || CASE WHEN (doc_id + line_no) % 7 = 0 THEN '#x' ELSE '' END AS phrase, left(text, 10) || CASE WHEN (doc_id + line_no) % 7 = 1 THEN '#x' ELSE '' END AS opening FROM nl WHERE length(text) >= 8),
expected AS (SELECT doc_id, page, CASE kind WHEN 'heading' THEN 'headings' WHEN 'paragraph' THEN 'paragraphs' WHEN 'aside' THEN 'asides' WHEN 'quotation' THEN 'quotations' ELSE 'preformatted' END AS "check", phrase FROM ph
  UNION ALL SELECT doc_id, page, 'paragraphOpenings', opening FROM ph WHERE kind = 'paragraph' UNION ALL SELECT doc_id, page, 'text', phrase FROM ph WHERE line_no % 2 = 0
  UNION ALL SELECT doc_id, page, 'absentText', phrase FROM ph WHERE line_no % 9 = 0 UNION ALL SELECT doc_id, page, 'absentPreformatted', phrase FROM ph WHERE line_no % 3 = 0)"""
)


def _contract(spark, sf_dir):
    """Lines as blocks of five kinds, and expectations made of their own words, some of them spoilt."""
    n, text = F.col("line_no"), F.trim(F.regexp_replace("line", "[ \\t]+", " "))
    kind = F.get(F.array(*[F.lit(k) for k in ("heading", "paragraph", "aside", "quotation", "preformatted")]), n % 5)
    lines = sources.doc_lines(spark, sf_dir).where("line <> ''").select("doc_id", "line_no", F.floor(n / 5).alias("page"), kind.alias("kind"), text.alias("text"))
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("t"))
    whole = pages.select("doc_id", "page", F.lit("page").alias("kind"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
    d, t = F.col("doc_id"), F.col("text")
    spoilt = lambda k: F.when((d + n) % 7 == k, "#x").otherwise("")
    said = lines.where(F.length(t) >= 8).select("doc_id", "page", "kind", "line_no", F.concat(F.trim(F.substring(t, 4, 14)), spoilt(0)).alias("phrase"), F.concat(F.substring(t, 1, 10), spoilt(1)).alias("opening"))
    of_kind = F.when(F.col("kind") == "preformatted", "preformatted").otherwise(F.concat("kind", F.lit("s")))
    wants = lambda rows, check, phrase="phrase": rows.select("doc_id", "page", (F.lit(check) if isinstance(check, str) else check).alias("check"), F.col(phrase).alias("phrase"))
    expected = wants(said, of_kind).unionByName(wants(said.where("kind = 'paragraph'"), "paragraphOpenings", "opening")).unionByName(wants(said.where(n % 2 == 0), "text"))
    expected = expected.unionByName(wants(said.where(n % 9 == 0), "absentText")).unionByName(wants(said.where(n % 3 == 0), "absentPreformatted"))
    return expected, lines.select("doc_id", "page", "kind", "text").unionByName(whole)


@query(
    f"""WITH {_CONTRACT_SQL}, e AS (SELECT DISTINCT *, CASE "check" WHEN 'text' THEN 'page' WHEN 'absentText' THEN 'page' WHEN 'headings' THEN 'heading' WHEN 'asides' THEN 'aside' WHEN 'quotations' THEN 'quotation' WHEN 'preformatted' THEN 'preformatted' WHEN 'absentPreformatted' THEN 'preformatted' ELSE 'paragraph' END AS kind FROM expected),
m AS (SELECT e.doc_id, e.page, e."check", e.phrase, coalesce(bool_or(CASE WHEN e."check" = 'paragraphOpenings' THEN starts_with(b.text, e.phrase) ELSE contains(b.text, e.phrase) END), false) AS found FROM e LEFT JOIN blocks b ON b.doc_id = e.doc_id AND b.page = e.page AND b.kind = e.kind GROUP BY ALL)
SELECT doc_id, page, "check", phrase FROM m WHERE found = starts_with("check", 'absent')"""
)
def content_violations(spark, sf_dir):
    return checks.content_violations(*_contract(spark, sf_dir))


@query(f'WITH {_CONTRACT_SQL} SELECT "check", count(*) AS n, count(DISTINCT (doc_id, page)) AS pages, count(DISTINCT doc_id) AS documents FROM expected GROUP BY "check"')
def check_census(spark, sf_dir):
    return checks.check_census(_contract(spark, sf_dir)[0])
