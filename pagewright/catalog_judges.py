"""Queries of the judgments: word classes, findings, the recognition plan and its outcome, image classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import functions as X
from . import plans, sources
from .functions import lines as L
from .operators import word_classes
from .registry import query

_PIECES = "list_filter(flatten(list_transform(list_filter(list_transform(t, lambda x: regexp_replace(x, '^[^\\p{L}]+|[^\\p{L}]+$', '', 'g')), lambda x: x <> ''), lambda x: string_split(x, '-'))), lambda x: x <> '')"
_LATIN = X.LATIN.replace("\\x{0}", "\\x{1}")

_COUNTS_SQL = f"""{sources.DOC_LINES_SQL},
lexicon AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\\p{{L}}{{2,}}'))) AS word FROM benchmark WHERE text IS NOT NULL),
tok AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[{L.WS}]+'), lambda x: x <> '') AS t FROM doc_lines),
tk AS (SELECT doc_id, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(t, lambda x: regexp_matches(x, '\\p{{N}}')))) AS BIGINT) AS numeric_tokens,
  CAST(sum(len(list_filter(t, lambda x: regexp_matches(x, '\\p{{N}}') AND NOT regexp_matches(x, '\\p{{L}}')))) AS BIGINT) AS number_tokens FROM tok GROUP BY doc_id),
pc AS (SELECT doc_id, line_no, {_PIECES} AS p FROM tok),
wd AS (SELECT doc_id, line_no, i, regexp_replace(replace(p[i], '’', ''''), '(?i)^(.+)(''s|n''t|''ll|''re|''ve|''m|''d)$', '\\1') AS word FROM (SELECT doc_id, line_no, p, unnest(range(1, len(p) + 1)) AS i FROM pc)),
nb AS (SELECT *, lag(word) OVER o AS before, lead(word) OVER o AS after FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY line_no, i)),
kn AS (SELECT n.*, a.word IS NOT NULL AS in0, (b.word IS NOT NULL AND regexp_matches(n.before || n.word, '^\\p{{L}}+$')) OR (c.word IS NOT NULL AND regexp_matches(n.word || n.after, '^\\p{{L}}+$')) AS near
  FROM nb n LEFT JOIN lexicon a ON a.word = lower(n.word) LEFT JOIN lexicon b ON b.word = lower(n.before || n.word) LEFT JOIN lexicon c ON c.word = lower(n.word || n.after)),
cl AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(regexp_replace(word, '[{_LATIN}]', '', 'g'), '\\p{{L}}') THEN 'damaged' WHEN NOT regexp_matches(word, '^\\p{{L}}+$') THEN 'neutral'
  WHEN length(word) = 1 THEN CASE WHEN word IN ('a', 'A', 'i', 'I') THEN 'bare' WHEN regexp_matches(word, '^\\p{{Ll}}$') THEN 'damaged' ELSE 'neutral' END
  WHEN regexp_matches(word, '^(\\p{{Ll}}+|\\p{{Lu}}+|\\p{{Lu}}\\p{{Ll}}*)$') AND in0 THEN 'english'
  WHEN regexp_matches(word, '^(\\p{{Lu}}+|\\p{{Lu}}\\p{{Ll}}*|(\\p{{Lu}}\\p{{Ll}}+){{2,}})$') THEN 'neutral'
  WHEN (NOT regexp_matches(word, '^\\p{{Ll}}+$') OR length(word) >= 3) AND NOT coalesce(near, false) THEN 'misread' ELSE 'damaged' END AS kind FROM kn),
bl AS (SELECT doc_id, line_no, count(*) FILTER (kind = 'bare') AS bare, count(*) FILTER (kind = 'english') AS known, count(*) FILTER (kind IN ('damaged', 'misread')) AS damaged, count(*) FILTER (kind = 'neutral') AS neutral, count(*) FILTER (kind = 'misread') AS misread FROM cl GROUP BY ALL),
sm AS (SELECT doc_id, CAST(sum(known + bare) AS BIGINT) AS english, CAST(sum(damaged) AS BIGINT) AS damaged, CAST(sum(neutral) AS BIGINT) AS neutral, CAST(sum(misread) AS BIGINT) AS misread, CAST(sum(bare) FILTER (known = 0) AS BIGINT) AS lonely FROM bl GROUP BY doc_id),
word_counts AS (SELECT doc_id, tokens, numeric_tokens, number_tokens, coalesce(english, 0) AS english, coalesce(damaged, 0) AS damaged, coalesce(neutral, 0) AS neutral, coalesce(misread, 0) AS misread, coalesce(lonely, 0) AS lonely FROM tk LEFT JOIN sm USING (doc_id))"""


def _counts(spark, sf_dir):
    return word_classes.word_counts(sources.doc_lines(spark, sf_dir), word_classes.lexicon(sources.table(spark, sf_dir, "benchmark")))


@query(f"WITH {_COUNTS_SQL} SELECT * FROM word_counts")
def word_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


_FINDING = """CASE WHEN {j} < 20 OR number_tokens * 5 >= tokens THEN NULL WHEN (english - lonely) * 2 < {j} THEN 'few_english'
 WHEN (CASE WHEN numeric_tokens * 5 >= tokens THEN misread * 10 >= {w} ELSE misread * 1000 >= {w} * 85 END) OR (numeric_tokens * 5 < tokens AND (english - lonely) * 10 < {j} * 6 AND misread * 1000 >= {w} * 75) THEN 'misread' END""".format(j="(english + damaged - lonely)", w="(english + damaged + neutral)")


def _finding(c):
    words = c("english") + c("damaged") + c("neutral")
    return plans.word_finding(c("english"), c("english") + c("damaged"), c("lonely"), c("misread"), words, c("numeric_tokens"), c("number_tokens"), c("tokens"))


@query(
    f"""WITH {_COUNTS_SQL}, p AS (SELECT w.*, text, {_FINDING} AS finding, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS letters FROM word_counts w JOIN documents USING (doc_id)),
f AS (SELECT *, length(regexp_replace(letters, '[{_LATIN}]', '', 'g')) AS fl, english + damaged - lonely AS j FROM p), s AS (SELECT *, j >= 5 AND j < 20 AND number_tokens * 5 < tokens AND (english - lonely) * 2 < j AS unread FROM f)
SELECT a.doc_id, a.finding, a.english < 32 AS sparse, a.j >= 5 AND a.j < 20 AND a.number_tokens * 5 < a.tokens AND a.fl >= 5 AND a.fl * 10 >= length(a.letters) AND (a.english - a.lonely) * 3 < a.j * 2 AS short,
 CASE WHEN least(8, len(string_split(a.text, chr(10)))) >= 7 AND (a.doc_id % 8) / 8.0 >= 0.75 AND a.english < least(8, len(string_split(a.text, chr(10)))) THEN 'missing_text' END AS ink,
 coalesce(a.unread AND b.unread AND a.j + b.j >= 20, false) AS two_short,
 coalesce(a.english + a.damaged + a.neutral > 0 AND a.misread * greatest(1, b.english + b.damaged + b.neutral) < b.misread * (a.english + a.damaged + a.neutral), false) AS better FROM s a LEFT JOIN s b ON b.doc_id = a.doc_id + 1"""
)
def word_findings(spark, sf_dir):
    """Findings of each document; its neighbour's counts stand for a second reading of the page."""
    counts = _counts(spark, sf_dir)
    texts = sources.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.foreign_letters(F.col("text")).alias("fl"), X.held(F.col("text"), r"\p{L}").alias("nl"), F.size(F.split("text", "\n")).alias("n_lines"))
    # each count goes to its own document and to the one before, so that the words are counted once
    count, d = F.struct(*counts.columns), F.col("doc_id")
    told = counts.select(F.explode(F.array(F.struct(d.alias("key"), F.lit(True).alias("own"), count.alias("c")), F.struct((d - 1).alias("key"), F.lit(False).alias("own"), count.alias("c")))).alias("t")).select("t.*")
    met = told.groupBy("key").agg(F.collect_list(F.when(F.col("own"), F.col("c"))).alias("a"), F.collect_list(F.when(~F.col("own"), F.col("c"))).alias("b"))
    met = met.select("b", F.explode("a").alias("a")).select("a", F.explode_outer("b").alias("b"))
    both = met.select("a.*", *[F.col(f"b.{c}").alias(f"o_{c}") for c in counts.columns]).join(texts.hint("merge"), "doc_id")
    a, b = F.col, lambda c: F.col(f"o_{c}")
    words = lambda c: c("english") + c("damaged") + c("neutral")
    rows = F.least(F.lit(8), F.col("n_lines"))  # rows of writing and the share outside every line are measured on images: stand-ins
    ink = plans.ink_finding(rows, (F.col("doc_id") % 8) / 8, F.col("english"))
    false = F.lit(False)
    return both.select(
        "doc_id", _finding(a).alias("finding"), plans.sparse_layer(F.col("english")).alias("sparse"), plans.short_reading(a, F.col("fl"), F.col("nl")).alias("short"), ink.alias("ink"),
        F.coalesce(plans.two_short_readings(a, b), false).alias("two_short"), F.coalesce(plans.reads_better(F.col("misread"), words(a), F.col("o_misread"), words(b)), false).alias("better"),
    )


_EVIDENCE_SQL = (
    _COUNTS_SQL
    + f""",
ev AS (SELECT doc_id, {_FINDING} AS found, english < 32 AND regexp_matches(lower(lang), '^(en|eng)([-_].*)?$') AS sparse0, doc_id % 13 = 0 AS requires_image, doc_id % 2 = 0 AS image_backed, doc_id % 5 = 0 AS drawn, doc_id % 17 = 0 AS damaged_encoding,
  length(text) - length(replace(text, '?', '')) > greatest(2, length(text) // 50) OR length(trim(text)) = 0 AS unreadable FROM word_counts JOIN documents USING (doc_id)),
evidence AS (SELECT *, CASE WHEN image_backed AND NOT requires_image AND NOT damaged_encoding THEN found END AS finding, image_backed AND NOT requires_image AND NOT damaged_encoding AND coalesce(sparse0, false) AS sparse, unreadable OR drawn OR damaged_encoding AS lacks_text FROM ev),
pl AS (SELECT *, CASE policy WHEN 'automatic' THEN 'judge' WHEN 'automatic_including' THEN 'retry' WHEN 'always' THEN 'retry' ELSE 'keep' END AS rule FROM evidence, (SELECT unnest(['never', 'automatic', 'automatic_including', 'automatic_keeping', 'always']) AS policy)),
nd AS (SELECT *, policy = 'always' OR (starts_with(policy, 'automatic') AND (lacks_text OR (rule = 'retry' AND image_backed) OR (rule = 'judge' AND finding IS NOT NULL))) AS needs FROM pl),
planned AS (SELECT *, CASE WHEN requires_image THEN 'keep' WHEN NOT needs THEN CASE WHEN rule = 'judge' AND sparse THEN 'verify' ELSE 'keep' END WHEN rule = 'judge' AND coalesce(finding = 'misread', false) THEN 'compare' ELSE 'replace' END AS plan FROM nd)"""
)


def _planned(spark, sf_dir):
    """A page's evidence: word findings from its text; what images and fonts say is set by doc_id."""
    documents = sources.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    d, t = F.col("doc_id"), F.col("text")
    marks = F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))
    said = documents.select(
        "doc_id", "lang", (d % 13 == 0).alias("requires_image"), (d % 2 == 0).alias("image_backed"), (d % 5 == 0).alias("drawn"), (d % 17 == 0).alias("damaged_encoding"),
        plans.lacks_readable_text(F.length(F.trim(t)), marks, F.lit(False), F.lit(False), F.length(t)).alias("unreadable"),
    )
    c = F.col
    judged = c("image_backed") & ~c("requires_image") & ~c("damaged_encoding")
    evidence = _counts(spark, sf_dir).join(said.hint("merge"), "doc_id").select(
        "doc_id", "requires_image", "image_backed", "drawn", "damaged_encoding", F.when(judged, _finding(c)).alias("finding"),
        (judged & plans.sparse_layer(c("english")) & F.coalesce(X.english_declared(c("lang")), F.lit(False))).alias("sparse"), (c("unreadable") | c("drawn") | c("damaged_encoding")).alias("lacks_text"),
    )
    each = evidence.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in plans.POLICIES])))
    return each.withColumn("plan", plans.recognition_plan(c("policy"), c))


@query(f"WITH {_EVIDENCE_SQL} SELECT doc_id, policy, plan, finding FROM planned")
def recognition_plan(spark, sf_dir):
    return _planned(spark, sf_dir).select("doc_id", "policy", "plan", "finding")


_LAYER = "CASE WHEN plan = 'verify' THEN [] WHEN finding IS NULL THEN [] ELSE ['layer:' || finding || ':{0}'] END"
_BAD = "(doc_id % 4 = 1 OR (plan = 'verify' AND sparse AND doc_id % 4 = 2))"


@query(
    f"""WITH {_EVIDENCE_SQL}, o AS (SELECT *, unnest(['none', 'read', 'empty', 'failed']) AS outcome FROM planned),
r AS (SELECT *, CASE WHEN plan = 'keep' OR outcome = 'none' THEN 'a' WHEN outcome = 'failed' THEN CASE WHEN plan IN ('compare', 'verify') THEN 'b' WHEN drawn THEN 'c' ELSE 'd' END
  WHEN outcome = 'empty' AND drawn AND plan <> 'verify' THEN 'e' WHEN {_BAD} AND (plan = 'replace' OR (sparse AND outcome <> 'empty')) THEN 'f' WHEN plan = 'verify' THEN 'g'
  WHEN plan = 'compare' AND NOT (NOT {_BAD} AND doc_id % 3 = 0) THEN 'h' WHEN outcome = 'empty' THEN 'i' ELSE 'j' END AS k FROM o),
s AS (SELECT *, CASE WHEN k IN ('a', 'b', 'g', 'h') THEN 'kept_layer' WHEN k IN ('c', 'e') THEN 'kept_as_extracted' WHEN k IN ('d', 'f', 'i') THEN 'page_image' ELSE 'replaced' END AS disposition,
  CASE k WHEN 'a' THEN CASE WHEN finding IS NULL THEN [] ELSE ['layer:' || finding || ':retained'] END WHEN 'b' THEN list_concat({_LAYER.format('kept_over')}, ['failed:layer']) WHEN 'c' THEN list_concat({_LAYER.format('kept_as_extracted')}, ['failed:drawn'])
  WHEN 'd' THEN list_concat({_LAYER.format('page_image')}, ['failed:page']) WHEN 'e' THEN list_concat({_LAYER.format('kept_as_extracted')}, ['failed:drawn'])
  WHEN 'f' THEN list_concat(['reading_implausible'], CASE WHEN plan = 'verify' THEN ['layer:unread:implausible'] ELSE {_LAYER.format('implausible')} END) WHEN 'g' THEN [] WHEN 'h' THEN {_LAYER.format('kept_over')}
  WHEN 'i' THEN list_concat({_LAYER.format('page_image')}, ['failed:no_text']) ELSE list_concat(list_concat({_LAYER.format('replaced')}, ['ocr']), CASE WHEN doc_id % 7 = 0 THEN ['incomplete'] ELSE [] END) END AS w FROM r)
SELECT doc_id, policy, outcome, disposition, coalesce(array_to_string(list_concat(list_concat(CASE WHEN damaged_encoding THEN ['encoding:' || CASE WHEN disposition IN ('kept_layer', 'kept_as_extracted') THEN 'retained' ELSE disposition END] ELSE [] END,
  CASE WHEN plan <> 'replace' AND NOT requires_image AND image_backed AND disposition = 'kept_layer' THEN ['unverified'] ELSE [] END), w), ','), '') AS warnings FROM s"""
)
def recognition_resolve(spark, sf_dir):
    d = F.col("doc_id")
    each = _planned(spark, sf_dir).withColumn("outcome", F.explode(F.array(*[F.lit(o) for o in ("none", "read", "empty", "failed")])))
    # readings are made elsewhere: what they hold is set by doc_id
    each = each.select("*", (d % 4 == 1).alias("reading_bad"), (d % 4 == 2).alias("beside_bad"), (d % 3 == 0).alias("better"), (d % 7 == 0).alias("uncovered"))
    disposition, warnings = plans.recognition_resolve(F.col("plan"), F.col("outcome"), F.col)
    return each.select("doc_id", "policy", "outcome", disposition.alias("disposition"), F.array_join(warnings, ",").alias("warnings"))


_SHARES = {"flat": 1, "hard": 2, "soft": 3, "ground": 4, "chroma": 5, "bilevel": 6, "off_tint": 7}
_SCALE = {"flat": 6.0, "hard": 2.0, "soft": 3.0, "ground": 6.0, "chroma": 1.0, "bilevel": 12.0, "off_tint": 0.01}


@query(
    f"""WITH f AS (SELECT vec_id, {', '.join(f'least(1.0, abs(CAST(embedding[{i}] AS DOUBLE)) * {_SCALE[k]}) AS {k}' for k, i in _SHARES.items())}, CAST(floor(abs(CAST(embedding[8] AS DOUBLE)) * 30000) AS BIGINT) AS colours,
  255 - CAST(vec_id % 9 AS BIGINT) * 3 AS red, 255 - CAST(vec_id % 7 AS BIGINT) * 9 AS green, 250 - CAST(vec_id % 5 AS BIGINT) * 13 AS blue, unnest(['page', 'region']) AS role, vec_id % 2 = 0 AS from_image FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) >= 8),
r AS (SELECT *, CASE WHEN hard + soft > 0 THEN hard / (hard + soft) ELSE 0.0 END AS ratio FROM f),
c AS (SELECT *, CASE WHEN ground >= 0.20 AND chroma < 0.10 AND soft < 0.15 AND ratio >= 0.40 AND hard >= 0.01 THEN CASE WHEN role <> 'page' THEN 'line art or chart' WHEN NOT from_image THEN 'text page (born-digital)' WHEN bilevel >= 0.95 AND colours <= 4096 THEN 'text page (bilevel scan)' ELSE 'text page (tonal scan)' END
  WHEN colours <= 4096 AND flat >= 0.30 THEN 'line art or chart' WHEN flat <= 0.12 AND soft >= 0.30 AND ground <= 0.15 THEN 'photograph' WHEN soft >= 0.20 AND ground <= 0.55 AND flat <= 0.55 THEN 'continuous-tone art' WHEN ratio >= 0.40 AND flat >= 0.45 THEN 'line art or chart' ELSE 'mixed' END AS kind FROM r)
SELECT vec_id, role, kind, chroma < 0.02 OR kind IN ('photograph', 'text page (tonal scan)') OR (kind = 'continuous-tone art' AND (role = 'page' OR flat < 0.30)) OR (kind = 'mixed' AND role = 'page') AS lossy,
 (greatest(abs(red - green), abs(green - blue)) <= 4 OR (red >= green AND green >= blue AND red - blue <= 64 AND red * 299 + green * 587 + blue * 114 >= 160000)) AND off_tint <= 0.001 AND colours % 100 < 64 AS monochrome FROM c"""
)
def image_class(spark, sf_dir):
    """Pixels are no input here: the shares of an image's features are read from the embeddings' components."""
    vectors = sources.table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND size(embedding) >= 8")
    at = lambda i: F.abs(F.element_at("embedding", i).cast("double"))
    v, c = F.col("vec_id"), F.col
    f = vectors.select(
        "vec_id", *[F.least(F.lit(1.0), at(i) * _SCALE[k]).alias(k) for k, i in _SHARES.items()], F.floor(at(8) * 30000).alias("colours"), (255 - v % 9 * 3).alias("red"), (255 - v % 7 * 9).alias("green"), (250 - v % 5 * 13).alias("blue"),
        F.explode(F.array(F.lit("page"), F.lit("region"))).alias("role"), (v % 2 == 0).alias("from_image"),
    )
    kind = plans.image_class(c, c("role"), c("from_image"))
    return f.withColumn("kind", kind).select("vec_id", "role", "kind", plans.lossy_is_safe(c("kind"), c, c("role")).alias("lossy"), plans.is_monochrome(c("red"), c("green"), c("blue"), c("off_tint"), c("colours") % 100).alias("monochrome"))


@query(
    f"""WITH {sources.DOC_LINES_SQL}, r AS (SELECT doc_id, string_split(line, ' ') AS cells FROM doc_lines),
t AS (SELECT doc_id, count(*) AS n_rows, max(len(cells)) AS columns, CAST(sum(len(list_filter(cells, lambda x: regexp_matches(x, '[^{L.WS}]') AND length(x) > 2))) AS BIGINT) AS transcribed FROM r GROUP BY doc_id)
SELECT a.doc_id, a.n_rows * a.columns AS cells, a.transcribed, a.n_rows * a.columns < 9 OR a.transcribed * 2 >= a.n_rows * a.columns AS read, a.n_rows >= 8 AND (a.n_rows * a.columns - a.transcribed) / (a.n_rows * a.columns) >= 0.2 AS loss,
 coalesce(a.n_rows < b.n_rows AND a.transcribed >= b.transcribed, false) AS kept FROM t a LEFT JOIN t b ON b.doc_id = a.doc_id + 1"""
)
def cell_evidence(spark, sf_dir):
    """A document's lines as a table's rows, words as cells; words of one or two letters stand for cells that were not read."""
    cells = sources.doc_lines(spark, sf_dir).select("doc_id", F.split("line", " ").alias("cells"))
    read = F.size(F.filter("cells", lambda x: x.rlike(f"[^{L.WS}]") & (F.length(x) > 2)))
    t = cells.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("columns"), F.sum(read).alias("transcribed"))
    t = t.select("doc_id", "rows", (F.col("rows") * F.col("columns")).alias("cells"), "transcribed")
    other = t.select(*[F.col(c).alias(f"o_{c}") for c in t.columns])
    both, c = t.join(other, F.col("o_doc_id") == F.col("doc_id") + 1, "left"), F.col
    loss = plans.indicates_loss(c("rows"), (c("cells") - c("transcribed")) / c("cells"))
    kept = plans.bands_are_kept(c("rows"), c("transcribed"), c("o_rows"), c("o_transcribed"))
    return both.select("doc_id", "cells", "transcribed", plans.cells_were_read(c("cells"), c("transcribed")).alias("read"), loss.alias("loss"), F.coalesce(kept, F.lit(False)).alias("kept"))
