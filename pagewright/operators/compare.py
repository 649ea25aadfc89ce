"""Comparing runs: multisets of images, changed pages less what changes by itself, spans, receipts, summaries, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def image_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, other, change of (sha, name, ord): images are matched by bytes, in order; what is left on one side changed, and matched ones of
    another name were renamed."""

    def numbered(images: DataFrame, name: str) -> DataFrame:
        return images.select("sha", F.col("name").alias(name), F.row_number().over(Window.partitionBy("sha").orderBy("ord")).alias("k"))

    both = numbered(before, "name").join(numbered(after, "other"), ["sha", "k"], "full")
    change = F.when(F.col("name").isNull(), "added").when(F.col("other").isNull(), "removed").when(F.col("name") != F.col("other"), "renamed")
    return both.select("name", "other", change.alias("change")).where("change IS NOT NULL")


def changed(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The key and the names of the fields that two runs' records disagree on, comma-joined; a missing record differs in all it holds."""
    a = left.select(F.col(key).alias("l"), *[F.col(f).alias(f"l_{f}") for f in fields])
    b = right.select(F.col(key).alias("r"), *[F.col(f).alias(f"r_{f}") for f in fields])
    both = a.join(b, F.col("l") == F.col("r"), "full")
    differs = [F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), f) for f in sorted(fields)]
    return both.select(F.coalesce("l", "r").alias(key), F.concat_ws(",", *differs).alias("fields")).where("fields <> ''")


def attributed(candidate: DataFrame, control: DataFrame, key: str) -> DataFrame:
    """Changes of the candidate that a second run of the baseline doesn't show by itself."""
    return candidate.join(control.select(key), key, "left_anti")


def paragraph_spans(pages: DataFrame) -> DataFrame:
    """Each paragraph of a page, and whether it also stands on the page before and after: doc_id, page_no, ids (array)."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    beside = pages.select("doc_id", "page_no", "ids", F.lag("ids").over(order).alias("b"), F.lead("ids").over(order).alias("a"))
    each = beside.select("doc_id", "page_no", "a", "b", F.explode(F.array_distinct("ids")).alias("id"))
    held = lambda c: F.coalesce(F.array_contains(c, F.col("id")), F.lit(False))
    return each.select("doc_id", "page_no", "id", held("b").alias("from_before"), held("a").alias("goes_on"))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per setting: rows, the sum, the median and the mean of a measure."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.median(value), 4).alias("median"), F.round(F.avg(value), 4).alias("mean"))


def growth_gate(rounds: DataFrame, by: str, order: list[str], value: str, ceiling: float) -> DataFrame:
    """How much a count grows a round, from the first to the last, and whether that keeps to the ceiling; two rounds at least."""
    at = F.struct(*order)
    ends = rounds.groupBy(by).agg(F.count("*").alias("n"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last")).where("n >= 2")
    grown = (F.col("last") - F.col("first")) / (F.col("n") - 1)
    return ends.select(by, F.round(grown, 6).alias("growth"), (grown <= ceiling).alias("passes"))


def verified(sources: DataFrame, content: Column, said_bytes: Column, said_sha: Column) -> DataFrame:
    """What of a source's record is wrong: bytes, then the digest."""
    wrong = F.when(F.octet_length(content) != said_bytes, "bytes").when(F.sha2(content.cast("binary"), 256) != said_sha, "sha256")
    return sources.withColumn("wrong", wrong)


def missing_warnings(required: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per case: required pages, those warned of, whether all are: required and accepted hold case_id and page."""
    seen = required.join(accepted.select("case_id", "page").distinct().withColumn("seen", F.lit(True)), ["case_id", "page"], "left")
    sums = seen.groupBy("case_id").agg(F.count("*").alias("required"), F.count("seen").alias("warned"))
    return sums.withColumn("passed", F.col("required") == F.col("warned"))
