"""Page evidence: recurring lines, margin slots, body size, leading, label styles.

Windows are partitioned by document (or document and signature), so a group never exceeds
one document; sums that span documents are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT_FLOOR = 6
PAIRS_FLOOR = 4


def signature(line):
    """A short line with its numbers masked; null for lines that are no furniture."""
    return F.when(F.length(line) < 100, F.regexp_replace(F.lower(line), "[0-9]+", "#"))


def recurring_lines(lines: DataFrame) -> DataFrame:
    """source-wide lines that stand in many documents: signature, n_docs, kept at max(3, (all + 1) / 2 / 100)."""
    marked = lines.select("lang", "doc_id", signature(F.col("line")).alias("signature")).where("signature <> ''")
    per = marked.distinct().groupBy("lang", "signature").agg(F.count("*").alias("n_docs"))
    total = lines.select("lang", "doc_id").distinct().groupBy("lang").agg(F.count("*").alias("docs"))
    floor = F.greatest(F.lit(3), F.floor((F.col("docs") + 1) / 200))
    return per.join(total, "lang").where(F.col("n_docs") >= floor).select("lang", "signature", "n_docs")


def margin_slots(pages: DataFrame) -> DataFrame:
    """Row slots of a document that are filled on max(6, pages / 4) pages at least."""
    count = pages.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    slots = pages.groupBy("doc_id", "row_no").agg(F.countDistinct("page_no").alias("filled"))
    floor = F.greatest(F.lit(SLOT_FLOOR), F.ceil(F.col("pages") / 4))
    return slots.join(count, "doc_id").where(F.col("filled") >= floor).select("doc_id", "row_no", "filled")


def body_size(pages: DataFrame) -> DataFrame:
    """The size most characters are set in, ties to the smaller; established with 3 lines and 200 characters."""
    weights = pages.groupBy("doc_id", "size").agg(F.sum(F.length("line")).alias("chars"), F.count("*").alias("lines"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("chars"), "size")
    top = weights.withColumn("k", F.row_number().over(best)).where("k = 1")
    return top.select("doc_id", "size", "chars", ((F.col("lines") >= 3) & (F.col("chars") >= 200)).alias("established"))


def stated_leading(pages: DataFrame) -> DataFrame:
    """The commonest step (half points) to the next line below of the same size and edge; PAIRS_FLOOR pairs, ties to the closer."""
    below = Window.partitionBy("doc_id", "page_no", "size", "x").orderBy(F.desc("y"))
    steps = pages.select("doc_id", "size", (F.col("y") - F.lead("y").over(below)).alias("step")).where(F.col("step") <= 3 * F.col("size"))
    bins = steps.groupBy("doc_id", F.round(F.col("step") * 2).cast("int").alias("half_points")).agg(F.count("*").alias("pairs"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("pairs"), "half_points")
    return bins.where(F.col("pairs") >= PAIRS_FLOOR).withColumn("k", F.row_number().over(best)).where("k = 1").select("doc_id", "half_points", "pairs")


def label_styles(pages: DataFrame) -> DataFrame:
    """Bold styles that stand on three pages of a document at least."""
    styles = pages.where("bold").groupBy("doc_id", F.round(F.col("size") * 2).cast("int").alias("size_key")).agg(F.countDistinct("page_no").alias("n_pages"))
    return styles.where("n_pages >= 3")
