"""Rules over a document's blocks: notes, chapters, progress, options, the model's validity, phrases in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of progress, and bounds of the options.
EXTRACTION, RECONSTRUCTION = 0.6875, 0.3125
OPENING, PIPELINE, PIPELINE_END, WRITING = 0.02, 0.80, 0.82, 0.17
BOUNDS = {"dpi": (72, 600), "pages": (1, 100_000), "characters": (1, 100_000_000), "pixels": (1, 48_000_000), "year": (1980, 2099)}
LANGUAGE = "^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"


def note_targets(references: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, line_no, note where exactly one entry has the reference's number and its pages hold the reference's."""
    r, e = references.alias("r"), entries.alias("e")
    on = (F.col("r.doc_id") == F.col("e.doc_id")) & (F.col("r.number") == F.col("e.number")) & F.col("r.page").between(F.col("e.first_page"), F.col("e.last_page"))
    met = r.join(e, on).groupBy("r.doc_id", "r.line_no").agg(F.min("e.note").alias("note"), F.count("*").alias("n"))
    return met.where(F.col("n") == 1).select("doc_id", "line_no", "note")


def chapters_in_order(titles: DataFrame) -> DataFrame:
    """doc_id, n, ordered: two chapters at least, numbered 1, 2, 3 and so on over rising pages."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    steps = titles.select("doc_id", (F.col("number") == F.row_number().over(order)).alias("fits"), (F.col("page_no") - F.lag("page_no").over(order)).alias("step"))
    held = steps.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("fits").alias("fits"), F.min("step").alias("step"))
    return held.select("doc_id", "n", ((F.col("n") >= 2) & F.col("fits") & F.coalesce(F.col("step") > 0, F.lit(True))).alias("ordered"))


def pipeline_progress(k: Column, n: Column) -> Column:
    """How far a book is when k of its n pages' two passes are done: reading first, then rebuilding."""
    read = EXTRACTION * (k * 2) / n
    rebuilt = EXTRACTION + RECONSTRUCTION * (k * 2 - n) / n
    return F.least(F.lit(PIPELINE_END), OPENING + PIPELINE * F.when(k * 2 <= n, read).otherwise(rebuilt))


def writing_progress(k: Column, n: Column) -> Column:
    return PIPELINE_END + WRITING * k / n


def refused_option(options) -> Column:
    """The first option out of its bounds, or null; ``options`` gives columns by name."""
    out = F.when(~options("language").rlike(LANGUAGE), "language")
    for name, (low, high) in BOUNDS.items():
        out = out.when(~options(name).between(low, high), "date" if name == "year" else name)
    return out


def model_violations(parts: DataFrame) -> DataFrame:
    """doc_id, line_no, code of parts that a valid document may not hold: doc_id, line_no, kind, level, asset, width, rectangular, note."""
    by = lambda c: Window.partitionBy("doc_id", "kind", c).orderBy("line_no")
    said = parts.select("*", F.row_number().over(by("asset")).alias("ka"), F.row_number().over(by("note")).alias("kn"))
    # the first place an asset is given, for every part of the document that names it
    given = F.min(F.when(F.col("kind") == "asset", F.col("line_no"))).over(Window.partitionBy("doc_id", "asset"))
    said = said.withColumn("given", given)
    k = F.col("kind")
    note = ~F.col("note").rlike("^note-[0-9a-z-]*$") | (F.length("note") > 80) | (F.col("kn") > 1)
    code = (
        F.when((k == "heading") & ~F.col("level").between(1, 6), "heading_level")
        .when((k == "asset") & (F.col("ka") > 1), "duplicate_asset")
        .when((k == "image") & (F.col("given").isNull() | (F.col("given") >= F.col("line_no"))), "missing_asset")
        .when((k == "table") & ((F.col("width") < 2) | ~F.col("rectangular")), "table")
        .when((k == "note") & note, "note")
    )
    return said.select("doc_id", "line_no", code.alias("code")).where("code IS NOT NULL")


def ordered_in(text: Column, phrases: Column) -> Column:
    """Whether every phrase occurs in the text, each after the one before."""
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("found"))

    def step(s: Column, phrase: Column) -> Column:
        place = F.call_function("locate", phrase, text, s["at"])
        return F.struct((place + F.length(phrase)).alias("at"), (s["found"] & (place > 0)).alias("found"))

    return F.aggregate(phrases, start, step, lambda s: s["found"])
