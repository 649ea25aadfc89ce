"""What sizes say: body size, headings, ranks, numbered titles, and the geometry that two lines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import section_number


def size_key(size: Column) -> Column:
    """Half points."""
    return F.round(size * 2).cast("int")


def body_sizes(lines: DataFrame, *keys: str) -> DataFrame:
    """body (the rounded size of most characters, the smaller of equals) and established (null, or body) by ``keys``."""
    sums = lines.groupBy(*keys, F.round("size").cast("int").alias("rounded")).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("lines"))
    best = sums.groupBy(*keys).agg(F.max_by(F.struct("rounded", "chars", "lines"), F.struct("chars", -F.col("rounded"))).alias("b"))
    held = F.when((F.col("b.lines") >= 3) & (F.col("b.chars") >= 200), F.col("b.rounded"))
    return best.select(*keys, F.col("b.rounded").alias("body"), held.alias("established"))


def heading_thresholds(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, body, threshold: from what size a line of the page may be a heading."""
    document = body_sizes(lines, "doc_id").select("doc_id", F.col("body").alias("of_document"))
    pages = body_sizes(lines, "doc_id", "page_no").join(document, "doc_id")
    body = F.greatest(F.lit(4), F.col("body")).cast("double")
    heading = F.greatest(body, F.coalesce("established", F.lit(0)))
    floor = F.when(F.col("established").isNull(), F.col("of_document") * 1.1).otherwise(0.0)
    return pages.select("doc_id", "page_no", "body", F.round(F.greatest(body * 1.25, heading * 1.1, floor), 6).alias("threshold"))


def title_sized(lines: DataFrame) -> DataFrame:
    """Lines that are large enough for a heading, hold a letter and are no longer than a title."""
    at = lines.join(heading_thresholds(lines), ["doc_id", "page_no"])
    return at.where((F.col("size") >= F.col("threshold")) & (F.length("text") < 200) & F.col("text").rlike(r"\p{L}")).select("doc_id", "page_no", "row_no", "size", "bold")


def heading_tiers(tagged: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, size_key, bold, level of styles on ``least`` pages: the level most of their lines are tagged with, the shallower of equals."""
    style = ["doc_id", "size_key", "bold"]
    levels = tagged.groupBy(*style, "level").agg(F.count("*").alias("n"))
    best = levels.groupBy(*style).agg(F.max_by("level", F.struct("n", -F.col("level"))).alias("level"))
    pages = tagged.groupBy(*style).agg(F.countDistinct("page_no").alias("pages"))
    return best.join(pages, style).where(F.col("pages") >= least).select(*style, "level")


def ranked_levels(lines: DataFrame, tiers: DataFrame) -> DataFrame:
    """Each line's level: of the largest tier of its weight that is not above its size."""
    t = tiers.groupBy("doc_id", "bold").agg(F.array_sort(F.collect_list(F.struct((-F.col("size_key")).alias("k"), "level"))).alias("tiers"))
    ranked = lines.join(t, ["doc_id", "bold"], "left")
    level = F.get(F.filter("tiers", lambda x: -x["k"] <= size_key(F.col("size"))), F.lit(0))["level"]
    return ranked.select("doc_id", "page_no", "row_no", level.alias("level"))


def numbered_sections(lines: DataFrame) -> DataFrame:
    """doc_id, size_key, n: numbered titles larger than the body that rise from 1 in steps of 3 at most, three or more of one size."""
    number = section_number(F.col("text"))
    found = lines.join(heading_thresholds(lines).select("doc_id", "page_no", "body"), ["doc_id", "page_no"]).where(number.rlike("^[0-9]+$") & (F.col("size") >= F.col("body") * 1.1))
    found = found.select("doc_id", size_key(F.col("size")).alias("size_key"), "page_no", "y", number.cast("int").alias("number"))
    order = Window.partitionBy("doc_id", "size_key").orderBy("page_no", F.desc("y"))
    steps = found.select("*", (F.col("number") - F.lag("number").over(order)).alias("step"), F.row_number().over(order).alias("k"))
    good = steps.groupBy("doc_id", "size_key").agg(F.count("*").alias("n"), F.min(F.when(F.col("k") == 1, F.col("number"))).alias("first"), F.min("step").alias("least"), F.max("step").alias("most"))
    return good.where("n >= 3 AND first = 1 AND least >= 1 AND most <= 3").select("doc_id", "size_key", "n")


def line_heights(lines: DataFrame) -> DataFrame:
    """doc_id, rounded, quartile, median of line heights by index: the lower quartile, and the upper of two middles."""
    sorted_ = F.array_sort(F.collect_list("h"))
    held = lines.groupBy("doc_id", F.round("size").cast("int").alias("rounded")).agg(sorted_.alias("hs"), F.count("*").alias("n"))
    at = lambda part: F.get("hs", F.floor(F.col("n") / part).cast("int"))
    return held.select("doc_id", "rounded", at(4).alias("quartile"), at(2).alias("median"))


def page_rects(lines: DataFrame, width: float) -> DataFrame:
    """doc_id, page_no, the union of a page's lines, and whether it is a type page: even side margins of a seventh at least."""
    u = lines.groupBy("doc_id", "page_no").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"), F.min("y").alias("foot"), F.max(F.col("y") + F.col("h")).alias("top"))
    a, b = F.col("left"), F.lit(width) - F.col("right")
    return u.withColumn("type_page", (a >= width / 7) & (b >= width / 7) & (F.abs(a - b) <= width / 50))


# --- two lines, a above b, as structs of x, y, w, h, size --------------------------------------------------


def same_size(a: Column, b: Column) -> Column:
    return F.abs(a["size"] - b["size"]) <= b["size"] * 0.1


def same_row(a: Column, b: Column) -> Column:
    shared = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return shared >= F.least(a["h"], b["h"]) * 0.5


def shares_column(a: Column, b: Column) -> Column:
    return (b["x"] < a["x"] + a["w"]) & (b["x"] + b["w"] > a["x"])


def stacks_under(a: Column, b: Column) -> Column:
    """b may go on a's heading: alike in size, close below, one edge or the middle aligned."""
    size = F.greatest(a["size"], b["size"])
    close = (b["y"] < a["y"]) & (b["y"] + b["h"] >= a["y"] - size) & (a["y"] - b["y"] <= size * 2.2)
    left, right = F.abs(a["x"] - b["x"]), F.abs(a["x"] + a["w"] - b["x"] - b["w"])
    middle = F.abs(a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2)
    return (F.abs(a["size"] - b["size"]) <= size * 0.1) & ~same_row(a, b) & close & (F.least(left, right, middle) <= size * 0.6)


def continues_broken_word(a: Column, b: Column) -> Column:
    size, gap = F.greatest(a["size"], F.lit(4.0)), a["y"] - b["y"] - b["h"]
    return a["text"].rlike("[-­]$") & b["text"].rlike(r"^\p{Ll}") & (F.abs(a["x"] - b["x"]) <= size * 0.25) & (gap >= size * -0.2) & (gap <= size * 0.8)


# --- rectangles -----------------------------------------------------------------------------------------------


def is_thin_rule(w: Column, h: Column) -> Column:
    return (h <= 6) & (w >= F.greatest(F.lit(12.0), h * 3))


def is_edge_band(y: Column, w: Column, h: Column, width: float, height: float) -> Column:
    return (w >= width * 0.9) & ((y <= 1) | (y + h >= height - 1))


def covers_page(w: Column, h: Column, width: float, height: float) -> Column:
    return w * h > width * height * 0.75


def is_folio_in_margin(text: Column, middle: Column, height: float) -> Column:
    short = (F.length(F.regexp_replace(text, r"[\t\n\r ]", "")) <= 4) & text.rlike(r"\p{N}") & ~text.rlike(r"\p{L}")
    return short & ((middle / height <= 0.10) | (middle / height >= 0.90))


def upright(turn: Column, rect: Column) -> Column:
    """A rectangle in the frame in which its turned text reads upright."""
    turned = lambda x, y: F.struct(x.alias("x"), y.alias("y"), rect["h"].alias("w"), rect["w"].alias("h"))
    same = F.struct(*[rect[c].alias(c) for c in ("x", "y", "w", "h")])
    return F.when(turn == "clockwise", turned(-(rect["y"] + rect["h"]), rect["x"])).when(turn == "counterclockwise", turned(rect["y"], -(rect["x"] + rect["w"]))).otherwise(same)
