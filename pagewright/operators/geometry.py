"""Lines of a page against each other and against points and rectangles: joins inside a page, unique or nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]


def same_row_as(a: Column, b: Column) -> Column:
    shared = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return shared >= F.least(a["h"], b["h"]) * 0.5


def without_overprints(lines: DataFrame) -> DataFrame:
    """The lines but those that print the text of an earlier one again, in its size and place: doc_id, page_no, ord, text, x, y, w, h, size."""
    a, b = lines.alias("a"), lines.alias("b")
    near = lambda c, most: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= most
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_no") == F.col("b.page_no")) & (F.col("a.text") == F.col("b.text")) & (F.col("b.ord") < F.col("a.ord"))
    return a.join(b, on & near("size", 0.01) & near("x", 0.05) & near("y", 0.05) & near("w", 0.05) & near("h", 0.05), "left_anti")


def printed_rows(pieces: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, row: pieces from the top down, each on the row of the one that opened it, or opening one.

    The row's first piece is its measure, so a page is folded in order; a page's pieces are one array.
    """
    piece = F.struct((-F.col("y")).alias("k"), "ord", "y", "h")
    pages = pieces.groupBy(*PAGE).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    kind = "struct<y:double,h:double,row:int,out:array<struct<ord:int,row:int>>>"
    start = F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("h"), F.lit(0).alias("row"), F.array().alias("out")).cast(kind)

    def step(s: Column, p: Column) -> Column:
        on = (s["row"] > 0) & same_row_as(s, p)
        row = F.when(on, s["row"]).otherwise(s["row"] + 1)
        out = F.concat(s["out"], F.array(F.struct(p["ord"].alias("ord"), row.alias("row"))))
        return F.struct(F.when(on, s["y"]).otherwise(p["y"]).alias("y"), F.when(on, s["h"]).otherwise(p["h"]).alias("h"), row.alias("row"), out.alias("out")).cast(kind)

    return pages.select(*PAGE, F.inline(F.aggregate("pieces", start, step, lambda s: s["out"])))


def owners(points: DataFrame, rects: DataFrame) -> DataFrame:
    """doc_id, page_no, point, owner: the only rectangle of the page that holds the point; none where several do."""
    p, r = points.alias("p"), rects.alias("r")
    inside = F.col("p.px").between(F.col("r.x"), F.col("r.x") + F.col("r.w")) & F.col("p.py").between(F.col("r.y"), F.col("r.y") + F.col("r.h"))
    met = p.join(r, (F.col("p.doc_id") == F.col("r.doc_id")) & (F.col("p.page_no") == F.col("r.page_no")) & inside)
    found = met.groupBy("p.doc_id", "p.page_no", "p.point").agg(F.count("*").alias("n"), F.min("r.rect").alias("owner"))
    return found.where(F.col("n") == 1).select("doc_id", "page_no", "point", "owner")


def nearest_below(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, below, gap: the next line down that shares the column and not the row."""
    rect = F.struct("x", "y", "w", "h")
    a, b = lines.select(*PAGE, "ord", rect.alias("r")).alias("a"), lines.select(*PAGE, "ord", rect.alias("r")).alias("b")
    x, y = F.col("a.r"), F.col("b.r")
    column = (y["x"] < x["x"] + x["w"]) & (y["x"] + y["w"] > x["x"])
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_no") == F.col("b.page_no")) & (F.col("a.ord") != F.col("b.ord"))
    met = a.join(b, on & column & ~same_row_as(x, y) & (y["y"] + y["h"] <= x["y"] + x["h"] * 0.5))
    best = met.groupBy("a.doc_id", "a.page_no", "a.ord", x["y"].alias("foot")).agg(F.max(F.struct((y["y"] + y["h"]).alias("top"), (-F.col("b.ord")).alias("k"))).alias("n"))
    return best.select("doc_id", "page_no", "ord", (-F.col("n.k")).alias("below"), F.round(F.col("foot") - F.col("n.top"), 6).alias("gap"))


def top_lines(lines: DataFrame, height: float, most: int = 6) -> DataFrame:
    """doc_id, page_no, opening: the first lines of a page's upper half, as one normal phrase."""
    from ..functions.lines import normal_phrase

    order = Window.partitionBy(*PAGE).orderBy(F.desc("y"), "ord")
    first = lines.where(F.col("y") >= height / 2).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    said = first.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("k", normal_phrase(F.col("text")).alias("t")))).alias("t"))
    return said.select(*PAGE, F.array_join(F.transform("t", lambda x: x["t"]), " ").alias("opening"))
