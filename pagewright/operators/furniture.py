"""Running heads, feet and folios: lines that repeat in the margins of a document's pages.

A candidate is a short line in a margin band.  Its signature is its text with digits masked; candidates of one edge and
signature that stand on neighbouring pages, near the place and size of their run's first, are a run, and
runs of three are furniture.  A run's anchor is its first line, so a run is a fold over a document's pages and not a
comparison of neighbours; a fold's input is one document's candidates of one signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_folio
from ..functions.lines import tokens

# The bands, what a run tolerates, and how often lines must repeat.
TOP, BOTTOM = 0.90, 0.07
DRIFT, FOLIO_DRIFT = 0.004, 0.04
LONGEST, LEAST = 100, 3


def masked(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]+", "#")


def candidates(lines: DataFrame, height: float) -> DataFrame:
    """Lines that may be furniture: doc_id, page_no, row_no, edge, signature, position, size, folio."""
    folio = is_folio(F.trim("text"))
    middle = (F.col("y") + F.col("h") / 2) / height
    foot = F.when(folio, F.col("y") / height).otherwise(middle)
    edge = F.when(middle >= TOP, "top").when(foot <= BOTTOM, "bottom")
    found = lines.select("doc_id", "page_no", "row_no", edge.alias("edge"), masked(F.col("text")).alias("signature"), middle.alias("position"), "size", folio.alias("folio"), "text")
    short = (F.length("text") < LONGEST) & (F.size(tokens(F.col("text"))) > 0)
    return found.where(F.col("edge").isNotNull() & short).drop("text")


def runs(found: DataFrame) -> DataFrame:
    """Each candidate with its run: doc_id, edge, signature, page_no, row_no, run."""
    line = F.struct("page_no", "row_no", "position", "size", "folio")
    groups = found.groupBy("doc_id", "edge", "signature").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    kind = "struct<page:int,position:double,size:double,folio:boolean,run:int,out:array<struct<page_no:int,row_no:int,run:int>>>"
    start = F.struct(F.lit(None).alias("page"), F.lit(0.0).alias("position"), F.lit(0.0).alias("size"), F.lit(False).alias("folio"), F.lit(0).alias("run"), F.array().alias("out")).cast(kind)

    def step(s: Column, c: Column) -> Column:
        folios = s["folio"] & c["folio"]
        near = F.abs(c["position"] - s["position"]) <= F.when(folios, FOLIO_DRIFT).otherwise(DRIFT)
        like = F.abs(c["size"] - s["size"]) <= F.greatest(F.lit(0.5), s["size"] * F.when(folios, 0.25).otherwise(0.1))
        goes_on = F.coalesce((c["page_no"] - s["page"]).between(1, 2) & near & like, F.lit(False))
        run = F.when(goes_on, s["run"]).otherwise(s["run"] + 1)
        kept = lambda name: F.when(goes_on, s[name]).otherwise(c[name]).alias(name)
        out = F.concat(s["out"], F.array(F.struct(c["page_no"].alias("page_no"), c["row_no"].alias("row_no"), run.alias("run"))))
        return F.struct(c["page_no"].alias("page"), kept("position"), kept("size"), kept("folio"), run.alias("run"), out.alias("out")).cast(kind)

    folded = F.aggregate("lines", start, step, lambda s: s["out"])
    return groups.select("doc_id", "edge", "signature", F.inline(folded))


def plan(found: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, page_no, row_no of the lines that are furniture; documents of fewer than three pages have none."""
    each = runs(found)
    long = each.groupBy("doc_id", "edge", "signature", "run").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return each.join(long.drop("n"), ["doc_id", "edge", "signature", "run"]).select("doc_id", "page_no", "row_no").distinct()


def drop_folios(lines: DataFrame, planned: DataFrame) -> DataFrame:
    """doc_id, offset: what the numbers of planned lines say beyond their page, alike on six pages and a quarter of all."""
    words = tokens(F.col("text"))
    ends = F.array_distinct(F.array(F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)))
    said = lines.join(planned, ["doc_id", "page_no", "row_no"]).select("doc_id", "page_no", F.explode(ends).alias("t")).where(F.col("t").rlike("^[0-9]{1,9}$"))
    offsets = said.select("doc_id", "page_no", (F.col("t").cast("int") - F.col("page_no")).alias("offset")).groupBy("doc_id", "offset").agg(F.countDistinct("page_no").alias("n"))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    floor = F.greatest(F.lit(6), F.floor((F.col("pages") + 3) / 4))
    return offsets.join(pages, "doc_id").where(F.col("n") >= floor).select("doc_id", "offset", "n")


def dropped(lines: DataFrame, planned: DataFrame) -> DataFrame:
    """The lines that stay: a page keeps all its lines where none would remain."""
    marked = lines.join(planned.withColumn("gone", F.lit(True)), ["doc_id", "page_no", "row_no"], "left")
    kept = marked.groupBy("doc_id", "page_no").agg(F.count_if(F.col("gone").isNull()).alias("kept"))
    return marked.join(kept, ["doc_id", "page_no"]).where(F.col("gone").isNull() | (F.col("kept") == 0)).drop("gone", "kept")


def synthetic_margins(lines: DataFrame, height: float) -> DataFrame:
    """doc_id, key, n: masked lines of the outer margins that stand on half of a document's pages, three at least."""
    middle = F.col("y") + F.col("h") / 2
    edge = F.when(middle > height * 0.93, "top:").when(middle < height * 0.07, "bottom:")
    keys = lines.where(F.length("text") < LONGEST).select("doc_id", "page_no", F.concat(edge, masked(F.col("text"))).alias("key")).where("key IS NOT NULL").distinct()
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    counted = keys.groupBy("doc_id", "key").agg(F.count("*").alias("n")).join(pages, "doc_id")
    return counted.where((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(3), F.floor((F.col("pages") + 1) / 2)))).select("doc_id", "key", "n")
