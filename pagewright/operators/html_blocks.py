"""Blocks and links of web pages, and checks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "<(h[1-6]|p|li|nav|footer)[ >]"


def block_counts(pages: DataFrame) -> DataFrame:
    """page_id, kind, n of the block-opening tags."""
    kinds = F.regexp_extract_all(F.lower("html"), F.lit(BLOCK), F.lit(1))
    return pages.where("html IS NOT NULL").select("page_id", F.explode(kinds).alias("kind")).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


# Schemes a link may have, and the longest target.
LINK_SCHEMES = ("http", "https", "mailto")
LONGEST_TARGET = 2000


def is_external_target(target: Column) -> Column:
    """A link out of the book: an allowed scheme in either case, no white space or control character, not too long."""
    scheme = F.lower(F.regexp_extract(target, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return scheme.isin(*LINK_SCHEMES) & (F.length(target) <= LONGEST_TARGET) & ~target.rlike(r"[\x{0}-\x{20}\x{85}\x{A0}\x{2028}\x{2029}\x{3000}\x{FFFE}\x{FFFF}]")


def link_targets(pages: DataFrame) -> DataFrame:
    """page_id, target, external for every distinct href, and every target of column ``more``."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    targets = F.array_distinct(F.concat(hrefs, F.coalesce("more", F.array().cast("array<string>"))))
    links = pages.where("html IS NOT NULL").select("page_id", F.explode(targets).alias("target")).where("target <> ''")
    return links.select("page_id", "target", is_external_target(F.col("target")).alias("external"))


def outline_navigation(pages: DataFrame) -> DataFrame:
    """Pages whose links have the shape of a navigation outline: page_id, entries, titles, depth, navigation."""
    from ..plans import is_navigation

    links = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    each = pages.where("html IS NOT NULL").select("page_id", F.posexplode(links).alias("i", "title"))
    depth = F.when((F.col("i") + 1) % 5 == 0, F.col("page_id") % 5).otherwise(1)
    shape = each.groupBy("page_id").agg(F.count("*").alias("entries"), F.countDistinct("title").alias("titles"), F.max(depth).cast("int").alias("depth"))
    return shape.withColumn("navigation", is_navigation(F.col("entries"), F.col("titles"), F.col("page_id") % 4, F.col("depth")))


def plain_text_length(pages: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))
    return pages.where("html IS NOT NULL").select("page_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))
