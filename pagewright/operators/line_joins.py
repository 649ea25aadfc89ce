"""Joining printed lines: substitutes for hyphens, join decisions, cross-page continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import named
from ..functions.lines import join_operation, word_halves

# Characters a book may draw as its line-end hyphen.
SUBSTITUTES = ("=", "¬", "~", "_", "|", "\\", "+", "*", "/", "<", ">", "^", "¦")


def line_end_substitute(wrapped: DataFrame) -> DataFrame:
    """doc_id, mark: the one character whose uses nearly all end a line inside a word."""
    marks = F.array_distinct(F.regexp_extract_all("line", F.lit(f"[{''.join(chr(92) + c for c in SUBSTITUTES)}]"), F.lit(0)))
    each = wrapped.select("doc_id", "line", "next_line", F.explode(marks).alias("mark"))
    final = F.col("line").endswith(F.col("mark")) & F.substring("line", -2, 2).rlike("\\p{L}.\\z")
    tally = each.groupBy("doc_id", "mark").agg(
        F.sum(F.length("line") - F.length(F.replace("line", "mark", F.lit("")))).alias("total"),
        F.sum(final.cast("int")).alias("final"),
        F.sum((final & F.col("next_line").isNotNull()).cast("int")).alias("continuable"),
        F.sum((final & F.coalesce(F.col("next_line").rlike("^\\p{Ll}"), F.lit(False))).cast("int")).alias("lowercase"),
    )
    fit = tally.where("total >= 8 AND final * 100 >= total * 95 AND lowercase * 10 >= continuable * 9")
    return fit.groupBy("doc_id").agg(F.min("mark").alias("mark"), F.count("*").alias("k"), F.min("total").alias("total")).where("k = 1").select("doc_id", "mark", "total")


def _decided(wrapped: DataFrame) -> DataFrame:
    """doc_id, lines, operations: what joins each line to the next, decided in the document's row against its own words, so nothing is shuffled."""

    def operations(lines: Column) -> Column:
        def pair(line: Column, i: Column) -> Column:
            after, hyphen = F.get(lines, i + 1), line.endswith("-")
            prefix, suffix = word_halves(line, after)
            return F.struct(line.alias("line"), after.alias("next"), F.when(hyphen, prefix).alias("prefix"), F.when(hyphen, suffix).alias("suffix"))

        return named(F.filter(F.transform(lines, pair), lambda p: p["next"].isNotNull()), decided)

    def decided(pairs: Column) -> Column:
        asked = F.transform(F.filter(pairs, lambda p: p["prefix"].isNotNull()), lambda p: F.array(F.concat(p["prefix"], p["suffix"]), F.concat(p["prefix"], F.lit("-"), p["suffix"])))
        of = lambda held: F.transform(pairs, lambda p: join_operation(p["line"], p["next"], lambda w: F.array_contains(held, w), (p["prefix"], p["suffix"])))
        return named(F.array_intersect("words", F.flatten(asked)), of)

    return wrapped.select("doc_id", "lines", named(F.col("lines"), operations).alias("operations"))


def hyphen_join(wrapped: DataFrame) -> DataFrame:
    """doc_id, line_no, operation for every line with a next one: the document's own words decide a hyphen."""
    # outer, or the optimizer asks for the array's size first and decides everything twice
    return _decided(wrapped).select("doc_id", F.posexplode_outer("operations").alias("line_no", "operation")).where("line_no IS NOT NULL")


def paragraph_join(wrapped: DataFrame) -> DataFrame:
    """doc_id, n_chars, digest of each document's lines joined as decided."""

    def piece(line: Column, i: Column) -> Column:
        done = F.get("operations", i)
        cut = F.substring(line, F.lit(1), F.length(line) - 1)
        return F.when(done == "remove", cut).when(done == "space", F.concat(line, F.lit(" "))).otherwise(line)

    joined = _decided(wrapped).select("doc_id", F.array_join(F.transform("lines", piece), "").alias("text"))
    return joined.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def continuation_pairs(turns: DataFrame) -> DataFrame:
    """Neighbouring turns where the left is unfinished and the right opens in lower case."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select("conv_id", "turn", "text", F.lead("text").over(order).alias("next_text"))
    joins = ~F.col("text").rlike("[.!?:]$") & F.col("next_text").rlike("^\\p{Ll}")
    return pairs.where("next_text IS NOT NULL").select("conv_id", "turn", F.coalesce(joins, F.lit(False)).alias("continues"))
