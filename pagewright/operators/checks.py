"""Evaluation operators: contracts and run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases the content contract asks for.
CONTRACT = ("all rights reserved", "licensed under the apache license", "privacy policy", "the and attion to")


def contract_checks(documents: DataFrame, phrases: tuple[str, ...] = CONTRACT) -> DataFrame:
    """phrase, n_docs that hold it; the phrases are a literal list, so documents are read once and never joined."""
    low = F.lower("text")
    sums = [F.sum(F.coalesce(low.contains(p), F.lit(False)).cast("bigint")).alias(f"p{i}") for i, p in enumerate(phrases)]
    one = documents.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(p).alias("phrase"), F.coalesce(F.col(f"p{i}"), F.lit(0).cast("bigint")).alias("n_docs")) for i, p in enumerate(phrases)])
    return one.select(F.inline(pairs))


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, change (added, removed, changed) between two runs' records (doc_id, digest)."""
    a = before.select("doc_id", F.col("digest").alias("old"))
    b = after.select(F.col("doc_id").alias("other"), F.col("digest").alias("new"))
    both = a.join(b, a["doc_id"] == b["other"], "full")
    change = F.when(F.col("doc_id").isNull(), "added").when(F.col("other").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(F.coalesce("doc_id", "other").alias("doc_id"), change.alias("change")).where("change IS NOT NULL")


# Kinds of content checks, the blocks each one looks at, and how: held, absent, or opening a block.
CHECKS = {
    "text": ("page", "held"), "absentText": ("page", "absent"), "headings": ("heading", "held"), "paragraphs": ("paragraph", "held"),
    "paragraphOpenings": ("paragraph", "opening"), "asides": ("aside", "held"), "quotations": ("quotation", "held"),
    "preformatted": ("preformatted", "held"), "absentPreformatted": ("preformatted", "absent"),
}


def content_violations(expected: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page, check, phrase of the expectations that a document's blocks don't meet.

    ``expected`` holds doc_id, page, check, phrase and ``blocks`` doc_id, page, kind, text, both in normal form; a page's
    whole text is a block of kind ``page``.  An expectation meets the blocks of its own page and kind only.
    """
    kind = F.create_map(*[F.lit(x) for check, (of, _) in CHECKS.items() for x in (check, of)])[F.col("check")]
    mode = F.create_map(*[F.lit(x) for check, (_, how) in CHECKS.items() for x in (check, how)])[F.col("check")]
    wanted = expected.select("doc_id", "page", "check", "phrase", kind.alias("kind"), mode.alias("mode")).distinct()
    held = F.when(F.col("mode") == "opening", F.col("text").startswith(F.col("phrase"))).otherwise(F.col("text").contains(F.col("phrase")))
    met = wanted.join(blocks, ["doc_id", "page", "kind"], "left").groupBy("doc_id", "page", "check", "phrase", "mode").agg(F.bool_or(F.coalesce(held, F.lit(False))).alias("found"))
    return met.where(F.col("found") == (F.col("mode") == "absent")).select("doc_id", "page", "check", "phrase")


def check_census(expected: DataFrame) -> DataFrame:
    """check, n, pages, documents: how many expectations there are of each kind, without looking at any text."""
    return expected.groupBy("check").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "page").alias("pages"), F.countDistinct("doc_id").alias("documents"))


def spine_crossings(joins: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, ord, verdict of pairs of phrases that a book sets one after the other: once each, in one file in order, or across two files.

    ``joins`` holds doc_id, ord, before, after; ``files`` doc_id, file, text in order of file.
    """
    of_book = files.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("file", "text"))).alias("files"))
    uses = lambda p: F.aggregate("files", F.lit(0), lambda n, f: n + F.size(F.split(f["text"], F.concat(F.lit("\\Q"), F.col(p), F.lit("\\E")))) - 1)
    place = lambda p: F.get(F.filter(F.transform("files", lambda f, i: F.when(F.contains(f["text"], F.col(p)), i)), lambda i: i.isNotNull()), F.lit(0))
    both = joins.join(of_book, "doc_id")
    at = both.select("doc_id", "ord", "before", "after", "files", uses("before").alias("n"), uses("after").alias("m"), place("before").alias("i"), place("after").alias("j"))
    text = F.get("files", F.col("i"))["text"]
    ordered = F.instr(F.substring(text, F.instr(text, F.col("before")) + F.length("before"), F.length(text)), F.col("after")) > 0
    verdict = F.when((F.col("n") != 1) | (F.col("m") != 1), "repeated").when(F.col("i") == F.col("j"), F.when(ordered, "inside").otherwise("disordered")).when(F.col("j") == F.col("i") + 1, "across").otherwise("apart")
    return at.select("doc_id", "ord", verdict.alias("verdict"))
