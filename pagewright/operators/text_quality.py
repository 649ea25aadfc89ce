"""Text-quality statistics: words, stop words, rare letter pairs, token classes, vocabulary.

All per-document figures are folded inside the document's own row, so no shuffle is needed
and long documents stay one row.  Only the vocabulary and the pair table are aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import english_declared, letter_words, vocabulary_words

# English function words and report vocabulary.
STOP_WORDS = """
the of and to in a is that for it as was with be by on not he this are or his from at which but
have an had they you were their one all we can her has there been if more when will would who so no
than into them its two out then up also only new some could time these first any may other such
each about how because between under over after before both those most while where through many
during three now must does do did being made make used use using data page table figure section
number see chapter part per within without same different against however should very much still
even here just like every another might well since great little our own way too
""".split()

COMMON_PAIRS = 300
LEAST_WORDS, MOST_STOPS, LEAST_RARE = 20, 0.05, 0.30


def letter_pairs(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))


def common_pairs(documents: DataFrame, most: int = COMMON_PAIRS) -> list[str]:
    """The letter pairs that most distinct English words of the corpus hold; ``most`` rows reach the driver."""
    words = documents.where(english_declared(F.col("lang"))).select(F.explode(letter_words(F.col("text"))).alias("w"))
    words = words.select(F.lower("w").alias("w")).where(F.col("w").rlike("^[a-z]{2,}$")).distinct()
    pairs = words.select(F.explode(letter_pairs(F.col("w"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return [r["pair"] for r in pairs.orderBy(F.desc("n"), "pair").limit(most).collect()]


def encoding_statistics(documents: DataFrame, common: list[str]) -> DataFrame:
    """doc_id, lang, words, stop_rate, rare_rate: words are letter runs of two or more.

    Words and pairs are rows that generated code counts, summed in every task before the rows' numbers meet.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", letter_words(F.coalesce("text", F.lit(""))).alias("w"))
    words = rows.select("row", "doc_id", "lang", F.explode_outer("w").alias("word")).select("row", "doc_id", "lang", F.lower("word").alias("word"))
    plain = F.col("word").rlike("^[a-z]+$")
    n_pairs = F.when(plain, F.length("word") - 1).otherwise(0)
    places = F.when(plain, F.sequence(F.lit(1), F.length("word") - 1))
    each = words.select("row", "doc_id", "lang", "word", n_pairs.alias("pairs"), F.posexplode_outer(places).alias("k", "i"))
    first = F.coalesce("k", F.lit(0)) == 0
    rare = F.col("i").isNotNull() & ~F.substring("word", F.col("i"), F.lit(2)).isin(*common) if common else F.col("i").isNotNull()
    counted = each.groupBy("row", "doc_id", "lang").agg(
        F.sum((first & F.col("word").isNotNull()).cast("bigint")).alias("words"),
        F.sum((first & F.col("word").isin(*STOP_WORDS)).cast("bigint")).alias("stops"),
        F.sum(F.when(first, F.col("pairs")).otherwise(0)).alias("pairs"),
        F.sum(rare.cast("bigint")).alias("rare"),
    )
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 9)
    whole = counted.select("doc_id", "lang", "words", F.coalesce("stops", F.lit(0)).alias("stops"), "pairs", "rare")
    return whole.select("doc_id", "lang", "words", rate("stops", "words").alias("stop_rate"), rate("rare", "pairs").alias("rare_rate"))


def implausible(statistics: DataFrame) -> DataFrame:
    flag = english_declared(F.col("lang")) & (F.col("words") >= LEAST_WORDS) & (F.col("stop_rate") < MOST_STOPS) & (F.col("rare_rate") >= LEAST_RARE)
    return statistics.select("doc_id", F.coalesce(flag, F.lit(False)).alias("implausible"))


def vocabulary(lines: DataFrame) -> DataFrame:
    """word, n, n_docs over all lines; sums are made per task before the shuffle."""
    words = lines.select("doc_id", F.explode(vocabulary_words(F.col("line"))).alias("word"))
    per_doc = words.groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    return per_doc.groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


def token_counts(documents: DataFrame) -> DataFrame:
    """doc_id, tokens, numeric_tokens (hold a digit), number_tokens (digits and no letter)."""
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]+"), lambda t: t != "")
    numeric = F.filter("t", lambda t: t.rlike("[0-9]"))
    return documents.select("doc_id", tokens.alias("t")).select(
        "doc_id",
        F.size("t").cast("bigint").alias("tokens"),
        F.size(numeric).cast("bigint").alias("numeric_tokens"),
        F.size(F.filter(numeric, lambda t: ~t.rlike("\\p{L}"))).cast("bigint").alias("number_tokens"),
    )
