"""Word classes of a document against a lexicon: known, misread, neutral, lonely letters.

A document's words are rows; the lexicon is a table of its own and is joined by equality, so neither has to fit
in a task.  A word's neighbours come from a window inside its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import LATIN, letter_words, named, runs
from ..functions.lines import tokens

# Endings that a word may carry, and the length from which a lower-case word can be misread.
CLITIC = "(?i)^(.+)('s|n't|'ll|'re|'ve|'m|'d)$"
MISREAD_LENGTH = 3


def lexicon(texts: DataFrame) -> DataFrame:
    """word: the distinct lower-case words of two letters or more in column text."""
    return texts.where("text IS NOT NULL").select(F.explode(letter_words(F.col("text"))).alias("w")).select(F.lower("w").alias("word")).distinct()


def words(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, at, word of every piece of every token."""
    line = F.col("line")
    inner = runs(line, r"\p{L}(?:\P{IsWhite_Space}*\p{L})?")  # each token from its first letter to its last
    parted = F.filter(F.flatten(F.transform(inner, lambda x: F.split(x, "-"))), lambda x: x != "")
    bare = lambda x: F.when(x.contains("'") | x.contains("’"), F.regexp_replace(F.translate(x, "’", "'"), CLITIC, "$1")).otherwise(x)
    pieces = named(F.when(line.contains("-"), parted).otherwise(inner), lambda x: F.when(line.contains("'") | line.contains("’"), F.transform(x, bare)).otherwise(x))
    # outer, or the optimizer asks for the array's size first and cuts every line twice
    return lines.select("doc_id", "line_no", F.posexplode_outer(pieces).alias("at", "word")).where("at IS NOT NULL")


def word_counts(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of each document: tokens, numeric_tokens, number_tokens, english, damaged, neutral, misread, lonely."""
    numeric = lambda t: F.filter(t, lambda x: x.rlike(r"\p{N}"))
    sizes = lambda t: named(numeric(t), lambda m: F.struct(F.size(t).alias("n"), F.size(m).alias("m"), F.size(F.filter(m, lambda x: ~x.rlike(r"\p{L}"))).alias("k")))
    per_line = lines.select("doc_id", named(tokens(F.col("line")), sizes).alias("s")).select("doc_id", "s.n", "s.m", "s.k")
    token_sums = per_line.groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.sum("m").alias("numeric_tokens"), F.sum("k").alias("number_tokens"))

    order = Window.partitionBy("doc_id").orderBy("line_no", "at")
    w = words(lines).select("doc_id", "line_no", "word", F.lag("word").over(order).alias("before"), F.lead("word").over(order).alias("after"))
    word, asked = F.col("word"), lambda key, i: known.select(F.col("word").alias(key), F.lit(True).alias(f"in{i}"))
    w = w.withColumn("k0", F.lower("word")).join(asked("k0", 0), "k0", "left")
    foreign = ~word.rlike(f"^[{LATIN}]*$") & F.regexp_replace("word", f"[{LATIN}]", "").rlike(r"\p{L}")
    letters, lower, upper, capital = word.rlike(r"^\p{L}+$"), word.rlike(r"^\p{Ll}+$"), word.rlike(r"^\p{Lu}+$"), word.rlike(r"^\p{Lu}\p{Ll}*$")
    bare = word.isin("a", "A", "i", "I")
    single = F.when(bare, "bare").when(lower, "damaged").otherwise("neutral")
    unknown = F.when(~lower & (upper | capital | word.rlike(r"^(\p{Lu}\p{Ll}+){2,}$")), "neutral").when(lower & (F.length("word") < MISREAD_LENGTH), "damaged")
    alone = (
        F.when(foreign, "damaged").when(~letters, "neutral").when(F.length("word") == 1, single)
        .when(F.col("in0").isNotNull() & (lower | upper | capital), "english").otherwise(unknown)
    )
    # what a word says by itself comes first: only where that leaves it open are its neighbours asked for
    w = w.select("doc_id", "line_no", "word", "before", "after", alone.alias("alone"))
    joined = lambda a, b: F.when(F.col("alone").isNull() & F.concat(a, b).rlike(r"^\p{L}+$"), F.lower(F.concat(a, b)))
    w = w.select("doc_id", "line_no", "alone", joined("before", "word").alias("k1"), joined("word", "after").alias("k2"))
    w = w.join(asked("k1", 1), "k1", "left").join(asked("k2", 2), "k2", "left")
    kind = F.coalesce("alone", F.when(F.col("in1").isNull() & F.col("in2").isNull(), "misread").otherwise("damaged"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    k = F.col("kind")
    by_line = w.select("doc_id", "line_no", kind.alias("kind")).groupBy("doc_id", "line_no").agg(
        count(k == "bare").alias("bare"), count(k == "english").alias("known"), count(k.isin("damaged", "misread")).alias("damaged"), count(k == "neutral").alias("neutral"), count(k == "misread").alias("misread")
    )
    sums = by_line.groupBy("doc_id").agg(
        F.sum(F.col("known") + F.col("bare")).alias("english"), F.sum("damaged").alias("damaged"), F.sum("neutral").alias("neutral"), F.sum("misread").alias("misread"),
        F.sum(F.when(F.col("known") == 0, F.col("bare")).otherwise(0)).alias("lonely"),
    )
    zero = F.lit(0).cast("bigint")
    return token_sums.join(sums.hint("merge"), "doc_id", "left").select("doc_id", "tokens", "numeric_tokens", "number_tokens", *[F.coalesce(c, zero).alias(c) for c in ("english", "damaged", "neutral", "misread", "lonely")])
