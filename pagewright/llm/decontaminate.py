"""Benchmark decontamination by winnowing, in DataFrame expressions alone.

Both sides hash every run of ``GRAM`` words and keep the smallest hash of each run of
``WINDOW - GRAM + 1`` consecutive grams.  Equal windows of ``WINDOW`` words keep the same
hash, so every shared span of that many words shares a fingerprint.  The benchmark's
fingerprints are folded into a bitmap of fixed size (``BITS`` bits, whatever the
benchmark's size), which every document row tests in place: no shuffle of documents, and
nothing that is sent out grows with the data.  A document gram that passes is a hit; it is
extended to the windows around it, and those are joined with the benchmark's windows on
their words, so false hits of the bitmap fall out.  Items of fewer than ``WINDOW`` words
are looked up through a second bitmap of their first words.

Defined results: null and wordless texts have no words and no hits; an item without words
or with a null id takes no part; items that repeat a window all count; a repeated row of
documents gives a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, words_column

WINDOW = 13
GRAM = 5
#: Bits of each bitmap; 64 a long, so the literal holds BITS / 64 longs at most.
BITS = 1 << 21
#: Benchmark windows that may be broadcast; beyond it the join shuffles.
BROADCAST_WINDOWS = 200_000


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gram_hashes(word_hashes: Column) -> Column:
    last = F.size(word_hashes) - GRAM
    grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(GRAM)]))
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(grams)


def winnow(grams: Column) -> Column:
    """Distinct smallest hashes of the sliding windows; none where the text is shorter than a window."""
    span = WINDOW - GRAM + 1
    last = F.size(grams) - span
    kept = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_min(F.slice(grams, i + 1, span))))
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(kept)


def slots(value: Column) -> tuple[Column, Column]:
    mask = F.lit(BITS - 1).cast("bigint")
    return value.bitwiseAND(mask), F.shiftrightunsigned(value, 30).bitwiseAND(mask)


def bitmap(values: DataFrame) -> Column | None:
    """A literal array of longs with two bits set for each value of column v; None if there is none."""
    one = F.explode(F.array(*slots(F.col("v")))).alias("s")
    words = values.select(one).groupBy(F.shiftright("s", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("bits")).collect()
    if not words:
        return None
    longs = ["0"] * (BITS // 64)
    for r in words:
        longs[r["at"]] = str(r["bits"])
    return F.split(F.lit(",".join(longs)), ",").cast("array<bigint>")


def passes(bits: Column, value: Column) -> Column:
    def one(slot: Column) -> Column:
        return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1

    first, second = slots(value)
    return one(first) & one(second)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(window, m, items): the distinct windows of the items, their word counts and item ids as strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_column(F.col("text")).alias("w"))
    items = items.where(F.col("item").isNotNull() & (F.size("w") > 0))
    items = items.select("item", "w", F.least(F.lit(WINDOW), F.size("w")).alias("m"))
    each = items.select("item", "m", F.explode(F.expr("transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))")).alias("window"))
    return each.groupBy("window", "m").agg(F.collect_set("item").alias("items"))


def hits_column(words: Column, grams_bits: Column | None, first_bits: Column | None, short: list[int]) -> Column:
    """Windows of a document's words that the bitmaps let pass: array<struct<start, m, window>>."""
    kind = "array<struct<start:int,m:int,window:string>>"
    none = F.array().cast(kind)

    def around(w: Column, hashes: Column) -> Column:
        """Windows of WINDOW words that hold a gram that passes."""
        ends = F.size(w) - WINDOW
        def of(grams: Column) -> Column:
            found = F.exists(winnow(grams), lambda x: passes(grams_bits, x))
            at = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: passes(grams_bits, F.get(grams, i)))
            starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - (WINDOW - GRAM), F.lit(0)), F.least(p, ends)))))
            return F.when(found, F.transform(F.filter(starts, lambda s: s <= ends), lambda s: F.struct(s.alias("start"), F.lit(WINDOW).alias("m"), F.array_join(F.slice(w, s + 1, WINDOW), " ").alias("window"))).cast(kind)).otherwise(none)

        return F.when(ends < 0, none).otherwise(let(gram_hashes(hashes), of))

    def shorter(w: Column, hashes: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: passes(first_bits, F.get(hashes, i)))
        each = F.transform(at, lambda p: F.array(*[F.struct(p.alias("start"), F.lit(m).alias("m"), F.array_join(F.slice(w, p + 1, m), " ").alias("window")) for m in short]))
        return F.when(F.size(w) == 0, none).otherwise(F.filter(F.flatten(each), lambda x: x["start"] + x["m"] <= F.size(w)).cast(kind))

    def both(w: Column, hashes: Column) -> Column:
        parts = ([around(w, hashes)] if grams_bits is not None else []) + ([shorter(w, hashes)] if first_bits is not None and short else [])
        return F.concat(*parts) if parts else none

    return let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: both(w, h)).alias("hits")))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of documents."""
    windows = materialize(item_windows(benchmark), "benchmark-windows")
    long_items = windows.where(F.col("m") == WINDOW).select(F.split("window", " ").alias("w"))
    prints = long_items.select(F.explode(let(F.transform("w", lambda x: F.xxhash64(x)), lambda h: winnow(gram_hashes(h)))).alias("v"))
    short_items = windows.where(F.col("m") < WINDOW)
    short = sorted(r["m"] for r in short_items.select("m").distinct().collect())  # at most WINDOW - 1 rows
    firsts = short_items.select(F.xxhash64(F.substring_index("window", " ", 1)).alias("v"))
    hits = hits_column(words_column(F.col("text")), bitmap(prints), bitmap(firsts) if short else None, short)
    found = documents.select("doc_id", F.xxhash64("text").alias("__key"), hits.alias("__x")).select("doc_id", "__key", "__x.n_words", "__x.hits")
    found = materialize(found, "decontaminate-hits")

    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("window") + 24 * F.size("items")), F.lit(0)).alias("b")).first()
    against = F.broadcast(windows) if size["n"] <= BROADCAST_WINDOWS and size["b"] <= 64_000_000 else windows
    each = found.where(F.size("hits") > 0).select("doc_id", "__key", F.inline("hits")).join(against, ["window", "m"])
    spans = each.groupBy("doc_id", "__key").agg(F.sort_array(F.collect_set(F.struct("start", "m"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["m"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["m"] - F.greatest(a["end"], s["start"]))).alias("n")))
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("__key").alias("__k"), covered["n"].cast("bigint").alias("__n"), F.array_sort("items").alias("__items"))
    out = found.join(spans, found["doc_id"].eqNullSafe(spans["__d"]) & found["__key"].eqNullSafe(spans["__k"]), "left")
    n_hit = F.coalesce("__n", F.lit(0).cast("bigint"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("__items").isNull(), 0).otherwise(F.size("__items")).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("__items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least({WINDOW}, len(w)) AS m FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
dp AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM dp),
h AS (SELECT doc_id, item, i, m FROM dw JOIN bw USING (m, s)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
