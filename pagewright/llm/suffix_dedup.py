"""Removal of long repeated byte strings by bounded interval expansion on a Burrows-Wheeler transform.

A window of ``SPAN`` bytes that starts at two places must be found whatever texts hold it.
``windows`` gives every window an owner gram, equal for equal windows, so:

1. A scan counts the owners over all texts (summed in each batch and task first) and keeps,
   for each, the smallest and largest hash of its stretches' bytes.  An owner seen once owns
   no repeated window.  An owner whose stretches are all alike makes all their windows
   repeated.
2. A second scan finds the stretches of the other owners again (a bitmap of fixed size lets
   few others through, and a join with the owners drops those) and takes their bytes along,
   once for each different stretch.
3. Different stretches of one owner come together and form a text of their own, for which a
   suffix array and the Burrows-Wheeler transform are built.  Breadth-first backward
   extension sets the entries of the common-prefix array by increasing value; it ends at
   ``SPAN``, so entries that are still open mark the windows that start at two places.
   Owners with more than ``GROUP`` different stretches would make an unbounded group: their
   windows are hashed (128 bits) and counted across tasks instead.
4. The repeated windows' byte ranges return to their documents, which are cut.

Defined results: null texts are empty; texts under ``SPAN`` bytes hold no window; a repeated
row is another place, so both rows lose all windows; texts are bytes, so a cut may fall
inside a character (``__kept_text`` drops such halves).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, table
from .pieces import ragged, texts_of
from .windows import SPAN, slices, stretches

#: Different stretches of one owner that form one text.
GROUP = 2048
#: Bytes of stretches that are sorted together.
SORTED_BYTES = 1 << 18
#: Stretches of an Arrow batch that goes back to the JVM: about 1 MB with their bytes.
FOUND_ROWS = 4096
#: Bits of the bitmap of owners that repeat.
BITS = 1 << 24


# --- suffix array, transform and bounded expansion -------------------------------------------------


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by doubling; symbols are such that no two suffixes are equal."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.uint64)
    width = 1
    while True:
        ahead = np.zeros(n, np.uint64)
        if width < n:
            ahead[: n - width] = rank[width:] + np.uint64(1)
        key = rank << np.uint64(32) | ahead
        order = np.argsort(key, kind="stable")
        held = key[order]
        fresh = np.empty(n, np.uint64)
        fresh[order] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])]).astype(np.uint64)
        rank, width = fresh, width * 2
        if int(rank[order[-1]]) == n - 1:
            return order


def repeated_starts(pieces: list[bytes], least: int) -> np.ndarray:
    """Places in the pieces, laid end to end with one place after each, where a string of ``least`` bytes starts that also starts elsewhere."""
    m = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, m)
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    symbols = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int32) + np.int32(m)
    symbols[ends] = np.arange(m)  # every end is a symbol of its own, below all bytes
    order = suffix_array(symbols).astype(np.int32)  # places fit 32 bits: half the memory
    transform = symbols[order - 1]
    columns = np.argsort(transform, kind="stable").astype(np.int32)  # place in the first column -> place in the transform
    to_first, all_places = np.empty(n, np.int32), np.arange(n, dtype=np.int32)
    to_first[columns] = all_places
    previous = np.full(n, -1, np.int32)  # last place before with the same symbol
    same = transform[columns[1:]] == transform[columns[:-1]]
    previous[columns[1:][same]] = columns[:-1][same]
    following = np.full(n, n, np.int32)
    following[columns[:-1][same]] = columns[1:][same]
    del columns, same

    common = np.full(n + 1, -1, np.int32)
    common[: m + 1] = 0
    common[n] = 0
    low, high = all_places[:m], all_places[:m]  # intervals of the ends
    first_symbol = symbols[order]
    starts = (np.flatnonzero(np.diff(first_symbol[m:], prepend=-1)) + m).astype(np.int32)
    stops = np.append(starts[1:], np.int32(n)) - np.int32(1)
    del first_symbol
    fresh = common[stops + 1] < 0
    fresh[-1:] = True
    common[stops + 1] = 0
    low, high = np.concatenate([low, starts[fresh]]), np.concatenate([high, stops[fresh]])
    for length in range(1, least):
        if not len(low):
            break
        one = low == high
        single = low[one]
        new_low = new_high = to_first[single[transform[single] >= m]]
        low, high = low[~one], high[~one]
        if len(low):
            size = high - low + 1
            places = ragged(all_places, low, size)
            at_low, at_high = np.repeat(low, size), np.repeat(high, size)
            letter = transform[places] >= m
            firsts = letter & (previous[places] < at_low)
            lasts = letter & (following[places] > at_high)
            # a symbol's first and last place of an interval, both in order of symbol within the interval
            which = np.repeat(all_places[: len(low)], size)
            a, b = places[firsts], places[lasts]
            a = a[np.lexsort((transform[a], which[firsts]))]
            b = b[np.lexsort((transform[b], which[lasts]))]
            new_low, new_high = np.concatenate([new_low, to_first[a]]), np.concatenate([new_high, to_first[b]])
        still = common[new_high + 1] < 0
        low, high = new_low[still], new_high[still]
        common[high + 1] = length
    open_at = common[:n] < 0
    repeated = open_at.copy()
    repeated[:-1] |= open_at[1:]
    return np.sort(order[repeated])


def _ranges(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last)."""
    if not len(numbers):
        return []
    cut = np.flatnonzero(np.diff(numbers) != 1)
    return list(zip(numbers[np.concatenate([[0], cut + 1])].tolist(), numbers[np.concatenate([cut, [len(numbers) - 1]])].tolist(), strict=True))


# --- scans ------------------------------------------------------------------------------------------


def _all_stretches(column: pa.Array):
    """Stretches of a batch, with the text's number in the batch, and the bytes they lie in."""
    data, offsets = texts_of(column)
    found = []
    for begin, stop in slices(offsets):
        text, *rest = stretches(data[offsets[begin] : offsets[stop]], offsets[begin : stop + 1] - offsets[begin])
        found.append((text + begin, *rest))
    return data, offsets, tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else None


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _owners(batches):
    for batch in batches:
        _, _, found = _all_stretches(batch["text"])
        if found is None or not len(found[0]):
            continue
        owner, content = found[3], found[4].view(np.int64)
        order = np.argsort(owner)
        owner, content = owner[order], content[order]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        counts = np.diff(np.append(first, len(owner)))
        yield pa.RecordBatch.from_arrays([_signed(owner[first]), pa.array(counts), pa.array(np.minimum.reduceat(content, first)), pa.array(np.maximum.reduceat(content, first))], names=["owner", "n", "least", "most"])


def _slots(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(BITS - 1)
    return owner & mask, (owner >> np.uint64(30)) & mask


def _bitmap(owners: DataFrame) -> np.ndarray:
    """BITS bits with two set for every owner; summed by word, so BITS / 64 rows reach the driver at most."""
    slot = F.explode(F.array(F.col("owner").bitwiseAND(F.lit(BITS - 1).cast("bigint")), F.shiftrightunsigned("owner", 30).bitwiseAND(F.lit(BITS - 1).cast("bigint")))).alias("s")
    words = owners.select(slot).groupBy(F.shiftright("s", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


_FOUND = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("owner", pa.int64()), ("content", pa.int64()), ("bytes", pa.binary())])


def _likely(bitmap):
    def run(batches):
        bits = bitmap.value
        for batch in batches:
            data, offsets, found = _all_stretches(batch["text"])
            if found is None:
                continue
            text, first, count, owner, content = found
            a, b = _slots(owner)
            hit = ((bits[a >> np.uint64(6)] >> (a & np.uint64(63))) & (bits[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)
            text, first, count, owner, content = (x[hit] for x in (text, first, count, owner, content))
            if not len(text):
                continue
            alike = np.unique(np.stack([owner, content], 1).view([("a", "u8"), ("b", "u8")]).ravel(), return_index=True)[1]
            taken = np.zeros(len(text), bool)
            taken[alike] = True
            starts = offsets[text] + first
            stops = starts + count - 1 + SPAN
            held = memoryview(data)
            for k in range(0, len(text), FOUND_ROWS):  # bytes are copied for the rows of one batch at a time
                some = slice(k, k + FOUND_ROWS)
                bytes_taken = [held[a:b].tobytes() if t else None for t, a, b in zip(taken[some].tolist(), starts[some].tolist(), stops[some].tolist(), strict=True)]
                docs, keys = (batch[c].take(pa.array(text[some])) for c in ("doc", "key"))
                yield pa.RecordBatch.from_arrays([docs, keys, pa.array(first[some].astype(np.int32)), pa.array(count[some].astype(np.int32)), _signed(owner[some]), _signed(content[some]), pa.array(bytes_taken, pa.binary())], schema=_FOUND)

    return run


_PARTS = pa.schema([("owner", pa.int64()), ("content", pa.int64()), ("parts", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _expand(batches):
    """Groups of one owner, several at a time, through the bounded expansion; rows come sorted by owner."""
    rows: list[tuple[int, int, int, bytes]] = []
    total = 0

    def solved(rows):
        pieces = [r[3] for r in rows]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(sizes + 1) - (sizes + 1)
        starts = repeated_starts(pieces, SPAN)
        cuts = np.searchsorted(starts, np.append(begins, int(begins[-1] + sizes[-1]) + 1))
        parts = []
        for i, (_, _, n, data) in enumerate(rows):
            found = [] if n > 1 else _ranges(starts[cuts[i] : cuts[i + 1]] - begins[i])
            parts.append([{"a": a, "b": b} for a, b in found])
        some = [i for i, p in enumerate(parts) if p]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.int64()), pa.array([parts[i] for i in some], _PARTS.field(2).type)], schema=_PARTS)

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("owner", "content", "n", "bytes")), strict=True):
            if total > SORTED_BYTES and row[0] != rows[-1][0]:
                yield solved(rows)
                rows, total = [], 0
            rows.append(row)
            total += len(row[3])
    if rows:
        yield solved(rows)


def _hashed(batches):
    """Every window of a stretch with a 128-bit hash."""
    import xxhash

    names = ["owner", "content", "n", "at", "h1", "h2"]
    for batch in batches:
        for owner, content, n, data in zip(*(batch[c].to_pylist() for c in ("owner", "content", "n", "bytes")), strict=True):
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i : i + SPAN]) for i in range(len(data) - SPAN + 1)), np.int64).reshape(-1, 2)
            k = len(digests)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, x)) for x in (owner, content, n)] + [pa.array(np.arange(k, dtype=np.int32)), pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1]))], names=names)


def repeated_ranges(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc, key, ranges): byte ranges [a, b) covered by repeated windows; key tells texts of one doc_id apart."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text")).where(F.length("text") >= SPAN)
    owners = map_arrow(texts.select("text"), _owners, "owner long, n long, least long, most long").groupBy("owner").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    owners = materialize(owners.where("n > 1").select("owner", (F.col("least") == F.col("most")).alias("alike")), "dedup-owners")
    bitmap = documents.sparkSession.sparkContext.broadcast(_bitmap(owners))
    likely = map_arrow(texts, _likely(bitmap), "doc long, key long, first int, count int, owner long, content long, bytes binary")
    found = materialize(likely.join(owners, "owner"), "dedup-found")

    whole = found.where("alike").select("doc", "key", F.col("first").alias("a"), (F.col("first") + F.col("count") + (SPAN - 1)).alias("b"))
    different = found.where("NOT alike").groupBy("owner", "content").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    different = materialize(different, "dedup-different")
    crowds = different.groupBy("owner").agg(F.count("*").alias("k")).where(F.col("k") > group).select("owner")
    usual = different.join(crowds, "owner", "left_anti").repartition("owner").sortWithinPartitions("owner", "content")
    parts = map_arrow(usual, _expand, "owner long, content long, parts array<struct<a:int,b:int>>").select("owner", "content", F.inline("parts"))
    each = map_arrow(different.join(crowds, "owner", "left_semi"), _hashed, "owner long, content long, n long, at int, h1 long, h2 long")
    again = each.groupBy("owner", "h1", "h2").agg(F.sum("n").alias("starts")).where("starts > 1").drop("starts")
    once = each.where("n = 1").join(again, ["owner", "h1", "h2"]).select("owner", "content", "at")
    island = F.col("at") - F.row_number().over(Window.partitionBy("owner", "content").orderBy("at"))
    runs = once.withColumn("island", island).groupBy("owner", "content", "island").agg(F.min("at").alias("a"), F.max("at").alias("b")).drop("island")
    # a stretch that occurs again repeats all its windows: one range
    copies = different.where("n > 1").select("owner", "content", F.lit(0).alias("a"), (F.length("bytes") - SPAN).alias("b"))
    parts = parts.unionByName(runs).unionByName(copies)
    partly = found.where("NOT alike").select("doc", "key", "first", "owner", "content").join(parts, ["owner", "content"])
    partly = partly.select("doc", "key", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b") + SPAN).alias("b"))
    return whole.unionByName(partly).groupBy("doc", "key").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def _cut(n_carried: int, with_text: bool):
    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch["__text"])
            removed, spans, digests, kept = [], [], [], []
            for i, (begin, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                text, ranges = data[begin:stop], batch["__ranges"][i].values
                runs = 0
                if ranges is not None and len(ranges):
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, ranges.field("a").to_numpy(), 1)
                    np.add.at(edge, ranges.field("b").to_numpy(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = text[~gone]
                bytes_kept = text.tobytes()
                removed.append(stop - begin - len(bytes_kept))
                spans.append(runs)
                digests.append(hashlib.sha256(bytes_kept).hexdigest())
                kept.append(bytes_kept.decode("utf-8", "ignore") if with_text else "")
            fields = [batch.schema.field(i) for i in range(n_carried)] + [pa.field("__n_bytes", pa.int64()), pa.field("__n_removed", pa.int64()), pa.field("__n_spans", pa.int64()), pa.field("__sha", pa.string())]
            columns = [batch.column(i) for i in range(n_carried)] + [pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            if with_text:
                fields.append(pa.field("__kept_text", pa.string()))
                columns.append(pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return run


def remove_repeats(documents: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of every row, and __n_bytes, __n_removed, __n_spans, __sha (of the bytes left), and, if asked, __kept_text."""
    ranges = repeated_ranges(documents).select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), F.col("ranges").alias("__ranges"))
    rows = documents.select(*keep, F.col("doc_id").cast("long").alias("__d"), F.xxhash64("text").alias("__k"), F.col("text").cast("binary").alias("__text"))
    joined = rows.join(ranges, rows["__d"].eqNullSafe(ranges["__doc"]) & rows["__k"].eqNullSafe(ranges["__key"]), "left")
    joined = joined.select(*[rows[c] for c in keep], "__text", "__ranges")
    fields = [f for f in joined.schema.fields if f.name not in ("__text", "__ranges")]
    extra = [T.StructField(n, t) for n, t in (("__n_bytes", T.LongType()), ("__n_removed", T.LongType()), ("__n_spans", T.LongType()), ("__sha", T.StringType()))] + [T.StructField("__kept_text", T.StringType())] * with_text
    return map_arrow(joined, _cut(len(keep), with_text), T.StructType(fields + extra))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.col("__sha").alias("kept_sha256"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, i, md5(t[i + 1:i + {SPAN}]) AS h FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - {SPAN - 1})) AS i FROM d WHERE octet_length(t) >= {SPAN})),
r AS (SELECT doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
s AS (SELECT doc_id, i, i > lag(i) OVER o + {SPAN} OR lag(i) OVER o IS NULL AS fresh FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {SPAN} AS b FROM g GROUP BY doc_id, k),
gaps AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM runs),
tails AS (SELECT doc_id, max(b) AS a, 9223372036854775807 AS b FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(t[x.a + 1:least(x.b, octet_length(t))]), '' ORDER BY x.a) AS h FROM d JOIN (SELECT * FROM gaps UNION ALL SELECT * FROM tails) x USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(t) ELSE sha256(unhex(coalesce(kept.h, ''))) END AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
