"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words in Spark.

The merges are one ``aggregate`` over a word's bytes.  Its state is an array with one 64-bit
number a symbol, the rank of the pair it begins above its id, so the least number is the
next merge and its first place is where; each step merges there and looks up the two
new neighbours only.  A pair's rank is found in a rank map, an array of slots in
which every pair of ids has one of two places (two halves of ``xxhash64``), so a look-up
reads two slots whatever the vocabulary's size.

Few words make up most of a corpus.  Texts are cut in whole Arrow batches (see ``pieces``),
words are counted over all documents with partial sums in every task, and the commonest ones,
``HEAD`` at most and ``HEAD_LONGEST`` bytes long at most (a bound on what is sent to the
workers), are folded once; workers find them by hash and compare their bytes.  Any other word
is folded once a slice of documents, about ``SLICE`` bytes of text, in the row that
holds the slice, so no word or document is ever gathered elsewhere.  Words longer than
``LONGEST`` bytes, whose fold would be quadratic, take the same merges from a heap.

Decoding concatenates the ids' binary pieces.

Defined results: null and empty texts have no ids, and the digests of no bytes; each row of
documents gives a row; other columns of documents, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table
from .pieces import cut, ragged, simple, texts_of
from .windows import mixed, powers

HEAD, HEAD_LONGEST = 1 << 18, 24
LONGEST = 256
SLICE = 1 << 20
_SLOTS = 1 << 18
_NONE = 1 << 30
_ID = (1 << 17) - 1
#: Stands before and after a word's symbols; no pair holds it.
_EDGE = 0xFFFF
#: Words a task adds up before it hands them on.
_COUNTED = 300_000


@dataclass
class Ranks:
    """A vocabulary: tokens by id, and the pattern that parts words."""

    tokens: list[bytes]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Ranks:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        return cls(tokens, pattern)

    def pairs(self) -> dict[tuple[int, int], int]:
        """Rank of every pair of ids whose bytes together are a token."""
        ids = {t: i for i, t in enumerate(self.tokens) if t}
        return {(ids[t[:k]], ids[t[k:]]): i for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}

    def byte_ids(self) -> list[int]:
        ids = {t: i for i, t in enumerate(self.tokens) if len(t) == 1}
        return [ids[bytes([b])] for b in range(256)]


def rank_slots(pairs: dict[tuple[int, int], int], slots: int = _SLOTS) -> list[int]:
    """The rank map: ``(left << 16 | right) << 17 | rank`` in one of the pair's two places; -1 is free."""
    import xxhash

    held, mask = [-1] * slots, slots - 1
    for (left, right), rank in pairs.items():
        entry, place = ((left << 16 | right) << 17) | rank, None
        for _ in range(2000):
            h = xxhash.xxh64_intdigest((entry >> 17).to_bytes(8, "little"), seed=42)
            first, second = h & mask, (h >> 32) & mask
            place = second if place == first else first
            if held[first] < 0 or held[second] < 0:
                held[first if held[first] < 0 else second] = entry
                break
            held[place], entry = entry, held[place]
        else:
            return rank_slots(pairs, slots * 2)
    return held


def let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(word: Column, numbers: Column, n_slots: int) -> Column:
    """Ids of a word given as an array of its byte values; ``numbers``: see ``Folder``."""
    mask, low_bits = F.lit(n_slots - 1).cast("bigint"), F.lit(_ID).cast("bigint")
    none = F.lit(_NONE << 17).cast("bigint")

    def symbol(left: Column, right: Column) -> Column:
        """The number of symbol ``left`` before ``right``: the pair's rank, then its id."""

        def found(key: Column) -> Column:
            def at(h: Column) -> Column:
                def pick(e: Column, other: Column) -> Column:
                    return F.when(F.shiftright(e, 17) == key, F.shiftleft(e.bitwiseAND(low_bits), 17)).otherwise(other)

                one = F.get(numbers, h.bitwiseAND(mask).cast("int"))
                two = F.get(numbers, F.shiftrightunsigned(h, 32).bitwiseAND(mask).cast("int"))
                return pick(one, pick(two, none))

            return let(F.xxhash64(key), at)

        return let(F.shiftleft(left, 16).bitwiseOR(right), found).bitwiseOR(left)

    def step(state: Column, _: Column) -> Column:
        def merged(low: Column) -> Column:
            def there(at: Column) -> Column:  # at counts from 1, and the edge stands at 1
                new = F.shiftright(low, 17)
                before = F.get(state, at - 2).bitwiseAND(low_bits)
                after = F.get(state, at + 1).bitwiseAND(low_bits)
                return F.concat(F.slice(state, F.lit(1), at - 2), F.array(symbol(before, new), symbol(new, after)), F.slice(state, at + 2, F.size(state)))

            return let(F.array_position(state, low).cast("int"), there)

        return let(F.array_min(state), lambda low: F.when(low >= none, state).otherwise(merged(low)))

    edge = F.array(F.lit((_NONE << 17) | _EDGE).cast("bigint"))
    start = F.concat(edge, F.transform(word, lambda b, i: F.get(numbers, F.coalesce(F.get(word, i + 1) + (b + 1) * 256, b) + n_slots)), edge)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1))), start, step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(low_bits).cast("int")))


class Folder:
    """The fold with its numbers, for use in one expression: the rank map's slots, then the symbols that each byte is as a
    word's last one, then those that each byte is before each other byte.

    They come as a scalar subquery: a literal's 4 MB would stand in every description of a plan, and the driver keeps those.
    """

    def __init__(self, ranks: Ranks, spark: SparkSession):
        pairs, byte_ids = ranks.pairs(), ranks.byte_ids()
        slots = rank_slots(pairs)
        self.n = len(slots)
        last = [(_NONE << 17) | x for x in byte_ids]
        before = [(pairs.get((x, y), _NONE) << 17) | x for x in byte_ids for y in byte_ids]
        numbers = pa.array(np.array(slots + last + before, np.int64))
        one = pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), numbers)
        self.numbers = spark.createDataFrame(pa.table({"numbers": one}))

    def with_ids(self, rows: DataFrame, words: Column, name: str) -> DataFrame:
        """``rows`` with the ids of each of an array of byte arrays.

        A subquery may not be written inside a higher-order function, so it is a column first; that is read once, so the
        optimizer puts the subquery in its place, and no row carries it.
        """
        ids = let(F.col("__numbers"), lambda t: F.transform(words, lambda w: fold(w, t, self.n)))
        return rows.withColumn("__numbers", self.numbers.scalar()).withColumn(name, ids).drop("__numbers")


def merge_long(word: bytes, pairs: dict[tuple[int, int], int], byte_ids: list[int]) -> list[int]:
    """The same merges, leftmost lowest rank first, from a heap."""
    ids: list[int | None] = [byte_ids[b] for b in word]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= len(ids) or ids[j] != right:
            continue
        ids[i], ids[j] = rank, None
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(ids) and (p := (ids[a], ids[b])) in pairs:
                heapq.heappush(heap, (pairs[p], a, *p))
    return [x for x in ids if x is not None]


_rng = np.random.default_rng(4099)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the words that lie end to end."""
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    return mixed((sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


class _Words:
    """A slice's distinct words, end to end: the simple pieces of the texts, and the words of all others."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, find):
        starts = cut(data, offsets)
        bounds = np.append(starts, len(data))
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        held, places = texts_of(coded.dictionary)
        plain = simple(held, places)
        number, lists = {}, []
        odd = np.flatnonzero(~plain)
        raw = held.tobytes()
        for i in odd.tolist():
            words = [w.encode() for w in find(raw[places[i] : places[i + 1]].decode("utf-8", "replace"))]
            lists.append([number.setdefault(w, len(plain) + len(number)) for w in words])
        sizes = np.fromiter(map(len, number), np.int64, len(number))
        self.data = np.concatenate([held, np.frombuffer(b"".join(number), np.uint8)])
        self.bounds = np.concatenate([places, places[-1] + np.cumsum(sizes)])
        # words of each piece, then of each text
        per, first = np.ones(len(plain), np.int64), np.arange(len(plain))
        per[odd] = np.fromiter(map(len, lists), np.int64, len(lists))
        first[odd] = len(plain) + np.cumsum(per[odd]) - per[odd]
        values = np.concatenate([np.arange(len(plain)), np.fromiter((x for words in lists for x in words), np.int64)])
        index = np.asarray(coded.indices)
        self.at = ragged(values, first[index], per[index])
        ends = np.concatenate([[0], np.cumsum(per[index])])
        self.per_text = np.diff(ends[np.searchsorted(starts, offsets)])

    def __len__(self) -> int:
        return len(self.bounds) - 1


def _slices(column: pa.Array, pattern):
    """(first text, text after the last, _Words) of slices of a batch."""
    data, offsets = texts_of(column)
    begin, n = 0, len(offsets) - 1
    while begin < n:
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE, "right")) - 1)
        yield begin, stop, _Words(data[offsets[begin] : offsets[stop]], offsets[begin : stop + 1] - offsets[begin], pattern)
        begin = stop


def _finder(pattern: str):
    import regex

    return regex.compile(pattern).findall


def _count(pattern: str):
    def run(batches):
        find, parts, held = _finder(pattern), [], 0

        def added() -> pa.Table:
            return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for _, _, words in _slices(batch["text"], find):
                n = np.bincount(words.at, minlength=len(words))
                short = np.flatnonzero((n > 0) & (np.diff(words.bounds) <= HEAD_LONGEST))
                sizes = np.diff(words.bounds)[short]
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                array = pa.BinaryArray.from_buffers(pa.binary(), len(short), [None, pa.py_buffer(bounds), pa.py_buffer(ragged(words.data, words.bounds[:-1][short], sizes))])
                parts.append(pa.table({"word": array, "n": pa.array(n[short])}))
                held += len(short)
                if held > 2 * _COUNTED:
                    parts = [added()]
                    held = len(parts[0])
                    if held > _COUNTED:
                        yield from parts[0].to_batches(1 << 16)
                        parts, held = [], 0
        if parts:
            yield from added().to_batches(1 << 16)

    return run


def word_counts(documents: DataFrame, pattern: str) -> DataFrame:
    """(word, n) over all documents, of the words that may be sent to the workers."""
    return map_arrow(documents.select(F.col("text").cast("binary").alias("text")), _count(pattern), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, most: int = HEAD) -> DataFrame:
    """The commonest words, ``most`` at most: all that reach the least count that keeps to the bound."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    levels = counts.where("n > 1").groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()  # some hundred rows
    total, least = 0, None
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["words"]
        if total > most:
            break
        least = r["level"]
    return counts.where(F.lit(False)) if least is None else counts.where((F.col("n") > 1) & (level >= least))


class Head:
    """Words and their ids, found by hash; words whose hash another one has are left out."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        data, bounds = texts_of(words)
        flat, places = ids.flatten().to_numpy().astype(np.uint16), ids.offsets.to_numpy().astype(np.int64)
        places -= places[0]
        hashes = word_hashes(data, bounds)
        order = np.argsort(hashes, kind="stable")
        order = order[np.diff(hashes[order], prepend=hashes[order[:1]] + np.uint64(1)) != 0] if len(order) else order
        self.hashes = hashes[order]
        self.sizes, self.n_ids = np.diff(bounds)[order].astype(np.int32), np.diff(places)[order].astype(np.int32)
        self.data, self.ids = ragged(data, bounds[:-1][order], self.sizes.astype(np.int64)), ragged(flat, places[:-1][order], self.n_ids.astype(np.int64))
        self.starts, self.id_starts = (np.cumsum(x, dtype=np.int64) - x for x in (self.sizes, self.n_ids))

    def find(self, words: _Words) -> np.ndarray:
        """Each word's number here, or -1."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.hashes) or not len(words):
            return out
        hashes, sizes = word_hashes(words.data, words.bounds), np.diff(words.bounds)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == sizes) & (sizes > 0))
        if len(same):
            at, sizes = at[same], sizes[same]
            equal = ragged(self.data, self.starts[at], sizes) == ragged(words.data, words.bounds[:-1][same], sizes)
            equal = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
            out[same[equal]] = at[equal]
        return out


def _look_up(ranks: Ranks, head: Head, fields: list[pa.Field]):
    """A row for each slice: its documents' columns, ids of its words (below 0: the own word -1 - i) and its own words."""
    names = [f.name for f in fields] + ["n_ids", "seq", "own"]

    def run(batches):
        find, pairs, byte_ids = _finder(ranks.pattern), None, ranks.byte_ids()
        for batch in batches:
            for begin, stop, words in _slices(batch["text"], find):
                at = head.find(words)
                size, start = np.ones(len(words), np.int64), np.zeros(len(words), np.int64)
                known = at >= 0
                size[known], start[known] = head.n_ids[at[known]], head.id_starts[at[known]]
                extra, own, base = [], [], len(head.ids)
                raw = words.data.tobytes()
                for i in np.flatnonzero(~known).tolist():
                    word = raw[words.bounds[i] : words.bounds[i + 1]]
                    if len(word) <= LONGEST:
                        ids = [-1 - len(own)]
                        own.append(word)
                    else:
                        pairs = pairs or ranks.pairs()
                        ids = merge_long(word, pairs, byte_ids)
                    size[i], start[i] = len(ids), base + len(extra)
                    extra += ids
                sizes = size[words.at]
                starts = start[words.at]
                mine = starts >= base
                seq = np.empty(int(sizes.sum()), np.int32)
                place = np.repeat(mine, sizes)
                seq[~place] = ragged(head.ids, starts[~mine], sizes[~mine])
                seq[place] = ragged(np.array(extra, np.int32), starts[mine] - base, sizes[mine])
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(words.per_text)])]
                inner = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(inner), pa.array(np.frombuffer(b"".join(own), np.uint8).astype(np.int32)))
                one = pa.array([0, stop - begin], pa.int32())
                kept = [pa.ListArray.from_arrays(one, batch[f.name].slice(begin, stop - begin)) for f in fields]
                kept += [pa.ListArray.from_arrays(one, pa.array(np.diff(ends))), pa.array([seq.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), values)]
                yield pa.RecordBatch.from_arrays(kept, names=names)

    return run


def encode(documents: DataFrame, ranks: Ranks, most: int = HEAD) -> DataFrame:
    """Rows of slices: doc_id and n_ids (arrays, one entry a document), seq (32-bit numbers: ids, or -1 - i for
    the i-th own word) and own (ids of the slice's own words)."""
    folder = Folder(ranks, documents.sparkSession)
    common = common_words(materialize(word_counts(documents, ranks.pattern), "bpe-words"), most)
    values = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.conv(F.hex(F.substring("word", i, F.lit(1))), 16, 10).cast("int"))
    found = folder.with_ids(common, F.array(values), "ids").select("word", F.get("ids", F.lit(0)).alias("ids")).toArrow().combine_chunks()
    words, ids = (found[c].chunk(0) if found[c].num_chunks else found[c].combine_chunks() for c in ("word", "ids"))
    head = documents.sparkSession.sparkContext.broadcast(Head(words.cast(pa.binary()), ids))
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = [pa.field("doc_id", pa.null())]
    slices = map_arrow(rows, lambda batches: _look_up(ranks, head.value, fields)(batches), f"doc_id array<{kind}>, n_ids array<bigint>, seq binary, own array<array<int>>")
    return folder.with_ids(slices, F.col("own"), "own")


def _finish(ranks: Ranks):
    def run(batches):
        flat = np.frombuffer(b"".join(ranks.tokens), np.uint8)
        sizes = np.fromiter(map(len, ranks.tokens), np.int64, len(ranks.tokens))
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            for r in range(len(batch)):
                seq = np.frombuffer(batch["seq"][r].as_buffer(), np.int32)
                own = batch["own"][r].values
                ends = np.concatenate([[0], np.cumsum(batch["n_ids"][r].values.to_numpy())])
                if len(own):
                    places, ids = own.offsets.to_numpy().astype(np.int64), own.flatten().to_numpy()
                    places -= places[0]
                    size, start = np.ones(len(seq), np.int64), np.arange(len(seq)) + len(ids)
                    mine = np.flatnonzero(seq < 0)
                    which = -1 - seq[mine]
                    size[mine], start[mine] = np.diff(places)[which], places[which]
                    ends = np.concatenate([[0], np.cumsum(size)])[ends]
                    seq = ragged(np.concatenate([ids, seq]), start, size)
                coded = seq.astype("<u4").tobytes()
                text = ragged(flat, starts[seq], sizes[seq]).tobytes()
                cuts = np.concatenate([[0], np.cumsum(sizes[seq])])[ends].tolist()
                at = ends.tolist()
                ids_sha = [hashlib.sha256(coded[4 * a : 4 * b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                text_sha = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
                doc_ids = batch["doc_id"][r].values
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(ends)), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_and_decode(documents: DataFrame, ranks: Ranks, most: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of documents."""
    schema = documents.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return map_arrow(encode(documents, ranks, most), _finish(ranks), schema)


def public_ranks() -> Ranks:
    import public_tokenizers

    return Ranks.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), public_ranks())
