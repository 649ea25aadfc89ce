"""Token-id shards compressed with Re-Pair grammars.

Documents are range-partitioned by doc_id and sorted, so shards follow the ids' order.
Each task encodes its documents (tokenizers library, every distinct chunk once while it
stays in a bounded store), appends the end id and cuts the stream into blocks of at most
``BLOCK_IDS`` ids (a longer document is a block of its own).  A block is compressed by
itself, with rules of its own: every round replaces the most frequent pairs of neighbours that
don't overlap by new nonterminals, until no pair occurs ``LEAST`` times.

A text is encoded as the library does by default: the literal of an added token, such as
``<|endoftext|>``, gives that token's id.

A block's file record holds: the rules (two 32-bit symbols a nonterminal), the expansion
length of every nonterminal, the compressed sequence, and, per document, its id and token
count.  Expansion lengths give the place of any id without decoding what comes before it,
so ``decode_range`` reads single documents.  Records are written through Spark's Parquet
writer into the shared folder, so a lost executor's half-written part never shows, and
any store that Spark can write works.

Defined results: null and empty texts give the end id alone; ties of doc_id are ordered by
text; repeated rows give a row each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, new_path, table
from .pieces import PieceStore, ragged, simple, texts_of

END_ID = 2
BLOCK_IDS = 1 << 20
#: Text of a shard, at most about.
SHARD_BYTES = 256 << 20
#: Pairs a round may replace; the others wait for the next one.
PAIRS = 8192
#: A pair must occur so often in a block to be replaced.
LEAST = 16
_HASH_BITS = 18

BLOCK_SCHEMA = "shard int, base long, n_ids long, first_new int, rules binary, lengths binary, sequence binary, doc_ids array<long>, doc_tokens array<long>"


def _frequent(seq: np.ndarray, least: int, most: int, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent pairs of neighbours (64-bit keys, most frequent first), and their places with each place's rank; only
    pairs that begin at ``where`` count, if it is given.

    Pairs are counted in hashed slots; a slot stands for one pair that fell into it, and
    that pair is then counted exactly.  Where no slot's pair is frequent, a frequent one may
    have lost its slot, so the places in full slots are sorted: none is left only if none is found.
    """
    left, right = (seq[:-1], seq[1:]) if where is None else (seq[where], seq[where + 1])
    slot = ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - _HASH_BITS)).view(np.int32)

    def keys(at: np.ndarray) -> np.ndarray:
        return (left[at].astype(np.uint64) << np.uint64(32)) | right[at]

    counts = np.bincount(slot, minlength=1 << _HASH_BITS)
    top = np.flatnonzero(counts >= least)
    if len(top) > most:
        top = top[np.argpartition(-counts[top], most)[:most]]
    if not len(top):
        return np.zeros(0, np.uint64), top, top
    slot_of = np.full(1 << _HASH_BITS, -1, np.int32)
    slot_of[top] = np.arange(len(top), dtype=np.int32)
    at = slot_of[slot]
    places = np.flatnonzero(at >= 0)
    at, here = at[places], keys(places)
    pair = np.zeros(len(top), np.uint64)
    pair[at] = here
    same = pair[at] == here
    places, at = places[same], at[same]
    exact = np.bincount(at, minlength=len(top))
    if exact.max() < least:
        places = np.flatnonzero(counts[slot] >= least)
        pair, at, exact = np.unique(keys(places), return_inverse=True, return_counts=True)
    order = np.argsort(-exact, kind="stable")
    order = order[exact[order] >= least]
    order = order[:most]
    rank = np.full(len(pair), -1, np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    rank = rank[at]
    places, rank = places[rank >= 0], rank[rank >= 0]
    return pair[order], places if where is None else where[places], rank


def compress(ids: np.ndarray, pairs: int = PAIRS, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first nonterminal, rules as pairs of symbols, expansion lengths, sequence).

    After a round only pairs that hold one of its new symbols can have become frequent, so the next one looks beside those
    places; where they give nothing the whole sequence is looked through, and if that gives nothing it is done.

    Of overlapping places the more frequent pair wins; in a run of one symbol every other place does.
    """
    seq = np.ascontiguousarray(ids, np.uint32)
    first = int(seq.max()) + 1 if len(seq) else 1
    rules, length_of, where = [], np.ones(first, np.int64), None
    while len(seq) >= 2:
        found, places, rank = _frequent(seq, least, pairs, where)
        if not len(places):
            if where is None:
                break
            where = None
            continue
        near = np.diff(places) == 1  # the next place is the next symbol
        before, after = np.full(len(places), len(found), np.int32), np.full(len(places), len(found), np.int32)  # ranks of the pairs beside
        before[1:], after[:-1] = np.where(near, rank[:-1], before[1:]), np.where(near, rank[1:], after[:-1])
        keep = (rank < before) & (rank <= after) | (rank == before) & (rank <= after)
        places, rank = places[keep], rank[keep]
        touching = np.diff(places, prepend=-2) == 1
        if touching.any():
            number = np.arange(len(places))
            run_start = np.maximum.accumulate(np.where(touching, 0, number))
            odd = (number - run_start) % 2 == 1
            places, rank = places[~odd], rank[~odd]
        used = np.flatnonzero(np.bincount(rank, minlength=len(found)))
        new_id = np.zeros(len(found), np.uint32)
        new_id[used] = len(length_of) + np.arange(len(used), dtype=np.uint32)
        left, right = (found[used] >> np.uint64(32)).astype(np.uint32), (found[used] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rules.append(np.stack([left, right], 1))
        length_of = np.concatenate([length_of, length_of[left] + length_of[right]])
        stay = np.ones(len(seq), bool)
        stay[places + 1] = False
        seq = seq[stay]
        moved = places - np.arange(len(places))  # places in order: each moves up by those before it
        seq[moved] = new_id[rank]
        where = np.stack([moved - 1, moved], 1).ravel()
        where = where[np.diff(where, prepend=-2) > 0]
        where = where[(where >= 0) & (where < len(seq) - 1)]
    return first, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), length_of[first:].astype(np.uint32), seq


def expand(first: int, rules: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """Undo ``compress``: the nonterminals' whole expansions first, then one gather for the sequence."""
    if not len(rules):
        return sequence
    pairs = rules.tolist()
    full: list[tuple] = []
    for left, right in pairs:
        full.append((full[left - first] if left >= first else (left,)) + (full[right - first] if right >= first else (right,)))
    lengths = np.fromiter(map(len, full), np.int64, len(full))
    flat = np.fromiter((x for e in full for x in e), np.uint32, int(lengths.sum()))
    big = sequence >= first
    size = np.ones(len(sequence), np.int64)
    size[big] = lengths[sequence[big] - first]
    values = np.concatenate([flat, sequence[~big]])
    starts = np.empty(len(sequence), np.int64)
    starts[big] = (np.cumsum(lengths) - lengths)[sequence[big] - first]
    starts[~big] = len(flat) + np.arange(int((~big).sum()))
    return ragged(values, starts, size)


def expand_symbols(first: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The expansion of a few symbols, by their own rules alone: each pass opens every nonterminal once."""
    while (big := symbols >= first).any():
        size = np.where(big, 2, 1)
        opened = np.repeat(symbols, size)
        at = (np.cumsum(size) - size)[big]
        pairs = rules[symbols[big] - first]
        opened[at], opened[at + 1] = pairs[:, 0], pairs[:, 1]
        symbols = opened
    return symbols


def decode_range(first: int, rules: np.ndarray, lengths: np.ndarray, sequence: np.ndarray, start: int, stop: int) -> np.ndarray:
    """ids[start:stop] of the block, expanding only the symbols that cover them."""
    size = np.ones(len(sequence), np.int64)
    big = sequence >= first
    size[big] = lengths[sequence[big] - first]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    skip = start - (ends[a - 1] if a else 0)
    return expand_symbols(first, rules, sequence[a : b + 1])[skip : skip + stop - start]


#: Ids that one call of the library may encode together, parted by the end-of-text token.
_PARTING = "<|endoftext|>"


#: A worker's store and its library for special literals, kept for the next tasks of the same tokenizer.
_STORES: dict[int, tuple[PieceStore, _Special]] = {}


def _store(tokenizer: str) -> tuple[PieceStore, _Special]:
    key = hash(tokenizer)
    if key not in _STORES:
        _STORES.clear()
        _STORES[key] = PieceStore(library_encoder(tokenizer)), _Special(tokenizer)
    return _STORES[key]


def library_encoder(tokenizer: str):
    """encode(list of distinct pieces) by the tokenizers library (see ``PieceStore``); ``tokenizer`` is its JSON text.

    Short pieces go in one call, parted by the special token, which the library always
    takes for itself; those that are one match of the pattern for sure aren't searched for matches again.
    Pieces that could hold the token's text go one by one with special tokens off.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    plain, parted = Tokenizer.from_str(tokenizer), Tokenizer.from_str(tokenizer)
    plain.encode_special_tokens = True
    parting, between = parted.token_to_id(_PARTING), _PARTING.encode()
    uncut, spec = parted, json.loads(tokenizer)
    step = spec.get("pre_tokenizer") or {}
    if step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space"):
        step["use_regex"] = False
        uncut = Tokenizer.from_str(json.dumps(spec))

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        one = simple(np.frombuffer(b"".join(pieces), np.uint8), places)
        short = np.array([len(p) <= 64 and b"<|" not in p for p in pieces], bool) & (parting is not None)
        kind = np.where(short, np.where(one, 0, 1), 2)
        order, flat, per = np.argsort(kind, kind="stable"), [], []
        m, n = np.searchsorted(kind[order], [1, 2]).tolist()
        for library, k, stop in [(uncut, k, min(k + 4096, m)) for k in range(0, m, 4096)] + [(parted, k, min(k + 4096, n)) for k in range(m, n, 4096)]:
            some = [pieces[i] for i in order[k:stop].tolist()]
            text = between.join(some).decode("utf-8", "replace")
            ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            parts = ids == parting
            per.append(np.diff(np.append(np.flatnonzero(parts), len(ids)), prepend=-1) - 1)
            if len(per[-1]) != len(some):
                raise ValueError("pieces were not parted")
            flat.append(ids[~parts])
        for k in range(n, len(order), 64):
            some = [pieces[i].decode("utf-8", "replace") for i in order[k : k + 64].tolist()]
            found = [np.array(e.ids, np.uint32) for e in plain.encode_batch_fast(some, add_special_tokens=False)]
            per.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat += found
        lengths, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        if per:
            lengths[order] = np.concatenate(per)
            starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(flat or [np.zeros(0, np.uint32)]), starts, lengths

    return encode


class _Special:
    """Whole-text calls for texts that hold the literal of an added token, which the piece store must not cut."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.literals = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]

    def ids(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)


def _encoded(column: pa.Array, store: PieceStore, special: _Special) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids per text)."""
    data, offsets = texts_of(column)
    raw = data.tobytes()
    held: set[int] = set()
    for literal in special.literals:
        at = raw.find(literal)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(literal) <= offsets[k + 1]:
                held.add(k)
            at = raw.find(literal, at + 1)
    if not held:
        return store.of(column)
    parts, sizes, begin = [], [], 0
    for k in [*sorted(held), len(column)]:
        if k > begin:
            ids, per = store.of(column.slice(begin, k - begin))
            parts.append(ids)
            sizes.append(per)
        if k < len(column):
            ids = special.ids(raw[offsets[k] : offsets[k + 1]])
            parts.append(ids)
            sizes.append(np.array([len(ids)]))
        begin = k + 1
    return np.concatenate(parts), np.concatenate(sizes)


def _writer(tokenizer: str, end_id: int, block_ids: int):
    def encode(batches):
        from pyspark import TaskContext

        store, special = _store(tokenizer)
        shard, base = TaskContext.get().partitionId(), 0
        held, docs, counts, total = [], [], [], 0

        def block():
            nonlocal held, docs, counts, total, base
            first, rules, lengths, sequence = compress(np.concatenate(held))
            row = {"shard": [shard], "base": [base], "n_ids": [total], "first_new": [first], "rules": [rules.tobytes()], "lengths": [lengths.tobytes()], "sequence": [sequence.tobytes()], "doc_ids": [docs], "doc_tokens": [counts]}
            base += total
            held, docs, counts, total = [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=_ARROW)

        for batch in batches:
            ids, sizes = _encoded(batch["text"], store, special)
            ends = np.cumsum(sizes)
            sizes = sizes + 1
            with_end = np.insert(ids, ends, end_id).astype(np.uint32)
            doc_ids, done, ends = batch["doc_id"].to_pylist(), 0, np.cumsum(sizes)
            while done < len(doc_ids):
                begin = int(ends[done - 1]) if done else 0
                upto = max(int(np.searchsorted(ends, begin + block_ids - total, "right")), done if total else done + 1)
                if upto > done:
                    held.append(with_end[begin : int(ends[upto - 1])])
                    docs += doc_ids[done:upto]
                    counts += sizes[done:upto].tolist()
                    total += int(ends[upto - 1]) - begin
                    done = upto
                if done < len(doc_ids):
                    yield block()
        if held:
            yield block()

    return encode


_ARROW = pa.schema(
    [("shard", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()), ("first_new", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))]
)


def write_shards(documents: DataFrame, tokenizer_path: str, path: str, shards: int | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode and write the shards under ``path``, in ascending order of doc_id.

    The driver reads the tokenizer's file, so executors need not hold it.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = file.read()
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    if shards is None:  # as many as the session deals data over, more where they would hold too much
        size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        shards = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, _writer(tokenizer, end_id, block_ids), BLOCK_SCHEMA).write.mode("overwrite").parquet(path)


def _reader(batches):
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            rules = np.frombuffer(r["rules"], np.uint32).reshape(-1, 2)
            ids = expand(r["first_new"], rules, np.frombuffer(r["sequence"], np.uint32))
            ends = np.cumsum(r["doc_tokens"])
            starts = ends - r["doc_tokens"]
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([r["shard"]] * len(crcs), r["doc_ids"], (starts + r["base"]).tolist(), r["doc_tokens"], crcs), schema, strict=True)], schema=schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards under ``path``.

    Only one number a shard (its count of ids) meets in one place, and shards are the
    writer's partitions, whose number is set by the job and not by the rows.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before, rows = 0, []
    for shard, n in totals:
        rows.append((shard, before))
        before += n
    docs = map_arrow(blocks, _reader, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    offsets = spark.createDataFrame(rows, "shard int, before long")
    return docs.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_documents(spark, path)
