"""Near-duplicates by Jaccard similarity of word shingles: an exact prefix-filter join.

Shingles are hashed to 64 bits; texts with equal sets form one class, and only classes are
joined.  A global order puts rare shingles first: frequencies are summed over all texts in
``1 << FREQUENCY_BITS`` hashed buckets, a table of fixed size.  Two sets that are similar
enough share one of their first few shingles (the prefix), so classes meet in groups of a
shared prefix shingle:

* shingles in one prefix only are dropped first, by a count and a join;
* a group's classes are paired in a join whose condition holds the length and positional
  filters; a pair of several groups is made distinct;
* the suffix filter bounds what a pair's sets may share beyond that, from counts by part of the hash space
  that were taken when the texts were read: most pairs of unlike texts end here;
* pairs are verified in units, one for each: a unit is a group's pairs, cut by the bytes of
  their sets.  A class's text goes once to each unit that has a pair of it, and the unit makes its
  set and compares it exactly; a pair that is linked already through others needs no more.

In a group of more than ``small`` classes every class first meets ``HUBS`` others only, and links join
components; what is paired after that are classes of different components, in blocks, where
marks of the sets (a suffix filter too) are compared in the join.  So a large group of near copies costs a few pairs a class,
and never all its pairs, and yet no link between components is lost.

Links become components (see ``components``) of documents; a class stands for its rows as its
smallest doc_id.

Defined results: null and wordless texts have no shingles and are linked with nothing; with
fewer words than a shingle the whole sequence is the only one; rows that repeat a doc_id
each give a row, judged by their own text, and a doc_id that is the smallest of two classes joins them; a class
none of whose rows has a doc_id forms no links, and its rows have no component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table
from .components import components
from .pieces import texts_of
from .windows import mixed, powers

FREQUENCY_BITS = 18
#: Classes of a group that are paired at once; in larger groups each meets some hubs first.
SMALL, HUBS = 32, 16
#: A large group of c classes is cut into sqrt(c) / BLOCK blocks, more where sets hold many bytes; a unit holds UNIT_BYTES, about.
BLOCK, UNIT_BYTES = 4, 4 << 20
#: Bits that mark a set's shingles in joins of large groups.
MARKS = 1024
#: Bits of the bitmap of documents whose texts take part in pairs.
BITS = 1 << 22
#: Copies of the labels that a large class's rows are dealt over.
SALTS = 16

_rng = np.random.default_rng(77)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_PLACE = _rng.integers(0, 1 << 64, 64, np.uint64, endpoint=False) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash), distinct and sorted, of texts that lie end to end."""
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    size = len(data)
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    letter = ~_SPACE[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:size]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | edge[1:size]
    stop = np.flatnonzero(ends) + 1
    up, down = powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:size], dtype=np.uint64)])
    word = mixed((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64))
    text = np.searchsorted(offsets, first, "right") - 1
    at = np.flatnonzero(np.diff(text, prepend=-1))
    counts = np.diff(np.append(at, len(text)))
    # shingles of n words that lie in one text; shorter texts are one shingle
    last = len(word) - n + 1
    hashes, owners = [], []
    if last > 0:
        inside = text[:last] == text[n - 1 :]
        value = np.zeros(last, np.uint64)
        for k in range(n):
            value += word[k : k + last] * _PLACE[k]
        hashes.append(mixed(value[inside]))
        owners.append(text[:last][inside])
    for i in np.flatnonzero(counts < n):
        some = word[at[i] : at[i] + counts[i]]
        hashes.append(mixed((some * _PLACE[: len(some)]).sum(dtype=np.uint64, keepdims=True) + _PLACE[-1:] * np.uint64(len(some))))
        owners.append(text[at[i] : at[i] + 1])
    h, t = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return t[keep], h[keep]


def _sets(column: pa.Array, n: int, most: int = 1 << 19):
    """(first text's number, text, hash) of slices of a batch."""
    data, offsets = texts_of(column)
    begin, total = 0, len(offsets) - 1
    while begin < total:
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        t, h = shingle_sets(data[offsets[begin] : offsets[stop]], offsets[begin : stop + 1] - offsets[begin], n)
        yield begin, stop, t, h
        begin = stop


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def _signatures(t: np.ndarray, h: np.ndarray, seed: int):
    """(text, set size, two sums of mixed hashes that name the set) of the texts that have shingles."""
    at = np.flatnonzero(np.diff(t, prepend=-1))
    counts = np.diff(np.append(at, len(t)))
    if not len(at):
        return t[:0], counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = np.add.reduceat(mixed(h * _PLACE[40 + seed]), at), np.add.reduceat(mixed(h ^ _PLACE[63 - seed]), at)
    return t[at], counts, mixed(one).view(np.int64), mixed(two).view(np.int64)


_READ = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("proof", pa.int64()), ("sketch", pa.binary()), ("bits", pa.list_(pa.int64())), ("bucket", pa.int32())])


def _sketch(h: np.ndarray) -> bytes | None:
    """Counts of a set's hashes by part of the hash space, about 16 in each; None where a count doesn't fit a byte."""
    parts = max(4, (len(h) // 16).bit_length() - 1)
    counts = np.bincount((h >> np.uint64(64 - parts)).astype(np.int64), minlength=1 << parts)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _bits(h: np.ndarray) -> np.ndarray | None:
    """MARKS bits, one set for each hash; None for sets that would fill them."""
    if len(h) > MARKS // 2:
        return None
    held = np.zeros(MARKS, np.uint8)
    held[(h & np.uint64(MARKS - 1)).astype(np.int64)] = 1
    return np.packbits(held).view(np.int64)


def _read(n: int, seed: int):
    """A row for each text, with its set's size and names; then the task's shingles by bucket."""

    def run(batches):
        frequency = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for batch in batches:
            size, one, two = (np.zeros(len(batch), np.int64) for _ in range(3))
            sketch, bits = [None] * len(batch), [None] * len(batch)
            for begin, _, t, h in _sets(batch["text"], n):
                frequency += np.bincount(_bucket(h), minlength=len(frequency))
                text, counts, a, b = _signatures(t, h, seed)
                size[begin + text], one[begin + text], two[begin + text] = counts, a, b
                ends = np.cumsum(counts).tolist()
                for k, start, stop in zip((begin + text).tolist(), [0, *ends], ends, strict=False):
                    sketch[k], bits[k] = _sketch(h[start:stop]), _bits(h[start:stop])
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(size), pa.array(one), pa.array(two), pa.array(sketch, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.nulls(len(batch), pa.int32())], schema=_READ)
        at = np.flatnonzero(frequency)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(frequency[at]), none, none, pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.list_(pa.int64())), pa.array(at.astype(np.int32))], schema=_READ)

    return run


def frequencies(read: DataFrame) -> np.ndarray:
    """Shingles of all texts by bucket; the table's size is fixed."""
    rows = read.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << FREQUENCY_BITS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def prefix_length(n, percent: int):
    """Shingles of a set of n (a number or an array) of which a similar set must share one."""
    return n - (-(-n * percent // 100)) + 1


def _ordered(t: np.ndarray, h: np.ndarray, frequency: np.ndarray):
    """Hashes in the rare-first order of each text, and each one's place there."""
    order = np.lexsort((h, frequency[_bucket(h)], t))
    at = np.flatnonzero(np.diff(t, prepend=-1))
    counts = np.diff(np.append(at, len(t)))
    return h[order], np.arange(len(t)) - np.repeat(at, counts), at, counts


def _prefixes(n: int, percent: int, seed: int, frequency):
    """(token, class, set size << 32 | place) of the prefix of each set; copies in a batch count once."""

    def run(batches):
        table_of = frequency.value
        for batch in batches:
            seen: set[int] = set()
            for _, _, t, h in _sets(batch["text"], n):
                if not len(t):
                    continue
                _, counts, name, _ = _signatures(t, h, seed)
                ordered, place, _, _ = _ordered(t, h, table_of)
                new = np.ones(len(name), bool)
                for i, key in enumerate(name.tolist()):
                    new[i] = key not in seen
                    seen.add(key)
                keep = (place < np.repeat(prefix_length(counts, percent), counts)) & np.repeat(new, counts)
                columns = [ordered[keep].view(np.int64), np.repeat(name, counts)[keep], (np.repeat(counts, counts)[keep] << 32) | place[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "cls", "np"])

    return run


def _bitmap(docs: DataFrame) -> Column:
    """The test whether a row's doc may be among those of ``docs``: a literal array of BITS bits, one set for each.

    BITS / 64 rows reach the driver at most.
    """
    slot = F.xxhash64("doc").bitwiseAND(F.lit(BITS - 1).cast("bigint"))
    rows = docs.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("bits")).toArrow()
    longs = np.zeros(BITS // 64, np.int64)
    longs[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    bits = F.split(F.lit(",".join(map(str, longs.tolist()))), ",").cast("array<bigint>")
    return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1


def _near(x: str, y: str, percent: int) -> Column:
    """The length and positional filters for rows of one prefix shingle."""
    n, m = (F.shiftright(f"{s}.np", 32) for s in (x, y))
    i, j = (F.col(f"{s}.np").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) for s in (x, y))
    shared = F.least(n - i, m - j)  # the first common shingle and all that follows
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * shared >= percent * (n + m - shared))


def _alike(x: str, y: str, percent: int) -> Column:
    """The suffix filter in a join: a mark of one set that the other lacks is a shingle they don't share."""
    n, m = (F.shiftright(f"{s}.np", 32) for s in (x, y))

    def lacks(a: str, b: str) -> Column:
        return sum((F.bit_count(F.get(f"{a}.bits", F.lit(k)).bitwiseAND(F.bitwise_not(F.get(f"{b}.bits", F.lit(k))))) for k in range(MARKS // 64)), F.lit(0))

    most = F.least(n - lacks(x, y), m - lacks(y, x))
    return F.coalesce(100 * most >= percent * (n + m - most), F.lit(True))


def _likely(percent: int):
    """The suffix filter on pairs of any size: what two sets hold of each part of the hash space bounds what they share."""
    names = ["unit", "a_cls", "a_doc", "b_cls", "b_doc"]

    def parts(sketch: bytes, size: int) -> np.ndarray:
        counts = np.frombuffer(sketch, np.uint8).astype(np.int64)
        return counts.reshape(size, -1).sum(1)

    def likely(x, y) -> bool:
        if x is None or y is None:
            return True
        size = min(len(x), len(y))
        a, b = parts(x, size), parts(y, size)
        most = int(np.minimum(a, b).sum())
        return 100 * most >= percent * (int(a.sum()) + int(b.sum()) - most)

    def run(batches):
        for batch in batches:
            keep = [likely(x, y) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return run


def _pairs(met: DataFrame, unit: Column) -> DataFrame:
    """The rows x and y that met, the smaller class first, and a unit to verify them in."""
    low, high = (F.struct(F.col(f"{s}.cls"), F.col(f"{s}.doc")) for s in ("x", "y"))
    first = F.col("x.cls") < F.col("y.cls")
    pair = met.select(F.when(first, low).otherwise(high).alias("a"), F.when(first, high).otherwise(low).alias("b"), unit.alias("unit"))
    return pair.select("unit", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in ("cls", "doc")])


def _block(side: str) -> Column:
    """A class's block of its group: blocks hold about UNIT_BYTES of sets."""
    parts = F.greatest(F.lit(1), F.ceil(F.col(f"{side}.held") * 8 / UNIT_BYTES))
    return F.pmod(F.xxhash64(f"{side}.cls"), parts)


def _verify(n: int, percent: int, seed: int):
    """Links among the pairs of each unit: rows come sorted by unit, texts before pairs."""

    def run(batches):
        unit, sets, label = None, {}, {}

        def root(x):
            while label.setdefault(x, x) != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        def hold(cls: int, text) -> None:
            for _, _, t, h in _sets(pa.array([text], pa.binary()), n):
                if len(t) and int(_signatures(t, h, seed)[2][0]) == cls:  # a doc_id may have several texts
                    sets[cls] = h

        def linked(a: int, b: int) -> bool:
            x, y = sets[a], sets[b]  # sorted
            shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            return 100 * shared >= percent * (len(x) + len(y) - shared)

        for batch in batches:
            a_out, b_out = [], []
            columns = [batch[name].to_pylist() for name in ("unit", "kind", "cls", "doc", "b_cls", "b_doc")]
            for row, (of, kind, cls, doc, b_cls, b_doc) in enumerate(zip(*columns, strict=True)):
                if of != unit:
                    unit, sets, label = of, {}, {}
                if kind == 0:
                    hold(cls, batch["text"][row].as_py())
                elif cls in sets and b_cls in sets and root(cls) != root(b_cls) and linked(cls, b_cls):
                    label[root(b_cls)] = root(cls)
                    a_out.append(doc)
                    b_out.append(b_doc)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, rows: DataFrame, sketches: DataFrame, likely, check) -> DataFrame:
    """Links (a, b) that join the documents of what the pairs link; each pair is verified once, in one of its units."""
    first = [F.min(c).alias(c) for c in ("unit", "a_doc", "b_doc")]
    pairs = pairs.groupBy("a_cls", "b_cls").agg(*first)
    for s, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sketches.select(F.col("cls").alias(f"{s}_cls"), F.col("sketch").alias(name)), f"{s}_cls")
    pairs = map_arrow(pairs, likely, "unit string, a_cls long, a_doc long, b_cls long, b_doc long")
    pairs = materialize(pairs, "join-pairs")
    side = F.explode(F.array(*[F.struct(F.col(f"{s}_cls").alias("cls"), F.col(f"{s}_doc").alias("doc")) for s in ("a", "b")])).alias("x")
    held = pairs.select("unit", side).select("unit", "x.cls", "x.doc").distinct()
    texts = rows.where(_bitmap(held.select("doc"))).join(held, "doc")
    no, none = F.lit(None).cast("long"), F.lit(None).cast("binary")
    texts = texts.select("unit", F.lit(0).alias("kind"), "cls", "doc", "text", no.alias("b_cls"), no.alias("b_doc"))
    asked = pairs.select("unit", F.lit(1).alias("kind"), F.col("a_cls").alias("cls"), F.col("a_doc").alias("doc"), none.alias("text"), "b_cls", "b_doc")
    units = texts.unionByName(asked).repartition("unit").sortWithinPartitions("unit", "kind")
    return materialize(map_arrow(units, check, "a long, b long"), "join-links")


def _across(big: DataFrame, known: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Pairs of classes that share a large group and not a component yet, met in blocks of the group; None if there are none."""
    rows = big.join(known, big["doc"] == known["node"], "left").select("token", "cls", "doc", "np", "c", "held", "bits", F.coalesce("component", "doc").alias("of"))
    rows = materialize(rows, "join-crowds")
    parted = rows.groupBy("token").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("token")
    if parted.isEmpty():
        return None
    parts = F.greatest(F.ceil(F.sqrt("c") / block), F.ceil(F.col("held") * 8 / UNIT_BYTES)).cast("int")
    rows = rows.join(parted, "token").withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("token", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "cls", "doc", "np", "bits", "of")
    x, y = rows.alias("x"), rows.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    apart = (F.col("x.of") != F.col("y.of")) & ((F.col("x.part") < F.col("y.part")) | (F.col("x.p") == F.col("x.q")) & (F.col("x.cls") < F.col("y.cls")))
    return _pairs(x.join(y, on & apart & _near("x", "y", percent) & _alike("x", "y", percent)), F.concat_ws(":", "x.token", "x.p", "x.q"))


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80, small: int = SMALL) -> DataFrame:
    """(doc, n, component) for every row: set size and the smallest doc_id that links reach."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text"))
    for seed in range(8):
        read = materialize(map_arrow(rows, _read(n, seed), "doc long, n long, cls long, proof long, sketch binary, bits array<bigint>, bucket int"), "join-read")
        members = read.where("bucket IS NULL")
        classes = members.where("n > 0").groupBy("cls").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.min("proof").alias("p"), F.max("proof").alias("q"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
        classes = materialize(classes, "join-classes")
        if classes.where("p <> q").isEmpty():  # else two sets share a name: other names are drawn
            break
    else:
        raise RuntimeError("set names collide")
    frequency = spark.sparkContext.broadcast(frequencies(read))
    verify = lambda pairs: _links(pairs, rows, classes.select("cls", "sketch"), _likely(percent), _verify(n, percent, seed))

    texts = rows.select("text").where(F.length("text") > 0)
    prefixes = map_arrow(texts, _prefixes(n, percent, seed, frequency), "token long, cls long, np long")
    counts = prefixes.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    met = materialize(prefixes.join(counts, "token"), "join-met").groupBy("token", "cls").agg(F.min("np").alias("np"))
    groups = met.groupBy("token").agg(F.count("*").alias("c"), F.sum(F.shiftright("np", 32)).alias("held")).where("c > 1")
    named = classes.where("rep IS NOT NULL").select("cls", F.col("rep").alias("doc"))
    shared = materialize(met.join(groups, "token").join(named, "cls").select("token", "cls", "doc", "np", "c", "held"), "join-shared")

    few, big = shared.where(F.col("c") <= small), shared.where(F.col("c") > small)
    x, y = few.alias("x"), few.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & _near("x", "y", percent))
    pairs = _pairs(met, F.concat_ws(":", "x.token", F.least(_block("x"), _block("y")), F.greatest(_block("x"), _block("y"))))
    # in a large group every class first meets HUBS others only: those that share most with large groups, which
    # is what the others were copied from, and some by chance
    shares = big.groupBy("cls").agg((-F.count("*")).alias("shares"))
    big = materialize(big.join(shares, "cls").join(classes.select("cls", "bits"), "cls"), "join-big")
    rank = lambda k: F.struct(F.when(F.lit(k < HUBS // 4), F.col("shares")).otherwise(0).alias("s"), F.xxhash64("cls", F.lit(k)).alias("h"), "cls", "doc", "np", "bits")
    hubs = big.groupBy("token").agg(*[F.min(rank(k)).alias(f"h{k}") for k in range(HUBS)])
    hubs = hubs.select("token", F.explode(F.array_distinct(F.array(*[F.col(f"h{k}") for k in range(HUBS)]))).alias("y"))
    met = big.alias("x").join(hubs.alias("hubs"), "token").where((F.col("x.cls") != F.col("y.cls")) & _near("x", "y", percent) & _alike("x", "y", percent))
    links = verify(pairs.unionByName(_pairs(met, F.concat_ws(":", "token", F.lit("h"), _block("x")))))
    reached = components(links)
    pairs = None if big.isEmpty() else _across(big, reached, percent, BLOCK)
    if pairs is not None:
        reached = components(links.unionByName(verify(pairs)))

    # a large class or component is dealt over SALTS copies of its label; rows alone in their class and without links need none
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    labels = classes.join(reached, classes["rep"] == reached["node"], "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
    labels = labels.select("cls", F.coalesce("component", "rep").alias("least"), F.lit(True).alias("labelled"), salts)
    out = members.where("n > 0").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(labels, ["cls", "salt"], "left")
    out = out.select("doc", "n", F.when(F.col("labelled"), F.col("least")).otherwise(F.col("doc")).alias("component"))
    return out.unionByName(members.where("n = 0").select("doc", "n", F.col("doc").alias("component")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 90 * (u.n + v.n - k)),
c AS (SELECT doc_id AS root, doc_id AS here FROM w UNION SELECT root, b FROM c JOIN l ON here = a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT here AS doc_id, min(root) AS component_id FROM c GROUP BY here) m USING (doc_id)
"""
