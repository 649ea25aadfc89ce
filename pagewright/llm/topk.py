"""Exact top-k by integer inner product through a pivot-distance index.

Vectors are lifted by one coordinate so that all have the largest norm M: then the inner
product of a query with a vector falls as their distance grows, and the triangle inequality
holds: |d(q, p) - d(x, p)| <= d(q, x) for every pivot p.  Every vector is keyed by its
nearest pivot and the annulus (distance range) it lies in.  For every query the annuli are
sorted by the best score that the inequality leaves possible, and searched in that order, in
rounds that reach ``GROWTH`` times as many vectors each.  After a round the k-th score is the
bound, which only rises; a query is done at the first annulus that can't reach its bound.  A round in
which no query has an annulus left, as one annulus filled it before, ends nothing: the next one goes on.

Pivots and annulus edges come from a bounded sample (``SAMPLE`` rows of smallest hash);
every row is indexed and the result is exact whatever the pivots are.  What the driver
holds is one line per annulus, ``PIVOTS * (ANNULI + 1)`` a dimension at most.  Annuli are split
by a hash of vec_id into blocks of about ``BLOCK`` vectors and queries into chunks, and block
and chunk meet in a join on annulus and block, so no task holds more than one of each at a time,
and a vector that repeats in a third of all rows is spread as any other.  The joins say that they
are merges: chunks, written as Parquet, look small beside what they are in memory, and would be broadcast.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part; queries are scored against vectors of their own length; a vec_id that repeats among
the queries is answered once, for its smallest vector, and rows of that id are not its
candidates; other repeated rows are candidates of their own.  Components are floor(1024 x);
components and scores that don't fit 64-bit integers are the nearest that do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table

K = 10
QUERY_EVERY = 100
PIVOTS, ANNULI = 24, 12
SAMPLE = 1024
BLOCK, CHUNK = 512, 256
#: How many times more vectors each round reaches.
GROWTH = 16


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    usable = embeddings.select("vec_id", "embedding").where("vec_id IS NOT NULL AND size(embedding) > 0")
    usable = usable.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows; float64 where that is exact."""
    largest = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if largest * largest * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Index:
    """Pivots, the largest norm and the annulus edges for vectors of one length."""

    def __init__(self, sample: np.ndarray, top: float, pivots: int = PIVOTS, annuli: int = ANNULI):
        self.top = float(top)
        chosen, far = [0], None
        while len(chosen) < min(pivots, len(sample)):  # farthest first
            d = self.distances(sample, sample[chosen[-1:]])[:, 0]
            far = d if far is None else np.minimum(far, d)
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.pivots = sample[chosen].astype(np.float64)
        near = self.distances(sample, self.pivots).min(1)
        self.edges = np.unique(np.quantile(near, np.linspace(0, 1, annuli + 1)[1:-1]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))

    def distances(self, x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        square = 2 * self.top - 2 * x.astype(np.float64) @ pivots.astype(np.float64).T - 2 * np.outer(self.lift(x), self.lift(pivots))
        return np.sqrt(np.maximum(square, 0))

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = self.distances(x, self.pivots)
        pivot = d.argmin(1)
        near = d[np.arange(len(x)), pivot]
        return pivot, np.searchsorted(self.edges, near, "right"), near

    def bounds(self, q: np.ndarray, rings: list[tuple[int, float, float]]) -> np.ndarray:
        """For each query and ring (pivot, least, most distance), a score no vector there can exceed."""
        q = q.astype(np.float64)
        norm = (q * q).sum(1)
        d = np.sqrt(np.maximum(norm[:, None] + self.top - 2 * q @ self.pivots.T, 0))[:, [p for p, _, _ in rings]]
        low, high = np.array([r[1] for r in rings]), np.array([r[2] for r in rings])
        slack = 1e-6 * (1 + math.sqrt(self.top)) * 8
        gap = np.maximum(np.maximum(low - d, d - high) - slack, 0)
        return (norm[:, None] + self.top - gap * gap) / 2 + 1e-9 * self.top + 1


def _keyed(indexes: dict[int, Index]):
    def run(batches):
        for batch in batches:
            lengths = np.diff(batch["v"].offsets.to_numpy())
            n = len(batch)
            pivot, ring, near = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                pivot[at], ring[at], near[at] = indexes[int(dim)].key(_matrix(batch["v"].take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(lengths.astype(np.int32)), pa.array(pivot), pa.array(ring), pa.array(near)], names=["vec_id", "v", "dim", "pivot", "ring", "near"])

    return run


def _pairs(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for i in range(len(batch)):
                queries, block = batch["queries"][i].values, batch["block"][i].values
                q_ids, ids = queries.field("query_id").to_numpy(), block.field("vec_id").to_numpy()
                scores = products(_matrix(queries.field("q")), _matrix(block.field("v")))
                order = np.argsort(ids, kind="stable")
                ids, scores = ids[order], scores[:, order]
                for q, row in zip(q_ids, scores, strict=True):
                    at = np.flatnonzero(ids != q)
                    if len(at) > k:  # all that reach the k-th score, then ties by id
                        least = np.partition(row[at], len(at) - k)[len(at) - k]
                        at = at[row[at] >= least]
                        at = at[np.argsort(-row[at], kind="stable")[:k]]
                    out[0].append(np.full(len(at), q, np.int64))
                    out[1].append(ids[at])
                    out[2].append(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in out], names=names)

    return run


def _asks(indexes, rings, after: int, upto: int):
    """Rings each query is compared with in a round: those that lie between reaching ``after`` and ``upto`` vectors, while
    their bounds reach the query's least score."""
    columns = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.int64())), ("dim", pa.int32()), ("pivot", pa.int32()), ("ring", pa.int32()), ("parts", pa.int32())])

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            for r in batch.to_pylist():
                of = rings.get(len(r["q"]), [])
                if not of:
                    continue
                bound = indexes[len(r["q"])].bounds(np.array([r["q"]]), [(p, lo, hi) for p, _, lo, hi, _ in of])[0]
                order = np.argsort(-bound, kind="stable")
                reach = np.cumsum([of[j][4] for j in order])
                first = int(np.searchsorted(reach, after)) + 1 if after else 0
                for j in order[first : int(np.searchsorted(reach, upto)) + 1]:
                    if r["least"] is not None and bound[j] < r["least"]:
                        break
                    for column, x in zip(out, (r["query_id"], r["q"], len(r["q"]), of[j][0], of[j][1], -(-of[j][4] // BLOCK)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, columns, strict=True)], schema=columns)

    return run


def top_k(embeddings: DataFrame, query_every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query."""
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    tops = {r["dim"]: r["top"] for r in vectors.groupBy(F.size("v").alias("dim")).agg(F.max(norm).alias("top")).collect()}
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    indexes = {}
    for dim, top in tops.items():
        rows = [r["v"] for r in sample if len(r["v"]) == dim] or [[0] * dim]
        indexes[dim] = Index(np.array(rows), top)

    keyed = materialize(map_arrow(vectors, _keyed(indexes), "vec_id long, v array<long>, dim int, pivot int, ring int, near double"), "topk-keyed")
    stats = keyed.groupBy("dim", "pivot", "ring").agg(F.min("near").alias("lo"), F.max("near").alias("hi"), F.count("*").alias("n")).collect()
    rings: dict[int, list] = {}
    for r in sorted(stats, key=lambda r: (r["dim"], r["pivot"], r["ring"])):
        rings.setdefault(r["dim"], []).append((r["pivot"], r["ring"], r["lo"], r["hi"], r["n"]))
    splits = spark.createDataFrame([(r["dim"], r["pivot"], r["ring"], -(-r["n"] // BLOCK)) for r in stats], "dim int, pivot int, ring int, parts long")
    salted = keyed.join(F.broadcast(splits), ["dim", "pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    blocks = materialize(salted.groupBy("dim", "pivot", "ring", "part").agg(F.collect_list(F.struct("vec_id", "v")).alias("block")), "topk-blocks")

    queries = vectors.where(F.col("vec_id") % query_every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    queries = materialize(queries, "topk-queries")
    chunks = max(1, -(-queries.count() // CHUNK))
    most = max([sum(r[4] for r in of) for of in rings.values()], default=0)

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, after, upto = None, 0, 4 * k + 1
    while after < most or found is None:
        asked = queries.withColumn("least", F.lit(None).cast("long"))
        if found is not None:
            least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            asked = queries.join(least.hint("merge"), "query_id", "left")
        asks = map_arrow(asked, _asks(indexes, rings, after, upto), "query_id long, q array<long>, dim int, pivot int, ring int, parts int")
        asks = materialize(asks, "topk-asks")
        if found is None or not asks.isEmpty():  # a large annulus may fill whole rounds: what lies behind it comes later
            part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
            grouped = asks.select("query_id", "q", "dim", "pivot", "ring", part).groupBy("dim", "pivot", "ring", "part", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("query_id", "q")).alias("queries"))
            met = grouped.join(blocks.hint("merge"), ["dim", "pivot", "ring", "part"]).select("queries", "block")
            scored = map_arrow(met, _pairs(k), "query_id long, vec_id long, score long")
            if found is not None:
                scored = scored.unionByName(found.select("query_id", "vec_id", "score"))
            found = materialize(scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "topk-found")
        after, upto = upto, upto * GROWTH
    return found.select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
