"""Toxicity by compression distance, with one zstandard dictionary a class.

Training text is reduced to lower-case words parted by spaces.  zstandard trains one
dictionary on windows of ordinary text, and one on toxic text.  Most of a toxic text is ordinary, so
the toxic samples are the words that begin with something toxic documents hold
far more often than ordinary ones do, once or repeatedly, each time they occur; the ordinary content, which both
classes share, stands in front of what is trained on them.  So the two dictionaries differ in what
parts the classes, and a window's gain, its compressed length with the ordinary dictionary
less that with the toxic one, is near 0 for ordinary text.

Every window of every text is compressed with both dictionaries at a fast setting; windows
whose length the toxic dictionary lowers are compressed again with both at a strong
setting (optimal parsing, entropy tables), whose difference is the gain.  Thresholds on
the gains turn a text's windows into a few features, and their logistic weights are
calibrated on the labelled rows, which never include held-out ones; a toxic row weighs
``TOXIC_WEIGHT`` ordinary ones, since toxic texts are the rarer and missing one costs more.

Fitting uses a bounded sample: about ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled rows,
chosen by a hash of doc_id, never more than ``2 * (TOXIC_ROWS + ORDINARY_ROWS)``, and ``SAMPLE_BYTES`` of each.

Defined results: null, empty and wordless texts have no windows and get the score of no
gain; with no rows of one class to learn from every score is 0; labels that repeat a
doc_id count once, toxic if any of them is.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, map_arrow, table

STEP, OVERLAP = 48, 16
ORDINARY_BYTES = 32768
TOXIC_BYTES = 4096
#: How many times the ordinary share of documents must hold a word start, once or repeatedly, and in what share of toxic ones at least.
ONCE, REPEATED = (6.0, 0.02), (12.0, 0.015)
TOXIC_WEIGHT = 3.0
TOXIC_ROWS, ORDINARY_ROWS = 800, 1600
#: Bytes of a sampled row's text that are learned from (scores read whole texts).
SAMPLE_BYTES = 1 << 16
FAST, STRONG = 3, 19
#: Gains that count, in bytes.
THRESHOLDS = (1, 2, 4)

#: Repeat offsets at the end of a dictionary's entropy tables (zstd format); its content follows.
_TABLES_END = b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00"


def normal(text: bytes) -> bytes:
    return text.translate(WORD_BYTES)


def windows(data: bytes) -> list[bytes]:
    data = b" " + data
    return [data[i : i + STEP + OVERLAP] for i in range(0, max(1, len(data) - OVERLAP), STEP)] if len(data) > 1 else []


@dataclass
class Model:
    tables: bytes
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    bias: float


class Gains:
    def __init__(self, tables: bytes, ordinary: bytes, toxic: bytes):
        import zstandard as z

        def compressor(content: bytes, level: int, kind: int):
            return z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(content, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False).compress

        both = ordinary + toxic
        self.fast = compressor(ordinary, FAST, z.DICT_TYPE_RAWCONTENT), compressor(both, FAST, z.DICT_TYPE_RAWCONTENT)
        self.strong = compressor(tables + ordinary, STRONG, z.DICT_TYPE_FULLDICT), compressor(tables + both, STRONG, z.DICT_TYPE_FULLDICT)

    def of(self, text: bytes) -> list[int]:
        (a, b), (c, d) = self.fast, self.strong
        return [len(c(w)) - len(d(w)) if len(a(w)) > len(b(w)) else 0 for w in windows(normal(text))]


def features(gains: list[int]) -> list[float]:
    if not gains:
        return [0.0] * (4 + len(THRESHOLDS))
    g = np.array(gains, float)
    top = np.sort(g)[::-1]
    root = np.sqrt(len(g))
    gained = np.clip(g, 0, None).sum()
    return [top[0], top[:3].sum(), gained / len(g), gained / root, *((g >= t).sum() / root for t in THRESHOLDS)]


def _starts(texts: list[bytes]) -> tuple[Counter, Counter]:
    """Documents that hold each word start of 4 to 10 bytes, and those that hold it in several words."""
    once: Counter = Counter()
    repeated: Counter = Counter()
    for text in texts:
        held = Counter(w[:n] for w in text.split() for n in range(4, min(len(w), 10) + 1))
        once.update(held.keys())
        repeated.update(w for w, n in held.items() if n > 1)
    return once, repeated


def _toxic_samples(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words of the toxic texts, at each of their places, whose start parts the classes."""
    starts: set[bytes] = set()
    for inside, outside, (ratio, share) in zip(_starts(toxic), _starts(ordinary), (ONCE, REPEATED), strict=True):
        least = max(2, share * len(toxic))
        starts |= {w for w, n in inside.items() if n >= least and n / len(toxic) >= ratio * (outside[w] + 1) / len(ordinary)}
    return [b" " + w + b" " for t in toxic for w in t.split() if any(w[:n] in starts for n in range(4, min(len(w), 10) + 1))]


def _toxic_content(samples: list[bytes]) -> bytes:
    """What zstandard's training makes of the samples; the samples themselves where they are too few to train on."""
    import zstandard as z

    try:
        trained = z.train_dictionary(TOXIC_BYTES, samples, k=24, d=6).as_bytes()
        return trained[trained.index(_TABLES_END) + len(_TABLES_END) :]
    except (z.ZstdError, ValueError):
        return b"".join(samples)[-TOXIC_BYTES:]


def train(rows: list[tuple[bytes, int]]) -> Model | None:
    """A model from (text, toxic) rows; None if a class is missing."""
    import zstandard as z

    toxic, ordinary = [normal(t) for t, y in rows if y], [normal(t) for t, y in rows if not y]
    if not toxic or not ordinary:
        return None
    samples = [t[i : i + 64] for t in ordinary for i in range(0, len(t), 64)]
    step = max(1, len(samples) // 60_000)
    try:
        trained = z.train_dictionary(ORDINARY_BYTES, samples[::step], k=48, d=6).as_bytes()
        at = trained.index(_TABLES_END) + len(_TABLES_END)
    except (z.ZstdError, ValueError):
        return None
    tables, content = trained[:at], trained[at:]
    model = Model(tables, content, _toxic_content(_toxic_samples(toxic, ordinary)), *[np.zeros(0)] * 3, 0.0)
    gains = Gains(tables, content, model.toxic)
    x = np.array([features(gains.of(t)) for t, _ in rows])
    y = np.array([float(bool(label)) for _, label in rows])
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    x = (x - model.mean) / model.spread
    w, b, weight = np.zeros(x.shape[1]), 0.0, np.where(y > 0, TOXIC_WEIGHT, 1.0)
    weight /= weight.sum()
    for _ in range(3000):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight
        w -= 0.5 * (x.T @ error + 1e-3 * w)
        b -= 0.5 * error.sum()
    model.weights, model.bias = w, float(b)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model | None:
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y"), min(1.0, toxic_rows / max(1, counts.get(True, 0)))).otherwise(min(1.0, ordinary_rows / max(1, counts.get(False, 0))))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000 < share).limit(2 * (toxic_rows + ordinary_rows))
    rows = documents.select("doc_id", F.substring(F.col("text").cast("binary"), 1, SAMPLE_BYTES).alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").limit(2 * (toxic_rows + ordinary_rows)).collect()
    return train([(bytes(r["text"]), int(r["y"])) for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["text"])))])


def _score(model: Model):
    def run(batches):
        gains = Gains(model.tables, model.ordinary, model.toxic)
        for batch in batches:
            x = np.array([features(gains.of(t) if t else []) for t in batch["text"].to_pylist()]).reshape(len(batch), -1)
            z = ((x - model.mean) / model.spread) @ model.weights + model.bias if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=["doc_id", "score"])

    return run


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score for every row of documents."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    return map_arrow(rows, _score(model), "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
