"""Language identification by a convolutional network over bytes, trained here in numpy.

The network reads fixed windows of ``WINDOW`` bytes: filters of several widths over one-hot
bytes, the maximum of each filter over the window, a rectifier and a softmax.  Training is
Adam on mini-batches; the maximum sends each filter's gradient to one place a window, so a
step touches few weights.

A filter over one-hot bytes is a sum of table rows, so scoring looks up two bytes at a time
in tables of 65,536 rows that each worker builds once.  A text is cut into all its windows
(the last one padded with spaces); its score of a language is the mean of its windows'
probabilities, weighted by their bytes, and the best language is predicted.

Fitting uses a bounded sample: at most about ``ROWS_PER_LANGUAGE`` labelled rows of each
language, ``SPANS`` spans of each, chosen by a hash of doc_id.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to
the alphabetically first language; with nothing to learn from, everything is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table
from .pieces import texts_of

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
ROWS_PER_LANGUAGE = 400
SPANS = 6
UNKNOWN = "und"

#: A-Z are folded and digits alike.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48
FOLD[[0, 9, 10, 13]] = 32


@dataclass
class Network:
    names: list[str]
    tables: list[np.ndarray]  # one a width: (width, 256, FILTERS)
    bias: np.ndarray  # of the filters
    out: np.ndarray  # (all filters, languages)
    out_bias: np.ndarray


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes of each): every byte of every non-empty text is in one window."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    total = int(counts.sum())
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    out = np.full(total * WINDOW, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(first * WINDOW - offsets[:-1], sizes)
    out[place] = FOLD[data]
    within = np.arange(total) - np.repeat(first, counts)
    return out.reshape(total, WINDOW), text, np.minimum(sizes[text] - within * WINDOW, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], steps: int = 500, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    n = len(names)
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS]
    params = [*tables, np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, n)), np.zeros(n)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_class = [np.flatnonzero(labels == c) for c in range(n)]
    by_class = [x for x in by_class if len(x)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, max(1, batch // len(by_class))) for x in by_class])
        x, y = windows[pick], labels[pick]
        rows = np.arange(len(x))
        pooled, places = [], []
        for w, t in zip(WIDTHS, params, strict=False):
            act = sum(t[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
            at = act.argmax(1)
            places.append(at)
            pooled.append(np.take_along_axis(act, at[:, None], 1)[:, 0])
        raw = np.concatenate(pooled, 1) + params[-3]
        hidden = np.maximum(raw, 0)
        logits = hidden @ params[-2] + params[-1]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[rows, y] -= 1
        prob /= len(x)
        back = (prob @ params[-2].T) * (raw > 0)
        grads = [np.zeros_like(p) for p in params[: len(WIDTHS)]]
        for k, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                np.add.at(grads[k][j], (x[rows[:, None], at + j], np.arange(FILTERS)[None, :]), part)
        grads += [back.sum(0), hidden.T @ prob + 1e-4 * params[-2], prob.sum(0)]
        for p, g, m, s in zip(params, grads, mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(names, [p.astype(np.float32) for p in params[: len(WIDTHS)]], *(p.astype(np.float32) for p in params[-3:]))


class Scorer:
    """Window probabilities through tables of byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        self.pairs = []
        for t in net.tables:
            pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, len(t) - 1, 2)]
            self.pairs.append((pairs, t[-1] if len(t) % 2 else None))

    def __call__(self, windows: np.ndarray, block: int = 1024) -> np.ndarray:
        out = np.empty((len(windows), len(self.net.names)), np.float32)
        for k in range(0, len(windows), block):
            x = windows[k : k + block]
            two = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
            pooled = []
            for w, (pairs, last) in zip(WIDTHS, self.pairs, strict=True):
                n = WINDOW - w + 1
                act = pairs[0][two[:, :n]]
                for j, t in enumerate(pairs[1:], 1):
                    act += t[two[:, 2 * j : 2 * j + n]]
                if last is not None:
                    act += last[x[:, w - 1 : w - 1 + n]]
                pooled.append(act.max(1))
            logits = np.maximum(np.concatenate(pooled, 1) + self.net.bias, 0) @ self.net.out + self.net.out_bias
            prob = np.exp(logits - logits.max(1, keepdims=True))
            out[k : k + block] = prob / prob.sum(1, keepdims=True)
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(documents: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Network | None:
    """Train on a bounded sample of documents that are not held out and have a text and a lang."""
    usable = documents.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    names = sorted(counts)
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("lang") == name, min(1.0, rows_per_language / counts[name])).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    spans = F.transform(F.sequence(F.lit(0), F.lit(SPANS - 1)), lambda i: F.substring(F.col("text"), (F.length("text") * i / SPANS).cast("int") + 1, F.lit(WINDOW)))
    rows = usable.where(draw < share).select("doc_id", "lang", F.array_distinct(spans).alias("spans")).orderBy("doc_id", "spans").limit(2 * rows_per_language * len(names)).collect()
    data, labels = [], []
    for r in rows:
        for s in r["spans"]:
            if len(s) > 3:
                data.append(s.encode()[:WINDOW].ljust(WINDOW))
                labels.append(names.index(r["lang"]))
    if not data:
        return None
    windows = FOLD[np.frombuffer(b"".join(data), np.uint8)].reshape(-1, WINDOW)
    return train(windows, np.array(labels), names)


def _predict(net: Network):
    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}")
        scorer = Scorer(net)
        for batch in batches:
            data, offsets = texts_of(batch["__bytes"])
            total = np.zeros((len(batch), len(net.names)))
            begin = 0
            while begin < len(batch):  # a few MB of text at a time
                stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + (4 << 20), "right")) - 1)
                windows, text, weight = windows_of(data[offsets[begin] : offsets[stop]], offsets[begin : stop + 1] - offsets[begin])
                if len(windows):
                    prob = scorer(windows) * weight[:, None]
                    starts = np.flatnonzero(np.diff(text, prepend=-1))
                    total[begin + text[starts]] = np.add.reduceat(prob, starts)
                begin = stop
            sizes = np.diff(offsets)
            score = total / np.maximum(sizes, 1)[:, None]
            best = score.argmax(1)
            known = [bool(n) and letter.search(data[a : a + n].tobytes().decode("utf-8", "replace")) is not None for a, n in zip(offsets[:-1].tolist(), sizes.tolist(), strict=True)]
            names = [net.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            values = np.where(known, np.clip(score[np.arange(len(best)), best], 0, 1), 0.0)
            kept = [(batch.schema.field(i), batch.column(i)) for i in range(batch.num_columns - 1)]
            fields = [f for f, _ in kept] + [pa.field("__lang_pred", pa.string()), pa.field("__score", pa.float64())]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(names, pa.string()), pa.array(values, pa.float64())], schema=pa.schema(fields))

    return run


def predict(documents: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of documents, and __lang_pred, __score."""
    if net is None:
        return documents.select(*keep, F.lit(UNKNOWN).alias("__lang_pred"), F.lit(0.0).alias("__score"))
    rows = documents.select(*keep, F.col("text").cast("binary").alias("__bytes"))
    schema = T.StructType([*(f for f in rows.schema.fields[:-1]), T.StructField("__lang_pred", T.StringType()), T.StructField("__score", T.DoubleType())])
    return map_arrow(rows, _predict(net), schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = predict(documents, fit(documents), ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))
