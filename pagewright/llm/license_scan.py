"""License scans: fuzzy search for short notices.

A phrase of ``n`` characters may be found with ``k`` edits.  By the pigeonhole principle,
of ``k + 1`` pieces of the phrase one must occur unchanged in any text within ``k`` edits,
so an Aho-Corasick automaton over all pieces (the seeds) locates candidates exactly, and
the ``regex`` library's bounded-error matching verifies each candidate's surroundings and
reports spans and edits.  Texts are first reduced to their words, parted by one space.

Verified spans without edits that stand between spaces are the exact places: their words
stand consecutively.  Phrases of the base table give base labels; the operator's own
phrases, and base phrases found with edits, add labels to those.

Defined results: null, empty and wordless texts have no words and no places.  Each row
gives a row; overlapping places of different phrases all count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, map_arrow, table

#: (phrase, label, is base)
PHRASES = (
    ("cc by", "cc-by", True),
    ("general public license", "gpl", True),
    ("all rights reserved", "reserved", True),
    ("licensed under the apache license", "apache", False),
    ("apache license version 2 0", "apache-2.0", False),
    ("permission is hereby granted free of charge", "mit", False),
    ("released under the mit license", "mit", False),
    ("redistribution and use in source and binary forms", "bsd", False),
    ("mozilla public license", "mpl", False),
    ("creative commons attribution", "cc-by", False),
    ("this work is in the public domain", "public-domain", False),
    ("spdx license identifier", "spdx", False),
)

#: Characters of a phrase for each edit that is allowed.
CHARS_PER_EDIT = 10


@dataclass(frozen=True)
class Seed:
    phrase: int
    offset: int
    length: int


def edits_of(phrase: str) -> int:
    return len(phrase) // CHARS_PER_EDIT


def seeds_of(phrases) -> dict[str, list[Seed]]:
    """Pieces of each phrase: one more than its edits, of nearly equal length."""
    out: dict[str, list[Seed]] = {}
    for p, (phrase, _, _) in enumerate(phrases):
        n = edits_of(phrase) + 1
        bounds = [len(phrase) * i // n for i in range(n + 1)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            out.setdefault(phrase[a:b], []).append(Seed(p, a, b - a))
    return out


class Scanner:
    def __init__(self, phrases=PHRASES):
        import ahocorasick
        import regex

        self.phrases = phrases
        self.automaton = ahocorasick.Automaton()
        for piece, seeds in seeds_of(phrases).items():
            self.automaton.add_word(piece, (len(piece), seeds))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?e)(?<= )(?:{regex.escape(p)}){{e<={edits_of(p)}}}(?= )") for p, _, _ in phrases]

    def spans(self, spaced: str) -> list[tuple[int, int, int, int]]:
        """(phrase, start, end, edits) in a text of words with one space around each."""
        windows: dict[int, list[list[int]]] = {}
        for last, (length, seeds) in self.automaton.iter(spaced):
            begin = last - length + 1
            for s in seeds:
                phrase = self.phrases[s.phrase][0]
                k = edits_of(phrase)
                a, b = begin - s.offset - k - 1, begin - s.offset + len(phrase) + k + 1
                held = windows.setdefault(s.phrase, [])
                if held and a <= held[-1][1]:
                    held[-1][0], held[-1][1] = min(a, held[-1][0]), max(b, held[-1][1])
                else:
                    held.append([a, b])
        found = []
        for p, held in windows.items():
            phrase = self.phrases[p][0]
            whole = f" {phrase} "
            for a, b in held:
                a, b = max(a, 0), min(b, len(spaced))
                exact, at = [], spaced.find(whole, a, b)
                while at >= 0:
                    exact.append(at + 1)
                    at = spaced.find(whole, at + 1, b)
                found += [(p, x, x + len(phrase), 0) for x in exact]
                if not edits_of(phrase):
                    continue
                k = 0  # both come in order of place: what overlaps a match lies at the pointer
                for m in self.patterns[p].finditer(spaced, a, b):
                    while k < len(exact) and exact[k] + len(phrase) <= m.start():
                        k += 1
                    if k == len(exact) or exact[k] >= m.end():
                        found.append((p, m.start(), m.end(), sum(m.fuzzy_counts)))
        return sorted(set(found), key=lambda x: (x[1], x[0]))


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())]))
_SCHEMA = "doc_id long, n_words long, spans array<struct<label:string,start:long,stop:long,edits:int,base:boolean>>, score double"


def _scan(phrases):
    def run(batches):
        scanner = Scanner(phrases)
        for batch in batches:
            n_words, all_spans, scores = [], [], []
            for text in batch["text"].to_pylist():
                words = text.translate(WORD_BYTES).split() if text else []
                spaced = b" " + b" ".join(words) + b" "
                n_words.append(len(words))
                score, rows = 0.0, []
                spans = scanner.spans(spaced.decode("latin-1"))
                spaces = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32) if spans else None
                for p, start, stop, edits in spans:
                    phrase, label, base = phrases[p]
                    first, after = np.searchsorted(spaces, (start, stop)).tolist()
                    rows.append({"label": label, "start": first - 1, "stop": after, "edits": edits, "base": base})
                    score = max(score, 1 - edits / len(phrase))
                all_spans.append(rows)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(all_spans, _SPANS), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "spans", "score"])

    return run


def scan(documents: DataFrame, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, spans (label, first word, word after the last, edits, base), score for every row."""
    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), _scan(phrases), _SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"] & (s["edits"] == 0))
    starts = F.transform(base, lambda s: s["start"])

    def joined(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        "score",
        F.size("spans").alias("n_spans"),
        # every span as label:first word-word after the last:edits
        F.array_join(F.transform("spans", lambda s: F.concat(s["label"], F.lit(":"), s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"), F.lit(":"), s["edits"].cast("string"))), " ").alias("spans"),
    )
