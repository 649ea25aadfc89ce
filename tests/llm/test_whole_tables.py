"""The registered queries on a whole table, against the public libraries and plain Python."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from pagewright.llm import byte_bpe
from pagewright.llm.catalog import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op3_equals_the_library(spark, texts):
    ranks = byte_bpe.public_ranks()
    library = tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks={t: i for i, t in enumerate(ranks.tokens) if t}, special_tokens={})
    got = {r["doc_id"]: tuple(r) for r in queries()["op3_byte_bpe"](spark, SF).collect()}
    for d, text in texts.items():
        ids = library.encode_ordinary(text)
        assert got.pop(d) == (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got


def test_op10_equals_the_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries()["op10_token_files"](spark, SF).collect()}
    start = 0
    for d in sorted(texts):
        ids = [*library.encode(texts[d], add_special_tokens=False).ids, 2]
        assert got.pop(d) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_op1_base_columns_equal_plain_counts(spark, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = {r["doc_id"]: r for r in queries()["op1_license_scan"](spark, SF).collect()}
    for d, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        found = [(k, label) for p, label in phrases.items() for w in [p.split()] for k in range(len(words)) if words[k : k + len(w)] == w]
        r = got.pop(d)
        places = [k for k, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(found), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert not got


def test_op5_and_op2_answer_for_every_row(spark, texts):
    for name, modulus, remainder in (("op5_language_id", 4, 2), ("op2_toxicity", 5, 0)):
        rows = queries()[name](spark, SF).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder) and 0 <= r["score"] <= 1 for r in rows)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    told = [(r["lang_pred"], lang[r["doc_id"]]) for r in queries()["op5_language_id"](spark, SF).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([a == b for a, b in told]) > 0.95
