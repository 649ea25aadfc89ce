"""License scan, toxicity, language, byte BPE, token files: against plain versions and held-out rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from pagewright.llm import byte_bpe, language_id, license_scan, pieces, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, extra string, score double, n int"
ODD = [
    None,
    "",
    " ",
    "\n\n x",
    "don't we'll 'sx !'s <|endoftext|>",
    "été — naïve “q” é×÷é",
    "\t\tx\r\n  y ",
    "x1y2 3'44 cc-by CC  BY",
    "日本語 テスト",
    "a" * 2000,
    "word " * 3000,
    "General Public\nLicense, all rights reserved; All Rights Reserved.",
    "general pubic license and al rights reserved",
    "q\x00\x01\x1cz",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "e", 1.0, 1) for i, t in enumerate(ODD)] + [(8, ODD[8], None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_license_scan_matches_plain_counts(spark, docs):
    found = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, text in enumerate(ODD):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        want = sorted((k, label) for phrase, label, base in license_scan.PHRASES if base for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        got = sorted((s["start"], s["label"]) for s in found[i]["spans"] if s["base"] and s["edits"] == 0)
        assert (found[i]["n_words"], got) == (len(words), want), text
    fuzzy = {(s["label"], s["edits"]) for s in found[12]["spans"]}
    assert fuzzy == {("gpl", 1), ("reserved", 1)}
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_places_in_a_long_text_take_linear_time():
    import time

    scanner = license_scan._scan(license_scan.PHRASES)
    text = b"cc by all rights reserved general pubic license x " * 20_000
    began = time.time()
    (out,) = scanner([pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array([text], pa.binary())})])
    spans = out["spans"][0].as_py()
    assert len(spans) == 60_000 and out["n_words"][0].as_py() == 180_000 and time.time() - began < 30
    assert [(s["start"], s["stop"], s["edits"]) for s in spans[-3:]] == [(179_991, 179_993, 0), (179_993, 179_996, 0), (179_996, 179_999, 1)]


def test_edits_are_spans_with_their_counts_and_no_false_hits():
    scanner = license_scan.Scanner()
    found = lambda t: [(license_scan.PHRASES[p][1], t[a:b], e) for p, a, b, e in scanner.spans(t)]
    assert found(" a general publi license ") == [("gpl", "general publi license", 1)]  # a deletion
    assert found(" a general publicc license ") == [("gpl", "general publicc license", 1)]  # an insertion
    assert found(" a general pablic licence ") == [("gpl", "general pablic licence", 2)]
    assert found(" a general pablik licence ") == [] and found(" rights reserved generals ") == [] and found(" cc bi ") == []


def test_every_phrase_within_its_edits_is_found():
    scanner = license_scan.Scanner()
    rng = np.random.default_rng(5)
    for p, (phrase, _, _) in enumerate(license_scan.PHRASES):
        for _ in range(20):
            text, k = phrase, license_scan.edits_of(phrase)
            for _ in range(k):
                at = int(rng.integers(1, len(text) - 1))
                text = text[:at] + "z" + text[at + 1 :] if text[at] != " " else text
            assert any(s[0] == p for s in scanner.spans(f" some {text} more ")), text


def test_byte_bpe_equals_library(spark, docs):
    ranks = byte_bpe.public_ranks()
    library = tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks={t: i for i, t in enumerate(ranks.tokens) if t}, special_tokens={})
    for most in (8, 1 << 17):
        got = byte_bpe.encode_and_decode(docs, ranks, most=most).collect()
        assert len(got) == len(ODD) + 1
        for r in got:
            text = ODD[r["doc_id"]] or ""
            ids = library.encode_ordinary(text)
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), text
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_and_decode(docs.limit(0), ranks).count() == 0


def test_byte_bpe_plans_do_not_hold_the_rank_map(spark, docs):
    plan = byte_bpe.encode_and_decode(docs, byte_bpe.public_ranks())._jdf.queryExecution()
    assert len(plan.toString()) < 100_000  # the driver keeps every plan's description
    assert "__numbers" not in plan.executedPlan().toString()  # nor does any row


def test_long_words_take_the_same_merges():
    ranks = byte_bpe.public_ranks()
    library = tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks={t: i for i, t in enumerate(ranks.tokens) if t}, special_tokens={})
    pairs, byte_ids = ranks.pairs(), ranks.byte_ids()
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 400):
        word = "".join(rng.choice(list("abcdeth"), n))
        assert byte_bpe.merge_long(word.encode(), pairs, byte_ids) == library.encode_ordinary(word)


def test_token_files_round_trip(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    token_files.write_shards(docs, path, str(tmp_path / "shards"), shards=3, block_ids=1000)
    got = sorted(token_files.read_documents(spark, str(tmp_path / "shards")).collect(), key=lambda r: (r["start"]))
    start = 0
    order = sorted(range(len(ODD) + 1), key=lambda i: (i if i < len(ODD) else 8, i))
    for r, i in zip(got, order, strict=True):
        doc_id = i if i < len(ODD) else 8
        ids = [*plain.encode(ODD[doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_files.write_shards(docs.limit(0), path, str(tmp_path / "none"), shards=2)
    assert token_files.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_pieces_are_encoded_as_the_library_does_and_the_library_is_loaded_once():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        text = file.read()
    assert token_files._store(text) is token_files._store(text)
    plain = Tokenizer.from_str(text)
    plain.encode_special_tokens = True
    odd = [" word", "Zürich", "x" * 100, " 12345", "'s", "don't", "<|endoftext|>", "<|", "  ", "\n\t", "a b", "日本 語", "×÷", "!?", " ", ""]
    flat, starts, lengths = token_files.library_encoder(text)([p.encode() for p in odd])
    assert [flat[a : a + n].tolist() for a, n in zip(starts, lengths, strict=True)] == [plain.encode(p, add_special_tokens=False).ids for p in odd]


def test_token_files_take_special_literals_as_the_library_does(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain", None, "<|endoftext", "|>x<|endoftext|><|endoftext|> y", "é<|endoftext|>\n\n z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_shards(docs, path, str(tmp_path / "shards"), shards=1)
    for r in token_files.read_documents(spark, str(tmp_path / "shards")).collect():
        ids = [*plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[r["doc_id"]]
    assert plain.encode(texts[0], add_special_tokens=False).ids.count(50256) == 1


def test_grammar_is_exact_and_random_access():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 9, 5000), np.zeros(1001), np.tile([1, 2, 3], 900), np.zeros(0), np.array([7])):
        ids = ids.astype(np.uint32)
        first, rules, lengths, sequence = token_files.compress(ids, least=4)
        assert (token_files.expand(first, rules, sequence) == ids).all()
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2)):
            if b > a:
                assert (token_files.decode_range(first, rules, lengths, sequence, a, b) == ids[a:b]).all()
    first, rules, lengths, sequence = token_files.compress(np.tile([1, 2, 3, 4], 1000).astype(np.uint32))
    assert len(sequence) < 1000 and int(lengths.max()) >= 8


def test_grammar_leaves_no_frequent_pair(monkeypatch):
    rng = np.random.default_rng(6)
    zipf = np.minimum(rng.zipf(1.3, 60_000), 40_000)
    passage = np.tile(rng.integers(0, 50_000, 500), 60)
    for bits in (token_files._HASH_BITS, 4):  # with 16 slots most pairs lose theirs
        monkeypatch.setattr(token_files, "_HASH_BITS", bits)
        for ids in (zipf[: 60_000 if bits > 4 else 3000], passage, np.zeros(5000)):
            ids = ids.astype(np.uint32)
            first, rules, lengths, sequence = token_files.compress(ids)
            pairs = np.unique((sequence[:-1].astype(np.uint64) << np.uint64(32)) | sequence[1:], return_counts=True)[1]
            assert pairs.max(initial=0) < token_files.LEAST
            assert (token_files.expand(first, rules, sequence) == ids).all()
            assert (token_files.decode_range(first, rules, lengths, sequence, 100, 900) == ids[100:900]).all()


def test_piece_cuts_are_word_boundaries():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in filter(None, ODD):
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = set(pieces.cut(data, np.array([0, len(data)])).tolist())
        ends, at = {0}, 0
        for m in pattern.findall(text):
            at += len(m.encode())
            ends.add(at)
        assert cuts <= ends, text
        parts = np.append(sorted(cuts), len(data))
        split = [w for a, b in zip(parts, parts[1:], strict=False) for w in pattern.findall(data[a:b].tobytes().decode())]
        assert split == pattern.findall(text)


def test_language_on_held_out_rows(spark):
    words = {"aa": "the of and to in is that", "bb": "der die und das ist nicht ein", "cc": "que los las del por una con"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 30)), lang) for i in range(240) for lang in [list(words)[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !?", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    net = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, net, ["doc_id"]).collect()}
    tested = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["__lang_pred"] == rows[i][2] for i in tested]) > 0.95
    assert {got[i]["__lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert all(0 <= r["__score"] <= 1 for r in got.values())
    assert language_id.fit(docs.limit(0)) is None
    assert language_id.predict(docs, None, ["doc_id"]).where("__lang_pred = 'und'").count() == len(got)


def test_toxicity_on_held_out_rows(spark):
    from pagewright.llm.catalog import queries

    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
        got = [r for r in queries()["op2_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
        assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in got]) > 0.9
    # six rows of the small table are toxic: only the large one says something about recall
    toxic, clean = ([r["predicted"] for r in got if labels[r["doc_id"]] == k] for k in (1, 0))
    assert len(toxic) > 90 and np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.04
    empty = toxicity.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), None)
    assert {r["score"] for r in empty.collect()} == {0.0}
