"""Jaccard join, components, suffix dedup, top-k, decontamination, url rules: against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import components, decontaminate, ngram_join, suffix_dedup, topk, url_filter, windows


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def family(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            words = docs[rng.randrange(len(docs))].split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))]
        docs.append(" ".join(words))
    return [*docs, None, "", "  \t", "one", "one", "ONE two", "one two", docs[0], docs[0].upper()]


@pytest.mark.parametrize(("n", "percent", "small"), [(3, 90, 48), (5, 80, 48), (2, 60, 2)])
def test_jaccard_join_equals_brute_force(spark, n, percent, small):
    texts = family(n * percent)
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n int, token string")
    got = {r["doc"]: (r["n"], r["component"]) for r in ngram_join.near_duplicates(docs, n, percent, small).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_jaccard_join_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    texts = [f"{' '.join(f'k{i}' for i in range(40))} u{j}" for j in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.near_duplicates(docs, 3, 90, small=2).collect()
    assert {r["component"] for r in got} == {0}
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(199)] + [(1000, 1001), (1001, 1000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 200)) and got[1001] == 1000


def plain_dedup(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [2048, 1])
def test_suffix_dedup_equals_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_ranges, "__defaults__", (group,))
    rng = random.Random(9)
    base = "".join(rng.choice("abcdé \n") for _ in range(900))
    texts = [None, "", "x" * 150, "ab" * 300, base, base[100:700], base[:250] + "Z" + base[250:], "q" * 199 + base[300:520], base[:199], base]
    texts += [base[i : i + 260] + str(i) + base[i + 260 : i + 500] for i in (0, 3, 50)]
    texts += ["".join(rng.choice("abc") for _ in range(3000))]
    docs = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, ranges string")
    got = {r["doc_id"]: (r["__n_bytes"], r["__n_removed"], r["__n_spans"], r["__sha"]) for r in suffix_dedup.remove_repeats(docs, ["doc_id"]).collect()}
    assert got == dict(enumerate(plain_dedup(texts, 200)))
    assert suffix_dedup.remove_repeats(docs.limit(0), ["doc_id"]).count() == 0


def test_bounded_expansion():
    rng = random.Random(3)
    for _ in range(60):
        least = rng.choice([2, 5, 8])
        base = "".join(rng.choice("abc") for _ in range(30))
        parts = []
        for _ in range(rng.randint(1, 7)):
            s = list(base[rng.randint(0, 10) :][: rng.randint(1, 30)])
            for _ in range(rng.randint(0, 3)):
                s[rng.randrange(len(s))] = rng.choice("abcd")
            parts.append("".join(s).encode())
        count = Counter(p[i : i + least] for p in parts for i in range(len(p) - least + 1))
        want, begin = set(), 0
        for p in parts:
            want |= {begin + i for i in range(len(p) - least + 1) if count[p[i : i + least]] > 1}
            begin += len(p) + 1
        assert set(suffix_dedup.repeated_starts(parts, least).tolist()) == want


def test_expansion_holds_little_at_a_time():
    rng = random.Random(5)
    rows = []
    for owner in range(150):
        base = bytes(rng.choices(b"abcdefgh ", k=420))
        rows += [(owner, i, 1, base[i : i + 300]) for i in range(0, 120, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["owner", "content", "n", "bytes"])
    tracemalloc.start()
    found = sum(len(b) for b in suffix_dedup._expand([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(rows) and peak < 64 << 20  # 2.7 MB of stretches


def test_scans_hold_little_at_a_time():
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefgh \n", k=100_000))
    texts = [text[i * 1000 :] + text[: i * 1000] for i in range(40)]  # 4 MB whose stretches all count as repeated
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array([t.encode() for t in texts])], names=["doc", "key", "text"])

    class Full:
        value = np.full(suffix_dedup.BITS // 64, (1 << 64) - 1, np.uint64)

    for scan in (suffix_dedup._owners, suffix_dedup._likely(Full)):
        tracemalloc.start()
        largest = max(b.nbytes for b in scan([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24 << 20 and largest < 4 << 20
    found = pa.Table.from_batches(suffix_dedup._likely(Full)([batch])).to_pylist()
    assert [(r["doc"], r["first"]) for r in found] == sorted((r["doc"], r["first"]) for r in found)
    assert all(r["bytes"] == texts[r["doc"]].encode()[r["first"] : r["first"] + r["count"] + 199] for r in found if r["bytes"] is not None)
    several = {(r["owner"], r["content"]) for r in found}
    assert sorted(several) == sorted((r["owner"], r["content"]) for r in found if r["bytes"] is not None)


def test_powers_without_tables_of_all_places():
    assert sum(x.nbytes for v in vars(windows).values() for x in (v if isinstance(v, tuple) else [v]) if isinstance(x, np.ndarray)) < 1 << 20
    base, whole = int(windows._BASE), 1 << 64
    for size in (0, 1, 1023, 1024, 70_000, 1 << 20, (1 << 20) + 1):
        up, down = windows.powers(size)
        assert len(up) == len(down) == size + 1
        for i in {0, size // 3, size - size // 1024, size}:
            assert int(up[i]) == pow(base, i, whole) and int(down[i]) == pow(base, -i, whole)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)], i % 3) for i in range(400)]
    rows += [(500 + i, rows[7][1], 0) for i in range(20)]
    rows += [(1000, None, 0), (1100, [], 0), (1200, [float("nan")] * 6, 0), (1300, [None] * 6, 0), (1400, [float("inf")] * 6, 0), (1500, [0.5, 0.5], 0), (1501, [0.25, 0.5], 0), (1600, [1e6] * 6, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(frame).collect()}
    usable = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in usable if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(scored[:10], 1)}
    assert got == want
    assert topk.top_k(frame.limit(0)).count() == 0


def test_top_k_looks_on_where_one_ring_fills_whole_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk.Index.__init__, "__defaults__", (1, 2))  # two rings of about 1,500 vectors: more than the second round reaches
    rng = np.random.default_rng(11)
    vectors = rng.normal(0, 0.3, (3000, 6))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = np.floor(1024 * vectors).astype(np.int64)
    scores = whole[::100] @ whole.T
    want = set()
    for q, row in zip(range(0, 3000, 100), scores, strict=True):
        best = [i for i in np.lexsort((np.arange(3000), -row)).tolist() if i != q][:10]
        want |= {(q, k, i, int(row[i])) for k, i in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(frame).collect()} == want


def test_top_k_broadcasts_nothing_that_grows(spark, monkeypatch):
    plans, write = {}, topk.materialize

    def spy(frame, what):
        plans.setdefault(what, []).append(frame._jdf.queryExecution().executedPlan().toString())
        return write(frame, what)

    monkeypatch.setattr(topk, "materialize", spy)
    rng = np.random.default_rng(5)
    topk.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.3, (600, 6)))], "vec_id long, embedding array<double>")).count()
    assert plans["topk-found"] and plans["topk-asks"]
    assert not any("Broadcast" in p for p in [*plans["topk-found"], *plans["topk-asks"]])


def test_top_k_of_large_components(spark):
    rows = [(1000, [3e6, 3e6]), (1, [2.0, 1.0]), (2, [-3.0, 1.0]), (2, [1.0, 1.0]), (3, [3e6, 2e6]), (1100, [1e25, -1e25, 1.0]), (3, [1e25, 1.0, 1.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    unit = 3_000_000 * 1024
    assert got[:4] == [(1000, 1, 3, (1 << 63) - 1), (1000, 2, 1, unit * 3072), (1000, 3, 2, unit * 2048), (1000, 4, 2, unit * -2048)]
    assert [x[:3] for x in got[4:]] == [(1100, 1, 3)]


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((30, 13, 14, 60, 5, 1, 20))]
    items += [(10, items[1][1]), (11, None), (12, "..."), (13, "Only ONE-two.")]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            source = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(source)) if source else 0
            words[len(words) // 2 : len(words) // 2] = source[a : a + rng.randrange(5, 40)]
        docs.append((i, " ".join(words)))
    docs += [(70, None), (71, ""), (72, "x, only!one TWO y"), (73, items[3][1].upper()), (73, items[3][1].upper())]
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        w = tokens(text)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    want = []
    for d, text in docs:
        w, hit, held = tokens(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    held |= found
        want.append((d, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    frame = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, n_words int, start string")
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, m int")
    assert sorted(map(tuple, decontaminate.decontaminate(frame, bench).collect())) == sorted(want)
    none = decontaminate.decontaminate(frame, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    assert decontaminate.decontaminate(frame.limit(0), bench).count() == 0


def test_url_rules_and_model(spark):
    urls = {
        1: ("http://WWW.Example.NET/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("https://example.net/fr", "example.net", "/fr", "net/", "block"),
        3: ("x://net", "net", "", None, None),
        4: ("x://a.org/fr/q", "a.org", "/fr/q", "org/fr/", "allow"),
        5: ("http://example.com/de/?a=://b", "example.com", "/de/", "example.com/de/", "block"),
        6: ("nothing", "", "", None, None),
        7: (None, "", "", None, None),
        8: ("a?b://É.com?p/q", "É.com", "", None, None),
        9: ("http://notnet/en/", "notnet", "/en/", None, None),
        10: ("http://cheap-pills.example.org/x", "cheap-pills.example.org", "/x", None, "block"),
        11: ("http://city-library.example.org/en/12", "city-library.example.org", "/en/12", None, "allow"),
    }
    pages = spark.createDataFrame([(k, v[0], "h", 1) for k, v in urls.items()], "page_id long, url string, host string, score int")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for k, (_, host, path, rule, verdict) in urls.items():
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] in ("allow", "block") if verdict is None else got[k]["verdict"] == verdict
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_model_on_hosts_it_has_not_seen(spark):
    hosts = "spam-farm adult-x casino-win ads-track cheap-pills free-bets".split()
    learned = {u.split("//")[1].split("/")[0] for u, _ in url_filter.training_rows()}
    assert not any(h in u for h in hosts for u in learned)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    judged = [r for r in url_filter.judge(pages).collect() if r["rule"] is None and r["host"]]
    bad = [r["verdict"] == "block" for r in judged if any(h in r["host"] for h in hosts)]
    good = [r["verdict"] == "allow" for r in judged if not any(h in r["host"] for h in hosts)]
    assert len(bad) >= 5 and np.mean(bad) >= 0.9 and np.mean(good) >= 0.97
