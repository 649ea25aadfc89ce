"""The corpus pipeline's stages on planted cases."""

import corpus_pipeline as pipeline


def test_stages_keep_clean_rows_and_drop_planted_ones(spark, tmp_path):
    import random

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item, passage = text(40), text(60)
    rows = [(i, text(80)) for i in range(20)]
    rows += [(20, rows[3][1]), (21, rows[4][1] + " more"), (22, f"{text(30)} {item} {text(5)}"), (23, f"{text(50)} {passage} {text(50)}"), (24, f"{text(50)} {passage} {text(50)}"), (25, None), (26, "12 34")]
    docs = spark.createDataFrame([(i, t, ["en", "de"][i % 2], "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, ranges string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeats", "benchmark", "tokens"]
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, held, str(tmp_path))
        if name != "tokens":
            assert out.columns == held.columns
        held = pipeline.materialize(out, "test")
        ids.append(sorted(r["doc_id"] for r in held.collect()))
    assert ids[0] == list(range(25))
    assert ids[1] == [*range(20), 22, 23, 24]
    assert ids[2] == ids[1]
    assert ids[3] == ids[4] == [*range(20), 23, 24]
    assert sorted(r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()) == ids[4]


def test_extra_columns_and_empty_tables_come_through(spark, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["row", "__bytes", "__text", "__ranges", "__k", "component", "d", "key", "unit", "__lang_pred"]
    schema = "doc_id long, text string, lang string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    texts = ["some words stand here", "und andere stehen dort", None, "some words stand here"]
    docs = spark.createDataFrame([(i, t, ["en", "de"][i % 2], 5, *[n + str(i) for n in names]) for i, t in enumerate(texts)], schema)
    for held in (docs, docs.limit(0)):
        n = held.count()
        for name, stage in pipeline.STAGES:
            out = stage(spark, held, str(tmp_path))
            if name == "tokens":
                assert out.count() == n
                break
            assert out.columns == docs.columns
            held = pipeline.materialize(out, "test")
            n = held.count()
            assert all(r["__bytes"] == f"__bytes{r['doc_id']}" for r in held.collect())


def test_stages_judge_rows_and_not_ids(spark, tmp_path):
    import random

    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item, t = text(40), [text(80) for _ in range(8)]
    tainted = [f"{text(30)} {item} {text(5)}" for _ in range(2)]
    rows = [(1, t[0]), (1, t[1]), (1, t[1]), (2, t[2]), (3, t[2] + " more"), (3, t[3]), (None, t[4]), (None, t[4] + " more"), (None, t[5]), (4, t[5]), (None, t[6])]
    kept = [(1, t[0]), (1, t[1]), (2, t[2]), (3, t[3]), (4, t[5]), (None, t[6])]
    docs = spark.createDataFrame([(i, x, "d") for i, x in rows], "doc_id long, text string, d string")
    near = pipeline.near(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in near.collect()]
    assert len(got) == len(kept) + 1 and set(kept) < set(got) and [x[0] for x in got if x not in kept] == [None]
    assert [x[1] for x in got if x not in kept][0] in (t[4], t[4] + " more")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(7, tainted[0], "x"), (7, t[7], "x"), (None, tainted[1], "x"), (None, t[0], "x")], "doc_id long, text string, d string")
    assert {(r["doc_id"], r["text"]) for r in pipeline.benchmark(spark, docs, str(tmp_path)).collect()} == {(7, t[7]), (None, t[0])}
