"""Rules held against written cases, whatever their SQL says."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagewright import functions as X
from pagewright import plans
from pagewright.functions import lines as L
from pagewright.operators import blocks, furniture, html_blocks, line_joins, typography


@pytest.fixture(scope="module")
def rule(spark):
    def values(function, *rows):
        """The function of each row's values, given as columns a, b and so on."""
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = "abcdefgh"[: len(rows[0])]
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names])
        return [r[0] for r in frame.orderBy("i").select(function(*map(F.col, names)).alias("v")).collect()]

    return values


def test_placeholders_and_stated_values(rule):
    assert rule(X.stated, "Unknown Author", "no author", "No Title", "NOT available", "n/a", " A\u00a0 title\x07 ", "--", "x" * 1001) == [None] * 5 + ["A title", None, None]
    assert rule(L.page_label, "xii", "y" * 33, "12") == ["xii", None, "12"]


def test_xml_text(rule):
    assert rule(X.xml_text, "a<b> & \"c\" 'd'\x01\ufffe") == ["a&lt;b&gt; &amp; &quot;c&quot; &apos;d&apos;"]


def test_advances_skip_white_space(rule):
    assert rule(L.advances, "ab cd", "日本 x", " \t\u3000", "ﬁ１") == [4, 5, 0, 3]


def test_typed_rules(rule):
    assert rule(L.is_typed_rule, "- -", "—–―‒‐-_─━", "-", "__ x", "= =", " ── ") == [True, True, False, False, False, True]


def test_external_targets(rule):
    found = rule(html_blocks.is_external_target, "https://a.example/x", "HTTP://a.example", "mailto:a@b.example", "ftp://a.example", "/x", "https://a.example/ x", "https://a.example/" + "x" * 2000, "javascript:x()", "https:\x07x")
    assert found == [True, True, True, False, False, False, False, False, False]


def test_markers(rule):
    assert rule(X.marker_family, "• one", "* * *", "+ 100% fruit juice", "+ c ~ 50", "a) x", "12. x", "1999. x", "-x") == ["bullet", None, "bullet", None, "letter", "number", None, None]
    assert rule(L.marker_kind, "12. x", "a) x", "12.", "ab. x") == ["number.", "letter)", None, None]
    assert rule(lambda t: L.marker_kind(t, whole=True), "12.", "a)", "12. x") == ["number.", "letter)", None]
    assert rule(L.marked_value, "3) x", "B. x", "x") == [3, 98, None]
    assert rule(X.is_value, "7,100", "(2)", "—", "12†", "e740", "1% ad valorem.", "") == [True, True, True, True, True, False, False]


def test_section_numbers_and_chapters(rule):
    assert rule(L.section_number, "3 Results", "3.12 More results", "0.1 None", "123 Many", "3 results", "3 Ab", "3 " + "Aaa " * 40) == ["3", "3.12", None, None, None, None, None]
    assert rule(L.roman, "xiv", "MCMXCIV", "IIII", "IC", "", "mmmm") == [14, 1994, None, None, None, None]
    said = rule(L.chapter_label, "Chapter 4: The sea", "CHAPTER  IX.   Winds", "chapter iiii x", "Part 2", "Chapter 7 – Ice", "Chapter 0 x")
    assert [tuple(x) if x else x for x in said] == [(4, "The sea", None), (9, "Winds", "chapter ix"), None, None, (7, "Ice", None), None]
    assert rule(L.names_exercises, "Practice 3", "More EXERCISES", "Exercised") == [True, True, False]


def test_scripts(rule):
    assert rule(L.latin_repaired, "Сору that", "Привет Mир", "plain") == ["Copy that", "Привет Mир", "plain"]
    assert rule(L.cyrillic_repaired, "MOСKBA", "XCM", "HET", "not Москва") == ["МОСКВА", "XCM", "НЕТ", "not Москва"]
    assert rule(L.joined_ideographs, "中 文  字", "中 a 文", "中 文") == ["中文字", "中 a 文", "中文"]
    assert rule(L.reads_visual_order, ") a (", "(a)", "a)", "(a) ) (b") == [True, False, False, True]
    assert rule(L.is_index_glyph_name, "g12", "G108", "glyph7", "uni0041", "u12", "cid99", "abc12", "12") == [True, True, True, False, False, True, False, False]


def test_line_pairs(rule):
    assert rule(L.breaks_at_closed_en_dash, ("1990–", "1995"), ("a –", "b"), ("a–", " b")) == [True, False, False]
    assert rule(L.breaks_at_closed_em_dash, ("said—", "“no”"), ("said —", "no"), ("a——", "b")) == [True, False, False]
    assert rule(L.arabic_without_space, ("سلام", "، x"), ("سلام", "x"), ("a", ".")) == [True, False, False]
    assert rule(L.continues_citation, ("384", "U. S. 436 (1966)"), ("3845", "U. S. 4"), ("384", "U.S. 4")) == [True, False, False]
    known = lambda w: w.isin("example", "well-known", "wellknown", "Example")
    cases = [("exam-", "ple"), ("well-", "known"), ("foo-", "bar"), ("soft\u00ad", "ly"), ("the", "end"), ("中", "文"), ("1990–", "95"), ("exam-", "Ple"), ("e-", "Xample")]
    want = ["remove", "concatenate", "concatenate", "remove", "space", "concatenate", "concatenate", "remove", "concatenate"]
    assert rule(lambda a, b: L.join_operation(a, b, known), *cases) == want


def test_shares_and_distances(rule):
    assert rule(L.percent, 0.12345, 1.5, -1.0, 0.5) == ["12.35%", "100.00%", "0.00%", "50.00%"]
    assert rule(lambda a, b: L.nearly(a, b, 2), ("total", "totel"), ("a", "b"), ("abcd", "wxyz")) == [True, True, False]


def test_findings(rule):
    # english, judged, lonely, misread, words, numeric, number, tokens
    cases = [(9, 20, 0, 0, 20, 0, 0, 20), (10, 20, 0, 2, 20, 0, 0, 20), (11, 19, 0, 9, 20, 0, 0, 20), (15, 20, 0, 1, 20, 0, 4, 20), (15, 20, 0, 1, 20, 4, 0, 20), (11, 20, 0, 15, 200, 0, 0, 200), (13, 20, 0, 15, 200, 0, 0, 200)]
    assert rule(plans.word_finding, *cases) == ["few_english", "misread", None, None, None, "misread", None]
    assert rule(plans.ink_finding, (7, 0.75, 6), (7, 0.75, 7), (6, 0.9, 0), (9, 0.7, 0)) == ["missing_text", None, None, None]
    assert rule(plans.cells_were_read, (8, 0), (10, 5), (10, 4)) == [True, True, False]
    assert rule(plans.is_paper, (255, 255, 255), (10, 12, 11), (250, 235, 200), (12, 32, 117), (200, 190, 130)) == [True, True, True, False, False]


def plan_of(rule, policy, **said):
    names = ("requires_image", "image_backed", "lacks_text", "sparse")
    row = (policy, said.get("finding") or "", *[bool(said.get(n)) for n in names])
    one = lambda p, f, *flags: plans.recognition_plan(p, {"finding": F.nullif(f, F.lit("")), **dict(zip(names, flags, strict=True))}.__getitem__)
    return rule(one, row)[0]


def test_recognition_plan(rule):
    assert plan_of(rule, "never", lacks_text=True) == "keep"
    assert plan_of(rule, "always") == "replace"
    assert plan_of(rule, "always", requires_image=True) == "keep"
    assert plan_of(rule, "automatic", lacks_text=True) == "replace"
    assert plan_of(rule, "automatic", finding="misread", image_backed=True) == "compare"
    assert plan_of(rule, "automatic", finding="few_english", image_backed=True) == "replace"
    assert plan_of(rule, "automatic", sparse=True) == "verify"
    assert plan_of(rule, "automatic_including", image_backed=True) == "replace"
    assert plan_of(rule, "automatic_keeping", finding="misread", image_backed=True) == "keep"


def test_furniture_runs_are_anchored_at_their_first_line(spark):
    at = lambda page, y, text="Part 3", size=9.0, row=0: ("d", page, row, text, 72.0, y, 100.0, 10.0, size)
    drifting = [at(p, 800.0 + 3.0 * p) for p in range(1, 7)]  # each step is small, but not the way from the first
    steady = [at(p, 760.0, "Head", row=1) for p in (1, 2, 4, 5, 8)]  # the last is too far on
    folios = [at(p, 30.0 + 4 * (p % 3), str(p), row=9) for p in range(1, 5)]
    lines = spark.createDataFrame(drifting + steady + folios, "doc_id string, page_no int, row_no int, text string, x double, y double, w double, h double, size double")
    got = {(r["page_no"], r["row_no"]) for r in furniture.plan(furniture.candidates(lines, 842.0)).collect()}
    assert got == {(p, 1) for p in (1, 2, 4, 5)} | {(p, 9) for p in range(1, 5)}


def test_heading_tiers_and_ranks(spark):
    tagged = [("d", p, 32, True, 1 if p < 3 else 2) for p in range(1, 5)] + [("d", p, 22, True, 3) for p in (1, 2, 3)] + [("d", p, 40, True, 1) for p in (1, 2)]
    tiers = typography.heading_tiers(spark.createDataFrame(tagged, "doc_id string, page_no int, size_key int, bold boolean, level int"))
    assert sorted((r["size_key"], r["level"]) for r in tiers.collect()) == [(22, 3), (32, 1)]  # ties are shallow, two pages don't rank
    lines = spark.createDataFrame([("d", 1, i, s, b) for i, (s, b) in enumerate([(20.0, True), (16.0, True), (12.0, True), (10.0, True), (16.0, False)])], "doc_id string, page_no int, row_no int, size double, bold boolean")
    assert [r["level"] for r in typography.ranked_levels(lines, tiers).orderBy("row_no").collect()] == [1, 1, 3, None, None]


def test_hyphens_in_the_document(spark):
    wrapped = spark.createDataFrame([(1, ["example", "well-known"], ["an exam-", "ple of well-", "known facts", "end"]), (2, [], ["one"]), (3, [], [])], "doc_id long, words array<string>, lines array<string>")
    assert [(r[0], r[1], r[2]) for r in line_joins.hyphen_join(wrapped).orderBy("doc_id", "line_no").collect()] == [(1, 0, "remove"), (1, 1, "concatenate"), (1, 2, "space")]
    joined = "an example of well-known facts end"
    assert {r["doc_id"]: r["n_chars"] for r in line_joins.paragraph_join(wrapped).collect()} == {1: len(joined), 2: 3, 3: 0}


def test_phrases_in_order(rule):
    assert rule(blocks.ordered_in, ("a b a c", ["a", "a", "c"]), ("a b", ["b", "a"]), ("aa", ["a", "a", "a"])) == [True, False, False]


def test_windows_of_a_stream(spark, tmp_path):
    from pagewright.streaming import windowed_counts

    day = datetime.datetime(2024, 1, 1)
    rows = [(day + datetime.timedelta(minutes=20 * i), "ab"[i % 2], float(i)) for i in range(9)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    run = windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r["window"]["start"].hour, r["event_type"], r["n"]) for r in spark.table("windows").collect()) == [(0, "a", 2), (0, "b", 1), (1, "a", 1), (1, "b", 2), (2, "a", 2), (2, "b", 1)]


def test_styled_text(spark):
    from pagewright.operators import inline

    kind = "array<struct<text:string,style:int,href:string>>"
    runs = [("ab ", 2, None), ("cd", 3, "u"), (" ", 0, None), ("ef", 0, "u"), ("gh ", 8, None)]
    frame = spark.createDataFrame([(1, runs), (2, []), (3, [("  x ", 2, None), (" ", 0, None)])], f"i int, r {kind}")

    def of(column):
        return [r[0] for r in frame.orderBy("i").select(column).collect()]

    r = F.col("r")
    assert of(inline.plain_text(r)) == ["ab cd efgh ", "", "  x  "]
    assert [[tuple(x) for x in v] for v in of(inline.trimmed(r))] == [[*runs[:4], ("gh", 8, None)], [], [("x", 2, None)]]
    assert [tuple(x) for x in of(inline.dropped(r, F.lit(4)))[0]] == [("d", 3, "u"), *runs[2:]]
    assert [tuple(x) for x in of(inline.links_merged(r))[0]] == [runs[0], ("cd ef", 3, "u"), runs[4]]
    assert of(inline.divided_at(r, F.lit(4))) == [False, False, True] and of(inline.divided_at(r, F.lit(3))) == [True, False, True]
    assert of(inline.wholly_bold(r)) == [False, True, True]
    assert of(inline.markup(r))[0] == '<strong>ab </strong><a href="u"><strong><em>cd</em></strong></a> <a href="u">ef</a><sup>gh </sup>'
    assert of(inline.href(F.lit("page"), F.lit("7")))[0] == "page-7" + "-" * 42
    assert len(of(inline.href(F.lit("note"), F.lit("n")))[0]) == 128 and of(inline.href(F.lit("external"), F.lit("a&b")))[0] == "a&amp;b"


def test_phrases_across_files(spark):
    from pagewright.operators.checks import spine_crossings

    files = spark.createDataFrame([(1, 1, "a b. c"), (1, 2, "d e"), (1, 3, "c f")], "doc_id long, file int, text string")
    joins = spark.createDataFrame([(1, 0, "a", "b."), (1, 1, "b.", "a"), (1, 2, "b.", "d"), (1, 3, "a", "f"), (1, 4, "a", "c"), (1, 5, "a", "zz")], "doc_id long, ord int, before string, after string")
    got = {r["ord"]: r["verdict"] for r in spine_crossings(joins, files).collect()}
    assert got == {0: "inside", 1: "disordered", 2: "across", 3: "apart", 4: "repeated", 5: "repeated"}


def test_word_classes(spark):
    from pagewright.operators import word_classes

    lines = [(1, 0, "The dog's don't a 12th 3 mis- xq zzq"), (1, 1, "I a"), (1, 2, "McDonald NATO Привет wo rd b"), (2, 0, "")]
    known = spark.createDataFrame([(w,) for w in ("the", "dog", "do", "word")], "word string")
    got = {r["doc_id"]: r.asDict() for r in word_classes.word_counts(spark.createDataFrame(lines, "doc_id long, line_no int, line string"), known).collect()}
    # the, dog, do and a are known; I and a stand alone on their line; wo and rd join to a known word
    assert {k: got[1][k] for k in ("tokens", "numeric_tokens", "number_tokens", "english", "neutral", "lonely")} == {"tokens": 17, "numeric_tokens": 2, "number_tokens": 1, "english": 6, "neutral": 2, "lonely": 2}
    assert (got[1]["damaged"], got[1]["misread"]) == (8, 2)  # th, mis, xq, zzq, a foreign word, wo, rd and b; of them mis and zzq are long enough and join to nothing
    assert got[2]["tokens"] == got[2]["english"] == 0


def test_line_ends_are_the_text_ends(spark, rule):
    """A line separator ends no text: what stands before it isn't the end."""
    from pagewright.operators import inline

    frame = spark.createDataFrame([([("a \u2028", 0, None)],), ([(" ", 0, None), ("b", 0, None), (" \t", 0, "u")],)], "r array<struct<text:string,style:int,href:string>>")
    assert [r[0] for r in frame.select(inline.plain_text(inline.trimmed(F.col("r")))).collect()] == ["a \u2028", "b"]
    assert rule(L.breaks_at_closed_en_dash, ("a–\u2028", "b"), ("a–", "b")) == [False, True]


def test_wrapped_texts_break_words_at_the_end_only(spark, tmp_path):
    from pagewright import sources

    spark.createDataFrame([(1, "x" * 59 + "\r" + "y" * 59 + "z" + "word")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r)[1:] for r in sources.wrapped_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(0, "x" * 59 + "\r", "y" * 59 + "z-"), (1, "y" * 59 + "z-", "word"), (2, "word", None)]
    assert line_joins.paragraph_join(sources.wrapped_texts(spark, str(tmp_path))).first()["n_chars"] == 59 + 1 + 1 + 60 + 4


def test_ends_of_a_line_say_what_the_line_says(rule):
    rules = (L.breaks_at_closed_en_dash, L.breaks_at_closed_em_dash, L.wide_without_space, L.arabic_without_space, L.continues_citation)
    pairs = [("long line 1990–", "1995 and on and on"), ("he said at last—", "“no”, and so on, long"), ("文字文字文字  ", "   中文 and more and more"), ("سلام سلام  ", " \t، xxxxxxxxxxxxx"), ("see 384", "U. S. 4361 (1966)"), ("see 1384", "U. S. 436 (1966)"), ("384", "U. S. 43612"), ("", "")]
    for of in rules:
        assert rule(lambda a, b, of=of: of(L.last_of(a), L.first_of(b)), *pairs) == rule(of, *pairs)
    assert [rule(of, *pairs).index(True) for of in rules] == [0, 1, 2, 3, 4]


def test_long_texts_take_time_in_proportion(spark, tmp_path):
    """Twenty thousand runs on a line, and as many lines of a text: quadratic forms took minutes."""
    import time

    from pagewright import catalog

    spark.createDataFrame([(1, "en", "a " * 60_000 + "b"), (2, "en", ("= word" * 20_000))], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("inline_ends", "inline_markup", "line_end_substitute", "hyphen_join"):
        began = time.time()
        catalog.queries()[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
        assert time.time() - began < 20, name


def test_words_are_counted_once_and_documents_not_broadcast(spark):
    import re

    from pagewright import catalog

    for name in ("word_counts", "word_findings", "recognition_plan", "recognition_resolve"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        lines = re.findall(r"Generate posexplode\(split\(text", plan.optimizedPlan().toString())
        assert len(lines) == 2, name  # of a document's lines: once for tokens, once for words
        assert not re.search(r"BroadcastHashJoin \[(doc_id|o_doc_id)", plan.executedPlan().toString()), name
