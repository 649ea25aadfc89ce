"""Lists and packing against written cases and plain simulations."""

import random

from pagewright.operators.list_items import Block, Builder, ListStream, build_lists, rows_of
from pagewright.operators.spine import Packer


def built(*texts, pages=None, kinds=None, edges=None):
    builder = Builder()
    for i, text in enumerate(texts):
        kind = (kinds or {}).get(i, "preformatted")
        builder.accept(Block(i, (pages or {}).get(i, 1), kind, text, edge=(edges or {}).get(i, 72.0), size=11.0))
    builder.settle()
    return [(r[2], r[3], r[5], r[6]) for r in rows_of(0, builder.blocks)]


def test_markers_chain_into_lists():
    assert built("• first item", "• second item") == [("unordered", "•", 0, True), ("unordered", "•", 0, False)]
    assert built("1. first item", "2. second item", "3. third item") == [("ordered", f"{i}.", 0, i == 1) for i in (1, 2, 3)]
    assert [k for k, *_ in built("1. first item", "3. third item")] == ["preformatted"] * 2  # a number is missing
    assert [k for k, *_ in built("a) first item", "b) second item")] == ["lettered"] * 2
    assert [k for k, *_ in built("A) first item", "b) second item")] == ["preformatted"] * 2  # two families
    assert built("• only item")[0][0] == "paragraph"  # a lone marker is a paragraph's


def test_what_is_no_list():
    assert [k for k, *_ in built("1. Introduction 12", "2. Method 15", "3. Results 19")] == ["preformatted"] * 3  # contents
    assert [k for k, *_ in built("1. Find the sum of 2 and 4", "2. How many are 3 and 5?", "3. Find the third of 9")] == ["preformatted"] * 3  # problems
    assert [k for k, *_ in built("1. Smith, J. Notes on rivers", "2. Adams, K. L. Notes on hills")] == ["preformatted"] * 2  # references
    assert [k for k, *_ in built("1. first item", "2. second item", "3.")] == ["preformatted"] * 3  # the numbering goes on without items


def test_pages_pieces_and_levels():
    kinds = {2: "page"}
    assert [k for k, *_ in built("1. first item", "2. second item", "", "3. third item", kinds=kinds, pages={3: 2, 2: 2})] == ["ordered", "ordered", "page", "ordered"]
    assert [k for k, *_ in built("• first item", "• second item", "some prose", "• third item", kinds={2: "paragraph"})] == ["unordered", "unordered", "paragraph", "paragraph"]
    assert [k for k, *_ in built("• first item", "• second item", pages={1: 4})] == ["paragraph", "paragraph"]  # two pages apart
    nested = built("1. first item", "2. second item", "a. inner item", "b. inner item", edges={2: 90.0, 3: 90.0})
    assert nested == [("ordered", "1.", 0, True), ("ordered", "2.", 0, False), ("lettered", "a.", 1, True), ("lettered", "b.", 1, False)]
    assert [k for k, *_ in built("1. first item", "a. inner item", "b. inner item", "2. second item")] == ["paragraph", "lettered", "lettered", "paragraph"]


def test_stream_gives_what_the_batch_gives():
    rng = random.Random(4)
    for _ in range(40):
        blocks = []
        for page in range(1, 9):
            for _ in range(rng.randrange(4)):
                text = rng.choice(["• ", "1. ", "2. ", "3. ", "a) ", "b) ", ""]) + "some item here"
                blocks.append((page, "preformatted" if text[0] != "s" else "paragraph", text))
        whole, stream = Builder(), ListStream()
        for i, (page, kind, text) in enumerate(blocks):
            whole.accept(Block(i, page, kind, text))
        whole.settle()
        got = []
        for page in range(1, 9):
            got += stream.page([Block(i, p, k, t) for i, (p, k, t) in enumerate(blocks) if p == page])
        got += stream.finish()
        assert rows_of(0, got) == rows_of(0, whole.blocks)


def test_lists_of_documents(spark):
    rows = [(d, i, 1, "preformatted", f"{i + 1}. item of words", False, 72.0, 11.0) for d in (1, 2) for i in range(3)] + [(3, 0, 1, "paragraph", None, False, None, None)]
    blocks = spark.createDataFrame(rows, "doc_id long, seq int, page int, kind string, text string, recognized boolean, edge double, size double")
    got = sorted((r["doc_id"], r["seq"], r["kind"], r["text"]) for r in build_lists(blocks).collect())
    assert got == [(d, i, "ordered", "item of words") for d in (1, 2) for i in range(3)] + [(3, 0, "paragraph", "")]
    assert build_lists(blocks.limit(0)).count() == 0


def simulated(blocks, target):
    """Files as lists of blocks: bytes are counted afresh at each step."""
    files, current = [], []
    size = lambda some: sum(b[1] for b in some)

    def headings():
        k = len(current)
        while k and current[k - 1][2]:
            k -= 1
        return k

    for i, (n, heading, chapter) in enumerate(blocks):
        if chapter:
            if current:
                files.append(current)
            current = []
        k = headings()
        short = k < len(current) and size(current[k:]) * 10 <= target
        if current and size(current) + n > target and not (short and k == 0):
            if short and size(current[:k]):
                files.append(current[:k])
                current = current[k:]
            else:
                files.append(current)
                current = []
        current.append((i, n, heading))
        k = headings()
        if size(current) >= target and not (k < len(current) and size(current[k:]) * 10 <= target):
            files.append(current)
            current = []
    out = {}
    for number, file in enumerate([*files, current], 1):
        for i, *_ in file:
            out[i] = number
    return [out[i] for i in range(len(blocks))]


def test_packing_equals_a_plain_simulation():
    rng = random.Random(2)
    for _ in range(400):
        blocks = [(rng.choice([1, 5, 20, 60, 150]), rng.random() < 0.3, False) for _ in range(rng.randrange(1, 25))]
        blocks = [(n if not h else min(n, 20), h, h and rng.random() < 0.2) for n, h, _ in blocks]
        assert Packer(100).files(blocks) == simulated(blocks, 100), blocks


def test_headings_go_on_with_what_they_head():
    assert Packer(100).files([(90, False, False), (5, True, False), (50, False, False)]) == [1, 2, 2]
    assert Packer(100).files([(90, False, False), (50, True, False), (50, False, False)]) == [1, 2, 2]
    assert Packer(100).files([(40, False, False), (5, True, True), (50, False, False)]) == [1, 2, 2]
    assert Packer(100).files([(250, False, False), (10, False, False)]) == [1, 2]


def test_groups_are_folded_in_batches(spark):
    from pagewright.operators import reading_order, spine
    from pagewright.operators.grouped import fold_groups

    rows = [(k, i, f"{k}{i}") for k in (None, 1, 2, 5) for i in (7, 3, 11, 1, 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        frame = spark.createDataFrame(rows, "k int, i int, t string")
        got = fold_groups(frame, ["k"], ["i"], lambda group: [(group[0][0], "".join(f"{t};" for _, _, t in group))], "k int, t string").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == {(k, "".join(f"{k}{i};" for i in (1, 3, 5, 7, 11))) for k in (None, 1, 2, 5)}

    schema = "doc_id long, seq int, page int, kind string, text string, recognized boolean, edge double, size double"
    lists = build_lists(spark.createDataFrame([(1, 2, 1, "preformatted", "• second item", False, 72.0, 11.0), (1, 1, 1, "preformatted", "• first item", False, 72.0, 11.0)], schema))
    boxes = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 1.0, 1.0)], "doc_id long, page_no int, row_no int, x double, y double, w double, h double")
    packed = spine.pack(spark.createDataFrame([(1, 1, 5, False, False)], "doc_id long, seq int, bytes long, heading boolean, chapter boolean"))
    for frame in (lists, packed, reading_order.reading_order(boxes)):
        assert "InPandas" not in frame._jdf.queryExecution().toString()  # a data frame for each group costs more than its rows
    assert [(r["kind"], r["opens"]) for r in lists.orderBy("seq").collect()] == [("unordered", True), ("unordered", False)]
