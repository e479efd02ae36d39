"""The relational stages against the document-local ones, layout, boundaries and the rate limit."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import boundary, kernel, layout, lines, merge, segment, split
from textloom.options import BoundaryOptions, ChunkOptions, RateLimit
from textloom.streaming import rate_limit


def random_docs(seed, n=60):
    r = random.Random(seed)
    parts = ["# One", "## Two words", "#### Deep", "- item a", "2) item b", "| a | b |", "| c |d|", "", "   ", "Some plain text.", "More of it, with a comma", "x" * 700, "word " * 260, "é Ü 　 spaced"]
    return [(i, "\n".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(random_docs(1), "doc_id long, text string").cache()


def by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return {k: sorted(v) for k, v in out.items()}


def test_nodes(docs):
    got = by_doc(lines.nodes(lines.line_rows(docs)).select("doc_id", "node_pos", "node_type", "level", "text").collect())
    want = {d: [(i, n.kind, n.level, n.text) for i, n in enumerate(kernel.markdown_nodes(t))] for d, t in random_docs(1)}
    assert got == {k: v for k, v in want.items() if v}


def test_blocks_paths_and_merges(docs):
    nodes = segment.blocks(segment.section_paths(lines.normalised(lines.nodes(lines.line_rows(docs)))))
    facts = segment.block_facts(nodes)
    blocks = {d: kernel.segmented(kernel.normalised(kernel.markdown_nodes(t))) for d, t in random_docs(1)}
    got = by_doc(facts.select("doc_id", "block_id", "text", segment.path_text(F.col("path")), "tokens").collect())
    want = {d: [(i, kernel.block_text(b), " > ".join(kernel.block_path(b)), kernel.block_tokens(b, kernel.estimate)) for i, b in enumerate(bs)] for d, bs in blocks.items()}
    assert got == {k: v for k, v in want.items() if v}
    for options in (ChunkOptions(), ChunkOptions(min_tokens=5, max_tokens=40)):
        merged = merge.merged(facts.withColumn("path", segment.path_text(F.col("path"))), options)
        got = by_doc(merged.select("doc_id", "block_id", "text").collect())
        want = {d: [(i, kernel.block_text(b)) for i, b in enumerate(kernel.merged(bs, options, kernel.estimate))] for d, bs in blocks.items()}
        assert got == {k: v for k, v in want.items() if v}
    serial = by_doc(segment.serialised(facts).select("doc_id", "chunk_index", "chunk_type", "full_text").collect())
    want = {d: [(i, c[0], c[1]) for i, c in enumerate(kernel.chunks(bs), 1)] for d, bs in blocks.items()}
    assert serial == {k: v for k, v in want.items() if v}


def test_merging_under_a_lone_title(spark):
    """Segmentation never leaves a title alone on the left; the rule is held with literal blocks."""
    rows = [(1, 0, "p", 900, 1, 1, 0, 0, 0), (1, 1, "p", 900, 1, 0, 1, 0, 0), (1, 2, "q", 1, 1, 0, 1, 0, 0)]
    facts = spark.createDataFrame(rows, "doc_id long, block_id long, path string, tokens long, n_nodes long, n_title long, n_paragraph long, n_table long, n_list long")
    assert [r["group_id"] for r in merge.merge_groups(facts).orderBy("block_id").collect()] == [0, 0, 1]


@pytest.mark.parametrize("most", [10, 50])
def test_fixed_passes_equal_the_recursion(spark, most):
    r = random.Random(3)
    texts = ["".join(r.choice("abc ,.;!-_\n。，") for _ in range(r.randint(0, 300))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("n", tx.normal_text(F.col("t")))
    got = df.orderBy("i").select(split.separator_parts(F.col("n"), most), "n").collect()
    for parts, text in got:
        want = [s.text for s in kernel.recursive_split(text, most, kernel.estimate)]
        if all(kernel.estimate(p) <= most for p in parts):
            assert parts == want
    spans = split.split_spans(df, "n", ChunkOptions(max_tokens=most, overlap_tokens=2)).orderBy("i").collect()
    for row in spans:
        plain = kernel.packed(kernel.recursive_split(row["n"], most, kernel.estimate), most, kernel.estimate)
        assert len(row["spans"]) == len(plain)


def test_hard_windows_by_arithmetic(spark):
    lengths = [0, 1, 40, 41, 45, 1800, 1801, 2700, 6000, 12345]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    for most in (10, 450):
        for n, widths in df.select("n", split.hard_windows(F.col("n"), most)).collect():
            assert widths == [len(s.text) for s in kernel.hard_windows("x" * n, most, kernel.estimate)]


def test_whitespace_tokens_and_previews(spark):
    values = ["", " \t\x1c ", "a", "　abcde\x85", "x" * 200, "x" * 201, "y\n" * 150, "ab " * 67 + "tail end", "a\xa0\xa0b"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    got = df.select(tx.token_count(F.col("v")), tx.strip(F.col("v")), tx.preview(F.col("v"))).collect()
    assert [r[0] for r in got] == [kernel.estimate(v) for v in values]
    assert [r[1] for r in got] == [v.strip() for v in values]
    flat = [v.replace("\n", " ").strip() for v in values]
    assert [r[2] for r in got] == [f if len(f) <= 200 else f[:200].rstrip() + "..." for f in flat]


# -- boundaries -------------------------------------------------------------------------------------------------------


def test_cosine_rejects_what_a_scorer_would(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(boundary.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, None, None]


@pytest.mark.parametrize("bounds", [BoundaryOptions(), BoundaryOptions(llm=True), BoundaryOptions(similarity=False), BoundaryOptions(similarity=False, llm=True)])
def test_decision_expression_equals_the_function(spark, bounds):
    pair = [kernel.Node("paragraph", "a")], [kernel.Node("paragraph", "b")]
    cases = [(s, w) for s in (None, 0.5, 0.72, 0.8, 0.88, 0.95) for w in (True, False, None)]
    df = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(cases)], "i int, s double, w boolean").orderBy("i")
    d = boundary.decision(F.lit(True), F.col("s"), F.col("w"), bounds)
    got = [tuple(r) for r in df.select(d.alias("d")).select("d.*").collect()]
    want = [kernel.decide(*pair, ChunkOptions(), bounds, kernel.estimate, (lambda s: None if s is None else lambda a, b: s)(s), lambda a, b, w=w: bool(w)) for s, w in cases]
    assert got == want


def test_models_see_eligible_pairs_only(spark):
    pairs = spark.createDataFrame([(1, True), (2, False)], "k int, ok boolean")
    seen = []

    def asks(df):
        seen.append(df)
        return df.withColumn("score", F.lit(0.9)).withColumn("says_merge", F.lit(None).cast("boolean"))

    got = {r["k"]: r["score"] for r in boundary.decide_with_model(pairs, F.col("ok"), asks, ["k"]).collect()}
    assert got == {1: 0.9, 2: None} and seen[0].count() == 1


# -- layout -----------------------------------------------------------------------------------------------------------

BLOCK = "doc_id long, page_no int, block_no int, x0 double, y0 double, x1 double, y1 double, text string"


def test_columns_and_half_even_rows(spark):
    # rows of 12 points, halves to even: 18 and 30 share row 2, so x decides
    rows = [(1, 1, 0, 300.0, 10.0, 400.0, 20.0, "right"), (1, 1, 1, 50.0, 18.0, 100.0, 20.0, "b"), (1, 1, 2, 20.0, 30.0, 60.0, 40.0, "a"), (1, 1, 3, 0.0, 0.0, 5.0, 5.0, " "), (1, 2, 0, 0.0, 0.0, 1.0, 1.0, "")]
    got = layout.column_order(spark.createDataFrame(rows, BLOCK)).orderBy("page_no", "place").collect()
    assert [r["text"] for r in got] == ["a", "b", "right", " "]


def test_touching_boxes_do_not_overlap(spark):
    b = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0, "touch"), (1, 1, 1, 0.0, 0.0, 10.1, 11.0, "in"), (1, 2, 0, 5.0, 5.0, 20.0, 20.0, "other page")], BLOCK)
    t = spark.createDataFrame([(1, 1, 9, 10.0, 5.0, 20.0, 20.0, "t")], BLOCK)
    assert sorted(r["text"] for r in layout.without_overlap(b, t).collect()) == ["other page", "touch"]


def test_image_regions_of_one_number_keep_their_order(spark):
    boxes = [(1, 9.0, 900.0, 99.0, 990.0), (5, 0.0, 0.0, 90.0, 80.0), (5, 0.0, 0.0, 80.0, 90.0), (5, 0.0, 0.0, 90.0, 90.0), (5, 50.0, 0.0, 99.0, 90.0), (5, 0.0, 50.0, 60.0, 99.0), (7, 0.0, 0.0, 50.0, 50.0)]
    rows = [(1, page, *box, "", 1, 100.0, 1000.0) for page in (1, 2) for box in boxes]
    none = spark.createDataFrame([], BLOCK)
    for given in (rows, rows[::-1], rows[1::2] + rows[::2]):
        blocks = spark.createDataFrame(given, f"{BLOCK}, block_type int, page_width double, page_height double").coalesce(1)
        got = layout.image_regions(blocks, none).orderBy("page_no", "order").collect()
        assert [(r["page_no"], r["order"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got] == [(page, i, *box[1:]) for page in (1, 2) for i, box in enumerate(boxes)]
        assert {r["strategy"] for r in got} == {"pdf_image_region"}


def merged_texts(spark, *nodes):
    schema = "doc_id long, page_no int, place long, node_type string, role string, x0 double, y0 double, x1 double, y1 double, text string"
    rows = [(1, 1, i, "paragraph", role, x0, y0, x1, y1, text) for i, (x0, y0, x1, y1, text, role) in enumerate(nodes)]
    return [(r["text"], r["y1"]) for r in layout.merged_paragraphs(spark.createDataFrame(rows, schema)).orderBy("place").collect()]


def test_paragraphs_flow_on(spark):
    a, b, c = (0.0, 100.0, 90.0, 110.0, "a line that ends in a hy-", "body"), (0.0, 112.0, 95.0, 122.0, "phen and goes on,", "body"), (2.0, 124.0, 60.0, 134.0, "up to the very end of it.", "body")
    assert merged_texts(spark, a, b, c) == [("a line that ends in a hyphen and goes on, up to the very end of it.", 134.0)]
    assert len(merged_texts(spark, (*a[:4], "it is complete!", "body"), b)) == 2
    assert len(merged_texts(spark, a, (*b[:4], "- an item of a list", "body"))) == 2
    assert len(merged_texts(spark, a, (*b[:4], "Heading", "body"))) == 2
    assert len(merged_texts(spark, a, (*b[:4], b[4], "footer_zone"))) == 2
    assert len(merged_texts(spark, a, (0.0, 129.0, 90.0, 139.0, b[4], "body"))) == 2
    assert len(merged_texts(spark, a, (19.0, 112.0, 139.0, 122.0, b[4], "body"))) == 2
    assert merged_texts(spark, (*a[:4], "这是一段没有结束的文字而且", "body"), (*b[:4], "继续下去直到这里为止的一段文字", "body"))[0][0] == "这是一段没有结束的文字而且继续下去直到这里为止的一段文字"


def test_repeated_margins_go(spark):
    rows = [(1, "Header", "header_zone"), (1, "Header", None), (1, "body twice", "body"), (1, "body twice", "body"), (1, "Page 3", "body"), (1, "第 2 页", None), (1, "3 / 9", None), (1, "x" * 101, None), (1, "x" * 101, None), (2, "Header", None)]
    got = layout.without_noise(spark.createDataFrame(rows, "doc_id long, text string, role string"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([(1, "body twice"), (1, "body twice"), (1, "x" * 101), (1, "x" * 101), (2, "Header")])


# -- rate limit -------------------------------------------------------------------------------------------------------


def fold(times, hits, seconds):
    log, out = [], []
    for t in sorted(times):
        log = [x for x in log if t - x <= seconds]
        out.append((t, len(log) < hits))
        if out[-1][1]:
            log.append(t)
    return out


def test_refused_hits_are_not_logged(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), r.randint(0, 2000)) for _ in range(300)] + [("edge", 0), ("edge", 0), ("edge", 60), ("edge", 61)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = rate_limit.limited(df, "k", "ts", RateLimit(2, 60)).collect()
    for key in ("a", "b", "edge"):
        assert sorted((x["micros"] // 1_000_000, x["allowed"]) for x in got if x["key"] == key) == sorted(fold([s for k, s in rows if k == key], 2, 60))


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts")).orderBy("ts")
    whole = events.collect()
    limit = RateLimit(2, 86_400)
    for k in range(2):  # two files, in the order of time
        part = whole[k * len(whole) // 2 : (k + 1) * len(whole) // 2]
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        target = tmp_path / "in"
        target.mkdir(exist_ok=True)
        for f in (tmp_path / f"in{k}").glob("part-*"):
            f.rename(target / f"{k}-{f.name}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = rate_limit.limited_stream(stream, "user_id", "ts", limit)
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((int(r["key"]), r["micros"], r["allowed"]) for r in spark.table("limited").collect())
    want = sorted((r["key"], r["micros"], r["allowed"]) for r in rate_limit.limited(events, "user_id", "ts", limit).collect())
    assert got == want
