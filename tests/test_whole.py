"""The queries named _whole read every character of the documents."""

import pytest

from textloom.plans import chunking, registry

LONG = "one line without an end, " * 1000
TEXTS = [LONG, "short", "", "  \n ", "a first line of more than twenty-four characters\nsecond\n" + "x" * 61, None]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    rows = [(i, t, len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_marking_keeps_every_line(spark, small):
    got = {r["doc_id"]: r["text"] for r in registry.whole_docs(spark, small).collect()}
    for i, text in enumerate(TEXTS):
        rest = iter((got[i] or "").split("\n"))
        assert text is None or all(any(have in (line, f"- {line}") for have in rest) for line in text.split("\n"))


def test_a_long_line_reaches_the_splitter(spark, small):
    chunks = chunking.chunk_texts(registry.whole_docs(spark, small)).where("doc_id = 0").orderBy("chunk_index").collect()
    letters = "".join(c for r in chunks for c in r["full_text"] if c.isalpha())
    assert len(chunks) > 1 and letters == "".join(c for c in LONG[:24] + LONG if c.isalpha())
    assert registry.queries()["chunk_documents_whole"](spark, small).where("doc_id = 0").count() == len(chunks)


def test_ocr_and_empty_documents_see_all_nodes(spark, small):
    ocr = {r["doc_id"]: (r["n_chars"], r["needs_ocr"]) for r in registry.queries()["ocr_fallback_whole"](spark, small).collect()}
    # short lines of one kind are one node, and what surrounds a node is stripped
    assert ocr == {i: (len((t or "").strip()), len((t or "").strip()) < 40) for i, t in enumerate(TEXTS)}
    empty = {r["doc_id"]: r["error"] for r in registry.queries()["empty_documents_whole"](spark, small).collect()}
    assert empty == {2: "invalid_value", 3: "invalid_value", 5: "invalid_value"}
