"""Files to stored chunks, page assembly and model clients."""

import pytest
from pyspark.sql import functions as F

from tests.test_sources import docx, text_cell, xlsx
from textloom.operators import kernel
from textloom.plans import chunking, pages, service
from textloom.sources import providers
from textloom.sources.store import ChunkStore


def test_files_to_stored_chunks(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.md").write_text("# T\ntext of it\n- item")
    (folder / "b.docx").write_bytes(docx([("Top", "H1"), ("Body",)]))
    (folder / "c.xlsx").write_bytes(xlsx([("S", [[text_cell("A1", "x"), text_cell("B1", "y")]])]))
    (folder / "d.csv").write_text("no")
    (folder / "e.txt").write_text(" \n ")
    (folder / "f.pdf").write_bytes(b"%PDF")
    (folder / "g.doc").write_bytes(b"legacy")
    (folder / "h.docx").write_bytes(b"no zip")
    (folder / "i.png").write_bytes(b"picture")
    store = ChunkStore(spark, str(tmp_path / "store"))
    failed = {r["filename"]: (r["error"], r["status"]) for r in service.chunk_files(spark, str(folder), store).collect()}
    assert failed == {"d.csv": ("unsupported_file_type", 400), "e.txt": ("invalid_value", 400), "f.pdf": ("missing_reader", 500), "g.doc": ("missing_reader", 500), "h.docx": ("parse_error", 500), "i.png": ("ocr_required", 422)}
    got = {r["filename"]: r["total_chunks"] for r in store.documents().collect()}
    assert set(got) == {"a.md", "b.docx", "c.xlsx"} and all(got.values())
    texts = {r["full_text"] for r in store.chunks().collect()}
    assert {"Top\nBody", "S\nx | y"} <= texts


def _pages(content):
    """Page texts of a made-up PDF: pages part at form feeds; L makes a laid-out page, X fails."""
    if content == b"X":
        raise RuntimeError("broken")
    for number, page in enumerate(content.decode().split("\f"), 1):
        if page.startswith("L"):
            yield number, 0, 20.0, 200.0, 220.0, 210.0, page[1:], 600.0, 800.0, 0
            yield number, 1, 20.0, 300.0, 220.0, 310.0, "in the table", 600.0, 800.0, 0
            yield number, 0, 10.0, 295.0, 300.0, 350.0, "a | b", None, None, 2
        else:
            yield number, 0, None, None, None, None, page, None, None, 3


def _render(content):
    return ((k, f"page {k} of {content.decode()}".encode()) for k in range(1, 13))


def _model(image):
    if b"unreadable" in image:
        raise RuntimeError("no answer")
    text = "" if b"empty" in image else f"the model read {image.decode()}"
    return '{"nodes": [{"node_type": "paragraph", "text": "%s"}]}' % text


def test_pages_and_images_by_model(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    long = "a body of text that is long enough to need no model at all, on two lines."
    for name, content in {"long.pdf": long, "laid.pdf": "L" + long, "short.pdf": "short", "keeps.pdf": "empty", "none.pdf": " ", "broken.pdf": "X", "a.png": "pixels", "b.jpg": "unreadable", "c.txt": long}.items():
        (folder / name).write_text(content)
    store = ChunkStore(spark, str(tmp_path / "store"))
    readers = service.Readers(_pages, _render, _model)
    failed = {r["filename"]: (r["error"], r["status"]) for r in service.chunk_files(spark, str(folder), store, readers=readers).collect()}
    names = {r["document_id"]: r["filename"] for r in store.documents().collect()}
    texts = {}
    for r in store.chunks().orderBy("document_id", "chunk_index").collect():
        texts.setdefault(names[r["document_id"]], []).append(r["full_text"])
    assert texts["long.pdf"] == [long] and texts["c.txt"] == [long] and texts["keeps.pdf"] == ["empty"]
    assert "\n".join(texts["laid.pdf"]) == f"{long}\na | b"
    assert texts["a.png"] == ["the model read pixels"]
    assert "\n".join(texts["short.pdf"]).split("\n") == [f"the model read page {k} of short" for k in range(1, 11)]
    # the broken file has no nodes, so the model is asked for it too
    assert texts.get("broken.pdf") and failed == {"b.jpg": ("parse_error", 500)} and "none.pdf" in texts
    without = {r["filename"]: r["error"] for r in service.chunk_files(spark, str(folder), ChunkStore(spark, str(tmp_path / "other")), readers=service.Readers(_pages)).collect()}
    assert without == {"none.pdf": "ocr_required", "broken.pdf": "parse_error", "a.png": "ocr_required", "b.jpg": "ocr_required"}


class _Answer:
    def __init__(self, kind, body):
        self.headers, self.body = {"Content-Type": kind}, [body]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self, _):
        return self.body.pop() if self.body else b""


def _open(url, seconds):
    return _Answer("text/html" if "html" in url else "text/plain; charset=utf-8", b"the fetched text" if "big" not in url else b"x" * (2 << 20))


def test_urls_to_stored_chunks(spark, tmp_path):
    urls = [("https://a.org/x", "x.txt"), ("https://a.org/html", "y.txt"), ("ftp://a.org/z", "z.txt"), ("https://inside.org/x", "w.txt"), ("https://a.org/x", "v.exe"), ("http://127.0.0.1/x", "u.txt"), ("https://a.org/big", "t.txt")]
    resolve = lambda host: {"10.0.0.1"} if host == "inside.org" else {"93.184.216.34"}
    store = ChunkStore(spark, str(tmp_path / "store"))
    from textloom.options import IngestOptions

    failed = service.chunk_urls(spark.createDataFrame(urls, "document_url string, filename string"), store, ingest_options=IngestOptions(max_upload_mb=1), resolve=resolve, opener=_open)
    assert {r["filename"]: r["error"] for r in failed.collect()} == {"y.txt": "download_error", "z.txt": "download_error", "w.txt": "download_error", "v.exe": "unsupported_file_type", "u.txt": "download_error", "t.txt": "file_too_large"}
    assert [(r["filename"], r["total_chunks"]) for r in store.documents().collect()] == [("x.txt", 1)]


def test_saving_again_replaces(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.md").write_text("# One\ntext\n# Two\ntext")
    (tmp_path / "f" / "b.md").write_text("stays")
    service.chunk_files(spark, str(tmp_path / "f"), store)
    before = {r["chunk_id"] for r in store.chunks().collect()}
    (tmp_path / "f" / "a.md").write_text("# One\nother text")
    service.chunk_files(spark, str(tmp_path / "f"), store)
    after = {r["chunk_id"]: r["full_text"] for r in store.chunks().collect()}
    assert len(before) == 3 and len(after) == 2 and set(after) <= before and "One\nother text" in after.values()
    assert {r["filename"]: r["total_chunks"] for r in store.documents().collect()} == {"a.md": 1, "b.md": 1}
    key = store.documents().where("filename = 'a.md'").first()["document_id"]
    page = store.page(key, 1, 5).collect()
    assert [(r["filename"], r["status"], r["total_chunks"], r["chunk_index"]) for r in page] == [("a.md", "completed", 1, 1)]
    assert store.page(key, 2, 5).count() == 0 and store.page("none") is None
    assert {(r["filename"], r["chunk_index"]) for r in store.pages(2, 1).collect()} == {("a.md", None), ("b.md", None)}


BLOCK = "doc_id long, page_no int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double"


def test_page_assembly(spark):
    def block(page, no, x0, y0, text, width=200.0):
        return (1, page, no, x0, y0, x0 + width, y0 + 10, text, 600.0, 800.0)

    rows = []
    for page in (1, 2):
        rows += [block(page, 0, 20.0, 10.0, "Annual report"), block(page, 9, 20.0, 780.0, f"Page {page}")]
    rows += [block(1, 1, 20.0, 200.0, "a paragraph that begins here and"), block(1, 2, 20.0, 212.0, "goes on in the next line."), block(1, 3, 320.0, 200.0, "the other column stands for itself!"), block(1, 4, 20.0, 400.0, "inside the table")]
    blocks = spark.createDataFrame(rows, BLOCK)
    tables = spark.createDataFrame([(1, 1, 10.0, 395.0, 300.0, 450.0, "h | k\n1 | 2")], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = pages.page_nodes(blocks, tables).orderBy("node_pos").collect()
    assert [(r["node_type"], r["text"]) for r in got] == [("paragraph", "a paragraph that begins here and goes on in the next line."), ("paragraph", "the other column stands for itself!"), ("table", "h | k\n1 | 2")]
    chunk = chunking.chunk_nodes(pages.page_nodes(blocks, tables)).collect()
    assert all(c["page_no"] == [1] for c in chunk)


def test_plain_pages(spark):
    rows = [(1, p, f"Running head\n\nbody of page number {p} of this\n\nPage {p}") for p in (1, 2)]
    got = pages.plain_page_nodes(spark.createDataFrame(rows, "doc_id long, page_no int, text string")).orderBy("node_pos").collect()
    assert [(r["text"], r["source_page"]) for r in got] == [("body of page number 1 of this", 1), ("body of page number 2 of this", 2)]


def test_token_service(spark):
    calls = []

    def post(url, payload, headers, seconds):
        calls.append(payload["input"])
        return {"bad": {}, "two": {"count": 2}}.get(payload["input"], {"token_count": 7})

    count = providers.HttpTokenCounter("u", post=post)
    assert [count(" one "), count("one"), count("two"), count("  ")] == [7, 7, 2, 0] and calls == ["one", "two"]
    with pytest.raises(ValueError):
        count("bad")
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "k int, t string")
    got = {r["k"]: r["tokens"] for r in providers.counted_tokens(df, "t", kernel.estimate).collect()}
    assert got == {1: 1, 2: None, 3: 1}


def test_scores_and_decisions():
    models = providers.Models(text="t", embedding_url="u", embedding="e", embedding_key="k")
    seen = {}

    def post(url, payload, headers, seconds):
        seen.update(headers)
        return {"data": [{"embedding": [1.0, 0.0]}, {"embedding": [1.0, 1.0]}]}

    assert providers.EmbeddingScorer(models, post=post)("a", "b") == pytest.approx(0.5**0.5) and seen["Authorization"] == "Bearer k"
    for bad in (([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0])):
        with pytest.raises(ValueError):
            providers.cosine(*bad)
    with pytest.raises(RuntimeError):
        providers.EmbeddingScorer(providers.Models())("a", "b")

    def chat(answer):
        return providers.ChatModel("u", post=lambda *_: {"choices": [{"message": {"content": answer}}]})

    assert providers.ModelDecider(chat('{"decision": "merge"}'), models)("a", "b")
    assert not providers.ModelDecider(chat("broken"), models)("a", "b") and not providers.ModelDecider(None)("a", "b")
    assert providers.Models(text="t", flash="f").decider == "f" and models.decider == "t"
    assert providers.prompt("vision", "scan") and chat("x").vision("m", "q", "data:") == "x"
    with pytest.raises(KeyError):
        providers.prompt("none", "such")
    with pytest.raises(ValueError):
        providers.prompt("vision")


def test_deciding_without_scores():
    block = lambda kind, text: [kernel.Node(kind, text, path=("p",))]
    blocks = [block("paragraph", "a"), block("list", "b"), block("table", "c"), block("paragraph", "d")]
    assert [len(b) for b in kernel.decided_by_model(blocks, lambda a, b: True)] == [2, 1, 1]

    def broken(a, b):
        raise RuntimeError

    assert kernel.decided_by_model(blocks, broken) == blocks
