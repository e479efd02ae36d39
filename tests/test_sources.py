"""Files, formats, stores and admission."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import lines, segment
from textloom.options import ChunkOptions, IngestOptions
from textloom.plans import chunking
from textloom.sources import ingest, office, store, vision


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def docx(paragraphs, tables=(), styles={"H1": "Heading 1", "H3": "heading 3"}):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s=None: f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(p(*x) for x in paragraphs) + "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in t) + "</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>" + "".join(f'<w:style w:styleId="{k}"><w:name w:val="{v}"/></w:style>' for k, v in styles.items()) + "</w:styles>")
    return out.getvalue()


def xlsx(sheets):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} xmlns:r="{r}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>shared</t></si></sst>")
        for i, (_, rows) in enumerate(sheets):
            cells = "".join("<row>" + "".join(c for c in row) + "</row>" for row in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {s}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def text_cell(ref, t):
    return f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'


def test_docx(spark):
    content = docx([("Top", "H1"), ("  ",), ("Some text",), ("- item one",), ("Deep", "H3")], [[["a", "b"], [" ", ""], ["c", ""]]])
    rows = office.parsed(spark.createDataFrame([(1, bytearray(content))], "doc_id long, content binary"), office.docx_nodes).orderBy("node_pos").collect()
    assert [(r["node_type"], r["level"], r["text"]) for r in rows] == [("title", 1, "Top"), ("paragraph", 0, "Some text"), ("list", 0, "- item one"), ("title", 3, "Deep"), ("table", 0, "a | b\nc |")]
    got = chunking.chunk_nodes(office.parsed(spark.createDataFrame([(1, bytearray(content))], "doc_id long, content binary"), office.docx_nodes)).orderBy("chunk_index").collect()
    assert got[-1]["section_path"] == ["Top", "Deep"] and got[-1]["chunk_type"] == "table"


def test_xlsx_sheets():
    content = xlsx([("One", [[text_cell("A1", " name "), '<c r="C1"><v>3</v></c>'], [], ['<c r="A3" t="s"><v>0</v></c>', '<c r="B3"><v>2.50</v></c>', '<c r="C3" t="b"><v>1</v></c>']]), ("Two", [])])
    assert list(office.xlsx_nodes(content)) == [("title", 1, "One", "One", "xlsx_sheet"), ("table", 0, "name |  | 3\nshared | 2.5 | True", "One", "xlsx_sheet"), ("title", 1, "Two", "Two", "xlsx_sheet")]


def test_missing_readers_say_so():
    for reader in (office.xls_nodes, office.doc_text, lambda c: list(office.pdf_blocks(c)), lambda c: list(office.pdf_page_texts(c))):
        with pytest.raises(office.MissingReader):
            reader(b"x")


def test_legacy_cells(spark):
    df = spark.createDataFrame([("1.0", " x.0 ", None), (None, " ", "")], "a string, b string, c string")
    row = office.rendered_row([F.col(c) for c in "abc"], legacy=True)
    assert [r[0] for r in df.select(row).collect()] == ["1 | x | ", None]


def test_office_lines(spark):
    text = "Intro\nfirst line of a paragraph, with a mark\nsecond line, of it\n• item\n（1） more\n\n第一章 总则\nlong line without a mark but above the limit"
    n = lines.office_nodes(lines.line_rows(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("node_pos").collect()
    assert [(r["node_type"], r["text"]) for r in n] == [("title", "Intro"), ("paragraph", "first line of a paragraph, with a mark second line, of it"), ("list", "• item\n（1） more"), ("title", "第一章 总则"), ("paragraph", "long line without a mark but above the limit")]


def test_page_headings(spark):
    cases = {"1.2 Scope of it": "title", "Short": "title", "a@b": "paragraph", "1999.12": "paragraph", "one two three four five": "paragraph", "Ends here!": "paragraph", "| a |": "table", "• x": "list", "two\nlines": "paragraph", "thirteen chars": "paragraph"}
    assert dict(zip(cases, column(spark, list(cases), lines.page_node_type))) == cases


def test_suffixes_and_routes(spark):
    names = ["a.PDF", "dir.txt/a", "a.tar.md", ".md", "x.csv", "y.tiff", None]
    assert column(spark, names, ingest.suffix) == [".pdf", "", ".md", "", ".csv", ".tiff", None]
    assert column(spark, names[:2] + names[4:6], ingest.parser_route) == ["pdf", "unsupported", "unsupported", "vision"]


def test_sizes_and_status(spark):
    limit = 20 << 20
    df = spark.createDataFrame([("a.txt", limit), ("a.txt", limit + 1), ("a.csv", limit + 1)], "f string, n long").orderBy("n", "f")
    error = ingest.rejection(F.col("f"), F.col("n"))
    assert sorted((str(r[0]), r[1]) for r in df.select(error, ingest.status_code(error)).collect()) == [("None", 200), ("file_too_large", 413), ("unsupported_file_type", 400)]
    assert column(spark, ["other", "ocr_required"], ingest.status_code) == [500, 422]


def test_hosts(spark):
    urls = ["http://example.com/a", "https://x.Example.com", "http://badexample.com", "http://example.com.evil.org", "ftp://example.com/", "no url", "http:///x"]
    assert column(spark, urls, lambda u: ingest.url_error(u, "example.com, ")) == [None, None, "not_allowed", "not_allowed", "scheme", "scheme", "host"]
    assert column(spark, urls[:1], lambda u: ingest.host_allowed(u, " , ")) == [True]


def test_content_types(spark):
    rows = [("a.txt", "Text/Plain; charset=x", True), ("a.txt", "application/pdf", False), ("a.png", "image/x", True), ("a.png", "text/plain", False), ("a.zip", "any", True), ("a.txt", None, False), ("a.txt", "", False), ("a.md", "text/markdown", True)]
    df = spark.createDataFrame(rows, "f string, c string, want boolean")
    assert df.where(ingest.content_type_ok(F.col("f"), F.col("c")) != F.col("want")).count() == 0


class Answer(io.BytesIO):
    def __init__(self, content, **headers):
        super().__init__(content)
        self.headers = {k.replace("_", "-"): v for k, v in headers.items()}


def fetch(url="http://h.org/a", content=b"abc", addresses=("93.184.216.34",), options=IngestOptions(max_upload_mb=1), **headers):
    return ingest.guarded_fetch(url, lambda c: c != "bad", options, lambda h: set(addresses), lambda u, s: Answer(content, **headers))


def test_guarded_fetch():
    assert fetch() == b"abc" and fetch(content=b"x" * (2 << 20)) == b"x" * (2 << 20)
    for bad in (dict(url="file:///etc"), dict(url="http://"), dict(addresses=("10.0.0.1",)), dict(addresses=("127.0.0.1", "93.184.216.34")), dict(addresses=("::1",)), dict(Content_Type="bad"), dict(Content_Length=str(3 << 20)), dict(content=b"x" * ((2 << 20) + 1)), dict(options=IngestOptions(allowed_hosts="other.org"))):
        with pytest.raises(ingest.DownloadError):
            fetch(**bad)


def test_binary_files_and_decoding(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# T\xff\nb\xc3\xa4h \xe2\x82")
    (tmp_path / "b.csv").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"\xef\xbb\xbf# not a title\r\nnext\rlast")
    got = {r["filename"]: r["text"] for r in ingest.text_documents(ingest.binary_files(spark, str(tmp_path))).collect()}
    assert got == {"a.md": "# T\nbäh ", "c.txt": "﻿# not a title\r\nnext\rlast"}
    classes = lines.line_rows(spark.createDataFrame([(1, got["c.txt"])], "doc_id long, text string")).orderBy("line_no").collect()
    assert [(r["raw"], r["class"]) for r in classes] == [("﻿# not a title", "paragraph"), ("next", "paragraph"), ("last", "paragraph")]


def test_ocr_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf"), (3, "c.txt"), (4, "d.png")], "doc_id long, filename string")
    nodes = spark.createDataFrame([(1, "x" * 40), (2, "x" * 39)], "doc_id long, text string")
    wanted = ingest.needs_ocr(docs, nodes)
    assert {r["doc_id"]: r["needs_ocr"] for r in wanted.collect()} == {1: False, 2: True, 3: True, 4: True}
    ocr = spark.createDataFrame([(1, "no"), (4, "yes")], "doc_id long, text string")
    assert sorted(r["text"] for r in ingest.with_ocr_fallback(nodes, ocr, wanted).collect()) == ["x" * 39, "x" * 40, "yes"]
    assert {r["doc_id"]: r["error"] for r in ingest.empty_documents(docs, nodes).collect()} == {3: "invalid_value", 4: "ocr_required"}


def test_vision_answers(spark):
    good = 'x ```json\n{"nodes": [{"node_type": "figure", "text": " a "}, {"text": ""}, {"node_type": "title", "text": "t", "level": -2, "bbox": [1, 2, 3, 4], "order": 7}]}\n```'
    df = spark.createDataFrame([(1, good, 3), (2, "nothing here", 1), (3, ' {"nodes": []} ', 1)], "k int, answer string, page_no int")
    got = vision.answered_nodes(df, ["k"], page="page_no").orderBy("node_pos").collect()
    assert [(r["node_type"], r["level"], r["text"], r["bbox"], r["order"], r["page_layout"]) for r in got] == [("paragraph", 0, "a", None, None, "page_3"), ("title", 0, "t", [1.0, 2.0, 3.0, 4.0], 7, "page_3")]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        vision.answered_nodes(spark.createDataFrame([(1, "{broken}")], "k int, answer string"), ["k"]).collect()
    regions = spark.createDataFrame([(1, [9.0], "image", 5)], "k int, bbox array<double>, layout_role string, `order` int")
    assert sorted(r["order"] for r in vision.with_defaults(vision.answered_nodes(df, ["k"]), regions, ["k"]).collect()) == [5, 7]


def test_models_that_fail_leave_an_error(spark):
    def model(content):
        if content == b"bad":
            raise ValueError("no answer")
        return '{"nodes": [{"text": "seen"}]}'

    images = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad"))], "k int, content binary")
    got = {r["k"]: (r["answer"], r["error"]) for r in vision.ask(images, model, ["k"]).collect()}
    assert got[2] == (None, "no answer") and got[1][1] is None


def test_store(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "store"))
    assert s.documents().count() == 0 and s.page("none") is None
    docs = spark.createDataFrame([(str(i), f"{'word ' * 500}\n\n- a\n\n# T{i}\ntext") for i in range(3)], "doc_id string, text string")
    chunks = chunking.chunk_texts(docs, options=ChunkOptions(max_tokens=60)).withColumnRenamed("doc_id", "document_id")
    s.save(chunks, docs.select(F.col("doc_id").alias("document_id"), F.lit("a.md").alias("filename")))
    s.save(chunks.limit(0), spark.createDataFrame([("empty", "b.md")], "document_id string, filename string"))
    one = s.document("1").collect()[0]
    assert one["status"] == "completed" and one["total_chunks"] == s.chunks().where("document_id = '1'").count() > 5
    assert s.document("empty").collect()[0]["total_chunks"] == 0
    page = s.page("1", 2, 3).collect()
    assert [r["chunk_index"] for r in page] == [4, 5, 6] and "full_text" not in page[0].asDict()
    assert s.page("1", 99).collect() == []
    detail = s.chunk(page[0]["chunk_id"]).collect()
    assert len(detail) == 1 and detail[0]["full_text"].startswith(detail[0]["preview_text"][:100].rstrip("."))
    for bad in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            store.page_bounds(*bad)
    s.clear()
    assert s.documents().count() == 0


def test_page_parts_and_lists(spark):
    pages = spark.createDataFrame([(1, 1, "a\n\n\nb\n \n c ")], "doc_id long, page_no int, text string")
    assert [r["text"] for r in office.page_parts(pages).orderBy("part_no").collect()] == ["a", "b\n \n c"]
    df = spark.createDataFrame([(2,), (None,), (1,), (2,)], "p int")
    assert df.agg(segment.page_list(F.col("p"))).first()[0] == [1, 2]
