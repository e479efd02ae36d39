"""Office and page formats to nodes. DOCX and XLSX are read with the standard library; others need what is not always there.

Each reader is an Arrow pass over (doc_id, content): one file in, its nodes out, no exchange.
"""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import strip
from ..operators import kernel

NODES = "doc_id {kind}, node_pos int, node_type string, level int, text string, sheet_name string, parser_strategy string"
CELL_JOINER = " | "
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_LIST = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")

RawNode = tuple[str, int, str, str | None, str]


class MissingReader(RuntimeError):
    """The format needs a program or library that is not installed."""


def row_text(cells: list[str]) -> str | None:
    """The cells joined, or None for a row of blank ones."""
    cells = [c.strip() for c in cells]
    return CELL_JOINER.join(cells) if any(cells) else None


def _paragraph(p: ElementTree.Element) -> str:
    marks = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
    return "".join(marks[e.tag](e) for e in p.iter() if e.tag in marks)


def docx_nodes(content: bytes) -> Iterator[RawNode]:
    """Paragraphs first, titles by their style's name, then all tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    for p in body.findall(f"{_W}p"):
        text = _paragraph(p).strip()
        if not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val")).lower() if style is not None else ""
        if name.startswith("heading"):
            digits = "".join(c for c in name if c.isdigit())
            yield "title", int(digits) if digits else 1, text, None, "docx_heading"
        else:
            yield "list" if _LIST.match(text) else "paragraph", 0, text, None, "docx_paragraph"
    for t in body.findall(f"{_W}tbl"):
        rows = [row_text(["\n".join(_paragraph(p) for p in c.findall(f"{_W}p")) for c in r.findall(f"{_W}tc")]) for r in t.findall(f"{_W}tr")]
        text = "\n".join(r for r in rows if r).strip()
        if text:
            yield "table", 0, text, None, "docx_table"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_nodes(sheets: Iterator[tuple[str, list[list[str]]]], strategy: str) -> Iterator[RawNode]:
    """A title and, where it has rows, a table for every sheet."""
    for name, rows in sheets:
        yield "title", 1, name, name, strategy
        text = "\n".join(t for t in map(row_text, rows) if t)
        if text:
            yield "table", 0, text, name, strategy


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    kind, v = c.get("t"), c.find(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return str(v.text == "1")
    if kind in ("str", "e"):
        return v.text
    number = float(v.text)
    return str(int(number)) if re.fullmatch(r"-?\d+", v.text) else str(number)


def xlsx_nodes(content: bytes) -> Iterator[RawNode]:
    def sheets() -> Iterator[tuple[str, list[list[str]]]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
                target = targets[sheet.get(f"{_R}id")]
                rows = []
                for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_S}row"):
                    cells: list[str] = []
                    for c in row.findall(f"{_S}c"):
                        place = _column(c.get("r", "")) if c.get("r") else len(cells)
                        cells += [""] * (place + 1 - len(cells))
                        cells[place] = _cell(c, shared)
                    rows.append(cells)
                yield sheet.get("name"), rows

    return sheet_nodes(sheets(), "xlsx_sheet")


def xls_nodes(content: bytes) -> Iterator[RawNode]:
    """Legacy sheets: a trailing .0 goes from every cell, texts included. Needs xlrd."""
    try:
        import xlrd
    except ImportError as error:
        raise MissingReader("legacy sheets need xlrd") from error
    book = xlrd.open_workbook(file_contents=content)
    tidy = lambda v: re.sub(r"\.0$", "", str(v).strip())
    return sheet_nodes(((s.name, [[tidy(v) for v in s.row_values(r)] for r in range(s.nrows)]) for s in book.sheets()), "xls_sheet")


def doc_text(content: bytes) -> str:
    """The text of a legacy Word file, by antiword; see ``lines.office_nodes`` for its nodes."""
    program = shutil.which("antiword")
    if not program:
        raise MissingReader("legacy Word files need antiword")
    with tempfile.NamedTemporaryFile(suffix=".doc") as f:
        f.write(content)
        f.flush()
        done = subprocess.run([program, f.name], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"antiword failed: {done.stderr.decode('utf-8', 'ignore').strip() or 'unknown error'}")
    return done.stdout.decode("utf-8", "ignore")


def pdf_blocks(content: bytes) -> Iterator[tuple]:
    """(page_no, block_no, x0, y0, x1, y1, text, page_width, page_height, block_type) of every block. Needs PyMuPDF."""
    try:
        import fitz
    except ImportError as error:
        raise MissingReader("page layout needs PyMuPDF") from error
    with fitz.open(stream=content, filetype="pdf") as file:
        for number, page in enumerate(file, 1):
            for k, (x0, y0, x1, y1, text, *_, kind) in enumerate(page.get_text("blocks")):
                yield number, k, x0, y0, x1, y1, text, page.rect.width, page.rect.height, kind


def pdf_page_texts(content: bytes) -> Iterator[tuple[int, str]]:
    """(page_no, text), the fallback without layout; parts are cut at blank lines. Needs pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise MissingReader("page texts need pypdf") from error
    for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        yield number, page.extract_text() or ""


def pdf_tables(content: bytes) -> Iterator[tuple]:
    """(page_no, x0, y0, x1, y1, text) of the tables that the layout library finds; a page it fails on has none. Needs PyMuPDF."""
    try:
        import fitz
    except ImportError as error:
        raise MissingReader("page layout needs PyMuPDF") from error
    with fitz.open(stream=content, filetype="pdf") as file:
        for number, page in enumerate(file, 1):
            try:
                found = [(t.bbox, t.extract() or []) for t in page.find_tables().tables]
            except Exception:  # as a page without tables
                continue
            for box, rows in found:
                text = "\n".join(t for t in (row_text(["" if c is None else str(c) for c in row]) for row in rows) if t)
                if text:
                    yield (number, *box, text)


def pdf_images(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(page_no, PNG) of every page at twice its size, for a vision model. Needs PyMuPDF."""
    try:
        import fitz
    except ImportError as error:
        raise MissingReader("rendering pages needs PyMuPDF") from error
    with fitz.open(stream=content, filetype="pdf") as file:
        for number, page in enumerate(file, 1):
            yield number, page.get_pixmap(matrix=fitz.Matrix(2, 2)).tobytes("png")


#: What a block of a page is: text, an image, a table, or a page's whole text where there is no layout.
TEXT, IMAGE, TABLE, PLAIN = 0, 1, 2, 3


def pdf_pages(content: bytes) -> Iterator[tuple]:
    """Blocks and tables where there is a layout library, else whole page texts: (page_no, block_no, x0, y0, x1, y1, text, page_width,
    page_height, block_type)."""
    try:
        blocks = list(pdf_blocks(content))
        none = (None, None)
        yield from blocks
        yield from ((number, k, *box, text, *none, TABLE) for k, (number, *box, text) in enumerate(pdf_tables(content)))
    except MissingReader:
        yield from ((number, 0, None, None, None, None, text, None, None, PLAIN) for number, text in pdf_page_texts(content))


def text_nodes(content: bytes) -> Iterator[RawNode]:
    """Text and markdown files; malformed bytes are dropped, and U+FFFD with them."""
    text = content.decode("utf-8", "replace").replace("\ufffd", "")
    return ((n.kind, n.level, n.text, None, "text_lines") for n in kernel.markdown_nodes(text))


def doc_lines(content: bytes) -> Iterator[RawNode]:
    """The text of a legacy Word file as one node, for ``lines.office_nodes``."""
    yield OFFICE_TEXT, 0, doc_text(content), None, "antiword"


OFFICE_TEXT = "office_text"
READERS = {"text": text_nodes, "docx": docx_nodes, "xlsx": xlsx_nodes, "xls": xls_nodes, "doc": doc_lines}


def error_kind(error: Exception) -> str:
    return "missing_reader" if isinstance(error, MissingReader) else "parse_error"


def _arrow_rows(ids: pa.Array, place: int, rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([ids.take(pa.array([place] * len(rows), pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])


def read_rows(files: DataFrame, read: Callable[[str, bytes], Iterator[tuple]], fields: str) -> DataFrame:
    """One Arrow pass over (doc_id, parser, content): the rows that ``read`` gives for each file, or one row with its error."""
    kind, n = files.schema["doc_id"].dataType.simpleString(), fields.count(",") + 1
    schema = files.sparkSession.createDataFrame([], f"{fields}, error string").schema
    names, types = schema.names, to_arrow_schema(schema).types

    def run(batches):
        for batch in batches:
            for i, (parser, content) in enumerate(zip(batch.column("parser").to_pylist(), batch.column("content").to_pylist())):
                try:
                    rows = [(*row, None) for row in read(parser, content or b"")]
                except Exception as error:  # reported in the file's row
                    rows = [(*[None] * n, error_kind(error))]
                yield _arrow_rows(batch.column("doc_id"), i, rows, names, types)

    return files.select("doc_id", "parser", "content").mapInArrow(run, f"doc_id {kind}, {fields}, error string")


def parsed(files: DataFrame, reader: Callable[[bytes], Iterator[RawNode]]) -> DataFrame:
    """The nodes of (doc_id, content), by one of the readers above; what a reader raises is raised."""
    kind = files.schema["doc_id"].dataType
    names = ["node_pos", "node_type", "level", "text", "sheet_name", "parser_strategy"]
    types = [pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 3]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [(k, *node) for k, node in enumerate(reader(batch.column("content")[i].as_py() or b""))]
                yield _arrow_rows(batch.column("doc_id"), i, rows, names, types)

    return files.select("doc_id", "content").mapInArrow(run, NODES.format(kind=kind.simpleString()))


def rendered_row(cells: list[Column], legacy: bool = False) -> Column:
    """A table's row as sheet text, null where all cells are blank; legacy sheets lose a trailing .0."""
    texts = [strip(F.coalesce(c.cast("string"), F.lit(""))) for c in cells]
    if legacy:
        texts = [F.regexp_replace(t, r"\.0$", "") for t in texts]
    full = F.lit(False)
    for t in texts:
        full = full | (t != "")
    return F.when(full, F.concat_ws(CELL_JOINER, *texts))


def page_parts(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, part_no, text of page texts cut at blank lines (the fallback without layout)."""
    parts = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n{2,}")).alias("part_no", "text"))
    return parts.withColumn("text", strip(F.col("text"))).where("text <> ''")
