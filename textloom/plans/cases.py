"""More registered queries: operators on cases that arithmetic makes from whole tables, with the same in SQL in ``oracle_cases``."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import boundary, layout, lines, segment, split
from ..options import BoundaryOptions, ChunkOptions, RateLimit
from ..sources import ingest, office, providers, store, vision
from ..streaming import rate_limit
from . import chunking, pages
from .registry import long, marked_docs, page_blocks, query, stored_chunks, table


def normal_docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.normal_text(F.col("text")).alias("text"))


# -- text and lines ---------------------------------------------------------------------------------------------------


@query
def decode_malformed(spark, folder):
    """Bytes that are no UTF-8 after each text, and a genuine U+FFFD: all go."""
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("z"), "UTF-8"), F.unhex(F.lit("C3")), F.encode(F.lit("y�"), "UTF-8"), F.unhex(F.lit("E282")))
    t = tx.decoded(broken)
    return table(spark, folder, "documents").select("doc_id", long(F.length(t)).alias("n_chars"), F.md5(t).alias("text_hash"))


@query
def node_offsets(spark, folder):
    """Where the nodes of marked documents begin and end in their text."""
    got = chunking.located_nodes(marked_docs(spark, folder))
    return got.select("doc_id", long("node_pos").alias("node_pos"), "node_type", long("start").alias("start"), long("end").alias("end"), F.md5("text").alias("text_hash"))


# -- splitting --------------------------------------------------------------------------------------------------------


@query
def hard_split_text(spark, folder):
    """Hard windows over whole texts, stripped and located."""
    s = split.split_spans(normal_docs(spark, folder), "text", stage="windows").select("doc_id", F.posexplode("spans").alias("window", "s"))
    return s.select("doc_id", long("window").alias("window"), long("s.start").alias("start"), long("s.end").alias("end"), F.md5("s.text").alias("text_hash"))


@query
def overlap_ratio(spark, folder):
    """Spans drawn back by a tenth of the one before, placed from where their node begins."""
    rows = normal_docs(spark, folder).withColumn("base", F.col("doc_id") % 7 * 1000)
    s = split.split_spans(rows, "text", ChunkOptions(max_tokens=60, overlap_ratio=0.1), base="base").select("doc_id", F.posexplode("spans").alias("span", "s"))
    return s.select("doc_id", long("span").alias("span"), long("s.start").alias("start"), long("s.end").alias("end"), F.md5("s.text").alias("text_hash"))


# -- boundaries -------------------------------------------------------------------------------------------------------


def _line_score(left: str, right: str) -> float:
    if (len(left) + len(right)) % 17 == 0:
        raise ValueError("no score")
    return (7 * len(left) + 3 * len(right)) % 101 / 100


def _line_word(left: str, right: str) -> bool:
    if len(left) % 13 == 0:
        raise RuntimeError("no answer")
    return len(right) % 2 == 0


@query
def boundary_fold(spark, folder):
    """Lines as blocks, joined from the left by scores and words that follow the lengths of what has been joined."""
    rows = lines.line_rows(table(spark, folder, "documents")).where("raw <> ''")
    kind = F.when(F.col("line_no") % 9 == 0, "title").when(F.col("line_no") % 13 == 5, "table").otherwise("paragraph")
    blocks = rows.select("doc_id", F.col("line_no").alias("block_id"), kind.alias("node_type"), F.col("raw").alias("text"), F.floor(F.col("line_no") / 6).cast("string").alias("path"))
    return boundary.fold(blocks, bounds=BoundaryOptions(high=0.6, low=0.3, llm=True), scorer=_line_score, decider=_line_word)


def _embedding_post(url: str, payload: dict, headers: dict, seconds: float) -> dict:
    if any(len(t) % 19 == 0 for t in payload["input"]):
        raise RuntimeError("no embedding")
    return {"data": [{"embedding": [float(len(t) % 7 + 1), float(len(t) % 5 + 1)]} for t in payload["input"]]}


def _chat_post(url: str, payload: dict, headers: dict, seconds: float) -> dict:
    asked = json.loads(payload["messages"][1]["content"])
    word = "merge" if len(asked["left"]) % 2 else "keep"
    return {"choices": [{"message": {"content": "?" if len(asked["right"]) % 11 == 0 else json.dumps({"decision": word})}}]}


@query
def model_decisions(spark, folder):
    """Turns of a conversation as neighbours: an embedding service scores them, a chat service decides, either may fail."""
    models = providers.Models(text="t", embedding_url="http://embeddings", embedding="e")
    scorer = providers.EmbeddingScorer(models, post=_embedding_post)
    decider = providers.ModelDecider(providers.ChatModel("http://chat", post=_chat_post), models)
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_id"), "text")
    pairs = boundary.neighbours(turns, ["text"])
    asked = boundary.decide_with_model(pairs, F.col("block_id") % 4 > 0, lambda rows: providers.judged(rows, "prev_text", "text", scorer, decider), ["doc_id", "block_id"])
    d = boundary.decision(F.col("block_id") % 4 > 0, F.col("score"), F.col("says_merge"), BoundaryOptions(high=0.99, low=0.8, llm=True))
    return asked.select("doc_id", long("block_id").alias("block_id"), d.alias("d")).select("doc_id", "block_id", "d.merge", "d.strategy", "d.similarity_score")


def _words(text: str) -> int:
    return len(text.split())


@query
def counted_tokens(spark, folder):
    """A token service's counts, asked once for each distinct text."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.substring("text", 1, 40).alias("text"))
    counter = providers.HttpTokenCounter("http://tokens", post=_token_post)
    got = providers.counted_tokens(rows, "text", counter)
    return got.select("conv_id", long("turn").alias("turn"), long("tokens").alias("tokens"))


def _token_post(url: str, payload: dict, headers: dict, seconds: float) -> dict:
    n = _words(payload["input"])
    return {"count": n} if n % 2 else {"token_count": n, "count": -1}


# -- layout and pages -------------------------------------------------------------------------------------------------

#: Texts that join in all ways: hyphens, CJK characters, sentence ends, headings, list rows.
FLOWING = ("it goes on and on,", "half a word of a long para-", "this line comes to its end!", "这是一段比较长的中文文字还没有结束", "中文的句子到这里就结束了。", "1. a list row of the page", "第三章 概述", "continues in lower case with")


def flowing_blocks(spark: SparkSession, folder: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(t) for t in FLOWING]), (F.col("block_no") % len(FLOWING) + 1).cast("int"))
    b = page_blocks(spark, folder).withColumn("text", text)
    return b.withColumn("x0", F.floor(F.col("x0") / 100) * 100.0).withColumn("role", layout.role(F.col("y0"), F.col("y1"), F.col("page_height")))


@query
def paragraph_merge(spark, folder):
    b = layout.column_order(flowing_blocks(spark, folder)).withColumn("node_type", F.lit("paragraph"))
    got = layout.merged_paragraphs(b)
    return got.select("doc_id", long("page_no").alias("page_no"), "place", "x0", "y0", "x1", "y1", "text")


@query
def page_assembly(spark, folder):
    """Blocks and tables of whole pages to nodes: order, overlap, types, roles, merging, reading order, repeated margins."""
    b = flowing_blocks(spark, folder).drop("role")
    tables = b.where("is_table").withColumn("text", F.concat(F.lit("t | "), F.col("block_no").cast("string")))
    got = pages.page_nodes(b.where("NOT is_table"), tables)
    return got.select("doc_id", long("source_page").alias("source_page"), "node_type", long("level").alias("level"), F.md5("text").alias("text_hash"))


@query
def plain_pages(spark, folder):
    """Three documents as the pages of one, cut at blank lines, without what repeats."""
    d = table(spark, folder, "documents")
    head = F.concat(F.lit("Running head "), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("\n\n"))
    p = d.select(F.floor(F.col("doc_id") / 3).alias("doc_id"), (F.col("doc_id") % 3 + 1).alias("page_no"), F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n\n3 / 7")).alias("text"))
    got = pages.plain_page_nodes(p)
    return got.select("doc_id", long("source_page").alias("source_page"), "node_type", F.md5("text").alias("text_hash"))


@query
def ocr_router(spark, folder):
    """Nodes by a parser, and OCR's where these are too short and it finds any; every third document has little text."""
    d = table(spark, folder, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 30)).otherwise(F.col("text"))
    nodes = d.select("doc_id", text.alias("text")).where("doc_id % 5 > 0")
    found = d.where("doc_id % 4 > 0").select("doc_id", F.concat(F.lit("read: "), "text").alias("text"))
    got = ingest.with_ocr_fallback(nodes, found, ingest.needs_ocr(d, nodes))
    return got.select("doc_id", F.md5("text").alias("text_hash"))


def _picture_model(content: bytes) -> str:
    text = content.decode()
    if len(text) % 10 == 3:
        raise RuntimeError("no answer")
    node = {"node_type": "table" if len(text) % 2 else "drawing", "text": text, "level": len(text) % 3, **({"order": 7} if len(text) % 4 == 0 else {})}
    return f"```json\n{json.dumps({'nodes': [node]})}\n```"


@query
def picture_nodes(spark, folder):
    """Regions of pages read by a model, the first ten pages only, with the region's metadata where it gave none; failures as rows."""
    b = table(spark, folder, "benchmark")
    regions = vision.scanned_pages(b.select("item_id", (F.col("item_id") % 12 + 1).alias("page_no"), F.encode("text", "UTF-8").alias("content"), F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0, 4.0)]).alias("bbox"), F.lit("picture").alias("layout_role"), (F.col("item_id") % 5).cast("int").alias("order")))
    answers = vision.ask(regions, _picture_model, ["item_id", "page_no"])
    nodes = vision.answered_nodes(answers.where("error IS NULL"), ["item_id"], page="page_no")
    got = vision.with_defaults(nodes, regions, ["item_id"]).select("item_id", F.col("page_layout").alias("place"), "node_type", "level", F.md5("text").alias("text_hash"), long("order").alias("order"), F.concat_ws(" ", "layout_role", F.array_join(F.col("bbox").cast("array<int>"), ",")).alias("region"))
    none = F.lit(None)
    failed = answers.where("error IS NOT NULL").select("item_id", F.lit("failed").alias("place"), none.cast("string").alias("node_type"), none.cast("long").alias("level"), none.cast("string").alias("text_hash"), none.cast("long").alias("order"), F.col("error").alias("region"))
    return got.unionByName(failed)


# -- files ------------------------------------------------------------------------------------------------------------

_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{body}')
    return out.getvalue()


def docx_file(text: str) -> bytes:
    """Every line a paragraph, each seventh a heading of level 1 to 3 by its style's name, each fifth also the row of a table."""

    def p(line: str, style: str | None = None) -> str:
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{mark}<w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'

    rows = text.split("\n")
    body = "".join(p(line, f"s{k // 7 % 3 + 1}" if k % 7 == 0 else None) for k, line in enumerate(rows))
    cells = "".join(f"<w:tr><w:tc>{p(str(k))}</w:tc><w:tc>{p(line)}</w:tc></w:tr>" for k, line in enumerate(rows) if k % 5 == 0)
    styles = "".join(f'<w:style w:styleId="s{n}"><w:name w:val="heading {n}"/></w:style>' for n in (1, 2, 3))
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}<w:tbl>{cells}</w:tbl></w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="{_WORD}">{styles}</w:styles>'})


def xlsx_file(text: str) -> bytes:
    """One sheet: a row for every line, its number, a gap of one column, whether the number is even, and the line as a shared string."""
    rows = text.split("\n")
    cells = "".join(
        f'<row r="{k + 1}"><c r="A{k + 1}"><v>{k}</v></c><c r="C{k + 1}" t="b"><v>{int(k % 2 == 0)}</v></c><c r="D{k + 1}" t="s"><v>{k}</v></c><c r="E{k + 1}"><v>{k}.5</v></c></row>' for k in range(len(rows))
    )
    shared = "".join(f'<si><t xml:space="preserve">{escape(line)}</t></si>' for line in rows)
    return _zipped({
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_REL}"><sheets><sheet name="lines" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{cells}</sheetData></worksheet>', "xl/sharedStrings.xml": f'<sst xmlns="{_SHEET}">{shared}</sst>',
    })


def made_files(spark: SparkSession, folder: str, make) -> DataFrame:
    """(doc_id, content): a file of each document's text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([make(t or "") for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "content"])

    return table(spark, folder, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, content binary")


@query
def docx_files(spark, folder):
    got = office.parsed(made_files(spark, folder, docx_file), office.docx_nodes)
    return got.select("doc_id", long("node_pos").alias("node_pos"), "node_type", long("level").alias("level"), F.md5("text").alias("text_hash"), "parser_strategy")


@query
def xlsx_files(spark, folder):
    got = office.parsed(made_files(spark, folder, xlsx_file), office.xlsx_nodes)
    return got.select("doc_id", long("node_pos").alias("node_pos"), "node_type", long("level").alias("level"), F.md5("text").alias("text_hash"), "sheet_name")


@query
def read_errors(spark, folder):
    """Files whose reader fails or is missing give a row with the error, the others their nodes."""
    made = made_files(spark, folder, xlsx_file)
    parser = F.when(F.col("doc_id") % 3 == 0, "docx").when(F.col("doc_id") % 3 == 1, "xlsx").otherwise("absent")

    def read(name: str, content: bytes):
        if name == "absent":
            raise office.MissingReader(name)
        return ((kind, text) for kind, _, text, *_ in office.READERS[name](content))

    got = office.read_rows(made.withColumn("parser", parser), read, "node_type string, text string")
    return got.select("doc_id", "node_type", F.md5("text").alias("text_hash"), "error", long(ingest.status_code(F.col("error"))).alias("status"))


# -- addresses, store, service ----------------------------------------------------------------------------------------


@query
def barred_addresses(spark, folder):
    """IPv4 addresses from line items, in and beside all networks that are not fetched."""
    i = table(spark, folder, "lineitem")
    first = F.element_at(F.array(*[F.lit(x) for x in (0, 8, 10, 100, 127, 169, 172, 192, 198, 203, 223, 224, 240, 255)]), (F.col("l_partkey") % 14 + 1).cast("int"))
    second = F.element_at(F.array(*[F.lit(x) for x in (0, 15, 16, 18, 19, 31, 32, 51, 88, 168, 254)]), (F.col("l_suppkey") % 11 + 1).cast("int"))
    third = F.element_at(F.array(*[F.lit(x) for x in (0, 2, 99, 100, 113)]), (F.col("l_orderkey") % 5 + 1).cast("int"))
    host = F.concat_ws(".", first.cast("string"), second.cast("string"), third.cast("string"), (F.col("l_orderkey") % 256).cast("string"))
    return i.select("l_orderkey", "l_linenumber", host.alias("address"), ingest.barred_literal(host).alias("barred"))


def _saved(spark: SparkSession, folder: str) -> store.ChunkStore:
    """Documents in a store of their own: every document saved, then every other one again with half of its chunks."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="textloom-")
    kept = store.ChunkStore(spark, f"{root}/store-{uuid.uuid4().hex}")
    c = stored_chunks(marked_docs(spark, folder)).withColumn("section_path", F.array("section_path")).withColumn("page_no", F.array(F.lit(1)))
    names = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("file "), F.col("doc_id").cast("string")).alias("filename"))
    kept.save(c, names)
    again = F.col("document_id").cast("long") % 2 == 0
    kept.save(c.where(again & (F.col("chunk_index") % 2 == 1)), names.where(again))
    return kept


@query
def store_pages(spark, folder):
    """The second page of every document with its header, empty where the document ends before."""
    got = _saved(spark, folder).pages(page=2, page_size=4)
    return got.select("document_id", "filename", "status", long("total_chunks").alias("total_chunks"), long("chunk_index").alias("chunk_index"), "chunk_type", "preview_text")


@query
def store_lookups(spark, folder):
    """Point lookups of a chunk by its id and of its document."""
    kept = _saved(spark, folder)
    key = kept.chunks().agg(F.min("chunk_id")).first()[0]
    chunk = kept.chunk(key)
    return chunk.join(kept.document(chunk.first()["document_id"]).select("document_id", "filename"), "document_id").select("document_id", "filename", long("chunk_index").alias("chunk_index"), F.md5("full_text").alias("text_hash"))


@query
def exempt_requests(spark, folder):
    """Requests that count against the limit, by path; /health and /metrics do not."""
    path = F.element_at(F.array(*[F.lit(p) for p in ("/health", "/metrics", "/chunk", "/health/x")]), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, folder, "events").select(path.alias("path"), rate_limit.exempt(path, RateLimit()).alias("exempt")).groupBy("path", "exempt").agg(F.count("*").alias("n"))


@query
def pipeline_metrics(spark, folder):
    """What splitting a document took: spans, spans that were drawn back, tokens of all spans."""
    rows = normal_docs(spark, folder)
    s = split.split_spans(rows, "text", ChunkOptions(max_tokens=60, overlap_tokens=8))
    drawn = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("spans") - 1, F.lit(1))), lambda k: F.coalesce(F.get("spans", k)["start"] < F.get("spans", k - 1)["end"], F.lit(False))))
    tokens = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + tx.token_count(x["text"], trimmed=True))
    return s.select("doc_id", long(F.size("spans")).alias("n_spans"), long(drawn).alias("n_overlaps"), tokens.alias("tokens"))


@query
def parsed_node_texts(spark, folder):
    """``chunk_parsed_nodes`` chunk by chunk, with the hash of each text."""
    c = table(spark, folder, "conversations")
    title = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2).alias("node_pos"), F.lit("title").alias("node_type"), F.lit(1).alias("level"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("text"))
    body = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2 + 1).alias("node_pos"), F.lit("paragraph").alias("node_type"), F.lit(0).alias("level"), "text")
    got = chunking.chunk_nodes(title.unionByName(body))
    return got.select("doc_id", "chunk_index", "chunk_type", segment.path_text(F.col("section_path")).alias("section_path"), "tokens", F.md5("full_text").alias("text_hash"))


@query
def normal_node_texts(spark, folder):
    """``normalize_nodes`` node by node, with the hash of each text."""
    n = lines.normalised(lines.nodes(lines.line_rows(marked_docs(spark, folder))))
    return n.select("doc_id", long("node_pos").alias("node_pos"), "node_type", long("level").alias("level"), F.md5("text").alias("text_hash"))
