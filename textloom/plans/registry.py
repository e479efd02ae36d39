"""Registered queries of the chunking engine, each over its whole table, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import boundary, kernel, layout, lines, merge, segment, split
from ..options import BoundaryOptions, ChunkOptions, RateLimit
from ..sources import ingest, office, store, vision
from ..streaming import rate_limit
from . import chunking, oracle

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def marked_query(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Registers f over the marked documents, whose heading lines are cut, and as f_whole over all of their characters."""
    FOUND[f.__name__] = lambda spark, folder: f(marked_docs(spark, folder))
    FOUND[f"{f.__name__}_whole"] = lambda spark, folder: f(whole_docs(spark, folder))
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def marked(text: Column, whole: bool = False) -> Column:
    """The prose with headings and list rows put in by line number, so that all line classes occur. A heading takes the place
    of its line, of which 24 characters stay, or if whole is a further line before it."""

    def line(raw: Column, i: Column) -> Column:
        hashes = F.repeat(F.lit("#"), (F.floor(i / 11) % 3 + 1).cast("int"))
        heading = F.concat(hashes, F.lit(" "), F.left(raw, F.lit(24)))
        if whole:
            heading = F.concat(heading, F.lit("\n"), raw)
        return F.when(i % 11 == 0, heading).when(i % 5 == 0, F.concat(F.lit("- "), raw)).otherwise(raw)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def marked_docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", marked(F.col("text")).alias("text"))


def whole_docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", marked(F.col("text"), whole=True).alias("text"))


def marked_nodes(docs: DataFrame) -> DataFrame:
    return lines.nodes(lines.line_rows(docs))


def marked_blocks(docs: DataFrame) -> DataFrame:
    return segment.blocks(segment.section_paths(lines.normalised(marked_nodes(docs))))


def text_path_facts(docs: DataFrame) -> DataFrame:
    return segment.block_facts(marked_blocks(docs)).withColumn("path", segment.path_text(F.col("path")))


# -- text -------------------------------------------------------------------------------------------------------------


@query
def token_count(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


@query
def normalize_text(spark, folder):
    t = tx.normal_text(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", long(F.length(t)).alias("n_chars"), F.md5(t).alias("text_hash"))


@query
def normalize_table(spark, folder):
    t = tx.normal_table(F.replace(F.col("text"), F.lit(" "), F.lit("  ")))
    return table(spark, folder, "documents").select("doc_id", long(F.length(t)).alias("n_chars"), F.md5(t).alias("text_hash"))


@query
def preview_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query
def decode_utf8(spark, folder):
    t = tx.decoded(F.encode("text", "UTF-8"))
    return table(spark, folder, "documents").select("doc_id", long(F.length(t)).alias("n_chars"), F.md5(t).alias("text_hash"))


# -- lines to blocks --------------------------------------------------------------------------------------------------


@marked_query
def line_class(docs):
    return lines.line_rows(docs).select("doc_id", long("line_no").alias("line_no"), "class")


@marked_query
def markdown_nodes(docs):
    n = marked_nodes(docs)
    return n.select("doc_id", long("node_pos").alias("node_pos"), "node_type", long("level").alias("level"), F.md5("text").alias("text_hash"))


@marked_query
def normalize_nodes(docs):
    n = lines.normalised(marked_nodes(docs))
    return n.groupBy("doc_id", "node_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.sum("level").alias("levels"))


@marked_query
def office_nodes(docs):
    n = lines.office_nodes(lines.line_rows(docs))
    return n.select("doc_id", long("node_pos").alias("node_pos"), "node_type", long("level").alias("level"), F.md5("text").alias("text_hash"))


@query
def page_node_types(spark, folder):
    rows = lines.line_rows(table(spark, folder, "documents")).where(tx.strip(F.col("raw")) != "")
    return rows.select("doc_id", long("line_no").alias("line_no"), lines.page_node_type(F.col("raw")).alias("node_type"))


@marked_query
def section_path(docs):
    n = segment.section_paths(lines.normalised(marked_nodes(docs)))
    return n.select("doc_id", long("node_pos").alias("node_pos"), segment.path_text(F.col("section_path")).alias("section_path"))


@marked_query
def segment_blocks(docs):
    f = text_path_facts(docs)
    return f.select("doc_id", "block_id", "path", long("tokens").alias("tokens"), "n_nodes", F.md5("text").alias("text_hash"))


@marked_query
def merge_short_blocks(docs):
    return merge.merge_groups(text_path_facts(docs)).select("doc_id", "block_id", "group_id")


@marked_query
def serialize_blocks(docs):
    s = segment.serialised(segment.block_facts(marked_blocks(docs)))
    return s.select("doc_id", "chunk_index", "chunk_id", "chunk_type", "section_path", "preview_text", F.md5("full_text").alias("text_hash"))


# -- splitting --------------------------------------------------------------------------------------------------------


@query
def separator_split(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", tx.normal_text(F.col("text")).alias("text"))
    s = split.split_spans(rows, "text", stage="separate").select("doc_id", F.transform("spans", lambda x: x["text"]).alias("t"))
    return s.select("doc_id", long(F.size("t")).alias("n_spans"), F.md5(F.array_join("t", "\x1f")).alias("spans_hash"))


@query
def span_pack(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", tx.normal_text(F.col("text")).alias("text"))
    s = split.split_spans(rows, "text", stage="pack").select("doc_id", F.transform("spans", lambda x: x["text"]).alias("t"))
    return s.select("doc_id", long(F.size("t")).alias("n_spans"), F.md5(F.array_join("t", "\x1f")).alias("spans_hash"))


@query
def overlap_chunks(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", tx.normal_text(F.col("text")).alias("text"))
    s = split.split_spans(rows, "text", ChunkOptions(max_tokens=60, overlap_tokens=8)).select("doc_id", F.posexplode("spans").alias("span", "s"))
    return s.select("doc_id", long("span").alias("span"), long("s.start").alias("start"), long("s.end").alias("end"), F.md5("s.text").alias("text_hash"))


@query
def hard_split(spark, folder):
    w = split.hard_windows(F.length("text"), ChunkOptions().max_tokens)
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(w).alias("window", "width"))
    return rows.select("doc_id", long("window").alias("window"), long("width").alias("width"))


@query
def node_pack(spark, folder):
    sizes = F.transform(F.split("text", "\n"), lambda x: tx.token_count(x))
    packs = split.pack_groups(sizes, ChunkOptions().max_tokens)
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(packs).alias("line_no", "pack"))
    return rows.select("doc_id", long("line_no").alias("line_no"), long("pack").alias("pack"))


@marked_query
def chunk_documents(docs):
    c = chunking.chunk_texts(docs)
    return c.select("doc_id", "chunk_index", "chunk_id", "chunk_type", segment.path_text(F.col("section_path")).alias("section_path"), "tokens", "preview_text", F.md5("full_text").alias("text_hash"))


@query
def chunk_parsed_nodes(spark, folder):
    """The same from parsed nodes: conversations as a heading for each turn and its paragraphs."""
    c = table(spark, folder, "conversations")
    title = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2).alias("node_pos"), F.lit("title").alias("node_type"), F.lit(1).alias("level"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("text"))
    body = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2 + 1).alias("node_pos"), F.lit("paragraph").alias("node_type"), F.lit(0).alias("level"), "text")
    got = chunking.chunk_nodes(title.unionByName(body))
    return got.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"), F.sum(F.length("full_text")).alias("n_chars"))


@marked_query
def document_summary(docs):
    return chunking.document_summary(docs, chunking.chunk_texts(docs))


# -- store ------------------------------------------------------------------------------------------------------------


def stored_chunks(docs: DataFrame) -> DataFrame:
    s = segment.serialised(segment.block_facts(marked_blocks(docs)))
    return s.withColumn("document_id", F.col("doc_id").cast("string"))


@marked_query
def paged_chunks(docs):
    got = store.paged(stored_chunks(docs), page=2, page_size=5)
    return got.select("document_id", "chunk_index", "chunk_type", "preview_text")


@query
def page_lists(spark, folder):
    page = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber"))
    got = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(segment.page_list(page).alias("p"))
    return got.select("l_orderkey", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"))


@marked_query
def json_columns(docs):
    s = segment.section_paths(lines.normalised(marked_nodes(docs))).select("doc_id", "node_pos", "section_path", F.array(long("node_pos")).alias("page_no"))
    back = store.from_json_columns(store.json_columns(s).withColumn("page_no", F.when(F.col("node_pos") % 2 == 0, F.col("page_no"))))
    return back.select("doc_id", long("node_pos").alias("node_pos"), segment.path_text(F.col("section_path")).alias("section_path"), long(F.size("page_no")).alias("n_pages"))


# -- boundaries -------------------------------------------------------------------------------------------------------

LOW_BOUNDS = BoundaryOptions(high=0.3, low=0.1)


def decided_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring vectors as block pairs: their cosine is the score, the vector's number gives the gate and the decider's word."""
    e = table(spark, folder, "embeddings").select(F.lit(0).alias("doc_id"), F.col("vec_id").alias("block_id"), "embedding", "label")
    # an equi-join on the next number, so that the whole table is not one window
    before = e.select((F.col("block_id") + 1).alias("block_id"), F.col("embedding").alias("prev_embedding"), F.col("label").alias("prev_label"))
    pairs = e.join(before, "block_id")
    score = F.when(F.col("block_id") % 17 > 0, boundary.cosine(F.col("prev_embedding"), F.col("embedding")))
    d = boundary.decision((F.col("label") + F.col("prev_label")) % 5 > 0, score, F.col("block_id") % 2 == 0, BoundaryOptions(high=0.3, low=0.1, llm=True))
    return pairs.select(F.col("block_id").alias("right_block"), d.alias("d")).select("right_block", "d.merge", "d.strategy", "d.similarity_score")


@query
def cosine_adjacent(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    return e.join(before, "vec_id").select("vec_id", F.round(boundary.cosine(F.col("before"), F.col("embedding")), 6).alias("cosine"))


@query
def boundary_decisions(spark, folder):
    return decided_neighbours(spark, folder)


@query
def decision_counts(spark, folder):
    return boundary.decision_counts(decided_neighbours(spark, folder))


@marked_query
def boundary_gate(docs):
    facts = text_path_facts(docs)
    pairs = boundary.neighbours(facts, ["path", "tokens", "n_title", "n_table"])
    d = boundary.decision(boundary.gate("prev_", ""), F.lit(None).cast("double"), F.lit(None).cast("boolean"), BoundaryOptions(similarity=False))
    return pairs.select("doc_id", "block_id", boundary.gate("prev_", "").alias("eligible"), d["strategy"].alias("strategy"))


# -- layout -----------------------------------------------------------------------------------------------------------


def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks laid out by arithmetic from line items: a page is an order, a block its line."""
    i = table(spark, folder, "lineitem")
    x0, y0 = (F.col("l_partkey") * 37 % 500).cast("double"), (F.col("l_suppkey") * 53 % 760).cast("double")
    blank = (F.col("l_partkey") + F.col("l_linenumber")) % 7 == 0
    return i.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("page_no"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("block_no"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 20 + F.col("l_quantity") * 4).alias("x1"), (y0 + 8 + F.col("l_linenumber") * 5).alias("y1"),
        F.when(blank, "").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("text"),
        F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0).alias("block_type"),
        (F.col("l_linenumber") % 4 == 0).alias("is_table"),
    )


@query
def layout_column_order(spark, folder):
    return layout.column_order(page_blocks(spark, folder)).select("doc_id", long("page_no").alias("page_no"), "block_no", "place")


@query
def layout_role(spark, folder):
    return page_blocks(spark, folder).select("doc_id", "block_no", layout.role(F.col("y0"), F.col("y1"), F.col("page_height")).alias("role"))


@query
def bbox_exclusion(spark, folder):
    b = page_blocks(spark, folder)
    return layout.without_overlap(b.where("NOT is_table"), b.where("is_table")).select("doc_id", long("page_no").alias("page_no"), "block_no")


@query
def image_regions(spark, folder):
    b = page_blocks(spark, folder)
    got = layout.image_regions(b.where("NOT is_table"), b.where("is_table"))
    return got.select("doc_id", long("page_no").alias("page_no"), "order", "x0", "y0", "x1", "y1", "strategy")


@query
def reading_order(spark, folder):
    b = page_blocks(spark, folder).withColumn("order", long("block_no"))
    box = F.col("block_no") % 13 > 0
    b = b.withColumn("x0", F.when(box, F.col("x0"))).withColumn("y0", F.when(box, F.col("y0")))
    got = layout.reading_order(b.where("NOT is_table AND block_type = 0"), b.where("is_table"), b.where("NOT is_table AND block_type = 1"))
    return got.select("doc_id", long("page_no").alias("page_no"), "order", "place")


@query
def layout_merge(spark, folder):
    b = page_blocks(spark, folder)
    flow = F.when(F.col("block_no") % 3 == 0, "it goes on and on,").when(F.col("block_no") % 3 == 1, "half a word of a long para-").otherwise("this one comes to an end.")
    b = b.withColumn("text", F.concat(flow, F.lit(" and "), F.col("doc_id").cast("string")))
    b = b.withColumn("x0", F.floor(F.col("x0") / 100) * 100.0).withColumn("role", layout.role(F.col("y0"), F.col("y1"), F.col("page_height")))
    b = layout.column_order(b).withColumn("node_type", F.lit("paragraph"))
    got = layout.merged_paragraphs(b)
    return got.select("doc_id", long("page_no").alias("page_no"), "place", "x0", "y0", "x1", "y1", "text")


@query
def repeated_noise(spark, folder):
    rows = lines.line_rows(table(spark, folder, "documents")).withColumnRenamed("raw", "text")
    got = layout.without_noise(rows, role_col=None)
    return got.select("doc_id", long("line_no").alias("line_no"), F.md5("text").alias("text_hash"))


# -- sources ----------------------------------------------------------------------------------------------------------


@query
def sheet_nodes(spark, folder):
    n = table(spark, folder, "customer")
    row = office.rendered_row([F.col(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")])
    # a sheet holds the customers of a nation among a thousand numbers, so sheets do not grow with the table
    part = F.floor(F.col("c_custkey") / 1000)
    rows = n.select("c_nationkey", part.alias("part"), F.col("c_custkey").alias("k"), row.alias("row"))
    body = lines.ordered_text(F.col("row"), F.col("k"), "\n")
    name = F.concat_ws(" ", F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("part"), F.col("part").cast("string"))
    return rows.groupBy("c_nationkey", "part").agg(body.alias("t")).select(name.alias("sheet_name"), F.md5("t").alias("text_hash"), long(F.length("t")).alias("n_chars"))


@query
def legacy_sheet_rows(spark, folder):
    n = table(spark, folder, "part")
    return n.select("p_partkey", office.rendered_row([F.floor("p_retailprice").cast("double").cast("decimal(12,1)"), F.col("p_name"), F.col("p_size")], legacy=True).alias("row"))


@query
def model_json_nodes(spark, folder):
    b = table(spark, folder, "benchmark")
    kind = F.when(F.col("item_id") % 3 == 0, "title").when(F.col("item_id") % 3 == 1, "figure").otherwise("list")
    body = F.to_json(F.struct(F.array(F.struct(kind.alias("node_type"), F.col("text"), (F.col("item_id") % 4 - 1).cast("int").alias("level")), F.struct(F.lit("paragraph").alias("node_type"), F.lit("  ").alias("text"), F.lit(0).alias("level"))).alias("nodes")))
    answer = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\ndone"))).otherwise(F.concat(F.lit("So "), body, F.lit(" it is")))
    got = vision.answered_nodes(b.select("item_id", answer.alias("answer")), ["item_id"])
    return got.select("item_id", "node_pos", "node_type", "level", F.md5("text").alias("text_hash"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Files made up from documents: their suffix and size follow the number."""
    kinds = [*ingest.SUFFIXES, ".csv", ".html", ".PDF"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % len(kinds) + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", F.concat(F.lit("file.v"), F.col("doc_id").cast("string"), kind).alias("filename"), (F.col("n_chars") * 1000).alias("length"))


@query
def file_admission(spark, folder):
    f = files(spark, folder)
    error = ingest.rejection(F.col("filename"), F.col("length"))
    return f.select("doc_id", error.alias("error"), long(ingest.status_code(error)).alias("status"), ingest.parser_route(F.col("filename")).alias("parser"))


@query
def host_allowlist(spark, folder):
    p = table(spark, folder, "pages")
    return p.select("page_id", ingest.url_host(F.col("url")).alias("host"), ingest.host_allowed(F.col("url"), "example.com, Example.net").alias("allowed"))


@query
def url_errors(spark, folder):
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp://"), F.split_part("url", F.lit("://"), F.lit(2)))).otherwise(F.col("url"))
    return table(spark, folder, "pages").select("page_id", ingest.url_error(url, "example.org").alias("error"))


@query
def content_type_check(spark, folder):
    kinds = ["text/plain; charset=utf-8", "application/pdf", "IMAGE/PNG", "application/octet-stream", "text/markdown", ""]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % len(kinds) + 1).cast("int"))
    return files(spark, folder).select("doc_id", ingest.content_type_ok(F.col("filename"), kind).alias("ok"))


@query
def ocr_fallback(spark, folder):
    docs = table(spark, folder, "documents")
    nodes = lines.line_rows(docs).where(F.length("raw") <= 60).select("doc_id", F.col("raw").alias("text"))
    return ingest.needs_ocr(docs, nodes)


@query
def empty_documents(spark, folder):
    f = files(spark, folder)
    nodes = lines.line_rows(table(spark, folder, "documents")).where(F.length("raw") <= 60)
    return ingest.empty_documents(f, nodes)


@query
def ocr_fallback_whole(spark, folder):
    """The same from all nodes of the documents."""
    docs = table(spark, folder, "documents")
    return ingest.needs_ocr(docs, marked_nodes(docs))


@query
def empty_documents_whole(spark, folder):
    """The same from all nodes of the documents."""
    return ingest.empty_documents(files(spark, folder), marked_nodes(table(spark, folder, "documents")))


@query
def data_urls(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", tx.data_url(F.lit("text/plain"), F.encode("text", "UTF-8")).alias("url"))


# -- service ----------------------------------------------------------------------------------------------------------


@query
def rate_limit_hits(spark, folder):
    got = rate_limit.limited(table(spark, folder, "events"), "user_id", "ts", RateLimit(2, 86_400))
    return got.select(F.col("key").alias("user_id"), "micros", "allowed")


@query
def request_metrics(spark, folder):
    e = table(spark, folder, "events").select(F.lit("POST").alias("method"), F.concat(F.lit("/"), "event_type").alias("path"), F.when(F.col("user_id") % 9 == 0, 500).otherwise(200).cast("long").alias("status"), F.floor("value").alias("seconds"))
    return rate_limit.request_metrics(e, (1.0, 10.0, 50.0))


def queries() -> dict[str, Query]:
    from . import cases  # noqa: F401, registers its own

    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    from . import oracle_cases

    return {k: v for k, v in (oracle.SQL | oracle_cases.SQL).items() if k in queries()}
