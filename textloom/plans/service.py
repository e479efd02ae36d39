"""Files or URLs in, stored chunks out: admission, one reader per format, OCR where a text is too short, errors as rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines
from ..options import BoundaryOptions, ChunkOptions, IngestOptions
from ..sources import ingest, office, vision
from ..sources.store import ChunkStore, document_id
from . import chunking, pages

NODE = ("doc_id", "node_pos", "node_type", "level", "text", "source_page")


@dataclass(frozen=True)
class Readers:
    """What reads PDF files and images. Without a model images need OCR, and so do PDF files without enough text."""

    pages: Callable[[bytes], Iterator[tuple]] = office.pdf_pages
    render: Callable[[bytes], Iterator[tuple[int, bytes]]] = office.pdf_images
    model: Callable[[bytes], str] | None = None


def admitted(files: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """files (filename, length, content) with document_id, error and the parser that they go to."""
    error = ingest.rejection(F.col("filename"), F.col("length"), options)
    if "error" in files.columns:
        error = F.coalesce("error", error)
    return files.withColumn("doc_id", document_id(F.coalesce(F.col("path"), F.col("filename")))).withColumn("error", error).withColumn("parser", ingest.parser_route(F.col("filename")))


def _plain(rows: DataFrame, page: str | None = None) -> DataFrame:
    level = F.col("level").cast("int").alias("level")
    return rows.select("doc_id", F.col("node_pos").cast("int").alias("node_pos"), "node_type", level, "text", (F.col(page) if page else F.lit(None)).cast("int").alias("source_page"))


class Staged:
    """Tables below a folder, so that no file is read twice."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def direct_nodes(staged: Staged, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and errors of text, Word and sheet files."""

    def read(parser: str, content: bytes) -> Iterator[tuple]:
        return ((k, *node) for k, node in enumerate(office.READERS[parser](content)))

    got = office.read_rows(files.where(F.col("parser").isin(*office.READERS)), read, "node_pos int, node_type string, level int, text string, sheet_name string, parser_strategy string")
    got = staged.table(got, "direct")
    nodes = _plain(got.where(F.col("error").isNull() & (F.col("node_type") != office.OFFICE_TEXT)))
    texts = got.where(F.col("node_type") == office.OFFICE_TEXT).select("doc_id", "text")
    return nodes.unionByName(_plain(lines.office_nodes(lines.line_rows(texts)))), got.where("error IS NOT NULL").select("doc_id", "error")


def answered(staged: Staged, images: DataFrame, readers: Readers, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and errors of images (doc_id, page_no, content), each answered by the model."""
    answers = staged.table(vision.ask(images, readers.model, ["doc_id", "page_no"]), name)
    nodes = vision.answered_nodes(answers.where("error IS NULL"), ["doc_id"], page="page_no")
    # pages one after the other; a node's place counts within its page
    nodes = nodes.withColumn("node_pos", F.col("page_no") * 100_000 + F.col("node_pos"))
    return _plain(nodes, "page_no"), answers.where("error IS NOT NULL").select("doc_id", F.lit("parse_error").alias("error")).distinct()


def page_file_nodes(staged: Staged, files: DataFrame, readers: Readers) -> tuple[DataFrame, DataFrame]:
    """Nodes and errors of PDF files: by layout where the reader has any, else by page texts."""
    fields = "page_no int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double, block_type int"
    got = staged.table(office.read_rows(files, lambda _, content: readers.pages(content), fields), "pages")
    plain = pages.plain_page_nodes(got.where(F.col("block_type") == office.PLAIN).select("doc_id", "page_no", "text"))
    blocks, tables = (got.where(F.col("block_type") == kind).drop("error") for kind in (office.TEXT, office.TABLE))
    laid = pages.page_nodes(blocks, tables)
    return _plain(laid, "source_page").unionByName(_plain(plain, "source_page")), got.where("error IS NOT NULL").select("doc_id", "error")


def with_ocr(staged: Staged, files: DataFrame, nodes: DataFrame, readers: Readers, options: IngestOptions) -> DataFrame:
    """PDF nodes, replaced by the model's where a file has fewer characters than the threshold and the model finds any."""
    wanted = ingest.needs_ocr(files, nodes, options)
    short = files.join(wanted.where("needs_ocr"), "doc_id", "left_semi")
    rendered = office.read_rows(short, lambda _, content: readers.render(content), "page_no int, content binary")
    images = vision.scanned_pages(rendered.where("error IS NULL"), options.ocr_pages)
    found, _ = answered(staged, images.select("doc_id", "page_no", "content"), readers, "ocr")
    return ingest.with_ocr_fallback(nodes, found, wanted)


def extracted(staged: Staged, files: DataFrame, readers: Readers = Readers(), options: IngestOptions = IngestOptions()) -> tuple[DataFrame, DataFrame]:
    """Nodes of all admitted files (doc_id, parser, error, content), and (doc_id, error) of those whose reader is missing or fails."""
    good = files.where("error IS NULL")
    nodes, errors = direct_nodes(staged, good)
    papers = good.where("parser = 'pdf'")
    page_nodes, page_errors = page_file_nodes(staged, papers, readers)
    if readers.model is not None:
        images = good.where("parser = 'vision'").select("doc_id", F.lit(1).alias("page_no"), "content")
        seen, image_errors = answered(staged, images, readers, "images")
        page_nodes = with_ocr(staged, papers, page_nodes, readers, options).unionByName(seen)
        page_errors = page_errors.unionByName(image_errors)
    nodes = staged.table(nodes.unionByName(page_nodes).select(*NODE), "nodes")
    # a file that OCR read after all has no error
    errors = errors.unionByName(page_errors).join(nodes.select("doc_id").distinct(), "doc_id", "left_anti")
    return nodes, staged.table(errors, "errors")


def _stored(spark: SparkSession, seen: DataFrame, fit: DataFrame, store: ChunkStore, options: ChunkOptions, bounds: BoundaryOptions, readers: Readers, ingest_options: IngestOptions) -> DataFrame:
    staged = Staged(spark, f"{store.path}/_staging-{uuid.uuid4().hex}")
    try:
        nodes, errors = extracted(staged, fit, readers, ingest_options)
        chunks = chunking.chunk_nodes(nodes, options, bounds).withColumnRenamed("doc_id", "document_id")
        kept = nodes.select(F.col("doc_id").alias("document_id")).distinct()
        admitted_ = seen.where("error IS NULL").select("doc_id", "filename")
        store.save(chunks, admitted_.withColumnRenamed("doc_id", "document_id").join(kept, "document_id", "left_semi"))
        unread = ingest.empty_documents(admitted_.join(errors, "doc_id", "left_anti"), nodes)
        reasons = errors.unionByName(unread).join(admitted_, "doc_id").select("filename", "error")
        failed = seen.where("error IS NOT NULL").select("filename", "error").unionByName(reasons)
        failed = failed.withColumn("status", ingest.status_code(F.col("error")))
        return Staged(spark, f"{store.path}/_failed-{uuid.uuid4().hex}").table(failed, "rows")
    finally:
        staged.drop()


def chunk_files(spark: SparkSession, path: str, store: ChunkStore, options: ChunkOptions = ChunkOptions(), bounds: BoundaryOptions = BoundaryOptions(), ingest_options: IngestOptions = IngestOptions(), readers: Readers = Readers()) -> DataFrame:
    """Chunks every admissible file below ``path`` into the store; returns filename, error and status of those that failed. Files
    of no bytes are not listed by Spark's reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    # contents above the limit are never read: the filter on length prunes them before the column is fetched
    seen = admitted(files.select("path", "filename", "length"), ingest_options)
    fit = admitted(files.where(F.col("length") <= ingest_options.max_upload_mb * ingest.MEGABYTE), ingest_options)
    return _stored(spark, seen, fit, store, options, bounds, readers, ingest_options)


def chunk_urls(urls: DataFrame, store: ChunkStore, options: ChunkOptions = ChunkOptions(), bounds: BoundaryOptions = BoundaryOptions(), ingest_options: IngestOptions = IngestOptions(), readers: Readers = Readers(), **guards) -> DataFrame:
    """The same of (document_url, filename): each is fetched once, by the task that has it, and kept until it is parsed."""
    spark = urls.sparkSession
    fetched = Staged(spark, f"{store.path}/_fetched-{uuid.uuid4().hex}")
    try:
        files = admitted(fetched.table(ingest.fetched(urls, ingest_options, **guards), "files"), ingest_options)
        return _stored(spark, files.drop("content"), files, store, options, bounds, readers, ingest_options)
    finally:
        fetched.drop()
