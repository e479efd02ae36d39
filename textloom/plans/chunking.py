"""Whole documents to chunks, in one pass over the scan: the production path.

Documents are independent, so the plan is scan, one Arrow operator, project: no exchange and no state that grows with the
input. Only the columns that are asked for are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview
from ..operators import kernel
from ..options import BoundaryOptions, ChunkOptions

NODE = "struct<node_type:string,level:int,text:string,source_page:int>"


def _chunk_rows(node_lists, ids: pa.Array, options: ChunkOptions, bounds: BoundaryOptions, count: kernel.Counter, scorer, decider) -> pa.RecordBatch:
    source, index, kinds, paths, pages, texts, tokens = [], [], [], [], [], [], []
    for row, nodes in enumerate(node_lists):
        blocks = kernel.blocks_of(nodes, options, bounds, count, scorer, decider)
        blocks = [b for b in blocks if kernel.block_text(b).strip()]
        for k, ((kind, text, path, page_no), block) in enumerate(zip(kernel.chunks(blocks), blocks), 1):
            source.append(row)
            index.append(k)
            kinds.append(kind)
            paths.append(list(path))
            pages.append(page_no)
            texts.append(text)
            tokens.append(kernel.block_tokens(block, count))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(source, pa.int64())), pa.array(index, pa.int64()), pa.array(kinds, pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array(pages, pa.list_(pa.int32())), pa.array(texts, pa.string()), pa.array(tokens, pa.int64())],
        names=["doc_id", "chunk_index", "chunk_type", "section_path", "page_no", "full_text", "tokens"],
    )


CHUNKS = "doc_id {kind}, chunk_index long, chunk_type string, section_path array<string>, page_no array<int>, full_text string, tokens long"


def _finished(chunks: DataFrame) -> DataFrame:
    ident = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256)
    return chunks.select("doc_id", "chunk_index", ident.alias("chunk_id"), "chunk_type", "section_path", "page_no", preview(F.col("full_text")).alias("preview_text"), "full_text", "tokens")


def chunk_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: ChunkOptions = ChunkOptions(), bounds: BoundaryOptions = BoundaryOptions(), count: kernel.Counter = kernel.estimate, scorer: kernel.Scorer | None = None, decider: kernel.Decider | None = None) -> DataFrame:
    """Chunks of text or markdown documents."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                nodes = (kernel.markdown_nodes(t or "") for t in part.column("text").to_pylist())
                yield _chunk_rows(nodes, part.column("doc_id"), options, bounds, count, scorer, decider)

    return _finished(rows.mapInArrow(run, CHUNKS.format(kind=rows.schema["doc_id"].dataType.simpleString())))


LOCATED = "doc_id {kind}, node_pos int, node_type string, level int, text string, start int, `end` int"


def located_nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The nodes of text or markdown documents with where they begin and end in the text. No exchange."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names, types = ["node_pos", "node_type", "level", "text", "start", "end"], [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            found = [(row, k, n.kind, n.level, n.text, n.start, n.end) for row, t in enumerate(batch.column("text").to_pylist()) for k, n in enumerate(kernel.markdown_nodes(t or ""))]
            source, *columns = zip(*found) if found else ([],) * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(source, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])

    return rows.mapInArrow(run, LOCATED.format(kind=rows.schema["doc_id"].dataType.simpleString()))


def chunk_nodes(nodes: DataFrame, options: ChunkOptions = ChunkOptions(), bounds: BoundaryOptions = BoundaryOptions(), count: kernel.Counter = kernel.estimate, scorer: kernel.Scorer | None = None, decider: kernel.Decider | None = None) -> DataFrame:
    """Chunks of parsed nodes (doc_id, node_pos, node_type, level, text, source_page): one exchange brings documents together."""
    kind = nodes.schema["doc_id"].dataType.simpleString()
    page = F.col("source_page") if "source_page" in nodes.columns else F.lit(None)
    node = F.struct("node_pos", "node_type", F.col("level").cast("int").alias("level"), "text", page.cast("int").alias("page"))
    docs = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))

    def run(batches):
        for batch in batches:
            lists = ([kernel.Node(n["node_type"], n["text"], n["level"] or 0, n["page"]) for n in nodes_] for nodes_ in batch.column("nodes").to_pylist())
            yield _chunk_rows(lists, batch.column("doc_id"), options, bounds, count, scorer, decider)

    return _finished(docs.mapInArrow(run, CHUNKS.format(kind=kind)))


def document_summary(docs: DataFrame, chunks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, status, total_chunks; a document without chunks failed."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = docs.select(F.col(doc_id).alias("doc_id")).join(counts, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("n").isNull(), "failed").otherwise("completed").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("total_chunks"))
