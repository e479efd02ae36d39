"""The chunk store: two Parquet tables, written by staging, read by key with pushed filters.

Saving a document again replaces it. Arrays are native; ``chunk_index`` counts from 1; ids are hashes of what they name, so writing again gives the same ids.
Chunks are sorted by document within files, so that a document's row groups are few and found by statistics.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENTS = "document_id string, filename string, status string, total_chunks int, created_at timestamp, updated_at timestamp"
CHUNKS = "chunk_id string, document_id string, chunk_index int, chunk_type string, section_path array<string>, page_no array<int>, preview_text string, full_text string, created_at timestamp"
HEADER = ("filename", "status", "total_chunks")
MOST_ROWS, PAGE_SIZE = 100, 20


def document_id(key: Column) -> Column:
    return F.sha2(key.cast("string"), 256)


def chunk_id(document: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", document, index.cast("string")), 256)


def page_bounds(page: int, page_size: int) -> tuple[int, int]:
    """Offset and limit; pages count from 1, sizes go to 100."""
    if page < 1 or not 1 <= page_size <= MOST_ROWS:
        raise ValueError("page must be at least 1 and page_size from 1 to 100")
    return (page - 1) * page_size, page_size


def paged(chunks: DataFrame, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """That page of every document, by chunk_index."""
    skip, take = page_bounds(page, page_size)
    row = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))
    return chunks.withColumn("row", row).where(F.col("row").between(skip + 1, skip + take)).drop("row")


@dataclass
class ChunkStore:
    """Tables ``documents`` and ``chunks`` below a path; every write adds its own folder of both, then one marker."""

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[str]:
        """Folders of the writes that were finished."""
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_DONE"))
        return [str(s.getPath().getParent()) for s in found or []]

    def save(self, chunks: DataFrame, filenames: DataFrame) -> None:
        """chunks: document_id, chunk_index, chunk_type, section_path, page_no, preview_text, full_text; filenames: document_id, filename.

        Readers see a batch only when both tables are complete: the marker comes last.
        """
        batch = f"{self.path}/{time.time_ns():020d}-{uuid.uuid4().hex}"
        now = F.current_timestamp()
        rows = chunks.select(
            chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", F.col("chunk_index").cast("int"), "chunk_type",
            "section_path", F.col("page_no").cast("array<int>"), "preview_text", "full_text", now.alias("created_at"),
        )
        rows.repartition("document_id").sortWithinPartitions("document_id", "chunk_index").write.parquet(f"{batch}/chunks")
        counts = self.spark.read.schema(CHUNKS).parquet(f"{batch}/chunks").groupBy("document_id").agg(F.count("*").cast("int").alias("n"))
        status = F.when(F.col("n").isNull(), "failed").otherwise("completed")
        docs = filenames.join(counts, "document_id", "left").select(
            "document_id", "filename", status.alias("status"), F.coalesce("n", F.lit(0)).alias("total_chunks"), now.alias("created_at"), now.alias("updated_at")
        )
        docs.sortWithinPartitions("document_id").write.parquet(f"{batch}/documents")
        jvm, fs = self._fs()
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{batch}/_DONE")).close()

    def _read(self, name: str, schema: str) -> DataFrame:
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, batch string")
        batch = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
        return self.spark.read.schema(schema).parquet(*[f"{b}/{name}" for b in batches]).withColumn("batch", batch)

    def _latest(self) -> DataFrame:
        """Of every document the last write that was finished: saving it again replaces it."""
        return self._read("documents", DOCUMENTS).groupBy("document_id").agg(F.max("batch").alias("batch"))

    def _current(self, name: str, schema: str) -> DataFrame:
        rows = self._read(name, schema)
        if len(self._batches()) > 1:
            rows = rows.join(self._latest(), ["document_id", "batch"], "left_semi")
        return rows.drop("batch")

    def documents(self) -> DataFrame:
        return self._current("documents", DOCUMENTS)

    def chunks(self) -> DataFrame:
        return self._current("chunks", CHUNKS)

    def document(self, key: str) -> DataFrame:
        return self.documents().where(F.col("document_id") == key)

    def chunk(self, key: str) -> DataFrame:
        """Point lookup; arrays that are missing are empty."""
        found = self.chunks().where(F.col("chunk_id") == key)
        return found.withColumn("section_path", F.coalesce("section_path", F.array().cast("array<string>"))).withColumn("page_no", F.coalesce("page_no", F.array().cast("array<int>")))

    def page(self, key: str, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame | None:
        """One page of a document's chunks without their full texts, each with the document's header; None for an unknown document."""
        skip, take = page_bounds(page, page_size)
        if self.document(key).isEmpty():
            return None
        rows = self.chunks().where(F.col("document_id") == key).drop("full_text").orderBy("chunk_index").offset(skip).limit(take)
        return rows.join(F.broadcast(self.document(key).select("document_id", *HEADER)), "document_id").orderBy("chunk_index")

    def pages(self, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
        """That page of every document: its header, and the chunks where the page has any."""
        rows = paged(self.chunks().drop("full_text"), page, page_size)
        return self.documents().select("document_id", *HEADER).join(rows, "document_id", "left")

    def clear(self) -> None:
        jvm, fs = self._fs()
        for batch in self._batches():
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{batch}/_DONE"), False)
            fs.delete(jvm.org.apache.hadoop.fs.Path(batch), True)


def register_tables(spark: SparkSession, documents: str = "chunk_documents_table", chunks: str = "chunk_rows_table") -> None:
    """Empty catalog tables of both schemas."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {documents} ({DOCUMENTS}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {chunks} ({CHUNKS}) USING parquet")


def json_columns(chunks: DataFrame) -> DataFrame:
    """Arrays as JSON text, for stores without arrays."""
    return chunks.withColumn("section_path", F.to_json("section_path")).withColumn("page_no", F.to_json("page_no"))


def from_json_columns(chunks: DataFrame) -> DataFrame:
    read = lambda c, kind: F.from_json(F.coalesce(c, F.lit("[]")), kind)
    return chunks.withColumn("section_path", read(F.col("section_path"), "array<string>")).withColumn("page_no", read(F.col("page_no"), "array<int>"))
