"""The plans that the design counts on: few exchanges, pruned columns, pushed filters."""

from pyspark.sql import functions as F

from textloom.operators import lines, segment
from textloom.options import RateLimit
from textloom.plans import chunking, registry
from textloom.sources.store import ChunkStore
from textloom.streaming import rate_limit


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_chunking_needs_no_exchange(spark, sf):
    p = plan(registry.queries()["chunk_documents"](spark, sf))
    assert "Exchange" not in p and "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_blocks_need_one_exchange(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    nodes = segment.blocks(segment.section_paths(lines.normalised(lines.nodes(lines.line_rows(docs)))))
    assert exchanges(segment.block_facts(nodes)) == 1
    assert exchanges(chunking.chunk_nodes(nodes)) == 1


def test_rate_limit_needs_one_exchange(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    df = rate_limit.limited(events, "user_id", "ts", RateLimit())
    assert exchanges(df) == 1 and "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan(df)


def test_lookups_are_pushed_to_the_scan(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path))
    chunks = chunking.chunk_texts(spark.createDataFrame([("a", "x")], "doc_id string, text string")).withColumnRenamed("doc_id", "document_id")
    store.save(chunks, chunks.select("document_id", F.lit("f").alias("filename")))
    assert "EqualTo(document_id,a)" in plan(store.document("a"))
    p = plan(store.page("a"))
    assert "EqualTo(document_id,a)" in p and "full_text" not in p


def test_chunking_a_stream(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    stream = chunking.chunk_texts(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == chunking.chunk_texts(docs).count()
