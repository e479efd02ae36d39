"""Nodes to blocks, chunks and back: section paths, block boundaries, serialisation. One exchange on the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview, strip, token_count
from .lines import ordered_text

LONG_TEXT = 1200
PATH_JOINER = " > "


def heading_stack(titles: Column) -> Column:
    """The path after a list of (level, text): a title of level L keeps the first L - 1 entries."""
    return F.aggregate(
        titles, F.array().cast("array<string>"),
        lambda path, t: F.concat(F.slice(path, F.lit(1), F.greatest(t["level"], F.lit(1)) - 1), F.array(t["text"])),
    )


def section_paths(nodes: DataFrame) -> DataFrame:
    """Adds ``section_path`` (array) to nodes (doc_id, node_pos, node_type, level, text).

    The path depends on the last title only, so it is computed once per title and then looked up.
    """
    up_to = Window.partitionBy("doc_id").orderBy("node_pos").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("node_type") == "title", F.struct("level", "text"))
    at_title = F.when(F.col("node_type") == "title", heading_stack(F.collect_list(title).over(up_to)))
    stamped = nodes.withColumn("title_path", at_title)
    return stamped.withColumn("section_path", F.coalesce(F.last("title_path", True).over(up_to), F.array().cast("array<string>"))).drop("title_path")


def blocks(nodes: DataFrame) -> DataFrame:
    """Adds ``block_id`` (from 0)."""
    order = Window.partitionBy("doc_id").orderBy("node_pos")
    before, size = F.lag("node_type").over(order), F.lag(F.length("text")).over(order)
    kind = F.col("node_type")
    opens = before.isNull() | ((before != "title") & (before.isin("table", "list") | (size > LONG_TEXT) | kind.isin("table", "title")))
    return nodes.withColumn("block_id", (F.sum(opens.cast("long")).over(order) - 1).cast("long"))


def block_facts(nodes: DataFrame, tokens: Column | None = None) -> DataFrame:
    """One row per block: text, path (of its last node that has one), tokens (sum over nodes), number of nodes and kinds."""
    tokens = token_count(F.col("text")) if tokens is None else tokens
    return nodes.groupBy("doc_id", "block_id").agg(
        ordered_text(F.col("text"), F.col("node_pos"), "\n").alias("text"),
        F.coalesce(F.max_by("section_path", F.when(F.size("section_path") > 0, F.col("node_pos"))), F.array().cast("array<string>")).alias("path"),
        F.sum(tokens).alias("tokens"),
        F.count("*").alias("n_nodes"),
        *[F.sum((F.col("node_type") == k).cast("long")).alias(f"n_{k}") for k in ("title", "paragraph", "table", "list")],
        F.min("node_pos").alias("first_pos"),
    )


def path_text(path: Column) -> Column:
    return F.array_join(path, PATH_JOINER)


def chunk_type() -> Column:
    """One kind: it; else table before list before mixed. From the counts of ``block_facts``."""
    kinds = ("title", "paragraph", "table", "list")
    one = F.coalesce(*[F.when(F.col(f"n_{k}") == F.col("n_nodes"), k) for k in kinds])
    return F.coalesce(one, F.when(F.col("n_table") > 0, "table"), F.when(F.col("n_list") > 0, "list"), F.lit("mixed"))


def serialised(facts: DataFrame) -> DataFrame:
    """doc_id, chunk_index (from 1), chunk_id, chunk_type, section_path, preview_text, full_text; blank blocks dropped."""
    rows = facts.withColumn("full_text", strip(F.col("text"))).where("full_text <> ''")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_id")).cast("long")
    rows = rows.withColumn("chunk_index", index).withColumn("chunk_type", chunk_type())
    return rows.select(
        "doc_id", "chunk_index", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256).alias("chunk_id"),
        "chunk_type", path_text(F.col("path")).alias("section_path"), preview(F.col("full_text")).alias("preview_text"), "full_text", "tokens",
    )


def page_list(page: Column) -> Column:
    return F.array_sort(F.collect_set(page))
