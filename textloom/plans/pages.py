"""Pages of blocks to nodes: the layout operators put together. One exchange on the page, one on the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_text
from ..operators import layout
from ..operators.lines import page_node_type
from ..sources import office


def text_nodes(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks in column order that are on no table, cleaned, typed and joined to paragraphs."""
    ordered = layout.without_overlap(layout.column_order(blocks), tables)
    ordered = ordered.withColumn("text", normal_text(F.col("text"))).where("text <> ''")
    typed = ordered.withColumn("node_type", page_node_type(F.col("text"))).withColumn("role", layout.role(F.col("y0"), F.col("y1"), F.col("page_height")))
    return layout.merged_paragraphs(typed)


def page_nodes(blocks: DataFrame, tables: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """doc_id, node_pos, node_type, level, text, source_page of all pages, in reading order, without repeated margins.

    tables and images: doc_id, page_no, box, text; images carry what a vision model read, with node_type.
    """
    cols = [*layout.PAGE, *layout.BOX]
    none = F.lit(None).cast("string")
    texts = text_nodes(blocks, tables).select(*cols, "node_type", "role", F.col("place").alias("order"), "text", F.lit(0).alias("rank"))
    parts = texts.unionByName(tables.select(*cols, F.lit("table").alias("node_type"), none.alias("role"), F.lit(0).cast("long").alias("order"), "text", F.lit(1).alias("rank")))
    if images is not None:
        parts = parts.unionByName(images.select(*cols, "node_type", none.alias("role"), F.col("order").cast("long").alias("order"), "text", F.lit(2).alias("rank")))
    far = F.lit(1e9)
    w = Window.partitionBy("doc_id").orderBy("page_no", F.coalesce("y0", far), F.coalesce("x0", far), "order", "rank")
    kept = layout.without_noise(parts.withColumn("node_pos", F.row_number().over(w) - 1))
    level = F.when(F.col("node_type") == "title", 1).otherwise(0)
    return kept.select("doc_id", "node_pos", "node_type", level.alias("level"), "text", F.col("page_no").alias("source_page"))


def plain_page_nodes(pages: DataFrame) -> DataFrame:
    """The fallback without layout: page texts (doc_id, page_no, text) cut at blank lines; no role, so repeats go anywhere."""
    parts = office.page_parts(pages).withColumn("text", normal_text(F.col("text"))).where("text <> ''")
    w = Window.partitionBy("doc_id").orderBy("page_no", "part_no")
    typed = parts.withColumn("node_pos", F.row_number().over(w) - 1).withColumn("node_type", page_node_type(F.col("text")))
    kept = layout.without_noise(typed, role_col=None)
    return kept.select("doc_id", "node_pos", "node_type", F.when(F.col("node_type") == "title", 1).otherwise(0).alias("level"), "text", F.col("page_no").alias("source_page"))
