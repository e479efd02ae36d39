"""Nodes from a vision model's answers. The model is an injected callable; what surrounds it is expressions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

ANSWER = "struct<nodes:array<struct<node_type:string,text:string,level:int,bbox:array<double>,layout_role:string,`order`:int>>>"
KINDS = ("title", "paragraph", "table", "list")


def json_object(answer: Column) -> Column:
    """The fenced object if there is one, else from the first brace to the last; null without any."""
    bare = strip(answer)
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))


def answered_nodes(answers: DataFrame, keys: list[str], answer: str = "answer", page: str | None = None) -> DataFrame:
    """Keys, node_pos, node_type, level, text, bbox, layout_role, order, page_layout. Broken JSON is an error, as for a parser."""
    parsed = F.from_json(json_object(F.col(answer)), ANSWER, {"mode": "FAILFAST"})
    pages = [page] if page else []
    rows = answers.select(*keys, *pages, F.posexplode(parsed["nodes"]).alias("raw_pos", "n"))
    rows = rows.withColumn("text", strip(F.coalesce("n.text", F.lit("")))).where("text <> ''")
    kind = F.when(F.col("n.node_type").isin(*KINDS), F.col("n.node_type")).otherwise("paragraph")
    layout = F.concat(F.lit("page_"), F.col(page).cast("string")) if page else F.lit(None).cast("string")
    return rows.select(
        *keys, *pages, F.col("raw_pos").cast("long").alias("node_pos"), kind.alias("node_type"), F.greatest(F.coalesce("n.level", F.lit(0)), F.lit(0)).cast("long").alias("level"),
        "text", "n.bbox", F.nullif(F.col("n.layout_role"), F.lit("")).alias("layout_role"), F.col("n.order").alias("order"), layout.alias("page_layout"),
    )


def with_defaults(nodes: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Region metadata (bbox, layout_role, order) where the model gave none."""
    d = regions.select(*keys, F.col("bbox").alias("d_bbox"), F.col("layout_role").alias("d_role"), F.col("order").alias("d_order"))
    out = nodes.join(d, keys, "left")
    for name, default in (("bbox", "d_bbox"), ("layout_role", "d_role"), ("order", "d_order")):
        out = out.withColumn(name, F.coalesce(name, default))
    return out.drop("d_bbox", "d_role", "d_order")


def ask(images: DataFrame, model: Callable[[bytes], str], keys: list[str], content: str = "content") -> DataFrame:
    """Keys, answer, error: one call an image; a failing call becomes an error and no node."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*keys).schema.fields)

    def run(batches):
        for batch in batches:
            answers, errors = [], []
            for value in batch.column(content).to_pylist():
                try:
                    answers.append(model(value))
                    errors.append(None)
                except Exception as error:  # reported in its row
                    answers.append(None)
                    errors.append(str(error) or type(error).__name__)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*keys, "answer", "error"])

    return images.select(*keys, content).mapInArrow(run, f"{fields}, answer string, error string")


def scanned_pages(pages: DataFrame, most: int = 10) -> DataFrame:
    """The pages of a scanned document that are sent to the model."""
    return pages.where(F.col("page_no") <= most)
