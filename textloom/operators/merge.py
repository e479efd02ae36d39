"""Merging of short blocks: a fold over each document's blocks with a state of scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import ChunkOptions

FACTS = ("path", "tokens", "n_nodes", "n_title", "n_paragraph", "n_table", "n_list")


def merge_type(b: Column) -> Column:
    """Several paragraphs are mixed here, one is a paragraph."""
    alone = F.coalesce(*[F.when(b[f"n_{k}"] == 1, k) for k in ("title", "paragraph", "table", "list")])
    return (
        F.when(b["n_nodes"] == 1, alone).when(b["n_title"] == b["n_nodes"], "title")
        .when(b["n_table"] > 0, "table").when(b["n_list"] > 0, "list").otherwise("mixed")
    )


def mergeable(left: Column, right: Column, options: ChunkOptions) -> Column:
    a, b = merge_type(left), merge_type(right)
    lone_titles = (left["n_title"] == left["n_nodes"]) & (b != "title")
    barred = (a == "title") | (b == "title")
    for x, y in (("table", "paragraph"), ("table", "list")):
        barred = barred | ((a == x) & (b == y)) | ((a == y) & (b == x))
    short = (right["tokens"] < options.min_tokens) & (left["tokens"] + right["tokens"] <= options.max_tokens)
    return (left["path"] == right["path"]) & (lone_titles | (~barred & short))


def merge_groups(facts: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """doc_id, block_id, group_id (from 0): blocks of a group are merged. ``path`` is a string here."""
    fact = F.struct("block_id", *FACTS)
    docs = facts.groupBy("doc_id").agg(F.array_sort(F.collect_list(fact)).alias("blocks"))
    state = "struct<path:string,tokens:bigint,n_nodes:bigint,n_title:bigint,n_paragraph:bigint,n_table:bigint,n_list:bigint>"

    def step(acc: Column, b: Column) -> Column:
        now = acc["now"]
        joins = now["path"].isNotNull() & mergeable(now, b, options)
        summed = [(now[c] + b[c]).alias(c) for c in FACTS[1:]]
        # joined blocks share a path, so the path of what has been joined stays
        grown = F.when(joins, F.struct(now["path"].alias("path"), *summed)).otherwise(F.struct(*[b[c].alias(c) for c in FACTS]))
        group = F.when(joins, acc["group"]).otherwise(acc["group"] + 1)
        return F.struct(grown.cast(state).alias("now"), group.alias("group"), F.concat(acc["out"], F.array(F.struct(b["block_id"].alias("block_id"), group.alias("group_id")))).alias("out"))

    start = F.struct(F.lit(None).cast(state).alias("now"), F.lit(-1).cast("long").alias("group"), F.array().cast("array<struct<block_id:bigint,group_id:bigint>>").alias("out"))
    folded = F.aggregate("blocks", start, step, lambda acc: acc["out"])
    return docs.select("doc_id", F.inline(folded))


def merged(facts: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """One row per merged block, in the columns of ``block_facts`` with a text path; block_id is the group's number."""
    rows = facts.join(merge_groups(facts, options), ["doc_id", "block_id"])
    return rows.groupBy("doc_id", F.col("group_id").alias("block_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("block_id").alias("o"), "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.min("path").alias("path"),
        *[F.sum(c).cast("long").alias(c) for c in FACTS[1:]],
    )
