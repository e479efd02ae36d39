"""Boundary refinement between neighbouring blocks: the rule gate, similarity, decisions and their counts."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import BoundaryOptions, ChunkOptions
from . import kernel

DECISION = "struct<merge:boolean,strategy:string,similarity_score:double>"


def cosine(a: Column, b: Column) -> Column:
    """Null where the lengths differ, a vector is empty or has no length: what a scorer would reject."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot / norms)


def gate(left: str, right: str, options: ChunkOptions = ChunkOptions()) -> Column:
    """No title or table on either side, one section path, a token sum within the budget."""
    l, r = (lambda c: F.col(f"{left}{c}")), (lambda c: F.col(f"{right}{c}"))
    plain = (l("n_title") == 0) & (r("n_title") == 0) & (l("n_table") == 0) & (r("n_table") == 0)
    return plain & (l("path") == r("path")) & (l("tokens") + r("tokens") <= options.max_tokens)


def decision(passes: Column, score: Column, says_merge: Column, bounds: BoundaryOptions = BoundaryOptions()) -> Column:
    """The cascade: rules, then similarity (a null score is a failed scorer), then the decider's word."""
    kept = F.round(score, 4)
    word = F.coalesce(says_merge, F.lit(False))

    def of(merge, strategy: str, value: Column | None = None) -> Column:
        merge = merge if isinstance(merge, Column) else F.lit(merge)
        return F.struct(merge.alias("merge"), F.lit(strategy).alias("strategy"), (F.lit(None) if value is None else value).cast("double").alias("similarity_score"))

    if not bounds.similarity:
        rest = F.when(word, of(True, "llm_only")).otherwise(of(False, "rule_keep")) if bounds.llm else of(False, "rule_keep")
    else:
        failed = of(word, "llm_fallback") if bounds.llm else of(False, "rule_block")
        gray = of(word, "llm_gray", kept) if bounds.llm else of(False, "similarity_gray_keep", kept)
        rest = F.when(score.isNull(), failed).when(score >= bounds.high, of(True, "similarity_high", kept)).when(score <= bounds.low, of(False, "similarity_low", kept)).otherwise(gray)
    return F.when(F.coalesce(passes, F.lit(False)), rest).otherwise(of(False, "rule_block"))


def neighbours(blocks: DataFrame, columns: list[str], order: str = "block_id") -> DataFrame:
    """Each block but the first with the columns of the one before, as prev_*."""
    w = Window.partitionBy("doc_id").orderBy(order)
    before = [F.lag(c).over(w).alias(f"prev_{c}") for c in columns]
    return blocks.select("*", *before, (F.row_number().over(w) > 1).alias("has_prev")).where("has_prev").drop("has_prev")


def decide_with_model(pairs: DataFrame, passes: Column, asks: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Runs a model on the pairs that need it only.

    ``asks`` gets the pairs past the gate and adds ``score`` and ``says_merge``; the others are joined back untouched, as
    Spark may evaluate a Python function on every branch of a CASE.
    """
    asked = asks(pairs.where(passes)).select(*keys, "score", "says_merge")
    return pairs.join(asked, keys, "left")


FOLDED = "doc_id {kind}, block_id long, group_id long, merge boolean, strategy string, similarity_score double, merge_strategy string, merge_score double"


def fold(blocks: DataFrame, options: ChunkOptions = ChunkOptions(), bounds: BoundaryOptions = BoundaryOptions(), count: kernel.Counter = kernel.estimate, scorer: kernel.Scorer | None = None, decider: kernel.Decider | None = None) -> DataFrame:
    """Neighbours joined from the left, later decisions seeing what was joined, of (doc_id, block_id, node_type, text, path).

    One row a block: its group (from 0), the decision about it (null for a document's first) and what the group's nodes carry: the
    strategy of its last merge and the last score of one. One exchange on the document.
    """
    kind = blocks.schema["doc_id"].dataType.simpleString()
    block = F.struct(F.col("block_id").cast("long").alias("block_id"), "node_type", "text", F.coalesce("path", F.lit("")).alias("path"))
    docs = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    names = ["block_id", "group_id", "merge", "strategy", "similarity_score", "merge_strategy", "merge_score"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.string(), pa.float64()]

    def rows(found: list[dict]) -> list[tuple]:
        one = [[kernel.Node(b["node_type"], b["text"] or "", path=(b["path"],) if b["path"] else ())] for b in found]
        done = kernel.refined(one, options, bounds, count, scorer, decider)
        decisions = [(None, None, None), *done.decisions]
        groups = [k - 1 for k in itertools.accumulate((not merge for merge, *_ in decisions), initial=0)][1:]
        return [(b["block_id"], g, *d, done.blocks[g][0].strategy, done.blocks[g][0].score) for b, g, d in zip(found, groups, decisions)]

    def run(batches):
        for batch in batches:
            for i, found in enumerate(batch.column("blocks").to_pylist()):
                columns = list(zip(*rows(found)))
                ids = batch.column("doc_id").take(pa.array([i] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])

    return docs.mapInArrow(run, FOLDED.format(kind=kind))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """strategy, result (merge or keep), n."""
    result = F.when(F.col("merge"), "merge").otherwise("keep")
    return decisions.groupBy("strategy", result.alias("result")).agg(F.count("*").alias("n"))
