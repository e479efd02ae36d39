"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums, exact cuts.

Sources (null last) take the weights in turn; their targets share the total size and stop at ``most_repeats`` times the
source, the excess going to the others by weight. Every source is cut at its budget (the target rounded to a whole word):
whole passes over the source first, then the documents in key order until the budget is met, the last one in part.

Defined results: null texts have size 0 and take nothing; identical rows are interchangeable and each counted; a source of
size 0 has target 0; an empty table gives no row; a text of any length is counted in windows. Keys are hashes of the whole
row, so reruns agree; rows of equal keys are equal rows, ordered as they are read (ties). Other columns only take part in
the key, whatever their names. Weights are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import pyarrow as pa

from .runtime import Scratch, checkpoint, column, free_name, row_identity, running_sums, tidied
from .words import word_counts

WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS = 3


def sized(rows: DataFrame, text: str) -> DataFrame:
    """Replaces ``text`` by ``size``, its number of words."""
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != text], T.StructField("size", T.LongType())])

    def count(batches):
        for batch in batches:
            kept = [batch.column(n) for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(word_counts(batch.column(text)))], names=schema.names)

    return rows.mapInArrow(tidied(count), schema)


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """Per source: source_size, target. Water-filling by prefix sums over the source table, however many sources there are."""
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("one", F.lit(1).cast("long")).withColumn("all", F.lit(""))
    ranked = running_sums(scratch, totals, "all", [F.col("source")], "one", "ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    table = scratch.table(ranked.select("source", "source_size", weight.alias("weight")), "targets")
    # the level at which the sources with the lowest caps a weight are full and the others share what is left, for each number of full ones
    cap = F.col("source_size") * F.lit(float(most))
    shares = table.select("*", F.lit("").alias("all"), cap.alias("cap"), (cap / F.col("weight")).alias("full"))
    held = running_sums(scratch, shares, "all", [F.col("full"), F.col("source")], "cap", "held").withColumnRenamed("before", "held")
    lighter = running_sums(scratch, held, "all", [F.col("full"), F.col("source")], "weight", "lighter")
    whole = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = lighter.agg(F.max((F.lit(float(whole["size"] or 0)) - F.col("held")) / (F.lit(float(whole["weight"] or 0)) - F.col("before")))).first()[0]
    return table.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level or 0.0)).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, ident, size, source_size, target, taken."""
    named = F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))
    ident = row_identity(docs)
    rows = docs.select(F.col(doc_id).alias("doc_id"), named.alias("source"), F.col(text).cast("string").alias("text"), ident.alias("ident"))
    with Scratch(docs.sparkSession) as scratch:
        sizes = scratch.table(sized(rows, "text"), "sizes")
        targets = source_targets(scratch, sizes, weights, most_repeats)
        keyed = sizes.withColumn("key", F.md5(F.concat("ident", F.lit(str(seed))))).withColumn("salt", F.monotonically_increasing_id())
        placed = running_sums(scratch, keyed, "source", [F.col("key"), F.col("ident"), F.col("salt")], "size", "placed")
        budget = F.floor(F.col("target") + 0.5).cast("long")
        passes = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
        rest = budget - passes * F.col("source_size")
        part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
        joined = placed.join(targets, "source")
        return checkpoint(joined.select("doc_id", "ident", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document once for every whole pass and, where the budget ends, in part."""
    takes = mix(docs, doc_id, text, source, **options)
    takes = takes.groupBy("ident").agg(F.sum("taken").alias("taken"), F.max("size").alias("size")).where("taken > 0")
    key, size, taken, copy = (free_name(n, docs.columns) for n in ("ident", "size", "taken", "copy"))
    takes = takes.select(F.col("ident").alias(key), F.col("size").alias(size), F.col("taken").alias(taken))
    named = docs.withColumn(key, row_identity(docs)).join(takes, key).dropDuplicates([key])
    turns = F.ceil(F.col(taken) / F.col(size)).cast("int")
    copies = named.withColumn(copy, F.explode(F.sequence(F.lit(1), turns)))
    left = F.col(taken) - (F.col(copy) - 1) * F.col(size)
    return copies.withColumn(text, F.when(left >= F.col(size), F.col(text)).otherwise(first_words(F.col(text), left))).select(*map(column, docs.columns))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its first n words."""
    blank = r"[\x20\x09-\x0D]+"
    part = (n + F.when(text.rlike("^" + blank), 2).otherwise(1)).cast("int")
    rest = F.element_at(F.split(text, blank, part), -1)
    return F.regexp_replace(F.left(text, F.length(text) - F.length(rest)), blank + "$", "")
