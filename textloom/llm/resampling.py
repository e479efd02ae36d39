"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

The target model counts the hashed words and word pairs of documents labelled as good, the raw model those of all
documents. A document's weight is its sum of log ratios, the logarithm of how much likelier the target model makes it. Adding
Gumbel noise to the weights and keeping the largest is sampling without replacement in proportion to the exponential of the
weights. With ``temper`` the weight of a document of more n-grams is brought to that many, a tempered sum and no longer the
ratio of the models; it is off unless asked for.

The target model is fitted on at most ``TARGET_DOCS`` labelled documents, chosen by hash; that bound is also what is
broadcast. All else covers all rows. Ranks come from distributed prefix sums.

Defined results: a null or empty text has no n-gram and weight 0; a null doc_id is never labelled; identical rows have one key
and differ in rank only (ties go by the row's identity, then by where it is read); a text of any length is read whole; without
labels all weights are 0; an empty table gives no row. Other columns only take part in the row's identity, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, checkpoint, row_identity, running_sums, tidied
from .words import mix64, word_hashes

BUCKETS, TARGET_DOCS = 10_000, 50_000


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of a column of texts, and the row of each."""
    words, offsets = word_hashes(column)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    pair = mix64(words[:-1] * np.uint64(3) + words[1:]) if len(words) else words
    inside = row[:-1] == row[1:]
    hashed = np.r_[words, pair[inside]]
    return (hashed % np.uint64(BUCKETS)).astype(np.int64), np.r_[row, row[:-1][inside]]


def _totals(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            bucket, row = _features(part.column("text"))
            raw += np.bincount(bucket, minlength=BUCKETS)
            good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)
            target += np.bincount(bucket[good[row]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, target_docs: int = TARGET_DOCS) -> np.ndarray:
    """log(target / raw) of each bucket, both with one added count."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("good_id")).distinct().orderBy(F.xxhash64("good_id"), "good_id").limit(target_docs)
    marked = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    marked = marked.join(F.broadcast(good), F.col("id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("good"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in marked.mapInArrow(tidied(_totals), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > BUCKETS else np.zeros(BUCKETS)


def good_share(labels: DataFrame) -> float:
    """The share of labels that call a document good; 1 without labels."""
    found = labels.where("quality IS NOT NULL").agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
    return 1.0 if found is None else found


def _weighted(ratio: np.ndarray, temper: int | None):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                bucket, row = _features(part.column("text"))
                n = np.bincount(row, minlength=part.num_rows)
                weight = np.bincount(row, ratio[bucket], part.num_rows)
                if temper:
                    weight *= np.minimum(1, temper / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ident"), pa.array(n.astype(np.int64)), pa.array(weight)], names=["doc_id", "ident", "n_grams", "log_weight"])

    return run


def resample(docs: DataFrame, labels: DataFrame, share: float, doc_id: str = "doc_id", text: str = "text", temper: int | None = None, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, ident, n_grams, log_weight, gumbel_key, rank (1 is best), kept (``share`` of all rows)."""
    ratio = fit(docs, labels, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_identity(docs).alias("ident"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    with Scratch(docs.sparkSession) as scratch:
        weighted = rows.mapInArrow(tidied(_weighted(ratio, temper)), f"doc_id {kind}, ident string, n_grams long, log_weight double")
        uniform = (F.pmod(F.xxhash64("ident", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        keyed = weighted.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
        keyed = keyed.withColumn("salt", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long")).withColumn("all", F.lit(""))
        keyed = scratch.table(keyed, "keys")
        most = int(keyed.count() * share + 0.5)
        ranked = running_sums(scratch, keyed, "all", [F.desc("gumbel_key"), F.col("ident"), F.col("salt")], "one", "ranks")
        rank = F.col("before") + 1
        return checkpoint(ranked.select("doc_id", "ident", "n_grams", "log_weight", "gumbel_key", rank.alias("rank"), (rank <= most).alias("kept")))
