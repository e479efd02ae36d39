"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept, and all but the last return the columns of documents:

1. language  documents without a letter (``und``) go, and those of at least LEAST_LETTERS letters whose closest language has a
             cosine below LEAST_COSINE, which look like no language that was learned; hyperdimensional profiles. Where no row
             names a language nothing can be learned, and all documents with a letter stay.
2. exact     of equal texts the one with the largest doc_id stays; Grace hash.
3. near      of each class of near copies (Jaccard of word 5-grams >= 0.8) the one with the smallest doc_id stays.
4. mix       sources take turns at weights 1, 2, 3; documents of a source above its size come up to three times, the one at
             the cut is shortened to the budget.
5. pack      power-of-two pieces of at most 1024 tokens.

Nulls, empty tables, ties, very long texts and repeated rows have the results that the operators' modules state; further
columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, language, mixing, near_join, packing
from textloom.llm.runtime import column, delete, free_name, shared_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The cosine with a language that shares no n-gram is about 0.03, one by the root of the dimensions. Of the 9873 documents of
#: sf0.1 with at least so many letters none is below 0.112; shorter texts say too little.
LEAST_COSINE, LEAST_LETTERS = 0.08, 40


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    found = free_name("lang_pred", names), free_name("score", names)
    model = language.train(docs.where(~language.held_out(F.col("doc_id"), 5, 0)))
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    short = F.length(F.regexp_replace("text", r"\P{L}+", "")) < LEAST_LETTERS
    kept = (F.col(found[0]) != language.UNKNOWN) & ((F.col(found[1]) >= LEAST_COSINE) | short)
    return language.predict(docs, model, out=found).where(kept).select(*map(column, names))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs, keep_rows=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.near_dedup(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: The first and the last stage (a trained model, a tokenizer) cannot be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
        if before:  # nothing reads it any more
            delete(spark, before)
        before = f"{root}/{name}"
    return docs
