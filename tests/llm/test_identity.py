import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, mixing, near_join, runtime

MARKS = [None, "", "\x01", "\x02", "a", "a\x01b", "b\x01c", "c", "-", "1:a", "1:", "0:", "2:\x01"]


def test_distinct_rows_have_distinct_identities(spark):
    rows = list(itertools.product(MARKS, MARKS))
    df = spark.createDataFrame(rows, "x string, `y.z` string")
    assert df.select(runtime.row_identity(df).alias("i")).distinct().count() == len(rows)


def test_nested_binary_and_time_columns(spark):
    rows = [(["a, b"], bytearray(b"x"), None, {"k": "v"}), (["a", "b"], bytearray(b"x"), None, {"k": "v"}), (None, None, datetime.datetime(2020, 1, 1), None), (["a", None], bytearray(b""), None, None), (["a", "null"], bytearray(b""), None, None)]
    df = spark.createDataFrame(rows, "a array<string>, `b``c` binary, t timestamp, m map<string,string>")
    assert df.select(runtime.row_identity(df).alias("i")).distinct().count() == len(rows)


@pytest.mark.parametrize("swap", [("a\x01b", "c", "a", "b\x01c"), (None, "x", "\x02", "x"), ("x", None, "x", ""), ("\x01", "", "", "\x01"), ("1:a", "b", "1", ":a1:b")])
def test_no_operator_confuses_rows(spark, swap):
    text, source, other_text, other_source = swap
    names = "doc_id long, text string, source string, `Source_` string, ident string, grace_uid int"
    rows = [(1, text, source, None, "i", 1), (1, other_text, other_source, None, "i", 1), (2, "of their own words", None, "\x02", None, None)]
    df = spark.createDataFrame(rows, names).repartition(2)
    lower = {(r[1] or "").lower() for r in rows}
    assert {(r["text"] or "").lower() for r in exact_dedup.exact_dedup(df, keep_rows=True).collect()} == lower
    near = [tuple(r) for r in near_join.near_dedup(df).collect()]
    words = {tuple((r[1] or "").split()) for r in rows}
    assert {tuple((r[1] or "").split()) for r in near} == words
    # weights and sizes as they are, every row that has words is named by some take of its own
    takes = mixing.mix(df).groupBy("ident").agg(F.sum("taken").alias("taken")).where("taken > 0").count()
    mixed = {tuple(r)[1:3] for r in mixing.mixed_documents(df).collect()}
    assert len(mixed) == takes and all(any(s == r[2] and (r[1] or "").startswith(t) for r in rows) for t, s in mixed)


def test_rows_named_keeps_one_of_identical_rows(spark):
    rows = [("a\x01b", "c"), ("a", "b\x01c"), ("a", "b\x01c"), (None, "x"), ("\x02", "x")]
    df = spark.createDataFrame(rows, "text string, ident string")
    idents = df.select(runtime.row_identity(df).alias("ident"))
    assert sorted(map(repr, map(tuple, runtime.rows_named(df, idents).collect()))) == sorted(map(repr, set(rows)))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf(dict):
        pass

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_folder(Session())
