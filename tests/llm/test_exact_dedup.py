import hashlib
import random
from collections import defaultdict

import pytest

from textloom.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string"


def lower(t):
    return (t or "").encode().lower().decode()


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        for k, i in enumerate(ids):
            out.append((i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(repr, out))


def got(spark, rows, **options):
    df = ed.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("memory", [ed.MEMORY_BYTES, 300])
def test_against_brute_force(spark, memory):
    r = random.Random(1)
    texts = ["", None, "ß", "SS", "É", "é", "a" * 50_000] + [f"Text {i % 40}" for i in range(60)]
    rows = [(i, r.choice(texts)) for i in range(300)] + [(None, "text 1"), (None, None), (7, "TEXT 1"), (7, "text 1"), (7, "text 1")]
    assert got(spark, rows, memory_bytes=memory) == brute(rows)


@pytest.mark.parametrize("fan", [2, 5])
def test_a_text_with_many_leaders_is_merged_in_rounds(spark, fan):
    rows = [(i, "hot text" if i % 3 else f"text {i % 7}") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(23)
    out = ed.exact_dedup(df, local_bytes=0, memory_bytes=2000, fan=fan)
    assert sorted(repr(tuple(r)) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == brute(rows)


def test_full_local_tables_keep_what_repeats():
    local = ed.LocalLeaders(0, 3000)
    led = [local.lead(t, ed.digest(t)) for t in [b"hot" if i % 5 == 0 else b"cold%d" % i for i in range(100)]]
    assert led == [(i, 0 if i % 5 == 0 else i) for i in range(100)] and local.table.held <= 3000 + 300


def test_empty_table(spark):
    assert got(spark, []) == []


def test_grace_splits_and_compares_contents():
    contents = [f"c{i % 50}".encode() * 20 for i in range(400)]
    for hasher in (ed.digest, lambda c: b"\0" * 32, lambda c: bytes([len(c)] * 32)):
        classes = sorted(sorted(c) for c in ed.grace(iter(enumerate(contents)), 500, hasher))
        assert classes == sorted([k for k in range(400) if k % 50 == m] for m in range(50))


def test_kept_rows_with_clashing_names(spark):
    names = "doc_id long, text string, kept string, leader string, `class` string, ident string, Grace_UID int, n double"
    rows = [(1, "A", None, "x", "y", "z", 1, 2.0), (2, "a", "k", None, "y", "z", 1, 2.0), (2, "a", "k", None, "y", "z", 1, 2.0), (None, None, None, None, None, None, None, None)]
    out = ed.exact_dedup(spark.createDataFrame(rows, names), keep_rows=True)
    assert out.columns == ["doc_id", "text", "kept", "leader", "class", "ident", "Grace_UID", "n"]
    assert sorted(repr(tuple(r)) for r in out.collect()) == sorted(map(repr, [rows[1], rows[3]]))
