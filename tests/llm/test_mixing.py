import random
import re
from collections import defaultdict

import pytest

from textloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(totals, weights=(1.0, 2.0, 3.0), most=3):
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    t, free = dict.fromkeys(names, 0.0), set(names)
    excess = float(sum(totals.values()))
    while excess > 1e-9 and free:
        share, excess = excess / sum(w[s] for s in free), 0.0
        for s in list(free):
            t[s] += w[s] * share
            if t[s] >= most * totals[s]:
                excess += t[s] - most * totals[s]
                t[s] = float(most * totals[s])
                free.discard(s)
    return t


def rows_of(n, seed):
    r = random.Random(seed)
    sources = ["b", "a", None, "", "ä", "z"]
    return [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 40))), sources[min(int(r.expovariate(0.6)), 5)]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_budgets(spark, seed):
    rows = [*rows_of(200, seed), (None, None, "a"), (None, "x y", None), (3, "x\ty z", "a"), (3, "x\ty z", "a")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    totals = defaultdict(int)
    for _, text, source in rows:
        totals[source] += len(WORD.findall(text or ""))
    want = targets(totals)
    by_target = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target[(r["source_size"], round(r["target"], 6))] += r["taken"]
    # a source and its target are named by its size here
    assert {(totals[s], round(want[s], 6)) for s in totals} == set(by_target)
    for (_, target), taken in by_target.items():
        assert abs(taken - target) <= 1 * len([s for s in want if round(want[s], 6) == target])


def test_reruns_agree(spark):
    df = spark.createDataFrame(rows_of(150, 3), SCHEMA)
    runs = [sorted(map(tuple, mixing.mix(df.repartition(k)).drop("ident").collect())) for k in (1, 5)]
    assert runs[0] == runs[1]


def test_sizes_count_whole_texts(spark):
    rows = [(1, "a " * 700_000, "s"), (2, "b" * 3_000_000 + " c", "s"), (3, " \n\x1c　 x", "s")]
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sizes == {k: len(WORD.findall(t)) for k, t, _ in rows}


def test_documents_of_the_mix(spark):
    rows = [(1, " one two\nthree  four five", "a"), (2, "six", "a"), (3, "b " * 30, "b"), (4, "", "b"), (5, None, None), (6, "c d", None)]
    names = "doc_id long, text string, source string, ident string, size int, taken int, copy int"
    df = spark.createDataFrame([(*r, None, 1, 2, 3) for r in rows], names)
    takes = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    words = defaultdict(int)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert dict((k, t) for k, t, _ in rows)[r["doc_id"]].startswith(r["text"])
    assert dict(words) == {k: t["taken"] for k, t in takes.items() if t["taken"]}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.mixed_documents(df).count() == 0
