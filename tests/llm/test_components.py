import random

import pytest

from textloom.llm import components as cc
from textloom.llm.runtime import Scratch


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in root if find(x) != x}


@pytest.mark.parametrize("hot", [1, 64])
def test_components_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(cc, "LEAST_HOT", hot)
    r = random.Random(hot)
    edges = [(i, i + 1) for i in range(100, 130)] + [(500, 501 + i) for i in range(300)] + [(900 + i, 899) for i in range(40)] + [(7, 7), (1, 2), (2, 1)]
    edges += [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(60)]
    r.shuffle(edges)
    with Scratch(spark) as scratch:
        got = cc.components(scratch, spark.createDataFrame(edges, "a long, b long").repartition(3), "t").collect()
        assert {tuple(x) for x in got} == brute(edges) and len(got) == len(brute(edges))
        assert cc.components(scratch, spark.createDataFrame([], "a long, b long"), "e").count() == 0


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(cc, "LEAST_HOT", 5)
    rows = [(k, i) for k, n in ((1, 400), (2, 3), (3, 30), (None, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v long")
    keys = spark.createDataFrame([(1, "a", 400), (2, "b", 3), (3, "c", 30)], "k long, w string, n long")
    got = cc.spread_join(df, keys, "k", len(rows)).select("k", "v", "w").collect()
    names = {1: "a", 2: "b", 3: "c"}
    assert sorted(map(tuple, got)) == sorted((k, v, names[k]) for k, v in rows if k)
