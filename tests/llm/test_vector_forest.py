import numpy as np
import pytest

from textloom.llm import vector_forest as vf

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    n = len(rows)
    links = [set() for _ in range(n)]
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and None not in v and np.isfinite(v).all() and any(v)
        unit.append(np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float)) if ok else None)
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93:
                links[i].add(j)
                links[j].add(i)
    return links


def test_exact_links_in_small_labels(spark):
    r = np.random.default_rng(1)
    centre = r.standard_normal((5, 16))
    rows = [(i, [float(x) for x in centre[i % 5] + r.standard_normal(16) * 0.25], i % 3) for i in range(120)]
    rows += [(500 + i, rows[7][1], rows[7][2]) for i in range(4)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [float("nan")] * 16, 1), (604, [1.0, None], 1), (605, rows[7][1], None), (606, [1.0, 2.0], 1), (607, [1e-30, 2e-30], 1), (None, rows[7][1], rows[7][2])]
    links = brute(rows)
    got = {r["vec_id"]: r for r in vf.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=16).collect()}
    assert {k: v["n_links"] for k, v in got.items()} == {row[0]: len(links[i]) for i, row in enumerate(rows)}
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        assert got[row[0]]["component_id"] == min(ids, default=None)
        assert got[row[0]]["kept"] == (got[row[0]]["component_id"] == row[0])


@pytest.mark.parametrize("dense", [False, True])
def test_recall_of_the_forest(spark, dense):
    r = np.random.default_rng(2)
    base = r.standard_normal((1 if dense else 400, 32))
    rows = []
    for i in range(800):
        v = base[i % len(base)] + r.standard_normal(32) * 0.2
        rows.append((i, [float(x) for x in v], 0))
    links = brute(rows)
    total = sum(map(len, links))
    got = vf.near_vectors(spark.createDataFrame(rows, SCHEMA), leaf=64, tile=100).collect()
    found = sum(x["n_links"] for x in got)
    assert 0.97 * total <= found <= total
    assert all(x["n_links"] <= len(links[x["vec_id"]]) for x in got)


def test_leaves_are_split_again_until_they_are_small(spark, monkeypatch):
    """With a small sample for the first trees, leaves of any number of nodes come down to the tile, and recall holds."""
    r = np.random.default_rng(6)
    base = r.standard_normal((1500, 24))
    twins = base[:500] + r.standard_normal((500, 24)) * 0.2
    every = np.concatenate([base, twins])
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(every)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(vf, "SAMPLE_BYTES", 64 * 24 * 8)
    monkeypatch.setattr(vf, "LEAF_SAMPLE", 200)
    fit = vf.fit
    monkeypatch.setattr(vf, "fit", lambda nodes, trees, leaf, spill: fit(nodes, trees, leaf, spill, vf.SAMPLE_BYTES))
    sizes, refined = [], vf.refined

    def kept(scratch, routed, *rest):
        out = scratch.table(refined(scratch, routed, *rest), "kept")
        for x in (routed, out):
            sizes.append([n for (n,) in x.groupBy("leaf").count().select("count").collect()])
        return out

    monkeypatch.setattr(vf, "refined", kept)
    unit = every.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    total = int((unit @ unit.T >= 0.93).sum()) - len(unit)
    found = sum(x["n_links"] for x in vf.near_vectors(df, leaf=64, tile=128).collect())
    assert total > 600 and 0.97 * total <= found <= total
    assert max(sizes[0]) > 600 and max(sizes[1]) <= 128


def test_hot_leaves_are_routed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vf, "ROUTED", 50)
    r = np.random.default_rng(7)
    base = r.standard_normal((150, 16))
    rows = [(i, [float(x) for x in base[i % 150] + r.standard_normal(16) * 0.1], 0) for i in range(600)]
    links = brute(rows)
    found = {x["vec_id"]: x["n_links"] for x in vf.near_vectors(spark.createDataFrame(rows, SCHEMA), leaf=32, tile=60, trees=8).collect()}
    assert sum(found.values()) >= 0.97 * sum(map(len, links)) and all(n <= len(links[i]) for i, n in found.items())


def test_empty_table_and_clashing_names(spark):
    assert vf.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 5, "x")], SCHEMA + ", nid int, node string")
    assert vf.near_vectors(df).collect()[0]["component_id"] == 1
