import random
from math import comb

import pytest

from textloom.llm import near_join as nj

SCHEMA = "doc_id long, text string"


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, l in enumerate(links):
        for j in l:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d is None, d or 0), str(least.get(find(i))), len(links[i])) for i, (d, _) in enumerate(rows))


def got(spark, rows, **options):
    out = nj.near_join(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), str(r["class_id"]), r["n_links"]) for r in out)


def copies(seed, n_bases=8, n=90):
    r = random.Random(seed)
    bases = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([4, 6, 30, 80, 200]))] for _ in range(n_bases)]
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            words[r.randrange(len(words))] = f"x{r.randint(0, 9)}"
        if r.random() < 0.2:
            words += shared
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("tiles", [{}, {"bucket_tile": 4, "group_tile": 3}])
def test_against_brute_force(spark, tiles):
    rows = [*copies(5), (None, None), (200, ""), (201, " \n"), (202, "A b"), (203, "a B"), (204, "a b"), (203, "a B"), (None, "q r s t u v w x y z"), (205, "Q r s t u v w x y z")]
    assert got(spark, rows, **tiles) == brute(rows)


@pytest.mark.parametrize("sparse", [0, 1, 50])
def test_named_pairs_and_dense_groups_agree(spark, monkeypatch, sparse):
    """Whether pairs are named or make a dense group, every link is counted once."""
    monkeypatch.setattr(nj, "SPARSE", sparse)
    monkeypatch.setattr(nj, "PARTNERS", 3)
    rows = [*copies(9, 6, 120), (300, "A b"), (301, "a B")]
    assert got(spark, rows, bucket_tile=6, group_tile=5) == brute(rows)


def test_a_chain_of_unlike_texts_is_no_group(spark, monkeypatch):
    """Texts that each share most words with the next one: only neighbours are compared, however long the chain."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words[i * 24 : i * 24 + 120])) for i in range(100)]
    seen, kept = {}, nj.lone_pairs

    def pairs(near, groups):
        seen["pairs"], seen["dense"] = kept(near, groups).count(), groups.count()
        return kept(near, groups)

    monkeypatch.setattr(nj, "lone_pairs", pairs)
    monkeypatch.setattr(nj, "TOLERANCE", 1e-30)
    assert got(spark, rows, tolerance=1e-30) == brute(rows)
    assert 90 <= seen["pairs"] <= 400 and seen["dense"] == 0


def test_one_large_group_of_near_copies(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        words[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert got(spark, rows, bucket_tile=40, group_tile=40) == brute(rows)


def test_kept_rows_and_clashing_names(spark):
    names = "doc_id long, text string, nid int, ident int, `class` int, sig string, first string"
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text, 1, 1, 1, "a", None), (2, text + " more", None, 1, 1, "a", "b"), (1, "else", 1, 1, 1, None, None), (1, "else", 1, 1, 1, None, None), (9, None, 1, 1, 1, None, None)]
    out = nj.near_dedup(spark.createDataFrame(rows, names))
    assert out.columns == ["doc_id", "text", "nid", "ident", "class", "sig", "first"]
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 9]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_least_matches_follow_the_posterior():
    for n, m in zip(range(nj.STEP, nj.HASHES + 1, nj.STEP), nj.least_matches(0.8, 1e-6)):
        tail = lambda k: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))  # noqa: B023, E731
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


def test_long_texts_are_read_whole(spark):
    words = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(words[:200_000]))]
    assert [x[1:] for x in got(spark, rows)] == [("1", 1), ("1", 1), ("3", 0)]
