import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import class_lm as lm

SCHEMA = "doc_id long, text string"


def brute(rows):
    count, ends = Counter(), 0
    tokens = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        held = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2
        tokens.append((doc_id, held, words))
        if not held:
            count.update(words)
            ends += 1
    n = sum(count.values()) + ends
    v = len(count) + (ends > 0)
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    return sorted((repr(d), h, len(w) + 1, sum(count[x] > 0 for x in w) + (ends > 0), n, round(sum(base(count[x]) for x in w) + base(ends), 6)) for d, h, w in tokens)


def got(out):
    return sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)


@pytest.mark.parametrize("chunk", [lm.CHUNK, 50])
def test_base_counts_against_brute_force(spark, chunk):
    r = np.random.default_rng(1)
    rows = [(i, " ".join(f"W{int(x)}" for x in r.zipf(1.5, int(r.integers(0, 60))) % 500)) for i in range(120)]
    rows += [(None, None), (200, ""), (201, "x\x1cy z\tq"), (202, "same"), (202, "same"), (203, "long " * 20_000)]
    out = lm.score(spark.createDataFrame(rows, SCHEMA).repartition(3), classes=4, exchanged=40, rounds=2, chunk=chunk).collect()
    assert got(out) == brute(rows)
    assert all(x["score"] < 0 and math.isclose(x["perplexity"], 10 ** (-x["score"] / x["n_tokens"])) for x in out)


def test_slices_lose_nothing(monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 7)
    for text in (b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaa", b"ab cd\nefghijklmnop q r s  t " * 3, b" " * 30):
        parts = list(lm._slices(text))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def test_probabilities_sum_to_one():
    r = np.random.default_rng(2)
    classes = 3
    table = r.integers(1, 50, (classes + 2, classes + 2))
    model = lm.ClassModel(table, classes, 1000, 100, 40, 10)
    known = 10 ** model.moves
    unseen = 10 ** (model.unseen + np.log10(1 + 40 * 39 / 22))
    # emissions within a class sum to one, so the moves and the unseen share of each context do
    assert np.allclose(known.sum(1) + unseen, 1)


def test_classes_beat_the_base_on_unseen_texts(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        side = "ab"[i % 2]
        rows.append((i, " ".join(f"{side}{int(x) % 300}" for x in r.zipf(1.3, 60))))
    out = [x for x in lm.score(spark.createDataFrame(rows, SCHEMA), classes=8, exchanged=200).collect() if x["held_out"]]
    assert sum(x["score"] for x in out) > sum(x["base_score"] for x in out) + 0.1 * sum(x["n_tokens"] for x in out)


def test_empty_and_clashing(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(held, "only held", 1, "x")]
    out = lm.score(spark.createDataFrame(rows, SCHEMA + ", chunk int, word string")).collect()
    assert [(x["n_known"], x["train_tokens"], x["base_score"]) for x in out] == [(0, 0, 0.0)]


def test_words_beyond_the_first_ones_are_exchanged_too(spark):
    r = np.random.default_rng(4)
    # words of four kinds follow each other in turn; six words alone are too few to tell all four
    rows = [(i, " ".join("of" if r.random() < 0.1 else f"{'abcd'[j % 4]}{int(r.integers(60))}" for j in range(80))) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    few, many = (sum(x["score"] for x in lm.score(docs, classes=6, exchanged=n).collect() if x["held_out"]) for n in (6, 400))
    assert few > 1.02 * many


def brute_score(rows, classes, exchanged, rounds):
    """The whole method by loops over tokens: log10 probability of every text."""
    texts = [(zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2, (t or "").encode().lower().split()) for d, t in rows]
    training = [words for held, words in texts if not held]
    n = Counter(w for words in training for w in words)
    top = sorted(n, key=lambda w: (-n[w], w))[:exchanged]
    END, RARE = classes, classes + 1

    def around(of):
        """Of every word, how often each state is before and after it."""
        found = {w: (np.zeros(classes + 2), np.zeros(classes + 2)) for w in n}
        for words in training:
            states = [END, *(of(w) for w in words), END]
            for i, w in enumerate(words):
                found[w][0][states[i]] += 1
                found[w][1][states[i + 2]] += 1
        return found

    def pairs(of):
        moves = np.zeros((classes + 2, classes + 2))
        for words in training:
            states = [END, *(of(w) for w in words), END]
            for a, b in zip(states, states[1:]):
                moves[a, b] += 1
        return moves

    def level(moves):
        x, r, c = (v[v > 0] for v in (moves, moves.sum(1), moves.sum(0)))
        return ((x * np.log(x)).sum() - (r * np.log(r)).sum() - (c * np.log(c)).sum()) / max(moves.sum(), 1)

    def best(found, words, came, went, states):
        lb, la = (np.log((m[states] + 0.5) / (m[states] + 0.5).sum(0)) for m in (came, went))
        return {w: int(np.argmax(found[w][0][states] @ lb + found[w][1][states] @ la)) for w in words}

    now, kept = {w: i if i < classes else RARE for i, w in enumerate(top)}, None
    everything = list(range(classes + 2))
    for turn in range(rounds + 1):
        of = lambda w: now.get(w, RARE)  # noqa: B023, E731
        moves, found = pairs(of), around(of)
        if kept and turn > 1 and level(moves) <= kept[0]:
            break
        came, went = np.zeros((classes + 2, classes)), np.zeros((classes + 2, classes))
        for w in top:
            if now[w] < classes:
                came[:, now[w]] += found[w][0]
                went[:, now[w]] += found[w][1]
        kept = level(moves), now, found, came, went
        moved = best(found, top, came, went, everything)
        if moved == now:
            break
        now = moved
    _, now, found, came, went = kept
    of_all = {**best(found, [w for w in n if w not in now], came, went, everything), **now}
    kept = None
    while True:
        moves, found = pairs(of_all.__getitem__), around(of_all.__getitem__)
        if kept and level(moves) - kept[0] < lm.GAIN:
            kept = max(kept, (level(moves), of_all), key=lambda k: k[0])
            break
        kept = level(moves), of_all
        if not n:
            break
        of_all = best(found, list(n), moves[:, :classes], moves[:classes].T, everything[: classes + 1])
    of_all = kept[1]
    # the model
    UNSEEN, table, singles = classes + 1, np.zeros((classes + 2, classes + 1)), np.zeros(classes + 2)
    for words in training:
        before, once = END, False
        for w in [*words, None]:
            state = END if w is None else of_all[w]
            for context in [before] + [UNSEEN] * once:
                table[context, state] += 1
                singles[context] += w is not None and n[w] == 1
            before, once = state, w is not None and n[w] == 1
    once, twice = sum(c == 1 for c in n.values()), sum(c == 2 for c in n.values())
    tokens = sum(n.values()) + len(training)
    sizes = table[:UNSEEN].sum(0)
    share = np.array([s + 1 if s or not sizes.sum() else 0 for s in sizes])
    share = share / share.sum()
    total = table.sum(1)
    out = []
    for _, words in texts:
        before, sum_ = END, 0.0
        for w in [*words, None]:
            u = (singles[before] + lm.SMOOTH_UNSEEN * (once + 0.5) / (tokens + 1)) / (total[before] + lm.SMOOTH_UNSEEN)
            u = min(u, 0.999999)
            if w is None or w in n:
                state = END if w is None else of_all[w]
                p = (1 - u) * (table[before, state] + lm.SMOOTH_CLASS * share[state]) / (total[before] + lm.SMOOTH_CLASS)
                p *= 1 if w is None else n[w] / sizes[state]
                before = state
            else:
                p = u / (1 + once * max(once - 1, 0) / (2 * (twice + 1)))
                before = UNSEEN
            sum_ += math.log10(p)
        out.append(sum_)
    return out


@pytest.mark.parametrize(("exchanged", "chunk"), [(30, lm.CHUNK), (30, 25), (1000, 60), (3, 1000)])
def test_scores_against_brute_force(spark, exchanged, chunk):
    r = np.random.default_rng(8)
    rows = [(i, " ".join(f"{'abc'[(j + i) % 3]}{int(x) % 90}" for j, x in enumerate(r.zipf(1.4, int(r.integers(0, 70)))))) for i in range(90)]
    rows += [(None, None), (300, "a1 never seen b2"), (301, "same Same a1"), (301, "same Same a1")]
    out = lm.score(spark.createDataFrame(rows, SCHEMA).repartition(3), classes=5, exchanged=exchanged, rounds=3, chunk=chunk).collect()
    want = sorted((repr(d), round(x, 6)) for (d, _), x in zip(rows, brute_score(rows, 5, exchanged, 3)))
    assert sorted((repr(x["doc_id"]), round(x["score"], 6)) for x in out) == want


def test_an_empty_class_takes_no_probability():
    r = np.random.default_rng(9)
    table = r.integers(1, 50, (5, 5))
    table[:, 1] = table[1] = 0
    model = lm.ClassModel(table, 3, 1000, 100, 40, 10)
    known = 10 ** model.moves[:, [0, 2, 3]]
    assert np.allclose(known.sum(1) + 10 ** (model.unseen + np.log10(1 + 40 * 39 / 22)), 1)


def test_a_task_of_too_many_chunks_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(lm, "TURNS", 1)

    class Task:
        @staticmethod
        def get():
            return Task()

        def partitionId(self):
            return 0

    monkeypatch.setattr(lm, "TaskContext", Task)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([False] * 9), pa.array(["a b c d"] * 9)], names=["doc_id", "held", "text"])
    with pytest.raises(ValueError, match="chunks"):
        list(lm._coded(5, 4)(iter([batch])))


def test_long_texts_are_cut_with_context(monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task()

        def partitionId(self):
            return 0

    monkeypatch.setattr(lm, "TaskContext", Task)
    monkeypatch.setattr(lm, "SLICE", 40)
    long = " ".join(f"w{i}" for i in range(100))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([False] * 3), pa.array(["x y", long, "z"])], names=["doc_id", "held", "text"])
    seen = []
    for row in lm._rows(lm._coded(7, 4)(iter([batch]))):
        words = lm._strings(row["words"], lm._unpacked(row["wlens"], "<i4")).to_pylist()
        numbers, _, _, counted = lm._stream(row, np.zeros(len(words), np.int64), 1, True)
        seen += [b"END" if k < 0 else words[k] for k, c in zip(numbers, counted) if c]
        assert sum(counted) <= 8 and row["head"] + row["tail"] == (~counted).sum()
        assert lm._unpacked(row["counts"], "<i4").sum() == sum(counted & (numbers >= 0))
    assert seen == [b"x", b"y", b"END", *(b"w%d" % i for i in range(100)), b"END", b"z", b"END"]
