import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import licences, resampling, sharding, words


def test_words_and_hashes(monkeypatch):
    texts = ["", None, "a b", "A  B\n", "x\x1cy z", "é É", "w" * 500, "a b" * 300, "  　"]
    want = [(t or "").encode().lower().split() for t in texts]
    for window in (words.WINDOW, 16):
        monkeypatch.setattr(words, "WINDOW", window)
        monkeypatch.setattr(words.windows, "__defaults__", (window,))
        column = pa.array(["zz", *texts])[1:]
        assert words.word_counts(column).tolist() == list(map(len, want))
        hashes, offsets = words.word_hashes(column)
        flat = [w for ws in want for w in ws]
        assert np.diff(offsets).tolist() == list(map(len, want))
        assert len({(h, w) for h, w in zip(hashes.tolist(), flat)}) == len(set(flat)) == len(set(hashes.tolist()))


# -- sharding ---------------------------------------------------------------------------------------------------------


def test_table_is_balanced_and_stable():
    names = sharding.shard_names(8)
    table = sharding.fill(names, 509)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.fill(names[:-1], 509)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 7)
    assert moved < 0.2 * 509
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.fill(shards, slots)


def test_turns_claim_the_first_free_slot():
    names, slots = ["a", "b", "c"], 13
    orders = [[(sharding._number(f"{s}:offset") + k * (sharding._number(f"{s}:skip") % 12 + 1)) % 13 for k in range(13)] for s in names]
    owner = [-1] * slots
    for turn in range(slots):
        owner[next(x for x in orders[turn % 3] if owner[x] < 0)] = turn % 3
    assert owner == sharding.fill(names, slots)


def test_placement(spark, tmp_path):
    rows = [(1, "x"), (None, "y"), (None, None), (1, "x"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.place(df, "doc_id", ["a", "b", "c"], 13).collect()
    assert len(out) == 5 and len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    assert sharding.place(df.limit(0), "doc_id", ["a"], 13).count() == 0
    with pytest.raises(ValueError):
        sharding.place(df.withColumn("Shard", F.lit(1)), "doc_id", ["a"], 13)
    sharding.write_shards(df, "doc_id", ["a", "b", "c"], str(tmp_path / "s"), 13)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 5


# -- resampling -------------------------------------------------------------------------------------------------------


def test_weights_ranks_and_share(spark):
    good, bad = "the cat sat on the mat", "zq$$ zq$$ xx## zq$$"
    rows = [(i, f"{good if i % 2 else bad} n{i}") for i in range(200)] + [(None, None), (300, ""), (301, good), (301, good), (302, good * 30_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rank string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (1, 1)], "doc_id long, quality int")
    out = resampling.resample(docs, labels, share=0.5).collect()
    assert sorted(r["rank"] for r in out) == list(range(1, len(rows) + 1))
    assert sum(r["kept"] for r in out) == int(len(rows) * 0.5 + 0.5)
    by_key = sorted(out, key=lambda r: -r["gumbel_key"])
    assert [r["gumbel_key"] for r in sorted(out, key=lambda r: r["rank"])] == [r["gumbel_key"] for r in by_key]
    weights = {r["doc_id"]: r["log_weight"] for r in out}
    assert weights[300] == 0 and weights[None] == 0
    assert min(weights[i] for i in range(1, 200, 2)) > max(weights[i] for i in range(0, 200, 2))


def test_weight_is_the_ratio_of_the_models(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c c c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    ratio = resampling.fit(docs, labels, "doc_id", "text")
    bucket = lambda t: resampling._features(pa.array([t]))[0]
    raw, target = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    for t in ("a b a", "b c", "c c c"):
        np.add.at(raw, bucket(t), 1)
    np.add.at(target, bucket("a b a"), 1)
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    out = {r["doc_id"]: r["log_weight"] for r in resampling.resample(docs, labels, 1.0).collect()}
    assert np.isclose(out[2], ratio[bucket("b c")].sum())


def test_resampling_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["log_weight"] for r in resampling.resample(docs, labels, 0.5).collect()} == {0.0}
    assert resampling.resample(docs.limit(0), labels, 0.5).count() == 0
    assert resampling.good_share(labels) == 1.0


def test_long_texts_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(x) % 40}" for x in r.zipf(1.4, int(r.integers(1, 900))))) for i in range(60)] + [(None, None), (60, "")]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, log_weight string").repartition(3)
    labels = spark.createDataFrame([(i, (i + 1) % 2, None) for i in range(40)] + [(41, None, None)], "doc_id long, quality int, text string")

    def grams(text):
        own = words.word_hashes(pa.array([text or ""]))[0]
        pairs = words.mix64(own[:-1] * np.uint64(3) + own[1:]).tolist() if len(own) else []
        return [int(h) % resampling.BUCKETS for h in [*own, *pairs]]

    raw, target = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    for i, text in rows:
        for g in grams(text):
            raw[g] += 1
            target[g] += i is not None and i < 40 and i % 2 == 0
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    share = resampling.good_share(labels)
    assert share == 0.5
    out = {x["doc_id"]: x for x in resampling.resample(docs, labels, share).collect()}
    assert max(x["n_grams"] for x in out.values()) > 1000
    for i, text in rows:
        own = grams(text)
        assert out[i]["n_grams"] == len(own) and np.isclose(out[i]["log_weight"], ratio[own].sum())
    ordered = sorted(out.values(), key=lambda x: -x["gumbel_key"])
    assert [x["rank"] for x in ordered] == list(range(1, len(rows) + 1)) and [x["kept"] for x in ordered] == [k < 31 for k in range(len(rows))]
    tempered = {x["doc_id"]: x for x in resampling.resample(docs, labels, share, temper=100).collect()}
    for i in out:
        assert np.isclose(tempered[i]["log_weight"], out[i]["log_weight"] * min(1, 100 / max(out[i]["n_grams"], 1)))


# -- licences ---------------------------------------------------------------------------------------------------------


def test_licence_scan(spark, sf):
    prose = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    mit, apache = licences.BODIES["MIT"][0], "Licensed under the Apache License, Version 2.0."
    rows = [(i, t) for i, t in enumerate(prose) if not any(k in t for k in ("License", "CC BY", "rights reserved"))]
    rows += [(100, f"{prose[0]}\n{apache}"), (101, mit.upper()), (102, "word " * 200 + apache + " word" * 200), (103, None), (104, ""), (105, "license"), (106, apache), (106, apache), (None, apache), (107, "no news " * 200_000 + "\n" + apache)]
    got = {}
    for r in licences.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, matches int")).collect():
        got.setdefault(r["doc_id"], []).append({m["family"] for m in r["matches"]})
    for key in (100, 102, 106, None, 107):
        assert all("Apache-2.0" in f for f in got[key]), key
    assert got[101] == [{"MIT"}] and len(got[106]) == 2
    assert got[103] == got[104] == got[105] == [set()]
    assert all(got[i] == [set()] for i, _ in rows[: len(rows) - 10])
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_two_licences_in_one_paragraph(spark, sf):
    prose = [(i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect())]
    mit, apache = "Licensed under the MIT license.", "Licensed under the Apache License, Version 2.0."
    rows = [(1000, f"{mit} {apache}"), (1001, f"{apache} {mit}"), (1002, "Licensed under CC BY-SA 4.0."), (1003, "Licensed under the GNU Lesser General Public License, version 3.")]
    got = {r["doc_id"]: {m["family"] for m in r["matches"]} for r in licences.scan(spark.createDataFrame(prose + rows, "doc_id long, text string")).where("doc_id >= 1000").collect()}
    assert got == {1000: {"MIT", "Apache-2.0"}, 1001: {"MIT", "Apache-2.0"}, 1002: {"CC-BY-SA-4.0"}, 1003: {"LGPL-3.0"}}


def test_scan_against_brute_force():
    prose = [f"the {w} of some {w} text, number {i} in a row of lines" for i, w in enumerate(["cat", "Hund", "maison", "software", "rights"] * 8)]
    model = licences.train(prose, rounds=80)
    r = np.random.default_rng(1)
    words_ = " ".join(prose + [t for f in licences.FAMILIES for t in licences.TEMPLATES[f]]).split()
    texts = [None, "", " \n\n", "All rights reserved.", *(t for f in licences.FAMILIES for t in licences.BODIES.get(f, [])), "word " * 70 + "Licensed under the Zlib." + " word" * 70, "by by " * 40]
    texts += ["\n".join(" ".join(r.choice(words_, int(r.integers(1, 60)))) for _ in range(4)) for _ in range(40)]
    texts += [licences.BODIES["BSD-2-Clause"][0] + "\n" + licences.BODIES["BSD-3-Clause"][0]]

    def grams(tokens):
        return {(w,) for w in tokens} | set(zip(tokens, tokens[1:]))

    hashed = lambda g: words.word_hashes(pa.array([" ".join(g)]))[0]
    templates = {f: [grams(t.encode().lower().split()) for t in licences.TEMPLATES[f]] for f in licences.FAMILIES}

    def brute(text):
        found = {}
        for line, paragraph in enumerate((text or "").split("\n")):
            tokens = paragraph.encode().lower().split()
            starts = [0] if 0 < len(tokens) <= 32 else range(0, len(tokens) - 32 + 16 if tokens else 0, 16)
            for start in starts:
                piece = tokens[start : start + 32]
                features = [int(h) for h in hashed([w.decode() for w in piece])]
                own_hashes = np.array(features, np.uint64)
                features += words.mix64(own_hashes[:-1] * np.uint64(3) + own_hashes[1:]).tolist()
                z = sum(model.weights[f % licences.BUCKETS] for f in features) / len(features) ** 0.5 + model.bias
                p = np.exp((z - z.max()) / model.temperature)
                p /= p.sum()
                if 1 - p[0] < licences.CERTAIN:
                    continue
                own, names = grams(piece), []
                for k in sorted(range(len(licences.FAMILIES)), key=lambda k: (-p[k + 1], k)):
                    family = licences.FAMILIES[k]
                    if p[k + 1] <= p[0]:
                        break
                    shared = own & set().union(*templates[family])
                    alike = max(len(own & t) / min(len(t), len(own) if len(own) >= 16 else 1e9) for t in templates[family])
                    if alike >= licences.RESEMBLE and all(shared - set().union(*templates[n]) for n in names):
                        names.append(family)
                        key = line, family
                        have = found.get(key, (0, 0))
                        found[key] = max(have[0], p[k + 1]), max(have[1], alike)
        if any(f == "BSD-3-Clause" for _, f in found):
            found = {(n, "BSD-3-Clause" if f == "BSD-2-Clause" else f): v for (n, f), v in sorted(found.items(), key=lambda x: x[1])}
        return sorted((n, f, round(a, 6), round(b, 6)) for (n, f), (a, b) in found.items())

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    (out,) = licences._scan(model)(iter([batch]))
    got = [sorted((m["paragraph"], m["family"], round(m["probability"], 6), round(m["resemblance"], 6)) for m in ms) for ms in out.column("matches").to_pylist()]
    assert got == [brute(t) for t in texts]
    assert got[3][0][1] == "proprietary" and {f for _, f, *_ in got[-1]} == {"BSD-3-Clause"} and got[-42] == []


def test_templates_not_learned_from_are_recognised():
    """Weights fitted without every fifth template still name most of those, and leave lines they did not learn alone."""
    prose = [f"line {i} tells of the {w} and {w} things that no one licensed" for i, w in enumerate(["cat", "dog", "tree", "house", "sea"] * 20)]
    random = np.random.default_rng(2)
    kept = {f: [t for k, t in enumerate(ts) if k % 5 != 4] for f, ts in licences.TEMPLATES.items()}
    apart = [(f, t) for f, ts in licences.TEMPLATES.items() for k, t in enumerate(ts) if k % 5 == 4]
    texts, classes = list(prose[::2]), [0] * 50
    for k, f in enumerate(licences.FAMILIES):
        for t in kept[f]:
            copies = licences._copies(random, ["some", "words"], t)
            texts, classes = texts + copies, classes + [k + 1] * len(copies)
    fit = licences._Pieces(texts, np.array(classes)).fitted(np.ones(len(texts), bool), 160)
    seen = licences._Pieces([t for _, t in apart] + prose[1::2], np.zeros(len(apart) + 50, int)).logits(*fit).argmax(1)
    assert np.mean([licences.FAMILIES[k - 1] == f for k, (f, _) in zip(seen, apart)]) > 0.85 and (seen[len(apart) :] == 0).mean() > 0.9


def test_sampled_pieces_come_from_whole_lines(spark):
    lines = [" ".join(f"w{i}x{k}" for k in range(200)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    found = licences.unknown_pieces(docs, "text", F.col("doc_id").cast("string"))
    assert len(found) == 40 and all(len(p.split()) <= licences.PIECE and p in " ".join(lines) for p in found)
    assert len({int(p.split()[0].split("x")[1]) for p in found}) > 5


def test_pieces_cover_every_word():
    lengths = [0, 1, 31, 32, 33, 48, 49, 200]
    offsets = np.r_[0, np.cumsum(lengths)]
    paragraph, first, last = licences.pieces(offsets)
    for k, n in enumerate(lengths):
        own = [range(a, b) for p, a, b in zip(paragraph, first, last) if p == k]
        assert sorted({w for r in own for w in r}) == list(range(offsets[k], offsets[k + 1]))
        assert all(0 < len(r) <= licences.PIECE for r in own)
