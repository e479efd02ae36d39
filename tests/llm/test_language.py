import zlib

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import language as lg


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lg.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(1, 6)] + [(i, "der hund und die katze sind schön", "de") for i in range(6, 12)]
    rows += [(20, None, "en"), (21, "", None), (22, "123 !? ...", "de"), (None, "the the", None), (24, "日本語 テキスト", None), (25, "the " * 400_000, None), (25, "the mat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {(r["doc_id"], r["lang_pred"]) for r in lg.identify(df).collect()}
    assert {(20, "und"), (21, "und"), (22, "und"), (None, "en"), (25, "en")} <= found
    assert lg.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in lg.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([(1, "abc abc", "b"), (2, "abc abc", "a")], "doc_id long, text string, lang string")
    model = lg.train(df)
    assert model[0] == ["a", "b"]
    assert {r["lang_pred"] for r in lg.predict(df, model).collect()} == {"a"}


def test_bundles_equal_their_definition():
    text = "Ab a, bä ba"
    codes = lg.letter_codes(text)
    direct = np.zeros(lg.DIMENSIONS)
    for i in range(len(codes) - 2):
        vectors = [lg.letter_vector(int(codes[i + k])) for k in range(3)]
        direct += np.roll(vectors[0], 2) * np.roll(vectors[1], 1) * vectors[2]
    assert np.array_equal(lg.text_vectors([text])[0], direct)
    block, lg._BLOCK = lg._BLOCK, 4
    try:
        assert np.array_equal(lg.text_vectors([text])[0], direct)
    finally:
        lg._BLOCK = block


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "abc", "a", "x", 1)], "doc_id long, text string, lang string, lang_pred string, text_in int")
    out = lg.predict(df, lg.train(df), out=("p", "s"))
    assert out.columns == [*df.columns, "p", "s"] and out.first()["lang_pred"] == "x"


def test_predictions_against_brute_force(spark):
    """Training, cosines and the choice, from the definition, gram by gram."""
    r = np.random.default_rng(4)
    alphabets = {"de": "abcdeäöü", "en": "abcdefgh", "el": "αβγδεζ", None: "xyz"}
    rows = []
    for i in range(60):
        lang = list(alphabets)[i % 4]
        text = " ".join("".join(r.choice(list(alphabets[lang]), int(r.integers(1, 7)))) for _ in range(int(r.integers(0, 12))))
        rows.append((i, text.title() if i % 3 else text + " 12!", lang))
    rows += [(None, "Abc", "en"), (60, None, "de"), (61, "...", "de"), (7, rows[7][1], rows[7][2])]

    def vector(text):
        codes, out = lg.letter_codes(text or ""), np.zeros(lg.DIMENSIONS)
        for i in range(len(codes) - 2):
            out += np.prod([np.roll(lg.letter_vector(int(codes[i + k])), 2 - k) for k in range(3)], 0)
        return out

    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 0 for d, *_ in rows]
    names = sorted({lang for (_, _, lang), h in zip(rows, held) if lang and not h}, key=str.encode)
    prototypes = [sum(vector(t) for (_, t, lang), h in zip(rows, held) if lang == n and not h) for n in names]
    want = []
    for (d, text, _), h in zip(rows, held):
        v = vector(text)
        scores = [float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) if v.any() else 0.0 for p in prototypes]
        best = int(np.argmax(scores))
        want.append((repr(d), h, names[best] if v.any() else "und", round(max(0.0, scores[best]), 4)))
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, score string").repartition(3)
    got = [(repr(x["doc_id"]), x["held_out"], x["lang_pred"], round(x["score"], 4)) for x in lg.identify(df).collect()]
    assert sorted(got) == sorted(want)
