import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def held(rows, got, longest=1024):
    """Every document's pieces cover its ids once; sequences are whole, of a power of two and of one document."""
    want, pieces = defaultdict(list), defaultdict(list)
    tokenizer = Tokenizer.from_file(PATH)
    for doc_id, text in rows:
        want[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert set(want) == set(pieces)
    for doc_id, copies in want.items():
        spans = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[doc_id])
        cut = []
        for ids in copies:
            at = 0
            for size in packing.binary_pieces(len(ids), longest):
                cut.append((at, size, zlib.crc32(np.asarray(ids[at : at + size], "<u4").tobytes()), len(ids)))
                at += size
            assert at == len(ids)
        assert spans == sorted(cut)
    sequences = [r["sequence_id"] for r in got]
    assert sorted(sequences) == list(range(len(got)))
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= longest for r in got)
    assert [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])] == sorted((r["length"] for r in got), reverse=True)


@pytest.mark.parametrize("longest", [1024, 8])
def test_round_trip(spark, longest):
    rows = [(1, "Hello world. This is\na test,  two blanks"), (2, None), (3, ""), (4, " "), (5, "a\tb c d e　 f it's we'll"), (6, "<|endoftext|> x"), (7, "x y" * 3000), (None, "none"), (8, "twice"), (8, "twice"), (8, "other")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", ident int, length string").repartition(3)
    held(rows, packing.pack(df, PATH, longest).collect(), longest)


def test_more_rows_than_a_batch_holds(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["alpha", "Beta,", "gamma.\nNew", "d"]) for _ in range(r.randint(0, 30)))) for i in range(2 * packing.ROWS + 77)]
    held(rows, packing.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1), PATH).collect())


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held([tuple(r) for r in docs.collect()], packing.pack(docs, PATH).collect())


def test_full_memo_gives_the_same_ids(monkeypatch):
    texts = [f"word{i} and w{i % 7}, it's\nnew W{i}." for i in range(200)]
    want = [ids_of(t)[:-1] for t in texts]
    monkeypatch.setattr(packing, "MEMO", 10)
    small = packing.WordCoder(PATH)
    assert [small(pa.array([t]))[0].tolist() for t in texts[:5]] == want[:5]
    ids, offsets = small(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want


def test_coder_on_odd_texts():
    r = random.Random(3)
    odd = ["", " ", "  ", " a", "a ", "a  b", "\0", "a\0b c", "<|endoftext|>", "it's we'll '", "\n a\n", "é ü", "\u3000x", "a\tb", "x\u200b y", "\x85 z", "1 23 4,5", "don't stop", "𝒳 𝒴"]
    texts = [*odd, *("".join(r.choice(odd + ["word", " ", "\n", "Z."]) for _ in range(r.randint(0, 9))) for _ in range(3000))]
    coder = packing.WordCoder(PATH)
    for batch in (texts, [], ["a  b"], ["a b"], texts[::-1]):
        ids, offsets = coder(pa.array(batch, pa.string()))
        want = Tokenizer.from_file(PATH).encode_batch(batch, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [w.ids for w in want]


def test_runs_of_bytes():
    texts = pa.array(["a" * n for n in (3, 0, 50, 1, 1, 1, 1, 0, 9, 200, 1)])
    for rows, most in ((3, 10), (100, 1), (1, 100), (100, 1000)):
        runs = list(packing.byte_runs(texts, rows, most))
        assert [k for a, b in runs for k in range(a, b)] == list(range(len(texts)))
        assert all(b - a <= rows and (b - a == 1 or sum(len(t) for t in texts[a:b].to_pylist()) <= most) for a, b in runs)


def test_a_very_long_text_among_others(spark):
    rows = [(1, "x"), (2, "a word, " * 700_000 + "end"), (3, None), (4, "b" * 100_000)]
    held(rows, packing.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1), PATH).collect())


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
