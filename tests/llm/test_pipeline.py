import random
import re
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from textloom.llm import mixing
from textloom.llm.runtime import row_identity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(60):
        words = [r.choice(["the", "cat", "dog", "sat", "on", "mat", f"w{i}", f"v{r.randint(0, 9)}"]) for _ in range(r.randint(6, 80))]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 1))
    near = rows[3][1].split()
    near = (near * 4)[:100]
    rows += [(100, rows[0][1].upper(), "en", "s0", 1), (101, " ".join(near), "en", "s1", 1), (102, " ".join([*near, "end"]), "en", None, 1)]
    rows += [(103, None, None, None, None), (104, "123 ...", "en", "s1", 1), (None, "a text that no one numbered", None, "s2", None), (105, "", "en", "s2", 1), (105, "x y", "en", "s2", 1), (105, "x y", "en", "s2", 1)]
    rows += [(120, "αυτό το κείμενο είναι γραμμένο σε μια γλώσσα που κανείς δεν έμαθε ποτέ εδώ", None, "s1", 1)]
    # rows that a joiner without lengths would take for each other
    rows += [(110, "one a\x01b", "c", "s0", 1), (110, "one a", "b\x01c", "s0", 1), (111, "two words", "\x02", "", 1), (111, "two words more", None, "\x02", 1)]
    return rows


def grams(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def expected(rows):
    """The first three stages by brute force."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and r[0] != 120]
    best = {}
    for r in rows:
        key = r[1].encode().lower()
        if key not in best or (r[0] is not None, r[0] or 0) > (best[key][0] is not None, best[key][0] or 0):
            best[key] = r
    rows = sorted(best.values(), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return [r for i, r in enumerate(rows) if root[i] == i]


def test_stages_against_brute_force(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "und", 0.0, None, 7, "x") for r in rows], COLUMNS + ", lang_pred string, score double, ident string, uid int, `class` string")
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    names = docs.columns
    for name, stage in cp.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == names
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = expected(rows)
    assert sorted(repr(tuple(r)[:5]) for r in docs.collect()) == sorted(map(repr, kept))
    taken = {r["ident"]: r["taken"] for r in mixing.mix(docs).collect()}
    takes = {(r["doc_id"], r["text"]): taken[r["ident"]] for r in docs.withColumn("ident", row_identity(docs)).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = cp.run(spark, str(tmp_path / "in")).collect()
    want = defaultdict(list)
    for doc_id, text, *_ in kept:
        spans, left = [m.end() for m in WORD.finditer(text)], takes[doc_id, text]
        while left > 0:
            part = text if left >= len(spans) else text[: spans[left - 1]]
            want[doc_id].append(len(tokenizer.encode(part, add_special_tokens=False).ids) + 1)
            left -= len(spans)
    got = defaultdict(list)
    for p in pieces:
        if p["start"] == 0:
            got[p["doc_id"]].append(p["doc_tokens"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert sum(p["length"] for p in pieces) == sum(map(sum, want.values()))


def test_empty_documents_and_more_columns(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS + ", lang_pred string, ident int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
