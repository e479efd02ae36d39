"""Language identification by hyperdimensional profiles.

Every letter has a random bipolar vector drawn from its code point. An n-gram's vector binds (multiplies) the letters'
vectors after permuting (rotating) each by its place; a text's vector bundles (adds) its n-grams, a language's prototype
bundles its training texts. A text is given the language whose prototype has the largest cosine.

Bundles are integer sums, so training does not depend on the order of rows. The prototypes are L x dimensions numbers, 32 MB
for ``max_languages``, which bounds what reaches the driver and the tasks. Defined results: a null text or one without a letter
is ``und`` with score 0; a training row with a null language is skipped; without training rows everything is ``und``; ties go to
the first language by code point; rows that repeat each count in training and get one result; a very long text is read whole, in
blocks that overlap; an empty table gives no row. Other columns pass through ``predict`` unless ``keep`` names what does; a name
that clashes with an output is the caller's to avoid (``out``); ``identify`` reads no other column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import tidied

DIMENSIONS = 1024
GRAM = 3
MAX_LANGUAGES = 4096
UNKNOWN = "und"
_BLOCK = 1 << 20
_LETTERS: np.ndarray | None = None
_VECTORS: dict[tuple[int, int], np.ndarray] = {}


def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def letter_vector(point: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bipolar vector of a code point; 0 stands for every run of non-letters."""
    key = (point, dimensions)
    if key not in _VECTORS:
        _VECTORS[key] = (np.random.Generator(np.random.Philox(key=point + 1)).integers(0, 2, dimensions) * 2 - 1).astype(np.float32)
    return _VECTORS[key]


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, other runs as one 0, with a 0 at either end; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0)
    points = np.r_[np.uint32(0), points, np.uint32(0)]
    points = points[np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]]
    return points if len(points) > 1 else points[:0]


class GramCounts:
    """Counts of n-grams for the texts of a batch: rows x distinct n-grams, built without a loop over letters."""

    def __init__(self, texts: list[str | None]) -> None:
        codes = [letter_codes(t) if t else np.zeros(0, np.uint32) for t in texts]
        sizes = np.array([max(0, len(c) - GRAM + 1) for c in codes], np.int64)
        alphabet, flat = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.uint32), return_inverse=True)
        n, at, grams = len(alphabet), 0, []
        for c in codes:
            x = flat[at : at + len(c)].astype(np.int64)
            at += len(c)
            g = np.zeros(max(0, len(x) - GRAM + 1), np.int64)
            for k in range(GRAM):
                g = g * n + x[k : len(x) - GRAM + 1 + k] if len(g) else g
            grams.append(g)
        grams = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        self.rows = np.repeat(np.arange(len(codes)), sizes)
        if n**GRAM <= 1 << 22:
            present = np.flatnonzero(np.bincount(grams, minlength=1))
            place = np.zeros(int(n**GRAM) + 1, np.int64)
            place[present] = np.arange(len(present))
            self.columns = place[grams]
        else:
            present, self.columns = np.unique(grams, return_inverse=True)
        self.grams, self.alphabet, self.n, self.sizes = present, alphabet, n, sizes

    def vectors(self, dimensions: int) -> np.ndarray:
        base = np.stack([letter_vector(int(p), dimensions) for p in self.alphabet]) if self.n else np.zeros((1, dimensions), np.float32)
        out, rest = np.ones((len(self.grams), dimensions), np.float32), self.grams
        for k in range(GRAM):
            out *= np.roll(base, k, 1)[rest % self.n]
            rest = rest // self.n
        return out

    def bundle(self, dimensions: int) -> np.ndarray:
        """One vector a text."""
        out = np.zeros((len(self.sizes), dimensions), np.float32)
        width = len(self.grams)
        for at in range(0, width, 1 << 14):
            pick = (self.columns >= at) & (self.columns < at + (1 << 14)) if width > 1 << 14 else slice(None)
            cells = min(width - at, 1 << 14)
            counts = np.bincount(self.rows[pick] * cells + self.columns[pick] - at, minlength=len(self.sizes) * cells)
            part = GramCounts.__new__(GramCounts)
            part.grams, part.alphabet, part.n = self.grams[at : at + cells], self.alphabet, self.n
            out += counts.reshape(len(self.sizes), cells).astype(np.float32) @ part.vectors(dimensions)
        return out


def text_vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bundles of whole texts; long ones are read in blocks that overlap by n - 1 letters."""
    out = np.zeros((len(texts), dimensions), np.float32)
    batch: list[int] = []
    held = 0

    def flush() -> None:
        if batch:
            out[batch] = GramCounts([texts[i] for i in batch]).bundle(dimensions)
        batch.clear()

    for i, text in enumerate(texts):
        if text and len(text) > _BLOCK:
            codes = letter_codes(text)
            for at in range(0, max(len(codes) - GRAM + 1, 0), _BLOCK):
                out[i] += _codes_bundle(codes[at : at + _BLOCK + GRAM - 1], dimensions)
            continue
        batch.append(i)
        held += len(text or "")
        if held > _BLOCK or len(batch) >= 256:
            flush()
            held = 0
    flush()
    return out


def _codes_bundle(codes: np.ndarray, dimensions: int) -> np.ndarray:
    one = GramCounts([])
    one.alphabet, flat = np.unique(codes, return_inverse=True)
    one.n = len(one.alphabet)
    grams = np.zeros(len(codes) - GRAM + 1, np.int64)
    for k in range(GRAM):
        grams = grams * one.n + flat[k : len(codes) - GRAM + 1 + k]
    one.grams, one.columns = np.unique(grams, return_inverse=True)
    one.rows, one.sizes = np.zeros(len(grams), np.int64), np.array([len(grams)])
    return one.bundle(dimensions)[0]


def train(rows: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their prototypes, from all rows with a language."""
    pairs = rows.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))

    def bundles(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors, langs = text_vectors(part.column("text").to_pylist(), dimensions), np.array(part.column("lang").to_pylist())
                for name in np.unique(langs):
                    total[str(name)] = total.get(str(name), 0) + vectors[langs == name].sum(0, dtype=np.float64)
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(np.rint(vector).astype(np.int64))], names=["lang", "d", "v"])

    sums = pairs.mapInArrow(tidied(bundles), "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    bundles_ = F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"])
    found = sums.groupBy("lang").agg(bundles_.alias("v")).limit(max_languages + 1).toArrow()
    if found.num_rows > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages, which bounds what is broadcast")
    names = found["lang"].to_pylist()
    table = np.zeros((len(names), dimensions))
    for k, row in enumerate(found["v"].combine_chunks() if names else ()):
        table[k] = row.values.to_numpy()
    order = sorted(range(len(names)), key=lambda k: names[k].encode())
    return [names[k] for k in order], table[order]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", out: tuple[str, str] = ("lang_pred", "score"), keep: list[str | Column] | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """``keep`` (all columns by default) with the predicted language and its cosine, cut to 0..1."""
    names, prototypes = model
    length = np.linalg.norm(prototypes, axis=1, keepdims=True) if len(names) else 1
    unit = (prototypes / np.where(length == 0, 1, length)).astype(np.float32)
    rows = docs.select("*") if keep is None else docs.select(*keep, F.col(text).cast("string").alias("text_in"))
    source = text if keep is None else "text_in"
    fields = [f for f in rows.schema.fields if keep is None or f.name != "text_in"]
    schema = T.StructType([*fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])

    def guess(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors = text_vectors(part.column(source).to_pylist(), dimensions)
                norm = np.linalg.norm(vectors, axis=1)
                langs, score = np.full(len(vectors), UNKNOWN, object), np.zeros(len(vectors))
                if len(names):
                    cosine = (vectors @ unit.T) / np.where(norm == 0, 1, norm)[:, None]
                    best = cosine.argmax(1)
                    score = np.where(norm == 0, 0, np.clip(cosine[np.arange(len(best)), best], 0, 1)).astype(np.float64)
                    langs = np.where(norm == 0, UNKNOWN, np.array(names, object)[best])
                kept = [part.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs.tolist(), pa.string()), pa.array(score)], names=schema.names)

    return rows.mapInArrow(tidied(guess), schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts) == part


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns where crc32(doc_id) mod 5 is not 0."""
    test = held_out(F.col(doc_id), 5, 0)
    model = train(docs.where(~test), text, lang)
    return predict(docs, model, text, keep=[F.col(doc_id).alias("doc_id"), test.alias("held_out")])
