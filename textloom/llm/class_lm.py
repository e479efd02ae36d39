"""Scoring with a Brown class-based bigram model.

    P(w | v) = (1 - u(v)) P(c(w) | c(v)) n(w) / n(c(w))   for a word of the training texts,
    P(w | v) = u(v) / U                                   for any other,

u(v) being the smoothed share of once-seen words after v's class, U an estimate (Chao) of how many unseen words there are.
Only classes that hold a word share the smoothing, so the probabilities after any context sum to one.

Classes come from exchange clustering, run the distributed way: every round counts, over the whole training corpus, each
word's neighbours by class, and moves every word to the class in which it raises the likelihood most. To begin with, the
``exchanged`` most frequent words are moved in at most ``rounds`` rounds, starting from one class for each of the most frequent
ones; all other words join the class that suits their neighbours best. From there all words of the corpus are moved, in
rounds that go on until the likelihood rises by less than ``GAIN`` a token. As all words of a round move at once, a round may
lower the likelihood; in both phases the best round counts.

Texts are tokenised once and stored as numbers in chunks with their own lexicon, ordered by buckets of hashed words. The
most frequent words are counted in one table of fixed size, so no task meets all occurrences of a hot word. What is
around the others, summed by class within the chunk, is sent as one row for each chunk and bucket; what a chunk needs to know of
its words comes back the same way. The tables that reach the driver have a size set by the parameters. A text of more than
``chunk`` tokens fills chunks of its own, each with the token before and after it, and its sums are added up. A text is read
with the end before its first word.

Defined results: null counts as empty (one end); a null doc_id counts as empty text in the split; rows that repeat are each
counted and scored; without training texts every score follows the same formulas with zero counts; an empty table gives no row.
Ties: of equally frequent words the first by its bytes is exchanged, of classes that suit a word equally the lowest number
is taken. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .near_join import runs
from .runtime import Scratch, checkpoint, partitions, shuffles_dropped, tidied
from .words import word_hashes

CLASSES, EXCHANGED, ROUNDS = 32, 8192, 4
#: Tokens after which a chunk is closed, and bytes of one text read at a time.
CHUNK, SLICE = 1 << 21, 4 << 20
#: Bits of a chunk's number that count the chunks of a task.
TURNS = 20
#: Buckets of words for each shuffle partition, and cells of one row of a fixed table.
SPREAD, CELLS = 4, 1 << 14
SMOOTH_CLASS, SMOOTH_UNSEEN = 5.0, 20.0
#: Rise of the training texts' log-likelihood, in nats a token, below which the rounds over all words have converged.
GAIN = 0.001
_ZSTD = {"parquet.block.size": str(16 << 20), "compression": "zstd"}


def _packed(x: np.ndarray, kind: str) -> bytes:
    raw = x.astype(kind).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], size, codec="zstd", asbytes=True), kind) if size else np.zeros(0, kind)


def _rows(batches) -> Iterator[dict]:
    """Rows one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


# -- texts to chunks --------------------------------------------------------------------------------------------------


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in parts cut before a blank."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        blanks = [p for p in (text.rfind(b, at + 1, end) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if p > 0]
        if not blanks:
            following = [p for p in (text.find(b, end) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if p > 0]
            if not following:
                break
            blanks = [min(following)]
        yield text[at : max(blanks)]
        at = max(blanks)
    yield text[at:]


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and how many each has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, edges = split.flatten(), split.offsets.to_numpy()
    solid = pc.greater(pc.binary_length(flat), 0)
    before = np.r_[0, np.cumsum(solid.to_numpy(zero_copy_only=False))]
    return flat.filter(solid), np.diff(before[edges - edges[0]])


def _strings(data: bytes, lens: np.ndarray) -> pa.Array:
    edges = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=edges[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data)])


def _bytes_of(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """The words one after the other, and their lengths."""
    if not len(words):
        return b"", np.zeros(0, np.int64)
    words = words.cast(pa.large_binary())
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return data[edges[0] : edges[-1]].to_pybytes(), np.diff(edges)


CODED = "chunk long, docs array<{kind}>, held binary, lens binary, part long, head boolean, tail boolean, ids binary, words binary, wlens binary, counts binary, edges binary"


class _Chunks:
    """Closes a chunk every ``most`` tokens; a longer text has chunks of its own, with a token of context on either side."""

    def __init__(self, most: int, buckets: int, kind: pa.DataType) -> None:
        self.most, self.buckets, self.kind = most, buckets, kind
        self.first, self.turn, self.seen = TaskContext.get().partitionId() << TURNS, 0, 0
        self.out: list[pa.RecordBatch] = []
        self._clear()

    def _clear(self) -> None:
        self.tokens: list[pa.Array] = []
        self.docs: list[pa.Array] = []
        self.held: list[np.ndarray] = []
        self.lens: list[np.ndarray] = []
        self.size = 0

    def add(self, docs: pa.Array, held: np.ndarray, texts: pa.Array) -> None:
        large = pc.greater(pc.binary_length(texts), SLICE).to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero(large[1:] != large[:-1]) + 1, len(large)] if len(large) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            if large[a]:
                for row in range(a, b):
                    self._long(docs.slice(row, 1), held[row : row + 1], (_tokens(pa.array([s.decode()]))[0] for s in _slices(texts[row].as_py().encode())))
            else:
                self._short(docs.slice(a, b - a), held[a:b], *_tokens(texts.slice(a, b - a)))

    def _short(self, docs: pa.Array, held: np.ndarray, tokens: pa.Array, lens: np.ndarray) -> None:
        ends = np.cumsum(lens + 1)
        at = 0
        while at < len(lens):
            before = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, before + self.most - self.size, "right"))
            if stop > at:
                part = slice(at, stop)
                self.tokens.append(tokens.slice(before - at, ends[stop - 1] - stop - before + at))
                self.docs.append(docs.slice(at, stop - at))
                self.held.append(held[part])
                self.lens.append(lens[part])
                self.size += int(ends[stop - 1] - before)
                self.seen += stop - at
                at = stop
            elif self.size:
                self.close()
            else:
                self._long(docs.slice(at, 1), held[at : at + 1], iter([tokens.slice(before - at, lens[at])]))
                at += 1

    def _long(self, doc: pa.Array, held: np.ndarray, pieces: Iterator[pa.Array]) -> None:
        self.close()
        cut = (p.slice(a, self.most) for p in pieces for a in range(0, len(p), self.most))
        part, last = (TaskContext.get().partitionId() << 40) + self.seen, None
        self.seen += 1
        here = next(cut, None)
        if here is None:
            here = pa.array([], pa.string())
        while here is not None:
            following = next(cut, None)
            around = [x for x in (last, here, None if following is None else following.slice(0, 1)) if x is not None]
            self.tokens, self.docs, self.held, self.lens, self.size = around, [doc], [held], [np.array([len(here)])], len(here) + 1
            whole = last is None and following is None
            self.close(None if whole else part, last is not None, following is not None)
            last, here = here.slice(len(here) - 1, 1), following

    def close(self, part: int | None = None, head: bool = False, tail: bool = False) -> None:
        if not self.docs:
            return
        if self.turn >> TURNS:
            raise ValueError(f"a task holds more than {1 << TURNS} chunks: split the input into more tasks")
        named = pa.concat_arrays(self.tokens).dictionary_encode() if self.tokens else pa.array([], pa.string()).dictionary_encode()
        ids, words = named.indices.to_numpy(), named.dictionary
        held, lens = np.concatenate(self.held), np.concatenate(self.lens)
        inside = np.full(len(ids), not held[0]) if head or tail else np.repeat(~held, lens)
        if head:
            inside[0] = False
        if tail:
            inside[-1] = False
        counts = np.bincount(ids[inside], minlength=len(words))
        bucket = (word_hashes(words)[0] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        data, wlens = _bytes_of(words.take(pa.array(order)))
        row = (
            self.first + self.turn, pa.concat_arrays(self.docs).to_pylist(), _packed(held, "u1"), _packed(lens, "<i4"), part, head, tail, _packed(place[ids], "<i4"),
            data, _packed(wlens, "<i4"), _packed(counts[order], "<i4"), _packed(np.bincount(bucket, minlength=self.buckets), "<i4"),
        )
        types = [pa.int64(), pa.list_(self.kind), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.binary()] * 5]
        self.out.append(_batch(["chunk", "docs", "held", "lens", "part", "head", "tail", "ids", "words", "wlens", "counts", "edges"], types, [row]))
        self.turn += 1
        self._clear()

    def taken(self) -> list[pa.RecordBatch]:
        out, self.out = self.out, []
        return out


def _coded(most: int, buckets: int):
    """Chunks: doc_ids, held flags, words per document, word numbers, the lexicon by buckets and its training counts."""

    def run(batches):
        chunks = None
        for batch in batches:
            chunks = chunks or _Chunks(most, buckets, batch.schema.field("doc_id").type)
            chunks.add(batch.column("doc_id"), batch.column("held").to_numpy(zero_copy_only=False).astype(bool), pc.fill_null(batch.column("text"), ""))
            yield from chunks.taken()
        if chunks:
            chunks.close()
            yield from chunks.taken()

    return run


def _stream(row: dict, of_word: np.ndarray, end: int, training_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's tokens with an end after each document: word numbers (-1: end), states, document numbers, and whether they count
    (context does not)."""
    lens, ids = _unpacked(row["lens"], "<i4").astype(np.int64), _unpacked(row["ids"], "<i4")
    take = ~_unpacked(row["held"], "u1").astype(bool) if training_only else np.ones(len(lens), bool)
    if row["head"] or row["tail"]:
        numbers = (ids if row["tail"] else np.r_[ids, np.int32(-1)])[: None if take[0] else 0]
        doc, counted = np.zeros(len(numbers), np.int32), np.ones(len(numbers), bool)
        counted[: int(row["head"])] = False
        counted[len(counted) - int(row["tail"]) :] = False
    else:
        if not take.all():
            ids = ids[np.repeat(take, lens)]
        lens = lens[take]
        numbers = np.full(int(lens.sum()) + len(lens), -1, np.int32)
        place = np.ones(len(numbers), bool)
        place[np.cumsum(lens + 1) - 1] = False
        numbers[place] = ids
        doc, counted = np.repeat(np.flatnonzero(take).astype(np.int32), lens + 1), np.ones(len(numbers), bool)
    states = np.r_[of_word, end].astype(np.int16)[numbers]
    return numbers, states, doc, counted


def _around(states: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each token; every document begins after an end."""
    edge = np.array([end], states.dtype)
    return np.concatenate([edge, states[:-1]]), np.concatenate([states[1:], edge])


# -- what is sent between chunks and buckets ----------------------------------------------------------------------------

WORDS = "chunk long, bucket int, words binary, wlens binary, counts binary"
LEXICON = "chunk long, bucket int, known binary"


def _lexicon_rows(batches):
    """One row for each chunk and bucket: the words and their training counts."""
    for row in _rows(batches):
        lens, counts, edges = (_unpacked(row[c], "<i4") for c in ("wlens", "counts", "edges"))
        at, byte = np.r_[0, np.cumsum(edges)], np.r_[0, np.cumsum(lens)]
        out = [(row["chunk"], int(b), row["words"][byte[at[b]] : byte[at[b + 1]]], lens[at[b] : at[b + 1]].tobytes(), counts[at[b] : at[b + 1]].tobytes()) for b in np.flatnonzero(edges)]
        yield _batch(["chunk", "bucket", "words", "wlens", "counts"], [pa.int64(), pa.int32(), *[pa.binary()] * 3], out)


def _joined(rows: pa.Table, column: str, a: int, b: int) -> bytes:
    return b"".join(rows.column(column).slice(a, b - a).to_pylist())


def _bucket_words(rows: pa.Table, a: int, b: int) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a bucket's rows as one array, equal ones alike, and the edges of each row's."""
    lens = np.frombuffer(_joined(rows, "wlens", a, b), "<i4")
    each = pc.binary_length(rows.column("wlens").slice(a, b - a)).to_numpy() // 4
    return _strings(_joined(rows, "words", a, b), lens).dictionary_encode(), np.r_[0, np.cumsum(each)]


def _returned(rows: pa.Table, a: int, b: int, known: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """What is known of a bucket's words, for each chunk that asked."""
    return pa.RecordBatch.from_arrays(
        [rows.column("chunk").slice(a, b - a).combine_chunks(), rows.column("bucket").slice(a, b - a).combine_chunks(), pa.array([known[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])], pa.binary())],
        names=["chunk", "bucket", "known"],
    )


def _totals(most: int):
    """Every word's training count over all chunks, for each chunk that has it, and of each bucket how many words, tokens and words
    seen once and twice there are, and its ``most`` frequent words (chunk -1)."""
    names = ["chunk", "bucket", "known", "v", "total", "once", "twice", "word", "n"]
    types = [pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 4, pa.binary(), pa.int64()]

    def run(batches):
        for rows, at in runs(batches, ["bucket"]):
            for a, b in zip(at[:-1], at[1:]):
                words, edges = _bucket_words(rows, a, b)
                place = words.indices.to_numpy()
                n = np.bincount(place, np.frombuffer(_joined(rows, "counts", a, b), "<i4"), len(words.dictionary)).astype(np.int64)
                back = _returned(rows, a, b, n[place], edges)
                empty = pa.nulls(back.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*back.columns, *[empty] * 4, pa.nulls(back.num_rows, pa.binary()), empty], names=names)
                some = np.flatnonzero(n)
                if len(some) > most:
                    some = some[n[some] >= np.partition(n[some], -most)[-most]]
                stat = (-1, None, None, int((n > 0).sum()), int(n.sum()), int((n == 1).sum()), int((n == 2).sum()), None, None)
                yield _batch(names, types, [stat, *((-1, *[None] * 6, w, c) for w, c in zip(words.dictionary.take(pa.array(some)).to_pylist(), n[some].tolist()))])

    return run


def _with_lexicon(lexicon: DataFrame | None, chunks: DataFrame, size: int) -> DataFrame:
    """The chunks, each with the rows of its lexicon before it, in one exchange of both."""
    if lexicon is None:
        return chunks
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema.fields if f.name != "chunk"]
    rows = lexicon.select("chunk", "bucket", "known", *empty).unionByName(chunks.select("*", F.lit(size).alias("bucket"), F.lit(None).cast("binary").alias("known")))
    return rows.repartition(partitions(chunks.sparkSession), "chunk").sortWithinPartitions("chunk", "bucket")


def _chunk_rows(batches) -> Iterator[tuple[dict, bytes]]:
    """Chunks and what is known of their words."""
    known: list[bytes] = []
    for row in _rows(batches):
        if row["ids"] is None:
            known.append(row["known"])
        else:
            yield row, b"".join(known)
            known = []


KNOWN = "chunk long, docs array<{kind}>, held binary, lens binary, part long, head boolean, tail boolean, ids binary, n binary, place binary, words binary, wlens binary, edges binary"


def _placed(top: list[bytes], kind: pa.DataType):
    """Chunks with the training counts of all their words, the place of the exchanged ones, and the lexicon of the others only."""

    def run(batches):
        exchanged = pa.array(top, pa.large_binary())
        for row, known in _chunk_rows(batches):
            words = _strings(row["words"], _unpacked(row["wlens"], "<i4"))
            place = pc.fill_null(pc.index_in(words, value_set=exchanged), -1).to_numpy() if len(words) else np.zeros(0, np.int32)
            other = place < 0
            data, lens = _bytes_of(words.filter(pa.array(other)))
            edges = _unpacked(row["edges"], "<i4")
            edges = np.bincount(np.repeat(np.arange(len(edges)), edges)[other], minlength=len(edges))
            values = (row["chunk"], row["docs"], row["held"], row["lens"], row["part"], row["head"], row["tail"], row["ids"], _packed(np.frombuffer(known, "<i8"), "<i8"), _packed(place, "<i4"), data, _packed(lens, "<i4"), _packed(edges, "<i4"))
            types = [pa.int64(), pa.list_(kind), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.binary()] * 6]
            yield _batch(["chunk", "docs", "held", "lens", "part", "head", "tail", "ids", "n", "place", "words", "wlens", "edges"], types, [values])

    return run


# -- counts of fixed size -------------------------------------------------------------------------------------------------


def _cells(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The parts of a table that are not all zero, packed."""
    for block in range(-(-len(table) // CELLS)):
        part = table[block * CELLS : (block + 1) * CELLS]
        if part.any():
            yield block, _packed(part, "<i8")


def _block_sums(batches):
    for rows, at in runs(batches, ["block"]):
        for a, b in zip(at[:-1], at[1:]):
            parts = rows.column("cells").slice(a, b - a)
            total = sum(_unpacked(parts[k].as_py(), "<i8") for k in range(b - a))
            yield _batch(["block", "cells"], [pa.int64(), pa.binary()], [(rows.column("block")[a].as_py(), _packed(total, "<i8"))])


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum over all tasks of a table of ``size`` cells, from its parts (block, cells)."""
    dealt = parts.repartition(partitions(parts.sparkSession), "block").sortWithinPartitions("block")
    out = np.zeros(size, np.int64)
    for r in dealt.mapInArrow(tidied(_block_sums), "block long, cells binary").collect():
        part = _unpacked(bytes(r["cells"]), "<i8")
        out[r["block"] * CELLS : r["block"] * CELLS + len(part)] = part
    return out


def _top_cells(numbers: np.ndarray, place: np.ndarray, before: np.ndarray, after: np.ndarray, counted: np.ndarray, words: int, width: int) -> np.ndarray:
    """Counts of (exchanged word, state before) and (exchanged word, width + state after)."""
    at = np.flatnonzero(counted & (np.r_[place, -1][numbers] >= 0))
    spot = place[numbers[at]].astype(np.int64) * (2 * width)
    return np.bincount(spot + before[at], minlength=2 * width * words) + np.bincount(spot + width + after[at], minlength=2 * width * words)


def _neighbours(now: np.ndarray, classes: int):
    """``_top_cells`` of all chunks of a task, the other words being one state."""
    rare, end, width = classes, classes + 1, classes + 2

    def run(batches):
        total = np.zeros(2 * width * len(now), np.int64)
        for row in _rows(batches):
            place = _unpacked(row["place"], "<i4")
            numbers, states, _, counted = _stream(row, np.r_[now, rare][place], end, True)
            total += _top_cells(numbers, place, *_around(states, end), counted, len(now), width)
        yield _batch(["block", "cells"], [pa.int64(), pa.binary()], list(_cells(total)))

    return run


def _likelihood(moves: np.ndarray) -> float:
    """Nats a token of the class bigrams with these counts (context, state), less what no class changes."""
    total = moves.sum()
    x, rows, columns = (v[v > 0].astype(float) for v in (moves, moves.sum(1), moves.sum(0)))
    return float(((x * np.log(x)).sum() - (rows * np.log(rows)).sum() - (columns * np.log(columns)).sum()) / total) if total else 0.0


def _affinity(came: np.ndarray, went: np.ndarray, width: int) -> np.ndarray:
    """Logarithms by which a word's neighbours speak for each class: rows are the states before, then those after, from the
    counts of (state before, class) and (state after, class)."""
    out = np.zeros((2 * width, came.shape[1]))
    for at, counts in ((0, came), (width, went)):
        out[at : at + len(counts)] = np.log((counts + 0.5) / (counts + 0.5).sum(0))
    return out


def exchange(known: DataFrame, words: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the exchanged words, and the affinities that place all others; the best of the rounds."""
    width = classes + 2
    now = np.where(np.arange(words) < classes, np.arange(words), classes).astype(np.int64)
    best = None
    for turn in range(rounds + 1):
        parts = known.select("held", "lens", "head", "tail", "ids", "place").mapInArrow(tidied(_neighbours(now, classes)), "block long, cells binary")
        table = _summed(parts, 2 * width * words).reshape(words, 2 * width)
        member = np.zeros((words, classes))
        member[np.flatnonzero(now < classes), now[now < classes]] = 1
        came, went = table[:, :width].T @ member, table[:, width:].T @ member
        # between words that are not exchanged nothing changes
        moves = np.zeros((width, width))
        moves[:classes], moves[classes:, :classes] = went.T, came[classes:]
        gain = _likelihood(moves)
        if best is not None and turn > 1 and gain <= best[0]:
            break
        affinity = _affinity(came, went, width)
        best = gain, now, affinity
        moved = (table @ affinity).argmax(1)
        if (moved == now).all():
            break
        now = moved
    return best[1], best[2]


# -- rounds over all words ------------------------------------------------------------------------------------------------

ROUND = "chunk long, bucket int, words binary, wlens binary, sizes binary, around binary, times binary, block long, cells binary"


def _word_classes(row: dict, known: bytes, now: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """The place among the exchanged words and the class of all words of a chunk."""
    place = _unpacked(row["place"], "<i4")
    of = np.r_[now, rare][place].astype(np.int16)
    other = np.flatnonzero(place < 0)
    if known:
        of[other] = np.frombuffer(known, "u1")
    return place, of


def _transitions(numbers: np.ndarray, states: np.ndarray, counted: np.ndarray, n: np.ndarray, classes: int) -> np.ndarray:
    """Counts of (context, state) and of once-seen words by context. Contexts: classes, end, unseen (after once-seen words)."""
    width = classes + 2
    if not len(numbers):
        return np.zeros(width * width, np.int64)
    once = (np.r_[n, 0][numbers] == 1) & (numbers >= 0)
    states = states.astype(np.int64)
    before, after_once = np.r_[classes, states[:-1]], np.r_[False, once[:-1]]
    total = np.zeros(width * width, np.int64)
    for which, context in ((counted, before), (counted & after_once, np.full(len(before), classes + 1))):
        total += np.bincount(context[which] * width + states[which], minlength=len(total))
        which = which & once
        total += np.bincount(context[which] * width + classes + 1, minlength=len(total))
    return total


def _round(now: np.ndarray, classes: int, begun: bool):
    """For each chunk and bucket the words that are not exchanged, with the states around them and how often each occurs; for each
    task its transitions and, for the exchanged words, what is around them. Until all words have a class (``begun``) there is one
    more state, of those without, and no transitions."""
    width, end, rare = classes + 2, classes if begun else classes + 1, classes
    names, types = ["chunk", "bucket", "words", "wlens", "sizes", "around", "times", "block", "cells"], [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.binary()]

    def run(batches):
        total = np.zeros(width * width + 2 * width * len(now), np.int64)
        for row, known in _chunk_rows(batches):
            place, of = _word_classes(row, known, now, rare)
            numbers, states, _, counted = _stream(row, of, end, True)
            before, after = _around(states, end)
            total[width * width :] += _top_cells(numbers, place, before, after, counted, len(now), width)
            if begun:
                total[: width * width] += _transitions(numbers, states, counted, _unpacked(row["n"], "<i8"), classes)
            other = np.cumsum(place < 0) - 1
            at = np.flatnonzero(counted & (np.r_[place, 0][numbers] < 0))
            owner = other[numbers[at]].astype(np.int64) * (2 * width)
            key, times = np.unique(np.r_[owner + before[at], owner + width + after[at]], return_counts=True)
            del numbers, states, before, after, at, owner
            lens, edges = _unpacked(row["wlens"], "<i4"), np.r_[0, np.cumsum(_unpacked(row["edges"], "<i4"))]
            sizes = np.bincount(key // (2 * width), minlength=len(lens))
            first, byte = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(lens)]
            around, times, sizes = (key % (2 * width)).astype("<u2"), times.astype("<u4"), sizes.astype("<u2")
            out = []
            for b in np.flatnonzero(edges[1:] > edges[:-1]):
                w = slice(edges[b], edges[b + 1])
                c = slice(first[w.start], first[w.stop])
                out.append((row["chunk"], int(b), row["words"][byte[w.start] : byte[w.stop]], lens[w].tobytes(), sizes[w].tobytes(), around[c].tobytes(), times[c].tobytes(), None, None))
            yield _batch(names, types, out)
        yield _batch(names, types, [(None, None, None, None, None, None, None, block, cells) for block, cells in _cells(total)])

    return run


def _suited(affinity: np.ndarray):
    """The class that suits each word of a bucket best, for each chunk that has it."""
    width = len(affinity)

    def run(batches):
        for rows, at in runs(batches, ["bucket"]):
            for a, b in zip(at[:-1], at[1:]):
                words, edges = _bucket_words(rows, a, b)
                place = words.indices.to_numpy()
                owner = np.repeat(place, np.frombuffer(_joined(rows, "sizes", a, b), "<u2")).astype(np.int64)
                around, times = np.frombuffer(_joined(rows, "around", a, b), "<u2"), np.frombuffer(_joined(rows, "times", a, b), "<u4")
                best, step = np.zeros(len(words.dictionary), np.uint8), 1 << 15
                for low in range(0, len(best), step):
                    n = min(step, len(best) - low)
                    some = slice(None) if len(best) <= step else (owner >= low) & (owner < low + n)
                    cells = np.bincount((owner[some] - low) * width + around[some], times[some], n * width)
                    best[low : low + n] = (cells.reshape(n, width) @ affinity).argmax(1)
                yield _returned(rows, a, b, best[place], edges)

    return run


# -- the model --------------------------------------------------------------------------------------------------------------


class ClassModel:
    """log10 tables: transitions (context x state, known words only), class sizes, unseen words by context."""

    def __init__(self, table: np.ndarray, classes: int, training_tokens: int, distinct: int, once: int, twice: int) -> None:
        self.classes, self.tokens, self.distinct = classes, training_tokens, distinct
        moves, singles = table[:, : classes + 1].astype(float), table[:, classes + 1].astype(float)
        sizes = moves[: classes + 1].sum(0)
        # a class without a word takes no part
        share = np.where((sizes > 0) | (sizes.sum() == 0), sizes + 1, 0)
        share /= share.sum()
        total = moves.sum(1)
        unseen = (singles + SMOOTH_UNSEEN * (once + 0.5) / (training_tokens + 1)) / (total + SMOOTH_UNSEEN)
        unseen = np.minimum(unseen, 0.999999)
        given = (moves + SMOOTH_CLASS * share) / (total + SMOOTH_CLASS)[:, None] * (1 - unseen)[:, None]
        self.moves = np.log10(np.where(given > 0, given, 1e-300))
        self.sizes = np.log10(np.maximum(sizes, 1))
        self.unseen = np.log10(unseen) - np.log10(1 + once * max(once - 1, 0) / (2 * (twice + 1)))


SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "part"]


def _scored(model: ClassModel, now: np.ndarray, ends: int, kind: pa.DataType):
    c = model.classes
    types = [kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches):
        for row, known in _chunk_rows(batches):
            _, of = _word_classes(row, known, now, 0)
            numbers, states, doc, counted = _stream(row, of, c, False)
            n = _unpacked(row["n"], "<i8")
            end = numbers < 0
            count = np.where(end, ends, np.r_[n, 0][numbers])
            seen = count > 0
            context = np.where(seen, states, c + 1)
            context[end] = c
            before = np.r_[c, context[:-1]]
            inside = np.log10(np.maximum(count, 1)) - model.sizes[states]
            inside[end] = 0
            score = np.where(seen | end, model.moves[before, states] + inside, model.unseen[before])
            base = np.log10(count + 1) - np.log10(model.tokens + model.distinct + 1)
            docs = len(row["docs"])
            sums = [np.bincount(doc, w * counted, docs) for w in (base, score)]
            tokens, hits = (np.bincount(doc, w, docs).astype(np.int64) for w in (counted, seen & counted))
            columns = [row["docs"], _unpacked(row["held"], "u1").astype(bool), tokens, hits, np.full(docs, model.tokens), *sums, [row["part"]] * docs]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=SCORED)

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classes: int = CLASSES, exchanged: int = EXCHANGED, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every document.

    Learns from the documents whose crc32(doc_id) mod 7 is not 2.
    """
    if not 1 <= classes <= 200:
        raise ValueError("classes must be from 1 to 200")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), 7, 2).alias("held"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow = rows.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    buckets, width = SPREAD * partitions(spark), classes + 2
    with Scratch(spark) as scratch, shuffles_dropped(spark):
        coded = scratch.table(rows.mapInArrow(tidied(_coded(chunk, buckets)), CODED.format(kind=kind)), "coded", **_ZSTD)

        def by_bucket(sent: DataFrame) -> DataFrame:
            return sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")

        # training counts of all words, and the exchanged words: at most `exchanged` rows
        sent = coded.select("chunk", "words", "wlens", "counts", "edges").mapInArrow(tidied(_lexicon_rows), WORDS)
        counted = scratch.table(by_bucket(sent).mapInArrow(tidied(_totals(exchanged)), f"{LEXICON}, v long, total long, once long, twice long, word binary, n long"), "counts")
        whole = counted.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("v", "total", "once", "twice")]).first()
        ends = rows.where("NOT held").count()
        best = counted.where("word IS NOT NULL").select("word", "n").orderBy(F.desc("n"), "word").limit(exchanged).collect()
        top = [bytes(r["word"]) for r in best]
        lexicon = counted.where("chunk >= 0").select("chunk", "bucket", "known")
        known = scratch.table(_with_lexicon(lexicon, coded, buckets).mapInArrow(tidied(_placed(top, arrow)), KNOWN.format(kind=kind)), "known", **_ZSTD)
        scratch.drop("coded")
        scratch.drop("counts")
        now, affinity = exchange(known, len(top), classes, rounds)

        def counts(lexicon: DataFrame | None, now: np.ndarray, turn: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
            """What is around all words in a table, the transitions, and what is around the exchanged words."""
            chunks = known.select("chunk", "held", "lens", "head", "tail", "ids", "n", "place", "words", "wlens", "edges")
            chunks = _with_lexicon(lexicon, chunks, buckets) if lexicon is not None else chunks.withColumn("known", F.lit(None).cast("binary"))
            table = scratch.table(chunks.mapInArrow(tidied(_round(now, classes, lexicon is not None)), ROUND), f"round{turn}", **_ZSTD)
            cells = _summed(table.where("block IS NOT NULL").select("block", "cells"), width * width + 2 * width * len(top))
            return table, cells[: width * width].reshape(width, width), cells[width * width :].reshape(len(top), 2 * width)

        def suited(table: DataFrame, affinity: np.ndarray, turn: int) -> DataFrame:
            sent = by_bucket(table.where("block IS NULL").select("chunk", "bucket", "words", "wlens", "sizes", "around", "times"))
            return scratch.table(sent.mapInArrow(tidied(_suited(affinity)), LEXICON), f"classes{turn}", **_ZSTD)

        turn, chosen = 0, None
        table, *_ = counts(None, now, turn)
        lexicon = suited(table, affinity, turn)
        scratch.drop("round0")
        while True:
            turn += 1
            table, moves, around = counts(lexicon, now, turn)
            level = _likelihood(moves[: classes + 1, : classes + 1])
            gain = level - chosen[0] if chosen else np.inf
            if gain > 0:
                chosen = level, lexicon, now, moves
            if gain < GAIN or not whole["total"]:
                break
            affinity = _affinity(moves[: classes + 1, :classes], moves[:classes, : classes + 1].T, width)
            lexicon, now = suited(table, affinity, turn), (around @ affinity).argmax(1)
            scratch.drop(f"round{turn}")
        scratch.drop(f"round{turn}")
        _, lexicon, now, moves = chosen
        model = ClassModel(moves, classes, whole["total"] + ends, whole["v"] + (ends > 0), whole["once"], whole["twice"])
        chunks = known.select("chunk", "docs", "held", "lens", "part", "head", "tail", "ids", "n", "place")
        fields = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, part long"
        scored = scratch.table(_with_lexicon(lexicon, chunks, buckets).mapInArrow(tidied(_scored(model, now, ends, arrow)), fields), "scored")
        # texts that fill chunks of their own
        firsts = [F.first(c).alias(c) for c in ("doc_id", "held_out")]
        sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known")] + [F.first("train_tokens").alias("train_tokens")] + [F.sum(c).alias(c) for c in ("base_score", "score")]
        long = scored.where("part IS NOT NULL").groupBy("part").agg(*firsts, *sums).select(*SCORED)
        out = scored.where("part IS NULL").unionByName(long).drop("part")
        return checkpoint(out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
