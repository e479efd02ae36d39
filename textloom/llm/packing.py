"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, equal lengths share a bucket.

No sequence crosses a document and none needs padding. Defined results: a null or empty text is the closing id alone (one
piece of length 1); repeated rows are packed each on their own; a null doc_id stays null; an empty table gives no row. Pieces
of one length are numbered by a hash of document and text, then by their place; of repeated rows (ties) any may come first. A
text of any length is encoded whole, by itself if it is above ``BYTES``. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, checkpoint, identity, running_sums, tidied
from .words import utf8

PIECES = "doc_id {kind}, ident string, start long, length long, ids_crc32 long, doc_tokens long"
#: Texts encoded at a time, and about how many bytes of them.
ROWS, BYTES = 4096, 4 << 20
#: Entries of a Python worker's memo, some 200 bytes each; what comes after is encoded anew in every batch.
MEMO = 800_000
#: Fixed value: how byte-level BPE cuts a text into pre-tokens.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks that are neither letters, numbers nor white space, without the apostrophe.
MARKS = ".,!?;:*&$%#|()[]{}\"/-_=+"
_CODERS: dict[str, WordCoder] = {}


class WordCoder:
    """Ids of whole texts from a BPE file; each distinct pre-token is encoded once.

    With byte-level pre-tokens a blank before a non-blank always begins one, so texts are cut there, equal parts of a batch
    become one, and only these are looked up; a part not yet known is cut into its pre-tokens. Texts where that does not
    hold (two blanks in a row, a blank at the end) and files of another kind are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        kind = json.loads(pre.__getstate__()) if pre else {}
        self.byte_level = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not self.tokenizer.normalizer
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(PRETOKEN).findall
        # by what follows a blank, or by a NUL and what has no blank before it
        self.memo: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretokens(self, name: str) -> list[str]:
        """The names of the pre-tokens of a part; letters, or letters and then marks, need no search."""
        if name.isalpha():
            return [name]
        word = name.rstrip(MARKS)
        if word.isalpha():
            return [word, "\0" + name[len(word) :]]
        return [t[1:] if t[0] == " " else "\0" + t for t in self.cut(name[1:] if name[:1] == "\0" else f" {name}")]

    def _fresh(self, missing: list[str]) -> list[bytes]:
        """Ids of parts that the memo lacks; kept in it while it has room."""
        known = self.memo
        cut = {name: self._pretokens(name) for name in missing}
        wanted = list({t for c in cut.values() for t in c if t not in known})
        table = dict(zip(wanted, self._encode([t[1:] if t[:1] == "\0" else f" {t}" for t in wanted])))
        for name, pretokens in cut.items():
            if name not in table:
                table[name] = b"".join([table[t] if t in table else known[t] for t in pretokens])
        if len(known) < MEMO:
            known.update(table)
        return [table[name] for name in missing]

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts can't be cut at blanks."""
        if not self.byte_level:
            return np.ones(len(texts), bool)
        found = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " "))
        for mark in ("\0", *self.special):
            found = pc.or_(found, pc.match_substring(texts, mark))
        return found.to_numpy(zero_copy_only=False)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without nulls), one after the other, and the offsets of each text's."""
        whole = self._whole(texts)
        # parts are named by what follows their blank; a text's first part, which has none, by a NUL
        cut = pc.split_pattern(pc.binary_join_element_wise("\0", texts.filter(pa.array(~whole)), ""), " ")
        named = cut.flatten().dictionary_encode()
        names = named.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.memo.get, names))
        holes = [i for i, known in enumerate(ids) if known is None]
        for i, found in zip(holes, self._fresh([names[i] for i in holes])):
            ids[i] = found
        ids += self._encode(texts.filter(pa.array(whole)).to_pylist())
        # the parts of every text: places in ids
        parts, edges = named.indices.to_numpy(), cut.offsets.to_numpy().astype(np.int64)
        if whole.any():
            count, first = np.ones(len(texts), np.int64), np.arange(len(texts))
            count[~whole], first[~whole] = np.diff(edges), edges[:-1]
            first[whole] = len(named) + np.arange(int(whole.sum()))
            parts = np.r_[parts, np.arange(len(names), len(ids), dtype=parts.dtype)]
            edges = np.r_[0, np.cumsum(count)]
            parts = parts[np.repeat(first - edges[:-1], count) + np.arange(edges[-1])]
        joined = pa.array(ids, pa.large_binary()).take(pa.array(parts))
        _, ends, data = joined.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(parts) + 1]
        return np.frombuffer(data, "<u4")[: ends[-1] // 4], ends[edges] // 4


def coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def binary_pieces(total: int, longest: int) -> list[int]:
    """Full pieces first, then the binary digits of the rest, largest first."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def byte_runs(column: pa.Array, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows, at most so many and of about so many bytes in all."""
    _, offsets = utf8(column)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), at + rows, len(column))
        yield at, end
        at = end


def pieces(docs: DataFrame, tokenizer: str, longest: int = 1024, closing_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, ident, start, length, ids_crc32, doc_tokens."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), identity(F.col(doc_id), F.col(text)).alias("ident"), F.col(text).cast("string").alias("text"))
    end = np.asarray([closing_id], "<u4").tobytes()

    def cut(batches):
        encode = coder(tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for begin, stop in byte_runs(texts, ROWS, BYTES):
                ids, offsets = encode(texts.slice(begin, stop - begin))
                source, start, length, crc, total = [], [], [], [], []
                for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()), begin):
                    own = memoryview(ids[a:b].tobytes() + end)
                    n, done = b - a + 1, 0
                    for size in binary_pieces(n, longest):
                        source.append(row)
                        start.append(done)
                        length.append(size)
                        crc.append(zlib.crc32(own[4 * done : 4 * (done + size)]))
                        total.append(n)
                        done += size
                keys = batch.select(["doc_id", "ident"]).take(pa.array(source, pa.int64()))
                yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=[*keys.schema.names, "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(tidied(cut), PIECES.format(kind=kind.simpleString()))


def pack(docs: DataFrame, tokenizer: str, longest: int = 1024, closing_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All pieces with their sequence: one piece fills one sequence of its own length, sequences of a length are numbered together."""
    with Scratch(docs.sparkSession) as scratch:
        cut = pieces(docs, tokenizer, longest, closing_id, doc_id, text).withColumn("bucket", F.lpad(F.col("length").cast("string"), 12, "0"))
        cut = scratch.table(cut.withColumn("one", F.lit(1).cast("long")), "pieces")
        salt = F.monotonically_increasing_id()
        numbered = running_sums(scratch, cut.withColumn("salt", salt), "bucket", [F.col("ident"), F.col("start"), F.col("salt")], "one", "numbered")
        # at most one row per power of two up to the longest
        sizes = [(r["bucket"], r["n"]) for r in cut.groupBy("bucket").agg(F.count("*").alias("n")).collect()]
        first, done = {}, 0
        for bucket, n in sorted(sizes, reverse=True):
            first[bucket], done = done, done + n
        base = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[F.col("bucket")] if first else F.lit(0)
        out = numbered.select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("before") + base.cast("long")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        )
        return checkpoint(out)
