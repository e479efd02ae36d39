"""Exact deduplication by a Grace hash: partition by hash until a bucket fits an open-addressing table of whole contents.

Stage 1 runs where the rows are read: each task keeps a bounded table of contents and names a local leader for every row,
so a text held by a third of all rows leaves a task about once. Only leaders carry their content on. Stage 2 deals the leaders
out by hash and deduplicates each bucket; a bucket above ``memory_bytes`` is split again on further hash bits into spill files
of the task, recursively. A text with more than ``fan`` leaders is first deduplicated within salted parts of at most about
``fan``, in rounds, so no task meets all its leaders. Contents are always compared in full, hashes only choose the slot.

Defined results: null counts as empty; texts are equal when identical after lower-casing A-Z; of equal rows the largest
doc_id stays, null being smallest, and of rows that also share it exactly one (ties); rows that repeat are each counted in
group_size; a text of any length is one content, held whole by the task that compares it; an empty table gives no row. With
``keep_rows`` all other columns pass through unchanged, whatever their names; without it only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, checkpoint, partitions, parts, row_identity, rows_named, tidied

#: Bytes of contents, as Python holds them, in a bucket's table and in the table of a reading task.
MEMORY_BYTES, LOCAL_BYTES = 16 << 20, 8 << 20
#: What an entry takes besides its content (objects, list places and slots), and a member of a class.
ENTRY, MEMBER = 200, 48
SPLITS, FAN = 16, 256
#: Most rows of a table of hot texts that is broadcast.
HOT_ROWS = 100_000


def digest(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry's number, contents decide equality."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.held = 0

    def find(self, hashed: int, content: bytes) -> tuple[int, bool]:
        """The entry with this content and whether it is new."""
        mask = len(self.slots) - 1
        at = hashed & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == hashed and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        entry = len(self.contents)
        self.slots[at] = entry
        self.hashes.append(hashed)
        self.contents.append(content)
        self.held += len(content) + ENTRY
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


Leader = tuple[int, bytes]


def grace(rows: Iterator[Leader], memory_bytes: int, hasher: Callable[[bytes], bytes] = digest, level: int = 0, folder: str | None = None) -> Iterator[list[int]]:
    """Yields the numbers of each class of equal contents. Rows are (number, content)."""
    table, classes = ContentTable(), []
    rows = iter(rows)
    for number, content in rows:
        hashed = hasher(content)
        entry, fresh = table.find(int.from_bytes(hashed[8:16], "little"), content)
        if fresh:
            classes.append([])
        classes[entry].append(number)
        table.held += MEMBER
        if table.held > memory_bytes and len(table.contents) > 1 and level < 8:
            break
    else:
        yield from classes
        return
    own = tempfile.mkdtemp(prefix="grace-", dir=folder)
    try:
        files = [open(os.path.join(own, f"{k}"), "wb") for k in range(SPLITS)]

        def spill(number: int, content: bytes) -> None:
            into = files[(hasher(content)[level] >> 2) % SPLITS]
            into.write(number.to_bytes(8, "little", signed=True) + len(content).to_bytes(8, "little") + content)

        for entry, members in enumerate(classes):
            for number in members:
                spill(number, table.contents[entry])
        table = classes = None
        for number, content in rows:
            spill(number, content)
        for f in files:
            f.close()
        for k in range(SPLITS):
            yield from grace(_spilled(os.path.join(own, f"{k}")), memory_bytes, hasher, level + 1, own)
            os.remove(os.path.join(own, f"{k}"))
    finally:
        shutil.rmtree(own, ignore_errors=True)


def _spilled(path: str) -> Iterator[Leader]:
    with open(path, "rb") as f:
        while head := f.read(16):
            yield int.from_bytes(head[:8], "little", signed=True), f.read(int.from_bytes(head[8:], "little"))


class LocalLeaders:
    """Names a leader for every content a task meets; a full table is emptied but for what was met more than once."""

    def __init__(self, first: int, most: int) -> None:
        self.next, self.most = first, most
        self.table, self.leaders, self.times = ContentTable(), [], []

    def lead(self, content: bytes, sha: bytes) -> tuple[int, int]:
        """The row's number and its leader's."""
        if self.table.held > self.most:
            self._emptied()
        entry, fresh = self.table.find(int.from_bytes(sha[8:16], "little"), content)
        if fresh:
            self.leaders.append(self.next)
            self.times.append(0)
        self.times[entry] += 1
        self.next += 1
        return self.next - 1, self.leaders[entry]

    def _emptied(self) -> None:
        old, leaders, times = self.table, self.leaders, self.times
        self.table, self.leaders, self.times = ContentTable(), [], []
        for entry in sorted((e for e, n in enumerate(times) if n > 1), key=times.__getitem__, reverse=True):
            if self.table.held + len(old.contents[entry]) + ENTRY > self.most // 2:
                break
            self.table.find(old.hashes[entry], old.contents[entry])
            self.leaders.append(leaders[entry])
            self.times.append(1)


def _led(memory_bytes: int):
    def run(batches):
        local = LocalLeaders(TaskContext.get().partitionId() << 40, memory_bytes)
        for batch in parts(batches):
            uids, own, shas, contents = [], [], [], []
            for value in batch.column("text").to_pylist():
                content = (value or b"").lower()
                sha = digest(content)
                uid, leader = local.lead(content, sha)
                uids.append(uid)
                own.append(leader)
                shas.append(sha)
                contents.append(content if uid == leader else None)
            columns = [pa.array(uids, pa.int64()), pa.array(own, pa.int64()), pa.array(shas, pa.binary()), pa.array(contents, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ident"), *columns], names=["doc_id", "ident", "uid", "leader", "sha", "content"])

    return run


def _classes(memory_bytes: int):
    """(leader, class) of all leaders whose content is not alone; class is the smallest leader."""

    def leaders(batches) -> Iterator[Leader]:
        for batch in parts(batches):
            yield from zip(batch.column("leader").to_pylist(), batch.column("content").to_pylist())

    def run(batches):
        out: list[tuple[int, int]] = []
        for members in grace(leaders(batches), memory_bytes):
            if len(members) > 1:
                head = min(members)
                out += [(m, head) for m in members]
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def merged_leaders(scratch: Scratch, firsts: DataFrame, memory_bytes: int, fan: int) -> DataFrame:
    """``firsts`` (leader, sha, content) to (leader, class) of all leaders that share their content with another one."""
    spark = scratch.spark
    steps: list[DataFrame] = []
    # a round leaves about a fan-th of a hot text's leaders; contents that merely share a hash never get fewer
    for turn in range(8):
        counts = firsts.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n") > fan)
        hot = scratch.table(counts, f"hot{turn}")
        n_hot = hot.count()
        if not n_hot:
            break
        side = F.broadcast(hot) if n_hot <= HOT_ROWS else hot
        salt = F.pmod(F.xxhash64("leader"), F.ceil(F.col("n") / fan))
        salted = firsts.join(side, "sha").withColumn("salt", salt).repartition(partitions(spark), "sha", "salt")
        step = scratch.table(salted.select("leader", "content").mapInArrow(tidied(_classes(memory_bytes)), "leader long, class long"), f"step{turn}")
        steps.append(step)
        gone = step.where("leader <> class").select("leader")
        kept = firsts.join(side, "sha", "left_semi").join(gone, "leader", "left_anti").select(*firsts.columns)
        kept = scratch.table(kept, f"kept{turn}")
        firsts = firsts.join(side, "sha", "left_anti").select(*firsts.columns).unionByName(kept)
    dealt = firsts.repartition(partitions(spark), "sha").select("leader", "content")
    last = scratch.table(dealt.mapInArrow(tidied(_classes(memory_bytes)), "leader long, class long"), "classes")
    for step in reversed(steps):
        later = last.select(F.col("leader").alias("class"), F.col("class").alias("final"))
        moved = step.join(later, "class", "left").select("leader", F.coalesce("final", "class").alias("class"))
        last = moved.unionByName(last.join(step.select("leader"), "leader", "left_anti"))
    return last


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memory_bytes: int = MEMORY_BYTES, local_bytes: int = LOCAL_BYTES, fan: int = FAN, keep_rows: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With ``keep_rows`` instead the rows that stay, in the columns of ``docs``.
    """
    ident = row_identity(docs) if keep_rows else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"), ident.alias("ident"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    with Scratch(docs.sparkSession) as scratch:
        led = scratch.table(rows.mapInArrow(tidied(_led(local_bytes)), f"doc_id {kind}, ident string, uid long, leader long, sha binary, content binary"), "rows")
        best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), F.col("uid").alias("uid")))
        local = led.groupBy("leader").agg(best.alias("best"), F.count("*").alias("n"))
        firsts = led.where("uid = leader").select("leader", "sha", "content")
        local = local.join(merged_leaders(scratch, firsts, memory_bytes, fan), "leader", "left")
        lone = local.where(F.col("class").isNull()).select("leader", "best", "n")
        shared = local.where(F.col("class").isNotNull())
        total = shared.groupBy("class").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        verdict = lone.unionByName(shared.select("leader", "class").join(total, "class").select("leader", "best", "n"))
        verdict = verdict.select("leader", F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), F.col("n").alias("group_size"))
        slim = led.select("doc_id", "ident", "uid", "leader", "sha").join(verdict, "leader")
        stays = F.col("uid") == F.col("keep_uid")
        if keep_rows:
            return rows_named(docs, checkpoint(slim.where(stays).select("ident")))
        return checkpoint(slim.select(F.col("doc_id").alias(doc_id), "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")))


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["leader", "class"])
