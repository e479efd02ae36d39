"""Self-join on the Jaccard similarity of word 5-grams, candidates pruned by Bayesian inference on MinHash values.

1. One pass over the texts: distinct 5-gram hashes, a digest of the whole set and 128 MinHash values of 16 bits. Texts with
   the same set become one node with a multiplicity, so copies are never paired with each other.
2. Nodes that agree in one of 32 bands of 4 values meet in a bucket. Buckets with the same members are read once. Inside a
   bucket values are compared 16 at a time and a pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold falls below ``tolerance``. Where few pairs survive (at most ``SPARSE`` a member) they are named one by
   one, each by the first band its two nodes share; where many do, spanning links name a dense group instead.
3. The exact similarity of the surviving pairs is computed from whole texts: pairs outside dense groups around the smaller of
   their two nodes, those within a dense group in blocks, in which the values prune again. Counts and spanning links leave the
   task, never the pairs of a dense group. Buckets and groups above a tile's size are dealt out over tiles of block pairs, and
   a node with many partners over parts of ``PARTNERS``. Unlike texts that only hang together by a chain are no group.

A pair of similarity exactly 0.8 shares no band with probability (1 - 0.8^4)^32 < 5e-8.

Defined results: null counts as empty; a text without words is alone in its class; fewer than five words are one gram;
identical rows are copies of each other; a null doc_id takes no part in class_id unless all are null. Ties: a similarity of
exactly the threshold links, and of rows with the smallest doc_id the first by identity stays. A text of any length is read
whole. Other columns only take part in the row's identity (``near_join``) or pass through unchanged (``near_dedup``), whatever
their names. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import classed, components
from .runtime import Scratch, checkpoint, partitions, row_identity, rows_named, tidied
from .words import SHINGLE, gram_hashes, mix64, word_hashes

THRESHOLD = 0.8
HASHES, BAND, STEP = 128, 4, 16
TOLERANCE = 1e-9
BUCKET_TILE, GROUP_TILE = 1024, 512
#: Surviving pairs a member up to which a bucket's pairs are named, and partners of a node that one task compares.
SPARSE, PARTNERS = 2, 256
_SEEDS = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIP = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32)[:, None]
_TIMES = ((_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]


def gram_set(words: np.ndarray) -> np.ndarray:
    """The distinct 5-gram hashes of one text, sorted."""
    return np.unique(gram_hashes(words, SHINGLE))


def signature(grams: np.ndarray) -> np.ndarray:
    """128 MinHash values, each cut to 16 bits of a hash of the minimum."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        low = np.minimum(low, ((short[at : at + 4096] ^ _FLIP) * _TIMES).min(1))
    return (mix64(low.astype(np.uint64) + np.uint64(1)) >> np.uint64(48)).astype("<u2")


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... values seen: matches below which P(similarity >= threshold) < tolerance, from a uniform prior.

    With m of n matching, the posterior is Beta(m + 1, n - m + 1), so that probability is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of equal keys of sorted batches: a table and the offsets of its runs."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, part]) if rest is not None else part
        first = _run_starts(rest, keys)
        if len(first) > 1:
            done = rest.slice(0, first[-1]).combine_chunks()
            rest = rest.slice(first[-1])
            yield done, first
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.r_[_run_starts(rest, keys), rest.num_rows]


def _run_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    for key in keys:
        x = rows.column(key).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    if rows.num_rows:
        change[0] = True
    return np.flatnonzero(change)


def tiled(rows: DataFrame, group: str, node: str, size: str, most: int) -> DataFrame:
    """Deals each group's rows over tiles of block pairs: adds tile (long) and block (int); one tile up to ``most`` rows."""
    blocks = F.ceil(F.col(size) / most).cast("long")
    block = F.pmod(F.xxhash64(node, group), F.col("blocks"))
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda q: F.least(F.col("block"), q) * F.col("blocks") + F.greatest(F.col("block"), q),
    )
    return rows.withColumn("blocks", blocks).withColumn("block", block).withColumn("tile", F.explode(pair))


def dealt(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), group, "tile").sortWithinPartitions(group, "tile")


def tile_sides(tile: int, blocks: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows of the first block, and of the second unless it is the same one."""
    low, high = divmod(tile, blocks)
    return np.flatnonzero(block == low), None if low == high else np.flatnonzero(block == high)


def joined_labels(n: int) -> np.ndarray:
    return np.arange(n)


def unite(labels: np.ndarray, i: int, others: np.ndarray) -> None:
    """Gives everything that shares a label with ``i`` or ``others`` one label."""
    found = np.unique(np.r_[labels[i], labels[others]])
    if len(found) > 1:
        labels[np.isin(labels, found)] = found[0]


def _survivors(sig: np.ndarray, i: int, others: np.ndarray, least: list[int]) -> np.ndarray:
    """The others whose values keep the posterior above the tolerance."""
    matches = np.zeros(len(others), np.int64)
    for k, need in enumerate(least):
        cut = slice(k * STEP, (k + 1) * STEP)
        matches += (sig[others, cut] == sig[i, cut]).sum(1)
        alive = matches >= need
        if not alive.all():
            others, matches = others[alive], matches[alive]
        if not len(others):
            break
    return others


def _shared_band(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first band in which the nodes of each pair agree."""
    bands = np.ascontiguousarray(sig).view("<u8")
    return (bands[i] == bands[j]).argmax(1)


def _tile_survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray | None, least: list[int], most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The surviving pairs of a tile, or None as soon as there are more than ``most``."""
    i, j, held = [], [], 0
    for place, k in enumerate(left):
        found = _survivors(sig, int(k), left[place + 1 :] if right is None else right, least)
        held += len(found)
        if held > most:
            return None
        i.append(np.full(len(found), k))
        j.append(found)
    return np.concatenate(i), np.concatenate(j)


def _tile_links(sig: np.ndarray, left: np.ndarray, right: np.ndarray | None, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together whatever the surviving pairs of a tile do; nodes already together are not compared."""
    labels = joined_labels(len(sig))
    for place, i in enumerate(left):
        others = left[place + 1 :] if right is None else right
        others = others[labels[others] != labels[i]]
        if len(others):
            found = _survivors(sig, int(i), others, least)
            if len(found):
                unite(labels, int(i), found)
    moved = np.flatnonzero(labels != np.arange(len(sig)))
    return moved, labels[moved]


def _pruned(least: list[int]):
    """(a, b, dense): surviving pairs, or links of a dense group."""

    def run(batches):
        for rows, at in runs(batches, ["bucket", "tile"]):
            nid, block, band = (rows.column(c).to_numpy() for c in ("nid", "block", "band"))
            tile, blocks = rows.column("tile").to_numpy(), rows.column("blocks").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
            size = np.diff(at)
            two = at[:-1][size == 2]
            keep = np.ones(len(two), bool)
            matches = np.zeros(len(two), np.int64)
            for k, need in enumerate(least):
                cut = slice(k * STEP, (k + 1) * STEP)
                matches += (sig[two, cut] == sig[two + 1, cut]).sum(1)
                keep &= matches >= need
            keep &= (tile[two] // blocks[two] == tile[two] % blocks[two]) | (block[two] != block[two + 1])
            keep[keep] = _shared_band(sig, two[keep], two[keep] + 1) == band[two[keep]]
            a, b, dense = [nid[two[keep]]], [nid[two[keep] + 1]], [np.zeros(int(keep.sum()), bool)]
            for start, n in zip(at[:-1][size > 2], size[size > 2]):
                own, name = sig[start : start + n], nid[start : start + n]
                sides = tile_sides(int(tile[start]), int(blocks[start]), block[start : start + n])
                pairs = _tile_survivors(own, *sides, least, SPARSE * int(n)) if len(sides[0]) else None
                if pairs is None:
                    i, j = _tile_links(own, *sides, least)
                else:
                    first = _shared_band(own, *pairs) == band[start]
                    i, j = pairs[0][first], pairs[1][first]
                a.append(name[i])
                b.append(name[j])
                dense.append(np.full(len(i), pairs is None))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, dense)], names=["a", "b", "dense"])

    return run


def _alive(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of two blocks of values survive."""
    matches, alive = np.zeros((len(left), len(right)), np.int16), np.ones((len(left), len(right)), bool)
    for k, need in enumerate(least):
        for c in range(k * STEP, (k + 1) * STEP):
            matches += left[:, c, None] == right[None, :, c]
        alive &= matches >= need
        if not alive.any():
            break
    return alive


def _compared_pairs(threshold: float):
    """(nid, links, other) of the pairs of a hub, the node whose row comes first, and its partners."""

    def run(batches):
        for rows, at in runs(batches, ["hub", "part"]):
            nid, hub, mult = (rows.column(c).to_numpy() for c in ("nid", "hub", "mult"))
            text = rows.column("text").combine_chunks()
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            out: list[tuple[int, int, int]] = []
            for start, end in zip(at[:-1], at[1:]):
                words, offsets = word_hashes(text.slice(start, end - start))
                sets = [gram_set(words[offsets[k] : offsets[k + 1]]) for k in range(end - start)]
                centre = int(np.flatnonzero(nid[start:end] == hub[start])[0])
                total = 0
                for k in range(end - start):
                    if k == centre:
                        continue
                    both = len(np.intersect1d(sets[centre], sets[k], assume_unique=True))
                    if both / (len(sets[centre]) + len(sets[k]) - both) >= threshold:
                        out.append((nid[start + k], mult[start + centre], hub[start]))
                        total += int(mult[start + k])
                if total:
                    out.append((hub[start], total, hub[start]))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["nid", "links", "other"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, over the grams that occur on both sides."""
    rows_l, rows_r = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    flat_l, flat_r = (np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (left, right))
    names, place = np.unique(np.r_[flat_l, flat_r], return_inverse=True)
    in_l, in_r = place[: len(flat_l)], place[len(flat_l) :]
    if left is right:
        common = np.bincount(in_l, minlength=len(names)) > 1
    else:
        common = (np.bincount(in_l, minlength=len(names)) > 0) & (np.bincount(in_r, minlength=len(names)) > 0)
    column = np.cumsum(common) - 1
    out = np.zeros((len(left), len(right)), np.float32)
    width = int(common.sum())
    pick_l, pick_r = common[in_l], common[in_r]
    cols_l, cols_r, rows_l, rows_r = column[in_l[pick_l]], column[in_r[pick_r]], rows_l[pick_l], rows_r[pick_r]
    step = 8192
    for at in range(0, width, step):
        x = np.zeros((len(left), min(step, width - at)), np.float32)
        here = (cols_l >= at) & (cols_l < at + step)
        x[rows_l[here], cols_l[here] - at] = 1
        if left is right:
            y = x
        else:
            y = np.zeros((len(right), x.shape[1]), np.float32)
            here = (cols_r >= at) & (cols_r < at + step)
            y[rows_r[here], cols_r[here] - at] = 1
        out += x @ y.T
    return out


def _verified(threshold: float, least: list[int]):
    def run(batches):
        for rows, at in runs(batches, ["root", "tile"]):
            nid, mult, block = (rows.column(c).to_numpy() for c in ("nid", "mult", "block"))
            tile, blocks = rows.column("tile").to_numpy(), rows.column("blocks").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
            text = rows.column("text").combine_chunks()
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            out: list[list[np.ndarray]] = [[], [], []]
            for start, end in zip(at[:-1], at[1:]):
                words, offsets = word_hashes(text.slice(start, end - start))
                sets = [gram_set(words[offsets[k] : offsets[k + 1]]) for k in range(end - start)]
                sizes = np.array([len(s) for s in sets])
                left, right = tile_sides(int(tile[start]), int(blocks[start]), block[start:end])
                side = left if right is None else right
                alive = _alive(sig[start + left], sig[start + side], least)
                some, others = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
                one = [sets[i] for i in left[some]]
                other = one if right is None and np.array_equal(some, others) else [sets[i] for i in side[others]]
                shared = intersections(one, other).astype(np.float64)
                union = sizes[left[some]][:, None] + sizes[side[others]][None, :] - shared
                linked = np.zeros(alive.shape, bool)
                linked[np.ix_(some, others)] = shared / np.where(union == 0, 1, union) >= threshold
                linked &= alive
                if right is None:
                    np.fill_diagonal(linked, False)
                labels = joined_labels(end - start)
                for place in np.flatnonzero(linked.any(1)):
                    unite(labels, int(left[place]), side[linked[place]])
                weight = mult[start:end]
                links = np.zeros(end - start, np.int64)
                links[left] += linked @ weight[side]
                if right is not None:
                    links[right] += linked.T @ weight[left]
                got = np.flatnonzero(links)
                for column, value in zip(out, (nid[start + got], links[got], nid[start + labels[got]])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["nid", "links", "other"])

    return run


def _signed(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            words, offsets = word_hashes(part.column("text"))
            nodes, sigs = [], []
            for k in range(part.num_rows):
                if offsets[k] == offsets[k + 1]:
                    nodes.append(None)
                    sigs.append(None)
                    continue
                grams = gram_set(words[offsets[k] : offsets[k + 1]])
                nodes.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                sigs.append(signature(grams).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ident"), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "ident", "node", "sig"])


def _banded(batches):
    bands = HASHES // BAND
    salt = (np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u8").reshape(-1, bands)
        keys = mix64(sig + salt).view(np.int64).ravel()
        numbers = np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("nid").to_numpy(), bands)), pa.array(keys), pa.array(numbers)], names=["nid", "bucket", "band"])


def lone_pairs(near: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b), the smaller first, that no dense group holds both nodes of."""
    every = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    pairs = near.where("NOT dense").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    placed = pairs.join(every.select(F.col("node").alias("a"), F.col("root").alias("p")), "a", "left").join(every.select(F.col("node").alias("b"), F.col("root").alias("q")), "b", "left")
    return placed.where("p IS NULL OR q IS NULL OR p <> q").select("a", "b")


def _with_text(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (nid, ...) with the multiplicity, the values and one text of each node."""
    named = wanted.join(nodes.select("nid", "mult", "sig", F.col("first.ident").alias("ident")), "nid")
    texts = rows.select("ident", "text").join(named.select("ident").distinct(), "ident", "left_semi").dropDuplicates(["ident"])
    return named.join(texts, "ident")


def _sparse_links(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(nid, links, other) of single pairs, compared around their smaller node, in parts where it has many partners."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    partners = pairs.join(parts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("nid"))
    hubs = parts.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("nid"))
    whole = _with_text(rows, nodes, partners.unionByName(hubs)).select("hub", "part", "nid", "mult", "text")
    whole = whole.repartition(partitions(rows.sparkSession), "hub", "part").sortWithinPartitions("hub", "part")
    return whole.mapInArrow(tidied(_compared_pairs(threshold)), "nid long, links long, other long")


def _dense_links(rows: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float, least: list[int], tile: int) -> DataFrame:
    """(nid, links, other) of the pairs within dense groups, in blocks."""
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = groups.groupBy("root").agg((F.count("*") + 1).alias("n"))
    members = members.join(sizes, "root").withColumnRenamed("node", "nid")
    whole = tiled(_with_text(rows, nodes, members), "root", "nid", "n", tile).select("root", "tile", "nid", "mult", "sig", "blocks", "block", "text")
    return dealt(whole, "root").mapInArrow(tidied(_verified(threshold, least)), "nid long, links long, other long")


def near_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, bucket_tile: int = BUCKET_TILE, group_tile: int = GROUP_TILE) -> DataFrame:
    """One row per document: doc_id, ident, class_id (smallest doc_id of the class), n_links (other documents linked directly), kept."""
    ident = row_identity(docs)
    rows = docs.select(F.col(doc_id).alias("doc_id"), ident.alias("ident"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.table(rows.mapInArrow(tidied(_signed), f"doc_id {kind}, ident string, node binary, sig binary"), "signed")
        first = F.min(_order())
        nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("mult"), first.alias("first"), F.first("sig").alias("sig"))
        nodes = scratch.table(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
        # 2: buckets, the same members once, under the first of their bands
        least = least_matches(threshold, tolerance)
        bands = nodes.select("nid", "sig").mapInArrow(tidied(_banded), "nid long, bucket long, band int")
        members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("nid")).alias("x"), F.bit_xor(F.xxhash64("nid", F.lit(1))).alias("y"), F.min("band").alias("band")]
        buckets = bands.groupBy("bucket").agg(*members).where("n > 1")
        buckets = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("first")).select("first.bucket", "n", "first.band")
        met = tiled(bands.drop("band").join(buckets, "bucket"), "bucket", "nid", "n", bucket_tile).join(nodes.select("nid", "sig"), "nid")
        met = dealt(met.select("bucket", "tile", "nid", "band", "blocks", "block", "sig"), "bucket")
        near = scratch.table(met.mapInArrow(tidied(_pruned(least)), "a long, b long, dense boolean"), "near")
        groups = components(scratch, near.where("dense").select("a", "b"), "near")
        # 3: exact similarity of the pairs
        found = scratch.table(_sparse_links(rows, nodes, lone_pairs(near, groups), threshold).unionByName(_dense_links(rows, nodes, groups, threshold, least, group_tile)), "links")
        classes = components(scratch, found.select(F.col("nid").alias("a"), F.col("other").alias("b")), "classes")
        # back to documents
        links = found.groupBy("nid").agg(F.sum("links").alias("links"))
        own = nodes.select("node", "nid", "mult", "first").join(links, "nid", "left")
        own = classed(scratch, own, classes, "own").select("node", "head", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
        out = signed.select("doc_id", "ident", "node").join(own, "node", "left")
        return checkpoint(out.select(
            F.col("doc_id"), "ident",
            F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            (F.col("head").isNull() | (F.col("head.ident") == F.col("ident"))).alias("kept"),
        ))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("ident").alias("ident"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: the one with the smallest doc_id of every class, one of identical rows."""
    return rows_named(docs, near_join(docs, **options).where("kept").select("ident"))
