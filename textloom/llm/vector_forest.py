"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared only within their label. Identical vectors become one node with a multiplicity. Each tree halves a
label's nodes by random directions at the sample's median, both halves keeping what lies within ``spill`` of it, until a
leaf is expected to hold ``leaf`` nodes. The trees are fitted on at most ``SAMPLE_BYTES`` of vectors and then every node is
routed through all of them. A leaf that comes out above ``tile`` nodes is split again by a tree fitted on ``LEAF_SAMPLE`` of its
own nodes, in rounds, so leaves stay of one size however many nodes there are; only a part that no direction can halve (a
dense group) stays a large one.

Within a leaf all pairs are compared exactly, in blocks; a leaf above ``tile`` nodes is dealt out over tiles of block
pairs. A pair is counted in the first leaf its two nodes share, so counts are exact over all trees. Pairs never leave a
task, only counts and spanning links do; links are united by connected components.

Recall against brute force is measured in the tests (at least 0.9 is asked for; 0.97 is held there at several sizes).

Defined results: vectors that are null, empty, zero or hold null or non-finite parts, and rows with a null label, link with
nothing and are their own component; vectors of unequal lengths never link; identical vectors link with each other, repeated
rows included; a null vec_id is never a component's id unless all of its are null. Ties: a cosine of exactly the threshold
links. An empty table gives no row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import classed, components
from .near_join import dealt, joined_labels, runs, tile_sides, tiled, unite
from .runtime import Scratch, checkpoint, partitions, tidied
from .words import mix64

THRESHOLD = 0.93
TREES, LEAF, SPILL, TILE = 8, 256, 0.02, 1024
SAMPLE_BYTES = 32 << 20
#: Fewest sampled vectors that a split may rest on, vectors sampled from a leaf that is split again, and rows of one leaf that a
#: task routes.
LEAST, LEAF_SAMPLE, ROUTED = 32, 1024, 100_000


class Forest:
    """Splits of all trees and labels in flat arrays; children below 0 are leaves (-1 - leaf number)."""

    def __init__(self) -> None:
        self.directions: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[list[int]] = []
        self.roots: dict[str, list[int]] = {}
        self.leaves = 0

    def grow(self, part: str, sample: np.ndarray, count: int, trees: int, leaf: int, spill: float) -> None:
        seed = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
        self.roots[part] = [self._grow(sample, np.arange(len(sample)), count / len(sample), leaf, spill, np.random.Generator(np.random.Philox(key=[seed, t]))) for t in range(trees)]

    def _grow(self, sample: np.ndarray, own: np.ndarray, share: float, leaf: int, spill: float, random: np.random.Generator) -> int:
        if len(own) * share > leaf and len(own) >= LEAST:
            for _ in range(3):
                way = random.standard_normal(sample.shape[1])
                way /= np.linalg.norm(way)
                place = sample[own] @ way
                cut = _cut(place, spill)
                low, high = own[place <= cut + spill], own[place >= cut - spill]
                if max(len(low), len(high)) <= 0.75 * len(own):
                    at = len(self.cuts)
                    self.directions.append(way)
                    self.cuts.append(cut)
                    self.children.append([])
                    self.children[at] = [self._grow(sample, x, share, leaf, spill, random) for x in (low, high)]
                    return at
        self.leaves += 1
        return -self.leaves

    def route(self, part: str, vectors: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (row, leaf) over all trees."""
        rows, leaves = [], []
        stack = [(root, np.arange(len(vectors))) for root in self.roots[part]]
        while stack:
            node, own = stack.pop()
            if node < 0:
                rows.append(own)
                leaves.append(np.full(len(own), -1 - node))
            elif len(own):
                place = vectors[own] @ self.directions[node]
                low, high = self.children[node]
                stack += [(low, own[place <= self.cuts[node] + spill]), (high, own[place >= self.cuts[node] - spill])]
        return np.concatenate(rows), np.concatenate(leaves)


def lone_leaf(part: str) -> int:
    """The leaf of a label that needs no tree."""
    return -1 - (int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little") >> 2)


def _noded(batches):
    for batch in batches:
        labels, vectors = batch.column("label").to_pylist(), batch.column("vector").to_pylist()
        nodes, parts, units = [], [], []
        for label, vector in zip(labels, vectors):
            unit = None
            if label is not None and vector and None not in vector:
                x = np.asarray(vector, np.float64) + 0.0
                # scaled first, so that the squares of huge or tiny parts stay in range
                most = np.abs(x).max()
                if np.isfinite(x).all() and most > 0:
                    unit = x / most
                    unit = unit / np.sqrt(unit @ unit)
            part = None if unit is None else f"{len(unit)}:{label}"
            parts.append(part)
            units.append(None if unit is None else unit.tobytes())
            nodes.append(None if unit is None else hashlib.blake2b(part.encode() + b"\0" + x.tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.binary()), pa.array(parts, pa.string()), pa.array(units, pa.binary())], names=["vec_id", "node", "part", "unit"])


def _routed(forest: Forest, spill: float):
    """(nid, leaf) of every node over all trees."""

    def run(batches):
        for batch in batches:
            parts, units, nid = np.array(batch.column("part").to_pylist(), object), batch.column("unit").to_pylist(), batch.column("nid").to_numpy()
            for part in set(parts):
                own = np.flatnonzero(parts == part)
                if part in forest.roots:
                    rows, leaves = forest.route(part, np.stack([np.frombuffer(units[i]) for i in own]), spill)
                else:
                    rows, leaves = np.arange(len(own)), np.full(len(own), lone_leaf(part))
                yield pa.RecordBatch.from_arrays([pa.array(nid[own[rows]]), pa.array(leaves.astype(np.int64))], names=["nid", "leaf"])

    return run


def _packed(forest: Forest) -> bytes:
    out = io.BytesIO()
    np.savez(out, directions=np.array(forest.directions), cuts=np.array(forest.cuts), children=np.array(forest.children), root=np.array(forest.roots["leaf"]))
    return out.getvalue()


def _unpacked(raw: bytes) -> Forest:
    found, forest = np.load(io.BytesIO(raw)), Forest()
    forest.directions, forest.cuts, forest.children = list(found["directions"]), found["cuts"].tolist(), found["children"].tolist()
    forest.roots["leaf"] = found["root"].tolist()
    return forest


def _leaf_trees(leaf: int, spill: float):
    """(leaf, tree) of the leaves whose sample a direction can halve."""

    def run(batches):
        for rows, at in runs(batches, ["leaf"]):
            units, names, sizes = rows.column("unit").to_pylist(), rows.column("leaf").to_numpy(), rows.column("n").to_numpy()
            found = []
            for a, b in zip(at[:-1], at[1:]):
                sample = np.stack([np.frombuffer(u) for u in sorted(units[a:b])])
                forest = Forest()
                seed = int(names[a]) & (1 << 63) - 1
                forest.roots["leaf"] = [forest._grow(sample, np.arange(len(sample)), max(1.0, sizes[a] / len(sample)), leaf, spill, np.random.Generator(np.random.Philox(key=[seed, 1 << 20])))]
                if forest.leaves > 1:
                    found.append((int(names[a]), _packed(forest)))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["leaf", "tree"])

    return run


def _split_again(spill: float):
    """Nodes of a leaf to the leaves of its tree, which comes before them; new leaves are named by a hash of the old one and their number."""

    def run(batches):
        forest, of = None, None
        for batch in batches:
            leaf, nid, units = batch.column("leaf").to_numpy(), batch.column("nid").to_numpy(zero_copy_only=False), batch.column("unit").to_pylist()
            edges = np.r_[0, np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, len(leaf)] if len(leaf) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if batch.column("tree")[a].is_valid:
                    forest, of = _unpacked(batch.column("tree")[a].as_py()), leaf[a]
                    # the same leaf's tree comes once for each part of it that this task routes
                    while a < b and batch.column("tree")[a].is_valid:
                        a += 1
                if a < b:
                    assert of == leaf[a]
                    rows, number = forest.route("leaf", np.stack([np.frombuffer(u) for u in units[a:b]]), spill)
                    named = mix64(np.uint64(int(leaf[a]) & (1 << 64) - 1) + mix64(number.astype(np.uint64) + np.uint64(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(nid[a:b][rows].astype(np.int64)), pa.array(named.view(np.int64))], names=["nid", "leaf"])

    return run


def refined(scratch: Scratch, routed: DataFrame, nodes: DataFrame, leaf: int, spill: float, tile: int) -> DataFrame:
    """``routed`` (nid, leaf) with every leaf above ``tile`` nodes split by a tree of its own, until none is or none can be."""
    spark, turn = nodes.sparkSession, 0
    done: list[DataFrame] = []
    while True:
        large = scratch.table(routed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > tile), f"large{turn}")
        if large.isEmpty():
            break
        members = routed.join(large, "leaf").join(nodes.select("nid", "unit"), "nid")
        picked = members.where(F.pmod(F.xxhash64("nid", "leaf"), F.col("n")) < LEAF_SAMPLE).select("leaf", "n", "unit")
        picked = picked.repartition(partitions(spark), "leaf").sortWithinPartitions("leaf")
        trees = scratch.table(picked.mapInArrow(tidied(_leaf_trees(leaf, spill)), "leaf long, tree binary"), f"trees{turn}")
        names = trees.select("leaf")
        # what no tree splits is done, as are the leaves that were small enough
        done.append(scratch.table(routed.join(names, "leaf", "left_anti"), f"done{turn}"))
        if trees.isEmpty():
            return reduce(DataFrame.unionByName, done)
        salts = F.ceil(F.col("n") / ROUTED).cast("int")
        rows = members.join(names, "leaf", "left_semi").select("leaf", F.pmod(F.xxhash64("nid"), salts).cast("int").alias("salt"), "nid", "unit", F.lit(None).cast("binary").alias("tree"))
        heads = trees.join(large, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("nid"), F.lit(None).cast("binary").alias("unit"), "tree")
        dealt_ = rows.unionByName(heads).repartition(partitions(spark), "leaf", "salt").sortWithinPartitions("leaf", F.col("tree").isNull())
        routed = scratch.table(dealt_.mapInArrow(tidied(_split_again(spill)), "nid long, leaf long").distinct(), f"routed{turn}")
        turn += 1
    return reduce(DataFrame.unionByName, [*done, routed])


def _cut(place: np.ndarray, spill: float) -> float:
    """Of seven places about the median, the one with the fewest nodes within the spill: dense groups are cut around."""
    ordered = np.sort(place)
    cuts = np.quantile(ordered, np.linspace(0.35, 0.65, 7))
    within = np.searchsorted(ordered, cuts + spill, "right") - np.searchsorted(ordered, cuts - spill)
    return float(cuts[within.argmin()])


def _memberships(lists: list[np.ndarray], below: int) -> np.ndarray:
    """Nodes x the leaves numbered below ``below`` that any of them is in, as 0 and 1."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate(lists)
    owner, flat = owner[flat < below], flat[flat < below]
    names, column = np.unique(flat, return_inverse=True)
    out = np.zeros((len(lists), len(names)), np.float32)
    out[owner, column] = 1
    return out


def _compared(threshold: float):
    def run(batches):
        for rows, at in runs(batches, ["leaf", "tile"]):
            nid, mult, block, leaf, tile, blocks = (rows.column(c).to_numpy() for c in ("nid", "mult", "block", "leaf", "tile", "blocks"))
            parts, units = (rows.column(c).to_pylist() for c in ("part", "unit"))
            listed = rows.column("leaves").combine_chunks()
            listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
            leaves_, edges_ = listed.flatten().to_numpy(), listed.offsets.to_numpy() - listed.offsets[0].as_py()
            out: list[list[np.ndarray]] = [[], [], []]
            for start, end in zip(at[:-1], at[1:]):
                for part in sorted(set(parts[start:end])):
                    own = np.array([k for k in range(start, end) if parts[k] == part])
                    if len(own) < 2:
                        continue
                    left, right = tile_sides(int(tile[start]), int(blocks[start]), block[own])
                    unit = np.stack([np.frombuffer(units[k]) for k in own])
                    side = left if right is None else right
                    i, j = np.nonzero(unit[left] @ unit[side].T >= threshold)
                    if right is None:
                        i, j = i[i < j], j[i < j]
                    i, j = left[i], side[j]
                    if not len(i):
                        continue
                    labels = joined_labels(len(own))
                    edges = np.r_[0, np.flatnonzero(i[1:] != i[:-1]) + 1, len(i)]
                    for a, b in zip(edges[:-1], edges[1:]):
                        unite(labels, int(i[a]), j[a:b])
                    # counted here if they share no leaf before this one
                    earlier = _memberships([leaves_[edges_[k] : edges_[k + 1]] for k in own], int(leaf[start]))
                    shared = earlier[left] @ earlier[side].T
                    here = np.searchsorted(left, i), np.searchsorted(side, j)
                    first = shared[here] == 0
                    i, j = i[first], j[first]
                    weight = mult[own]
                    links = (np.bincount(i, weight[j], len(own)) + np.bincount(j, weight[i], len(own))).astype(np.int64)
                    got = np.flatnonzero((links > 0) | (labels != np.arange(len(own))))
                    for column, value in zip(out, (nid[own[got]], links[got], nid[own[labels[got]]])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["nid", "links", "other"])

    return run


def fit(nodes: DataFrame, trees: int, leaf: int, spill: float, sample_bytes: int = SAMPLE_BYTES) -> Forest:
    """The forest over a hash sample of the nodes, at most ``sample_bytes`` of it; labels of up to ``leaf`` nodes need none."""
    counts = nodes.groupBy("part").agg(F.count("*").alias("n"), F.max(F.length("unit")).alias("w")).where(F.col("n") > leaf)
    whole = counts.agg(F.sum("n").alias("n"), F.max("w").alias("w")).first()
    forest = Forest()
    if not whole["n"]:
        return forest
    most = max(LEAST, sample_bytes // whole["w"])
    share = min(1.0, most / whole["n"])
    picked = nodes.join(counts.select("part", "n"), "part").where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = picked.select("part", "n", "unit").limit(most + most // 4).toArrow()
    parts, sizes, units = np.array(rows["part"].to_pylist(), object), rows["n"].to_pylist(), rows["unit"].to_pylist()
    for part in sorted(set(parts)):
        own = np.flatnonzero(parts == part)
        own = own[np.argsort([units[i] for i in own])]
        forest.grow(part, np.stack([np.frombuffer(units[i]) for i in own]), sizes[own[0]], trees, leaf, spill)
    return forest


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    with Scratch(vectors.sparkSession) as scratch:
        noded = scratch.table(rows.mapInArrow(tidied(_noded), f"vec_id {kind}, node binary, part string, unit binary"), "noded")
        nodes = noded.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("mult"), F.min("vec_id").alias("first"), F.first("part").alias("part"), F.first("unit").alias("unit"))
        nodes = scratch.table(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
        forest = fit(nodes, trees, leaf, spill)
        routed = scratch.table(nodes.select("nid", "part", "unit").mapInArrow(tidied(_routed(forest, spill)), "nid long, leaf long"), "routed")
        routed = refined(scratch, routed, nodes, leaf, spill, tile)
        sizes = routed.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
        lists = routed.groupBy("nid").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
        met = nodes.select("nid", "mult", "part", "unit").join(lists, "nid").withColumn("leaf", F.explode("leaves")).join(sizes, "leaf")
        met = tiled(met, "leaf", "nid", "n", tile).select("leaf", "tile", "nid", "mult", "part", "unit", "leaves", "blocks", "block")
        found = scratch.table(dealt(met, "leaf").mapInArrow(tidied(_compared(threshold)), "nid long, links long, other long"), "links")
        classes = components(scratch, found.select(F.col("nid").alias("a"), F.col("other").alias("b")), "classes")
        links = found.groupBy("nid").agg(F.sum("links").alias("links"))
        own = nodes.select("node", "nid", "mult", "first").join(links, "nid", "left")
        own = classed(scratch, own, classes, "own").select("node", "head", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
        out = noded.select("vec_id", "node").join(own, "node", "left")
        component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("head"))
        return checkpoint(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")))
