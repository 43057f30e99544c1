"""Exact near-duplicate vectors by cover trees and dual traversal.

Vectors of a label are normalised and dealt to blocks of bounded size, near ones together. Each block has a cover tree:
nested levels whose radii halve, each node with the distance to its farthest descendant. Pairs of blocks are pruned by
their roots' covering radii, and the others are traversed two trees at a time: a pair of nodes is dropped when its centres
are farther apart than the threshold and both radii, and linked as a whole when even the farthest descendants are near
enough. At unit length, cosine >= c is distance <= sqrt(2 - 2 c).

Which blocks meet is found by their roots alone, in a grid of groups of blocks; then the blocks of each cell of the grid
that has a pair left are brought together, so that a block travels once for a group of others and not for each of them.

A traversal says how many links each vector has and which vectors it connects, not each pair; equal vectors are one with a
weight, known by a digest. So large groups of copies cost what their distinct members cost, and results grow with the vectors.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .components import connected

THRESHOLD = 0.98
#: Numbers in a block: 4096 vectors of 64 dimensions.
BLOCK_NUMBERS = 1 << 18
#: Pivots that sort a label's vectors into cells before these are cut to blocks, and numbers in the pivots of all labels, which
#: are broadcast. With so many large labels that none gets a pivot, cells are cut by hash alone.
MAX_PIVOTS, PIVOT_NUMBERS = 64, 4_000_000
#: Rows up to which totals of labels, blocks' counts, cells of the grid and vectors' results are broadcast.
BROADCAST_ROWS = 200_000
#: Blocks in a group of the grid at most; a label has at least GRID groups before these hold more than one.
GROUP, GRID = 8, 16
#: Distances are held against bounds with this slack (near 0 they are that inexact); closer pairs are decided by their raw vectors.
SLACK = 1e-7


class Tree:
    """A cover tree over unit vectors. Nodes are numbered from the root, 0; order[lo:hi] are a node's points."""

    def __init__(self, points: np.ndarray):
        self.center, self.radius, self.lo, self.hi, self.kids = [], [], [], [], []
        self.order = np.empty(len(points), np.int64)
        self.filled = 0
        if not len(points):
            return
        todo = [(-1, np.arange(len(points)), math.inf)]
        pending: list[tuple[int, np.ndarray, float]] = []
        # depth first, so that each node's points follow one another
        while todo:
            parent, own, level = todo.pop()
            far = distances(points[own], points[own[:1]])[:, 0]
            node, radius = len(self.center), float(far.max())
            self.center.append(int(own[0]))
            self.radius.append(radius)
            self.lo.append(self.filled)
            self.hi.append(self.filled + len(own))
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(node)
            if len(own) == 1 or radius <= SLACK:
                self.order[self.filled : self.filled + len(own)] = own
                self.filled += len(own)
                continue
            level = min(level, 2.0)
            while level >= radius:
                level /= 2
            pending = []
            rest, gap = own, far
            while len(rest):
                inside = gap <= level
                inside[0] = True
                pending.append((node, rest[inside], level))
                rest = rest[~inside]
                if len(rest):
                    gap = distances(points[rest], points[rest[:1]])[:, 0]
            todo.extend(reversed(pending))
        self.center, self.radius = np.array(self.center), np.array(self.radius)
        self.kids = [np.array(k, np.int64) for k in self.kids]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def scaled(raw: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish; directions stay the same to the last bit."""
    exponent = np.frexp(np.abs(raw).max(axis=-1, keepdims=True, initial=0.0))[1]
    return np.ldexp(raw, -exponent)


def unit(raw: np.ndarray) -> np.ndarray:
    raw = scaled(raw)
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Cosine of two raw vectors in double precision."""
    x, y = scaled(x), scaled(y)
    return float(x @ y) / (math.sqrt(float(x @ x)) * math.sqrt(float(y @ y))) >= threshold


class Links:
    """Counts of links by point, and what they connect."""

    def __init__(self, weights: np.ndarray, collect: bool = False):
        self.weights, self.count, self.root = weights, np.zeros(len(weights), np.int64), list(range(len(weights)))
        self.pairs: list[tuple[int, int]] | None = [] if collect else None

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every point of a with every other point of b; a and b are the same or have none in common."""
        same = a is b
        self.count[a] += self.weights[b].sum() - (self.weights[a] if same else 0)
        if not same:
            self.count[b] += self.weights[a].sum()
        if self.pairs is not None:
            self.pairs += [(int(i), int(j)) for k, i in enumerate(a) for j in (b[k + 1 :] if same else b)]
        first = self.find(int(a[0]))
        for i in (*a.tolist(), *(() if same else b.tolist())):
            if (r := self.find(i)) != first:
                self.root[r] = first

    def one(self, i: int, j: int) -> None:
        self.count[i] += self.weights[j]
        self.count[j] += self.weights[i]
        if self.pairs is not None:
            self.pairs.append((i, j))
        if (a := self.find(i)) != (b := self.find(j)):
            self.root[a] = b


def traverse(x: Tree, xs: np.ndarray, xraw: np.ndarray, y: Tree, ys: np.ndarray, yraw: np.ndarray, shift: int, links: Links, threshold: float) -> None:
    """All links between the points of two trees, or within one (x is y). Points of y are numbered from shift in links."""
    tau, same = math.sqrt(2.0 - 2.0 * threshold), x is y
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        whole_a, whole_b = x.order[x.lo[a] : x.hi[a]], y.order[y.lo[b] : y.hi[b]]
        if same and a == b and 2 * x.radius[a] <= tau - SLACK:
            links.all(whole_a, whole_a)
            continue
        split_a, split_b = len(x.kids[a]) > 0, len(y.kids[b]) > 0
        if not split_a and not split_b:  # points that coincide, at most SLACK apart
            for k, i in enumerate(whole_a.tolist()):
                for j in whole_b[k + 1 :].tolist() if same and a == b else whole_b.tolist():
                    if near(xraw[i], yraw[j], threshold):
                        links.one(i, shift + j)
            continue
        if same and a == b:
            left = right = x.kids[a]
        else:  # the wider node first; leaves stay
            left = x.kids[a] if split_a and (not split_b or x.radius[a] >= y.radius[b]) else np.array([a])
            right = y.kids[b] if split_b and (not split_a or y.radius[b] >= x.radius[a]) else np.array([b])
        for i in range(0, len(left), 1024):
            part = left[i : i + 1024]
            gap, reach = distances(xs[x.center[part]], ys[y.center[right]]), x.radius[part][:, None] + y.radius[right][None, :]
            go = gap <= tau + reach + SLACK
            if same and a == b:
                go &= part[:, None] <= right[None, :]  # each pair of nodes once
            for p, q in zip(*np.nonzero(go), strict=True):
                u, v = int(part[p]), int(right[q])
                if not (same and u == v) and gap[p, q] + reach[p, q] <= tau - SLACK:
                    links.all(x.order[x.lo[u] : x.hi[u]], shift + y.order[y.lo[v] : y.hi[v]])
                elif not (same and u == v and len(x.kids[u]) == 0 and x.hi[u] - x.lo[u] == 1):
                    stack.append((u, v))


def exact_pairs(vectors: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """All pairs of rows with cosine >= threshold, in one process: the traversal with its pairs listed."""
    raw = np.asarray(vectors, float)
    tree, points, links = Tree(unit(raw)), unit(raw), Links(np.ones(len(raw), np.int64), collect=True)
    if len(raw):
        traverse(tree, points, raw, tree, points, raw, 0, links, threshold)
    return sorted((min(p), max(p)) for p in links.pairs)


def digested(table: DataFrame) -> DataFrame:
    """(vec_id, label, h1, h2, embedding): a 128-bit digest of the vector, null where it is unusable.

    Unusable: a null label or vec_id, a vector that is null, empty or zero or has null or non-finite numbers.
    """
    v = F.col("embedding")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select("vec_id", "label", F.when(fine, F.xxhash64(v)).alias("h1"), F.when(fine, F.xxhash64(F.lit("second"), v)).alias("h2"), v.alias("embedding"))


def representatives(table: DataFrame) -> DataFrame:
    """(label, h1, h2, rep, n, embedding) for each distinct usable vector of a label: smallest vec_id, and how many rows have it."""
    return digested(table).where("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))


def blocks(reps: DataFrame) -> DataFrame:
    """A row (kind, block, center, radius, data) for each block: its root's centre and radius, and the packed vectors and tree.

    A label's vectors go to the nearest of its pivots, which are chosen by hash; a cell of more than a block's rows is cut by
    hash. kind: label and dimensions.
    """
    spark = reps.sparkSession
    sized = reps.withColumn("kind", F.concat_ws("/", "label", F.size("embedding")))
    per_block = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dims")))
    totals = written(sized.groupBy("kind").agg(F.count("*").alias("total"), F.max(F.size("embedding")).alias("dims")), "totals")
    numbers = totals.where(F.col("total") > per_block).agg(F.sum("dims")).first()[0] or 0
    most = min(MAX_PIVOTS, PIVOT_NUMBERS // max(1, 2 * numbers))
    spread = F.pmod(F.xxhash64("rep"), F.lit(1 << 40))
    joined = sized.join(small(totals, BROADCAST_ROWS), "kind").withColumn("wanted", F.least(F.ceil(2 * F.col("total") / per_block), F.lit(most)))
    # the pivots: about `wanted` of each kind, those with the lowest hashes
    pivots = joined.where((F.col("total") > per_block) & (spread < F.col("wanted") * ((1 << 40) / F.col("total"))))
    listed: dict[str, list] = {}
    for r in pivots.select("kind", "embedding").toLocalIterator():
        if len(own := listed.setdefault(r["kind"], [])) < 2 * most:
            own.append(r["embedding"])
    sent = spark.sparkContext.broadcast({k: unit(np.array(v, float)) for k, v in listed.items()})

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell = np.zeros(len(f), np.int32)
            for kind, at in f.groupby("kind").indices.items():
                if kind in sent.value:
                    for i in range(0, len(at), 4096):
                        cell[at[i : i + 4096]] = np.argmax(unit(np.stack(f["embedding"].iloc[at[i : i + 4096]].to_list()).astype(float)) @ sent.value[kind].T, axis=1)
            yield f.assign(cell=cell)

    in_cells = written(joined.select("rep", "n", "kind", "embedding", "dims").mapInPandas(nearest, "rep long, n long, kind string, embedding array<double>, dims int, cell int"), "cells")
    count = in_cells.groupBy("kind", "cell").agg(F.count("*").alias("rows"), F.max("dims").alias("dims"))
    parts = count.select("kind", "cell", F.ceil(F.col("rows") / per_block).alias("parts"))
    keyed = in_cells.join(small(parts, BROADCAST_ROWS), ["kind", "cell"]).withColumn("block", F.concat_ws("/", "kind", "cell", F.pmod(F.xxhash64("rep", F.lit("part")), "parts")))

    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rep")
        raw = np.stack(f["embedding"].to_list()).astype(float)
        points = unit(raw)
        tree = Tree(points)
        data = pickle.dumps((f["rep"].to_numpy(), f["n"].to_numpy(), raw, tree), protocol=5)
        return pd.DataFrame({"kind": [f["kind"].iloc[0]], "block": [key[0]], "center": [points[tree.center[0]]], "radius": [tree.radius[0]], "data": [data]})

    return keyed.groupBy("block").applyInPandas(build, "kind string, block string, center array<double>, radius double, data binary")


def link_counts(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, links, other): parts of each vector's number of links, and another vector that it is connected with, if any."""
    made = written(blocks(reps), "blocks")
    tau, cell = math.sqrt(2.0 - 2.0 * threshold), ["kind", "p", "q"]
    group = F.least(F.lit(GROUP), F.greatest(F.lit(1), F.floor(F.col("blocks") / GRID)))
    groups = made.groupBy("kind").agg(F.count("*").alias("blocks")).select("kind", F.ceil(F.col("blocks") / group).alias("groups"))
    grid = made.join(small(groups, BROADCAST_ROWS), "kind").withColumn("i", F.pmod(F.xxhash64("block"), "groups"))
    # a group meets itself and every other one: as the first with later ones, as the second with earlier ones
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), lambda j: F.struct(F.least("i", j).alias("p"), F.greatest("i", j).alias("q"), (j < F.col("i")).alias("second")))
    roots = grid.select("kind", "block", "center", "radius", F.explode(meets).alias("m")).select("kind", "m.*", "block", "center", "radius")
    x, y = (roots.select(*cell, *(F.col(c).alias(f"{s}_{c}") for c in ("second", "block", "center", "radius"))) for s in "xy")
    gap = F.sqrt(F.aggregate(F.zip_with("x_center", "y_center", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, d: acc + d))
    paired = F.when(F.col("p") == F.col("q"), F.col("x_block") <= F.col("y_block")).otherwise(~F.col("x_second") & F.col("y_second"))
    needed = written(x.join(y, cell).where(paired & (gap <= tau + F.col("x_radius") + F.col("y_radius") + SLACK)).select(*cell).distinct(), "grid")
    dealt = grid.select("kind", "block", "data", F.explode(meets).alias("m")).select("kind", "m.*", "block", "data").join(small(needed, BROADCAST_ROWS), cell, "left_semi")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            for k in range(batch.num_rows):
                here = tuple(batch.column(c)[k].as_py() for c in range(3))
                if held and here != now:
                    yield from _linked(held, now[1] == now[2], threshold)
                    held = []
                now = here
                held.append((batch.column(3)[k].as_py(), pickle.loads(batch.column(5)[k].as_py())))
        if held:
            yield from _linked(held, now[1] == now[2], threshold)

    # a row is a block, some megabytes; a cell's blocks follow each other
    return dealt.select(*cell, "second", "block", "data").repartition(*cell).sortWithinPartitions(*cell, "block").mapInArrow(links, "rep long, links long, other long")


def _linked(held: list[tuple], own: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between the blocks of a cell: all of one group (own), or those of its first with those of its second group."""
    tau = math.sqrt(2.0 - 2.0 * threshold)
    points = [unit(block[2]) for _, block in held]
    for a, (second, (ids, weights, raw, tree)) in enumerate(held):
        for b in range(a, len(held)) if own else [] if second else [b for b, (later, _) in enumerate(held) if later]:
            ids2, weights2, raw2, tree2 = held[b][1]
            gap = distances(points[a][tree.center[:1]], points[b][tree2.center[:1]])[0, 0]
            if gap > tau + tree.radius[0] + tree2.radius[0] + SLACK:
                continue
            if a == b:
                found, every = Links(weights), ids
                traverse(tree, points[a], raw, tree, points[a], raw, 0, found, threshold)
            else:
                found, every = Links(np.concatenate([weights, weights2])), np.concatenate([ids, ids2])
                traverse(tree, points[a], raw, tree2, points[b], raw2, len(ids), found, threshold)
            at = np.flatnonzero(found.count)
            other = every[[found.find(int(i)) for i in at]] if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every[at], pa.int64()), pa.array(found.count[at], pa.int64()), pa.array(other, pa.int64())], names=["rep", "links", "other"])


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept. Only vec_id, label and embedding are read.

    Rows with an unusable vector have no links and are their own component (null for a null vec_id, which isn't kept).
    Rows that repeat a vec_id are vectors of their own. Vectors of any length are compared, those of different lengths never.
    Ties don't matter: a component's id is its smallest. A table without rows gives none.
    """
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label"))
    reps = written(representatives(table), "vectors")
    found = written(link_counts(reps, threshold), "links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = written(connected(found.select("rep", "other"), "rep", "other"), "components")
    known = reps.select("label", "h1", "h2", "rep", "n").join(totals, "rep", "left").join(component, F.col("rep") == F.col("id"), "left")
    known = written(known.select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "known")
    out = digested(table).drop("embedding").join(small(known, BROADCAST_ROWS), ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
