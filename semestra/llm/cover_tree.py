"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are scaled to length 1, where a cosine limit c is the distance
tau = sqrt(2 - 2c). The upper levels of one cover tree, with halving radii and
centres that stay centres further down, are chosen from a bounded sample of at
most SAMPLE vectors; every vector is put under its nearest centre of the lowest
of these levels, and the covering radius of each centre is the true maximum
over all its vectors. A cell is cut into blocks of about BLOCK vectors, and a
block holds its own subtree, built on down by halving radii in its task.

The dual traversal starts with pairs of centres and goes on with pairs of
blocks (as Spark joins on cell numbers) and of subtree nodes (in tasks): a pair
of nodes is dropped when their centres are further apart than both covering
radii and tau together, and is linked whole when even the furthest members are
within tau. A pair of blocks returns each vector's number of partners and a
spanning forest of the links it found, never the pairs, so a cell with a third
of all vectors costs its block pairs and no large output.

Defined results: vectors that are null, empty, of length zero, or that hold
null or non-finite components link with nothing, as do vectors of different
dimension; such a vector is its own component and kept. Rows with a null vec_id
take no part: n_links 0, component null, kept. Equal vectors are one class and
link with each other. Rows that repeat a vec_id with another vector share that
id's links. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.llm.components import connected_components
from semestra.session import drop_written, materialize

SAMPLE = 4096
CENTRES = 256  # most centres of the upper levels' last
BLOCK = 4096
STRIP = 512  # rows compared at a time: bounds the matrices of a task
LEAF = 128
SLACK = 1e-7  # by which bounds are widened against rounding


def tau_of(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


@dataclass
class Node:
    """Members (rows of the unit vectors), their centre and covering radius."""

    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list["Node"] = field(default_factory=list)


def net(points: np.ndarray, radius: float, first: list[int], most: int) -> tuple[list[int], np.ndarray]:
    """Centres so that every point is within ``radius`` of one, beginning with
    ``first``, further ones where the points are worst covered; at most
    ``most``. Also each point's nearest centre, as its number."""
    near = distances(points, points[first])
    owner, gap = near.argmin(axis=1), near.min(axis=1)
    centres = list(first)
    while len(centres) < most and gap.max() > radius:
        far = int(gap.argmax())
        d = distances(points, points[far:far + 1])[:, 0]
        closer = d < gap
        owner[closer], gap[closer] = len(centres), d[closer]
        centres.append(far)
    return centres, owner


def subtree(units: np.ndarray, rows: np.ndarray, centre: np.ndarray | None = None) -> Node:
    """Cover tree over ``rows`` of ``units``: children are a net of half the
    node's radius; small nodes, and ones that no net thins out, are leaves."""
    centre = units[rows[0]] if centre is None else centre
    node = Node(rows, centre, float(distances(units[rows], centre[None]).max()))
    if len(rows) > LEAF and node.radius > SLACK:
        points = units[rows]
        most = max(2, len(rows) // 16)
        start = int(distances(points, centre[None])[:, 0].argmin())
        centres, owner = net(points, node.radius / 2, [start], most)
        if len(centres) < most or most <= 4:
            node.children = [subtree(units, rows[owner == k], points[c]) for k, c in enumerate(centres) if (owner == k).any()]
            if len(node.children) < 2:
                node.children = []
    return node


def upper_levels(sample: np.ndarray, most: int) -> list[list[int]]:
    """Centres (rows of the sample) by level, radii 2, 1, 1/2, ...: each level
    keeps the centres above. The last level has at most ``most``."""
    levels, radius = [[0]], 2.0
    while len(levels[-1]) < min(most, len(sample)) and radius > 1e-3:
        radius /= 2
        centres, _ = net(sample, radius, levels[-1], most)
        if len(centres) > len(levels[-1]):
            levels.append(centres)
    return levels


class Links:
    """Counts of partners and a spanning forest while pairs of nodes of two
    blocks are traversed; ``mass`` is how many rows share a vector."""

    def __init__(self, left: np.ndarray, right: np.ndarray, mass: tuple[np.ndarray, np.ndarray], same: bool, cosine: float):
        self.u, self.v, self.mass, self.same = left, right, mass, same
        self.cosine, self.tau = cosine, tau_of(cosine)
        self.count = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        self.edges: list[np.ndarray] = []

    def walk(self, top_a: Node, top_b: Node) -> None:
        stack = [(top_a, top_b)]
        while stack:
            a, b = stack.pop()
            d = float(distances(a.centre[None], b.centre[None])[0, 0])
            if d > a.radius + b.radius + self.tau + SLACK:
                continue
            if self.same and a is b:
                if a.children:
                    stack += [(x, y) for i, x in enumerate(a.children) for y in a.children[i:]]
                else:
                    self._compare(a, b, own=True)
            elif d + a.radius + b.radius <= self.tau - SLACK:
                self._whole(a, b)
            elif not a.children and not b.children:
                self._compare(a, b, own=False)
            elif a.children and (not b.children or a.radius >= b.radius):
                stack += [(x, b) for x in a.children]
            else:
                stack += [(a, y) for y in b.children]

    def _whole(self, a: Node, b: Node) -> None:
        self.count[0][a.rows] += self.mass[1][b.rows].sum()
        self.count[1][b.rows] += self.mass[0][a.rows].sum()
        self.edges.append(np.stack([a.rows, np.repeat(b.rows[:1], len(a.rows))]))
        self.edges.append(np.stack([np.repeat(a.rows[:1], len(b.rows)), b.rows]))

    def _compare(self, a: Node, b: Node, own: bool) -> None:
        for at in range(0, len(a.rows), STRIP):
            rows = a.rows[at:at + STRIP]
            linked = self.u[rows] @ self.v[b.rows].T >= self.cosine
            if own:
                linked[np.arange(len(rows)), at + np.arange(len(rows))] = False
                self.count[0][rows] += linked @ self.mass[0][a.rows]
                linked = np.triu(linked, at)
            else:
                self.count[0][rows] += linked @ self.mass[1][b.rows]
                self.count[1][b.rows] += linked.T @ self.mass[0][rows]
            i, j = np.nonzero(linked)
            if len(i):
                self.edges.append(np.stack([rows[i], b.rows[j]]))

    def forest(self) -> np.ndarray:
        """(left or right row, root) pairs that join what the edges join; right
        rows are numbered on after the left ones unless the blocks are one."""
        if not self.edges:
            return np.zeros((2, 0), np.int64)
        e = np.concatenate(self.edges, axis=1)
        shift = 0 if self.same else len(self.u)
        e[1] += shift
        root = np.arange(shift + len(self.v))
        while True:
            low = np.minimum(root[e[0]], root[e[1]])
            before = root.copy()
            np.minimum.at(root, before[e[0]], low)
            np.minimum.at(root, before[e[1]], low)
            root = root[root]
            if (root == before).all():
                break
        at = np.flatnonzero(root != np.arange(len(root)))
        return np.stack([at, root[at]])


def _units(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _valid(x):
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``."""
    spark = vectors.sparkSession
    written: list[str] = []
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    usable = rows.where(F.col("vec_id").isNotNull() & _valid(F.col("e")))
    classes = materialize(usable.groupBy("e").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("mass"))
                          .withColumn("dim", F.size("e")), "classes", written)
    dims = [r.dim for r in classes.select("dim").distinct().collect()]  # a handful: bounded by the models in use
    counts = links = None
    for dim in dims:
        got = _traverse(classes.where(F.col("dim") == dim), dim, cosine, written)
        counts = got[0] if counts is None else counts.union(got[0])
        links = got[1] if links is None else links.union(got[1])
    found = classes.select("e", "node", F.col("mass").alias("m"))
    if counts is not None:
        labels = connected_components(links)
        found = (found.join(counts.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(labels, "node", "left"))
    else:
        found = found.withColumns({"n": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    found = materialize(found.select("e", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                                     F.coalesce("component", "node").alias("c")), "found")
    drop_written(spark, written)
    out = rows.withColumn("key", F.when(F.col("vec_id").isNotNull() & _valid(F.col("e")), F.col("e"))) \
        .join(found.withColumnRenamed("e", "key"), "key", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _traverse(classes: DataFrame, dim: int, cosine: float, written: list[str]) -> tuple[DataFrame, DataFrame]:
    """Partner counts (node, n) and links (u, v) of classes of one dimension."""
    spark = classes.sparkSession
    drawn = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("e").toArrow().column("e").combine_chunks()
    sample = _units(drawn, dim)
    tops = sample[upper_levels(sample, min(CENTRES, max(1, classes.count() // BLOCK)))[-1]]
    shared = spark.sparkContext.broadcast(tops)  # at most CENTRES vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _units(batch.column(2), dim)
            d = distances(u, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(map(np.ndarray.tobytes, u)), pa.binary()),
                 pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))],
                names=["node", "mass", "unit", "cell", "gap"])

    placed = materialize(classes.select("node", "mass", "e").mapInArrow(
        place, "node long, mass long, unit binary, cell int, gap double"), "placed", written)
    cells = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()}  # CENTRES rows at most
    # Pairs of centres near enough for a link between their cells.
    names = sorted(cells)
    radius = np.array([cells[c][1] for c in names])
    near = distances(tops[names], tops[names]) <= radius[:, None] + radius[None, :] + tau_of(cosine) + SLACK
    np.fill_diagonal(near, True)  # rounding must not part a cell from itself
    pairs = [(names[i], names[j]) for i, j in zip(*np.nonzero(near)) if i <= j]
    sizes = spark.createDataFrame([(c, max(1, -(-n // BLOCK))) for c, (n, _) in cells.items()], "cell int, blocks int")
    cell_pairs = spark.createDataFrame(pairs, "cell_a int, cell_b int")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        u = np.frombuffer(b"".join(frame["unit"]), np.float64).reshape(-1, dim)
        centre = u.mean(axis=0)
        centre = u[distances(u, (centre / max(np.linalg.norm(centre), 1e-9))[None])[:, 0].argmin()]
        return pd.DataFrame([{
            "cell": frame["cell"].iloc[0], "block": frame["block"].iloc[0], "centre": centre.tolist(),
            "radius": float(distances(u, centre[None]).max()), "nodes": frame["node"].to_numpy(np.int64).tobytes(),
            "mass": frame["mass"].to_numpy(np.int64).tobytes(), "units": u.tobytes()}])

    blocks = materialize(
        placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("node", "mass", "unit", "cell", "block").groupBy("cell", "block").applyInPandas(
            pack, "cell int, block int, centre array<double>, radius double, nodes binary, mass binary, units binary"),
        "blocks", written)
    meta = blocks.select("cell", "block", "centre", "radius")
    side = lambda s: meta.select(*(F.col(c).alias(f"{c}_{s}") for c in meta.columns))
    dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0)))
    block_pairs = materialize(
        side("a").join(F.broadcast(cell_pairs), "cell_a").join(side("b"), "cell_b")
        .where((F.col("cell_a") < F.col("cell_b")) | (F.col("block_a") <= F.col("block_b")))
        .where(apart <= F.col("radius_a") + F.col("radius_b") + tau_of(cosine) + SLACK)
        .select("cell_a", "block_a", "cell_b", "block_b"), "block_pairs", written)
    load = blocks.select("cell", "block", "nodes", "mass", "units")
    tasks = block_pairs
    for s in "ab":
        tasks = tasks.join(load.select(*(F.col(c).alias(f"{c}_{s}") for c in load.columns)), [f"cell_{s}", f"block_{s}"])
    tasks = tasks.withColumn("same", (F.col("cell_a") == F.col("cell_b")) & (F.col("block_a") == F.col("block_b")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_py(), t)  # noqa: E731, B023
                same = batch.column("same")[r].as_py()
                nodes = get("nodes_a", np.int64), get("nodes_b", np.int64)
                mass = get("mass_a", np.int64), get("mass_b", np.int64)
                left, right = get("units_a", np.float64).reshape(-1, dim), get("units_b", np.float64).reshape(-1, dim)
                found = Links(left, right, mass, same, cosine)
                top = subtree(left, np.arange(len(left)))
                found.walk(top, top if same else subtree(right, np.arange(len(right))))
                ids = nodes[0] if same else np.concatenate(nodes)
                count = found.count[0] + found.count[1] if same else np.concatenate(found.count)
                at, (child, root) = np.flatnonzero(count), found.forest()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[at], ids[child]])),
                     pa.array(np.concatenate([count[at], np.zeros(len(child), np.int64)])),
                     pa.array(np.concatenate([ids[at], ids[root]]))], names=["node", "n", "other"])

    got = materialize(tasks.select("nodes_a", "mass_a", "units_a", "nodes_b", "mass_b", "units_b", "same").mapInArrow(
        search, "node long, n long, other long"), "found", written)
    return got.select("node", "n"), got.where("node != other").select(F.col("node").alias("u"), F.col("other").alias("v"))
