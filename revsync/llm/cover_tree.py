"""Exact pairs of similar vectors by dual traversal of cover trees.

Vectors are scaled to length one, so a cosine is a distance, and a threshold on one is a
threshold tau on the other. Points stand in nested levels: a level's nodes cover the next
one's within a radius, which halves from level to level. Two nodes are traversed together,
from the top; if the distance of their points is more than both covering radii and tau
together, no pair below them is close enough, and the pair is dropped.

The upper levels are a table: pivots, and below each its points in blocks of bounded size.
Pairs of nodes go down by joins on their parents and are pruned by their bounds. The lower
levels are a tree within each block; a task traverses two blocks' trees against each other,
a level of both at a time. A pair that is left at the end is decided in double precision.

A task gives each vector's number of links and a spanning forest of them, not all pairs, so
a group of near copies is as many rows as it has members, whatever the links between them.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from revsync.llm.common import components, stage

#: Points of a block, about, and the most pivots.
BLOCK, PIVOTS = 4_096, 64
#: The covering radii of the levels within a block; below the last one stand single points.
RADII = [0.5, 0.25, 0.125, 0.0625]
#: What rounding may add to a distance in single precision.
SLACK = 1e-3
#: Nodes of one tree that are compared with another's at once, and pairs at once.
STRIP, PAIRS = 512, 1 << 17


def unit(rows) -> np.ndarray:
    """Vectors of length one in double precision, whatever their size before."""
    a = np.asarray(rows, np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _distance(cos):
    return np.sqrt(np.maximum(2 - 2 * cos, 0))


def _net(single: np.ndarray, rows: np.ndarray, radius: float):
    """Centres that cover `rows` within `radius`, the first row that none covers next: each
    one's rows, itself first, that no earlier one has, and how far they are at most."""
    x, least = single[rows], 1 - radius * radius / 2
    alive = np.ones(len(rows), bool)
    for at in range(0, len(rows), STRIP):
        ahead = at + np.flatnonzero(alive[at : at + STRIP])
        cos = x[ahead] @ x.T
        for k, i in enumerate(ahead):
            if alive[i]:
                near = alive & (cos[k] >= least)
                near[i] = True
                alive[near] = False
                own = rows[near]
                yield own, float(_distance(cos[k][near].min())) + SLACK if len(own) > 1 else 0.0


class Tree:
    """A cover tree over points, by levels: `points` of the nodes, `parent` of each among the
    level before, in order, and `reach`, how far its points are at most. The last level has
    every point, with a reach of 0."""

    def __init__(self, x: np.ndarray):
        single = x.astype(np.float32)
        self.points: list[np.ndarray] = []
        self.parent: list[np.ndarray] = []
        self.reach: list[np.ndarray] = []
        members = [np.arange(len(x))]
        for radius in RADII:
            points, parent, reach, below = [], [], [], []
            for up, rows in enumerate(members):
                if len(rows) == 1:
                    points.append(rows[0])
                    parent.append(up)
                    reach.append(0.0)
                    below.append(rows)
                    continue
                for own, far in _net(single, rows, radius):
                    points.append(own[0])
                    parent.append(up)
                    reach.append(far)
                    below.append(own)
            self._add(points, parent, reach)
            members = below
        sizes = [len(m) for m in members]
        self._add(np.concatenate(members), np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(x)))

    def _add(self, points, parent, reach) -> None:
        self.points.append(np.asarray(points, np.int64))
        self.parent.append(np.asarray(parent, np.int64))
        self.reach.append(np.asarray(reach, np.float64))

    def levels(self):
        return list(zip(self.points, self.parent, self.reach))


def traverse(x: np.ndarray, a, y: np.ndarray, b, cosine: float, same: bool):
    """Places (i, j) in x and y of all pairs whose cosine is reached; `a` and `b` are the
    levels of their trees. If they are the `same`, every pair comes once."""
    tau = float(np.sqrt(2 - 2 * cosine)) + SLACK
    xs, ys = x.astype(np.float32), y.astype(np.float32)
    (p, _, r), (q, _, t) = a[0], b[0]
    far, found = t.max(), []
    for at in range(0, len(p), STRIP):  # the top level of one against that of the other
        rows = np.arange(at, min(at + STRIP, len(p)))
        cos = xs[p[rows]] @ ys[q].T
        least = 1 - np.minimum(r[rows] + far + tau, 2) ** 2 / 2
        i, j = np.nonzero(cos >= least[:, None].astype(np.float32) - 1e-6)
        keep = _distance(cos[i, j]) <= r[rows][i] + t[j] + tau
        found.append((rows[i[keep]], j[keep]))
    i, j = (np.concatenate(c) for c in zip(*found))
    if same:
        i, j = i[i <= j], j[i <= j]
    for (p, up_a, r), (q, up_b, t) in zip(a[1:], b[1:]):
        parts = []
        for at in range(0, len(i), PAIRS):
            for c, d in _children(i[at : at + PAIRS], j[at : at + PAIRS], up_a, up_b, same):
                near = _distance(np.einsum("ij,ij->i", xs[p[c]], ys[q[d]])) <= r[c] + t[d] + tau
                parts.append((c[near], d[near]))
        i, j = (np.concatenate(c) for c in zip(*parts)) if parts else (i[:0], j[:0])
    p, q = a[-1][0], b[-1][0]
    for at in range(0, len(i), PAIRS):
        c, d = p[i[at : at + PAIRS]], q[j[at : at + PAIRS]]
        hit = np.einsum("ij,ij->i", x[c], y[d]) >= cosine
        if same:
            hit &= c != d
        yield c[hit], d[hit]


def _children(i, j, up_a, up_b, same):
    """Pairs of children of pairs of nodes, some at a time."""
    first_a, first_b = (np.searchsorted(u, np.arange(u[-1] + 2)) for u in (up_a, up_b))
    na, nb = first_a[i + 1] - first_a[i], first_b[j + 1] - first_b[j]
    ends = np.cumsum(na * nb)
    for start in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        k = np.arange(start, min(start + PAIRS, ends[-1]))
        at = np.searchsorted(ends, k, side="right")
        k -= ends[at] - na[at] * nb[at]
        c, d = first_a[i[at]] + k // nb[at], first_b[j[at]] + k % nb[at]
        keep = c <= d if same else slice(None)
        yield c[keep], d[keep]


class Forest:
    """Links between numbered points: how many each has by weight, and a spanning forest."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.n = weights, np.zeros(len(weights), np.int64)
        self.up = list(range(len(weights)))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.n, i, self.weights[j])
        np.add.at(self.n, j, self.weights[i])
        for x, y in zip(i.tolist(), j.tolist()):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.edges.append((x, y))


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no component null or not finite, not all zero."""
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _placed(classes: DataFrame, block: int) -> DataFrame:
    """`classes` with the nearest pivot's number as `cell`; the pivots are vectors of the data,
    those of the smallest hash. A vector of another length than the first pivot's has a cell
    of its length, without a pivot."""
    n = classes.count()
    chosen = classes.orderBy(F.xxhash64("key"), "key").limit(min(PIVOTS, -(-n // block))).collect()
    size = len(chosen[0].v) if chosen else 0
    pivots = unit([r.v for r in chosen if len(r.v) == size]) if chosen else np.zeros((0, 0))

    def assign(frames):
        for pdf in frames:
            cell = np.array([-len(v) for v in pdf["v"]], np.int64)
            mine = np.flatnonzero(cell == -size)
            if len(mine):
                cell[mine] = (unit(np.stack(pdf["v"].to_numpy()[mine])) @ pivots.T).argmax(axis=1)
            yield pdf.assign(cell=cell)

    schema = T.StructType([*classes.schema.fields, T.StructField("cell", T.LongType())])
    return stage(classes.mapInPandas(assign, schema), "cover-cells")


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """A row per block of a cell: its tree, and its centre and reach for pruning pairs."""
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    numbered = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("key"), "parts"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(pdf["v"].to_numpy())
        x = unit(rows)
        centre = x.mean(axis=0)
        centre = centre / (np.linalg.norm(centre) or 1.0)
        held = rows.astype(np.float32) if (rows.astype(np.float32) == rows).all() else rows
        tree = (pdf["key"].to_numpy(), pdf["copies"].to_numpy(), held, Tree(x).levels())
        # The centre may be no unit vector, so distances to it are taken as they are.
        reach = float(np.linalg.norm(x - centre, axis=1).max())
        return pd.DataFrame({
            "cell": pdf["cell"].iloc[:1], "part": pdf["part"].iloc[:1],
            "centre": [centre], "reach": [reach + SLACK], "tree": [pickle.dumps(tree, 5)],
        })

    schema = "cell long, part long, centre array<double>, reach double, tree binary"
    return stage(numbered.groupBy("cell", "part").applyInPandas(build, schema), "cover-blocks")


def _node_pairs(blocks: DataFrame, tau: float) -> DataFrame:
    """Pairs of blocks that may hold a close pair: from the root to cells, then to blocks."""
    cells = blocks.groupBy("cell").agg(F.count("*").alias("parts"), F.first(F.size("centre")).alias("size"))
    # All cells are below one root: at most PIVOTS of them, and one for each other length.
    root = cells.withColumn("root", F.lit(0))
    down = root.select("root", "size", F.col("cell").alias("cell_a")).join(
        root.select("root", "size", F.col("cell").alias("cell_b")), ["root", "size"]
    )
    node = lambda s: blocks.select(
        F.col("cell").alias(f"cell_{s}"), F.col("part").alias(f"part_{s}"),
        F.col("centre").alias(f"centre_{s}"), F.col("reach").alias(f"reach_{s}"),
    )
    pairs = down.where("cell_a <= cell_b").join(node("a"), "cell_a").join(node("b"), "cell_b")
    apart = F.sqrt(
        F.aggregate(
            F.zip_with("centre_a", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
        )
    )
    near = apart <= F.col("reach_a") + F.col("reach_b") + tau
    once = (F.col("cell_a") < F.col("cell_b")) | (F.col("part_a") <= F.col("part_b"))
    return stage(pairs.where(near & once).select("cell_a", "part_a", "cell_b", "part_b"), "cover-pairs")


def links(classes: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """(key, n, other): for every key with links how many vectors, from each pair of blocks;
    and rows with a null n that are a spanning forest of its links.

    `classes` has a row per distinct vector: key, v, copies.
    """
    blocks = _blocks(_placed(classes, block), block)
    pairs = _node_pairs(blocks, float(np.sqrt(2 - 2 * cosine)) + SLACK)
    tree = lambda s: blocks.select(
        F.col("cell").alias(f"cell_{s}"), F.col("part").alias(f"part_{s}"), F.col("tree").alias(f"tree_{s}")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        same = (row.cell_a, row.part_a) == (row.cell_b, row.part_b)
        key_a, copies_a, rows_a, a = pickle.loads(row.tree_a)
        x = unit(rows_a)
        if same:
            key_b, copies_b, y, b, shift = key_a[:0], copies_a[:0], x, a, 0
        else:
            key_b, copies_b, rows_b, b = pickle.loads(row.tree_b)
            y, shift = unit(rows_b), len(x)
        keys, forest = np.append(key_a, key_b), Forest(np.append(copies_a, copies_b))
        for i, j in traverse(x, a, y, b, cosine, same):
            forest.link(i, j + shift)
        some = np.flatnonzero(forest.n)
        one, other = (np.array([keys[e[k]] for e in forest.edges], np.int64) for k in (0, 1))
        return pd.DataFrame({
            "key": np.append(keys[some], one),
            "n": pd.array(forest.n[some].tolist() + [None] * len(one), "Int64"),
            "other": pd.array([None] * len(some) + other.tolist(), "Int64"),
        })

    where = ["cell_a", "part_a", "cell_b", "part_b"]
    both = pairs.join(tree("a"), where[:2]).join(tree("b"), where[2:])
    return stage(both.groupBy(where).applyInPandas(compare, "key long, n long, other long"), "cover-links")


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    cosine: float = 0.9,
    block: int = BLOCK,
) -> DataFrame:
    """Per row of `vectors`: its id, n_links, component_id, kept.

    Vectors of equal length whose cosine, in double precision, is `cosine` or more link.
    One that is null, empty, all zero, or holds a null or non-finite component links with
    nothing: 0 links, its own id, kept. Rows with equal vectors link with each other, so
    repeated rows do; a null id is passed over in looking for a component's smallest.
    """
    v = F.when(usable(F.col(vector)), F.col(vector))
    rows = vectors.select(F.col(vec_id).alias("id"), v.alias("v"))
    rows = stage(rows.withColumn("key", F.when(F.col("v").isNotNull(), F.xxhash64("v"))), "cover-rows")
    classes = stage(
        rows.where("v is not null").groupBy("key")
        .agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("smallest")),
        "cover-classes",
    )
    found = links(classes.select("key", "v", "copies"), cosine, block)
    groups = components(found.where("other is not null"), "key", "other")
    counts = found.where("n is not null").groupBy("key").agg(F.sum("n").alias("n"))
    known = (
        classes.select("key", "copies", "smallest")
        .join(groups, F.col("key") == F.col("node"), "left").join(counts, "key", "left")
        .select(
            "key", "smallest", F.coalesce("component", "key").alias("component"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    known = stage(known, "cover-known")
    ids = known.groupBy("component").agg(F.min("smallest").alias("component_id"))
    known = stage(known.join(ids, "component").select("key", "n_links", "component_id"), "cover-ids")
    own = rows.select("id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return own.select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
