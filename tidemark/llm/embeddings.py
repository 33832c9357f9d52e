"""Near-duplicate embeddings by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.plans.lineage import cut

#: Dimensions of a block, and the grid of unit vectors (whole numbers, so that rotations and sums of squares are exact).
WIDTH, GRID = 16, 1 << 16
#: Numbers in the vectors that a tile takes from either side; rows and columns compared at a time.
SIDE, ROWS, COLUMNS = 1 << 21, 256, 4096
#: Rows of the sample that the splits are fitted on, and levels of splits of a block at most.
SAMPLE, LEVELS = 8192, 6


def padded(dim: int) -> int:
    """The next power of two from WIDTH on."""
    return max(WIDTH, 1 << (dim - 1).bit_length())


def turned(unit: np.ndarray) -> np.ndarray:
    """Rows rounded to the grid and rotated by random signs and a Hadamard transform, in whole numbers.

    Lengths grow by the root of padded(dim). Nothing is rounded after the
    grid, so every task gets the same numbers.
    """
    n, dim = unit.shape
    size = padded(dim)
    x = np.zeros((n, size))
    x[:, :dim] = np.rint(unit * GRID)
    x *= np.random.default_rng(size).choice([-1.0, 1.0], size)
    h = 1
    while h < size:
        x = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, size)


def budget(dim: int, least: float) -> float:
    """A block's share of the squared distance that rotated unit vectors of cosine `least` have at most.

    All blocks have WIDTH dimensions and equal shares that add up to it, so
    vectors at most that far apart are within the share in at least one
    block. The slack covers rounding to the grid.
    """
    return WIDTH * (math.sqrt(2 * (1 - least) + 1e-9) * GRID + math.sqrt(dim)) ** 2 + 1


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of the rows, and which rows have one."""
    x = np.ascontiguousarray(x, np.float64)
    top = np.abs(x).max(1, initial=0)
    ok = np.isfinite(top) & (top > 0)
    x = np.where(ok[:, None], x, 0) / np.where(ok, top, 1)[:, None]
    return x / np.where(ok, np.sqrt((x * x).sum(1)), 1)[:, None], ok


def split(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and value of each inner node of a complete tree: each at the median of its widest coordinate."""
    nodes = [sample]
    at, value = [], []
    for i in range((1 << levels) - 1):
        own = nodes[i]
        k = int(own.var(0).argmax()) if len(own) else 0
        v = float(np.median(own[:, k])) if len(own) else 0.0
        at.append(k)
        value.append(v)
        nodes += [own[own[:, k] <= v], own[own[:, k] > v]]
    return np.array(at, np.int64), np.array(value)


def leaves(tree: tuple[np.ndarray, np.ndarray] | None, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node = np.zeros(len(x), np.int64)
    if tree is not None:
        rows = np.arange(len(x))
        for _ in range((len(tree[0]) + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, tree[0][node]] > tree[1][node])
        node -= len(tree[0])
    return node


class Tile:
    """The rows of two chunks of a block: finds their links, counts them and merges linked rows, without listing pairs."""

    def __init__(self, unit: np.ndarray, weight: np.ndarray, block: int, least: float) -> None:
        self.unit, self.weight, self.block, self.least = unit, weight, block, least
        grid = turned(unit)
        self.part = [np.ascontiguousarray(grid[:, b * WIDTH : (b + 1) * WIDTH]) for b in range(block + 1)]
        self.square = [(p * p).sum(1) for p in self.part]
        self.limit = budget(unit.shape[1], least)
        # one product of these rows is a squared distance less the limit, in single precision, which the slack covers
        own, sq = self.part[block], self.square[block]
        limit = self.limit * 1.0001 + 1e-5 * sq.max(initial=0)
        one = np.ones((len(own), 1))
        self.left = np.hstack([own, sq[:, None] - limit, one]).astype(np.float32)
        self.right = np.hstack([-2 * own, one, sq[:, None]]).astype(np.float32)
        self.parent = np.arange(len(own))
        self.count = np.zeros(len(own), np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.parent[x]
            if (y == x).all():
                return x
            x = y

    def within(self, b: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which pairs are within the limit in a block; whole numbers below 2**53, so exact in any order."""
        return self.square[b][r][:, None] + self.square[b][c][None, :] - 2 * (self.part[b][r] @ self.part[b][c].T) <= self.limit

    def verify(self, r: np.ndarray, c: np.ndarray, near: np.ndarray) -> None:
        """Links among the candidates `near` of rows r and columns c that no earlier block finds."""
        for b in [*range(self.block), self.block]:
            near &= self.within(b, r, c) == (b == self.block)
            if not near.any():
                return
            i, j = near.any(1), near.any(0)
            r, c, near = r[i], c[j], near[np.ix_(i, j)]
        near &= self.unit[r] @ self.unit[c].T >= self.least
        self.count[r] += near @ self.weight[c]
        self.count[c] += self.weight[r] @ near
        last = len(self.parent)
        while True:
            a, b = self.roots(r), self.roots(c)
            to = np.minimum(a, np.where(near, b, last).min(1))
            back = np.minimum(b, np.where(near, to[:, None], last).min(0))
            if (to == a).all() and (back == b).all():
                return
            np.minimum.at(self.parent, a, to)
            np.minimum.at(self.parent, b, back)

    def join(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """All pairs of rows and cols; of the pairs of rows with themselves each once."""
        same = rows is cols
        for lo in range(0, len(rows), ROWS):
            r = rows[lo : lo + ROWS]
            for at in range(lo if same else 0, len(cols), COLUMNS):
                c = cols[at : at + COLUMNS]
                near = self.left[r] @ self.right[c].T <= 0
                if same and at < lo + ROWS:
                    near &= c[None, :] > r[:, None]
                i = near.any(1)
                if i.any():
                    j = near.any(0)
                    self.verify(r[i], c[j], near[np.ix_(i, j)])


def near_embeddings(df: DataFrame, vector: str = "embedding", id: str = "vec_id", least: float = 0.9) -> DataFrame:
    """One row for each row of df: id, n_links, component_id, kept.

    Rows link when the cosine of their vectors, in double precision, is at
    least `least`. n_links counts the other rows linked directly; component_id
    is the smallest id reachable by links; kept says that it is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and only vectors of one length with each other. A
    null id takes part with its links but names no component unless all of
    it is null. Repeated rows and ids are rows of their own. Extra columns are
    ignored; an empty table gives no rows.

    Equal vectors are one from the start, with their number. Unit vectors are
    rotated and split into blocks of WIDTH dimensions; near vectors are within
    their proportional budget in at least one block. A block's range join
    parts the vectors on several of its coordinates: splits are fitted on
    SAMPLE rows, every row gets a leaf, and leaves of more than SIDE numbers
    are dealt into chunks. A vector meets the chunks of those leaves whose
    bounding box is within the budget, tile by tile; leaves, boxes and the
    sample are at most 2**LEVELS, as many and SAMPLE for each length of
    vectors, whatever their number. In a tile, pairs within the block's
    budget are verified with the whole vectors, and a pair counts in the
    first block that finds it. A tile returns a count and one member of its
    group for each linked row, never the pairs; its memory is bounded.
    """
    kind = df.schema[id].dataType.simpleString()
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    form, bytes_ = ("<f4", 4) if single else ("<f8", 8)
    source = df.select(F.col(id).alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))

    def by_size(raws: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of vectors: the places of its rows and their unit vectors."""
        size = np.array([len(r) for r in raws]) // bytes_
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            yield d, at, units(np.frombuffer(b"".join(raws[i] for i in at), form).reshape(len(at), d))[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.asarray(lists.value_lengths().fill_null(0))
            values = lists.flatten()
            whole = np.asarray(values.fill_null(float("nan")), form)
            first = np.cumsum(size) - size
            raw, unit = [None] * len(lists), [None] * len(lists)
            for d in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == d)
                own = whole[first[at][:, None] + np.arange(d)]
                u, ok = units(own)
                for i in np.flatnonzero(ok).tolist():
                    raw[at[i]], unit[at[i]] = own[i].tobytes(), u[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(unit, pa.binary())], ["id", "raw", "unit"])

    # equal numbers give equal bytes, so these hashes name the same unit vectors
    named = cut(source.mapInArrow(read, f"id {kind}, raw binary, unit binary").select("id", "raw", F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(1), F.col("unit")).alias("h2")))
    ok = named.filter(F.col("raw").isNotNull())
    groups = cut(ok.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw")).withColumn("node", F.monotonically_increasing_id()))

    # leaves of each block, and their boxes and chunks; one leaf where a chunk holds all
    counts = {r.size // bytes_: r.n for r in groups.groupBy(F.octet_length("raw").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    chunk = {d: max(ROWS, SIDE // d) for d in counts}
    trees: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    if any(n > chunk[d] for d, n in counts.items()):
        sample = groups.select("raw", "h1", "h2").orderBy("h1", "h2").limit(SAMPLE).collect()
        for d, _, u in by_size([bytes(r.raw) for r in sample]):
            levels = min(LEVELS, max(0, math.ceil(math.log2(counts[d] / chunk[d]))))
            if levels:
                trees |= {(d, b): split(x, levels) for b, x in enumerate(np.split(turned(u), padded(d) // WIDTH, axis=1))}

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, _, u in by_size(batch.column(0).to_pylist()):
                for b, x in enumerate(np.split(turned(u), padded(d) // WIDTH, axis=1)):
                    leaf = leaves(trees.get((d, b)), x)
                    for k in np.unique(leaf).tolist():
                        own = x[leaf == k]
                        out.append((d, b, k, len(own), own.min(0), own.max(0)))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.float64())] * 2
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["dim", "block", "leaf", "n", "lo", "hi"])

    boxes: dict[tuple[int, int], list] = {}
    if trees:
        ends = [f(F.get(c, F.lit(k))).alias(f"{c}{k}") for c, f in (("lo", F.min), ("hi", F.max)) for k in range(WIDTH)]
        found = groups.select("raw").mapInArrow(edges, "dim long, block long, leaf long, n long, lo array<double>, hi array<double>")
        for r in found.groupBy("dim", "block", "leaf").agg(F.sum("n").alias("n"), *ends).orderBy("dim", "block", "leaf").collect():
            boxes.setdefault((r.dim, r.block), []).append((r.leaf, r.n, r[4 : 4 + WIDTH], r[4 + WIDTH :]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for d, at, u in by_size(batch.column(2).to_pylist()):
                for b, x in enumerate(np.split(turned(u), padded(d) // WIDTH, axis=1)):
                    own = boxes.get((d, b)) or [(0, counts[d], [-np.inf] * WIDTH, [np.inf] * WIDTH)]
                    ids = np.array([k for k, *_ in own])
                    many = np.array([-(-n // chunk[d]) for _, n, *_ in own])
                    first = np.cumsum(many) - many
                    mine = np.searchsorted(ids, leaves(trees.get((d, b)), x))
                    near = np.column_stack([(np.maximum(0, np.maximum(lo - x, x - hi)) ** 2).sum(1) <= budget(d, least) for _, _, lo, hi in own])
                    near[np.arange(len(x)), mine] = True
                    home = first[mine] + node[at] % many[mine]
                    row, other = np.nonzero(near[:, np.repeat(np.arange(len(own)), many)])
                    for lo in range(0, len(row), 4096):
                        r, o = row[lo : lo + 4096], other[lo : lo + 4096]
                        m, i = home[r], pa.array(at[r])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(r), d)), pa.array(np.full(len(r), b)), pa.array(np.minimum(m, o)), pa.array(np.maximum(m, o)), pa.array(m > o)] + [batch.column(c).take(i) for c in range(3)],
                            ["dim", "block", "i", "j", "right", "node", "n", "raw"],
                        )

    tiles = groups.select("node", "n", "raw").mapInArrow(place, "dim long, block long, i long, j long, right boolean, node long, n long, raw binary")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        dim, block, i, j = (k.as_py() for k in key)
        right, node = table.column("right").to_numpy(), table.column("node").to_numpy()
        order = np.lexsort((node, right))
        node = node[order]
        x = np.frombuffer(b"".join(table.column("raw").to_pylist()), form).reshape(-1, dim)[order]
        tile = Tile(units(x)[0], table.column("n").to_numpy()[order], block, least)
        rows = np.arange(len(node) - int(right.sum()))
        tile.join(rows, rows if i == j else np.arange(len(rows), len(node)))
        linked = np.flatnonzero(tile.count)
        return pa.table({"node": node[linked], "links": tile.count[linked], "root": node[tile.roots(linked)]})

    found = cut(tiles.groupBy("dim", "block", "i", "j").applyInArrow(join, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("label", "top")
    met = groups.select("h1", "h2", "rep", "n", "node").join(links, "node", "left").join(label, "node", "left").withColumn("top", F.coalesce("top", "node"))
    smallest = met.groupBy("top").agg(F.min("rep").alias("component"))
    known = met.join(smallest, "top").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    out = named.select("id", "h1", "h2", F.col("raw").isNotNull().alias("ok")).join(known.withColumn("ok", F.lit(True)), ["h1", "h2", "ok"], "left")
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
