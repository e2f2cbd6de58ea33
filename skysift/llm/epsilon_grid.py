"""Links between near vectors by an epsilon grid order join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.components import components
from skysift.operators.ordered import with_position
from skysift.session import cut

#: Leading principal dimensions of the grid, vectors of a sequence interval that is joined as one, of a tile, and children of an interval.
DIMENSIONS, INTERVAL, TILE, FAN_OUT = 8, 8192, 256, 8
#: Slack for rounding when a block is proven distant or near without being opened.
SLACK = 1e-7


def units(raw: pa.Array, size: int) -> np.ndarray:
    """Vectors of length one, filled up with zeros; scaled first, so that large or small components don't leave the range of doubles."""
    out = np.zeros((len(raw), size))
    lengths = np.diff(raw.offsets.to_numpy())
    values = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(size) < lengths[:, None]] = values
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-323)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def principal(distinct: DataFrame, size: int) -> np.ndarray:
    """Leading principal directions of the unit vectors, one a column. Each task adds up second moments of its rows, then they are added by row of the matrix."""

    def moments(batches):
        total = np.zeros((size, size + 2))
        for batch in batches:
            x = units(batch.column(0), size)
            total += np.column_stack([x.T @ x, x.sum(axis=0), np.full(size, len(x))])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "x"])

    def added(batches):
        total = {}
        for batch in batches:
            for row, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[row] = total.get(row, 0) + np.array(x)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["row", "x"])

    shape = "row bigint, x array<double>"
    rows = distinct.select("vec").mapInArrow(moments, shape).repartition("row").mapInArrow(added, shape).collect()
    found = np.array([r["x"] for r in sorted(rows)]).reshape(-1, size + 2)
    if not len(found) or not found[0, -1]:
        return np.eye(size)[:, :DIMENSIONS]
    mean = found[:, size] / found[0, -1]
    _, directions = np.linalg.eigh(found[:, :size] / found[0, -1] - np.outer(mean, mean))
    return directions[:, ::-1][:, :DIMENSIONS]


def placed_on_grid(distinct: DataFrame, basis: np.ndarray, reach: float) -> DataFrame:
    """Rows in epsilon grid order: by cells as wide as the reach, then by quarter cells, of the leading dimensions. Adds ``pos`` and ``block``."""
    size = len(basis)

    def cells(batches):
        for batch in batches:
            at = units(batch.column(0), size) @ basis / reach
            arrays = [pa.array(list(np.floor(at * k).astype(np.int32)), pa.list_(pa.int32())) for k in (1, 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "cell", "quarter"])

    kind = dict(distinct.dtypes)["vec"]
    rows = distinct.select("vec", "first", "n").mapInArrow(cells, f"vec {kind}, first bigint, n bigint, cell array<int>, quarter array<int>")
    placed = with_position(rows, "cell", "quarter").drop("cell", "quarter")
    return placed.withColumn("block", F.floor(F.col("pos") / INTERVAL))


def boxes(placed: DataFrame, basis: np.ndarray) -> DataFrame:
    """``block``, ``lo`` and ``hi``: bounds of each interval's leading coordinates."""
    size, k = basis.shape

    def bounds(batches):
        for batch in batches:
            at, block = units(batch.column(1), size) @ basis, batch.column(0).to_numpy()
            names = np.unique(block)
            lo = np.array([at[block == b].min(axis=0) for b in names]).reshape(-1, k)
            hi = np.array([at[block == b].max(axis=0) for b in names]).reshape(-1, k)
            dims = np.tile(np.arange(k), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, k)), pa.array(dims, pa.int64()), pa.array(lo.ravel()), pa.array(hi.ravel())], ["block", "dim", "lo", "hi"])

    found = placed.select("block", "vec").mapInArrow(bounds, "block bigint, dim bigint, lo double, hi double")
    return found.groupBy("block", "dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def near_intervals(found: DataFrame, reach: float) -> DataFrame:
    """Pairs ``a`` <= ``b`` of intervals whose boxes are within reach, by recursion from the whole sequence down: children of near pairs alone are looked at."""
    spark = found.sparkSession
    found = cut(found)
    last = found.agg(F.max("block")).first()[0]
    levels, width = 0, 1
    while width <= (last or 0):
        levels, width = levels + 1, width * FAN_OUT
    pairs = spark.createDataFrame([(0, 0)] if last is not None else [], "a bigint, b bigint")
    for level in range(levels - 1, -1, -1):
        node = F.floor(F.col("block") / FAN_OUT**level)
        bounds = found.groupBy(node.alias("node"), "dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        nodes = cut(bounds.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("box")).withColumn("parent", F.floor(F.col("node") / FAN_OUT)))
        one, two = (nodes.select(F.col("parent").alias(x), F.col("node").alias(f"{x}_node"), F.col("box").alias(f"{x}_box")) for x in "ab")
        gap = F.zip_with("a_box", "b_box", lambda p, q: F.greatest(F.lit(0.0), p["lo"] - q["hi"], q["lo"] - p["hi"]))
        square = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
        near = pairs.join(one, "a").join(two, "b").where("a_node <= b_node").where(square <= (reach + SLACK) ** 2)
        pairs = cut(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    return pairs


class Joined:
    """Links inside one pair of sequence intervals: how many each vector has, and a forest that joins what they join."""

    def __init__(self, x: np.ndarray, lengths: np.ndarray, n: np.ndarray, basis: np.ndarray, threshold: float, reach: float):
        self.x, self.lengths, self.n, self.threshold, self.reach = x, lengths, n, threshold, reach
        self.mixed = len(np.unique(lengths)) > 1
        self.at, self.count, self.parent = x @ basis, np.zeros(len(x), np.int64), np.arange(len(x))
        self.forest: list[tuple[int, int]] = []
        self.bounds: dict = {}

    def box(self, span: tuple[int, int]):
        if span not in self.bounds:
            part = slice(*span)
            centre = self.x[part].mean(axis=0)
            radius = np.sqrt(((self.x[part] - centre) ** 2).sum(axis=1).max())
            self.bounds[span] = self.at[part].min(axis=0), self.at[part].max(axis=0), centre, radius
        return self.bounds[span]

    def join(self, one: tuple[int, int], two: tuple[int, int]) -> None:
        """Recursion on sequence intervals: halves the longer one until both are tiles; distant pairs are left, near ones counted whole."""
        stack = [(one, two)]
        while stack:
            one, two = stack.pop()
            (lo_a, hi_a, mid_a, r_a), (lo_b, hi_b, mid_b, r_b) = self.box(one), self.box(two)
            between = np.sqrt(((mid_a - mid_b) ** 2).sum())
            gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
            if max(np.sqrt(gap @ gap), between - r_a - r_b) > self.reach + SLACK:
                continue
            if not self.mixed and between + r_a + r_b < self.reach - SLACK:
                self.all_near(one, two)
            elif max(one[1] - one[0], two[1] - two[0]) <= TILE:
                self.tile(one, two)
            elif one == two:
                left, right = halves(one)
                stack += [(left, left), (left, right), (right, right)]
            elif one[1] - one[0] >= two[1] - two[0]:
                stack += [(half, two) for half in halves(one)]
            else:
                stack += [(one, half) for half in halves(two)]

    def all_near(self, one, two) -> None:
        a, b = slice(*one), slice(*two)
        self.count[a] += self.n[b].sum()
        if one == two:
            self.count[a] -= self.n[a]
        else:
            self.count[b] += self.n[a].sum()
        for i in {*range(*one), *range(*two)} - {one[0]}:
            self.unite(one[0], i)

    def tile(self, one, two) -> None:
        a, b = slice(*one), slice(*two)
        near = self.x[a] @ self.x[b].T >= self.threshold
        if self.mixed:
            near &= self.lengths[a, None] == self.lengths[None, b]
        if one == two:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.count[a] += near @ self.n[b]
        if one != two:
            self.count[b] += near.T @ self.n[a]
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        # each vector's first link settles most of them; what is still apart is looked for among all
        for i, j in zip(rows.tolist(), near[rows].argmax(axis=1).tolist()):
            self.unite(one[0] + i, two[0] + j)
        for j, i in zip(columns.tolist(), near[:, columns].argmax(axis=0).tolist()):
            self.unite(one[0] + i, two[0] + j)
        left = np.array([self.root(one[0] + i) for i in rows.tolist()])
        right = np.array([self.root(two[0] + j) for j in columns.tolist()])
        apart = near[np.ix_(rows, columns)] & (left[:, None] != right[None, :])
        for i, j in zip(*(x.tolist() for x in np.nonzero(apart))):
            self.unite(int(left[i]), int(right[j]), one[0] + int(rows[i]), two[0] + int(columns[j]))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def unite(self, i: int, j: int, a: int | None = None, b: int | None = None) -> None:
        low, high = sorted((self.root(i), self.root(j)))
        if low != high:
            self.parent[high] = low
            self.forest.append((i if a is None else a, j if b is None else b))


def halves(span: tuple[int, int]):
    middle = (span[0] + span[1]) // 2
    return (span[0], middle), (middle, span[1])


def join_intervals(placed: DataFrame, pairs: DataFrame, basis: np.ndarray, threshold: float, reach: float) -> DataFrame:
    """``kind`` 0: position ``x`` has ``y`` links in a pair of intervals. ``kind`` 1: a link ``x``, ``y`` of its forest."""
    size = len(basis)
    sides = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    meet = placed.select("block", "pos", "n", "vec").join(pairs.select("a", "b", F.explode(sides).alias("block")), "block")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("pos")
        pos, n, block = (table.column(c).to_numpy() for c in ("pos", "n", "block"))
        raw = table.column("vec").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        found = Joined(units(raw, size), np.diff(raw.offsets.to_numpy()), n, basis, threshold, reach)
        middle = int(np.searchsorted(block, block[-1]))
        found.join((0, middle) if middle else (0, len(pos)), (middle, len(pos)))
        linked = np.flatnonzero(found.count)
        forest = np.array(found.forest, np.int64).reshape(-1, 2)
        kind = np.repeat([0, 1], [len(linked), len(forest)])
        return pa.table({"kind": pa.array(kind, pa.int32()), "x": np.concatenate([pos[linked], pos[forest[:, 0]]]), "y": np.concatenate([found.count[linked], pos[forest[:, 1]]])})

    return meet.groupBy("a", "b").applyInArrow(run, "kind int, x bigint, y bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``vec_id``, ``n_links`` (other rows whose vectors have a cosine of at least ``threshold`` with its own) and ``component_id``.

    One row per row of ``vectors``; the component's id is the smallest id reachable over links, its own included. A vector that is null, empty,
    all zero, or holds a null, NaN or infinity links with nothing, and so do vectors of different lengths. Rows that repeat an id are rows of
    their own. A null id is a component's id only where the component has no other. An empty table gives no rows.

    Equal vectors are one node with a count. Nodes are sorted in epsilon grid order and cut into intervals of INTERVAL vectors, whatever cell they
    are in, so no group is unbounded. Pairs of intervals are found by recursion on the boxes of their leading coordinates; each pair is joined in
    one task, again by recursion, down to tiles that are multiplied in double precision. Links are counted, not returned: components need a
    forest of each pair only. How much is skipped depends on the data: where vectors are spread evenly in many dimensions few blocks
    are provably distant, and the work is quadratic.
    """
    reach = float(np.sqrt(2 - 2 * threshold))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    usable = F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0), F.lit(False))
    good = rows.where(usable)
    distinct = cut(good.groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    size = distinct.agg(F.max(F.size("vec"))).first()[0]
    alone = F.lit(0).cast("bigint")
    if size is None:
        return rows.select(F.col("id").alias(id_col), alone.alias("n_links"), F.col("id").alias("component_id"))
    basis = principal(distinct, size)
    placed = placed_on_grid(distinct, basis, reach)
    found = cut(join_intervals(placed, near_intervals(boxes(placed, basis), reach), basis, threshold, reach))
    counts = found.where("kind = 0").groupBy(F.col("x").alias("pos")).agg(F.sum("y").alias("others"))
    roots = components(found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "pos")
    nodes = cut(placed.join(counts, "pos", "left").join(roots, "pos", "left").select("vec", "first", (F.col("n") - 1 + F.coalesce("others", alone)).alias("n_links"), F.coalesce("root", "pos").alias("root")))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(nodes.join(least, "root").select("vec", "n_links", "component_id"))
    linked = good.join(named, "vec").select(F.col("id").alias(id_col), "n_links", "component_id")
    return linked.unionAll(rows.where(~usable).select("id", alone, "id"))
