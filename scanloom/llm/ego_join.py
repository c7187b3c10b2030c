"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors whose cosine is at least c lie within eps = sqrt(2 - 2 c). They are
projected on the leading principal axes of all vectors; a projection brings no two
points further apart. In the epsilon grid order, by label and then by the cells of
width eps on those axes, the vectors form one sequence, which range partitioning
cuts into blocks. Blocks meet only if they hold neighbouring cells and their boxes
on the axes are within eps; a pair of blocks is joined recursively, halving the
sequence intervals and skipping halves that are provably distant. What is left is
compared by cosine in double precision.

A pair of blocks hands on a count of links for each vector and a spanning forest,
never the pairs. Equal vectors of a label are one node with a number of copies.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import settle
from scanloom.llm.components import components

#: Axes of the grid, axes of the boxes, vectors of a block and of the smallest interval.
GRID_AXES, BOX_AXES = 3, 12
BLOCK, LEAF = 256, 64
#: Added to distances that decide what is skipped, for rounding.
SLACK = 1e-9


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link: label, vector and all components are there, finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.split(values, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def principal_axes(nodes: DataFrame, count: int = BOX_AXES) -> dict[int, np.ndarray]:
    """By number of components: leading principal axes of the unit vectors, as columns.

    Each task sums the products of its vectors' components; the sums of the tasks are
    added by Spark. The driver gets one number for each two components.
    """
    schema = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def run(source):
        sums: dict[int, np.ndarray] = {}
        for batch in source:
            by_dim: dict[int, list[np.ndarray]] = {}
            for v in _vectors(batch.column("vector")):
                by_dim.setdefault(len(v), []).append(v)
            for dim, rows in by_dim.items():
                u = np.hstack([unit(np.array(rows)), np.ones((len(rows), 1))])  # the last row holds sums and the number
                sums[dim] = sums.get(dim, 0) + u.T @ u
        for dim, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * (dim + 1), pa.int32()), pa.array(range(dim + 1), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], schema=schema)

    parts = nodes.select("vector").mapInArrow(run, "dim int, i int, row array<double>").select("dim", "i", F.posexplode("row").alias("j", "x"))
    got: dict[int, np.ndarray] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).toLocalIterator():
        got.setdefault(r["dim"], np.zeros((r["dim"] + 1, r["dim"] + 1)))[r["i"], r["j"]] = r["x"]
    axes = {}
    for dim, m in got.items():
        mean = m[-1, :-1] / m[-1, -1]
        cov = m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean)
        axes[dim] = np.linalg.eigh(cov)[1][:, ::-1][:, :count]
    return axes


def joined_intervals(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, eps: float, min_cosine: float, leaf: int = LEAF) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (unit vectors) have the cosine; pa_, pb: their projections, in grid order."""
    hits = np.zeros((len(a), len(b)), bool)
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        x, y = pa_[a0:a1], pb[b0:b1]
        gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
        if (gap * gap).sum() > (eps + SLACK) ** 2:
            continue
        if max(a1 - a0, b1 - b0) <= leaf:
            hits[a0:a1, b0:b1] = a[a0:a1] @ b[b0:b1].T >= min_cosine
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            stack += [(a0, mid, b0, b1), (mid, a1, b0, b1)]
        else:
            mid = (b0 + b1) // 2
            stack += [(a0, a1, b0, mid), (a0, a1, mid, b1)]
    return hits


def forest(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(node, root): each node of the links in a mask with the smallest node it reaches in the mask."""
    rows, cols = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
    mask = hits[np.ix_(rows, cols)]
    roots = {int(n): int(n) for n in np.concatenate((left[rows], right[cols]))}
    top = np.iinfo(np.int64).max
    x, y = left[rows].copy(), right[cols].copy()
    while True:
        y2 = np.minimum(y, np.where(mask, x[:, None], top).min(axis=0))
        x2 = np.minimum(x, np.where(mask, y2[None, :], top).min(axis=1))
        for node, root in zip(np.concatenate((left[rows], right[cols])).tolist(), np.concatenate((x2, y2)).tolist(), strict=True):
            roots[node] = min(roots[node], root)  # a node may stand on both sides
        x2 = np.array([roots[n] for n in left[rows].tolist()], np.int64)
        y2 = np.array([roots[n] for n in right[cols].tolist()], np.int64)
        if (x2 == x).all() and (y2 == y).all():
            return list(roots.items())
        x, y = x2, y2


_BLOCKS = pa.schema([
    ("block", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("nodes", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())),
    ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("cells", pa.list_(pa.list_(pa.int32()))), ("units", pa.binary()),
])
_BLOCKS_DDL = "block long, label string, dim int, nodes array<long>, copies array<long>, low array<double>, high array<double>, cells array<array<int>>, units binary"


def _gridded(axes: dict[int, np.ndarray], eps: float, grid: int):
    schema = pa.schema([("node", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("copies", pa.int64()), ("cell", pa.list_(pa.int32())), ("units", pa.binary())])

    def run(source):
        for batch in source:
            units = [unit(v[None, :])[0] for v in _vectors(batch.column("vector"))]
            cells = [np.floor(u @ axes[len(u)][:, :grid] / eps).astype(np.int32).tolist() for u in units]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), pa.array([len(u) for u in units], pa.int32()), batch.column("copies"), pa.array(cells, schema.field("cell").type), pa.array([u.tobytes() for u in units], pa.binary())], schema=schema)

    return run


def _cut(axes: dict[int, np.ndarray], rows: int):
    """Cut a partition's part of the sequence into blocks of one label and number of components."""

    def run(source):
        number = TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def block():
            nonlocal number, held
            units = np.stack([np.frombuffer(x[5]) for x in held])
            p = units @ axes[held[0][2]]
            out = (number, held[0][1], held[0][2], [x[0] for x in held], [x[3] for x in held], p.min(axis=0).tolist(), p.max(axis=0).tolist(), [list(c) for c in dict.fromkeys(tuple(x[4]) for x in held)], units.tobytes())
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, _BLOCKS, strict=True)], schema=_BLOCKS)

        for batch in source:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == rows or held[0][1:3] != row[1:3]):
                    yield block()
                held.append(row)
        if held:
            yield block()

    return run


def _join_blocks(axes: dict[int, np.ndarray], eps: float, min_cosine: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(source):
        for batch in source:
            for r in batch.to_pylist():
                a = np.frombuffer(r["units"]).reshape(-1, r["dim"])
                b = np.frombuffer(r["units2"]).reshape(-1, r["dim"])
                hits = joined_intervals(a, b, a @ axes[r["dim"]], b @ axes[r["dim"]], eps, min_cosine)
                left, right = np.array(r["nodes"]), np.array(r["nodes2"])
                same = r["block"] == r["block2"]
                if same:
                    hits |= hits.T
                    np.fill_diagonal(hits, False)
                if not hits.any():
                    continue
                links: dict[int, int] = {}
                for nodes, found in ((left, hits @ np.array(r["copies2"])),) + (() if same else ((right, np.array(r["copies"]) @ hits),)):
                    links.update(zip(nodes[found > 0].tolist(), found[found > 0].tolist(), strict=True))
                rows = [(n, links[n], root) for n, root in forest(hits, left, right)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def _neighbours(cells: Column, axes: int) -> Column:
    """All cells next to those of an array, themselves included, each once."""
    near = cells
    for i in range(axes):
        step = lambda d, i=i: F.transform(near, lambda c: F.transform(c, lambda x, k: x + F.when(k == i, d).otherwise(0)))  # noqa: E731, B023
        near = F.array_distinct(F.concat(step(-1), step(0), step(1)))
    return near


def node_links(nodes: DataFrame, min_cosine: float, grid: int = GRID_AXES, block: int = BLOCK) -> DataFrame:
    """(node, links, root) from each pair of blocks: vectors linked in it, counted with their copies, and the smallest node reached in it.

    ``nodes``: (node, label, vector, copies), usable vectors, no two equal under a label.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    axes = principal_axes(nodes)
    placed = nodes.mapInArrow(_gridded(axes, max(eps, 1e-6) + SLACK, grid), "node long, label string, dim int, copies long, cell array<int>, units binary")
    order = ["label", "dim", *(F.coalesce(F.get("cell", F.lit(i)), F.lit(0)) for i in range(grid)), "node"]
    blocks = settle(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut(axes, block), _BLOCKS_DDL), "blocks")

    held = blocks.select("block", "label", "dim", "low", "high", F.explode("cells").alias("cell"))
    asked = blocks.select(F.col("block").alias("block2"), "label", "dim", F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(_neighbours(F.col("cells"), grid)).alias("cell"))
    gaps = F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= (eps + SLACK) ** 2
    pairs = settle(held.join(asked, ["label", "dim", "cell"]).where((F.col("block") <= F.col("block2")) & near).select("block", "block2").distinct(), "pairs")

    wide = blocks.select("block", "dim", "nodes", "copies", "units")
    wide2 = blocks.select(F.col("block").alias("block2"), F.col("nodes").alias("nodes2"), F.col("copies").alias("copies2"), F.col("units").alias("units2"))
    met = pairs.join(wide, "block").join(wide2, "block2").select("block", "block2", "dim", "nodes", "copies", "units", "nodes2", "copies2", "units2")
    return settle(met.mapInArrow(_join_blocks(axes, eps, min_cosine), "node long, links long, root long"), "links", batch_rows=64)


def near_vectors(vectors: DataFrame, min_cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Vectors link if their labels are equal and not null, they have equally many
    components and their cosine in double precision is at least ``min_cosine``, which
    is above 0. n_links counts other rows; component_id is the smallest vec_id that is
    reachable, the own included; kept says that it is the own. Null or zero vectors
    and those with a null or non-finite component link with nothing, nor do rows with
    a null vec_id, whose component_id is null and which are not kept. Rows that repeat
    a vec_id count and link as rows of their own. Other columns are not looked at. An
    empty table gives an empty table.
    """
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must be above 0 and at most 1")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.col("vec_id").isNotNull() & usable(F.col("vector"), F.col("label"))
    # Two hashes of label and vector, in different orders, stand for both; hashing takes -0.0 and 0.0 as one.
    keyed = rows.where(good).withColumns({"k1": F.xxhash64("label", "vector"), "k2": F.xxhash64("vector", "label", F.lit(1))})
    nodes = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    found = node_links(nodes.select("node", "label", "vector", "copies"), min_cosine)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found, "node", "root").withColumnRenamed("component", "top")
    told = nodes.select("node", "k1", "k2", "least", "copies").join(counts, "node", "left").join(reached, "node", "left")
    told = settle(told.withColumn("top", F.coalesce("top", "node")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1), "told")
    least = settle(told.groupBy("top").agg(F.min("least").alias("component_id")), "told")
    by_key = settle(told.join(least, "top").select("k1", "k2", "n_links", "component_id"), "told")
    linked = keyed.select("vec_id", "k1", "k2").join(by_key, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
