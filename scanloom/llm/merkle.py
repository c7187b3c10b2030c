"""Merkle manifest of a dataset, and proofs of all rows by octopus multiproofs.

Each row is a leaf. The leaves of a group, in order, are the bottom of a binary tree,
and the roots of the groups are the leaves of one more tree above them. Rows are
dealt by range, so that their places in the trees come from the counts of each part,
without a window over all rows. Trees are built in blocks of consecutive nodes, ten
levels a round; every node is kept as a row (tree, level, place).

A proof of a leaf is the sibling at each level up to the root. Rows are proved in
leaf partitions, runs of consecutive rows: a partition works out the least set of
nodes that its leaves don't give themselves, fetches them all in one join, derives
the interior nodes that its proofs share, and expands each row's own proof locally.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import measured, settle

#: Levels that a task builds at once (a block of two to the power of so many nodes), rows of a leaf partition.
LEVELS, RUN = 10, 1024
#: Rows of a part when rows are put in order.
PART_ROWS = 1 << 20
#: The tree above the groups; those of the groups are numbered from 0.
TOP = -1

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.binary())])
_NODES_DDL = "tree long, n long, level int, place long, digest binary"
_COORDS = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("place", pa.int64())])
_COORDS_DDL = "part int, run long, tree long, level int, place long"
_PROOFS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("siblings", pa.list_(pa.string())), ("folded_root", pa.string())])
_PROOFS_DDL = "doc_id long, leaf string, subroot string, siblings array<string>, folded_root string"


def joined_hash(*digests: str) -> str:
    """The node above digests given as hex text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree with n leaves."""
    return max(n - 1, 0).bit_length()


def width(n: int, level: int) -> int:
    """Nodes on a level of a tree with n leaves."""
    return -(-n >> level)


def missing(places: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The least set of nodes, as (level, places), that leads from the leaves at ``places`` (sorted, distinct) to the root of n leaves.

    On each level it is the siblings of the nodes that are known so far, those that
    exist and aren't known themselves.
    """
    out = []
    for level in range(height(n)):
        siblings = places ^ 1
        lacking = siblings[(siblings < width(n, level)) & ~np.isin(siblings, places, assume_unique=True)]
        if lacking.size:
            out.append((level, lacking))
        places = np.unique(places >> 1)
    return out


# --- leaves ------------------------------------------------------------------


def leaf_digest(values: list[Column]) -> Column:
    """The leaf of a row: SHA-256 over its values, each with its length in bytes before it, ``-`` if null."""
    shown = [v.cast("string") for v in values]
    parts = [F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in shown]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _in_order(rows: DataFrame, order: list[str], what: str) -> DataFrame:
    """A settled table of ``rows`` by range of ``order``, with ``part`` and ``row``, the number of a row within its part."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return settle(dealt.select("*", F.spark_partition_id().alias("part"), number.alias("row")), what)


def _placed(rows: DataFrame, tree: str) -> DataFrame:
    """Rows of ``_in_order`` with ``place``, their number within their tree; a part knows its first row, and the parts before it their counts."""
    counts = rows.groupBy("part", tree).agg(F.count("*").alias("_count"), F.min("row").alias("_first"))
    earlier = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = settle(counts.select("part", tree, (F.coalesce(F.sum("_count").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")), "shifts")
    return rows.join(measured(shifts), ["part", tree]).withColumn("place", F.col("row") + F.col("_shift")).drop("_shift")


# --- trees -------------------------------------------------------------------


def _block(table: pa.Table) -> pa.Table:
    """The nodes above a block of consecutive nodes of one level, up to ``LEVELS`` levels or the root."""
    places = table.column("place").to_numpy()
    by_place = np.argsort(places)
    digests = [d.hex() for d in table.column("digest").take(pa.array(by_place)).to_pylist()]
    tree, n, level = (table.column(c)[0].as_py() for c in ("tree", "n", "level"))
    first = int(places.min())
    levels, where, made = [], [], []
    for up in range(level + 1, min(level + LEVELS, height(n)) + 1):
        digests = [joined_hash(*digests[i : i + 2]) for i in range(0, len(digests), 2)]
        first >>= 1
        levels += [up] * len(digests)
        where += range(first, first + len(digests))
        made += map(bytes.fromhex, digests)
    return pa.table([[tree] * len(made), [n] * len(made), levels, where, made], schema=_NODES)


def _trees(leaves: DataFrame) -> list[DataFrame]:
    """Settled tables of all nodes above ``leaves`` (tree, n, level, place, digest), one for each round."""
    tallest = leaves.agg(F.max("n")).first()[0] or 0
    rounds, now = [], leaves
    for base in range(0, height(tallest), LEVELS):
        block = F.shiftright("place", LEVELS)
        rounds.append(settle(now.groupBy("tree", block.alias("block")).applyInArrow(_block, _NODES_DDL), "nodes"))
        now = rounds[-1].where(F.col("level") == base + LEVELS).where(F.col("n") > F.lit(1 << (base + LEVELS)))
    return rounds


@dataclass(frozen=True)
class Manifest:
    """``leaves``: rows with doc_id, leaf, claimed and their coordinates; ``nodes``: all nodes; ``root``: hex text, None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    groups: int
    root: str | None


def build(docs: DataFrame, claims: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang") -> Manifest:
    """The manifest of ``docs``: a tree for each value of ``group_col``, leaves by ``id_col``, and a tree above them by that value.

    ``claims`` is a leaf digest that is to be proved for a row instead of its own.
    Null ids and the group of nulls come first. Rows of one id are in the order of
    their digests; repeated rows are leaves of their own.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).cast("string").alias("grp"), leaf.alias("leaf"), (leaf if claims is None else claims).alias("claimed")
    )
    rows = settle(rows.withColumn("number", F.monotonically_increasing_id()), "leaves")
    counts = settle(rows.groupBy("grp").agg(F.count("*").alias("n")), "groups")
    groups = _in_order(counts.withColumn("above", F.lit(TOP)), ["above", "grp"], "groups")
    groups = settle(_placed(groups, "above").select("grp", "n", F.col("place").alias("tree")), "groups")
    # A table forgets how it was dealt: a hot group is dealt anew by range.
    rows = rows.join(measured(groups), rows["grp"].eqNullSafe(groups["grp"])).select("doc_id", "leaf", "claimed", "number", "tree", "n")
    leaves = _placed(_in_order(rows, ["tree", "doc_id", "leaf", "number"], "leaves"), "tree")
    leaves = leaves.withColumn("run", F.floor(F.col("row") / RUN))
    node = lambda t: t.select("tree", "n", "level", "place", "digest")
    bottom = node(leaves.withColumn("level", F.lit(0)).withColumn("digest", F.col("leaf")))
    lower = _trees(bottom)
    nodes = bottom
    for t in lower:
        nodes = nodes.unionByName(t)
    n_groups = groups.count()
    subroots = nodes.where(F.col("level") == _height("n")).select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), F.lit(0).alias("level"), F.col("tree").alias("place"), "digest"
    )
    subroots = settle(subroots, "subroots")
    nodes = nodes.unionByName(subroots)
    for t in _trees(subroots):
        nodes = nodes.unionByName(t)
    root = nodes.where((F.col("tree") == TOP) & (F.col("level") == height(n_groups))).select(F.lower(F.hex("digest"))).first()
    return Manifest(leaves, nodes, n_groups, root[0] if root else None)


def _height(n: str) -> Column:
    """``height`` as a column: binary digits of n - 1, none for 0."""
    return F.when(F.col(n) <= 1, 0).otherwise(F.length(F.bin(F.col(n) - 1))).cast("int")


# --- proofs ------------------------------------------------------------------


def _runs_of(table: pa.Table) -> list[tuple[int, int, np.ndarray]]:
    """(tree, n, rows by place) for each tree that has rows in a leaf partition."""
    trees, places = table.column("tree").to_numpy(), table.column("place").to_numpy()
    order = np.lexsort((places, trees))
    starts = np.flatnonzero(np.diff(trees[order], prepend=trees[order[0]] - 1))
    return [(int(trees[rows[0]]), table.column("n")[int(rows[0])].as_py(), rows) for rows in np.split(order, starts[1:])]


def prove(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, siblings, folded_root, verified) for each row of the manifest.

    ``siblings``: its proof, from the bottom level of its group's tree to the top of the
    one above, levels without a sibling left out. ``folded_root``: the root that
    follows from its claimed leaf and its siblings; ``verified``: it is the manifest's.
    Digests are hex text. An empty manifest gives no rows.
    """
    groups, root = manifest.groups, manifest.root

    def ask(table: pa.Table) -> pa.Table:
        part, run = table.column("part")[0].as_py(), table.column("run")[0].as_py()
        held = _runs_of(table)
        lacking = [(tree, level, p) for tree, n, rows in held for level, p in missing(table.column("place").to_numpy()[rows], n)]
        lacking += [(TOP, level, p) for level, p in missing(np.array([tree for tree, _, _ in held], np.int64), groups)]
        rows = [(part, run, tree, level, place) for tree, level, p in lacking for place in p.tolist()]
        return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5, schema=_COORDS)

    def expand(table: pa.Table, fetched: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _PROOFS.empty_table()
        known = {c[:3]: c[3].hex() for c in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "place", "digest")), strict=True)}
        docs, places = table.column("doc_id").to_pylist(), table.column("place").to_pylist()
        leaves = [d.hex() for d in table.column("leaf").to_pylist()]
        claims = [d.hex() for d in table.column("claimed").to_pylist()]
        held = _runs_of(table)

        def derive(tree: int, n: int, at: set[int]) -> None:
            """Interior nodes above the known ones at ``at``, each once."""
            for level in range(height(n)):
                last = width(n, level) - 1
                at = {p >> 1 for p in at}
                for p in at:
                    pair = [known[tree, level, 2 * p], *([known[tree, level, 2 * p + 1]] if 2 * p < last else [])]
                    known[tree, level + 1, p] = joined_hash(*pair)

        for tree, n, rows in held:
            known.update(((tree, 0, places[r]), leaves[r]) for r in rows.tolist())
            derive(tree, n, {places[r] for r in rows.tolist()})
            known[TOP, 0, tree] = known[tree, height(n), 0]
        derive(TOP, groups, {tree for tree, _, _ in held})

        def path(tree: int, n: int, place: int) -> list[tuple[str, bool]]:
            """(sibling, whether it stands left) of each level that has one; None where it has none."""
            return [(known.get((tree, level, place >> level ^ 1)), bool(place >> level & 1)) for level in range(height(n))]

        out = []
        for tree, n, rows in held:
            above = path(TOP, groups, tree)
            for r in rows.tolist():
                steps = path(tree, n, places[r]) + above
                folded = claims[r]
                for sibling, left in steps:
                    folded = joined_hash(folded) if sibling is None else joined_hash(sibling, folded) if left else joined_hash(folded, sibling)
                out.append((docs[r], leaves[r], known[tree, height(n), 0], [s for s, _ in steps if s is not None], folded))
        return pa.table([list(c) for c in zip(*out, strict=True)], schema=_PROOFS)

    run = ["part", "run"]
    asked = settle(manifest.leaves.select(*run, "tree", "n", "place").groupBy(*run).applyInArrow(ask, _COORDS_DDL), "asked")
    fetched = asked.join(manifest.nodes.select("tree", "level", "place", "digest"), ["tree", "level", "place"])
    leaves = manifest.leaves.select(*run, "tree", "n", "place", "doc_id", "leaf", "claimed")
    proofs = leaves.groupBy(*run).cogroup(fetched.groupBy(*run)).applyInArrow(expand, _PROOFS_DDL)
    return proofs.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "siblings", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
