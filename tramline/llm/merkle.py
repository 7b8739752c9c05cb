"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

H is lowercase hex SHA-256 over its inputs one after another, digests as hex text. A leaf is H of a row's fields, each as its
count of UTF-8 bytes, a colon and its value (integers in decimal), or a hyphen if null. Eight nodes in a row, fewer at the
end, become one node, until a single one remains.

Rows of a group are numbered across partitions (ranges of order, numbered in each and offset by the counts before), and cut
into aligned blocks of 8^4. A block gives its root; roots are nodes of the next tier, which is cut likewise until every
group has one. Proofs run the other way: each block walks through its leaves by fractal traversal, which keeps two stacked
subtrees a band of levels, the existing one that the path of the leaf at hand runs through and the desired one that comes
next and grows by a leaf at a time; what a path needs above the block is joined to it, tier by tier. A block holds 4,096
digests, however large or skewed the groups are, and the traversal of it two subtrees of 64 leaves a band.

Defined results: null groups come first, others bytewise; within a group null order values come first, ties ascend by leaf,
and rows that agree in that too have the same digests, in any order; a lone leaf is its group's root, and a lone group's root
the root of all, so a lone row's proof is H of nothing; texts of any length count whole; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import materialize

FANOUT = 8
#: Levels of a block's tree, and of the subtrees that its traversal stacks. A block has FANOUT ** BLOCK_LEVELS leaves.
BLOCK_LEVELS, BAND_LEVELS = 4, 2


def field(column: str | Column, kind: str = "string") -> Column:
    """A field of a leaf's input. Integers are written in decimal."""
    value = (F.col(column) if isinstance(column, str) else column).cast(kind)
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*columns: str | Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def h(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels of hashing until one of n nodes remains."""
    count = 0
    while n > 1:
        n, count = -(-n // FANOUT), count + 1
    return count


class Subtree:
    """Nodes of one subtree by level: grown from its leaves one at a time, as far as they go."""

    def __init__(self, levels: int) -> None:
        self.levels: list[list[str]] = [[] for _ in range(levels + 1)]

    def add(self, leaf: str, last: bool) -> None:
        """Append a leaf; runs that are full, or ended by the last leaf, are hashed into their parents at once."""
        self.levels[0].append(leaf)
        for low, high in zip(self.levels, self.levels[1:], strict=False):
            full = len(low) % FANOUT == 0
            if not full and not last:
                break
            high.append(h(low[(len(low) - 1) // FANOUT * FANOUT :]))

    @property
    def root(self) -> str:
        return self.levels[-1][0]


class FractalTraversal:
    """Paths of successive leaves of an aligned block, lowest level first: at each level the other nodes of the run.

    Levels are cut into bands. Band b has subtrees over the roots of band b - 1's, of at most FANOUT ** BAND_LEVELS of
    them; of each band the existing subtree (that the leaf at hand lies under) and the desired one (the next) are kept, and
    no more. The desired one grows while the existing one is walked through, from the roots of the band below, which grows
    ahead of it in turn; nodes(k) gives the block's leaf k and is asked for each leaf once a band.
    """

    def __init__(self, n: int, nodes: Callable[[int], str], levels: int) -> None:
        self.n, self.nodes, self.levels = n, nodes, levels
        self.bands = [min(BAND_LEVELS, levels - low) for low in range(0, levels, BAND_LEVELS)]
        self.spans = [1]
        for band in self.bands:
            self.spans.append(self.spans[-1] * FANOUT**band)
        self.existing = [self._whole(b, 0) for b in range(len(self.bands))]
        self.desired: list[Subtree | None] = [None] * len(self.bands)
        self.grown = [0] * len(self.bands)

    def _leaf(self, band: int, k: int) -> str:
        """Leaf k of a band: a leaf of the block, or the root of a subtree of the band below, by tree hash."""
        return self.nodes(k) if band == 0 else self._whole(band - 1, k).root

    def _count(self, band: int) -> int:
        """How many leaves a band has in all."""
        return -(-self.n // self.spans[band])

    def _whole(self, band: int, k: int) -> Subtree:
        """Subtree k of a band."""
        tree, size = Subtree(self.bands[band]), FANOUT ** self.bands[band]
        upto = min((k + 1) * size, self._count(band))
        for i in range(k * size, upto):
            tree.add(self._leaf(band, i), i == upto - 1)
        return tree

    def _grow(self, band: int, k: int) -> None:
        """One more leaf for the desired subtree, k, of a band, if it lacks any."""
        size = FANOUT ** self.bands[band]
        at, upto = k * size + self.grown[band], min((k + 1) * size, self._count(band))
        if at >= upto:
            return
        if self.desired[band] is None:
            self.desired[band] = Subtree(self.bands[band])
        self.desired[band].add(self._leaf(band, at), at == upto - 1)
        self.grown[band] += 1

    def paths(self) -> Iterator[list[list[str]]]:
        for k in range(self.n):
            path: list[list[str]] = []
            for band, height in enumerate(self.bands):
                low, high = self.spans[band], self.spans[band + 1]
                if k and k % high == 0:  # the desired subtree is complete, and takes the existing one's place
                    while self.grown[band] < min(high // low, self._count(band) - k // low):
                        self._grow(band, k // high)
                    self.existing[band], self.desired[band], self.grown[band] = self.desired[band], None, 0
                if k % low == 0:
                    self._grow(band, k // high + 1)
                tree, at = self.existing[band].levels, k // low % (high // low)
                for level in range(height):
                    run = tree[level][at // FANOUT * FANOUT : at // FANOUT * FANOUT + FANOUT]
                    path.append(run[: at % FANOUT] + run[at % FANOUT + 1 :])
                    at //= FANOUT
            yield path

    @property
    def root(self) -> str:
        return self.existing[-1].root if self.bands else self.nodes(0)


def fold(node: str, at: int, path: list[list[str]]) -> str:
    """The root from a node, its place and its siblings level by level."""
    for siblings in path:
        node = h([*siblings[: at % FANOUT], node, *siblings[at % FANOUT :]])
        at //= FANOUT
    return node


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with tree (the group's number, null first), pos (the row's place in its group) and n (the group's size).

    No group meets in one task: ranges of (group, order) are sorted apart and numbered, and offset by the counts of the
    ranges before. The rows must read the same each time."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), f"{name}-placed")
    part = F.shiftright("at", 33)
    counts = materialize(placed.groupBy(group, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows")), f"{name}-counts")
    # Groups are numbered likewise, of all ranges' first rows: a range counts as one row of its first group and of those that begin in it.
    by_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("rows").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = counts.select(group, "part", "first", before.alias("before"), F.sum("rows").over(by_group).alias("n"))
    begun = F.sum((F.col("before") == 0).cast("long")).over(Window.partitionBy("part").orderBy(F.col(group).asc_nulls_first()))
    begins = materialize(sized.withColumn("begun", begun), f"{name}-sized")
    parts = begins.groupBy("part").agg(F.max("begun").alias("begun_in"))
    earlier = F.coalesce(F.sum("begun_in").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    trees = begins.where("before = 0").join(parts.select("part", earlier.alias("earlier")), "part").select(F.col(group).alias("of"), (F.col("begun") + F.col("earlier") - 1).alias("tree"))
    offsets = begins.join(trees, F.col(group).eqNullSafe(F.col("of"))).select("tree", F.col(group).alias("of"), F.col("part").alias("of_part"), (F.col("before") - F.col("first")).alias("shift"), "n")
    return placed.join(offsets, (part == F.col("of_part")) & F.col(group).eqNullSafe(F.col("of"))).select(*rows.columns, "tree", (F.col("at") + F.col("shift")).alias("pos"), "n")


def _height(n: int) -> int:
    """Levels of a block in a tier of n nodes: all of a whole block's, unless one block holds the tier."""
    return levels_of(n) if n <= FANOUT**BLOCK_LEVELS else BLOCK_LEVELS


def _flat(path: list[list[str]]) -> str:
    return ",".join("".join(level) for level in path)


def _unflat(path: str | None) -> list[list[str]]:
    """None and no text: no levels; a level of a lone run has no digests."""
    return [[level[i : i + 64] for i in range(0, len(level), 64)] for level in path.split(",")] if path is not None else []


def _block_root(rows: pd.DataFrame) -> pd.DataFrame:
    """One block (tree, block, n, pos, node in any order): its root, a node of the next tier."""
    rows = rows.sort_values("pos")
    n, nodes = int(rows["n"].iloc[0]), rows["node"].tolist()
    tree = Subtree(_height(n))
    for k, node in enumerate(nodes):
        tree.add(node, k == len(nodes) - 1)
    return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "n": [-(-n // FANOUT**BLOCK_LEVELS)], "pos": [rows["block"].iloc[0]], "node": [tree.root]})


def _walked(rows: pd.DataFrame) -> tuple[pd.DataFrame, Iterator[list[list[str]]]]:
    """One block's rows in order, and their paths in it and on above it (above: in the row of its first node)."""
    rows = rows.sort_values("pos")
    nodes, above = rows["node"].tolist(), _unflat(rows["above"].iloc[0])
    paths = FractalTraversal(len(nodes), nodes.__getitem__, _height(int(rows["n"].iloc[0]))).paths()
    return rows, (path + above for path in paths)


def _block_paths(rows: pd.DataFrame) -> pd.DataFrame:
    rows, paths = _walked(rows)
    flat = [_flat(path) if path else None for path in paths]
    return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "path": pd.Series(flat, index=rows.index, dtype=object)})


def _block_proofs(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of leaves: what each row's proof hashes and folds to."""
    rows, paths = _walked(rows)
    tree, n = int(rows["tree"].iloc[0]), int(rows["n"].iloc[0])
    inner, subroot, root = levels_of(n), None, None
    proofs, folded = [], []
    for pos, leaf, shown, path in zip(rows["pos"], rows["node"], rows["shown"], paths, strict=True):
        if root is None:
            subroot = fold(leaf, pos, path[:inner])
            root = fold(subroot, tree, path[inner:])
        proofs.append(h([node for level in path for node in level]))
        folded.append(fold(fold(leaf if shown is None else shown, pos, path[:inner]), tree, path[inner:]))
    told = rows[["id", "node"]].rename(columns={"node": "leaf"}).assign(subroot=subroot, root=root, proof_sha256=proofs, folded_root=folded)
    return told.assign(verified=told["folded_root"] == root)


def _block() -> Column:
    return F.floor(F.col("pos") / FANOUT**BLOCK_LEVELS).cast("long").alias("block")


def tiers_of(nodes: DataFrame) -> list[DataFrame]:
    """Written tiers of trees (tree, n, pos, node), from the nodes up: each tier holds the roots of the blocks below it. A
    tree stops at the tier where it has one node."""
    tiers = [nodes]
    while True:
        below = tiers[-1].where("n > 1").select("tree", "n", "pos", "node", _block())
        up = materialize(below.groupBy("tree", "block").applyInPandas(_block_root, "tree long, n long, pos long, node string"), "tier")
        if not up.limit(1).count():
            return tiers
        tiers.append(up)


def roots_of(tiers: list[DataFrame]) -> DataFrame:
    """tree and root of every tree."""
    found = [tier.where("n = 1").select("tree", F.col("node").alias("root")) for tier in tiers]
    return reduce(DataFrame.unionByName, found)


def _with_above(tier: DataFrame, up: DataFrame | None, over: DataFrame | None) -> DataFrame:
    """A tier's nodes with their block's number and, in the first of each block, the path above it: that of the block's root
    in the tier above (up: tree, pos, path), or what is over the tree (over: tree, path) where one node is left."""
    heads = [] if up is None else [up.select("tree", (F.col("pos") * FANOUT**BLOCK_LEVELS).alias("pos"), F.col("path").alias("above"))]
    if over is not None:
        heads.append(tier.where("n = 1").select("tree", "pos").join(over, "tree").select("tree", "pos", F.col("path").alias("above")))
    rows = tier.withColumn("block", _block())
    if not heads:
        return rows.withColumn("above", F.lit(None).cast("string"))
    return rows.join(reduce(DataFrame.unionByName, heads), ["tree", "pos"], "left")


def paths_of(tiers: list[DataFrame], over: DataFrame | None = None) -> DataFrame | None:
    """tree, pos and path of the nodes of the lowest tier, from the top tier down. A path is text: levels, lowest first, set
    apart by commas, each the digests of the run's other nodes; null if there is none."""
    up = None
    for tier in reversed(tiers):
        rows = _with_above(tier.select("tree", "n", "pos", "node"), up, over)
        up = materialize(rows.groupBy("tree", "block").applyInPandas(_block_paths, "tree long, pos long, path string"), "paths")
    return up


def manifest(rows: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of each row (grp; id, a number that orders; leaf;
    shown, the leaf to verify with the row's proof, or null where it is the same; tie, the row's own number). The rows must
    be written ones: they are read more than once."""
    leaves = materialize(numbered(rows, "grp", ["id", "leaf", "tie"], "leaves").select("tree", "n", "pos", "id", F.col("leaf").alias("node"), "shown"), "leaves")
    tiers = tiers_of(leaves.select("tree", "n", "pos", "node"))
    subroots = materialize(roots_of(tiers), "subroots")
    trees = subroots.count()
    top = tiers_of(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("pos"), F.col("root").alias("node")))
    over = paths_of(top).select(F.col("pos").alias("tree"), "path")
    up = paths_of(tiers[1:], over) if len(tiers) > 1 else None
    proved = _with_above(leaves, up, over).groupBy("tree", "block").applyInPandas(_block_proofs, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return proved


def documents_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest of documents by lang, where rows for which tampered holds are verified with A-Z of their text lower-cased:
    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    shown = F.when(tampered & (lowered != F.col("text")), leaf_of(*fields, lowered))
    rows = docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf_of(*fields, "text").alias("leaf"), shown.alias("shown"), F.monotonically_increasing_id().alias("tie"))
    return manifest(materialize(rows, "rows")).withColumnRenamed("id", "doc_id")
