"""Near-duplicates by SimHash, with exact pairs from shards of vantage-point trees.

A fingerprint of some bits is cut into parts of equal length, each with a tree of its own, in which the reach, and with
it the overlap of shards, is small. Of two fingerprints that differ in fewer bits than (part_reach + 1) times the number
of parts, some part differs in part_reach bits at most, so all such pairs are found (op2: 3 bits of 64, 1 bit of each
half). Longer fingerprints with a wider reach (near copies by five-word shingles) are found if one of many parts agrees
that well, which is likely, not certain; every pair found is held against the whole fingerprints.

A tree over a bounded sample splits the Hamming space: at each node, fingerprints within the node's radius of its
vantage point go inside, the others outside. Each distinct fingerprint has one home shard. By the triangle inequality, a
fingerprint inside can be near one outside only if its own distance is within the reach of the radius, so only such
fingerprints also visit the outside: each pair within reach meets in the home shard of one of the two. Shards are cut
into blocks of bounded size, and a block at home with a block of all is a unit of work; each unit gives a spanning
forest of its links, never all pairs. Links are joined into components by rounds of star contraction over tables.

Defined results: texts without words (null, empty, white) have the fingerprint zero and are linked like any other;
equal fingerprints are linked; a row's component is the smallest doc_id in it (null only if all of its ids are null);
an empty table gives no rows; other columns are ignored (near_duplicates) or kept (drop_near_copies), whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.batches import byte_texts, slices
from tramline.llm.similar import drop_similar
from tramline.operators.graph import components
from tramline.session import materialize

SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Fingerprints that trees are fitted on (eight for each shard, between these bounds); fingerprints at home in a shard;
#: and those that a unit of work holds at home and in all.
SAMPLE, MOST_SAMPLE, SHARD, HOME_BLOCK, BLOCK = 1 << 16, 1 << 22, 1 << 11, 1 << 12, 1 << 13
#: Near copies: five-word shingles in 384 bits. Texts whose shingles have a Jaccard similarity of 0.8 have vectors with
#: a cosine of 0.889, which differ in 0.152 of the bits, 58 of 384 (with a standard deviation of 7).
NEAR = {"width": 5, "bits": 384, "reach": 62, "part_bits": 24, "part_reach": 1}


def _more(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits of a hash: the first are its own, the others are mixed from them (splitmix64)."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: bytes, width: int = 3, bits: int = 64) -> bytes:
    """Bits set in over half of the hashes of the text's shingles of width words."""
    words = text.translate(LOWER).split()
    if not words:
        return bytes(bits // 8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[len(words) - n :].tolist()
    ones, hash_ = np.zeros((bits // 64, 64), np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        hashes = np.fromiter((hash_(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)), np.uint64)
        for k in range(bits // 64):
            ones[k] += np.unpackbits(_more(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones.ravel() > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 3, bits: int = 64) -> DataFrame:
    """All columns of docs with fp binary (the fingerprint) after them. docs: with text, or a struct doc that has it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([fingerprint(t, width, bits) for t in byte_texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "fp"])

    return docs.mapInArrow(each, docs.select("*", F.lit(b"").alias("fp")).schema)


def _matrix(column: pa.Array | pd.Series, bits: int) -> np.ndarray:
    """Fingerprints as rows of bytes."""
    rows = column.to_pylist() if isinstance(column, pa.Array) else column.tolist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, bits // 8)


def _part(prints: np.ndarray, k: int, part_bits: int) -> np.ndarray:
    """The k-th part of each fingerprint, as a number."""
    own = prints[:, k * part_bits // 8 : (k + 1) * part_bits // 8]
    return np.pad(own, ((0, 0), (0, 4 - own.shape[1]))).copy().view(np.uint32).ravel()


class VantageTree:
    """A complete tree of vantage points and radii; node k has the children 2k+1 (inside) and 2k+2 (outside)."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.points, self.radii = np.zeros(2**depth - 1, sample.dtype), np.full(2**depth - 1, 64, np.int64)
        groups = {0: sample}
        for node in range(2**depth - 1):
            own = groups.pop(node)
            if len(own) < 4:
                groups[2 * node + 1], groups[2 * node + 2] = own, own[:0]
                continue
            tried = rng.choice(own, min(len(own), 8), replace=False)
            distances = np.bitwise_count(own[None, :] ^ tried[:, None]).astype(np.int64)
            pick = int(distances.std(1).argmax())  # the point that tells the others apart best
            self.points[node], self.radii[node] = tried[pick], int(np.median(distances[pick]))
            inside = distances[pick] <= self.radii[node]
            groups[2 * node + 1], groups[2 * node + 2] = own[inside], own[~inside]

    def shards(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (place in fps, shard, whether at home) for all shards that a fingerprint goes to."""
        at, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(fps[at] ^ self.points[node]).astype(np.int64)
            radius = self.radii[node]
            # A visitor follows its whole ball; a resident follows its side, and its ball outwards only.
            inner, outer = np.where(home, d <= radius, d - reach <= radius), np.where(home, d > radius, d + reach > radius)
            cross = home & (d <= radius) & (d + reach > radius)
            at, node, home = (
                np.concatenate([at[inner], at[outer], at[cross]]),
                np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2, 2 * node[cross] + 2]),
                np.concatenate([home[inner], home[outer], np.zeros(cross.sum(), bool)]),
            )
        return at, node, home


def forest(prints: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int, part_reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Two ends of each link of a spanning forest of the links between rows left and rows right.

    Links are pairs whose part differs in part_reach bits at most, and the whole fingerprint in reach.
    """
    whole = np.ascontiguousarray(prints).view(np.uint64)
    labels, ends = np.arange(len(prints)), ([], [])
    for k in range(0, len(left), 256):
        rows = left[k : k + 256]
        i, j = np.nonzero(np.bitwise_count(part[rows][:, None] ^ part[right][None, :]) <= part_reach)
        i, j = rows[i], right[j]
        near = np.concatenate([np.bitwise_count(whole[i[c : c + (1 << 17)]] ^ whole[j[c : c + (1 << 17)]]).sum(1, dtype=np.int64) for c in range(0, len(i), 1 << 17)] or [np.zeros(0, np.int64)]) <= reach
        i, j = i[near], j[near]
        opens = np.flatnonzero(np.diff(i, prepend=-1))
        for row, others in zip(i[opens].tolist(), np.split(j, opens[1:]) if len(opens) else [], strict=True):
            found, first = np.unique(labels[others], return_index=True)
            new = found != labels[row]
            if new.any():
                ends[0].append(np.full(new.sum(), row))
                ends[1].append(others[first[new]])
                labels[np.isin(labels, found)] = labels[row]
    return tuple(np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends)


def links(distinct: DataFrame, bits: int = 64, reach: int = 3, part_bits: int = 32, part_reach: int = 1, sample: int = SAMPLE, shard: int = SHARD, home_block: int = HOME_BLOCK, block: int = BLOCK) -> DataFrame:
    """a, b: ids at the ends of links between fingerprints within reach that connect all that such links connect.

    distinct: a table (written, as it is read often) of different fingerprints: id long, fp binary.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    sample = min(max(sample, 8 * total // shard), MOST_SAMPLE)
    drawn = _matrix(distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"], bits)
    depth = max(0, min(round(np.log2(max(1, total) / shard)), int(np.log2(max(1, len(drawn)) / 8))))
    count = bits // part_bits
    trees = spark.sparkContext.broadcast([VantageTree(_part(drawn, k, part_bits), depth) for k in range(count)])  # at most sample/8 nodes each

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _matrix(batch.column("fp"), bits)
            for k, tree in enumerate(trees.value):
                at, node, home = tree.shards(_part(prints, k, part_bits), part_reach)
                took = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([took.column("id"), took.column("fp"), pa.array(node * count + k), pa.array(home)], ["id", "fp", "shard", "home"])

    # Routing is cheap, and its rows are many: it is done once for the sizes of shards, and again for the units.
    routed = distinct.select("id", "fp").mapInArrow(route, "id long, fp binary, shard long, home boolean")
    # One row for each shard of each tree.
    sizes = routed.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes"))
    sizes = sizes.where("homes > 0 AND n > 1").select("shard", F.ceil(F.col("homes") / home_block).cast("int").alias("rows"), F.ceil(F.col("n") / block).cast("int").alias("columns"))
    placed = routed.join(F.broadcast(materialize(sizes, "shard-sizes")), "shard")
    own = lambda n: F.pmod(F.xxhash64("fp", F.lit(SEED)), n).cast("int")
    placed = placed.withColumns({"row": F.when(F.col("home"), own(F.col("rows"))), "column": own(F.col("columns"))})
    # Unit (i, j) holds the shard's row block i (those at home) and column block j (all); most shards are one unit.
    unit = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    as_row = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: unit(F.col("row"), j)))
    as_column = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: unit(i, F.col("column")))
    met = placed.withColumn("unit", F.explode(F.array_union(F.coalesce(as_row, F.array().cast("array<struct<i:int,j:int>>")), as_column)))
    side = (F.coalesce(F.col("row") == F.col("unit.i"), F.lit(False)).cast("byte") + 2 * (F.col("column") == F.col("unit.j")).cast("byte")).cast("byte")
    units = met.select("id", "fp", "shard", (F.col("unit.i").cast("long") * (1 << 31) + F.col("unit.j")).alias("unit"), side.alias("side"))

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        prints, side, ids = _matrix(f["fp"], bits), f["side"].to_numpy(), f["id"].to_numpy()
        part = _part(prints, int(f["shard"].iloc[0]) % count, part_bits)
        a, b = forest(prints, part, np.flatnonzero(side & 1), np.flatnonzero(side & 2), reach, part_reach)
        pairs = np.stack([ids[a], ids[b]], 1).reshape(-1, 2)
        return pd.DataFrame({"a": pairs.min(1), "b": pairs.max(1)})

    return units.groupBy("shard", "unit").applyInPandas(joined, "a long, b long").where("a <> b").distinct()


def classes(rows: DataFrame, **measure: int) -> DataFrame:
    """fp, component_id (the smallest doc_id that links reach) and stays (the row that has it) for each fp of rows.

    rows: a table with doc_id, row (different longs) and fp. measure: bits, reach, part_bits and part_reach of links.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))  # null ids come last
    distinct = materialize(rows.groupBy("fp").agg(F.min("row").alias("id"), first.alias("first")), "distinct")
    roots = components(links(distinct.select("id", "fp"), **measure))
    named = distinct.join(roots, distinct["id"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "id").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("least"))
    return named.join(ids, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("stays"))


def near_duplicates(docs: DataFrame, width: int = 3, **measure: int) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of each row; by default 64 bits of which 3 may differ."""
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    rows = materialize(fingerprints(inner, width, measure.get("bits", 64)).select("doc_id", "row", "fp"), "fingerprints")
    return rows.join(classes(rows, **measure), "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, width: int = NEAR["width"], **measure: int) -> DataFrame:
    """The rows of docs that stay: one of each component, that with its smallest doc_id (of equal ids, the first). Without
    a measure of fingerprints, texts are compared by their shingles themselves, so that no similar pair is left out.

    Rows are numbered and written with their fingerprints; of the rest, only numbers are shuffled. The rows that go are
    written too, so that Spark knows their size when it picks the join that takes them out.
    """
    if not measure:
        return drop_similar(docs, width)
    inner = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(fingerprints(inner, width, measure.get("bits", 64)).select("doc", "doc_id", "row", "fp"), "fingerprints")
    numbers = rows.select("doc_id", "row", "fp")
    gone = materialize(numbers.join(classes(numbers, **measure), "fp").where("row <> stays").select("row"), "near-copies")
    return rows.join(gone, "row", "left_anti").select("doc.*")
