"""Nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted in numpy on a bounded sample; every vector is assigned and encoded where it lies.
A query visits the lists of its nearest centroids. As many are visited as hold PROBED of the true neighbours of drawn
queries, which are compared with every vector, so that the share found is measured, not assumed: queries may lie
elsewhere than the rest, and large vectors may be rare. In a unit of work, tables of a query's inner products with the
codebooks give approximate scores of all coded vectors of the lists it visits; the best RERANK are scored exactly, in
double precision on the original vectors, and so are those that the error of their own code may have kept from the best k.

Equal vectors are one entry of the index with its k + 1 smallest ids (a query's best k can hold no others), found in two
steps by salted groups. Lists are put together, or cut, to units of bounded size, and so are the queries of a unit.

Defined results: vectors that are null, empty, zero, not of the most usual length, or hold null or non-finite numbers
take no part; rows with a query's own vec_id are not among its candidates; null ids take no part; ties go to the smaller
vec_id; with fewer candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import materialize

#: Vectors that the index is fitted on (16 for each list, between these bounds), and sampled queries that set how many
#: lists are visited.
SAMPLE, MOST_SAMPLE, SAMPLE_QUERIES = 1 << 14, 1 << 18, 256
#: Share of the sample's true neighbours that visited lists must hold.
PROBED = 0.97
#: Vectors and queries in a unit of work, vectors of a unit scored exactly for a query at least, and how many deviations
#: of its score a code may be off.
UNIT, UNIT_QUERIES, RERANK, DEVIATIONS = 1 << 13, 1 << 10, 256, 4.0
SALTS = 32


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[k : k + 4096] @ centres.T - half).argmax(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, column, k) for column in x.T], 1)
        full = count > 0
        centres[full] = (sums[full] / count[full, None]).astype(x.dtype)
        if not full.all():
            centres[~full] = x[rng.choice(len(x), (~full).sum())]
    return centres


class Index:
    """The fitted model: centres of lists, codebooks of the parts of residuals, and how many lists a query visits."""

    def __init__(self, sample: np.ndarray, lists: int, k: int, part: int = 4, codes: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.dim, self.part = sample.shape[1], part
        self.parts = -(-self.dim // part)
        self.centres = k_means(sample, lists, 10, rng)
        own = _nearest(sample, self.centres)
        residuals = self._padded(sample - self.centres[own]).reshape(len(sample), self.parts, part)
        self.books = np.stack([k_means(residuals[:, m], min(codes, len(sample)), 8, rng) for m in range(self.parts)])
        queries = sample[rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)]
        scores, order = queries @ sample.T, self.order(queries)
        best = np.argsort(-scores, axis=1, kind="stable")[:, 1 : k + 1]
        ranks = np.argsort(order, axis=1)  # of each list for each query
        held = np.take_along_axis(ranks, own[best], 1)
        self.probes = int(np.quantile(held, PROBED, method="higher")) + 1 if held.size else lists

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * self.part - self.dim)))

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Lists in order of the centre's inner product with each query."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(x, self.centres)
        residuals = self._padded(x - self.centres[own]).reshape(len(x), self.parts, self.part)
        return own, np.stack([_nearest(residuals[:, m], self.books[m]) for m in range(self.parts)], 1).astype(np.uint8)

    def errors(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each vector lies from what its code stands for."""
        off = self._padded(x - self.centres[own]).reshape(len(x), self.parts, self.part)
        return np.sqrt(sum(((off[:, m] - self.books[m][codes[:, m]]) ** 2).sum(1) for m in range(self.parts)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with each code: parts, codes, queries."""
        return np.einsum("qmd,mcd->mcq", self._padded(queries).reshape(len(queries), self.parts, self.part), self.books)


def _matrix(column: pa.Array, dim: int, dtype=np.float32) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dim)


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and embedding of the rows that take part, and their length."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding")).where(F.col("vec_id").isNotNull())
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = usual["n"] if usual else 0
    return rows.where(F.size("embedding") == dim), dim


def _probes(coded: DataFrame, queries: np.ndarray, index: Index, k: int) -> int:
    """Lists that a query visits: those that hold PROBED of the drawn queries' k nearest of all coded vectors."""
    dim = queries.shape[1]
    shared = coded.sparkSession.sparkContext.broadcast(queries)  # SAMPLE_QUERIES rows

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        scores, lists = np.zeros((len(q), 0), q.dtype), np.zeros((len(q), 0), np.int32)
        for batch in batches:
            x, own = _matrix(batch.column("embedding"), dim), batch.column("list").to_numpy()
            for at in range(0, len(x), 4096):
                part = own[at : at + 4096]
                scores = np.concatenate([scores, q @ x[at : at + 4096].T], 1)
                lists = np.concatenate([lists, np.broadcast_to(part, (len(q), len(part)))], 1)
                top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                scores, lists = np.take_along_axis(scores, top, 1), np.take_along_axis(lists, top, 1)
        at = np.repeat(np.arange(len(q), dtype=np.int32), scores.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(scores.ravel().astype(np.float64)), pa.array(lists.ravel().astype(np.int32))], ["q", "score", "list"])

    found = coded.select("list", "embedding").mapInArrow(best, "q int, score double, list int")
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))).where(F.col("rank") <= k + 1).collect()  # k + 1 for each drawn query
    ranks = np.argsort(index.order(queries), axis=1)
    return int(np.quantile([ranks[r["q"], r["list"]] for r in top], PROBED, method="higher")) + 1 if top else 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, lists: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors found for each row that meets is_query (on vec_id)."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # The k + 1 smallest ids of equal vectors: first in parts of a group, then of what the parts leave.
    few = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("place", F.row_number().over(Window.partitionBy("embedding", "salt").orderBy("vec_id")))
    few = few.where(F.col("place") <= k + 1).withColumn("place", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    entries = materialize(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    total = entries.count()
    sample = min(max(sample, 16 * round(total**0.5)), MOST_SAMPLE)
    drawn = _matrix(entries.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).toArrow().column("embedding").combine_chunks(), dim)
    lists = lists or max(1, min(round(total**0.5), len(drawn) // 16))
    index = Index(drawn, lists, k)
    shared = spark.sparkContext.broadcast(index)  # centres and codebooks: under sample vectors

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, codes = shared.value.encode(_matrix(batch.column("embedding"), dim))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), flat.cast(pa.binary()), batch.column("embedding"), batch.column("ids")], ["list", "code", "embedding", "ids"])

    element = rows.schema["embedding"].dataType.simpleString()
    coded = materialize(entries.mapInArrow(encode, f"list int, code binary, embedding {element}, ids array<long>"), "coded")
    drawn = _matrix(rows.where(is_query).select("embedding").orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE_QUERIES).toArrow().column("embedding").combine_chunks(), dim)
    probes = max(index.probes, _probes(coded, drawn, index, k)) if len(drawn) else index.probes
    # One row for each list. Small lists share a unit, in order; a large one has units of its own.
    first, parts, held_by, unit, room = {}, {}, {}, -1, 0
    for r in coded.groupBy("list").count().orderBy("list").collect():
        n, held_by[r["list"]] = -(-r["count"] // UNIT), r["count"]
        if n > 1 or r["count"] > room:
            unit, room = unit + 1, UNIT
        first[r["list"]], parts[r["list"]] = unit, n
        unit, room = unit + n - 1, room - r["count"] if n == 1 else 0
    units = unit + 1
    firsts, counts, sizes = (np.array([d.get(x, 0) for x in range(lists)], np.int64) for d in (first, parts, held_by))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            chosen = model.order(_matrix(batch.column("embedding"), dim))
            where, to, which = [], [], []
            for q, row in enumerate(chosen):
                # More lists than usual, where the usual ones hold too few vectors.
                row = row[: max(probes, int(np.searchsorted(np.cumsum(sizes[row]), k + 1)) + 1)]
                row = row[counts[row] > 0]
                at = np.repeat(firsts[row], counts[row]) + np.arange(counts[row].sum()) - np.repeat(np.cumsum(counts[row]) - counts[row], counts[row])
                by = np.repeat(row, counts[row])
                order = np.argsort(at, kind="stable")
                for group in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    where.append(q)
                    to.append(int(at[group[0]]))
                    which.append(by[group].tolist())
            took = batch.take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), took.column("vec_id"), took.column("embedding"), pa.array(which, pa.list_(pa.int32()))], ["unit", "query_id", "query", "lists"])

    asked = rows.where(is_query).dropDuplicates(["vec_id", "embedding"])
    visiting = materialize(asked.mapInArrow(visits, f"unit int, query_id long, query {element}, lists array<int>"), "visits")
    blocks = visiting.groupBy("unit").agg(F.ceil(F.count("*") / UNIT_QUERIES).cast("int").alias("blocks"))
    places = spark.createDataFrame([(x, int(firsts[x]), int(counts[x])) for x in range(lists) if counts[x]], "list int, first int, parts int")  # one row for each list
    held = coded.join(F.broadcast(places), "list").withColumn("unit", (F.col("first") + F.pmod(F.xxhash64("embedding"), F.col("parts"))).cast("int")).drop("first", "parts")
    # Each block of a unit's queries meets the unit's vectors; blocks has one row for each of the units.
    held = held.join(F.broadcast(blocks), "unit").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    visiting = visiting.join(F.broadcast(blocks), "unit").withColumn("block", F.pmod(F.xxhash64("query_id", "query"), F.col("blocks")).cast("int")).drop("blocks")

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "same": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not vectors.num_rows:
            return empty
        queries, vectors = queries.combine_chunks(), vectors.combine_chunks()
        q64, v64 = (_matrix(t.column(c).combine_chunks(), dim, np.float64) for t, c in ((queries, "query"), (vectors, "embedding")))
        own = vectors.column("list").to_numpy()
        codes = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
        ids, query_ids = vectors.column("ids").to_pylist(), queries.column("query_id").to_pylist()
        model, lists_of, out = shared.value, queries.column("lists").to_pylist(), []
        loose = DEVIATIONS / dim**0.5 * model.errors(v64.astype(np.float32), own, codes)
        for at in range(0, len(q64), 64):
            q = q64[at : at + 64]
            tables = model.tables(q.astype(np.float32))
            scores = (model.centres @ q.T.astype(np.float32))[own]  # vectors, queries
            for m in range(codes.shape[1]):
                scores += tables[m][codes[:, m]]
            visited = np.zeros((len(model.centres), len(q)), bool)
            for j, chosen in enumerate(lists_of[at : at + 64]):
                visited[chosen, j] = True
            scores[~visited[own]] = -np.inf
            take = min(RERANK, len(own))
            best = np.argpartition(-scores, take - 1, axis=0)[:take]
            for j in range(len(q)):
                near = best[np.isfinite(scores[best[:, j], j]), j]
                exact = (v64[near] * q[j]).sum(1)
                if len(near) == take < len(own):  # more may be left, and some of them better than the best k
                    maybe = np.flatnonzero(scores[:, j] + loose * np.sqrt((q[j] ** 2).sum()) >= np.partition(exact, -k)[-k] if take >= k else np.isfinite(scores[:, j]))
                    more = np.setdiff1d(maybe, near)
                    near, exact = np.concatenate([near, more]), np.concatenate([exact, (v64[more] * q[j]).sum(1)])
                order, found = np.lexsort(([ids[n][0] for n in near], -exact)), 0
                mine, alike = query_ids[at + j], zlib.crc32(q[j].tobytes())
                rows = []
                for n in order.tolist():
                    rows += [(mine, alike, i, exact[n]) for i in ids[near[n]] if i != mine]
                    found += 1
                    if len(rows) >= k and (found == len(order) or exact[order[found]] < rows[k - 1][3]):
                        break
                rows.sort(key=lambda r: (-r[3], r[2]))
                out += rows[:k]
        if not out:
            return empty
        columns = list(zip(*out, strict=True))
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())], ["query_id", "same", "vec_id", "score"])

    met = visiting.groupBy("unit", "block").cogroup(held.groupBy("unit", "block")).applyInArrow(search, "query_id long, same long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "same").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: pd.DataFrame, queries: list[int], k: int) -> pd.DataFrame:
    """What nearest aims at, for measuring how much it finds. For small tables."""
    x = np.array(vectors["embedding"].tolist(), np.float64)
    ids, out = vectors["vec_id"].to_numpy(), []
    for q in queries:
        scores = (x * x[np.flatnonzero(ids == q)[0]]).sum(1)
        order = [n for n in np.lexsort((ids, -scores)) if ids[n] != q][:k]
        out += [(q, r + 1, ids[n], scores[n]) for r, n in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
