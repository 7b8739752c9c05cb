"""Exact deduplication with a split for heavy hitters, in DataFrame operations only.

Misra-Gries counters of digests as text (Spark's freqItems keeps at most 1/support of them, merged over partitions) find every digest that
may be in over support of the rows. Their exact counts verify them; the winners, at most 1/support rows, are broadcast,
and their groups are resolved where the rows lie. No digest of the rest has more than support of the rows, so these are
shuffled as usual: pre-aggregated by digest, then joined back.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays (null ids are
smallest), and of rows that agree in both, one; an empty table gives no rows; other columns are ignored (dedup) or kept
(drop_exact_copies), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.session import materialize

#: Share of the rows above which a digest counts as heavy; also bounds the broadcast to 1/SUPPORT rows.
SUPPORT = 0.001


def heavy_digests(rows: DataFrame, total: int, support: float = SUPPORT) -> DataFrame:
    """digest, keep and n of the digests in over support of the rows. rows: digest and keep, a sortable struct."""
    counters = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    exact = rows.join(F.broadcast(counters), "digest").groupBy("digest").agg(F.max("keep").alias("keep"), F.count("*").alias("n"))
    return materialize(exact.where(F.col("n") > support * total), "heavy-digests")


def decided(rows: DataFrame, support: float) -> DataFrame:
    """rows with keep (the own of the row that stays) and n (rows of the digest). rows: digest, own (id and row)."""
    heavy = F.broadcast(heavy_digests(rows.select("digest", F.col("own").alias("keep")), rows.count(), support))
    rest = rows.join(heavy, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("own").alias("keep"), F.count("*").alias("n"))
    return rows.join(heavy, "digest").unionByName(rest.join(groups, "digest"))


def _digests(doc_id: Column, text: Column, row: Column) -> list[Column]:
    return [F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"), F.struct(doc_id.cast("long").alias("id"), row.alias("row")).alias("own")]


def dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row."""
    rows = materialize(docs.select(*_digests(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id())), "digests")
    return decided(rows, support).select(
        F.col("own.id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("own.row") == F.col("keep.row")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay. Rows are numbered and written; digests and numbers alone are shuffled, and the numbers
    of the rows that go are written, so that Spark knows their size when it picks the join that takes them out."""
    numbered = materialize(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    rows = materialize(numbered.select(*_digests(F.col("doc.doc_id"), F.col("doc.text"), F.col("row"))), "digests")
    gone = materialize(decided(rows, support).where("own.row <> keep.row").select("own.row"), "copies")
    return numbered.join(gone, "row", "left_anti").select("doc.*")


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
