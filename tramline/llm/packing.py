"""Packing of documents into training sequences: first-fit decreasing with a tournament tree, in random groups.

Rows are dealt by a generator, seeded for each partition of the input, into groups of about group_bytes of text, which bounds what
a task holds, however many rows share an id or source. In a group, each document gives full sequences as long as it
lasts; what remains of it is packed, longest first, into the first open sequence with room, which a tournament tree of
the sequences' room finds in logarithmic time. The sequences left least full are then cut up to fill the others, and
the last one is cut into powers of two, which need no padding.

Defined results: a null text is empty (its end id alone); rows with equal or null ids are packed each; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.batches import slices
from tramline.llm.tokens import WordEncoder, kept

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """A tournament of open sequences: each node holds the most room below it."""

    def __init__(self, leaves: int, room: int):
        self.width = 1 << max(0, (leaves - 1).bit_length())
        self.most = [room] * (2 * self.width)

    def take(self, size: int) -> int:
        """The first sequence with room for size, which then has that much less."""
        most, node = self.most, 1
        while node < self.width:
            node *= 2
            node += most[node] < size
        found = node - self.width
        most[node] -= size
        while node > 1:
            node //= 2
            most[node] = max(most[2 * node], most[2 * node + 1])
        return found


def first_fit(rests: list[tuple[int, int]], room: int) -> list[list[int]]:
    """Which of the rests (size, document), in their order, lie in each sequence: each in the first with room for it."""
    tree, open_ = RoomTree(max(1, len(rests)), room), []
    for n, d in rests:
        k = tree.take(n)
        if k == len(open_):
            open_.append([])
        open_[k].append(d)
    return open_


def pack(sizes: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold all ids of documents of these sizes."""
    full = [[(d, at, room)] for d, n in enumerate(sizes) for at in range(0, n - room + 1, room)]
    rests = sorted(((n % room, d) for d, n in enumerate(sizes) if n % room), key=lambda x: (-x[0], x[1]))
    placed = [[(d, sizes[d] - sizes[d] % room, sizes[d] % room) for d in s] for s in first_fit(rests, room)]
    return full + _filled(placed, room)


def _filled(open_: list[list[tuple[int, int, int]]], room: int) -> list[list[tuple[int, int, int]]]:
    """Cut up the least full sequences to fill the others; cut the last one into powers of two."""
    used = [sum(p[2] for p in s) for s in open_]
    order = sorted(range(len(open_)), key=lambda k: (-used[k], k))
    done, lo, hi = [], 0, len(order) - 1
    while lo < hi:
        target, gap = open_[order[lo]], room - used[order[lo]]
        while gap and lo < hi:
            source = open_[order[hi]]
            if not source:
                hi -= 1
                continue
            d, start, n = source.pop()
            part = min(n, gap)
            target.append((d, start + n - part, part))
            if n > part:
                source.append((d, start, n - part))
            gap -= part
        if gap:  # it is the last one
            break
        done.append(target)
        lo += 1
    last = [p for k in order[lo : hi + 1] for p in open_[k]]
    return done + _powers(last, room)


def _powers(pieces: list[tuple[int, int, int]], room: int) -> list[list[tuple[int, int, int]]]:
    total, sequences = sum(p[2] for p in pieces), []
    pieces = pieces[::-1]
    while total:
        gap = min(room, 1 << (total.bit_length() - 1))
        total -= gap
        sequences.append([])
        while gap:
            d, start, n = pieces.pop()
            part = min(n, gap)
            sequences[-1].append((d, start, part))
            if n > part:
                pieces.append((d, start + part, n - part))
            gap -= part
    return sequences


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = 2048, group_bytes: int = 4 << 20, seed: int = 42) -> DataFrame:
    """The pieces of all documents: where each starts in its document, and its sequence and place there."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(WordEncoder, tokenizer, False)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in slices(batches):
            ids, offsets = encoder.encode(batch.column("text"), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            dealt = pa.array(rng.integers(0, groups, batch.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([dealt, batch.column("doc_id"), lists], ["group", "doc_id", "ids"])

    def packed(group: pa.Table) -> pa.Table:
        number, doc_ids = group.column("group")[0].as_py(), group.column("doc_id").to_pylist()
        lists = group.column("ids").combine_chunks()
        offsets, data = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sizes = np.diff(offsets).tolist()
        # The order within a group must not depend on the order in which a shuffle brings its rows.
        order = sorted(range(len(sizes)), key=lambda d: (doc_ids[d] is not None, doc_ids[d] or 0, sizes[d], zlib.crc32(data[offsets[d] : offsets[d + 1]].data)))
        rows = []
        for k, sequence in enumerate(pack([sizes[d] for d in order], room)):
            at = 0
            for d, start, n in sequence:
                d, begin = order[d], int(offsets[order[d]]) + start
                rows.append((doc_ids[d], start, n, zlib.crc32(data[begin : begin + n].data), sizes[d], (number << 32) + k, at))
                at += n
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return docs.mapInArrow(encode, "group long, doc_id long, ids array<int>").groupBy("group").applyInArrow(packed, PIECES)
