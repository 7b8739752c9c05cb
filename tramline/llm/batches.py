"""Arrow batches of texts, cut to a bounded number of bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a Python worker handles at a time (one longer text is handled alone).
SLICE_BYTES = 2 << 20


#: What a Python worker keeps from task to task: one object, by how it was made.
stores: dict[tuple, object] = {}


def give_back(stored: bool = False) -> None:
    """Memory that is free within this worker goes back to the machine, as workers live on from stage to stage: what Arrow
    and the C library hold for later, and, if told so, what earlier stages' tasks have stored."""
    if stored:
        stores.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column; that of the document's row (a struct doc) where there is none of its own, so that texts are sent once."""
    return batch.column(name) if name in batch.schema.names else batch.column("doc").field(name)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named column holds about `budget` bytes in each piece.

    After each batch, memory that Arrow holds for later goes back; before the first and after the last, all that is free.
    """
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        values = column_of(batch, column)
        measure = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = measure(values).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + budget, "right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()
    give_back()


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return column_of(batch, column).cast(pa.binary()).fill_null(b"").to_pylist()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return column_of(batch, column).fill_null("").to_pylist()
