"""What several operators share: the shared scratch folder, lineage cuts and text helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.shared import cut, partitions, placed, ranges, remove, scratch, shared_dir  # noqa: F401  for the operators


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns called __0, __1 and so on, so that none clashes with those that an operator adds;
    and the new name of each."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*(f"__{i}" for i in range(len(docs.columns)))), names


def renamed(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Those columns of ``found`` that came from ``docs`` through ``plain``, by their own names."""
    return found.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)))


def ascii_lower(text: Column | str) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes that end a word under `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b <= 47 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256)
)


def word_list(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and everything beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def give_back() -> None:
    """Returns what allocators keep to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only where the C library has it
        pass


def lean(run):
    """``run``, an iterator over batches, that gives memory back to the system when it ends: workers live on, and what
    an allocator keeps in each of them would add up beside the next stage's."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def rebatched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``size`` rows, so that a batch of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def sized_batches(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts in ``column`` have about ``size`` bytes, or a single longer one."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def rows_out(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
