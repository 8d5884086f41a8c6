"""Rows that a callback completes, so many at a time: for calls that wait, not for work."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import nullcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Calls in flight in a task, and to one host.
IN_FLIGHT, A_HOST = 30, 6


def enriched(rows: DataFrame, complete: Callable[[dict], dict], columns: list[str], in_flight: int = IN_FLIGHT, host: Column | None = None, a_host: int = A_HOST, wanted: Column | None = None) -> DataFrame:
    """``rows`` with the values that ``complete`` gives for some of their ``columns``, and a last column with the error,
    whatever the others are called.

    ``complete`` takes a row as a dict and returns the values to be changed. In each task at most ``in_flight`` calls run at
    a time, and at most ``a_host`` of one ``host``; with a host, rows are dealt by it, so that the bound holds for the whole
    job, and a host's rows are split over no tasks. Rows keep their order within a task and don't wait for those behind
    them. A row whose call fails, or that isn't ``wanted``, goes through unchanged; the error says why. A task that
    runs again calls again, so ``complete`` must bear that."""
    names = rows.columns
    kinds = rows.schema
    told = rows.select(*(F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(names)), (host if host is not None else F.lit("")).cast("string").alias("__host"), (wanted if wanted is not None else F.lit(True)).cast("boolean").alias("__wanted"))
    dealt = told.repartition("__host") if host is not None else told
    at, gated = {c: k for k, c in enumerate(names)}, host is not None
    ddl = ", ".join([*(f"`__{k}` {f.dataType.simpleString()}" for k, f in enumerate(kinds)), "__error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gates: dict[str, threading.Semaphore] = {}

        def call(row: dict, key: str) -> tuple[dict, str | None]:
            with gates[key] if gated else nullcontext():
                try:
                    return {c: v for c, v in complete(dict(row)).items() if c in columns}, None
                except Exception as e:  # whatever a callback raises is its row's own failure
                    return {}, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                values = [batch.column(k).to_pylist() for k in range(len(names))]
                hosts, want = (batch.column(len(names) + k).to_pylist() for k in range(2))
                under_way: deque[tuple[int, Future]] = deque()
                found: list[tuple[dict, str | None]] = [({}, None)] * batch.num_rows
                for k in range(batch.num_rows):
                    if want[k]:
                        gates.setdefault(hosts[k] or "", threading.Semaphore(a_host))
                        if len(under_way) >= 4 * in_flight:  # no more than these are held
                            j, first = under_way.popleft()
                            found[j] = first.result()
                        under_way.append((k, pool.submit(call, {c: values[i][k] for c, i in at.items()}, hosts[k] or "")))
                for j, left in under_way:
                    found[j] = left.result()
                out = []
                for c, k in at.items():
                    column = batch.column(k)
                    if c in columns and any(c in new for new, _ in found):
                        column = pa.array([new.get(c, values[k][j]) for j, (new, _) in enumerate(found)], column.type)
                    out.append(column)
                yield pa.RecordBatch.from_arrays([*out, pa.array([e for _, e in found], pa.string())], names=[*(f"__{k}" for k in range(len(names))), "__error"])

    return dealt.mapInArrow(run, ddl).toDF(*names, "error")
