"""Fetching with retries, backoff and a rate limit for each host, as a DataFrame operator over requests.

What really goes out is a ``transport``: a function of (url, headers) that returns (status, body). So captured answers
serve as well as a network. Requests of one host go to one task, which spaces them; hosts run side by side.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import url_host
from quillmark.streaming.jobs import Circuit

Transport = Callable[[str, dict], tuple[int, str]]
# Answers that are worth another try, and how often.
RETRY = frozenset({429, 500, 502, 503, 504})
RETRIES, BACKOFF = 3, 1.0
AGENTS = ("Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7)")


@dataclass
class Fetcher:
    """Fetches urls one after another. Time is given by ``clock`` and ``sleep``, so that tests need not wait."""

    transport: Transport
    pause: float = 1.0
    retries: int = RETRIES
    backoff: float = BACKOFF
    limit: int = 5
    cooldown: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: dict[str, float] = field(default_factory=dict)
    circuits: dict[str, Circuit] = field(default_factory=dict)
    count: int = 0

    def _wait(self, host: str) -> None:
        now = self.clock()
        if host in self.last and (left := self.last[host] + self.pause - now) > 0:
            self.sleep(left)
        self.last[host] = self.clock()

    def get(self, url: str) -> tuple[int | None, str | None, str | None, int]:
        """(status, body, error, tries). After a failure that may pass the wait doubles, with a little chance in it;
        a host that keeps failing is left alone until its circuit allows a call again."""
        host = urlsplit(url).hostname or ""
        circuit = self.circuits.setdefault(host, Circuit(self.limit, self.cooldown))
        if not circuit.allows(self.clock()):
            return None, None, "circuit open", 0
        status, error = None, None
        for k in range(self.retries + 1):
            if k:
                self.sleep(self.backoff * 2 ** (k - 1) * (1 + 0.1 * random.Random(f"{url} {k}").random()))
            self._wait(host)
            self.count += 1
            try:
                status, body = self.transport(url, {"User-Agent": AGENTS[self.count % len(AGENTS)]})
                error = None if status < 400 else f"status {status}"
            except Exception as e:  # a transport may fail in any way; the request's row says how
                status, body, error = None, None, f"{type(e).__name__}: {e}"
            if error is None:
                circuit.told(True, self.clock())
                return status, body, None, k + 1
            if status is not None and status not in RETRY:
                break
        circuit.told(False, self.clock())
        return status, None, error, k + 1


def fetched(requests: DataFrame, transport: Transport, url: str = "url", hosts: int | None = None, **settings) -> DataFrame:
    """``requests`` with status, body, error and tries of each. A failing request is a row with an error, not a
    failing job; a task that is run again asks again."""
    keyed = requests.withColumn("__host", url_host(url))
    dealt = keyed.repartition(hosts, "__host") if hosts else keyed.repartition("__host")
    schema = requests.withColumns({"status": F.lit(None).cast("int"), "body": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "tries": F.lit(None).cast("int")}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = Fetcher(transport, **settings)
        for batch in batches:
            found = [fetcher.get(u) if u else (None, None, "no url", 0) for u in batch[url]]
            out = batch.drop(columns="__host")
            for k, name in enumerate(("status", "body", "error", "tries")):
                out[name] = pd.Series([f[k] for f in found], index=out.index, dtype="Int32" if name in ("status", "tries") else object)
            yield out

    return dealt.mapInPandas(run, schema)


def pages(base: str, first: int, last: int, step: int = 1) -> list[str]:
    """The urls of a paginated list: ``base`` with {page} replaced."""
    return [base.format(page=k) for k in range(first, last + 1, step)]


def id_batches(ids: DataFrame, column: str, size: int = 50) -> DataFrame:
    """(batch, ids): identifiers in groups of at most ``size``, for interfaces that take several at once. Ids are
    numbered within ranges, so no task sees them all."""
    from pyspark.sql import Window

    distinct = ids.select(F.col(column).alias("id")).where("id is not null").distinct()
    dealt = distinct.repartitionByRange("id").withColumn("part", F.spark_partition_id())
    place = F.floor((F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1) / size)
    return dealt.withColumn("k", place).groupBy("part", "k").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.concat_ws("-", "part", "k").alias("batch"), "ids")
