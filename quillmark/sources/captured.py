"""A Python data source of captured pages: one partition for each (query, page), so that a listing's pages
are fetched side by side. ``fetch`` is pluggable; offline it looks into captured files.

    spark.dataSource.register(CapturedPages)
    spark.read.format("captured").option("folder", f).option("queries", "a,b").option("pages", "3").load()
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Listing(InputPartition):
    query: str
    page: int


def from_folder(options: dict, query: str, page: int) -> str | None:
    """The captured file of a query's page, or None."""
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(options["folder"] if "://" in options["folder"] else "file://" + options["folder"])
    try:
        with where.open_input_stream(f"{at}/{query}-{page}.html") as f:
            return f.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        queries = [q for q in self.options.get("queries", "").split(",") if q]
        return [Listing(q, p) for q in queries for p in range(1, int(self.options.get("pages", "1")) + 1)]

    def _fetch(self) -> Callable[[dict, str, int], str | None]:
        """``module:function`` in the option ``fetch``, or the captured folder."""
        module, _, name = self.options.get("fetch", "").partition(":")
        return getattr(importlib.import_module(module), name) if name else from_folder

    def read(self, partition: Listing) -> Iterator[tuple]:
        try:
            html, error = self._fetch()(self.options, partition.query, partition.page), None
        except Exception as failure:  # a source that fails is a row, not a failed job
            html, error = None, f"{type(failure).__name__}: {failure}"
        if html is not None or error is not None:
            yield partition.query, partition.page, html, error


class CapturedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return "query string, page int, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
