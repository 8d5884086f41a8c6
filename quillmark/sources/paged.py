"""Paged interfaces as streams: answers come a request at a time, each with the token that asks for the next.

    spark.dataSource.register(PagedInterface)
    spark.readStream.format("paged").option("fetch", "module:function").option("queries", "a,b").load()

``fetch`` takes (options, query, token) and returns (items, next token), items as JSON strings; no token asks for the first
page, and none comes with the last. An offset names the next request, a query and its token; so what is read between two
offsets can be read again, and a stream that is started anew goes on where its checkpoint has it. A micro-batch
holds ``requests`` answers; interfaces that allow a call every few seconds fill no more.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def from_folder(options: dict, query: str, token: str | None) -> tuple[list[str], str | None]:
    """A captured answer: ``folder``/query-token.json (token 0 first) with "items" and "next"."""
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(options["folder"] if "://" in options["folder"] else "file://" + options["folder"])
    with where.open_input_stream(f"{at}/{query}-{token or 0}.json") as f:
        answer = json.loads(f.read())
    return [json.dumps(x) for x in answer["items"]], answer.get("next")


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.queries = [q for q in options.get("queries", "").split(",") if q]
        module, _, name = options.get("fetch", "").partition(":")
        self.fetch: Callable = getattr(importlib.import_module(module), name) if name else from_folder

    def initialOffset(self) -> dict:
        return {"query": 0, "token": None}

    def _page(self, at: dict) -> tuple[list[tuple], dict]:
        query = self.queries[at["query"]]
        items, token = self.fetch(self.options, query, at["token"])
        following = {"query": at["query"], "token": token} if token else {"query": at["query"] + 1, "token": None}
        return [(query, at["token"] or "", k, x) for k, x in enumerate(items)], following

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start
        for _ in range(int(self.options.get("requests", "1"))):
            if at["query"] >= len(self.queries):
                break
            page, at = self._page(at)
            rows += page
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while at != end and at["query"] < len(self.queries):
            page, at = self._page(at)
            yield from page

    def commit(self, end: dict) -> None:
        pass  # the checkpoint has it; captured answers aren't used up


class PagedInterface(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "query string, token string, place int, item string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)
