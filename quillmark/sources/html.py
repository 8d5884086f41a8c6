"""Captured pages as records: title, metadata, links and label/value pairs, by the standard parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import html_to_text


class Page(HTMLParser):
    """Collects the title, <meta> values, links with their texts, and pairs of <th>/<td> or <dt>/<dd>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.links, self.pairs = "", {}, [], {}
        self.stack: list[tuple[str, list[str]]] = []
        self.label, self.href = None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("name") or a.get("property")):
            self.meta[a.get("name") or a.get("property")] = a.get("content") or ""
        if tag in ("title", "a", "th", "td", "dt", "dd"):
            self.stack.append((tag, []))
        if tag == "a":
            self.href = a.get("href")

    def handle_data(self, data):
        for _, parts in self.stack:
            parts.append(data)

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            top, parts = self.stack.pop()
            text = " ".join("".join(parts).split())
            if top == "title" and not self.title:
                self.title = text
            elif top == "a" and self.href:
                self.links.append((self.href, text))
            elif top in ("th", "dt"):
                self.label = text.rstrip(":：").strip()
            elif top in ("td", "dd") and self.label:
                self.pairs.setdefault(self.label, text)
                self.label = None
            if top == tag:
                return


def parse(html: str | None) -> Page:
    page = Page()
    if html:
        page.feed(html)
        page.close()
    return page


#: Pages that are parsed before their records go back, so that what a worker holds doesn't grow with a batch.
SLICE = 256


def records(pages: DataFrame) -> DataFrame:
    kinds = dict(pages.dtypes)
    schema = pa.schema([("title", pa.string()), ("n_links", pa.int32()), ("pairs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: list[list] = [[], [], [], []]
            for html in batch.column("html").to_pylist():
                page = parse(html)
                for column, v in zip(out, (page.title, len(page.links), list(page.pairs.items()), html_to_text(html))):
                    column.append(v)
            arrays = [pa.array(v, f.type) for v, f in zip(out, schema)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *arrays], names=["page_id", "url", *schema.names])

    found = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, title string, n_links int, pairs map<string,string>, text string")
    return found.select("page_id", "url", "title", "n_links", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("pairs")))).alias("pairs"), "text")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href, label) of every link, resolved against its page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at, hrefs, labels = [], [], []
            for k, (html, url) in enumerate(zip(batch.column("html").to_pylist(), batch.column("url").to_pylist())):
                for href, label in parse(html).links:
                    at.append(k)
                    hrefs.append(urljoin(url or "", href))
                    labels.append(label)
            ids = batch.column("page_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hrefs, pa.string()), pa.array(labels, pa.string())], names=["page_id", "href", "label"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, href string, label string")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
