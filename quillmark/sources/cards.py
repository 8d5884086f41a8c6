"""Listing pages: repeated cards or table rows, each with a link, as rows of a table function."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql.functions import udtf

INLINE = frozenset("a b i u em strong span small sup sub mark code font".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Cards(HTMLParser):
    """Collects elements that fit a selector (``tag``, ``.class`` or ``tag.class``): title, link and text."""

    def __init__(self, selector: str):
        super().__init__(convert_charrefs=True)
        self.tag, _, self.kind = selector.partition(".")
        self.depth, self.found, self.card, self.link = 0, [], None, None

    def _fits(self, tag: str, attrs: dict) -> bool:
        return (not self.tag or tag == self.tag) and (not self.kind or self.kind in (attrs.get("class") or "").split())

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.card is None and self._fits(tag, a):
            self.card, self.depth = {"href": None, "title": [], "text": []}, 0
        if self.card is not None:
            if tag not in INLINE:
                self.card["text"].append(" ")
            self.depth += tag not in VOID
            if tag == "a" and a.get("href") and self.card["href"] is None:
                self.card["href"], self.link = a["href"], self.depth

    def handle_data(self, data):
        if self.card is not None:
            self.card["text"].append(data)
            if self.link is not None:
                self.card["title"].append(data)

    def handle_endtag(self, tag):
        if self.card is None or tag in VOID:
            return
        if self.link is not None and self.depth <= self.link:
            self.link = None
        if tag not in INLINE:
            self.card["text"].append(" ")
        self.depth -= 1
        if self.depth <= 0:
            self.found.append(self.card)
            self.card = self.link = None


def cards(html: str | None, selectors: str) -> Iterator[tuple[str | None, str, str]]:
    """(href, title, text) of each card; of several selectors, separated by ``|``, the first that finds any."""
    for selector in selectors.split("|"):
        parser = Cards(selector.strip())
        parser.feed(html or "")
        parser.close()
        if parser.found:
            for c in parser.found:
                yield c["href"], " ".join("".join(c["title"]).split()), " ".join("".join(c["text"]).split())
            return


@udtf(returnType="href: string, title: string, text: string")
class parse_cards:
    def eval(self, html: str, selectors: str):
        yield from cards(html, selectors)
