"""Pages as a table of their nodes, and blocks of pages by joins and aggregates on it.

One parse gives a row for each element and each text, numbered in the order of the page, with the number of the last
node inside it. So "inside" is an interval, "next to" a place among the children of a parent, and a block's text what its
interval holds; selectors, pairs of labels and values, links and descriptions are joins within a page.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "noscript", "template"))
#: What a start tag ends: a list item the one before it, a cell the cell before it, and so on.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_ENDS |= {tag: {"p"} for tag in ("div", "ul", "ol", "dl", "table", "section", "article", "h1", "h2", "h3", "h4", "form", "footer", "header", "main", "nav")}
_SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul".split())


class _Tree(HTMLParser):
    """Elements and texts as [node, parent, last, place, tag, attributes, text, block]; the root is node 0."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = [[0, None, 0, 0, "#page", {}, None, 0]]
        self.open, self.children = [0], [0]
        self.block = 0

    def _add(self, tag: str, attributes: dict, text: str | None) -> int:
        self.rows.append([len(self.rows), self.open[-1], len(self.rows), self.children[-1], tag, attributes, text, self.block])
        self.children[-1] += 1
        return len(self.rows) - 1

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            self.children.pop()
            self.rows[node][2] = len(self.rows) - 1
            self.block += self.rows[node][4] in _BLOCKS

    def handle_starttag(self, tag, attrs):
        if ends := _ENDS.get(tag):
            scope = _SCOPES.get(tag, _BLOCKS - {"p"})
            for depth in range(len(self.open) - 1, 0, -1):
                name = self.rows[self.open[depth]][4]
                if name in ends:
                    self._close(depth)
                    break
                if name in scope:
                    break
        self.block += tag in _BLOCKS
        node = self._add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in _VOID:
            self.open.append(node)
            self.children.append(0)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.rows[self.open[depth]][4] == tag:
                self._close(depth)
                return
        self.block += tag in _BLOCKS

    def handle_data(self, data):
        if not (self.rows[self.open[-1]][4] in _SILENT) and (text := " ".join(data.split())):
            self._add("#text", {}, text)

    def done(self) -> list[list]:
        self._close(0)
        return self.rows


NODE = "node int, parent int, last int, place int, tag string, classes array<string>, name string, attributes map<string,string>, text string, block int"


def nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, and the columns of ``NODE``): every element and text of each page: its number, its parent's and the
    last one inside it; its place among its parent's children; tag, classes, id and attributes; of a text ("#text") what
    it says, and the block it stands in (texts of one block are a line on the screen). Scripts and styles say nothing. A
    null page has no nodes, an empty one its root. ``key`` names a page."""
    kind = pages.schema[key].dataType.simpleString()
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32()]
    names = [c.split()[0] for c in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                of, out = [], [[] for _ in types]
                for k, page in enumerate(batch.column(1).slice(at, 64)):
                    if not page.is_valid:
                        continue
                    tree = _Tree()
                    tree.feed(page.as_py())
                    tree.close()
                    for node, parent, last, place, tag, attributes, text, block in tree.done():
                        of.append(at + k)
                        row = (node, parent, last, place, tag, attributes.get("class", "").split(), attributes.get("id"), list(attributes.items()), text, block)
                        for column, v in zip(out, row):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(v, t) for v, t in zip(out, types))], names=[key, *names])

    return pages.select(key, F.col(html).cast("string").alias("__h")).mapInArrow(run, f"`{key}` {kind}, {NODE}")


def having(tag: str | None = None, cls: str | None = None, name: str | None = None) -> Column:
    """One step of a selector: a tag, a class, an id."""
    out = F.substring("tag", 1, 1) != "#"
    out = out & (F.col("tag") == tag) if tag else out
    out = out & F.array_contains("classes", cls) if cls else out
    return out & (F.col("name") == name) if name else out


def selected(table: DataFrame, key: str, *steps: Column) -> DataFrame:
    """The nodes that the last step fits, inside of one that the step before fits, and so on."""
    found = table.where(steps[0])
    for step in steps[1:]:
        outer = found.select(F.col(key).alias("__k"), F.col("node").alias("__a"), F.col("last").alias("__z"))
        inside = (F.col(key) == F.col("__k")) & (F.col("node") > F.col("__a")) & (F.col("node") <= F.col("__z"))
        found = table.where(step).join(outer, inside, "left_semi")
    return found


def texts(table: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, node, text): what the ``found`` nodes say, a line for each block."""
    words = table.where("tag = '#text'").select(F.col(key).alias("__k"), F.col("node").alias("__n"), "text", F.col("block").alias("__b"))
    inside = (F.col(key) == F.col("__k")) & (F.col("__n") > F.col("node")) & (F.col("__n") <= F.col("last"))
    lines = found.select(key, "node", "last").join(words, inside).groupBy(key, "node", "__b").agg(F.sort_array(F.collect_list(F.struct("__n", "text"))).alias("x"))
    line = F.struct("__b", F.array_join(F.transform("x", lambda w: w.text), " ").alias("line"))
    return lines.groupBy(key, "node").agg(F.sort_array(F.collect_list(line)).alias("x")).select(key, "node", F.array_join(F.transform("x", lambda l: l.line), "\n").alias("text"))


def pairs(table: DataFrame, key: str) -> DataFrame:
    """(key, node, label, value, kind): a <dt> or <th> with the next <dd> or <td> beside it ('cell'), and a line that ends
    with a colon, or has one within it, with the rest of that line or the line after it ('line'). ``node`` tells the
    order; a label without a value is left out."""
    cells = table.where("tag in ('dt', 'dd', 'th', 'td')")
    said = cells.drop("text").join(texts(table, key, cells), [key, "node"])
    beside = Window.partitionBy(key, "parent").orderBy("place")
    following = F.lead(F.struct("tag", "text")).over(beside)
    told = said.select(key, "node", "tag", "text", following.alias("x")).where("(tag = 'dt' and x.tag = 'dd') or (tag = 'th' and x.tag = 'td')")
    cell = told.select(key, "node", F.regexp_replace("text", r"\s*[:：]\s*$", "").alias("label"), F.col("x.text").alias("value"), F.lit("cell").alias("kind"))
    words = table.where("tag = '#text'").groupBy(key, "block").agg(F.min("node").alias("node"), F.sort_array(F.collect_list(F.struct("node", "text"))).alias("x"))
    lines = words.select(key, "node", F.array_join(F.transform("x", lambda w: w.text), " ").alias("line"))
    after = F.lead("line").over(Window.partitionBy(key).orderBy("node"))
    split = lines.select(key, "node", F.regexp_extract("line", r"^([^:：]{2,40}?)\s*[:：]", 1).alias("label"), F.regexp_extract("line", r"^[^:：]{2,40}?\s*[:：](?!//)\s*(.*)$", 1).alias("rest"), F.col("line").rlike(r"^[^:：]{2,40}?\s*[:：]\s*$").alias("open"), after.alias("after"))
    line = split.where("label <> '' and (open or rest <> '')").select(key, "node", "label", F.when(F.col("open"), F.col("after")).otherwise(F.col("rest")).alias("value"), F.lit("line").alias("kind"))
    return cell.unionByName(line).where("label <> '' and value is not null and value <> ''")


def targets(table: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, node, target, how): where each of the ``found`` nodes leads: the first link inside it ('link'), else the
    first address or path in quotes in what a click runs ('onclick'), else the first form's action ('form')."""
    click = F.regexp_extract(F.col("attributes")["onclick"], r"""['"]((?:https?://|/|\./|\?)[^'"]+)['"]""", 1)
    href = F.col("attributes")["href"]
    good = F.when((F.col("tag") == "a") & ~F.coalesce(href, F.lit("")).rlike(r"^(?:\s*$|#|javascript:)"), F.struct(F.lit(0).alias("rank"), F.col("node").alias("n"), href.alias("to")))
    good = good.when(F.coalesce(click, F.lit("")) != "", F.struct(F.lit(1).alias("rank"), F.col("node").alias("n"), click.alias("to")))
    good = good.when((F.col("tag") == "form") & (F.coalesce(F.col("attributes")["action"], F.lit("")) != ""), F.struct(F.lit(2).alias("rank"), F.col("node").alias("n"), F.col("attributes")["action"].alias("to")))
    leads = table.select(F.col(key).alias("__k"), good.alias("x")).where("x is not null")
    inside = (F.col(key) == F.col("__k")) & (F.col("x.n") >= F.col("node")) & (F.col("x.n") <= F.col("last"))
    best = found.select(key, "node", "last").join(leads, inside).groupBy(key, "node").agg(F.min("x").alias("x"))
    return best.select(key, "node", F.col("x.to").alias("target"), F.element_at(F.array(*map(F.lit, ("link", "onclick", "form"))), F.col("x.rank") + 1).alias("how"))


#: Classes and ids of the parts of a page that describe the post.
DESCRIPTIONS = ("job-description", "description", "job-detail", "view_content", "board_view", "content-body")
LEAST, MOST = 200, 15_000


def descriptions(table: DataFrame, key: str, known: tuple[str, ...] = DESCRIPTIONS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(key, text, how): the description on each page, by the first of four ways that has at least ``least`` characters:
    a part of a known class or id ('known'), the page's <article> or <main> ('main'), the table that says most
    ('table'), the smallest block that has nine tenths of what the page's largest one says ('block'). Of several the
    longest, then the first; texts end at ``most`` characters."""
    names = F.array(*map(F.lit, known))
    how = F.when(F.arrays_overlap("classes", names) | F.array_contains(names, F.coalesce("name", F.lit(""))), 0).when(F.col("tag").isin("article", "main"), 1).when(F.col("tag") == "table", 2).when(F.col("tag").isin("div", "section", "td", "body"), 3)
    blocks = table.withColumn("how", how).where("how is not null")
    sized = table.where("tag = '#text'").select(F.col(key).alias("__k"), F.col("node").alias("__n"), F.length("text").alias("size"))
    inside = (F.col(key) == F.col("__k")) & (F.col("__n") > F.col("node")) & (F.col("__n") <= F.col("last"))
    weighed = blocks.join(sized, inside).groupBy(key, "node", "last", "how").agg(F.sum("size").alias("size")).where(F.col("size") >= least)
    largest = weighed.where("how = 3").groupBy(F.col(key).alias("__k")).agg(F.max("size").alias("top"))
    told = weighed.join(largest, F.col(key) == F.col("__k"), "left")
    worth = F.when(F.col("how") < 3, -F.col("size")).when(F.col("size") >= 0.9 * F.col("top"), F.col("size"))
    best = told.where(worth.isNotNull()).groupBy(key).agg(F.min_by(F.struct("node", "last", "how"), F.struct("how", worth.alias("worth"), "node")).alias("x")).select(key, "x.*")
    said = texts(table, key, best).join(best.select(key, "node", "how"), [key, "node"])
    return said.select(key, F.substring("text", 1, most).alias("text"), F.element_at(F.array(*map(F.lit, ("known", "main", "table", "block"))), F.col("how") + 1).alias("how"))
