"""Small foreign tables: SQLite files as a source, workbooks as a sink."""

from __future__ import annotations

import sqlite3
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows that a workbook's sheet holds at most; a report is for people.
MOST_ROWS = 100_000


class _Rows(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = dict(options), columns

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", "1"))
        return [InputPartition((k, n)) for k in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        k, n = partition.value
        listed = ", ".join(f'"{c}"' for c in self.columns)
        db = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            yield from db.execute(f'SELECT {listed} FROM "{self.options["dbtable"]}" WHERE rowid % ? = ?', (n, k))
        finally:
            db.close()


class SqliteTable(DataSource):
    """``spark.read.format("sqlite_table").schema(...).option("path", f).option("dbtable", t).load()``; the
    file must lie where executors see it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        db = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            kinds = {"INTEGER": "bigint", "REAL": "double"}
            found = db.execute(f'PRAGMA table_info("{self.options["dbtable"]}")').fetchall()
            return ", ".join(f"`{name}` {kinds.get(kind.upper(), 'string')}" for _, name, kind, *_ in found)
        finally:
            db.close()

    def reader(self, schema) -> DataSourceReader:
        return _Rows(self.options, schema.fieldNames())


def _cell(at: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f'<c r="{at}"><v>{value}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each (bounded) table, made on the driver."""
    ns = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        rel = f"{ns}/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{ns}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        for k, name in enumerate(names, 1):
            df = sheets[name]
            rows = df.limit(MOST_ROWS + 1).collect()
            if len(rows) > MOST_ROWS:
                raise ValueError(f"{name} is too long for a workbook; write it as a table")
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as out:
                out.write(f'<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>'.encode())
                for i, row in enumerate([df.columns, *rows], 1):
                    out.write((f'<row r="{i}">' + "".join(_cell(f"{_letters(j)}{i}", v) for j, v in enumerate(row)) + "</row>").encode())
                out.write(b"</sheetData></worksheet>")


def read_workbook(path: str) -> dict[str, list[list[str]]]:
    """The cells of a workbook that ``write_workbook`` made, as text."""
    from xml.etree import ElementTree

    tag = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{tag}sheet")]
        out = {}
        for k, name in enumerate(names, 1):
            sheet = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml"))
            out[name] = [["".join(c.itertext()) for c in row.iter(f"{tag}c")] for row in sheet.iter(f"{tag}row")]
        return out
