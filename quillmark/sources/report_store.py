"""Reports with several sheets, written as one: a data source whose tasks put files aside and whose driver puts up one
manifest, so that readers see the old report or the new one and nothing between.

    spark.dataSource.register(Report)
    cells.write.format("report").mode("overwrite").save(path)     # (sheet, part, key, cells)
    spark.read.format("report").load(path)

A file holds a part of a sheet and is called by its content, so parts that didn't change are not written again, and the
manifest of a report names files of earlier ones. A write that fails puts up no manifest. Paths must be such that Arrow's
file systems reach them.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "sheet string, part int, key string, cells map<string,string>"
_ARROW = pa.schema([("sheet", pa.string()), ("part", pa.int32()), ("key", pa.string()), ("cells", pa.map_(pa.string(), pa.string()))])


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _manifests(path: str) -> dict[int, str]:
    from pyarrow import fs

    where, at = _place(path)
    found = where.get_file_info(fs.FileSelector(f"{at}/manifests", allow_not_found=True))
    return {int(f.base_name): f.path for f in found if f.base_name.isdigit()}


def manifest(path: str, version: int | None = None) -> dict:
    """What is in the report: its version and its files, each with sheet, part, name and rows; empty before the first."""
    known = _manifests(path)
    if not known:
        return {"version": 0, "files": []}
    with _place(path)[0].open_input_stream(known[max(known) if version is None else version]) as f:
        return json.loads(f.read())


@dataclass
class _Staged(WriterCommitMessage):
    files: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _stage(self, sheet: str, part: int, rows: list[dict]) -> dict:
        where, at = _place(self.path)
        rows = sorted(rows, key=lambda r: (r["key"] or "", json.dumps(r["cells"], sort_keys=True)))
        content = json.dumps([[r["key"], sorted(r["cells"] or [])] for r in rows], ensure_ascii=False).encode()
        name = hashlib.sha256(json.dumps([sheet, part]).encode() + content).hexdigest()
        found = {"sheet": sheet, "part": part, "name": name, "rows": len(rows), "new": False}
        if where.get_file_info(f"{at}/files/{name}").type.name != "File":
            out = io.BytesIO()
            pq.write_table(pa.Table.from_pylist([{**r, "cells": sorted(r["cells"] or [])} for r in rows], _ARROW), out)
            where.create_dir(f"{at}/files", recursive=True)
            aside = f"{at}/files/.{uuid.uuid4().hex}"
            with where.open_output_stream(aside) as f:
                f.write(out.getvalue())
            where.move(aside, f"{at}/files/{name}")  # whole or not there; a task that runs twice makes the same file
            found["new"] = True
        return found

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, held, last = [], [], None
        for batch in iterator:
            for row in batch.to_pylist():
                group = row["sheet"], row["part"]
                if group != last and held:
                    files.append(self._stage(*last, held))
                    held = []
                last = group
                held.append(row)
        if held:
            files.append(self._stage(*last, held))
        return _Staged(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, at = _place(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["sheet"], f["part"]))
        version = max(_manifests(self.path), default=0) + 1
        where.create_dir(f"{at}/manifests", recursive=True)
        aside = f"{at}/manifests/.{uuid.uuid4().hex}"
        with where.open_output_stream(aside) as f:
            f.write(json.dumps({"version": version, "files": files}).encode())
        where.move(aside, f"{at}/manifests/{version:08d}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        pass  # without a manifest nobody sees what was put aside, and the next write may use it


@dataclass
class _Part(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, version: int | None):
        self.path, self.version = path, version

    def partitions(self) -> list[InputPartition]:
        return [_Part(f["name"]) for f in manifest(self.path, self.version)["files"]] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.name:
            where, at = _place(self.path)
            with where.open_input_file(f"{at}/files/{partition.name}") as f:
                yield from pq.read_table(f).cast(_ARROW).to_batches()


class Report(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options["version"]) if "version" in self.options else None)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def cells(rows: DataFrame, sheet: Column, key: str, parts: int = 16) -> DataFrame:
    """``rows`` as cells of a sheet each: the parts of a sheet are dealt by key, so a changed row touches one part."""
    values = F.create_map(*(x for c in rows.columns if c != "__key" for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))))
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return rows.select(sheet.cast("string").alias("sheet"), F.pmod(F.xxhash64(name), F.lit(parts)).cast("int").alias("part"), name.alias("key"), values.alias("cells"))


def write(report: DataFrame, path: str) -> dict[str, int]:
    """Writes all sheets of ``report`` (of what ``cells`` makes) in one commit and returns how many rows each has, as they
    were seen on their way."""
    names = [r.sheet for r in report.select("sheet").distinct().orderBy("sheet").collect()]  # sheets are few
    seen = Observation()
    counted = report.observe(seen, *(F.count_if(F.col("sheet") == n).alias(f"s{k}") for k, n in enumerate(names)), F.count(F.lit(1)).alias("all"))
    counted.repartition("sheet", "part").sortWithinPartitions("sheet", "part").write.format("report").mode("overwrite").option("path", path).save()
    found = seen.get
    return {n: found[f"s{k}"] for k, n in enumerate(names)}
