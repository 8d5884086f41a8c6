"""URL filter over a sorted digest array.

Rules are strings of a host and a path prefix with a verdict. Their 64-bit xxhash keys lie sorted in a
file, followed by the places of the full strings, the verdicts and the strings. Workers map the file into
memory. A url's candidates are every suffix of its host, cut at dots, with every prefix of its path that has
the length of some rule's path; all candidates of a batch are probed by one vectorised binary search,
and a hit counts only if the stored string equals the candidate. The longest rule wins; without one the verdict
is the list's default.

The file is written to the shared folder and handed to the executors by Spark, so it need not be on a disk
that they share. It is built on the driver, where the rules are; each ``PART`` of them have a file of their own.

Defined results: a null url, or one without ``://``, has an empty host and path and the default verdict;
repeated rows are judged one by one; an empty table gives an empty table; of a rule given twice the last
verdict holds; of rules as long as each other that fit a url the one with the longer host wins, of those the last in
the order of their characters, in whatever files they stand; a very long url has as many candidates as its host has dots
times the lengths of rules' paths; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import ascii_lower, lean, plain, rebatched, scratch

#: The rules of the production list.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
DEFAULT = "allow"
#: Rules of one file; more rules make more files, all of which are probed.
PART = 50_000_000
VERDICTS = ("allow", "block")
_MAGIC = np.frombuffer(b"QMURL001", np.uint64)[0]


def host_path(url: Column | str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def keys(strings: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))


def pack(rules: dict[str, str]) -> bytes:
    """The file: a header of four numbers, then sorted keys, places, verdicts and strings."""
    strings = [r.encode() for r in rules]
    digests = keys(strings)
    order = np.argsort(digests, kind="stable")
    ends = np.cumsum([0, *(len(strings[i]) for i in order)], dtype=np.uint64)
    verdicts = np.array([VERDICTS.index(rules[strings[i].decode()]) for i in order], np.uint8)
    paths = sorted({len(r[r.index("/") :]) if "/" in r else 0 for r in rules})
    longest = max((len(r.split("/", 1)[0]) for r in rules), default=0)
    head = np.array([_MAGIC, len(strings), len(paths), longest], np.uint64)
    return b"".join(x.tobytes() for x in (head, np.array(paths, np.uint64), digests[order], ends, verdicts)) + b"".join(strings[i] for i in order)


class Index:
    """A packed list, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        head = data[:32].view(np.uint64)
        if head[0] != _MAGIC:
            raise ValueError("not a list of this format")
        n, m, self.longest = int(head[1]), int(head[2]), int(head[3])
        at = 32

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            at += size
            return data[at - size : at].view(kind)

        self.paths = take(m, np.uint64).tolist()
        self.digests, self.ends = take(n, np.uint64), take(n + 1, np.uint64)
        self.verdicts, self.heap = take(n, np.uint8), data[at:]

    def string(self, i: int) -> bytes:
        return self.heap[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def find(self, strings: list[bytes], digests: np.ndarray | None = None) -> np.ndarray:
        """The place of each string in the list, or -1."""
        digests = keys(strings) if digests is None else digests
        out = np.full(len(strings), -1, np.int64)
        if not len(self.digests):
            return out
        left = np.searchsorted(self.digests, digests)
        hit = np.flatnonzero((left < len(self.digests)) & (self.digests[np.minimum(left, len(self.digests) - 1)] == digests))
        for k in hit:  # usually one place; digests that collide lie side by side
            i = int(left[k])
            while i < len(self.digests) and self.digests[i] == digests[k]:
                if self.string(i) == strings[k]:
                    out[k] = i
                    break
                i += 1
        return out

    def candidates(self, host: str, path: str) -> list[bytes]:
        if not host:
            return []
        tail = host[max(0, len(host) - self.longest - 1) :]
        suffixes = [host] if len(host) <= self.longest else []
        suffixes += [tail[i + 1 :] for i, c in enumerate(tail) if c == "."]
        prefixes = [path[:n] for n in self.paths if n <= len(path)]
        return [(s + p).encode("utf-8", "surrogatepass") for s in suffixes for p in prefixes]

    def judge(self, hosts: list[str], paths: list[str], default: str = DEFAULT) -> tuple[list[str | None], list[str]]:
        strings, of = [], []
        for k, (h, p) in enumerate(zip(hosts, paths)):
            new = self.candidates(h, p)
            strings += new
            of += [k] * len(new)
        rules: list[str | None] = [None] * len(hosts)
        verdicts = [default] * len(hosts)
        places = self.find(strings)
        for j in np.flatnonzero(places >= 0):
            k, s = of[j], strings[j].decode("utf-8", "surrogatepass")
            if rules[k] is None or weight(s) > weight(rules[k]):
                rules[k], verdicts[k] = s, VERDICTS[self.verdicts[places[j]]]
        return rules, verdicts


def weight(rule: str) -> tuple[int, int, str]:
    """Of rules that fit a url the one of most weight wins: the longest, of equals the one with the longer host, then the
    last in the order of their characters; whichever file it stands in."""
    return len(rule), len(rule.split("/", 1)[0]), rule


def parts(rules: dict[str, str], size: int) -> Iterator[dict[str, str]]:
    left = iter(rules.items())
    while (part := dict(islice(left, size))) or not rules:
        yield part
        if not rules:
            return


def judge(lists: list[Index], hosts: list[str], paths: list[str], default: str = DEFAULT) -> tuple[list[str | None], list[str]]:
    """The rule of most weight of all lists for each url, and its verdict."""
    rules: list[str | None] = [None] * len(hosts)
    verdicts = [default] * len(hosts)
    for index in lists:
        for k, (rule, verdict) in enumerate(zip(*index.judge(hosts, paths, default))):
            if rule is not None and (rules[k] is None or weight(rule) > weight(rules[k])):
                rules[k], verdicts[k] = rule, verdict
    return rules, verdicts


def share(spark: SparkSession, rules: dict[str, str]) -> str:
    """Write a list to the shared folder, hand it out, and return the name under which workers find it."""
    uri = scratch(spark, "urls")
    where = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(where)
    stream.write(bytearray(pack(rules)))
    stream.close()
    spark.sparkContext.addFile(fs.makeQualified(where).toString())
    return uri.rsplit("/", 1)[1]


def judged(pages: DataFrame, rules: dict[str, str] | None = None, url_col: str = "url", keep: list[str] | None = None, default: str = DEFAULT, part: int = PART) -> DataFrame:
    """The columns ``keep`` of ``pages`` (all by default), and in the last four columns host, path, rule and
    verdict, whatever the others are called."""
    names = pages.columns if keep is None else keep
    files = [share(pages.sparkSession, some) for some in parts(RULES if rules is None else rules, part)]
    held, short = plain(pages)
    host, path = host_path(F.col(short[url_col]).cast("string"))
    slim = held.select(*(short[c] for c in names), host.alias("host"), path.alias("path"))
    schema = slim.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Index(SparkFiles.get(f)) for f in files]
        for batch in rebatched(batches, 8192):
            found, verdicts = judge(lists, batch.column("host").to_pylist(), batch.column("path").to_pylist(), default)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=[*batch.schema.names, "rule", "verdict"]
            )

    return slim.mapInArrow(lean(run), schema).toDF(*names, "host", "path", "rule", "verdict")


def query(pages: DataFrame) -> DataFrame:
    return judged(pages, keep=["page_id"])


SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest
), parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path, row_number() OVER () AS k FROM cut
), rules(rule, verdict) AS (
  VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')
), split AS (
  SELECT rule, verdict, substr(rule, 1, strpos(rule, '/') - 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM rules
), best AS (
  SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN split ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (k)
"""
