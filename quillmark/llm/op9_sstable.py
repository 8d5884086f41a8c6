"""Token-id output as sorted-string-table shards.

A shard holds the documents of one range of identifiers, in ascending order:

    data blocks   entries (shared prefix, rest of key, value), every 16th key whole, then the places of
                  those restarts and their count; each block compressed with zstd
    block index   for each block its last key, offset and length
    Bloom filter  10 bits and 7 probes a key
    footer        offsets of index and filter, number of documents and of ids, bytes of an id, magic

Keys are 9 bytes, big-endian and order-preserving; values are the ids, little-endian, 2 bytes each where
the vocabulary allows. Lookup reads the footer, asks the filter, searches the index, then the restarts of
one block. A task writes under names of its own; the driver gives those of the tasks that succeeded their final
names and removes the others, so that lost executors and repeated tasks are harmless. A task's shards end at
``SHARD_BYTES``.

Defined results: a null text is empty and has the end id alone; null ids come first; rows of one id
are kept, in the order of their texts' hashes; a very long text is a batch of its own; an empty table
makes no shard; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import lean, partitions, scratch, sized_batches

END_ID = 1
BLOCK_BYTES = 1 << 16
RESTART = 16
MAGIC = b"QMSST001"
#: Of about so many distinct parts of texts does a worker remember the ids; at most of twice as many.
CACHE = 20_000
#: Bytes of text that are cut up at a time; a longer text is one batch.
BATCH_BYTES = 4 << 20
#: Bytes of data blocks from which a task ends a shard and begins the next, which bounds index and filter.
SHARD_BYTES = 256 << 20
_FOOTER = struct.Struct("<QQQQQQI8s")
_ENTRY = struct.Struct("<BBI")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent:
    """Values by key. What the last few batches used stays; the rest is forgotten in time."""

    def __init__(self, size: int, learn):
        self.size, self.learn, self.now, self.old = size, learn, {}, {}

    def of(self, keys: list) -> list:
        """The values of the distinct ``keys``, in their order."""
        if len(self.now) > self.size:
            self.now, self.old = {}, self.now
        now, old = self.now, self.old
        missing = [k for k in keys if k not in now]
        if old:
            now.update((k, old[k]) for k in missing if k in old)
            missing = [k for k in missing if k not in now]
        now.update(zip(missing, self.learn(missing)))
        return list(map(now.__getitem__, keys))


class Encoder:
    """The tokenizers library's ids of whole texts, as bytes.

    Batches are cut and deduplicated by Arrow, and each distinct part meets the library once. That is right
    for one normalizer and pre-tokenizer, ``KNOWN``, which never join what ASCII white space parts, nor a letter
    and a mark behind it; with any other tokenizer whole texts are encoded. A piece between white space loses
    its ``MARKS`` at the end if the library itself parts them from the character before. What is left is given
    to the library's model if it is plain ASCII, which neither normalizer nor byte alphabet change but for case,
    or a word of Latin letters, whose single characters the library has translated; else to the library.
    """

    # The normalizer and pre-tokenizer that the cutting rules are written for.
    KNOWN = {
        "normalizer": {
            "type": "Sequence",
            "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
        },
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }
    PLAIN = re.compile(rb"[!-&(-;=-~]+")
    PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
    #: ASCII punctuation that is in no contraction and no special token.
    MARKS = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has a core of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        settings = json.loads(self.tokenizer.to_str())
        special = [x["content"] for x in settings["added_tokens"]]
        self.cuts = all(settings[k] == v for k, v in self.KNOWN.items()) and all(re.fullmatch(r"<[^<>\s]*>", x) and not set(x) & set(self.MARKS) for x in special)
        self.model, self.letters, self.parting = self.tokenizer.model, {}, {}
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.width, self.code = (4, "I") if wide else (2, "H")
        self.kind = np.dtype(f"<u{self.width}")
        self.parts = Recent(cache, self._parts)

    def _parted(self, c: str) -> bool:
        """Does the library part a mark from the character (or none) before it?"""
        if c not in self.parting:
            if len(self.parting) > 4096:
                self.parting.clear()
            normal = self.tokenizer.normalizer.normalize_str(c + "!")
            self.parting[c] = c not in "<>|'" and normal[-1:] == "!" and self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)[-1][0] == "!" and c != ""
        return self.parting[c]

    def _letter(self, c: str) -> str:
        """What the model sees of a Latin letter; empty for what isn't one, before or after normalizing."""
        normal = self.tokenizer.normalizer.normalize_str(c) if c.isalpha() and c < "\u0250" else ""
        return "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)) if normal.isalpha() else ""

    def _word(self, text: str) -> str:
        """What the model sees of a word of Latin letters, or an empty string if it isn't one."""
        letters = self.letters
        for c in set(text).difference(letters):
            if len(letters) > 4096:
                letters.clear()
                return ""
            letters[c] = self._letter(c)
        seen = [letters[c] for c in text]
        return "".join(seen) if all(seen) and unicodedata.is_normalized("NFC", text) else ""

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 1024):
            out += [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False)]
        return out

    def _parts(self, new: list[bytes]) -> list[bytes]:
        found, rest, code, tokenize, plain = [b""] * len(new), [], self.code, self.model.tokenize, self.PLAIN.fullmatch
        for k, part in enumerate(new):
            if part.isalpha():  # of bytes: ASCII letters alone
                found[k] = array(code, [t.id for t in tokenize(part.lower().decode())]).tobytes()
            elif plain(part):
                found[k] = array(code, [t.id for x in self.PARTS.findall(part.lower()) for t in tokenize(x.decode())]).tobytes()
            elif part:
                text = part.decode()
                if word := self._word(text):
                    found[k] = array(code, [t.id for t in tokenize(word)]).tobytes()
                else:
                    rest.append((k, text))
        for (k, _), ids in zip(rest, self._whole([t for _, t in rest])):
            found[k] = ids
        return found

    def _pieces(self, pieces: pa.StringArray) -> pa.BinaryArray:
        """The ids of distinct pieces without ASCII white space."""
        core = pc.ascii_rtrim(pieces, characters=self.MARKS)
        last = pc.utf8_slice_codeunits(core, -1, sys.maxsize).dictionary_encode()
        parted = pa.array([self._parted(c) for c in last.dictionary.to_pylist()], pa.bool_()).take(last.indices)
        core = pc.if_else(parted, core, pieces)
        marks = pc.binary_slice(pieces.cast(pa.binary()), 0, 0)
        if pc.any(parted).as_py():
            begin = pc.binary_length(core).to_numpy()
            offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
            marks = _sliced(pieces, offsets[:-1] + begin, offsets[1:])
        core = pc.if_else(pc.ascii_is_alpha(core), pc.ascii_lower(core), core)
        both = pa.concat_arrays([core.cast(pa.binary()), marks]).dictionary_encode()
        ids = pa.array(self.parts.of(both.dictionary.to_pylist()), pa.binary()).take(both.indices)
        return pc.binary_join_element_wise(ids[: len(pieces)], ids[len(pieces) :], b"")

    def encode(self, texts: pa.StringArray) -> pa.BinaryArray:
        """The ids of each text, little-endian, ``width`` bytes each."""
        if not self.cuts:
            return pa.array(self._whole(texts.to_pylist()), pa.binary())
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        if not len(flat):
            return pa.array([b""] * len(texts), pa.binary())
        ids = self._pieces(flat.dictionary).take(flat.indices)
        bounds = np.frombuffer(split.buffers()[1], np.int32)[split.offset : split.offset + len(split) + 1]
        places = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        offsets = np.ascontiguousarray(places[bounds - bounds[0]])
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), ids.buffers()[2]])


def _sliced(values: pa.StringArray, begin: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """The bytes [begin, end) of the buffer behind ``values``; each slice ends before the next begins."""
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.empty(0, np.uint8)
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    places = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[places]))])


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder; it outlives the task, with what it remembers."""
    return Encoder(path)


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(key: bytes, size: int) -> list[int]:
        h = xxhash.xxh64_intdigest(key)
        a, b = h & 0xFFFFFFFF, h >> 32 | 1
        return [(a + i * b) % size for i in range(7)]

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        bits = np.zeros(max(8, 10 * len(keys) // 8 + 1), np.uint8)
        for k in keys:
            for p in cls._places(k, 8 * len(bits)):
                bits[p >> 3] |= 1 << (p & 7)
        return cls(bits)

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key, 8 * len(self.bits)))


class Writer:
    """Appends (key, value) pairs in ascending order to an open stream."""

    def __init__(self, stream, width: int, block_bytes: int = BLOCK_BYTES):
        self.stream, self.width, self.limit, self.at = stream, width, block_bytes, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []
        self.docs = self.tokens = 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.count, self.last = self.count + 1, key
        self.docs += 1
        self.tokens += len(value) // self.width
        if not self.hashes or self.hashes[-1] != key:
            self.hashes.append(key)
        if len(self.block) >= self.limit:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            tail = struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            packed = self.zip.compress(bytes(self.block) + tail)
            self.stream.write(packed)
            self.index.append((self.last, self.at, len(packed)))
            self.at += len(packed)
            self._start()

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        bloom = Bloom.of(self.hashes).bits.tobytes()
        self.stream.write(index + bloom)
        self.stream.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.tokens, self.width, MAGIC))


class Reader:
    """Reads a shard through any seekable file; holds the index and filter and one block at a time."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        a, n, b, m, self.docs, self.tokens, self.width, magic = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw, self.index, at = self._at(a, n), [], 0
        while at < n:
            size = raw[at]
            self.index.append((raw[at + 1 : at + 1 + size], *struct.unpack_from("<QQ", raw, at + 1 + size)))
            at += 17 + size
        self.bloom = Bloom(np.frombuffer(self._at(b, m), np.uint8))
        self.kind = np.dtype(f"<u{self.width}")

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def _block(self, k: int) -> tuple[bytes, tuple[int, ...], int]:
        raw = zstandard.ZstdDecompressor().decompress(self._at(*self.index[k][1:]))
        (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 * (n + 1)
        return raw, struct.unpack_from(f"<{n}I", raw, end), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, rest, size = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            raw, _, end = self._block(k)
            yield from self._entries(raw, 0, end)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row of ``doc_id``: none, one, or several if the identifier repeats."""
        key, found = key_of(doc_id), []
        if key not in self.bloom:
            return found
        k = bisect_left(self.index, key, key=lambda x: x[0])
        while k < len(self.index):
            raw, restarts, end = self._block(k)
            first = max(0, bisect_left(restarts, key, key=lambda at: next(self._entries(raw, at, end))[0]) - 1)
            for other, value in self._entries(raw, restarts[first], end):
                if other > key:
                    return found
                if other == key:
                    found.append(np.frombuffer(value, self.kind))
            k += 1
        return found


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


SHARDS = "shard int, part int, path string, docs long, tokens long"


def write(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES
) -> list:
    """Write ``docs`` as shards under ``path`` and return a row (shard, part, path, docs, tokens) for each, in order."""
    vocabulary = tokenizer or tokenizer_path()
    spark = docs.sparkSession
    where, folder = filesystem(path)
    where.create_dir(folder)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, folder = filesystem(path)
        encoder = writer = None
        done = []

        def close() -> None:
            writer.close()
            writer.stream.close()
            done.append((task.partitionId(), len(done), name, writer.docs, writer.tokens))

        for batch in sized_batches(batches, "text", BATCH_BYTES):
            encoder = encoder or encoder_of(vocabulary)
            end = np.array([end_id], encoder.kind).tobytes()
            for i, ids in zip(batch.column("id").to_pylist(), encoder.encode(batch.column("text")).to_pylist()):
                if writer is None:
                    name = f"{folder}/.attempt-{task.taskAttemptId()}-{task.partitionId():06d}-{len(done):04d}"
                    writer = Writer(where.open_output_stream(name), encoder.width)
                writer.add(key_of(i), ids + end)
                if writer.at >= shard_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        columns = list(zip(*done)) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "part", "path", "docs", "tokens"])

    found = []
    for r in sorted(ordered.mapInArrow(lean(shard), SHARDS).collect()):  # a row for each shard
        name = f"{folder}/part-{r.shard:06d}-{r.part:04d}.sst"
        where.move(r.path, name)
        found.append(Row(shard=r.shard, part=r.part, path=name, docs=r.docs, tokens=r.tokens))
    for x in where.get_file_info(pafs.FileSelector(folder)):  # of attempts that were lost
        if x.base_name.startswith(".attempt-"):
            where.delete_file(x.path)
    return found


def read(spark: SparkSession, path: str, shards: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, read from their files."""
    base, rows = 0, []
    for s in shards:
        rows.append((s.path, base))
        base += s.tokens

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = filesystem(path)
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with where.open_input_file(name) as file:
                    reader, out = Reader(file), []
                    for key, value in reader:
                        ids = np.frombuffer(value, reader.kind)
                        out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) == 8192:
                            yield _packed(out)
                            out = []
                    yield _packed(out)

    table = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return table.mapInArrow(lean(scan), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def query(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = scratch(spark, "shards")
    return read(spark, path, write(docs, path))
