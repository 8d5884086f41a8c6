import io
import random
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from tokenizers import Tokenizer

from quillmark.llm import op9_sstable as op9
from quillmark.llm.common import scratch, sized_batches
from tests.llm.conftest import SF


def test_query_matches_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    t = Tokenizer.from_file(op9.tokenizer_path())
    start, want = 0, []
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, op9.query(docs).collect())) == want


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (None, "a b"), (2, "x" * 100_000), (2, "<|endoftext|> it's Ab́ \U0001f600"), (2, "x" * 100_000), (-5, "y " * 50_000)]
    docs = spark.createDataFrame([(i, t, 4) for i, t in rows], "doc_id long, text string, tokens int")
    got = sorted(op9.query(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -5, 1, 2, 2, 2, 3]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(7)]
    t = Tokenizer.from_file(op9.tokenizer_path())
    assert sorted(r.n_tokens for r in got) == sorted(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    assert got[2].ids_crc32 == zlib.crc32(b"\x01\0\0\0")
    assert op9.query(docs.limit(0)).count() == 0


def same_ids(encoder, texts):
    got = encoder.encode(pa.array(texts, pa.string())).to_pylist()
    for text, ids, e in zip(texts, got, encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, encoder.kind).tolist() == e.ids, repr(text)


def test_pieces_are_encoded_as_the_whole_text():
    rng = random.Random(4)
    marks = ["'s", "'ll", "<|startoftext|>", "<|endoftext|>", "́", " ", " ", "\x1c", "\x85", "ΑΣ", "Σ", "İ", "ﬁ", "12", "é", "漢字", "😀", "\x00", "a", "B", "!", "...", "é!?", "Ü.", "ñ", "ß", "Ǆ", "ĳ", "ŉ", "ª", "ü", "ɐ", "ʰ", "Œ", "<", "|", ">", "'", "$$$", "it's,", "x.y", "3.5", "-_", " ", "\n", "\t ", "\x0b", "\r\n"]
    marks += ["\u0958", "\u095c", "\ufb4a", "\ufb2a", "\u0f69", "\u0338"]  # letters that NFC takes apart
    encoder = op9.Encoder(op9.tokenizer_path(), cache=50)
    assert encoder.cuts
    for _ in range(60):
        same_ids(encoder, ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(200)])
    same_ids(encoder, [])
    same_ids(encoder, ["", " ", ""])
    sliced = pa.array(["x!", "a b.", "", "c\u0958!"], pa.string())[1:]
    assert encoder.encode(sliced).to_pylist() == encoder.encode(pa.array(sliced.to_pylist(), pa.string())).to_pylist()


def test_every_character_before_a_mark():
    encoder = op9.Encoder(op9.tokenizer_path())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("{}!", "a{}b."):
        for at in range(0, len(chars), 100_000):
            same_ids(encoder, [form.format(c) for c in chars[at : at + 100_000]])


def test_other_tokenizers_take_whole_texts():
    encoder = op9.Encoder(op9.tokenizer_path("byte_bpe_50k.json"))
    assert not encoder.cuts
    same_ids(encoder, ["a b", " it's!", "", "x  y\n\n"])


def test_batches_and_shards_are_bounded_by_bytes(spark):
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 5, 30, 0, 1, 10)]})
    assert [b.num_rows for b in sized_batches(iter([batch, batch.slice(0, 0)]), "text", 10)] == [2, 1, 2, 1]
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 2000) as text").repartition(2)
    path = scratch(spark, "shards")
    shards = op9.write(docs, path, shard_bytes=500)
    assert max(s.part for s in shards) > 0 and sum(s.docs for s in shards) == 300
    where, folder = op9.filesystem(path)
    assert sorted(f.path for f in where.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".sst")) == sorted(s.path for s in shards)
    assert sorted(map(tuple, op9.read(spark, path, shards).collect())) == sorted(map(tuple, op9.query(docs).collect()))


def test_lookup():
    rng = random.Random(1)
    keys = sorted(rng.sample(range(-10_000, 10_000), 3000) + [5, 5, 5, 777, 777])
    sink = io.BytesIO()
    writer = op9.Writer(sink, 2, block_bytes=500)
    values = [np.array([rng.randrange(60_000) for _ in range(rng.randrange(1, 30))], "<u2") for _ in keys]
    for k, v in zip([None, *keys], [np.array([9], "<u2"), *values]):
        writer.add(op9.key_of(k), v.tobytes())
    writer.close()
    reader = op9.Reader(pa.BufferReader(sink.getvalue()))
    assert (reader.docs, reader.tokens) == (len(keys) + 1, 1 + sum(map(len, values)))
    assert [op9.id_of(k) for k, _ in reader] == [None, *keys]
    assert reader.get(None)[0].tolist() == [9]
    by = {}
    for k, v in zip(keys, values):
        by.setdefault(k, []).append(v.tolist())
    for k in range(-10_050, 10_050, 7):
        assert [x.tolist() for x in reader.get(k)] == by.get(k, [])
    assert [x.tolist() for x in reader.get(5)] == by[5]
