"""Binary records: exact round trips against whole texts' ids, the index, damage, and edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kotomill.llm import records

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "The", "don't", "é", "é", "́", "Σ", "ΑΣ", "漢字", "　", "\xa0", "\x85", "\x1c", "\x0b", "\x0c", "\r", "\n", "\t", " ", "  ", "'s", "<|startoftext|>", "<|endof", "text|>", "😀", "12", "İ", "ﬁ", "\x00", "が", "ガ", "‍", "-" * 9, "x" * 70, "...", ",", "!", "s", "ß", "Ł#", ")", "&"]


@pytest.fixture(scope="module")
def whole():
    held = Tokenizer.from_file(PATH)
    return lambda text: [*held.encode(text or "", add_special_tokens=False).ids, records.END]


@pytest.mark.parametrize("apart", [None, records.LATIN_MARKS])
def test_encoder_cuts_where_the_tokenizer_does(whole, apart):
    """The remembered words of a text give the ids of the whole text."""
    rng = random.Random(0)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "", "y" * 100_000, " " * 5000 + "z"]
    encode = records.Encoder(PATH, apart=apart)
    got = [np.frombuffer(b, encode.kind).tolist() for start in range(0, len(texts), 100) for b in encode(pa.array(texts)[start : start + 100])]
    assert got == [whole(t) for t in texts]


def test_encoder_forgets(whole, monkeypatch):
    monkeypatch.setattr(records, "CACHE", 3)
    encode = records.Encoder(PATH, apart=records.LATIN_MARKS)
    for text in ("a. b, c d e.", "e d c", "a " + "q" * 100, "f g", "", "a<|endoftext|>b a<|startoftext|>", "h i j k", "a f k", "<|endoftext|> <|endoftext|"):
        assert np.frombuffer(encode(pa.array([text]))[0], encode.kind).tolist() == whole(text) and len(encode.young) + len(encode.old) < 30


def folder(tmp_path):
    return f"file://{tmp_path}/records"


ROWS = [(5, "five words are here now", "a", 1), (-3, "x", "a", 1), (7, None, "a", 1), (7, "", "a", 1), (None, "no key", "a", 1), (5, "another five", "a", 1), (5, "another five", "a", 1), (1 << 40, "漢字 and 😀", "a", 1)]


def test_round_trip(spark, tmp_path, whole):
    """Keys ascend over the files, ids and their places are those of the texts, whatever the number of files."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, h string, n int").repartition(3)
    index = records.write(docs, folder(tmp_path), PATH, parts=4)
    got = records.read(spark, folder(tmp_path)).orderBy("part", "at").collect()
    assert [r.doc_id for r in got] == [-3, 5, 5, 5, 7, 7, 1 << 40, None]
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in got]
    assert sorted((str(r.doc_id), i) for r, i in zip(got, ids, strict=True)) == sorted((str(k), whole(t)) for k, t, *_ in ROWS)
    assert [r.start for r in got] == [sum(map(len, ids[:k])) for k in range(len(ids))]
    listed = index.orderBy("part", "at").collect()
    assert [(r.part, r.at, r.doc_id, r.n_tokens) for r in listed] == [(r.part, r.at, r.doc_id, len(i)) for r, i in zip(got, ids, strict=True)]
    assert {r.file for r in listed} == {p.name for p in (tmp_path / "records" / "data").iterdir()}
    for r, i in zip(listed, ids, strict=True):
        data = (tmp_path / "records" / "data" / r.file).read_bytes()[r.offset :]
        assert int.from_bytes(data[:8], "little") == r.length and records.unpacked(data[12 : 12 + r.length])[1].tolist() == i


def test_shuffled_reads(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    records.write(docs, folder(tmp_path), PATH, parts=3)
    plain = {(r.part, r.at): (r.doc_id, r.ids) for r in records.read(spark, folder(tmp_path)).collect()}
    one, two, other = ([((r.part, r.at), (r.doc_id, r.ids)) for r in records.shuffled(spark, folder(tmp_path), seed, 4).collect()] for seed in (1, 1, 2))
    assert dict(one) == plain and one == two != other and len(one) == 500
    assert [k for k, _ in one] != sorted(plain)


def test_one_key_with_most_rows_goes_to_several_files(spark, tmp_path):
    docs = spark.range(0, 900, numPartitions=6).select(F.when(F.col("id") % 3 > 0, F.lit(4)).otherwise(F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"))
    index = records.write(docs, folder(tmp_path), PATH, parts=5)
    assert index.where("doc_id = 4").select("part").distinct().count() > 1 and index.count() == 900
    keys = [r.doc_id for r in records.read(spark, folder(tmp_path)).orderBy("part", "at").collect()]
    assert keys == sorted(keys)


def test_empty_table_and_files_that_no_task_committed(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    (tmp_path / "records" / "data").mkdir(parents=True)
    (tmp_path / "records" / "data" / "part-00000000-lost.rec").write_bytes(b"half")
    assert records.write(docs, folder(tmp_path), PATH).count() == 0
    assert records.read(spark, folder(tmp_path)).count() == 0 and records.shuffled(spark, folder(tmp_path), 1).count() == 0
    assert not list((tmp_path / "records" / "data").iterdir())


@pytest.mark.parametrize("at", [0, 9, 15, -1])
def test_damage_is_found(spark, tmp_path, at):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    records.write(docs, folder(tmp_path), PATH, parts=1)
    (file,) = (tmp_path / "records" / "data").iterdir()
    data = bytearray(file.read_bytes())
    data[at] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        records.read(spark, folder(tmp_path)).collect()
    file.write_bytes(data[:-2])
    with pytest.raises(Exception, match="damaged"):
        records.read(spark, folder(tmp_path)).collect()


def test_wide_ids():
    payload = records.packed(3, np.array([70_000, 1], "<u4").tobytes(), 4)
    assert records.unpacked(payload)[1].tolist() == [70_000, 1] and records.unpacked(records.packed(None, b"\x01\x00", 2)) == (None, np.array([1]))


def test_query(spark, whole):
    """The query over the smallest tables, by brute force."""
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    want, start = [], 0
    for key, text in texts:
        ids = np.array(whole(text), "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, records.op12_records(spark, "/root/testdata/sf0.001").collect())) == want
