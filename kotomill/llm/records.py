"""Token ids in length-delimited binary records, with an offset index beside them.

A file is a sequence of frames and nothing else. A frame is

    u64  length of the payload
    u32  masked checksum of these 8 bytes
         payload
    u32  masked checksum of the payload

all little-endian. The checksum is CRC-32, masked as (c >> 15 | c << 17) + 0xA282EAD8 modulo 2^32, so that frames within frames don't verify by
accident. A payload is a key (i64), a byte that is 1 if there is a key, a byte with the bytes of an id, and the ids: 2 bytes each if the vocabulary fits, else 4.

Documents are dealt to files by ranges of their keys and sorted within, so the files in their order hold ascending keys. A task
streams its documents: it encodes a batch, writes the frames, and returns their index rows. The index is a Parquet table
(part, file, at, offset, length, n_tokens, doc_id), written by Spark: its commit is the commit of the files, since rows come only from tasks that ended well
and every attempt of a task writes under a name of its own; files that the index does not name are removed. Files are written and read by the executors with
pyarrow's file systems, in the folder that all nodes share.

Encoding: white space separates words for the tokenizer and belongs to none, so a text's ids are those of its parts between spaces, tabs and
line ends, and each worker remembers the ids of CACHE recent short ones.

``read`` streams whole files in order, ``shuffled`` deals the index rows, not the records, in a random order and reads each record by its
offset. Both verify lengths and checksums, and raise OSError on a damaged file.

Defined edge cases: a null text is empty and has the end id alone; null keys come last, in the order of their texts' hashes; equal keys
are ordered by the hash of the text, so the ids' order is the same in any run; rows that repeat id and text are records of their own; an
empty table gives an index without rows; extra columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, table, tidy

END = 2
#: Text bytes of a file, about, and of the least work worth a file.
FILE_BYTES, LEAST_BYTES = 256 << 20, 4 << 20
#: Words of a generation that a worker remembers, and their most characters.
CACHE, WORD_CHARS = 1 << 19, 32
#: Bytes of ids in a batch that is returned to Spark.
BATCH = 8 << 20
HEAD, KEY, CHECK = struct.Struct("<Q"), struct.Struct("<qBB"), struct.Struct("<I")
INDEX = "part int, file string, at long, offset long, length long, n_tokens long, doc_id long"


def masked(data: bytes | memoryview) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = HEAD.pack(len(payload))
    return b"".join((head, CHECK.pack(masked(head)), payload, CHECK.pack(masked(payload))))


FRAME = HEAD.size + 2 * CHECK.size


def unframed(source, where: str) -> bytes | None:
    """The next payload of an open file, None at its end."""
    head = source.read(HEAD.size + CHECK.size)
    if not head:
        return None
    if len(head) < HEAD.size + CHECK.size or CHECK.unpack_from(head, HEAD.size)[0] != masked(head[: HEAD.size]):
        raise OSError(f"{where}: damaged length of a record")
    size = HEAD.unpack_from(head)[0]
    body = source.read(size + CHECK.size)
    if len(body) < size + CHECK.size or CHECK.unpack_from(body, size)[0] != masked(memoryview(body)[:size]):
        raise OSError(f"{where}: damaged record")
    return body[:size]


def packed(key: int | None, ids: bytes, width: int) -> bytes:
    return KEY.pack(key or 0, key is not None, width) + ids


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    """(key, ids as unsigned 32-bit numbers)."""
    key, known, width = KEY.unpack_from(payload)
    return key if known else None, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=KEY.size).astype("<u4")


class Encoder:
    """Texts to the bytes of their ids, by a tokenizer file of the tokenizers library.

    Words are remembered in two generations: when the younger holds CACHE words it becomes the older one, and what the older one held
    and nobody asked for since is forgotten. Unknown words are encoded many at a time. ``apart`` may be a pattern of whole words with two
    groups, a head and a tail that the tokenizer is known to keep apart; these are then remembered by themselves.
    """

    def __init__(self, path: str, end: int = END, apart: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = np.array([end], self.kind).tobytes()
        self.apart = re.compile(apart).fullmatch if apart else None
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _bytes(self, words: list[str]) -> list[bytes]:
        """The ids of each word by itself: all are encoded as one text, and a token is of the word in which it starts."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, starts = np.array(found.ids, self.kind), np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
        begin = np.cumsum([0, *(len(w) + 1 for w in words)])
        cuts = (np.searchsorted(starts, begin) * self.width).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The bytes of words that the younger generation lacks; short ones and parts are remembered."""
        found = {w: b for w in words if (b := self.old.get(w)) is not None}
        fresh = words.difference(found)
        cut = {w: m.groups() for w in fresh if (m := self.apart(w))} if self.apart else {}
        parts = fresh.difference(cut).union(*cut.values()).difference(self.young, found)
        held = {p: b for p in parts if (b := self.old.get(p)) is not None} if cut else {}
        todo = list(parts.difference(held))
        for start in range(0, len(todo), 1024):
            some = todo[start : start + 1024]
            held.update(zip(some, self._bytes(some), strict=True))
        found.update(held)
        of = lambda p: found[p] if p in found else self.young[p]
        found.update([(w, of(a) + of(b)) for w, (a, b) in cut.items()])
        self.young.update((w, b) for w, b in found.items() if len(w) <= WORD_CHARS)
        return found

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Each distinct word of the texts is looked up once; the ids of the texts are then gathered by the words' numbers."""
        if len(self.young) > CACHE:
            self.young, self.old = {"": b""}, self.young
        plain = pc.fill_null(texts, "")
        for space in "\n\t\r":
            plain = pc.replace_substring(plain, space, " ")
        parts = pc.split_pattern(plain, " ")
        coded = parts.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        held = list(map(self.young.get, words))
        if None in held:
            more = self._learn({w for w, b in zip(words, held, strict=True) if b is None})
            held = [more[w] if b is None else b for w, b in zip(words, held, strict=True)]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // self.width
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(held), self.kind)
        sizes, starts = sizes[at], starts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = ids[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        edges = ends[np.asarray(parts.offsets) - parts.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() + self.end for a, b in zip(edges, edges[1:], strict=False)]


@cache
def encoder(path: str, end: int, apart: str | None) -> Encoder:
    return Encoder(path, end, apart)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and its path there."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1) if "://" in folder or not folder.startswith("file:") else "file://" + folder.removeprefix("file:"))


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END, parts: int | None = None, apart: str | None = None) -> DataFrame:
    """Writes the documents' records to ``folder``/data and their index to ``folder``/index, and returns the index.

    ``parts`` is the number of files; by default it follows from the bytes of all texts. ``apart`` is a pattern of words that Encoder may cut.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("x"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("x"))).first()[0] or 0
        parts = max(1, ceil(size / FILE_BYTES), min(2 * spark.sparkContext.defaultParallelism, ceil(size / LEAST_BYTES)))
    # the row's number lets a key with most rows be dealt to several files
    order = F.asc_nulls_last("k"), F.col("h"), F.col("n")
    keyed = rows.select("k", F.xxhash64("x").alias("h"), F.monotonically_increasing_id().alias("n"), "x")
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("k", "x")
    files, root = opened(f"{folder}/data")
    files.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer, end, apart)
        name = f"part-{part:08d}-{uuid.uuid4().hex}.rec"
        files, root = opened(f"{folder}/data")
        out, at, offset = None, 0, 0
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                out = out or files.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                keys, offsets, lengths, sizes = batch.column(0).to_pylist(), [], [], []
                for k, ids in zip(keys, encode(batch.column(1)), strict=True):
                    payload = packed(k, ids, encode.width)
                    out.write(frame(payload))
                    offsets.append(offset)
                    lengths.append(len(payload))
                    sizes.append(len(ids) // encode.width)
                    offset += len(payload) + FRAME
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), *(pa.array(c, pa.int64()) for c in (offsets, lengths, sizes, keys))], ["part", "file", "at", "offset", "length", "n_tokens", "doc_id"])
                at += n
        if out:
            out.close()  # an index row counts only once the task has ended, so after this

    dealt.mapInArrow(tidy(run), INDEX).write.parquet(f"{folder}/index")
    found = index(spark, folder)
    named = {r.file for r in found.select("file").distinct().collect()}  # a name per file of FILE_BYTES
    for held in files.get_file_info(fs.FileSelector(root)):
        if held.base_name not in named:
            files.delete_file(held.path)
    return found


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


RECORD = "part int, at long, doc_id long, start long, ids binary"


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of RECORD in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if size > BATCH or len(held) == 4096:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "at", "doc_id", "start", "ids"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(part, at, doc_id, start, ids) of every record, from whole files, one a task; start counts the ids of all records before, ids are unsigned 32-bit little-endian numbers."""
    found = index(spark, folder).groupBy("part", "file").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per file
    starts = accumulate((r.n for r in found), initial=0)
    listed = spark.createDataFrame([(k, r.part, r.file, s) for k, (r, s) in enumerate(zip(found, starts, strict=False))], "k int, part int, file string, start long")
    each = listed.repartitionByRange(max(1, len(found)), "k").select("part", "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(f"{folder}/data")

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for part, name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with files.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as source:
                        at = 0
                        while (payload := unframed(source, name)) is not None:
                            key, ids = unpacked(payload)
                            yield part, at, key, start, ids.tobytes()
                            at, start = at + 1, start + len(ids)

        yield from _batches(rows())

    return each.mapInArrow(tidy(run), RECORD)


def shuffled(spark: SparkSession, folder: str, seed: int, parts: int | None = None) -> DataFrame:
    """The records of ``read`` in an order drawn by the seed, without start; only index rows are shuffled, each record is read at its offset."""
    turn = F.xxhash64(F.lit(seed), "file", "at")
    rows = index(spark, folder).select(turn.alias("turn"), "part", "file", "at", "offset")
    dealt = (rows.repartitionByRange(parts, "turn") if parts else rows.repartitionByRange("turn")).sortWithinPartitions("turn", "part", "at").select("part", "file", "at", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(f"{folder}/data")
        held: dict = {}  # open files, the last used ones

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for part, name, at, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    source = held.pop(name, None) or files.open_input_file(f"{root}/{name}")
                    held[name] = source
                    if len(held) > 64:
                        held.pop(next(iter(held))).close()
                    source.seek(offset)
                    payload = unframed(source, name)
                    if payload is None:
                        raise OSError(f"{name}: no record at {offset}")
                    key, ids = unpacked(payload)
                    yield part, at, key, None, ids.tobytes()

        yield from _batches(rows())

    return dealt.mapInArrow(tidy(run), RECORD).drop("start")


#: word_bpe_49k splits texts into runs of letters, single digits and runs of other signs, so marks behind Latin letters stand apart (but for İ, whose small letter holds a mark).
LATIN_MARKS = r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,;:!?#$%&*)]+)"


def op12_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark).rstrip('/')}/kotomill/records-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), apart=LATIN_MARKS)
    rows = read(spark, folder)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op12_records": op12_records}
ORACLES: dict[str, str] = {}
