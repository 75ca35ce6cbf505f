"""Token-ID output as directly addressable codes.

Ids are cut into byte-wide chunks, least significant first. Level k holds chunk k of every id that has more than k
chunks, and a bitmap with a bit for each of them: set where the id goes on to level k + 1. A rank directory has the
number of set bits before every 512-bit block, so the place of a token's next chunk is one lookup and one popcount:
any token is read by itself, without decoding others.

A segment is one such code over the ids of whole documents, with the documents' ids and first positions. Segments are
rows of Parquet files, in ascending doc_id order, so Spark's own readers and its commit protocol carry them to any
store, and a lost executor only repeats its task.

Defined results: a null text is empty and has the end id alone; a null doc_id sorts first; documents with the same
doc_id are all kept, in the order of their texts' hashes; an empty table gives no segment; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, saved, texts
from .encoder import encoder

MAGIC = b"DAC1"
BLOCK_BITS = 512
#: A segment is closed once it has so many tokens; only a document that is longer makes a longer one.
SEGMENT_TOKENS = 1 << 18

SEGMENTS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("first_doc_id", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("shard_start", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)
_SEGMENTS_ARROW = pa.schema(
    [("shard", pa.int32()), ("segment", pa.int32()), ("first_doc_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("shard_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def encode_ids(ids: np.ndarray) -> bytes:
    """The levels of an id array."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        chunk, high = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = high != 0
        words = np.zeros(-(-len(rest) // BLOCK_BITS) * BLOCK_BITS // 8, dtype=np.uint8)
        packed = np.packbits(more, bitorder="little")
        words[: len(packed)] = packed
        ones = np.bitwise_count(words).reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint32)
        rank = np.zeros(len(ones) + 1, dtype="<u4")
        np.cumsum(ones, out=rank[1:])
        levels.append((chunk, words, rank))
        rest = high[more]
        if not len(rest):
            break
    out = [struct.pack("<4sI", MAGIC, len(levels))]
    for chunk, words, rank in levels:
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), words.tobytes(), rank.tobytes()]
    return b"".join(out)


class Codes:
    """Read access to an encoded id array, without copying it."""

    def __init__(self, data: bytes, at: int = 0):
        magic, n_levels = struct.unpack_from("<4sI", data, at)
        if magic != MAGIC:
            raise ValueError("not a DAC segment")
        at += 8
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // BLOCK_BITS)
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            words = np.frombuffer(data, np.uint8, blocks * BLOCK_BITS // 8, at + 8 + n)
            rank = np.frombuffer(data, "<u4", blocks + 1, at + 8 + n + len(words))
            self.levels.append((chunk, words, rank))
            at += 8 + n + len(words) + 4 * len(rank)
        self.end = at

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """One id by its position."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunk, words, rank) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            byte = i >> 3
            if not words[byte] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            inside = words[block * (BLOCK_BITS // 8) : byte]
            i = int(rank[block]) + int(np.bitwise_count(inside).sum()) + int(words[byte] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, in order."""
        out = self.levels[0][0].astype("<u4")
        place = None
        for k in range(1, len(self.levels)):
            chunk, words, _ = self.levels[k - 1]
            on = np.flatnonzero(np.unpackbits(words, count=len(chunk), bitorder="little"))
            place = on if place is None else place[on]
            out[place] |= self.levels[k][0].astype("<u4") << np.uint32(8 * k)
        return out


def pack_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """Documents, each with its ids as little-endian unsigned 32-bit integers, as one segment."""
    starts = np.zeros(len(ids) + 1, dtype="<i8")
    np.cumsum([len(x) // 4 for x in ids], out=starts[1:])
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], dtype="<i8")
    return struct.pack("<Q", len(ids)) + numbers.tobytes() + known.tobytes() + starts.tobytes() + encode_ids(np.frombuffer(b"".join(ids), "<u4"))


class Segment:
    """A segment's documents and codes."""

    def __init__(self, data: bytes):
        (n,) = struct.unpack_from("<Q", data)
        numbers, known = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, np.uint8, n, 8 + 8 * n)
        self.doc_ids = [int(x) if k else None for x, k in zip(numbers, known, strict=True)]
        self.starts = np.frombuffer(data, "<i8", n + 1, 8 + 9 * n)
        self.codes = Codes(data, 8 + 9 * n + 8 * (n + 1))

    def token(self, doc: int, i: int) -> int:
        """Token i of the segment's doc-th document."""
        if not 0 <= i < self.starts[doc + 1] - self.starts[doc]:
            raise IndexError(i)
        return self.codes.token(int(self.starts[doc]) + i)


def _segments(path: str, end_id: int | None, limit: int):
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        code, docs, ids, held = encoder(path), [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "segment": number, "first_doc_id": docs[0], "n_docs": len(docs), "n_tokens": held, "shard_start": start, "doc_ids": docs, "payload": pack_segment(docs, ids)}], _SEGMENTS_ARROW
            )

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = code.ids(text.as_py()) + end
                if docs and held + len(found) // 4 > limit:
                    yield row()
                    number, start, docs, ids, held = number + 1, start + held, [], [], 0
                docs.append(doc.as_py())
                ids.append(found)
                held += len(found) // 4
        if docs:
            yield row()

    return run


def write_segments(docs: DataFrame, vocabulary: str, name: str = "dac", *, end_id: int | None, doc_id: str = "doc_id", text: str = "text", limit: int = SEGMENT_TOKENS) -> tuple[DataFrame, str]:
    """Encode whole texts and write them as segments in ascending doc_id order; gives the written table and its path."""
    key, words = F.col("_id"), F.col("_text")
    rows = docs.select(docs[doc_id].cast("long").alias("_id"), texts(docs, text).alias("_text"))
    rows = rows.repartitionByRange(key, F.xxhash64(words)).sortWithinPartitions(key, F.xxhash64(words))
    with batches(docs.sparkSession):
        return saved(rows.mapInArrow(_segments(vocabulary, end_id, limit), SEGMENTS), name)


def shard_offsets(segments: DataFrame) -> DataFrame:
    """(shard, offset): ids in all shards before. One row for each writing task."""
    totals = sorted(segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    rows, at = [], 0
    for shard, n in totals:
        rows.append((shard, at))
        at += n
    return segments.sparkSession.createDataFrame(rows, "shard int, offset long")


_DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, segment int"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            s = Segment(r["payload"])
            ids, base = s.codes.all(), r["offset"] + r["shard_start"]
            n = len(s.doc_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s.doc_ids, pa.int64()),
                    pa.array(s.starts[:-1] + base, pa.int64()),
                    pa.array(np.diff(s.starts), pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(s.starts[:-1], s.starts[1:], strict=True)], pa.int64()),
                    pa.array([r["shard"]] * n, pa.int32()),
                    pa.array([r["segment"]] * n, pa.int32()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "segment"],
            )


def read_digest(segments: DataFrame) -> DataFrame:
    """Per document, from the written segments: its place among all ids, their number and checksum."""
    placed = segments.join(shard_offsets(segments), "shard")
    # Payloads are large: few to a batch.
    with batches(segments.sparkSession, 8):
        return saved(placed.select("shard", "segment", "shard_start", "payload", "offset").mapInArrow(_digest, _DIGEST), "digest")[0]


def read_tokens(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, position) rows of ``wanted`` with their token; positions outside a document give none.

    The column of document ids, read without the payloads, brings each asked document to its segment; there each token
    is read by itself. A segment of which nothing is asked is not opened.
    """

    def tokens(left, right):
        import pandas as pd

        rows = []
        if len(left):
            s = Segment(left["payload"].iloc[0])
            for r in right.itertuples():
                n = int(s.starts[r.nth + 1] - s.starts[r.nth])
                if 0 <= r.position < n:
                    rows.append((r.doc_id, r.position, s.token(r.nth, r.position)))
        return pd.DataFrame(rows, columns=["doc_id", "position", "token"])

    index = segments.select(F.col("shard").alias("in_shard"), F.col("segment").alias("in_segment"), F.posexplode("doc_ids").alias("nth", "doc_id"))
    asked = index.join(wanted.select("doc_id", "position"), "doc_id")
    opened = segments.select("shard", "segment", "payload").join(asked.select("in_shard", "in_segment").distinct(), F.expr("shard = in_shard AND segment = in_segment"), "left_semi")
    return opened.groupBy("shard", "segment").cogroup(asked.groupBy("in_shard", "in_segment")).applyInPandas(tokens, "doc_id long, position long, token long")
