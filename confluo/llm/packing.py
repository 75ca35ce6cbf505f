"""Packing by power-of-two decomposition.

A document's ids are cut into pieces of 1024, then one piece for each set bit of what is left, largest first. Each
piece is a sequence of its own in the bucket of its length, so no sequence crosses documents and none is padded.

Defined results: a null text is empty and has the end id alone; a null doc_id stays null; repeated rows each make
their own sequences; an empty table gives none; other columns are ignored. Sequences are numbered without gaps,
bucket after bucket, the longest first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, saved, texts
from .encoder import encoder

MAX_LENGTH = 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def cut(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of a document's pieces; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(path: str, end_id: int | None, longest: int, with_ids: bool):
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code, seen = TaskContext.get().partitionId(), encoder(path), {}
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            held = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids, at, doc = code.ids(text.as_py()) + end, 0, doc.as_py()
                total = len(ids) // 4
                for n in cut(total, longest):
                    piece = ids[4 * at : 4 * (at + n)]
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    for c, v in zip(cols, (doc, at, n, zlib.crc32(piece), total, nth), strict=True):
                        c.append(v)
                    at += n
                if with_ids:
                    held.append(ids)
            arrays = [pa.array(c, pa.int64()) for c in cols]
            arrays.insert(5, pa.array([part] * len(cols[0]), pa.int32()))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
            if with_ids:
                places = np.zeros(len(cols[0]) + 1, dtype=np.int32)
                np.cumsum(cols[2], out=places[1:])
                flat = np.frombuffer(b"".join(held), "<u4").astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(places), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def decompose(docs: DataFrame, vocabulary: str, *, end_id: int | None, longest: int = MAX_LENGTH, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece, as its own sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on demand the ids.

    No text is shuffled. A task numbers its pieces within each length; the tasks' counts, a few numbers for each
    task, then give every task its first number.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest is a power of two")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), texts(docs, text).alias("text"))
    with batches(docs.sparkSession):
        cut_up, _ = saved(rows.mapInArrow(_pieces(vocabulary, end_id, longest, with_ids), PIECES + (", ids array<int>" if with_ids else "")), "pieces")
    counts = cut_up.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts, _ = saved(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "piece-counts")
    sums, at = {}, 0
    for length, n in sorted(counts.groupBy("length").agg(F.sum("n")).collect(), reverse=True):
        sums[length], at = at, at + n
    base = F.create_map(*[F.lit(x).cast("long") for kv in sums.items() for x in kv]) if sums else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    out = cut_up.join(counts.drop("n"), ["length", "part"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (base[F.col("length")] + F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    return out.select(*columns, *(["ids"] if with_ids else []))
