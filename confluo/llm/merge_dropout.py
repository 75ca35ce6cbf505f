"""SentencePiece encoding with seeded merge dropout, and decoding.

The pieces and scores of a merge-type model drive an agenda: of all candidate merges of two neighbours, the one of the
highest score, then the leftmost, comes first. A candidate is skipped for good if its keyed hash falls below the dropout
rate; otherwise the two symbols merge and new candidates arise. The key of a candidate is made of seed, document, place
of the word in the document and the candidate's turn on the agenda, so every occurrence of a word draws for itself, and
any task gives a text the same ids again. Without dropout the ids are the library's own. Rates are multiples of 2 ** -16.

No piece joins a word to the next one's leading space, so words are encoded one by one. An occurrence's draws decide
which turns are skipped; what a word becomes by given skipped turns is kept in a bounded memo, and so is the number of
turns, which tells without an agenda that an occurrence skips nothing.

Characters without a piece become byte pieces, among them the model's own space mark, so every text decodes to itself.

Defined results: a null or empty text has no ids and decodes to an empty one; a null doc_id has a key of its own;
rows that repeat a doc_id draw alike, so repeated rows have equal ids; of equal scores the leftmost merge comes first;
words of any length are encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import short_batches, texts

RATE = 0.1
#: Entries of each of a worker's two memos, about 250 bytes each.
MEMO_WORDS = 1_000_000
#: Longer words run their agenda on a heap and are not kept.
LONG = 48
#: Turns whose draws are made for all words of a text together.
TURNS = 8

SPACE = "▁"
#: Stands for a literal space mark in symbols; no piece has this noncharacter.
_NO_SPACE = "\uffff"
_WORD = re.compile(r" *[^ \n]+|\n| +").findall
_M1, _M2, _M3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(LONG + 1)]


def _mixed(x: int) -> int:
    x = (x ^ (x >> 30)) * _M2 & _MASK
    x = (x ^ (x >> 27)) * _M3 & _MASK
    return x ^ (x >> 31)


def _mixed_all(x: np.ndarray) -> np.ndarray:
    """_mixed of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M3)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The vocabulary of a model file and the merges that it allows."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_at = next(i for i in range(n) if sp.is_byte(i))
        self.id_of = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.text = [b""] * n
        for p, i in self.id_of.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b in range(256):
            self.text[self.bytes_at + b] = bytes([b])
        # Scores by rank, from 0; pieces of equal scores share one.
        rank = np.unique([sp.get_score(i) for i in range(n)], return_inverse=True)[1].tolist()
        self.rank = {p: rank[i] for p, i in self.id_of.items() if len(p) > 1}
        self.encode = sp.encode


class Encoder(dict):
    """(ids as little-endian unsigned 32-bit integers, turns) of words without a skipped turn; ``varied`` has the others by (word, skipped turns)."""

    def __init__(self, path: str, rate: float, seed: int):
        super().__init__()
        self.pieces, self.seed, self.varied = Pieces(path), seed, {}
        self.limit = round(rate * (1 << 16))

    # The chance of a turn: four draws of 16 bits in each hash of an occurrence's key.

    def key(self, doc_id: int | None) -> int:
        return xxhash.xxh3_64_intdigest(b"" if doc_id is None else struct.pack("<q", doc_id), seed=self.seed & _MASK)

    def skips(self, key: int, turn: int) -> bool:
        return (_mixed((key + (turn >> 2) * _M1) & _MASK) >> 16 * (turn & 3)) & 0xFFFF < self.limit

    def _draws(self, key: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a text's n words, and a bit for each of their first TURNS turns that is skipped."""
        with np.errstate(over="ignore"):
            keys = _mixed_all(np.uint64(key) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_M3))
            bits = np.zeros(n, dtype=np.int64)
            for turn in range(0, TURNS, 4):
                drawn = _mixed_all(keys + np.uint64((turn >> 2) * _M1 & _MASK)).view("<u2").reshape(-1, 4)
                for k in range(4):
                    bits |= (drawn[:, k] < self.limit).astype(np.int64) << (turn + k)
        return keys, bits

    @staticmethod
    def _symbols(word: str) -> list[str]:
        """One for each character; a literal space mark is no space and has none of the vocabulary's pieces."""
        return list((word.replace(SPACE, _NO_SPACE) if SPACE in word else word).replace(" ", SPACE))

    def _packed(self, symbols: list[str]) -> bytes:
        get = self.pieces.id_of.__getitem__
        try:
            out = list(map(get, symbols))
        except KeyError:
            out, known = [], self.pieces.id_of
            for x in symbols:
                out += [known[x]] if x in known else [self.pieces.bytes_at + b for b in x.replace(_NO_SPACE, SPACE).encode("utf-8", "surrogatepass")]
        return _PACKERS[len(out)](*out) if len(out) < len(_PACKERS) else struct.pack(f"<{len(out)}I", *out)

    def short(self, word: str, skipped: int) -> tuple[bytes, int]:
        """A word by its skipped turns (a bit each), and its number of turns."""
        rank, x = self.pieces.rank.get, self._symbols(word)
        best = list(map(rank, map(add, x, x[1:]), repeat(-1)))
        best.append(-1)
        turn, last, find, cut, pop = 0, len(x) - 1, best.index, best.__delitem__, x.pop
        while (top := max(best)) >= 0:
            j = find(top)
            if skipped >> turn & 1:
                best[j] = -1
            else:
                x[j] = m = x[j] + pop(j + 1)
                cut(j)
                last -= 1
                if j:
                    best[j - 1] = rank(x[j - 1] + m, -1)
                if j < last:
                    best[j] = rank(m + x[j + 1], -1)
            turn += 1
        return self._packed(x), turn

    def long(self, word: str, key: int) -> bytes:
        """A word of any length by a heap agenda."""
        rank, x = self.pieces.rank.get, self._symbols(word)
        n, turn = len(x), 0
        nxt, prev = [*range(1, n), -1], [*range(-1, n - 1)]
        agenda: list[tuple[int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if (r := rank(m := x[a] + x[b])) is not None:
                heapq.heappush(agenda, (-r, a, m))

        for a in range(n - 1):
            offer(a, a + 1)
        while agenda:
            _, a, m = heapq.heappop(agenda)
            # Merged symbols leave an empty string behind.
            b = nxt[a] if x[a] else -1
            if b < 0 or x[a] + x[b] != m:
                continue
            turn += 1
            if self.skips(key, turn - 1):
                continue
            x[a], x[b], nxt[a] = m, "", nxt[b]
            if nxt[b] >= 0:
                prev[nxt[b]] = a
                offer(a, nxt[a])
            if prev[a] >= 0:
                offer(prev[a], a)
        return self._packed([s for s in x if s])

    def __missing__(self, word: str) -> tuple[bytes, int]:
        out = self.short(word, 0) if len(word) <= LONG else (b"", -1)
        if len(self) >= MEMO_WORDS:
            self.clear()
        if out[1] >= 0:
            self[word] = out
        return out

    def _learn(self, words: list[str]) -> None:
        """New words without a skipped turn by the library itself; a turn is a merge, so symbols less pieces are the turns."""
        new = [w for w in set(words) if w not in self and 1 < len(w) <= LONG and w[0] == " " and SPACE not in w]
        if len(self) + len(new) > MEMO_WORDS:
            self.clear()
        lo = self.pieces.bytes_at
        for w, ids in zip(new, self.pieces.encode([w[1:] for w in new], num_threads=1) if new else [], strict=True):
            if not any(lo <= i < lo + 256 for i in ids):
                self[w] = _PACKERS[len(ids)](*ids), len(w) - len(ids)

    def _occurrence(self, word: str, turns: int, key: int, bits: int) -> bytes:
        """A word of which the first skipped turn lies within its agenda."""
        skipped, turn, found = 0, 0, None
        while turn < turns:
            if bits >> turn & 1 if turn < TURNS else self.skips(key, turn):
                skipped |= 1 << turn
                found = self.varied.get((word, skipped))
                if found is None:
                    if len(self.varied) >= MEMO_WORDS:
                        self.varied.clear()
                    found = self.varied[word, skipped] = self.short(word, skipped)
                turns = found[1]
            turn += 1
        return self[word][0] if found is None else found[0]

    def ids(self, doc_id: int | None, text: str) -> bytes:
        """Ids of a whole text."""
        if not text:
            return b""
        words = _WORD(" " + text)
        self._learn(words)
        out, turns = map(list, zip(*map(self.__getitem__, words), strict=True))
        turns = np.array(turns)
        if not self.limit:
            for i in np.flatnonzero(turns < 0).tolist():
                out[i] = self.long(words[i], 0)
            return b"".join(out)
        keys, bits = self._draws(self.key(doc_id), len(words))
        inside = (np.int64(1) << np.clip(turns, 0, TURNS)) - 1
        for i in np.flatnonzero((turns < 0) | (turns > TURNS) | (bits & inside != 0)).tolist():
            n = int(turns[i])
            out[i] = self.long(words[i], int(keys[i])) if n < 0 else self._occurrence(words[i], n, int(keys[i]), int(bits[i]))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        text = self.pieces.text
        out = b"".join([text[i] for i in ids.tolist()])
        return out[1:].decode("utf-8", "surrogatepass") if out else ""


_LOADED: dict[tuple[str, float, int], Encoder] = {}


def encoder(path: str, rate: float = RATE, seed: int = 0) -> Encoder:
    """The worker's encoder; kept while the worker lives."""
    key = (path, rate, seed)
    if key not in _LOADED:
        _LOADED[key] = Encoder(*key)
    return _LOADED[key]


def encode(docs: DataFrame, model: str, *, rate: float = RATE, seed: int = 0, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 of the little-endian unsigned 32-bit ids, decoded (whether they decode to the text), and the ids."""
    if not 0 <= rate <= 1:
        raise ValueError("the rate is from 0 to 1")
    short_batches(docs.sparkSession)
    columns = "doc_id long, n_tokens long, ids_crc32 long, decoded boolean" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(model, rate, seed)
        for batch in batches:
            cols: list[list] = [[] for _ in range(3)]
            held = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = code.ids(doc, text)
                values = np.frombuffer(ids, "<u4")
                for c, v in zip(cols, (len(values), zlib.crc32(ids), code.decode(values) == text), strict=True):
                    c.append(v)
                if with_ids:
                    held.append(pa.array(values.astype(np.int32)))
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cols[0])].astype(np.int32)), pa.concat_arrays(held) if held else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in columns.split(", ")])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), texts(docs, text).alias("text")).mapInArrow(run, columns)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """Rows with an array column ``ids`` get a column ``text``."""
    from pyspark.sql.functions import pandas_udf

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        code = encoder(model, 0.0, 0)
        for batch in batches:
            yield pd.Series([code.decode(np.asarray(x, dtype=np.int64)) if x is not None else None for x in batch], dtype=object)

    return rows.withColumn("text", pandas_udf(run, "string")("ids"))
