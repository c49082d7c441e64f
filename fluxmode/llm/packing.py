"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents of its input partition as they come, without a shuffle. A document's
ids are cut into full windows and one tail; the tail goes whole into an open window of that fill
level h for which the sum of squares of the counts of partially filled windows, kept in a level
array, becomes least (h = 0 opens a window). When the stream ends, or too many windows are open,
the emptiest windows are cut up to top off the fullest; what is left of the last one is laid into
windows whose lengths are powers of two, which need no padding. So no window is padded.

Null text is an empty text: it has the end id alone. Every row is packed for itself, also repeated
ones; ids may be null. Texts of any length are encoded whole, runs of white space of 10,000 characters and more as the
pieces that the vocabulary's pattern makes of them. Extra columns are ignored. An empty table gives no pieces. A task's result
depends on its own input partition only, and a rerun of a scan gives the same pieces.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END_ID = 1024, 0
#: Open windows (of at most WINDOW ids each) before they are consolidated; bounds a task's memory.
MAX_OPEN = 4096
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class LevelPacker:
    """Windows of `size` ids; counts[h] is the number of open windows filled to level h."""

    def __init__(self, size: int, first_id: int, max_open: int = MAX_OPEN):
        self.size, self.next, self.max_open, self.n_open = size, first_id, max_open, 0
        self.counts = np.zeros(size + 1, np.int64)
        self.levels: list[list] = [[] for _ in range(size)]
        self.done: list[tuple] = []  # pieces with sequence_id and offset

    def _close(self, pieces: list) -> None:
        at = 0
        for p in pieces:
            self.done.append((*p, self.next, at))
            at += len(p[2]) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        n, full = len(ids) // 4, len(ids) // 4 // self.size * self.size
        for s in range(0, full, self.size):
            self._close([(doc, s, ids[4 * s : 4 * (s + self.size)], n)])
        if n > full:
            self._place((doc, full, ids[4 * full :], n), n - full)
        if self.n_open > self.max_open:
            self.drain()

    def _place(self, piece: tuple, s: int) -> None:
        """Choose h to minimise the change of the sum of squared counts; of equals the fullest."""
        top = self.size - s
        change = 2 * (self.counts[s : self.size + 1] - self.counts[: top + 1]) + 2
        change[0] = 2 * self.counts[s] + 1
        change[top] = -2 * self.counts[top] + 1
        change[1:][self.counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        h = top - int(np.argmin(change[::-1]))
        if h:
            window = self.levels[h].pop()
            self.counts[h] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if h + s == self.size:
            self._close(window)
        else:
            self.levels[h + s].append(window)
            self.counts[h + s] += 1
            self.n_open += 1

    def drain(self) -> None:
        """Close every open window without padding."""
        open_ = [(h, w) for h in range(self.size - 1, 0, -1) for w in self.levels[h]]
        self.levels, self.n_open = [[] for _ in range(self.size)], 0
        self.counts[:] = 0
        low, high = len(open_) - 1, 0
        spare: list = []  # pieces of the window being cut up
        while high <= low or spare:
            if high > low:  # nothing left to fill: lay the rest into powers of two
                left = sum(len(p[2]) // 4 for p in spare)
                if left:
                    self._close(self._take(spare, 1 << (left.bit_length() - 1)))
                continue
            if not spare and high == low:
                spare, low = open_[low][1], low - 1
                continue
            h, window = open_[high]
            if not spare:
                spare, low = open_[low][1], low - 1
            window = window + self._take(spare, self.size - h)
            h = sum(len(p[2]) // 4 for p in window)
            if h == self.size:
                self._close(window)
                high += 1
            else:
                open_[high] = (h, window)

    @staticmethod
    def _take(pieces: list, n: int) -> list:
        """Cut n ids off a list of pieces, in place."""
        got = []
        while n and pieces:
            doc, start, ids, total = pieces[0]
            m = len(ids) // 4
            if m <= n:
                got.append(pieces.pop(0))
                n -= m
            else:
                got.append((doc, start, ids[: 4 * n], total))
                pieces[0] = (doc, start + n, ids[4 * n :], total)
                n = 0
        return got


#: How a byte-level vocabulary splits a text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in runs that the pattern, which looks ahead after each, would search with a stack as deep as they are long.
_LONG_SPACE = re.compile("(?<![{0}])[{0}]{{10000,}}".format("\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"))


def encoder(path: str):
    """text -> ids of the byte-level tokenizer file at path; special tokens in a text have their own ids, as with its library.

    The file's vocabulary is in merge order, so its ids serve as merge ranks: that gives the ids the
    file's own library gives, in a third of the time.
    """
    import tiktoken

    with open(path) as f:  # a file of the installed tokenizer package, on every executor
        file = json.load(f)
    vocabulary, special = file["model"]["vocab"], {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    # byte-level files write each byte as one printable character
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special and all(c in byte_of for c in token)}
    made = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    ids_of = lambda text: made.encode(text, allowed_special="all")

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            begin, end = run.span()
            # the pattern leaves a run's last character to what follows, if that is text
            end -= end < len(text) and not any(text.startswith(s, end) for s in special)
            out += ids_of(text[at:begin])
            out += made._encode_single_piece(text[begin:end])
            at = end
        return out + ids_of(text[at:]) if at else ids_of(text)

    return encode


_loaded: dict = {}


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit): doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        if tokenizer_path not in _loaded:
            _loaded[tokenizer_path] = encoder(tokenizer_path)
        ids_of = _loaded[tokenizer_path]
        packer = LevelPacker(window, TaskContext.get().partitionId() << 40)

        def pieces():
            done, packer.done = packer.done, []
            for at in range(0, len(done), 8192):
                doc, start, ids, total, seq, offset = zip(*done[at : at + 8192], strict=True)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary()), "doc_tokens": pa.array(total, pa.int64()), "sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(offset, pa.int64()),
                })

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packer.add(doc, array("I", ids_of(text or "")).tobytes() + end)
                yield from pieces()
        packer.drain()
        yield from pieces()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows themselves: sequence_id, ids (array of its pieces' ids in order), n_tokens, padded_to."""
    n = F.sum("length")
    return pieces.groupBy("sequence_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]).alias("ids"),
        n.alias("n_tokens"),
        F.when(F.expr("bit_count(sum(length)) = 1"), n).otherwise(F.lit(window).cast("long")).alias("padded_to"),
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
