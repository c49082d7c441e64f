"""Fill-in-middle transformation by displacement scatter.

A text is cut into units (a run of ASCII letters, or one other code point). Two of its unit borders,
drawn from a hash of its id, part it into prefix, middle and suffix, which are written in another order
behind the marks <P>, <S> and <M>. Texts are not cut up one by one: the bytes of a batch lie in one buffer,
each part adds the change of its displacement to a difference array at its first byte, the running sum
of that array tells every byte how far it moves, and one numpy scatter writes all outputs. To restore
them, the marks of the outputs are found, the displacements follow from where they stand, and a gather
brings the bytes back; that needs the output and its form alone.

Null text is an empty text, and stays plain, as do texts that hold a mark themselves and a tenth of
all. Null ids are hashed as empty ones. Every row is worked on for itself: repeated rows and ids give equal
results, and cuts that tie leave an empty middle. Extra columns are ignored. An empty table gives an empty result.
Texts of any length are worked on whole: batches are taken in slices of kernel.SEGMENT bytes, and displacements of
a longer text are summed block by block, so that beside a text and its output some bytes a byte are held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SEGMENT, slices

#: The marks, and the orders of the parts (0 prefix, 1 middle, 2 suffix) with the mark before each.
MARKS = (b"<P>", b"<M>", b"<S>")
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Of 100 texts, those that are changed, and of 100 changed ones those in the order spm.
CHANGED, SPM = 90, 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIZE = len(MARKS[0])


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and where each text begins (one more than texts)."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


def _column(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buf))


def _marks(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the marks stand in a buffer, and which they are."""
    at = np.flatnonzero(buf[: max(len(buf) - 2, 0)] == MARKS[0][0])
    at = at[buf[at + 2] == MARKS[0][2]]
    which = np.full(len(at), -1)
    for k, mark in enumerate(MARKS):
        which[buf[at + 1] == mark[1]] = k
    return at[which >= 0], which[which >= 0]


def _unit_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte."""
    letter = _LETTER[buf]
    follows = np.zeros(len(buf) + 1, bool)
    follows[1:] = letter
    follows[offsets] = False
    return np.where(letter, ~follows[:-1], (buf & 0xC0) != 0x80)


class _Ranks:
    """Counts of set flags before a place, and places of the flag of a rank, from counts by block."""

    BLOCK = 4096

    def __init__(self, flags: np.ndarray):
        self.flags = flags
        whole = np.add.reduceat(flags, np.arange(0, len(flags), self.BLOCK), dtype=np.int64) if len(flags) else np.zeros(0, np.int64)
        self.before = np.concatenate(([0], np.cumsum(whole)))

    def count(self, places: np.ndarray) -> np.ndarray:
        block = places // self.BLOCK
        return self.before[block] + [np.count_nonzero(self.flags[b * self.BLOCK : p]) for b, p in zip(block.tolist(), places.tolist(), strict=True)]

    def place(self, ranks: np.ndarray) -> np.ndarray:
        """Of each rank from 0; the length of the flags beyond the last."""
        block = np.searchsorted(self.before, ranks, "right") - 1
        out = np.full(len(ranks), len(self.flags))
        for i in np.flatnonzero(block < len(self.before) - 1):
            b = block[i]
            out[i] = b * self.BLOCK + np.flatnonzero(self.flags[b * self.BLOCK : (b + 1) * self.BLOCK])[ranks[i] - self.before[b]]
        return out


def displaced(starts: np.ndarray, to: np.ndarray, size: int):
    """For blocks of `size` bytes: the block's own places and the places they move to.

    starts, ascending, are the first places of the parts and to where those go; of equal starts the last holds.
    """
    shift = to - starts
    change = np.diff(shift, prepend=0)
    moved, first = 0, 0
    for at in range(0, size, SEGMENT):
        end = min(at + SEGMENT, size)
        last = np.searchsorted(starts, end, "left")
        delta = np.zeros(end - at, np.int64)
        np.add.at(delta, starts[first:last] - at, change[first:last])
        places = np.cumsum(delta)
        places += moved
        moved, first = places[-1], last
        own = np.arange(at, end)
        places += own
        yield own, places


def _layout(parts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where parts, marks and outputs begin. parts: the three lengths of each text; order: the parts as written, or -1 for plain."""
    changed = order[:, 0] >= 0
    lens = parts.sum(axis=1) + np.where(changed, 3 * _SIZE, 0)
    begin = np.concatenate(([0], np.cumsum(lens)))
    to, marks = np.zeros_like(parts), np.zeros_like(parts)
    at = begin[:-1].copy()
    rows = np.arange(len(parts))
    for k in range(3):
        part = np.where(changed, order[:, k], k)
        marks[rows, part] = at
        at = at + np.where(changed, _SIZE, 0)
        to[rows, part] = at
        at = at + parts[rows, part]
    return to, marks, begin


_ORDER = {None: (-1, -1, -1), "plain": (-1, -1, -1)} | ORDERS


def cut(buf: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Units, forms, lengths in bytes of the three parts and characters of prefix and middle of each text; h: four draws a text."""
    flags = _unit_starts(buf, offsets)
    ranks = _Ranks(flags)
    first = ranks.count(offsets)
    n = np.diff(first)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    found = [np.where(cuts[:, j] == n, offsets[1:], ranks.place(first[:-1] + cuts[:, j])) for j in (0, 1)]
    at, _ = _marks(buf)
    text = np.searchsorted(offsets, at, "right") - 1
    marked = np.zeros(len(n), bool)
    marked[text[at + _SIZE <= offsets[text + 1]]] = True
    plain = marked | (np.diff(offsets) == 0) | (h[:, 2] % 100 >= CHANGED)
    form = np.where(plain, "plain", np.where(h[:, 3] % 100 < SPM, "spm", "psm")).tolist()
    parts = np.diff(np.stack([offsets[:-1], *found, offsets[1:]], axis=1), axis=1)
    chars = _Ranks((buf & 0xC0) != 0x80)
    held = np.stack([chars.count(p) for p in (offsets[:-1], *found)], axis=1)
    return n, form, parts, np.diff(held, axis=1)


def scatter(buf: np.ndarray, offsets: np.ndarray, parts: np.ndarray, form: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The outputs' bytes and where each begins."""
    order = np.array([_ORDER[f] for f in form], np.int64).reshape(-1, 3)
    to, marks, begin = _layout(parts, order)
    starts = offsets[:-1, None] + np.cumsum(parts, axis=1) - parts
    out = np.empty(begin[-1], np.uint8)
    for own, places in displaced(starts.ravel(), to.ravel(), len(buf)):
        out[places] = buf[own]
    changed = order[:, 0] >= 0
    for k, mark in enumerate(MARKS):
        out[marks[changed, k][:, None] + np.arange(_SIZE)] = np.frombuffer(mark, np.uint8)
    return out, begin


def gather(out: np.ndarray, begin: np.ndarray, form: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and where each begins, from outputs and forms."""
    order = np.array([_ORDER[f] for f in form], np.int64).reshape(-1, 3)
    changed = order[:, 0] >= 0
    parts = np.zeros((len(form), 3), np.int64)
    parts[:, 0] = np.diff(begin)
    if changed.any():
        at, which = _marks(out)
        text = np.searchsorted(begin, at, "right") - 1
        here = changed[text] & (at + _SIZE <= begin[text + 1])
        if np.count_nonzero(here) != 3 * np.count_nonzero(changed):
            raise ValueError("an output of a changed form must hold each mark once")
        borders = np.column_stack([at[here].reshape(-1, 3), begin[1:][changed]])
        rows = np.flatnonzero(changed)
        parts[changed] = 0
        parts[rows[:, None], which[here].reshape(-1, 3)] = np.diff(borders, axis=1) - _SIZE
    source, _, _ = _layout(parts, order)
    offsets = np.concatenate(([0], np.cumsum(parts.sum(axis=1))))
    starts = offsets[:-1, None] + np.cumsum(parts, axis=1) - parts
    texts = np.empty(offsets[-1], np.uint8)
    for own, places in displaced(starts.ravel(), source.ravel(), len(texts)):
        texts[own] = out[places]
    return texts, offsets


def transform(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and the output of every row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            h = np.stack([b.column(2 + k).to_numpy() for k in range(4)], axis=1)
            for i, j in slices(texts, 4096):
                buf, offsets = _buffer(texts.slice(i, j - i))
                n, form, parts, chars = cut(buf, offsets, h[i:j])
                plain = np.array([f == "plain" for f in form])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(i, j - i), "n": pa.array(n), "form": pa.array(form),
                    "prefix_chars": pa.array(chars[:, 0], mask=plain), "middle_chars": pa.array(chars[:, 1], mask=plain), "output": _column(*scatter(buf, offsets, parts, form)),
                })

    return docs.select(F.col(id_col).cast("long"), text_col, *draws).mapInArrow(run, SCHEMA)


def restore(made: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """made with the exact texts, rebuilt from their outputs and forms."""
    schema = made.select("*", F.lit("").alias(into)).schema

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(output)
            for i, j in slices(b.column(at), 4096):
                part = b.slice(i, j - i)
                texts = _column(*gather(*_buffer(part.column(at)), part.column(b.schema.get_field_index(form)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*b.schema.names, into])

    return made.mapInArrow(run, schema)


def digest(made: DataFrame) -> DataFrame:
    """Hashes in place of the texts."""
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
