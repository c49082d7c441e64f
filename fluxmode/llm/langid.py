"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, whatever is not a letter becomes one space, and the n-grams of 1 to 3 code
points of a whole text are hashed into BUCKETS features. Counts are gathered per language in the
tasks and summed by Spark; the log-probability matrix (languages x BUCKETS) is broadcast, and
batches are scored as sparse matrices of counts times that matrix.

The model may learn from a bounded sample: about MAX_PER_LANG rows of each language, those whose
hashed ids are least. A text that is null or has no letter (Unicode category L) gets `und` with score 0; so does every
text when nothing could be learned. Of equally likely languages the first in order wins. Repeated
rows are scored each for itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
MAX_PER_LANG = 20_000
#: Code points worked on at once.
SEGMENT = 1 << 16
#: Code points of a block of texts that is scored at once.
BLOCK = 1 << 19
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Numeric characters that \w holds besides digits (fractions, numerals in rings) and that are no letters.
_NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_BLANKED = dict.fromkeys(map(ord, _NUMERALS), " ")


def plain(text: str | None) -> str:
    """Lower-cased letters with single spaces around words; empty without a letter."""
    t = (text or "").lower()
    if not t.isascii() and not _NUMERALS.isdisjoint(t):
        t = t.translate(_BLANKED)
    words = _NOT_LETTERS.sub(" ", t).strip()
    return f" {words} " if words else ""


def sparse(parts: list[str], starts: np.ndarray):
    """Hashed n-grams of plain texts as rows of a sparse matrix of counts, one for each order: entries by row, and their columns.

    Only the n-grams that begin at the first `starts` code points of a part count; none crosses from one part to the next.
    """
    c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(p) for p in parts], np.int64)
    place = np.arange(len(c)) - np.repeat(np.cumsum(lens) - lens, lens)
    h = np.zeros(len(c), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        m = max(len(c) - order + 1, 0)
        h = (h[:m] + c[order - 1 :]) * np.uint32(0x9E3779B1)
        if order in ORDERS:
            entries = np.maximum(np.minimum(starts, lens - order + 1), 0)
            columns = ((h ^ np.uint32(order * 0x2C1B3C6D)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            yield entries, columns[place[:m] < np.repeat(entries, lens)[:m]]
        h ^= h >> np.uint32(15)


def parts_of(text: str) -> list[str]:
    """A plain text in parts of SEGMENT code points, with what the last n-grams of each need of the next."""
    return [text[at : at + SEGMENT + max(ORDERS) - 1] for at in range(0, len(text), SEGMENT)]


def features(text: str):
    """Hashed n-grams of one plain text, in parts of about SEGMENT code points."""
    for part in parts_of(text):
        for _, columns in sparse([part], np.array([min(SEGMENT, len(part))])):
            yield columns


class Model:
    """langs in order, and log priors and log probabilities by language."""

    def __init__(self, langs: list[str], rows: np.ndarray, counts: np.ndarray):
        self.langs = langs
        if langs:
            p = counts + SMOOTHING
            self.matrix = np.ascontiguousarray(np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32))
            self.prior = np.log(rows / rows.sum())

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """Languages and scores of a batch: its texts are the rows of a sparse matrix, taken by blocks of rows times the log probabilities."""
        log, known = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        rows, parts, held = [], [], 0
        for i, text in enumerate(map(plain, texts)):
            known[i] = bool(text) and bool(self.langs)
            for part in parts_of(text) if known[i] else ():
                rows.append(i)
                parts.append(part)
                held += len(part)
                if held >= BLOCK:
                    self._add(log, rows, parts)
                    rows, parts, held = [], [], 0
        self._add(log, rows, parts)
        if not known.any():
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        log += self.prior
        best = log.argmax(axis=1)
        score = np.where(known, 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], score.tolist()

    def _add(self, log: np.ndarray, rows: list[int], parts: list[str]) -> None:
        """The product of a sparse block with the matrix, added to the rows that its parts belong to."""
        if not parts:
            return
        for entries, columns in sparse(parts, np.minimum([len(p) for p in parts], SEGMENT)):
            some = np.flatnonzero(entries)
            if len(some):
                begin = (np.cumsum(entries) - entries)[some]
                np.add.at(log, np.array(rows)[some], np.add.reduceat(self.matrix[columns], begin, axis=0, dtype=float))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, max_per_lang: int = MAX_PER_LANG) -> Model:
    rows = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS)))
    share = F.create_map(*(x for g in langs for x in (F.lit(g), F.lit(min(1.0, max_per_lang / sizes[g])))))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= F.element_at(share, F.col("lang")) * (1 << 30)).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for f in features(plain(text)):
                    own += np.bincount(f, minlength=BUCKETS)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    # at most languages x BUCKETS sums reach the driver
    got = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), BUCKETS))
    order = {g: i for i, g in enumerate(langs)}
    counts[[order[g] for g in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, np.array([sizes[g] for g in langs], float), counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            langs, scores = sent.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
