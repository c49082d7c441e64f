"""Quality scores by a regularised quadratic discriminant over document statistics.

A document becomes a vector of transformed statistics of its whole text (STATISTICS). For each class
the mean and the covariance are estimated from a bounded sample of labelled rows; the covariances
are shrunk toward the pooled one and toward its diagonal, and their Cholesky factors are computed
once and sent with the tasks. A score is the posterior of label 1 from the difference of the two
log densities (half the Mahalanobis distances and log determinants) plus the log prior odds.

Null and empty texts have the statistics of an empty text and get a score like any other; labels
that are null or not 0 or 1 are ignored, and of repeated labels of a document any one of the lowest
value counts. A very long text costs its length. Ties do not arise: a score at the threshold is accepted. Without labels of both classes every score is 0.5. Extra columns are ignored by
scores() and kept by keep().
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows to learn from at most: those whose hashed ids are least.
MAX_LABELLED = 20_000
#: Shrinkage of each covariance toward the pooled one and toward its diagonal.
POOLED, DIAGONAL = 0.02, 0.005
#: Statistics of a text of n bytes are drawn toward the mean of label 1 by the root of n / (n + SHORT):
#: shares of a few words say little. Drawn and scaled statistics end at LIMIT deviations.
SHORT, LIMIT = 400, 8.0
THRESHOLD = 0.7
STATISTICS = (
    "upper_share", "symbol_share", "digit_share", "stop_share", "comma_share", "bar_share", "newline_share",
    "space_share", "log_word_length", "long_word_share", "distinct_share", "repeat_share", "capital_share", "byte_entropy", "short_word_share",
)
_CLASS = np.zeros((256, 9))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!*#$%&@~^_+=<>\\/{}[]", b"0123456789", b".?", b",;:'\"()-", b"|", b"\n", b" \t\r\x0b\x0c")):
    _CLASS[list(_chars), _i] = 1
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)], 8] = 1
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    t = (text or "").encode("utf-8", "surrogatepass")
    n = len(t)
    freq = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    upper, symbol, digit, stop, comma, bar, newline, space, letters = freq @ _CLASS
    p = freq[freq > 0] / max(n, 1)
    words = t.split()
    m = len(words)
    lens = np.fromiter(map(len, words), np.int64, m) if m else np.zeros(1, np.int64)
    lines = t.split(b"\n")
    root = lambda x: math.sqrt(max(0.0, x))
    # distinct words against what a text of this length has: Heaps' law with exponent 0.8
    return [
        root(upper / max(letters, 1)), root(symbol / max(n, 1)), root(digit / max(n, 1)), root(stop / max(n, 1)), root(comma / max(n, 1)),
        root(bar / max(n, 1)), root(newline / max(n, 1)), root(space / max(n, 1)), math.log1p(float(lens.mean())), root(float((lens > 14).mean())),
        len(set(words)) / max(m, 1) ** 0.8, root(1 - len(set(lines)) / len(lines)), root(sum(map(bytes.istitle, words)) / max(m, 1)),
        float(-(p * np.log2(p)).sum()), root(float((lens <= 3).mean())),
    ]


class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, and log priors."""

    def __init__(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL):
        self.usable = bool(len(y)) and 0 < y.sum() < len(y)
        if not self.usable:
            return
        self.centre, self.scale = x[y == 1].mean(0), x.std(0) + 1e-9
        z = self._drawn(x, size)
        common = np.atleast_2d(np.cov(z.T))
        self.classes = []
        for label in (0, 1):
            own = z[y == label]
            cov = np.cov(own.T) if len(own) > 1 else common
            cov = (1 - pooled) * cov + pooled * common
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-6 * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.classes.append((own.mean(0), np.linalg.inv(factor), math.log(len(own) / len(z)) - np.log(np.diag(factor)).sum()))

    def _drawn(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale * np.sqrt(size / (size + SHORT))[:, None]
        return np.clip(z, -LIMIT, LIMIT)

    def score(self, texts: list) -> np.ndarray:
        if not self.usable or not texts:
            return np.full(len(texts), 0.5)
        z = self._drawn(np.array([statistics(t) for t in texts]), sizes(texts))
        density = [c - 0.5 * np.square((z - mean) @ inverse.T).sum(1) for mean, inverse, c in self.classes]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def sizes(texts: list) -> np.ndarray:
    return np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], float)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Discriminant:
    """Learn from labelled rows outside the held-out fold; about max_labelled of them reach the driver, as vectors."""
    rows = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = rows.count()
    if n > max_labelled:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    near = F.broadcast(rows.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y")))  # at most about max_labelled short rows

    def measure(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes(texts)), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], ["y", "size", "x"])

    found = docs.select("doc_id", "text").join(near, F.col("doc_id") == F.col("_id")).select(F.col("_y").cast("int"), "text").mapInArrow(measure, "y int, size double, x array<double>").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
    return Discriminant(x, found["size"].to_numpy(), found["y"].to_numpy())


def scores(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(b.column(1).to_pylist()))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Discriminant) -> DataFrame:
    """The rows of docs whose score reaches THRESHOLD, with all their columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(sent.value.score(b.column(at).to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
