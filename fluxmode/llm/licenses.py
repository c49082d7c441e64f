"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed, and the hashes are joined to the places where the k-grams of the
templates stand. A hit votes for a diagonal, the text's place less the template's; its words are compared, so that
a vote is never owed to a hash. Votes are summed by text, template and diagonal. A copied notice lies on one diagonal, an
edited one on neighbouring ones: the diagonals from one up to BAND above it are taken together, and the span counts
if the words that their votes cover, of the template and of the text, are FOUND of the template's words or more. Of
anchors within BAND of each other the best stays, then the first; a span within a longer one goes.

Phrases are templates that must stand whole, on one diagonal; each place of one counts, and none is merged or dropped.
Shorter templates than K words have k-grams of all their words. The templates are a bounded list (MAX_WORDS), whose
k-grams are broadcast; tasks keep only hashes that occur in it, which is the join's own condition tried early.

Words are of digits, letters and all characters beyond ASCII, A-Z lower-cased. Null text is an empty text: no words, no
labels, score 0. Every row is judged for itself, repeated rows and ids included; null ids stay null. Extra columns are ignored.
Texts are read whole, in parts of kernel.SEGMENT bytes that overlap by K - 1 words. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored
from .kernel import SEGMENT, mix, slices, windows, word_places

#: Words of a k-gram, neighbouring diagonals taken together, share of a template's words that a span must hold, words of all templates.
K, BAND, FOUND, MAX_WORDS = 5, 8, 0.8, 100_000
# fixed values: the phrases of the contract, and the wording of public licenses and notices
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under cc by"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by-nc-sa", "licensed under cc by nc sa"),
    ("cc-by-nc-nd", "licensed under cc by nc nd"),
    ("all-rights-reserved", "no part of this publication may be reproduced stored in a retrieval system or transmitted in any form or by any means"),
)
_APART = np.zeros(256, bool)
_APART[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART[65:91] = False
_HITS = "rid long, doc_id long, n_words long, place long, k int, key long, gram string"


def _keys(h: np.ndarray, k: int) -> np.ndarray:
    return mix(windows(h, k) ^ np.uint64(k)).view(np.int64)


def _words(text: str) -> tuple[list[str], np.ndarray]:
    buf = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, h = word_places(buf, _APART)
    return [bytes(buf[s:e]).decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], h


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(t, label, phrase, m, k, tpos, key, gram): the k-grams of all templates; t numbers them."""
    out, n = [], 0
    for t, (label, text) in enumerate([*phrases, *notices]):
        words, h = _words(text)
        n += len(words)
        if not words or n > MAX_WORDS:
            raise ValueError(f"templates need words, at most {MAX_WORDS} together")
        m = len(words)
        k = m if t < len(phrases) else min(K, m)
        out += [(t, label, t < len(phrases), m, k, i, key, " ".join(words[i : i + k])) for i, key in enumerate(_keys(h, k).tolist())]
    return out


class _Seen:
    """Which hashes are among a set: by some of their bits, then by search."""

    def __init__(self, keys: list[int]):
        self.keys = np.unique(np.array(keys, np.int64))
        self.mask = np.int64((1 << max(16, (64 * len(self.keys)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[self.keys & self.mask] = True

    def places(self, keys: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[keys & self.mask])
        found = np.searchsorted(self.keys, keys[at])
        return at[self.keys[np.minimum(found, len(self.keys) - 1)] == keys[at]]


def _parts(column: pa.Array):
    """(rows, buffer, begins): byte buffers of whole texts, or of parts of a longer one, lower-cased; and the row range they are of."""
    for i, j in slices(column, 4096):
        texts = [(t or "").encode() for t in column.slice(i, j - i).to_pylist()]
        yield i, j, _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)], np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))


def hits(docs: DataFrame, grams: list[tuple], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each k-gram of a text that may be a template's, and one with n_words for each text; stored."""
    ks = sorted({g[4] for g in grams})
    keys = {k: [g[6] for g in grams if g[4] == k] for k in ks}
    carry = ks[-1] - 1

    def run(batches):
        seen = {k: _Seen(v) for k, v in keys.items()}

        def found(buf, starts, ends, h, inside, skip):
            """(word, k, key, gram) of the hits; inside: the last word of each word's text; windows within the first `skip` words are known."""
            for k in ks:
                key = _keys(h, k)
                for i in seen[k].places(key).tolist():
                    if i + k - 1 <= inside[i] and i + k > skip:
                        yield i, k, key[i].item(), b" ".join(bytes(buf[s:e]) for s, e in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist(), strict=True)).decode()

        for b in batches:
            rid, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j, buf, begin in _parts(b.column(2)):
                out, counts = [], np.zeros(j - i, np.int64)
                if j - i > 1 or len(buf) <= SEGMENT:
                    starts, ends, h = word_places(buf, _APART)
                    first = np.searchsorted(starts, begin)
                    counts = np.diff(first)
                    text = np.repeat(np.arange(j - i), counts)
                    for w, k, key, gram in found(buf, starts, ends, h, first[1:][text] - 1, 0):
                        row = text[w].item()
                        out.append((rid[i + row], ids[i + row], None, w - first[row].item(), k, key, gram))
                else:
                    at, end, base, skip = 0, 0, 0, 0
                    while at < len(buf):
                        end = min(end + SEGMENT, len(buf))
                        while end < len(buf) and not _APART[buf[end]]:
                            end += 1
                        part = buf[at:end]
                        starts, ends, h = word_places(part, _APART)
                        out += [(rid[i], ids[i], None, base + w, k, key, gram) for w, k, key, gram in found(part, starts, ends, h, np.full(len(h), len(h) - 1), skip)]
                        counts[0] = base + len(h)
                        yield from _rows(out)
                        out = []
                        if end == len(buf):
                            break
                        skip = min(carry, len(h))
                        base, at = base + len(h) - skip, at + int(starts[len(h) - skip]) if skip else end
                out += [(rid[r], ids[r], int(n), None, None, None, None) for r, n in zip(range(i, j), counts, strict=True)]
                yield from _rows(out)

    return stored(docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), text_col).mapInArrow(run, _HITS), "license-hits")


def _rows(out: list[tuple]):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    for at in range(0, len(out), 8192):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 8192], strict=True), types, strict=True)], [c.split()[0] for c in _HITS.split(", ")])


def spans(found: DataFrame, grams: list[tuple]) -> DataFrame:
    """rid, doc_id, label, phrase, start, stop (words), score for each phrase and notice in the hits."""
    spark: SparkSession = found.sparkSession
    places = spark.createDataFrame(grams, "t int, label string, phrase boolean, m int, k int, tpos int, key long, gram string")
    votes = found.where("place IS NOT NULL").join(F.broadcast(places), ["k", "key", "gram"])
    # the place of a vote on its diagonal follows from the template's, so one array holds both
    lines = votes.groupBy("rid", "doc_id", "t", "label", "phrase", "m", "k", (F.col("place") - F.col("tpos")).alias("diagonal")).agg(F.array_sort(F.collect_list("tpos")).alias("at"))
    whole = lines.where("phrase").select("rid", "doc_id", "label", "phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("m")).alias("stop"), F.lit(1.0).alias("score"))

    band = Window.partitionBy("rid", "t").orderBy("diagonal").rangeBetween(0, BAND)
    near = Window.partitionBy("rid", "t").orderBy("diagonal").rangeBetween(-BAND, BAND)
    words = lambda shift: F.array_distinct(F.flatten(F.transform("band", lambda l: F.flatten(F.transform(l["at"], lambda p: F.sequence(p + shift(l), p + shift(l) + F.col("k") - 1))))))
    covered = lines.where("NOT phrase").withColumns({"voted": F.sum(F.size("at")).over(band), "band": F.collect_list(F.struct("diagonal", "at")).over(band)})
    covered = covered.where(F.col("voted") * F.col("k") >= F.col("m") * FOUND)
    covered = covered.withColumns({"of": words(lambda l: F.lit(0).cast("long")), "held": words(lambda l: l["diagonal"])})  # noqa: E741
    covered = covered.withColumn("n", F.least(F.size("of"), F.size("held"))).where(F.col("n") >= F.col("m") * FOUND)
    covered = covered.withColumn("own", F.struct("n", (-F.col("diagonal")).alias("d")))
    best = covered.withColumn("best", F.max("own").over(near)).where("best = own")
    notices = best.select("rid", "doc_id", "label", "phrase", F.array_min("held").alias("start"), (F.array_max("held") + 1).alias("stop"), (F.col("n") / F.col("m")).alias("score"))
    before = Window.partitionBy("rid").orderBy("start", F.desc("stop"), F.desc("score"), "label").rowsBetween(Window.unboundedPreceding, -1)
    notices = notices.withColumn("reach", F.max("stop").over(before)).where("reach IS NULL OR reach < stop").drop("reach")
    return whole.unionByName(notices)


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of every row of docs, and a row with null label and n_words for each."""
    grams = templates(phrases, notices)
    found = hits(docs, grams, id_col, text_col)
    return spans(found, grams).unionByName(found.where("n_words IS NOT NULL").select("rid", "doc_id", "n_words"), allowMissingColumns=True)


def digest(scanned: DataFrame) -> DataFrame:
    """A row for each document: counts and places of phrases, labels, and the best score."""
    names = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    base = F.col("phrase")
    return scanned.groupBy("rid", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("label").isNotNull()).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    ).drop("rid")
