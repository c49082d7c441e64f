"""Fill-in-middle against a version that works on strings one by one."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxmode.llm import infill, kernel

SCHEMA = "doc_id long, text string, output string, n string"


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "<", "<P", "<P>", "x<S>y", "<M", "é", "日本語 text, 12 <b>!", "\u0000\n\r\t", "a" * 5000, "ß" * 5000, "no marks < P > here", "😀 <<P <S", "word " * 900]


def test_transform_and_restore(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS * 12)] + [(None, "null id here", "x", "y"), (7, "seven", "x", "y"), (7, "seven", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = infill.restore(infill.transform(df)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    have = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=key)
    want = sorted(((i, *expected(i, t), t or "") for i, t, *_ in rows), key=key)
    assert have == want
    assert {r[2] for r in have} == {"plain", "psm", "spm"}
    assert infill.digest(infill.transform(df.limit(0))).count() == 0
    r = infill.digest(infill.transform(spark.createDataFrame([(3, "three words here")], "doc_id long, text string"))).first()
    assert r["restored_sha256"] == hashlib.sha256(b"three words here").hexdigest() and r["output_sha256"] == hashlib.sha256(expected(3, "three words here")[-1].encode()).hexdigest()


def one_by_one(texts, ids):
    column = pa.array(texts, pa.string())
    h = np.array([[int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] for i in ids]).reshape(-1, 4)
    buf, offsets = infill._buffer(column)
    n, form, parts, chars = infill.cut(buf, offsets, h)
    out, begin = infill.scatter(buf, offsets, parts, form)
    back = infill._column(*infill.gather(out, begin, form)).to_pylist()
    return [(a, f, None if f == "plain" else p, None if f == "plain" else m, o) for a, f, (p, m), o in zip(n.tolist(), form, chars.tolist(), infill._column(out, begin).to_pylist(), strict=True)], back


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab <>PSM\né日😀."), max_size=30), max_size=12), st.integers(0, 10**6))
def test_any_batch(texts, first):
    ids = range(first, first + len(texts))
    got, back = one_by_one(texts, ids)
    assert got == [expected(i, t) for i, t in zip(ids, texts, strict=True)] and back == texts


def test_long_texts_cross_blocks(monkeypatch):
    monkeypatch.setattr(infill, "SEGMENT", 1000)
    texts = ["é, " * 3000, "a" * 7001, "x <b> " * 999, "", "日" * 2500]
    for first in range(0, 60, 5):
        ids = range(first, first + 5)
        got, back = one_by_one(texts, ids)
        assert got == [expected(i, t) for i, t in zip(ids, texts, strict=True)] and back == texts


def test_megabytes(spark):
    rows = [(1, "a" * 3_000_000), (2, " " * 2_500_000), (4, "é" * (kernel.SEGMENT + 17)), (5, "mixed 1\n" * 300_000)]
    for r in infill.restore(infill.transform(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        text = dict(rows)[r["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected(r["doc_id"], text) and r["restored"] == text
