"""Addresses spelled with bare words and numbers with bracketed dots are found; prose of the same words is left alone."""

import random

import pytest
from pyspark.sql import functions as F

from fluxmode.llm import pii

WORDS = "river stone light garden window paper season market bridge winter morning letter".split()


def planted(i):
    """A text and its one span, or none."""
    r = random.Random(i)
    name, host, octet = f"{r.choice(['ann', 'joe.b', 'lee_k'])}{i % 89}", f"site{i % 53}", lambda: str(r.randrange(1, 256))
    form = (
        ("email", f"{name} at {host} dot {r.choice(['com', 'org', 'net'])}"), ("email", f"{name} AT post DOT {host} DOT de"), ("ip", "[.]".join(octet() for _ in range(4))),
        ("ip", f"{octet()}[.]{octet()}.{octet()}(.){octet()}"), ("ip", " [dot] ".join(octet() for _ in range(4))),
        (None, "look at the dot on"), (None, "look at the dot com bubble"), (None, f"{host} at noon dot matrix"), (None, "(.) or [.] or 3 [dot] 4"), (None, f"300[.]{octet()}[.]{octet()}[.]999"),
    )[i % 10]
    before, after = (" ".join(r.choices(WORDS, k=6)) for _ in range(2))
    return f"{before}, {form[1]}, {after}", f"{form[0]}:{len(before) + 2}:{len(before) + 2 + len(form[1])}" if form[0] else ""


def test_spelled_forms(spark, tmp_path):
    texts = [planted(i) for i in range(1000)]
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    got = {r["doc_id"]: r["spans"] for r in pii.scan(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    missed = [(t, got[i]) for i, (t, want) in enumerate(texts) if want and got[i] != want]
    wrong = [(t, got[i]) for i, (t, want) in enumerate(texts) if not want and got[i]]
    assert len(missed) <= 0.1 * sum(bool(w) for _, w in texts) and not wrong, (missed[:5], wrong[:5])


@pytest.mark.parametrize(("kind", "value", "want"), [
    ("email?", "bob at host dot com", True), ("email?", "bob at mail dot host dot ORG", True), ("email?", "look at the dot com", False), ("email?", "point at red dot on", False), ("email?", "bob at host dot 1x", False),
    ("ip?", "192[.]168[.]1.9", True), ("ip?", "192 [dot] 168(dot)1.9", True), ("ip?", "192[.]168[.]1.999", False), ("ip?", "192[.]168[.]01.9", False), ("ip?", "1,2,3[.]4", False),
])
def test_labels(spark, kind, value, want):
    row = spark.createDataFrame([(kind, value, "")], "kind string, value string, before string")
    assert row.select(pii._passes().alias("ok")).first()["ok"] is want


def test_very_long_texts(spark, tmp_path):
    data = [(1, "a at b dot " * 200_000 + "com"), (2, "1[.]" * 300_000), (3, "a at " * 300_000), (4, "x at y" + " dot z" * 200_000), (5, "1 [dot] " * 200_000 + "é"), (6, None), (7, "at dot at dot")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    got = pii.scan(spark.read.parquet(str(tmp_path / "docs")))
    assert got.count() == 7 and got.where(F.col("n_email") + F.col("n_ip") > 0).count() == 0
