"""License scans against a version that compares every k-gram of a text with every one of a template."""

import random
import re
from collections import defaultdict

import pytest

from fluxmode.llm import common, kernel, licenses

SCHEMA = "doc_id long, text string, label string, t string, k string"
LOWER = str.maketrans(common.UPPER, common.UPPER.lower())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(text):
    w = words(text)
    base = [(i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = []
    for label, text_ in licenses.NOTICES:
        t = text_.split()
        k, votes = min(licenses.K, len(t)), defaultdict(list)
        index = defaultdict(list)
        for j in range(len(t) - k + 1):
            index[tuple(t[j : j + k])].append(j)
        for i in range(len(w) - k + 1):
            for j in index.get(tuple(w[i : i + k]), ()):
                votes[i - j].append(j)
        scored = {}
        for d in votes:
            of, held = set(), set()
            for e in range(d, d + licenses.BAND + 1):
                for j in votes.get(e, ()):
                    of |= set(range(j, j + k))
                    held |= set(range(e + j, e + j + k))
            n = min(len(of), len(held))
            if n >= licenses.FOUND * len(t):
                scored[d] = (n, -d, min(held), max(held) + 1)
        for d, (n, _, start, stop) in scored.items():
            if (n, -d) == max(scored[e][:2] for e in scored if abs(e - d) <= licenses.BAND):
                found.append((start, -stop, -n / len(t), label))
    reach, kept = -1, []
    for start, stop, score, label in sorted(found):
        if -stop > reach:
            kept.append((label, -score))
        reach = max(reach, -stop)
    labels = {label for _, label in base} | {label for label, _ in kept}
    at = [i for i, _ in base]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), max([1.0] * bool(base) + [s for _, s in kept], default=0.0)


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice([[], ["extra", w[i]], ["other"]])
    return " ".join(w)


def fixture():
    r = random.Random(4)
    filler = lambda n: " ".join(r.choice(["stone", "of", "the", "software", "license", "été", "general", "MIT", "a", "public"]) for _ in range(n))
    out = [None, "", "MIT", "mit License", "MIT/license; mit-license", "General\nPublic... License 3", "permit license", "mité license", "apache license " * 500, "the software " * 900]
    for label, text in licenses.NOTICES:
        for n in (0, 1, 3, 9):
            out.append(f"{filler(r.randrange(40))} {edited(text.upper() if n == 1 else text, r, n)}\n\n{filler(30)}")
    out.append(" ".join(text for _, text in licenses.NOTICES))
    return out + [filler(300) for _ in range(30)]


def told(r):
    return tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) + (round(r["score"], 9),)


def test_against_brute_force(spark):
    texts = fixture()
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, texts[3], "x", "y", "z"), (4, texts[4], "x", "y", "z")]
    got = licenses.digest(licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    have = sorted(((r["doc_id"] is None, r["doc_id"] or 0, *map(str, told(r))) for r in got))
    want = sorted((i is None, i or 0, *map(str, (*e[:-1], round(e[-1], 9)))) for i, e in ((i, expected(t)) for i, t, *_ in rows))
    assert have == want
    labels = {x for r in got for x in r["labels"].split(",")}
    assert labels >= {label for label, _ in licenses.NOTICES}
    assert licenses.digest(licenses.scan(spark.createDataFrame([], SCHEMA))).count() == 0


def test_edited_notices_are_found_and_prose_is_left(spark):
    r = random.Random(8)
    long = [(label, t) for label, t in licenses.NOTICES if len(t.split()) >= 25]
    rows = [(i, f"some words before {edited(t, r, 1)} and after") for i, (_, t) in enumerate(long)]
    got = {x["doc_id"]: x["labels"].split(",") for x in licenses.digest(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(long))


def test_long_texts_in_parts(spark):
    mit = dict(licenses.NOTICES)["bsd"]
    texts = ["x" * (kernel.SEGMENT + 9), " " * 3_000_000, ("word " * 9 + "mit license ") * 50_000, "a" * (kernel.SEGMENT - 40) + " " + mit + " tail", ("é " * (kernel.SEGMENT // 3 - 20)) + mit + " general public license" * 3 + " y" * 900_000]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: told(r) for r in licenses.digest(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        e = expected(t)
        assert got[i] == (*e[:-1], round(e[-1], 9)), i


def test_templates_are_bounded():
    with pytest.raises(ValueError):
        licenses.templates((("x", "w " * (licenses.MAX_WORDS + 1)),), ())
    with pytest.raises(ValueError):
        licenses.templates((("x", " .. "),), ())
