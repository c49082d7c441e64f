"""Texts of megabytes through the operators on whole documents and the stages of the pipeline."""

import hashlib
import random
import re

import public_tokenizers
import pytest

from fluxmode.llm import common, decontamination, exact_dedup, langid, near_dedup, packing, quality, secrets, substring_dedup

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(12)
PASSAGE = " ".join(f"bench{i}" for i in range(30))
PROSE = " ".join(rng.choice(["stone", "river", "light", "paper", "glass", "night"]) + str(rng.randrange(9999)) for _ in range(120_000))
CUT = PROSE.index(" ", 500_000)
TEXTS = {
    1: " " * 2_000_000,
    2: "x" + "\n" * 1_200_000 + "y",
    3: "é" * 1_000_000,
    4: "same " * 300_000,
    5: PROSE,
    6: PROSE.replace("stone", "Stone"),
    7: PROSE[:CUT] + " " + PASSAGE + PROSE[CUT:],
    8: "A" * 2_500_000,
    9: PROSE,
    10: "short text here",
}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    rows = [(i, t, "en", "s", len(t)) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def test_packing(docs):
    got = packing.pack(docs, TOKENIZER).selectExpr("doc_id", "length", "doc_tokens").groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(got) == len(TEXTS) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in got)


def test_dedup(docs):
    lower = {i: t.lower() if t.isascii() else t for i, t in TEXTS.items()}
    got = {r["doc_id"]: r for r in exact_dedup.groups(docs).collect()}
    assert all(got[i]["keep_id"] == max(j for j in lower if lower[j] == t) and got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in lower.items())
    near = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(docs).collect()}
    assert near == {i: 5 if i in (5, 6, 7, 9) else i for i in TEXTS}


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "not there at all in any text")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.digest(decontamination.hits(docs, bench)).collect()}
    assert got[7]["n_hit"] == 30 and not got[7]["contaminated"] and all(got[i]["n_hit"] == 0 for i in TEXTS if i != 7)


def test_substring(docs):
    got = {r["doc_id"]: r for r in substring_dedup.digest(substring_dedup.removals(docs)).collect()}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in TEXTS.items()}
    assert all(got[i]["n_words"] == words[i] for i in TEXTS)
    assert got[4]["n_removed"] == words[4] - 1 and got[9]["n_removed"] == words[9] and got[5]["n_removed"] == 0 and got[7]["n_removed"] == words[7] - 30


def test_models(spark, docs):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[1] == "und" and got[5] == "en" and len(got) == len(TEXTS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in TEXTS], "doc_id long, quality int, toxic int")
    scored = quality.scores(docs, quality.fit(docs, labels)).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scored)


def test_mixed_case_hexadecimal(spark, docs):
    one = spark.createDataFrame([(1, "key ghp_16C7e42F292c6912E7710c838347Ae178B4a end")], "doc_id long, text string")
    assert secrets.scan(one).first()["spans"].startswith("entropy:")


def test_stages(spark, docs, tmp_path_factory):
    import corpus_pipeline

    home = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in TEXTS], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    left = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.stored(stage(spark, left, home), "long")
        left = out if k else docs  # with so few labels the classifier's verdict is not the point here
    assert {r["doc_id"] for r in left.select("doc_id").distinct().collect()} == {1, 2, 3, 4, 7, 8, 10}
