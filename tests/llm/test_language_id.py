"""Language identification: held-out accuracy, defined results, what is read."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from fixtures_llm import documents, empty
from pyspark.sql import functions as F

from gustframe.llm import language_id as L

SF = "/root/testdata/sf0.01"


def brute_frequencies(text: str) -> np.ndarray:
    """Frequencies of the grams of one text, gram by gram."""
    out = np.zeros(L.BUCKETS)
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    s = "".join(c for i, c in enumerate(s) if c != " " or (i and s[i - 1] != " "))
    for k in range(1, L.ORDERS + 1):
        for i in range(len(s) - k + 1):
            if s[i:i + k] == " ":
                continue
            h = 0
            for j, c in enumerate(s[i:i + k]):
                h = (h + ord(c)) * int(L._FACTORS[j]) % 2**32
                h ^= h >> 15
            out[((h + k - 1) * 0x27D4EB2F % 2**32 >> 20) % L.BUCKETS] += 1
    return out / max(out.sum(), 1)


def test_frequencies_by_brute_force(monkeypatch):
    texts = ["One, two!  Ünï 12 é", "", None, "...", "a", " b ", "漢字 x" * 30, "İstanbul \U0001F600 z"]
    want = np.array([brute_frequencies(t or "") for t in texts])
    assert np.allclose(L.frequencies(texts), want)
    monkeypatch.setattr(L, "BLOCK", 7)
    assert np.allclose(L.frequencies(texts), want)


def test_scores_are_linear_in_frequencies():
    rng = np.random.default_rng(1)
    model = L.Model(["de", "en", "fr"], ["germanic", "romance"], [(0, 1)], rng.normal(size=(L.BUCKETS, 3)), rng.normal(size=3))
    texts = ["some words here", None, "x", "zwölf Boxkämpfer jagen", "12 34"]
    s, known = model.scores(texts)
    assert np.allclose(s, L.frequencies(texts) @ model.weights + model.bias) and known.tolist() == [True, False, True, True, False]
    langs, score = model.predict(texts)
    assert langs[1] == langs[4] == "und" and score[1] == score[4] == 0 and ((0 <= score) & (score <= 1)).all()
    for i in (0, 2, 3):
        assert langs[i] == ("fr" if s[i, 1] > s[i, 0] else "en" if s[i, 2] > 0 else "de")


@pytest.fixture(scope="module")
def result(spark):
    return L.identify(spark.read.parquet(f"{SF}/documents.parquet")).cache()


def test_held_out_accuracy(spark, result):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = result.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    for lang in ("de", "en", "es", "fr"):
        assert np.mean([r.lang_pred == lang for r in held if r.lang == lang]) > 0.95


def test_only_texts_are_read(spark, result):
    """Held-out languages and all sources play no part."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a = {r.doc_id: (r.lang_pred, r.score) for r in result.collect()}
    assert {r.doc_id: (r.lang_pred, r.score) for r in L.identify(other).collect()} == a


def test_edge_rows(spark):
    docs = documents(spark)
    got = L.identify(docs)
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == docs.count()
    assert {r.lang_pred for r in rows} <= {"en", "de", "es", "und"} and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    by = {r.doc_id: r.lang_pred for r in rows}
    assert by[100] == by[101] == by[102] == "und" and by[103] != "und"
    assert L.identify(empty(docs)).count() == 0
    none = L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = L.identify(docs.withColumn("lang", F.lit("q?"))).collect()
    assert {r.lang_pred for r in one} == {"q?", "und"}


def test_close_languages_and_unlisted_codes(spark):
    rng = random.Random(3)
    parts = {"es": "ción que el los para dad mente", "pt": "ção que o os para dade mente", "it": "zione che il gli per tà mente",
             "sv": "och att det som för ning het", "da": "og at det som for ning hed", "xq": "wok zub kri plo vax"}
    rows = [(i, " ".join(rng.choice(parts[lang].split()) for _ in range(40)), lang) for i in range(420) for lang in [sorted(parts)[i % 6]]]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 60 and np.mean([a == b for a, b in held]) > 0.97
