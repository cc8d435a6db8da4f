"""Quality levels count labelled documents, not their rows; decoding of foreign ids."""

from __future__ import annotations

from gustframe.llm import quality_rules, unigram
from tests.llm.fixtures_llm import prose

SCHEMA = "doc_id long, text string, lang string"


def _bad(i: int) -> str:
    return " ".join(w + "***" for w in prose(i, 60).split())


def test_repeated_rows_are_one_trial(spark):
    # 100 labelled documents, five rows each: too few for any level, however many rows
    rows = [(i, prose(i, 60), "en") for i in range(100) for _ in range(5)] + [(1000 + i, _bad(i), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame([(i, 1) for i in range(100)] * 3, "doc_id long, quality int")
    assert quality_rules.judge(docs, lab).where("kept").count() == 520
    # 400 documents are enough
    more = spark.createDataFrame([(i, prose(i, 60), "en") for i in range(400)] + [(1000 + i, _bad(i), "en") for i in range(20)], SCHEMA)
    lab = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    assert quality_rules.judge(more, lab).where("kept").count() == 400


def test_rows_that_differ_count_by_the_strictest(spark):
    rows = [(i, prose(i, 60), "en") for i in range(400)]
    rows += [(i, _bad(i), "en") for i in range(40)]  # the same ids with another text
    lab = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    assert quality_rules.judge(spark.createDataFrame(rows, SCHEMA), lab).where("kept").count() == 440


def test_decode_of_foreign_ids(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    ids = unigram.encode(docs).first().ids
    size = len(unigram.load_model(unigram.MODEL).pieces)
    table = spark.createDataFrame([(1, ids), (2, [*ids, size]), (3, [None, -1, *ids]), (4, None), (5, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in unigram.decode(table).collect()}
    assert got == {1: "one two", 2: "one two�", 3: "�� one two", 4: "", 5: ""}
