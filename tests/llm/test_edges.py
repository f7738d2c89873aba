"""Nulls, empty tables, repeated rows, clashing columns: every operator gives a row for a row."""

import pytest
from pyspark.sql import functions as F

from driftloom.llm import ann, common, decontam, html, langid, lm, mixing, neardup, quality, secrets, substrings

LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, None, None, None, None), (None, "a b c d e f g", "de", "s", 1), (None, None, None, None, None), (3, "", "en", "", 0), (4, LONG, "en", "s", 9), (4, "other text of the same id, not equal", "fr", "t", 3), (5, "\x00 \t\n", "en", "t", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", params=["messy", "empty"])
def docs(request, spark):
    df = spark.createDataFrame(ROWS if request.param == "messy" else [], SCHEMA)
    # Columns with names that an operator may use itself.
    for name in ("id", "n", "size", "score", "target", "copies", "hits", "seed", "cid", "label", "row", "h", "body", "spans", "held", "kept", "item", "rid", "p", "u", "tie", "component_id", "lang_pred", "predicted"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("held_out", F.col("doc_id") % 2 == 0)


def test_secrets(docs):
    assert secrets.find_secrets(docs).count() == docs.count() == secrets.redact(docs).count()


def test_near_duplicates(docs):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    if got:
        assert {r["component_id"] for r in got if r["n_shingles"] == 3} == {1}
        assert neardup.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("part", [common.PART, 1])
def test_keep_one_by_row(spark, monkeypatch, part):
    monkeypatch.setattr(common, "PART", part)
    text, other = "a b c d e f g", "quite another text of the same id here"
    rows = [(1, text), (1, text), (None, text), (4, text), (4, other), (None, "null id twice and no other row"), (None, "null id twice and no other row"), (2, None), (3, "")]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, text), (4, other), rows[5], (2, None), (3, "")]))


def test_language(docs):
    out = langid.predict(docs, langid.train(docs)).collect()
    assert len(out) == docs.count() and all(r["lang_pred"] for r in out)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).count() == docs.count()
    assert quality.keep_good(docs, model).columns == docs.columns


def test_substrings(docs):
    assert substrings.dedup_substrings(docs).count() == docs.count()


def test_lm(docs):
    assert lm.score(docs, docs.select("text", F.lit(0).alias("held"))).count() == docs.count()
    assert lm.score(docs, docs.filter("false").select("text", F.lit(0).alias("held"))).count() == docs.count()


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "a b c d e f g"), (None, "sit amet lorem ipsum dolor"), (2, None), (2, "")], "item_id long, text string")
    rows, pairs = decontam.contaminated(docs, items)
    assert rows.count() == docs.count()
    if docs.count():
        assert {r["item"] for r in pairs.collect()} == {1, None}
    rows, pairs = decontam.contaminated(docs, items.filter("false"))
    assert pairs.count() == 0 and decontam.drop_contaminated(docs, items.filter("false")).count() == docs.count()


def test_mixing(docs):
    got = mixing.mix_sources(docs)
    assert got.count() == docs.count() and set(docs.columns) < set(got.columns)


def test_pages(spark):
    df = spark.createDataFrame([(1, None, None), (None, "x", "<p>a"), (2, "http://h/", "<<<>"), (2, "http://h/", "<<<>")], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    assert html.extract(df).count() == 4 and html.extract(df.filter("false")).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (None, [1.0]), (2, None), (3, [None])], "vec_id long, embedding array<double>").withColumn("query", F.lit("clash"))
    assert {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") == 0).collect()} == {(0, 1)}
    assert ann.nearest(df.filter("false"), F.col("vec_id") == 0).count() == 0
