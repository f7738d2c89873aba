"""The pipeline on small, odd and empty tables."""

import pytest

import corpus_pipeline

ROWS = [(k, f"document number {k} tells of its own subject " + " ".join(f"w{k}x{j}" for j in range(30)), "en", f"s{k % 3}", 0) for k in range(30)]
COPY = ROWS[4][1]
ITEM = "one benchmark question that asks which of the many rivers is the longest of them all"
ODD = [(40, COPY, "en", "s0", 0), (41, ITEM + " and more", "en", "s1", 0), (42, "key AKIA" + "A1B2" * 5 + " in a text of its own making", "en", "s2", 0), (43, None, None, None, None), (None, "a row without an id but with words of its own", "en", "s1", 0), (44, "", "en", None, 0), (5, ROWS[5][1], "en", "s2", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages(spark, tmp_path):
    """Every stage but the first alone, on all rows; the classifier's runs in test_run."""
    write(spark, tmp_path, ROWS + ODD, [], [(1, ITEM), (2, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.near_dup_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([*range(30), 41, 42, 43, None, 44], key=str)
    clean = corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path))
    assert 41 not in {r["doc_id"] for r in clean.collect()} and clean.count() == docs.count() - 1
    out = corpus_pipeline.secrets_stage(spark, docs, str(tmp_path)).collect()
    assert len(out) == docs.count() and not any("AKIA" in (r["text"] or "") for r in out)
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] is not None)
    mixed = corpus_pipeline.mix_stage(spark, docs.withColumn("copies", docs["doc_id"]), str(tmp_path))
    assert mixed.columns == [*docs.columns, "copies"] and {r["copies"] for r in mixed.collect()} <= {1, 2}


@pytest.mark.parametrize("rows", [ROWS + ODD, []])
def test_run(spark, tmp_path, rows):
    write(spark, tmp_path, rows, [(k, int(k % 2 == 0), 0) for k in range(10)] if rows else [], [(1, ITEM)] if rows else [])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "copies"]
    if not rows:
        assert got.count() == 0
