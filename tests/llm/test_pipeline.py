"""The stages on a small corpus."""

import pytest

import corpus_pipeline

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ITEM = "every question of this benchmark is made of words that no other document has in the same order"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data"))
    rows = [
        (1, LONG, "en", "s", len(LONG)),
        (2, LONG + " phi", "en", "s", 1),
        (3, "Prose. " + ITEM, "en", "s", 1),
        (4, "the token = 'abcdef1234567' is here", None, "s", 35),
        (5, "12345 !!!", "en", "s", 9),
        (6, None, "en", "s", None),
        (7, "un texte tout simple", "fr", "s", 20),
        (None, "no name at all", "en", "s", 14),
    ] + [(100 + i, f"le petit chat numero mot{i} dort {i}", "fr", "s", 1) for i in range(20)] + [(200 + i, f"the small cat word{i} sleeps {i}", "en", "s", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "secrets":
            row = docs.where("doc_id = 4").first()
            assert row.text == "the <secret>' is here" and row.n_chars == len(row.text) and row.lang is not None
    clean = {1, 4, 7, None, *range(100, 120), *range(200, 220)}
    assert kept == [clean | {2, 3}, clean | {3}, clean, clean, clean]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == clean
