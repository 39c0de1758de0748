"""The pipeline's stages one after another, against plain Python."""

import importlib.util
import random

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline

ITEM = "quiet golden silver evening morning summer winter garden table window stone"


def words(rng, n):
    return " ".join(rng.choice("river stone window table garden winter summer morning evening silver golden quiet".split()) + rng.choice(["", "s", "ly", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(1), tmp_path_factory.mktemp("tables")
    base = words(rng, 120)
    rows = [(i, words(rng, 80), "en") for i in range(20)] + [(30, base, "en"), (31, base + " more", "en"), (32, base, "en"), (33, base, "en"), (33, base, "en")]
    rows += [(40, f"{words(rng, 60)} {ITEM} {words(rng, 60)}", "en"), (41, ITEM, "en"), (42, f"{words(rng, 50)} password=hunter2222 {words(rng, 50)}", "en"), (43, "12345 ...", "en"), (44, None, "en"), (None, words(rng, 50), None)]
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or ""), "x") for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        seen[name] = {r["doc_id"]: r for r in rows}
        if name != "encoding":
            assert docs.columns == columns
    clean = set(range(20)) | {None}
    assert set(seen["language"]) == clean | {30, 31, 32, 33, 40, 41, 42}
    assert set(seen["near_duplicates"]) == clean | {30, 40, 41, 42}
    assert set(seen["benchmark"]) == clean | {30, 40, 42} and ITEM not in seen["benchmark"][40]["text"]
    assert "hunter2222" not in seen["secrets"][42]["text"] and seen["secrets"][42]["n_chars"] == len(seen["secrets"][42]["text"])
    assert all(seen["secrets"][i]["text"] == seen["language"][i]["text"] for i in clean | {30})
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in seen["encoding"].values())


def test_run_gives_the_last_stage(spark, folder):
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == set(range(20)) | {None, 30, 40, 42}


def test_stages_handle_odd_tables(spark, tmp_path):
    """Empty tables, a very long text, two texts of one id, repeated rows and clashing names."""
    rng = random.Random(4)
    long, one, two = words(rng, 60_000), words(rng, 90), words(rng, 90)
    schema = "doc_id long, text string, lang string, source string, n_chars long, _spans string, _gone string, _mark long, mark long, sig long"
    rows = [(1, long), (2, long + " more"), (7, one), (7, two), (8, one), (9, None), (10, ""), (None, one), (11, two), (12, words(rng, 70)), (12, None)]
    rows += [(13, words(rng, 50))] * 3
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", "y", 1, 2, 3) for d, t in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert kept == sorted([(1, long), (7, one), (7, two), (None, one), (12, rows[9][1]), (13, rows[-1][1])], key=str)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 6
