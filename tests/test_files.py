"""Sources, sinks and streams over small folders."""

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dataset
from corpusmill.sources import files, sinks
from corpusmill.streaming import events


@pytest.fixture()
def tree(tmp_path):
    for name, text in {"a/x.md": "# X", "b/x.md": "# Later", ".hidden.md": "no", "node_modules/y.md": "no", "b/z.txt": "no", "b c/w.md": "ü"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_markdown_walk_and_flat_copy(spark, tree):
    found = files.markdown(spark, tree)
    assert sorted((r["path"], r["text"]) for r in found.collect()) == [("a/x.md", "# X"), ("b c/w.md", "ü"), ("b/x.md", "# Later")]
    flat = {r["name"]: (r["path"], r["text"], r["counted"]) for r in files.ingested(found).collect()}
    assert flat == {"x.md": ("b/x.md", "# Later", 2), "w.md": ("b c/w.md", "ü", 1)}
    with pytest.raises(files.GateFailed):
        files.require(found.filter("false"), "corpus")


def test_reviews_and_signatures(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/one-review.json").write_text(json.dumps({"context": "c", "questions": [{"question": "q", "answers": [{"answer": "a"}, "b"], "approved": True}, {"question": "r", "approved": False}]}))
    (tmp_path / "r/two-review.json").write_text("{broken")
    pairs, skipped = dataset.reviewed_pairs(files.reviews(spark, str(tmp_path / "r")))
    assert [tuple(r) for r in pairs.collect()] == [("one-review", "q", "a")] and skipped.first()[0] == 1
    (tmp_path / "s").mkdir()
    (tmp_path / "s/t.json").write_text(json.dumps({"zipf_avg": 1.5, "rare_terms": ["x"]}))
    (tmp_path / "s/u.json").write_text("[")
    assert [(r["title"], r["zipf_avg"], r["rare_terms"]) for r in files.signatures(spark, str(tmp_path / "s")).collect()] == [("t", 1.5, ["x"])]
    with pytest.raises(Exception):  # noqa: B017
        files.signatures(spark, str(tmp_path / "s"), strict=True).collect()


def test_chat_logs_keep_key_order(spark, tmp_path):
    log = {"messages": {k: {"extracted": f"text {k}", "host": "web" if i % 2 else None, "timestamp": float(-i)} for i, k in enumerate(["z", "a", "m", "b"])}}
    (tmp_path / "good.json").write_text(json.dumps(log))
    got = files.chatlogs(spark, str(tmp_path)).orderBy("turn").collect()
    assert [(r["text"], r["host"]) for r in got] == [("text z", None), ("text a", "web"), ("text m", None), ("text b", "web")]
    (tmp_path / "bad.json").write_text("nope")
    with pytest.raises(ValueError, match=r"bad\.json"):
        files.chatlogs(spark, str(tmp_path))
    assert files.chatlogs(spark, str(tmp_path), skip_bad=True).count() == 4 and [r["path"] for r in files.rejected_chatlogs(spark, str(tmp_path)).collect()] == ["bad.json"]


def test_sinks(spark, tmp_path):
    records = dataset.split(spark.range(10).withColumn("text", F.lit("é")), F.col("id"))
    sinks.jsonl(records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/split=train")).count() == 9
    assert sinks.report(spark.range(1), str(tmp_path / "report")) and not sinks.report(spark.range(1).select(F.raise_error(F.lit("x"))), str(tmp_path / "r2"))
    for _ in range(2):
        sinks.anchors(spark.range(2), str(tmp_path / "anchors"))
    assert spark.read.json(str(tmp_path / "anchors")).count() == 4
    row = sinks.manifest(spark.range(2), spark.range(0), spark.createDataFrame([("character", "train", 3)], "label string, split string, n int")).first()
    assert len(row["inputs"]) == 2 and row["failed"] == [] and row["datasets"][0]["n"] == 3


COMMAND = "command_id string, dataset_id string, action string, ts timestamp"


def stream(spark, tmp_path, batches, key="command_id"):
    source = tmp_path / "in"
    source.mkdir(exist_ok=True)
    for i, ids in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"command_id": c, "dataset_id": "d", "action": "train", "ts": "2024-01-01T00:00:00Z"}) for c in ids))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in this order
    return spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 1).json(str(source))


def ended(df, tmp_path, spark, mode="append"):
    df.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / "to")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / "to"))


def test_stream_dedup_by_event_time(spark, tmp_path):
    got = ended(events.deduplicated(stream(spark, tmp_path, [["a", "b", "a"], ["b", "c"]])), tmp_path, spark)
    assert sorted(r["command_id"] for r in got.collect()) == ["a", "b", "c"]


def test_stream_dedup_by_bounded_window(spark, tmp_path):
    got = ended(events.fifo_dedup(stream(spark, tmp_path, [["a", "b", "a"], ["c", "b"], ["a", "c", "a"]]), "dataset_id", size=2), tmp_path, spark)
    assert sorted(r["command_id"] for r in got.collect()) == ["a", "a", "b", "c"]


def test_stream_lifecycle_and_relay(spark, tmp_path):
    tries, waits, seen = [], [], []

    def deliver(batch, number):
        tries.append(number)
        if len(tries) < 3:
            raise OSError
        seen.extend(r["state"] for r in batch.collect())

    events.relayed(events.lifecycle(stream(spark, tmp_path, [["a"]])), deliver, wait=waits.append).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == ["IN_PROGRESS"] and len(waits) == 2 and 0.09 <= waits[0] <= 0.11 and 0.18 <= waits[1] <= 0.22


def test_git_log_with_binary_files_and_empty_commits(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"\x1eaa\x1f2024-01-02T00:00:00+00:00\n\n3\t1\ta b.md\n-\t-\tx.png\n\x1ebb\x1f2024-01-01T00:00:00+00:00\n\x1ecc\x1f2024-01-03T00:00:00+00:00\n\n2\t0\ta b.md\n")
    found = files.commits(spark, str(tmp_path / "log"))
    assert sorted((r["path"], r["commit_hash"], r["additions"], r["deletions"]) for r in found.collect()) == [("a b.md", "aa", 3, 1), ("a b.md", "cc", 2, 0), ("x.png", "aa", 0, 0)]


def test_signature_terms_that_are_no_strings_go(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"zipf_avg": 1.5, "rare_terms": ["x", 7, None, "y"]}))
    assert files.signatures(spark, str(tmp_path)).first()["rare_terms"] == ["x", "y"]


def test_trace_is_best_effort(spark, tmp_path):
    assert sinks.trace(spark.range(3), str(tmp_path / "t"), "m")
    told = spark.read.json(str(tmp_path / "t/metadata")).first()
    assert (told["total_steps"], told["model_config"]) == (3, "m") and spark.read.json(str(tmp_path / "t/trace")).count() == 3
    assert not sinks.trace(spark.range(1).select(F.raise_error(F.lit("x"))), str(tmp_path / "u"))


SEEN = "k string, state string, ts timestamp, n long"


def seen(spark, folder, rows):
    own = [(k, state, datetime.fromtimestamp(at, timezone.utc), n) for k, state, at, n in rows]
    spark.createDataFrame(own, SEEN).coalesce(1).write.mode("append").parquet(str(folder))


def caught_up(spark, folder, checkpoint, **options):
    """Runs the stream to its end, and gives the changes of the run, batch by batch."""
    found = []
    kept = events.kept_states(spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(str(folder)), ["k"], "state", ["ts", "n"], **options)
    kept.writeStream.outputMode("update").foreachBatch(lambda batch, _: found.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return found


def test_states_survive_a_restart(spark, tmp_path):
    data, progress = tmp_path / "data", tmp_path / "progress"
    initial = spark.createDataFrame([("a", "first", datetime.fromtimestamp(5, timezone.utc), 9), ("z", "alone", datetime.fromtimestamp(1, timezone.utc), 0)], SEEN)
    seen(spark, data, [("a", "early", 3, 0), ("b", "x", 1, 1), ("b", "y", 1, 2), ("c", None, 1, 0), ("d", "no order", 2, None)])
    assert sorted(caught_up(spark, data, progress, initial=initial)) == [("b", "y"), ("c", "IDLE")]
    seen(spark, data, [("b", "late", 0, 9), ("a", "second", 5, 10)])
    assert caught_up(spark, data, progress, initial=initial) == [("a", "second")]  # the state of the first run is there
    assert {tuple(r) for r in events.states(spark, str(progress), ["k"]).collect()} == {("a", "second"), ("b", "y"), ("c", "IDLE"), ("z", "alone")}


def test_states_expire(spark, tmp_path):
    data, progress = tmp_path / "data", tmp_path / "progress"
    for rows in ([("a", "x", 100, 0), ("b", "x", 100, 0)], [("b", "y", 108, 0)], [("c", "x", 111, 0)], [("c", "y", 112, 0)], [("c", "z", 119, 0)]):
        seen(spark, data, rows)
    found = caught_up(spark, data, progress, at="ts", expiry=10_000)
    assert ("a", None) in found and found.index(("a", None)) > found.index(("b", "y"))
    assert {tuple(r) for r in events.states(spark, str(progress), ["k"]).collect() if r["k"] != "b"} == {("c", "z")}  # b's timer is due with the last batch
    with pytest.raises(ValueError, match="together"):
        events.kept_states(spark.readStream.schema(SEEN).parquet(str(data)), ["k"], "state", ["n"], expiry=5)


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}-review.json").write_text('{"questions": []}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        assert files.review_texts(spark, str(tmp_path)).rdd.getNumPartitions() <= 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_anchors_are_computed_once(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from corpusmill.plans import folders, sessions

    chance = F.udf(random.random, "double").asNondeterministic()
    monkeypatch.setattr(sessions, "q43_high_reward", lambda t: t("x").select("conv_id", "turn", chance().alias("reward")))
    rows = spark.range(20).selectExpr("id AS conv_id", "id AS turn")
    assert {r["copies"] for r in folders.q52_anchor_append(lambda name: rows).collect()} == {2}


def test_frames_are_decoded_once(spark):
    import random

    from pyspark.sql import functions as F

    from corpusmill.operators import control

    frame = F.udf(lambda: random.choice([b"\x00\x00\x00\x00\x07\x00a", b"\x01"]), "binary").asNondeterministic()
    good, bad = control.unframed(spark.range(300).select("id", frame().alias("frame")))
    assert good.count() + bad.count() == 300 and good.count() and not {r["id"] for r in good.collect()} & {r["id"] for r in bad.collect()}


def test_batches_of_markdown_texts_are_bounded(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from corpusmill.functions import markdown

    @F.pandas_udf("int")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    long = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("x"), 20_000).alias("text"), "id")
    markdown.paragraphs(F.col("text"))
    assert long.select(rows("text").alias("n")).agg(F.max("n")).first()[0] <= 500


def test_review_files_are_read_a_folder_at_a_time(spark, monkeypatch):
    from corpusmill.plans import ORACLE, QUERIES, folders
    from tests import oracle

    read, text = [], files._text
    monkeypatch.setattr(files, "_text", lambda *args: read.append(text(*args)) or read[-1])
    monkeypatch.setattr(folders, "FILES", 16)
    for name in ("q48_review_files", "q48_rejected_files"):
        read.clear()
        assert oracle.same(spark, QUERIES[name], ORACLE[name])
        listed = [len(df.inputFiles()) for df in read]
        assert len(listed) > 2 and max(listed) <= 40 and sum(listed) == spark.read.parquet(f"{oracle.FOLDER}/labels.parquet").count()


def test_folders_of_reviews(spark, tmp_path):
    assert files.folders(spark, str(tmp_path)) == [str(tmp_path)]
    for name in ("shelf=1", "shelf=0"):
        (tmp_path / name).mkdir()
    (tmp_path / "_SUCCESS").write_text("")
    assert files.folders(spark, str(tmp_path)) == [f"{tmp_path}/shelf=0", f"{tmp_path}/shelf=1"]
