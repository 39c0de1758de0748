"""Stages over folders, end to end."""

import json

import pytest

from corpusmill.__main__ import main
from corpusmill.operators import control
from corpusmill.operators.control import GateFailed
from corpusmill.plans import stages


@pytest.fixture()
def corpus(tmp_path):
    (tmp_path / "raw/ethic").mkdir(parents=True)
    (tmp_path / "raw/one.md").write_text("# One\nalpha zorbium\n\n## Two\nbeta")
    (tmp_path / "raw/ethic/two.md").write_text("# Zorbium\nalpha one")
    (tmp_path / "raw/blank.md").write_text(" \n")
    (tmp_path / "rev").mkdir()
    (tmp_path / "rev/x-review.json").write_text(json.dumps({"questions": [{"question": "q", "answers": ["a"], "approved": True}, {"question": "r", "answers": ["b"], "approved": False}]}))
    (tmp_path / "sig").mkdir()
    (tmp_path / "sig/t.json").write_text(json.dumps({"title": "t", "zipf_avg": 1.0, "rarity_pos": 0.5, "rare_terms": ["z"]}))
    return tmp_path


@pytest.mark.parametrize(("mode", "n"), [("sections", 6), ("raw_text", 4), ("qa_pairs", 5)])
def test_prepare(spark, corpus, mode, n):
    got = stages.prepare(spark, str(corpus / "raw"), str(corpus / "out"), mode, str(corpus / "rev"), str(corpus / "sig"), valid=0.5).first()
    assert (got["records"], got["train"], got["valid"]) == (n, n // 2, n - n // 2)
    assert spark.read.json(str(corpus / "out")).count() == n


def test_profile_relate_and_assemble(spark, corpus):
    got = stages.profile(spark, str(corpus / "raw"), str(corpus / "profiles")).first()
    assert got["documents"] == 3 and got["n_thin"] == 1
    assert stages.profile(spark, str(corpus / "raw"), str(corpus / "profiles"), fix_only=True).first()["documents"] == 3
    told = stages.relate(spark, str(corpus / "raw"), str(corpus / "profiles"), str(corpus / "graph")).first()
    assert told["corpus_files"] == 3 and told["edges"] >= 1
    assert tuple(stages.assemble(spark, str(corpus / "rev"), str(corpus / "train")).first()) == (1, 0, 1, 1)


def test_chat_logs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = {"messages": {str(i): {"extracted": f"a message that is long enough {i}", "host": "web" if i % 2 == 0 else None} for i in range(6)}}
    (tmp_path / "in/a.json").write_text(json.dumps(log))
    (tmp_path / "in/bad.json").write_text("[]")
    with pytest.raises(ValueError, match="bad"):
        stages.prepare_chatlogs(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    row = stages.prepare_chatlogs(spark, str(tmp_path / "in"), str(tmp_path / "out"), skip_bad=True).first()
    assert [f["path"] for f in row["failed"]] == ["bad.json"] and {d["label"]: d["records"] for d in row["datasets"]} == {"character": 1, "painter": 2}
    assert spark.read.json(str(tmp_path / "out/painter")).count() == 2


def test_gates(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(GateFailed):
        stages.profile(spark, str(tmp_path / "none"), str(tmp_path / "p"))
    with pytest.raises(ValueError, match="mode"):
        stages.prepare(spark, "x", "y", "z")
    assert main(["assemble", str(tmp_path / "none"), str(tmp_path / "o")]) == 1


class Recorded:
    """A model that answers from what it was told to."""

    def complete(self, prompt, attempt):
        if prompt.startswith("Identify"):
            return "Q> 1. What is care?\nQ> And growth?" if attempt == 1 else "q> What is care? indeed"
        if prompt.startswith("You are grading"):
            return "RATING: 5\nSYNTHESIS: Care it is." if "What is care" in prompt else "RATING: 2\nSYNTHESIS: no"
        return {1: "Care. ", 2: "Attention", 3: "CARE."}.get(attempt, "Care.")


def test_questions_answers_and_curation(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.md").write_text("# Care\n\nCare is attention.\n\nGrowth is slow.\n")
    told = stages.questions(spark, str(tmp_path / "raw"), str(tmp_path / "q"), Recorded).first()
    assert tuple(told) == (2, 0, 4, 4)
    assert tuple(stages.answers(spark, str(tmp_path / "q"), str(tmp_path / "a"), Recorded).first()) == (4, 0, 8, 12)
    assert tuple(stages.curate(spark, str(tmp_path / "a"), str(tmp_path / "c"), Recorded).first()) == (2, 4, 2)
    review = spark.read.json(str(tmp_path / "c")).orderBy("context_id").first()
    assert [(q["question"], sorted(q["answers"]), q["rating"], q["approved"]) for q in review["questions"]] == [("And growth?", ["Attention", "Care."], 2, False), ("What is care?", ["Attention", "Care."], 5, True)]
    with pytest.raises(GateFailed):
        stages.questions(spark, str(tmp_path / "c"), str(tmp_path / "x"), Recorded)


def test_verify_judges_a_folder(spark, tmp_path):
    for d in control.DIRS:
        (tmp_path / d).mkdir(parents=True, exist_ok=True)
    (tmp_path / "raw_data/a.md").write_text("text")
    (tmp_path / "schema/schema.json").write_text('{"archetype": "a", "routing": {"x": "y"}}')
    told = stages.verify(spark, str(tmp_path)).first()
    assert told["valid"] and (told["corpus_files"], told["corpus_bytes"]) == (1, 4)
    (tmp_path / "schema/schema.json").unlink()
    assert stages.verify(spark, str(tmp_path)).first()["issues"] == ["missing schema/schema.json"]
