"""Command line: python -m corpusmill STAGE SOURCE TARGET [options]."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from corpusmill.operators.control import GateFailed
from corpusmill.plans import stages


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    parser.add_argument("stage", choices=("verify", "prepare", "chatlogs", "profile", "relate", "questions", "answers", "curate", "assemble"))
    parser.add_argument("source")
    parser.add_argument("target", nargs="?")
    parser.add_argument("--model", help="module:factory of the model that questions, answers and curate ask")
    parser.add_argument("--mode", default="sections", choices=stages.MODES)
    parser.add_argument("--reviews")
    parser.add_argument("--signatures")
    parser.add_argument("--profiles", help="signatures that relate needs")
    parser.add_argument("--lexicon")
    parser.add_argument("--tags", help="table of tagged words (sentence, place, word, tag) that a tagger learns from")
    parser.add_argument("--valid", type=float, default=0.1)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--size", type=int, default=500)
    parser.add_argument("--overlap", type=int, default=50)
    parser.add_argument("--skip-bad", action="store_true")
    parser.add_argument("--fix-only", action="store_true")
    a = parser.parse_args(argv)
    if a.stage != "verify" and not a.target:
        parser.error(f"{a.stage} needs a target")
    if a.stage in ("questions", "answers", "curate") and not a.model:
        parser.error(f"{a.stage} needs --model")
    if a.stage == "relate" and not a.profiles:
        parser.error("relate needs --profiles")
    spark = SparkSession.builder.appName(f"corpusmill {a.stage}").getOrCreate()
    factory = None
    if a.model:
        module, _, name = a.model.partition(":")
        factory = getattr(importlib.import_module(module), name)
    run = {
        "verify": lambda: stages.verify(spark, a.source),
        "questions": lambda: stages.questions(spark, a.source, a.target, factory, a.profiles),
        "answers": lambda: stages.answers(spark, a.source, a.target, factory),
        "curate": lambda: stages.curate(spark, a.source, a.target, factory),
        "prepare": lambda: stages.prepare(spark, a.source, a.target, a.mode, a.reviews, a.signatures, a.valid, a.seed, a.size, a.overlap),
        "chatlogs": lambda: stages.prepare_chatlogs(spark, a.source, a.target, a.valid, a.seed, skip_bad=a.skip_bad),
        "profile": lambda: stages.profile(spark, a.source, a.target, a.lexicon, a.fix_only, a.tags),
        "relate": lambda: stages.relate(spark, a.source, a.profiles, a.target),
        "assemble": lambda: stages.assemble(spark, a.source, a.target, a.valid, a.seed),
    }
    try:
        for row in run[a.stage]().toJSON().collect():
            print(row)
    except (GateFailed, ValueError) as e:
        print(f"{a.stage}: {e}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
