"""Operators on fixtures of the survey's shapes, against plain Python where order matters."""

import hashlib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import components, control, conversations, dataset, generation, graph, lexicon, vectors


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sections_keep_the_path(spark):
    text = "before\n# One\na\n## Two\nb\n### Three\nc\n# \n## Again\nd\n####### no heading\n## Empty"
    got = dataset.sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    assert [(r["header"], r["headers_path"], r["content"]) for r in got.orderBy("section").collect()] == [
        ("Introduction", [], "before"), ("One", ["One"], "a"), ("Two", ["One", "Two"], "b"), ("Three", ["One", "Two", "Three"], "c"), ("Again", ["Again"], "d\n####### no heading"),
    ]


@pytest.mark.parametrize("n", [0, 1, 4, 7, 10, 11, 25])
def test_chunks_overlap(spark, n):
    words = [f"w{i}" for i in range(n)]
    expect, at = [], 0
    while words and (at == 0 or at - 2 + 4 < n + 0 and at + 2 < n):
        expect.append(words[at : at + 4])
        at += 2
    df = spark.createDataFrame([(" ".join(words),)], "text string").select(dataset.word_chunks(T.parts(F.col("text")), 4, 2).alias("c"))
    assert df.first()["c"] == expect


def test_chunk_heads(spark):
    got = rows(dataset.chunk_records(spark.createDataFrame([(9, "a b c d e f g h i j")], "doc_id long, text string"), 4, 2).select("text"), "text")
    assert got[0][0] == "Document: 9\nChunk 1/4\n---\na b c d" and len(got) == 4


def test_reviewed_pairs_and_split(spark):
    q = "struct<question:string,answers:array<string>,approved:boolean,synthesis_answer:string>"
    df = spark.createDataFrame([("c", [("q1", ["a1"], True, " s "), ("q2", ["a2"], True, ""), ("q3", ["a3"], False, "s"), ("q4", [], True, None), ("", ["a"], True, "s")])], f"context_id string, questions array<{q}>")
    pairs, skipped = dataset.reviewed_pairs(df)
    assert rows(pairs.select("question", "answer"), "question") == [("q1", "s"), ("q2", "a2")] and skipped.first()[0] == 3
    assert dataset.pair_records(pairs).first()["messages"][2]["content"] == "s"
    for n, valid, expect in ((10, 0.1, 1), (1, 0.1, 1), (2, 0.0, 1), (4, 0.5, 2), (1, 0.0, 0), (997, 0.1, 100)):
        got = dataset.split(spark.range(n), F.col("id"), valid)
        assert got.filter("split = 'valid'").count() == expect and got.count() == n
    assert rows(dataset.split(spark.range(50), F.col("id")), "id") == rows(dataset.split(spark.range(50).repartition(7), F.col("id")), "id")


def test_signature_records(spark):
    df = spark.createDataFrame([("t", 3.14159, 0.5, ["x", "y"]), ("u", 0.0, 0.5, [])], "title string, zipf_avg double, rarity_pos double, rare_terms array<string>")
    got = rows(dataset.signature_records(df).select("title", "record", F.col("messages")[2]["content"]), "title", "record")
    assert got[0][2] == "The document 't' has a Zipf average of 3.142 and rarity position of 0.50000. Its rare terms include: x, y." and len(got) == 3
    assert dataset.signature_records(df, plain=True).filter("title = 't'").first()["text"] == "Taxonometry Profile for 't':\n- Zipf Average: 3.142\n- Rarity Position: 0.50000\n- Rare Terms: x, y"


def test_sections_of_long_documents(spark):
    text = "\n".join(f"{'#' * (1 + i % 4)} h{i}" if i % 2 else f"line {i}" for i in range(40_000))
    began = time.time()
    got = dataset.sections(spark.createDataFrame([(1, text), (2, None), (3, "plain\n#no\n ## no"), (4, "# a\n\n### b\nx\n## c\ny\n#\tz\n")], "doc_id long, text string"))
    found = [(r["doc_id"], r["section"], r["header"], r["headers_path"], r["content"]) for r in got.filter("doc_id > 1").orderBy("doc_id", "section").collect()]
    assert found == [(3, 0, "Introduction", [], "plain\n#no\n ## no"), (4, 2, "b", ["a", "b"], "x"), (4, 3, "c", ["a", "c"], "y")]
    assert got.filter("doc_id = 1").count() == 20_000 and time.time() - began < 60


@pytest.mark.parametrize("ranked", [1, 7, 4096])
def test_split_moves_no_record(spark, monkeypatch, ranked):
    monkeypatch.setattr(dataset, "RANKED", ranked)
    own = spark.range(1000).select("id", F.lit("x" * 50).alias("text"))
    got = dataset.split(own, F.col("id"))
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert {r["id"] for r in got.filter("split = 'train'").collect()} == set(order[:900])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    twins = spark.createDataFrame([(i % 3,) for i in range(30)] + [(None,)], "id long")
    sides = dataset.split(twins, F.col("id")).distinct().collect()
    assert len(sides) == 4 and {r["split"] for r in sides if r["id"] is None} == {"valid"}
    assert dataset.split(spark.range(0), F.col("id")).count() == 0 and dataset.split(spark.range(1), F.col("id")).first()["split"] == "valid"


def test_lexical_signatures(spark):
    docs = spark.createDataFrame([(1, "the the of zyx"), (2, None), (3, "Quux quux Blorp the-of abc")], "doc_id long, text string")
    lex = spark.createDataFrame([("the", 7.5), ("of", 4.0)], "word string, zipf double")
    got = {r["doc_id"]: r for r in lexicon.profiled(docs, lex).collect()}
    assert (got[1]["zipf_avg"], got[1]["zipf_low"], got[1]["zipf_medium"], got[1]["zipf_high"]) == (pytest.approx(19 / 4), 1, 1, 2)
    assert got[2]["zipf_avg"] == 0 and got[2]["rare_terms"] == [] and got[3]["rare_terms"] == ["Quux", "Blorp", "the-of"]
    whole = lexicon.rollup(lexicon.profiled(docs, lex)).first()
    assert (whole["documents"], whole["rare_terms_total"], whole["rare_terms_unique"], whole["n_thin"]) == (3, 3, 3, 2)
    empty = lexicon.rollup(lexicon.profiled(docs.limit(0), lex)).first()
    assert (empty["documents"], empty["zipf_avg"], empty["zipf_low"]) == (0, 0.0, 0)
    assert rows(lexicon.without_thin(docs, lexicon.profiled(docs, lex)).select("doc_id"), "doc_id") == [(3,)]
    n = spark.createDataFrame([(" ".join(["a"] * 9 + ["b"]),)], "text string")
    assert rows(lexicon.corpus_lexicon(n, 2), "word") == [("a", pytest.approx(math.log10(9e8)))]


CHAT = [("status", None), ("Original custom instructions no longer available, sorry", "web"), ("You are a careful guide.", "web"), ("This is a long enough first half.", None), ("And this is the second half of it.", None), ("cut it", "web"), ("tiny", None), ("A reply that is long enough to stay.", None), ("go on", "web"), ("A last reply that is long enough.", None), ("", "web")]


def test_turns_and_records(spark):
    df = spark.createDataFrame([(1, i, text, host) for i, (text, host) in enumerate(CHAT)] + [(2, 0, "hi there", "web")], "conv_id long, turn long, text string, host string")
    said = conversations.turns(df)
    one = [r for r in said.orderBy("conv_id", "pos").collect() if r["conv_id"] == 1]
    assert [r["role"] for r in one] == ["system", "assistant", "user", "assistant", "user", "assistant"]
    assert one[1]["content"] == "This is a long enough first half.\n\nAnd this is the second half of it."
    assert [len(r["messages"]) for r in conversations.character_records(said).collect()] == [6]
    led = conversations.character_records(said.filter("role <> 'system'"), fallback="F").first()["messages"]
    assert led[0]["content"] == "F" and len(led) == 6
    painted = [[m["role"] for m in r["messages"]] for r in conversations.painter_records(said).orderBy("pos").collect()]
    assert painted == [["system", "user", "assistant"], ["system", "user", "assistant", "user", "assistant"]]
    opener = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], "conv_id long, pos long, role string, content string")
    assert [[m["content"] for m in r["messages"]] for r in conversations.painter_records(opener).collect()] == [["b", "c"]]
    counts = conversations.manifest(said, conversations.character_records(said), conversations.painter_records(said))
    assert rows(counts, "conv_id") == [(1, 6, 1, 2), (2, 1, 0, 0)]


def test_rewards(spark):
    df = spark.createDataFrame([(1, "I love this so much"), (2, "the report was filed"), (3, "I LOVE this so much"), (4, ""), (5, None)], "seq long, content string")
    lex = spark.createDataFrame([("love", 3.2), ("much", 0.5)], "word string, valence double")
    got = dict(rows(conversations.rewards(df.filter("content is not null"), lex, ["seq"], ["seq"]), "seq"))
    assert got[1] > got[2] and got[3] < got[1] + 0.1 and got[4] == 0.0
    assert conversations.high_reward(spark.createDataFrame([(0.6,), (0.59,)], "reward double")).count() == 1


@pytest.fixture()
def corpus(spark):
    docs = [("a/one.md", "# Care Ethic\nWe follow the Growth Process and the care ethic."), ("process/growth.md", "# Growth Process\nIt needs zorbium."), ("z/two.md", "# care ethic!\nzorbium and careful"), ("z/none.md", "# é\nnothing")]
    return graph.subjects(spark.createDataFrame(docs, "path string, text string")), spark.createDataFrame([("z/two.md", ["zorbium", "careful"]), ("process/growth.md", ["Zorbium"])], "path string, rare_terms array<string>")


def test_graph(spark, corpus):
    subject, rare = corpus
    node = graph.nodes(subject, rare)
    assert rows(node, "id") == [("care-ethic", "ethic", "Care Ethic", 1.0, 2), ("careful", "concept", "careful", 0.5, 1), ("growth-process", "process", "Growth Process", 1.0, 1), ("zorbium", "concept", "Zorbium", 0.5, 1)]
    edge = graph.edges(graph.mentions(subject, node))
    assert rows(edge.select("source", "target", "mentions", "confidence"), "source", "target") == [("care-ethic", "careful", 1, 0.6), ("care-ethic", "growth-process", 1, 1.0), ("care-ethic", "zorbium", 1, 0.6), ("growth-process", "zorbium", 1, 0.6)]
    got = graph.metrics(edge, node).first()
    assert (got["nodes"], got["edges"], got["density"], got["avg_degree"]) == (4, 4, round(8 / 12, 6), 2.0)
    assert got["avg_clustering"] == round((1 / 3 + 0 + 1 + 1) / 4, 6)
    assert tuple(graph.coverage(subject).first()) == (4, 3, 1)
    assert tuple(graph.metrics(edge.limit(0), node.limit(0)).first()) == (0, 0, 0.0, 0.0, 0.0)
    assert graph.memberships(subject).count() == 3 and graph.counts(edge, node).filter("what = 'low_confidence'").first()["n"] == 5


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    least = {x: x for e in edges for x in e}
    for _ in edges:
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    got = dict(rows(components.components(spark.createDataFrame(edges, "u long, v long")), "node"))
    assert got == {x: c for x, c in least.items() if any(u != v and x in (u, v) for u, v in edges)}


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    own = rng.normal(size=(60, 4)).astype(np.float32)
    own[7] = own[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "id long, embedding array<float>")
    far = np.sqrt(((own[:, None].astype(float) - own[None].astype(float)) ** 2).sum(-1))
    expect = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i), key=lambda j: (round(far[i, j], 9), j))[:5]}
    for block in (1000, 17):
        assert {(s, t) for s, t, _, _ in rows(vectors.neighbours(df, 5, block), "source")} == expect
    near = vectors.neighbours(df, 5)
    assert {i: round(c, 6) for i, c in rows(vectors.core_distances(near), "id")} == {i: round(sorted(far[i])[5], 6) for i in range(60)}
    assert {c for _, c in rows(vectors.clusters(near, df, 100.0), "id")} == {0} or len({c for _, c in rows(vectors.clusters(near, df, 100.0), "id")}) <= 3
    node, edge, count = vectors.topology(near, vectors.clusters(near, df, 100.0), vectors.projected(df))
    assert node.count() == 60 and count.first()["edges"] == 300


def test_trajectories(spark):
    import numpy as np

    z = np.random.default_rng(2).normal(size=(9, 3))
    df = spark.createDataFrame([(i % 2, i, z[i].tolist()) for i in range(9)] + [(5, 0, [3.0, 4.0]), (5, 1, [1.0])], "g int, i long, embedding array<double>")
    got = {(g, i): (d, n) for g, i, d, n in rows(vectors.deviations(df, "g", "i"), "trace", "step")}
    for group in (0, 1):
        x, p = np.zeros(3), np.ones(3)
        for i in range(group, 9, 2):
            wide = p + 0.01
            gain = wide / (wide + 0.1)
            assert got[str(group), i][0] == pytest.approx(np.linalg.norm(z[i] - x))
            x, p = x + gain * (z[i] - x), (1 - gain) * wide
    assert got["5", 0] == (5.0, 5.0) and got["5", 1] == (1.0, 1.0)


class Same:
    def complete(self, prompt, attempt):
        return "Q> One? Q> Two?"


class Growing:
    def complete(self, prompt, attempt):
        return f"a{min(attempt, 3)}"


class Broken:
    def complete(self, prompt, attempt):
        raise OSError("no model")


def test_convergence_loops(spark):
    prompts = spark.createDataFrame([("d", "p")], "doc string, prompt string")
    parse = lambda text: [q.strip() for q in text.split("Q>") if q.strip()]
    assert rows(generation.completed(prompts, "doc", Same, parse, 10), "doc") == [("d", ["One?", "Two?"], 2)]
    assert rows(generation.completed(prompts, "doc", Growing, lambda t: [t], 5), "doc") == [("d", ["a1", "a2", "a3"], 4)]
    with pytest.raises(Exception, match="no model"):
        generation.completed(prompts, "doc", Broken, parse, 2).collect()
    passes = spark.createDataFrame([("d", 1, ["x", "y"]), ("d", 2, ["y", "z"]), ("d", 3, ["x"]), ("d", 4, ["w"]), ("e", 1, [])], "doc string, n int, found array<string>")
    assert rows(generation.converged(passes, "doc", "n", F.col("found"), 10), "doc") == [("d", ["x", "y", "z"], 3), ("e", [], 1)]


def test_grading(spark):
    df = generation.graded(spark.createDataFrame([("c", "RATING: 5\nSYNTHESIS: yes"), ("c", "rating: 2"), ("d", "?")], "context_id string, reply string"))
    assert [(r["rating"], r["approved"]) for r in df.collect()] == [(5, True), (2, False), (0, False)] and tuple(generation.curation_report(df, "context_id").first()) == (2, 3, 1)
    ask = spark.createDataFrame([("c", "ctx", "why?", ["a"])], "id string, context string, question string, answers array<string>")
    assert "- a\n" in generation.curation_prompts(ask, "id").first()["prompt"] and "ctx" in generation.answer_prompts(ask, "id").first()["prompt"] and generation.question_prompts(ask, "id", "context").first()["prompt"].endswith("Paragraph: ctx")


def test_commands(spark):
    rows_ = [("1", "d", "ORCHESTRATION_ACTION_PREPARE", 1), ("1", "d", "prepare", 2), ("2", "d", "Train", 3), ("3", "d", "dance", 4), ("3", "d", "train", 5), (None, "d", "train", 6), ("4", None, "train", 7)]
    df = spark.createDataFrame(rows_, "command_id string, dataset_id string, action string, seq long")
    assert [r["status"] for r in control.judged(df).orderBy("seq").collect()] == ["accepted", "duplicate", "accepted", "rejected", "accepted", "invalid", "invalid"]
    many = spark.range(4096 + 50).select(F.col("id").cast("string").alias("command_id"), F.col("id").alias("seq"))
    kept = control.retained(many)
    assert kept.count() == 4096 and kept.agg(F.min("seq")).first()[0] == 50
    states = spark.createDataFrame([("done",), ("Queued",), ("x",), (None,)], "s string")
    assert [r[0] for r in states.select(control.wire_state(F.col("s"))).collect()] == ["COMPLETED", "QUEUED", "UNSPECIFIED", "UNSPECIFIED"]


def test_model_resolution(spark):
    sources = spark.createDataFrame([(0, "p", "http://host.docker.internal:1/x", False, ["mistral"]), (1, "q", "http://host.docker.internal/x", True, ["a", "Mistral:7b", "mistral"])], "place int, provider string, url string, healthy boolean, models array<string>")
    got = control.resolved(sources, spark.createDataFrame([("mistral",), ("zzz",)], "name string"))
    assert rows(got, "name") == [("mistral", "q", "http://127.0.0.1/x", "Mistral:7b"), ("zzz", None, None, None)]


def test_verification_and_gates(spark):
    good = '{"archetype": "a", "routing": {"summarization": "m"}}'
    df = spark.createDataFrame([("ok", list(control.DIRS), 2, 10, good), ("bad", ["schema"], 0, 0, "{"), ("none", None, None, None, None), ("part", list(control.DIRS), 1, 1, '{"routing": {}}')], "dataset_id string, dirs array<string>, corpus_files int, corpus_bytes int, schema_json string")
    got = {r["dataset_id"]: r for r in control.verify(df).collect()}
    assert got["ok"]["valid"] and not got["ok"]["issues"] and got["bad"]["issues"][1:] == ["raw_data has no .md corpus", "schema.json is invalid json"] and len(got["none"]["issues"]) == 3
    assert got["part"]["issues"] == ["schema.json missing 'archetype'", "schema.json missing 'routing'"]
    with pytest.raises(control.GateFailed):
        control.gate(df.limit(0), "nothing here")
    assert control.gate(df, "x") is df


def test_totals_and_throughput(spark):
    commits = spark.createDataFrame([("f", "h2", "2024-02-01", 3, 1), ("f", "h1", "2024-01-01", 5, 0)], "path string, commit_hash string, date string, additions int, deletions int")
    got = control.totals(commits, ["path"]).first()
    assert (got["commits"], got["additions"], got["deletions"], got["last_modified_commit"]) == (2, 8, 1, "h2") and [h["commit_hash"] for h in control.history(commits, ["path"]).orderBy("path", "date").collect()] == ["h1", "h2"]
    runs = spark.createDataFrame([(10, 1.0, 3.0), (10, 1.0, 1.0)], "output_tokens int, start_time double, end_time double")
    assert [r["token_throughput"] for r in control.throughput(runs).collect()] == [5.0, 0.0]


class Capitals:
    """Tags capitalised words as proper nouns, digits as numbers, others as verbs."""

    def __call__(self, text):
        return [(w, "PROPN" if w[0].isupper() else "NUM" if w.isdigit() else "VERB") for w in text.split()]


def test_rare_terms_by_boundary_and_by_tagger(spark):
    import re

    texts = ["---- --word -foob- naïve-test x_abcd abcd_ Zorb-ium, zorb-ium common", "a b-c-d éabcd abcdé", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    known = spark.createDataFrame([("common", 5.0), ("paris", 6.0)], "word string, zipf double")
    got = {r["doc_id"]: r["rare_terms"] for r in lexicon.rare_terms(docs, known).collect()}
    for i, text in enumerate(texts):
        first = {}
        for term in re.findall(r"\b[a-zA-Z-]{4,}\b", text):
            if term.lower() != "common":
                first.setdefault(term.lower(), term)
        assert got.get(i, []) == list(first.values())
    named = spark.createDataFrame([(1, "Paris saw Quux 12 Zo run"), (2, "")], "doc_id int, text string")
    profile = {r["doc_id"]: r for r in lexicon.profiled(named, known, tagger=Capitals).collect()}
    assert profile[1]["rare_terms"] == ["Quux"] and profile[1]["rarity_pos"] == 4 / 6 and profile[2]["rarity_pos"] == 0.5 and profile[2]["rare_terms"] == []


def test_triangles_of_several_shares_equal_plain_ones(spark):
    import itertools
    import random

    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(260)} | {(0, i) for i in range(1, 40)}
    expect = {}
    for a, b, c in itertools.combinations(range(40), 3):
        if {(a, b), (a, c), (b, c)} <= pairs:
            for x in (a, b, c):
                expect[x] = expect.get(x, 0) + 1
    for most in (1 << 20, 150, 20):
        got = graph.triangles(spark.createDataFrame(sorted(pairs), "s long, t long"), most)
        assert {r["a"]: r["links"] for r in got.collect()} == expect


def test_labels_of_two_words_are_told_without_searching_texts(spark):
    node = spark.createDataFrame([("a", "red fox.", 1.0), ("b", "(red fox", 1.0), ("c", "red fox", 1.0), ("d", "fox,", 0.5), ("e", "red fox ran on", 1.0), ("f", "(red fox.", 0.5), ("g", "red fox. ", 1.0)], "id string, label string, confidence double")
    texts = ["the Red fox. ran", "the Red fox.ran", "the (red fox", "the(red fox", "a red fox ran on", "fox,fox", "(red fox.", "a(red fox.a", "red fox. a"]
    subject = spark.createDataFrame([(f"s{i}", f"p{i}", x) for i, x in enumerate(texts)], "id string, path string, text string")
    found = {}
    for r in graph.mentions(subject, node).collect():
        found.setdefault(r["source"], []).append(r["target"])
    assert {k: "".join(sorted(v)) for k, v in found.items()} == {"s0": "cg", "s1": "ac", "s2": "c", "s3": "bc", "s4": "ce", "s5": "d", "s6": "c", "s7": "abcf", "s8": "cg"}
