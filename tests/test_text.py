"""Column functions on the cases that the survey's fixtures describe."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import chat, frames, markdown
from corpusmill.functions import text as T
from corpusmill.operators import graph


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in ("a", "b")[: len(rows[0]) if isinstance(rows[0], tuple) else 1]))
    return [tuple(r)[0] if len(columns) == 1 else tuple(r) for r in df.orderBy("i").select(*columns).collect()]


def test_punctuation_and_misread_bytes(spark):
    rows = ["“hi” — it’s…", "itâ\u0080\u0099s 1â\u0080\u00932", "a\\nb c \U0001f600", "xî\u0088\u0084î\u0088\u0086y", "plain"]
    assert values(spark, rows, T.repaired(F.col("a"))) == ['"hi" -- it\'s...', "it's 1-2", "a\nb c \U0001f600", "xy", "plain"]


def test_questions_of_completions(spark):
    rows = ["Q> What is care?\nQ> 2. How is it kept?", "Care is what?> Maintenance, or q> 1) Why? noise", "no marker", "Q> ?", ""]
    assert values(spark, rows, T.questions(F.col("a"))) == [["What is care?", "How is it kept?"], ["Care is what?", "Why?"], [], [], []]


def test_ratings(spark):
    rows = ["RATING: 5\nSYNTHESIS: All\nof it. ", "I'd say rating: 10", "nothing", "RATING: 9"]
    assert values(spark, rows, T.rating(F.col("a")), T.synthesis(F.col("a"))) == [(5, "All\nof it."), (1, ""), (0, ""), (0, "")]


def test_titles_slugs_and_kinds(spark):
    rows = [("intro\n  # The Care Ethic \n", "a/b.md"), ("no heading", "x/my-own_note.md"), ("# t", "process/ethic/sub/n.md"), ("# Axiomatic", "q/w.md"), ("#no", "q/systems-of.x.md")]
    title = T.title(F.col("a"), F.col("b"))
    assert values(spark, rows, title) == ["The Care Ethic", "my own note", "t", "Axiomatic", "systems of.x"]
    assert values(spark, rows, T.kind(F.col("b"), title)) == ["ethic", "concept", "ethic", "axiom", "system"]
    assert values(spark, ["  The Café--x! ", "é", "A_b"], T.slug(F.col("a"))) == ["the-caf-x", "", "a-b"]


def test_words_and_estimates(spark):
    assert values(spark, ["Ünïted we_stand, 42-x"], T.words(F.col("a"))) == [["ünïted", "we_stand", "42", "x"]]
    assert values(spark, ["one two three four five", "", "  a "], T.token_estimate(F.col("a"))) == [6, 0, 1]
    assert values(spark, ["\n\t a b \r\n"], T.strip(F.col("a"))) == ["a b"]


def test_paragraphs(spark):
    rows = ["# Head\n\nfirst line\nof **one**\n\n\nsecond `two`\r\n", None, ""]
    assert values(spark, rows, markdown.paragraphs(F.col("a"))) == [["first line of one", "second two"], None, []]
    html = ["<p>a <b>x</b></p><p class='q'>two <strong>bold</strong> end</p><pre>no</pre><p> </p>"]
    assert values(spark, html, T.html_paragraphs(F.col("a"))) == [["a", "two bold end"]]


@pytest.mark.parametrize(
    ("text", "expect"),
    [
        ("- item one\n- item two\n\n+ x\n\n* y\n\n12. z", []), ("-x\n\n1.y\n\n*z*", ["-x", "1.y", "z"]), ("a\n\n- b\n\nc", ["a", "c"]),
        ("> quote\n\n#Heading of\nall lines\n\n---\n\n* * *\n\n___", []), ("Two\n===", ["Two ==="]), ("--", ["--"]),
        ("```py\n\ncode\n\n```\n\nafter", ["after"]), ("```\ncode\n```", ["code"]), ("~~~\n\nnever closed", ["~~~", "never closed"]), ("````\n\na\n\n```\n\n````", []),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["| a | b | |---|---| | 1 | 2 |"]),
        ("See [docs](http://x) now.", ["See "]), ("[x](u) first", []), ("See ![i](u) x", ["See "]), ("a [b] c [d](e", ["a [b] c [d](e"]), ("a [b [c]](u(v)) d", ["a "]),
        ("[id]: http://x 'T'\n\nsee [the][ID] x\n\nand [id] y\n\nand [no][other] z", ["see ", "and ", "and [no][other] z"]),
        ("[^1]: note\n\ntext[^1] more\n\ntext[^2]", ["text", "text[^2]"]), ("*[HTML]: Hyper\n\nall HTML here, XHTML", ["all "]),
        ("Term\n\n: what it is\n\nplain", ["plain"]), (": alone", [": alone"]), ("- x\n\n: y", []),
        ("**b** *i* __u__ _v_ ***w*** a*b*c", ["b i u v w abc"]), ("2 * 3 * 4 and a_b_c and _open", ["2 * 3 * 4 and a_b_c and _open"]), ("x*** y*** z***", ["x y z***"]), ("**a *b* c** d", ["a b c d"]),
        ("`a*b*` and ``c`d`` [x](y)", ["a*b* and c`d "]), ("`[x](y)` \\*no\\* \\[x](y)", ["[x](y) *no* [x](y)"]), ("a ` b", ["a ` b"]),
        ("a <br> b", ["a "]), ("a <em>b</em> <span class='x'>c</span> <i>d</i>", ["a b c "]), ("x <!-- no --> y < z & w &lt; &copy;", ["x  y < z & w < ©"]), ("mail <a@b.c> x", ["mail "]), ("<b>x</b> y", []),
        ("<div>a\n\nb</div> after\n\nc", ["after", "c"]), ("<div><div>a</div>\n\nb", []), ("<p>raw *x* <b>y</b></p>\n\n<p>z</p>", ["raw *x* ", "z"]), ("<hr>\n\nx", ["x"]), ("<ul><li>a</li></ul>", []),
        ("a\r\n  b\rc", ["a b c"]), ("  \n\t\n", []), ("\ue000a\ue001", ["a"]),
    ],
)
def test_markdown_blocks(text, expect):
    assert markdown.leads(text) == expect


def test_long_markdown():
    text = "\n\n".join(["```", "x [y"] * 3000 + ["a *b `c _d"] * 3000)
    assert len(markdown.leads(text)) >= 3000

def test_mentions_keep_word_boundaries(spark):
    import re

    rows = [("The CARE ethic.", "care Ethic"), ("careful", "care"), ("a c++b", "c++b"), ("a c++b", "xc++"), ("ac++b", "c++b"), ("x_care", "care"), ("l'été, l'été", "l'été"), ("of, the", "of, the"), ("of,  the", "of, the"), ("a foo-bar-", "foo-"), ("a foo-", "foo-"), ("x ---- y", " ---- "), ("x ----y", "----"), ("x----y", "----"), ("one two three four", "two three four"), ("one two, three four", "two three four"), ("a b c b c d", "b c d"), ("a b c x c d", "b c d a"), ("q -ab cd- r", "-ab cd-"), ("q-ab cd-r", "-ab cd-")]
    texts = spark.createDataFrame([(f"t{i}", f"p{i}", a) for i, (a, _) in enumerate(rows)], "id string, path string, text string")
    nodes = spark.createDataFrame([(f"n{i}", b, 1.0) for i, (_, b) in enumerate(rows)], "id string, label string, confidence double")
    got = {(r["source"], r["target"]) for r in graph.mentions(texts, nodes).collect()}
    assert got == {(f"t{i}", f"n{j}") for i, (a, _) in enumerate(rows) for j, (_, b) in enumerate(rows) if len(b) >= 4 and re.search(rf"\b{re.escape(b)}\b", a, re.I)}


def test_prompts_and_messages(spark):
    one = spark.createDataFrame([("ctx {question}", "why?", ["a", "b"], [])], "c string, q string, two array<string>, none array<string>")
    got = one.select(chat.filled("C:{context} Q:{question}{x}", context=F.col("c"), question=F.col("q")), chat.bullets(F.col("two")), chat.bullets(F.col("none")), chat.transcript(F.array(chat.message("user", F.col("q")), chat.message("assistant", F.col("c"))))).first()
    assert tuple(got) == ("C:ctx {question} Q:why?{x}", "- a\n- b", "- (none)", "User: why?\nAssistant: ctx {question}\nAssistant: ")
    assert [r[0] for r in spark.createDataFrame([("user",), ("assistant",), ("system",)], "r string").select(chat.inverted(F.col("r"))).collect()] == ["assistant", "user", "system"]


def test_frames_round_trip(spark):
    df = spark.createDataFrame([(0, b"abc"), (1, b""), (63, b"\x00\xff")], "n int, p binary").withColumn("f", frames.encoded(F.lit(258), F.col("n"), F.col("p")))
    got = df.select("n", "p", "f", frames.decoded(F.col("f")).alias("d")).collect()
    assert bytes(got[0]["f"]) == b"\x00\x00\x00\x01\x02\x00abc" and bytes(got[1]["f"]) == b"\x00\x00\x00\x01\x02\x02\x02"
    assert all((r["d"]["schema_id"], r["d"]["index"], bytes(r["d"]["payload"])) == (258, r["n"], bytes(r["p"])) for r in got)
    bad = spark.createDataFrame([(b"",), (b"\x01\x00\x00\x00\x01\x00x",), (b"\x00\x00\x00",), (b"\x00\x00\x00\x00\x01\x02",)], "f binary")
    assert [r[0] for r in bad.select(frames.decoded(F.col("f"))).collect()] == [None] * 4


def plain_varint(n):
    zigzag, out = (n << 1) ^ (n >> 63), b""
    zigzag &= (1 << 64) - 1
    while zigzag > 127:
        out, zigzag = out + bytes([zigzag & 127 | 128]), zigzag >> 7
    return out + bytes([zigzag])


def test_frames_with_any_indexes(spark):
    singles = [[n] for n in (0, 1, 63, 64, 127, 128, 300, 8191, 8192, 2**31 - 1, 2**31, 2**62, 2**63 - 1, -1, -64, -(2**63))]
    lists = [*singles, [0, 0], [5, 64, 0, 2**31], [7] * 130]
    rows = [(p, b"\x80\x00payload"[: i % 9]) for i, p in enumerate(lists)]
    got = spark.createDataFrame(rows, "p array<long>, b binary").withColumn("f", frames.encoded_path(F.lit(9), F.col("p"), F.col("b"))).select("p", "b", "f", frames.decoded(F.col("f")).alias("d")).collect()
    for (path, payload), r in zip(rows, got, strict=True):
        place = b"\x00" if path == [0] else plain_varint(len(path)) + b"".join(map(plain_varint, path))
        assert bytes(r["f"]) == b"\x00\x00\x00\x00\x09" + place + payload
        assert (r["d"]["schema_id"], r["d"]["index"], r["d"]["indexes"], bytes(r["d"]["payload"])) == (9, path[0], path, payload)


def test_frames_that_are_malformed_or_odd(spark):
    head = "0000000009"
    cases = {head: None, head + "02": None, head + "0280": None, head + "0402": None, head + "80" * 10 + "01": None, head + "ff" * 9 + "0241": None, head + "02" + "80" * 10 + "00": None, "01" + head[2:] + "0041": None, head + "0e0202": None}
    cases |= {head + "800041": ([], b"A"), head + "0141": ([], b"A"), head + "02800141": ([64], b"A"), head + "0282808000" + "41": ([1], b"A"), head + "00": ([0], b"")}  # no index, fewer than none, long forms
    rows = spark.createDataFrame([(bytes.fromhex(x),) for x in cases], "f binary").select("f", frames.decoded(F.col("f")).alias("d")).collect()
    for r, (digits, expect) in zip(rows, cases.items(), strict=True):
        assert (r["d"] and (r["d"]["indexes"], bytes(r["d"]["payload"]))) == expect, digits


def test_edges_of_words(spark):
    rows = ["one two, three", "a.b c", "achung | x", "plain words only", "", "x\u00a0y -z"]
    whole, some = (values(spark, rows, T.edges(F.col("a"), False, blank)) for blank in (True, False))
    alone = lambda x: x.strip("\t\n\x0b\f\r ") != x and x.strip("\t\n\x0b\f\r ").isalnum()
    assert some == [[x for x in found if not alone(x)] for found in whole] and some[0] == [", three", "two, "] and some[3] == some[4] == []
    assert values(spark, rows, T.edges(F.col("a"), True)) == [[], [".b", "a."], [], [], [], ["\u00a0y", "x\u00a0"]]
