"""Each sentiment rule by numbers, and charges against the rules on texts of every kind."""

import random

import pytest

from corpusmill.functions import sentiment
from corpusmill.operators import conversations

LEXICON = {"good": 2.0, "bad": -2.5, "love": 3.2, "terrifies": -2.6, "no": -1.2, "die": -2.9, "shit": -2.6, ":)": 2.0, "fine": 0.8}


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("a good day", [0, 2.0, 0]),
        ("good, 'bad'! :) (of)", [2.0, -2.5, 2.0, 0]),  # marks at the ends; short words keep theirs
        ("very good", [0, 2.293]), ("very bad", [0, -2.793]), ("slightly good", [0, 1.707]), ("slightly bad", [0, -2.207]),
        ("very old good", [0, 0, 2 + 0.95 * 0.293]), ("very old a good", [0, 0, 0, 2 + 0.9 * 0.293]), ("very old a b good", [0, 0, 0, 0, 2.0]),
        ("a GOOD day", [0, 2.733, 0]), ("a BAD day", [0, -3.233, 0]), ("GOOD DAY", [2.0, 0]), ("VERY good day", [0, 2 + 0.293 + 0.733, 0]), ("VERY bad day", [0, -2.5 - 0.293 - 0.733, 0]),
        ("not good", [0, -1.48]), ("isn't bad", [0, 1.85]), ("not very good", [0, 0, 2.293 * -0.74]), ("not a b good", [0, 0, 0, -1.48]), ("not a b c good", [0, 0, 0, 0, 2.0]),
        ("xn't good", [0, -1.48]), ("never so good", [0, 0, (2 + 0.293) * 1.25]), ("never a good", [0, 0, -1.48]), ("never so very good", [0, 0, 0, (2 + 0.293 + 0.95 * 0.293) * 1.25]),
        ("without doubt good", [0, 0, 2.0]), ("without a doubt good", [0, 0, 0, 2.0]), ("without a good", [0, 0, -1.48]),
        ("a b this good", [0, 0, 0, 2.5]),  # the word before alone raises, three words on
        ("least good", [0, -1.48]), ("at least good", [0, 0, 2.0]), ("the least good", [0, 0, -1.48]), ("very least good", [0, 0, 2 + 0.95 * 0.293]),
        ("no good", [0, 2.0 * -0.74]), ("no x good", [-1.2, 0, 2.0 * -0.74]), ("no man", [-1.2, 0]), ("no x or good", [-1.2, 0, 0, -1.48]),
        ("good but bad", [1.0, 0, -3.75]), ("good good but bad but bad", [1.0, 1.0, 0, -3.75, 0, -3.75]),
        ("x y z to die for", [0, 0, 0, 0, -2.9, 0]), ("x y z die for", [0, 0, 0, -2.9, 0]), ("a b the shit", [0, 0, 0, 3.0]), ("the shit", [0, -2.6]),
        ("x kind of good", [0, 0, 0, 2.0 - 0.293]), ("kind of good", [0, 0, 2.0]), ("very of", [0, 0]),
    ],
)
def test_rules(text, values):
    assert sentiment.valences(sentiment.words(text), LEXICON) == pytest.approx(values)


def test_of_equal_values_the_first_changes():
    rng = random.Random(2)
    for _ in range(300):
        values = [rng.choice([0.0, 1.0, 2.0, 4.0, -1.0, -2.0, 1.5, 3.0]) for _ in range(rng.randint(1, 12))]
        at, plain = rng.randrange(len(values)), values.copy()
        for v in plain:
            first = plain.index(v)
            plain[first] = v * (0.5 if first < at else 1.5 if first > at else 1)
        sentiment._around_but(values, at)
        assert values == plain


def test_shares_and_compound():
    assert sentiment.polarity("", LEXICON) == sentiment.polarity("  ", LEXICON) == (0.0, 0.0, 0.0, 0.0)
    assert sentiment.polarity("a good day", LEXICON) == (0.0, 0.4, 0.6, round(2 / 19**0.5, 4))
    s = 2 + 4 * 0.292  # five marks count as four
    assert sentiment.polarity("good!!!!!", LEXICON) == (0.0, 0.0, 1.0, round(s / (s * s + 15) ** 0.5, 4))
    down = 2.5 + 0.96
    assert sentiment.polarity("bad??? ?", LEXICON) == (round((3.5 + 0.96) / (4.46 + 1), 3), round(1 / 5.46, 3), 0.0, round(-down / (down * down + 15) ** 0.5, 4))
    assert sentiment.emphasis("?") == 0 and sentiment.emphasis("???") == pytest.approx(0.54)


def test_charges(spark):
    felt, flat = "I love you so much it terrifies me.", "The package shipped on Tuesday."
    texts = [felt, flat, "", "  ", None, "GOOD but not BAD!! " * 200, "é good\x0bÉ"]
    said = spark.createDataFrame([(i, str(i % 2), t) for i, t in enumerate(texts)], "id long, part string, content string")
    lexicon = spark.createDataFrame([*LEXICON.items(), ("Good", 1.0), ("unused", 9.0)], "word string, valence double")
    got = {r["id"]: r["charge"] for r in conversations.charges(said, lexicon, ["id", "part"]).collect()}
    assert got == {i: sentiment.charge(t or "", LEXICON) for i, t in enumerate(texts)} and got[0] > got[1] == 0.0 and got[3] == 0.5


def test_rewards_of_frequent_texts(spark):
    said = spark.createDataFrame([(i, "Good day" if i % 3 else f"day {i}") for i in range(60)], "id long, content string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    got = {r["id"]: r["reward"] for r in conversations.rewards(said, lexicon, ["id"], ["id"]).collect()}
    base = 8 / 200 * 0.4 + 0.4 * sentiment.charge("Good day", LEXICON)
    assert got[1] == pytest.approx(base + 0.2) and all(got[i] == pytest.approx(base) for i in range(2, 60) if i % 3)
    assert all(got[i] == pytest.approx(0.2 + 0.4 * len(f"day {i}") / 200) for i in range(0, 60, 3))
