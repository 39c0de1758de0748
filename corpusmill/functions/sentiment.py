"""Sentiment of a text by a lexicon of valences and ordered rules over its words.

A word's valence is changed, in this order, by "no" beside it, by capitals, by each of the three words before it (degree words,
weaker with distance; negations), by fixed phrases around it, and by "least". A "but" halves what stands before it and raises
what follows by half; exclamation and question marks strengthen the sum. Shares count a valence and one a word.
"""

from __future__ import annotations

import heapq
import math
import string
from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, negations, degree words and phrases of the published rules.
RAISE, CAPITALS, REVERSE, NEVER_SO = 0.293, 0.733, -0.74, 1.25
DISTANCE = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, FEW_QUESTIONS, MANY_QUESTIONS = 0.292, 4, 0.18, 3, 0.96
NORMAL = 15
NEGATIONS = frozenset(
    """aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt hasnt
    havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never none nope nor
    not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont
    wouldnt won't wouldn't rarely seldom despite""".split()
)
MORE = """absolutely,amazingly,awfully,completely,considerable,considerably,decidedly,deeply,effing,enormous,enormously,entirely,
especially,exceptional,exceptionally,extreme,extremely,fabulously,flipping,flippin,frackin,fracking,fricking,frickin,frigging,
friggin,fully,fuckin,fucking,fuggin,fugging,greatly,hella,highly,hugely,incredible,incredibly,intensely,major,majorly,more,most,
particularly,purely,quite,really,remarkably,so,substantially,thoroughly,total,totally,tremendous,tremendously,uber,unbelievably,
unusually,utter,utterly,very"""
LESS = """almost,barely,hardly,just enough,kind of,kinda,kindof,kind-of,less,little,marginal,marginally,occasional,occasionally,
partly,scarce,scarcely,slight,slightly,somewhat,sort of,sorta,sortof,sort-of"""
DEGREES = {**{w.strip(): RAISE for w in MORE.split(",")}, **{w.strip(): -RAISE for w in LESS.split(",")}}
PHRASES = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9}


def words(text: str) -> list[str]:
    """Words between white space without punctuation at their ends, unless two characters or fewer would be left."""
    return [w if len(s := w.strip(string.punctuation)) <= 2 else s for w in text.split()]


def spoken(text: Column) -> Column:
    """What words of a text a lexicon may hold: lower-cased, with and without punctuation at their ends."""
    parts = F.split(F.lower(text), r"(?U)\s+")
    return F.array_distinct(F.concat(parts, F.transform(parts, lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))))


def negates(word: str) -> bool:
    return word in NEGATIONS or "n't" in word


def _degree(word: str, valence: float, loud: bool) -> float:
    """What a word before adds to a valence."""
    change = DEGREES.get(word.lower(), 0.0)
    if change:
        change = -change if valence < 0 else change
        if loud and word.isupper():
            change += CAPITALS if valence > 0 else -CAPITALS
    return change


def _negated(valence: float, low: list[str], i: int, back: int) -> float:
    """valence after the word back places before place i."""
    word = low[i - back]
    if back > 1 and word == "never" and low[i - back + 1] in ("so", "this") or back == 3 and low[i - 1] in ("so", "this"):
        return valence * NEVER_SO
    if back > 1 and word == "without" and "doubt" in low[i - back + 1 : i]:
        return valence
    return valence * REVERSE if negates(word) else valence


def _phrased(valence: float, low: list[str], i: int) -> float:
    """valence, or that of a phrase that ends at place i or before it, or begins there; degree words of two or three words."""
    joined = lambda a, b: " ".join(low[a:b])
    for a, b in ((i - 1, i + 1), (i - 2, i + 1), (i - 2, i), (i - 3, i), (i - 3, i - 1)):
        if joined(a, b) in PHRASES:
            valence = PHRASES[joined(a, b)]
            break
    for end in (i + 2, i + 3):
        if end <= len(low):
            valence = PHRASES.get(joined(i, end), valence)
    return valence + sum(DEGREES.get(joined(a, b), 0.0) for a, b in ((i - 3, i), (i - 3, i - 1), (i - 2, i)))


def _valence(own: list[str], low: list[str], i: int, loud: bool, lexicon: Mapping[str, float]) -> float:
    if low[i] in DEGREES or low[i : i + 2] == ["kind", "of"] or low[i] not in lexicon:
        return 0.0
    valence = lexicon[low[i]]
    if low[i] == "no" and i + 1 < len(low) and low[i + 1] in lexicon:
        valence = 0.0
    if "no" in low[max(i - 2, 0) : i] or i > 2 and low[i - 3] == "no" and low[i - 1] in ("or", "nor"):
        valence = lexicon[low[i]] * REVERSE
    if loud and own[i].isupper():
        valence += CAPITALS if valence > 0 else -CAPITALS
    for back in (1, 2, 3):
        if i >= back and low[i - back] not in lexicon:
            valence = _negated(valence + DISTANCE[back - 1] * _degree(own[i - back], valence, loud), low, i, back)
            if back == 3:
                valence = _phrased(valence, low, i)
    if i > 0 and low[i - 1] == "least" and "least" not in lexicon and not (i > 1 and low[i - 2] in ("at", "very")):
        valence *= REVERSE
    return valence


def valences(own: list[str], lexicon: Mapping[str, float]) -> list[float]:
    """Each word's valence after all rules but those of marks."""
    low = [w.lower() for w in own]
    loud = 0 < sum(w.isupper() for w in own) < len(own)
    out = [_valence(own, low, i, loud, lexicon) for i in range(len(own))]
    if "but" in low:
        _around_but(out, low.index("but"))
    return out


def _around_but(values: list[float], at: int) -> None:
    """Halves what stands before place at and raises what follows. Of equal values, the first one changes each time."""
    places: defaultdict[float, list[int]] = defaultdict(list)
    for i, v in enumerate(values):
        places[v].append(i)
    for i in range(len(values)):
        if v := values[i]:
            while values[places[v][0]] != v:
                heapq.heappop(places[v])
            first = heapq.heappop(places[v])
            values[first] *= BEFORE_BUT if first < at else AFTER_BUT if first > at else 1.0
            heapq.heappush(places[values[first]], first)


def emphasis(text: str) -> float:
    asked = text.count("?")
    return min(text.count("!"), MOST_EXCLAMATIONS) * EXCLAMATION + (0 if asked < 2 else asked * QUESTION if asked <= FEW_QUESTIONS else MANY_QUESTIONS)


def polarity(text: str, lexicon: Mapping[str, float]) -> tuple[float, float, float, float]:
    """The negative, neutral and positive shares (three digits), and the compound between -1 and 1 (four digits)."""
    felt = valences(words(text), lexicon)
    if not felt:
        return 0.0, 0.0, 0.0, 0.0
    total, marks = float(sum(felt)), emphasis(text)
    total += math.copysign(marks, total) if total else 0.0
    up, down, flat = sum(v + 1 for v in felt if v > 0), sum(v - 1 for v in felt if v < 0), sum(v == 0 for v in felt)
    if up > -down:
        up += marks
    elif up < -down:
        down -= marks
    whole = up - down + flat
    compound = min(max(total / math.sqrt(total * total + NORMAL), -1.0), 1.0)
    return round(-down / whole, 3), round(flat / whole, 3), round(up / whole, 3), round(compound, 4)


def charge(text: str, lexicon: Mapping[str, float]) -> float:
    """Strength of feeling either way and the share of words with feeling, half each; at most 1."""
    _, flat, _, compound = polarity(text, lexicon)
    return min(0.5 * abs(compound) + 0.5 * (1.0 - flat), 1.0)
