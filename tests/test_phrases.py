"""Phrases by the automaton against trying all phrases at all places."""

import random

from weftline.operators import phrases


def tried(text, vocabulary):
    out = []
    for start in range(len(text)):
        hits = [(len(p), -i) for i, p in enumerate(vocabulary) if p and text.startswith(p, start)]
        if hits:
            n, i = max(hits)
            out.append((start, start + n, -i))
    return out


def test_longest_phrase_at_each_place():
    rng = random.Random(3)
    for _ in range(1500):
        vocabulary = ["".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 12))]
        text = "".join(rng.choices("abcd", k=rng.randint(0, 40)))
        assert phrases.Automaton(vocabulary).longest(text) == tried(text, vocabulary), (vocabulary, text)
    words = [p for p, _ in phrases.VOCABULARY]
    text = " ".join(rng.choices([w for p in words for w in p.split()], k=3000))
    assert phrases.Automaton(words).longest(text) == tried(text, words)
    assert phrases.Automaton(["a" * 40, "a"]).longest("a" * 39 + "b")[:2] == [(0, 1, 1), (1, 2, 1)]


def test_lines_and_verdicts(spark):
    lines = [(1, 1, "Light  RAIN showers"), (1, 2, None), (1, 3, "rain"), (2, 1, ""), (3, 1, "wind"), (3, 2, "Ｃ fog"), (4, 1, "snow or rain"), (4, 1, "snow or rain"), (None, 1, "fog")]
    df = spark.createDataFrame(lines, "unit long, line long, text string").withColumnRenamed("text", "line_text")
    hits = phrases.condition_hits(df, ["unit", "line"], "line_text")
    got = {(r.unit, r.line, r.start, r.stop, r.code) for r in hits.collect()}
    assert got == {(1, 1, 0, 18, 80), (1, 1, 6, 18, 80), (1, 3, 0, 4, 61), (3, 2, 2, 5, 45), (4, 1, 0, 4, 71), (4, 1, 8, 12, 61), (None, 1, 0, 3, 45)}
    expected = spark.createDataFrame([(1, 61), (1, 80), (2, 0), (3, 61), (4, 71), (5, 3), (None, 45)], "unit long, expected int")
    told = {(r.unit, r.expected): (r.state, r.first_line, r.others) for r in phrases.condition_verdicts(hits, expected, "unit", "line").collect()}
    assert told == {(1, 61): ("match", 3, None), (1, 80): ("match", 1, None), (2, 0): ("not-found", None, None), (3, 61): ("mismatch", None, "45"), (4, 71): ("mismatch", None, "61"), (5, 3): ("not-found", None, None), (None, 45): ("not-found", None, None)}


def test_empty(spark):
    none = spark.createDataFrame([], "unit long, line long, text string")
    assert phrases.condition_hits(none, ["unit", "line"], "text").count() == 0
