"""Phrases of a vocabulary in texts: one pass a text by an automaton, however many phrases there are."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import folded

#: Weather codes and the phrases that stand for them.
CONDITIONS = {
    0: ("clear sky", "clear", "sunny"), 1: ("mainly clear", "mostly clear", "mostly sunny"), 2: ("partly cloudy", "partly sunny"), 3: ("overcast", "cloudy"),
    45: ("fog", "foggy"), 48: ("depositing rime fog", "rime fog"),
    51: ("light drizzle", "drizzle"), 53: ("moderate drizzle",), 55: ("dense drizzle", "heavy drizzle"), 56: ("light freezing drizzle",), 57: ("dense freezing drizzle", "heavy freezing drizzle"),
    61: ("slight rain", "light rain", "rain"), 63: ("moderate rain",), 65: ("heavy rain",), 66: ("light freezing rain",), 67: ("heavy freezing rain",),
    71: ("slight snow", "light snow", "snow"), 73: ("moderate snow",), 75: ("heavy snow",), 77: ("snow grains",),
    80: ("slight rain showers", "light rain showers", "rain showers"), 81: ("moderate rain showers",), 82: ("violent rain showers", "heavy rain showers"),
    85: ("slight snow showers", "light snow showers", "snow showers"), 86: ("heavy snow showers",),
    95: ("thunderstorm",), 96: ("thunderstorm with slight hail", "thunderstorm with hail"), 99: ("thunderstorm with heavy hail",),
}
VOCABULARY = [(phrase, code) for code, several in CONDITIONS.items() for phrase in several]
#: A vocabulary is sent to every task with its automaton, so its size is bounded.
MOST_CHARS = 1 << 20

HITS = "array<struct<start:int,stop:int,phrase:int>>"


class Automaton:
    """A trie of phrases, for each state the one of its longest proper suffix in the trie (where a text goes on after a
    character that the state has no branch for), and the nearest state down that chain where a phrase ends."""

    def __init__(self, phrases: Sequence[str]) -> None:
        if sum(map(len, phrases)) > MOST_CHARS:
            raise ValueError(f"a vocabulary has at most {MOST_CHARS} characters")
        self.sizes, self.branches, self.ends = [len(x) for x in phrases], [{}], [-1]
        for i, phrase in enumerate(phrases):
            state = 0
            for c in phrase:
                if c not in self.branches[state]:
                    self.branches[state][c] = len(self.branches)
                    self.branches.append({})
                    self.ends.append(-1)
                state = self.branches[state][c]
            if state and self.ends[state] < 0:  # of equal phrases the first one counts, an empty one is nowhere
                self.ends[state] = i
        self.falls, self.shorter = [0] * len(self.branches), [0] * len(self.branches)
        waiting = deque(self.branches[0].values())
        while waiting:
            state = waiting.popleft()
            down = self.falls[state]
            self.shorter[state] = down if self.ends[down] >= 0 else self.shorter[down]
            for c, after in self.branches[state].items():
                while down and c not in self.branches[down]:
                    down = self.falls[down]
                self.falls[after] = self.branches[down].get(c, 0)
                down = self.falls[state]
                waiting.append(after)

    def longest(self, text: str) -> list[tuple[int, int, int]]:
        """``start, stop, phrase`` of the longest phrase at each place where one begins, in order."""
        found, state = {}, 0
        for stop, c in enumerate(text, 1):
            while state and c not in self.branches[state]:
                state = self.falls[state]
            state = self.branches[state].get(c, 0)
            ending = state if self.ends[state] >= 0 else self.shorter[state]
            while ending:
                i = self.ends[ending]
                found[stop - self.sizes[i]] = (stop, i)  # a later stop is a longer phrase
                ending = self.shorter[ending]
        return [(start, *found[start]) for start in sorted(found)]


def longest_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """The longest phrase at each place of a text where one begins, as an array of ``HITS``; null of null."""
    automaton = Automaton(phrases)

    def hits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "stop": b, "phrase": i} for a, b, i in automaton.longest(t)])

    return F.pandas_udf(hits, HITS)(text)


def condition_hits(lines: DataFrame, keys: list[str], text: str = "line", vocabulary: Sequence[tuple[str, int]] = VOCABULARY) -> DataFrame:
    """``keys, start, stop, phrase, code``: the longest phrase at each place of each normalized text. Null texts have none."""
    of = lambda k: F.get(F.array(*[F.lit(v[k]) for v in vocabulary]), F.col("h.phrase"))
    found = lines.select(*keys, F.explode(longest_phrases(folded(F.col(text)), [p for p, _ in vocabulary])).alias("h"))
    return found.select(*keys, "h.start", "h.stop", of(0).alias("phrase"), of(1).alias("code"))


def condition_verdicts(hits: DataFrame, expected: DataFrame, unit: str, line: str) -> DataFrame:
    """``unit, expected, state, first_line, others`` of each row of ``expected`` (``unit, expected``).

    A line says the code of its longest phrase, of equally long ones the lower code. A unit matches if one of its lines
    says what is expected (``first_line`` is the first such line), is a mismatch if others only are said (``others``, in order),
    and has not been found otherwise. Several rows of a unit in ``expected`` are judged each; a null unit is not found.
    """
    said = hits.withColumn("r", F.row_number().over(Window.partitionBy(unit, line).orderBy((F.col("start") - F.col("stop")), "code"))).filter("r = 1")
    codes = said.groupBy(unit, "code").agg(F.min(line).alias("at"))
    told = codes.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct("code", "at"))).alias("m"))  # as many as there are codes
    at, rest = F.col("m")[F.col("expected")], F.array_sort(F.map_keys("m"))
    state = F.when(at.isNotNull(), "match").when(F.col("m").isNotNull(), "mismatch").otherwise("not-found")
    return expected.join(told, unit, "left").select(unit, "expected", state.alias("state"), at.alias("first_line"), F.when(state == "mismatch", F.array_join(rest, ",")).alias("others"))
