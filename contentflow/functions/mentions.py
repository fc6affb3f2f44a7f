"""Mentions of many phrases in one walk through a text.

All phrases form one Aho-Corasick automaton, shared by the tasks; each text is walked once, so the cost follows the length of
the text and the number of mentions, not the number of phrases. Case is folded by the engine before the walk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

MOST_PHRASES = 1_000_000  # of one automaton, which every task holds

FOUND = "array<struct<phrase:int,start:int,around:string>>"


def _automaton(phrases: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        automaton.add_word(phrase, (i, len(phrase)))
    automaton.make_automaton()
    return automaton


def walk(automaton, low: str, text: str, margin: int | None) -> list[tuple]:
    """(phrase number, 0-based start, text around) of the mentions in order; those of one phrase don't overlap."""
    free: dict[int, int] = {}
    out = []
    for last, (i, n) in automaton.iter(low):
        start = last - n + 1
        if start >= free.get(i, 0):
            free[i] = last + 1
            out.append((i, start, None if margin is None else text[max(0, start - margin): start + n + margin]))
    return out


def phrase_mentions(spark: SparkSession, text: str | Column, phrases: list[str], margin: int | None = None) -> Column:
    """Mentions of ``phrases`` (any case) as array<struct<phrase, start, around>>: the number of the phrase in the list, the
    0-based start and, with ``margin``, the text so many characters before and after. Null texts and empty phrases
    have none."""
    if len(phrases) > MOST_PHRASES:
        raise ValueError(f"{len(phrases)} phrases are more than one automaton of {MOST_PHRASES}")
    at = {i: p.lower() for i, p in enumerate(phrases) if p}
    distinct = sorted(set(at.values()))
    same = [[i for i in at if at[i] == p] for p in distinct]  # phrases that differ in case only
    shared = spark.sparkContext.broadcast((distinct, same))

    @F.pandas_udf(FOUND)
    def find(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names, owners = shared.value
        automaton = _automaton(names) if names else None
        for low, whole in parts:
            out = []
            for a, b in zip(low, whole):
                found = walk(automaton, a, b, margin) if automaton is not None and a else []
                out.append([{"phrase": i, "start": s, "around": w} for k, s, w in found for i in owners[k]])
            yield pd.Series(out)

    column = F.col(text) if isinstance(text, str) else text
    return find(F.lower(column), column)


@F.pandas_udf(ArrayType(DoubleType()))
def _running(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in parts:
        yield values.map(lambda v: None if v is None else np.cumsum(v, dtype=np.float64))


def running_sum(numbers: str | Column) -> Column:
    """Sums of the numbers of an array up to each place."""
    return _running(F.col(numbers).cast("array<double>") if isinstance(numbers, str) else numbers.cast("array<double>"))
