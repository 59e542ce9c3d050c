"""All terms of all vocabularies in one pass over a text, by a multi-pattern automaton in Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


@functools.lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Made once in a worker."""
    made = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        made.add_word(term, k)
    made.make_automaton()
    return made


class Found:
    """Which of some terms a text holds, as a column of their numbers; blank terms are never held."""

    def __init__(self, terms: Iterable[str], name: str) -> None:
        self.terms = tuple(sorted({t for t in terms if t}))
        self.number = {t: k for k, t in enumerate(self.terms)}
        self.held = F.col(name)

    def column(self, text: Column) -> Column:
        """The numbers of the terms that occur in the text, overlapping ones too, in order."""
        terms = self.terms
        if not terms:
            return F.array().cast("array<int>")

        @F.pandas_udf(ArrayType(IntegerType()))
        def find(texts: pd.Series) -> pd.Series:
            made = _automaton(terms)
            return texts.map(lambda t: sorted({k for _, k in made.iter(t)}) if t else [])

        return find(text)

    def _numbers(self, terms: Iterable[str]) -> list[int]:
        return [self.number[t] for t in terms if t]

    def count(self, terms: Iterable[str]) -> Column:
        """How many of the terms occur; one that is listed twice counts twice."""
        numbers = self._numbers(terms)
        if not numbers:
            return F.lit(0)
        once = F.size(F.array_intersect(self.held, F.array(*[F.lit(k) for k in sorted(set(numbers))])))
        again = [k for place, k in enumerate(numbers) if k in numbers[:place]]
        return sum((F.array_contains(self.held, k).cast("int") for k in again), once)

    def any(self, terms: Iterable[str]) -> Column:
        numbers = self._numbers(terms)
        return F.arrays_overlap(self.held, F.array(*[F.lit(k) for k in sorted(set(numbers))])) if numbers else F.lit(False)
