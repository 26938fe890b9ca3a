"""Keywords of large lists in whole texts: one automaton over all of them reads each text once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Keywords:
    """A set of words and phrases, to be found as substrings. The same texts are read once, however many lists ask of them."""

    def __init__(self, *lists: tuple[str, ...]) -> None:
        self.words = tuple(dict.fromkeys(w for words in lists for w in words))
        self.places = {w: i for i, w in enumerate(self.words)}

    @cached_property
    def _read(self):
        words = self.words

        @F.pandas_udf("array<int>")
        def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import ahocorasick  # needed where texts are read

            automaton = ahocorasick.Automaton()
            for i, w in enumerate(words):
                automaton.add_word(w, i)
            automaton.make_automaton()
            for texts in batches:
                yield pd.Series([sorted({i for _, i in automaton.iter(t)}) for t in texts])

        return read

    def found(self, text: Column) -> Column:
        """The numbers of the words that occur in a text, which is lower case if they are."""
        return self._read(F.coalesce(text, F.lit("")))

    def count(self, found: Column, words: tuple[str, ...]) -> Column:
        """How many of `words` are among those found."""
        return F.size(F.array_intersect(found, F.array(*[F.lit(self.places[w]) for w in dict.fromkeys(words)])))
