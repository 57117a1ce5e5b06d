"""Analysers: how texts and queries become the terms of an index."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .snowball import english
from .text import NO_WORD, stem

STEMMERS = {"porter": stem, "english": english}


@lru_cache(1)
def _accents() -> dict[str, str]:
    """Latin letters with marks, and the letters without them."""
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            out[chr(code)] = base[0].lower()
    return out


@dataclass(frozen=True)
class Analyser:
    """Lower-case runs of letters and digits; with fold without marks on letters, with a stemmer by their stems. The version changes with what it gives, so that an index tells by which it was made."""

    name: str
    version: int
    stemmer: str | None = None
    fold: bool = False

    @property
    def mark(self) -> str:
        return f"{self.name}-{self.version}"

    def words(self, text: Column) -> Column:
        """The words of a text in order, before stemming; a leading or trailing empty one may stand among them."""
        low = F.lower(text)
        if self.fold:
            table = _accents()
            low = F.translate(F.regexp_replace(low, r"\p{M}+", ""), "".join(table), "".join(table.values()))
        return F.split(low, NO_WORD)

    def term(self, word: Column) -> Column:
        """The term of a word: its stem by a function that runs once for each different word of a batch."""
        if self.stemmer is None:
            return word
        of = STEMMERS[self.stemmer]

        @F.pandas_udf("string")
        def stems(words: pd.Series) -> pd.Series:
            codes, different = pd.factorize(words)
            return pd.Series([of(w) for w in different], dtype=object).take(codes).reset_index(drop=True)

        return stems(word)

    def terms_of(self, words: list[str]) -> list[str]:
        """The terms of different words."""
        return list(map(STEMMERS[self.stemmer], words)) if self.stemmer else words

    @cached_property
    def _letters(self) -> dict[int, str]:
        return str.maketrans(_accents())

    def of_query(self, text: str) -> list[str]:
        """The terms of a piece of a query."""
        low = text.lower()
        if self.fold:
            low = "".join(c for c in low if not unicodedata.category(c).startswith("M")).translate(self._letters)
        words = [w for w in re.split(r"[\W_]+", low) if w]
        return [STEMMERS[self.stemmer](w) for w in words] if self.stemmer else words


#: Terms as they stand.
PLAIN = Analyser("plain", 1)
#: What the reference's full-text table does: letters without marks, Porter's stems of 1980.
STEMMED = Analyser("porter-folded", 1, "porter", True)
