"""Many private terms in texts at once: one automaton, whatever the number of terms.

Terms are found whatever their case, and those that overlap are all found; one
that lies within a longer one is not reported beside it.  The automaton is built
once in each task, from a list that is as long as the settings file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lower(text: str) -> str:
    """In lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Terms:
    """Numbered from 1; of terms that differ by case only the first counts."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        self._automaton = ahocorasick.Automaton()
        for n, term in reversed(list(enumerate(self.terms, 1))):
            self._automaton.add_word(_lower(term), (len(term), n))
        if self.terms:
            self._automaton.make_automaton()

    def __reduce__(self):
        return Terms, (self.terms,)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, number) of each term that lies in no longer one, by start."""
        if not self.terms:
            return []
        found = sorted((last + 1 - size, -last - 1, n) for last, (size, n) in self._automaton.iter(_lower(text)))
        kept, reach = [], -1
        for start, end, n in found:  # of those that begin together the longest comes first
            if -end > reach:
                kept.append((start, -end, n))
                reach = -end
        return kept

    def mask(self, text: str) -> str:
        """Terms as ``[term #n]``; of two that overlap the one that begins first."""
        parts, at = [], 0
        for start, end, n in self.spans(text):
            if start >= at:
                parts += [text[at:start], f"[term #{n}]"]
                at = end
        return "".join([*parts, text[at:]])


def term_hits(each: DataFrame, terms: Sequence[str], key: str = "file") -> DataFrame:
    """``(file, line, kind, match)`` of every term in numbered lines; ``kind`` has the term's number only, so a report does not repeat it."""
    held = Terms(terms)
    names = [key, "line", "kind", "match"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, found = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for start, end, n in held.spans(text or ""):
                    rows.append(row)
                    kinds.append(f"term #{n}")
                    found.append(text[start:end])
            if rows:
                taken = pa.array(rows)
                columns = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(kinds), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, names)

    source = each.select(key, "line", "text")
    text = T.StringType()
    return source.mapInArrow(run, T.StructType([source.schema[key], source.schema["line"], T.StructField("kind", text), T.StructField("match", text)]))


def mask_terms(text: Column, terms: Sequence[str]) -> Column:
    """The text with each term as ``[term #n]``."""
    held = Terms(terms)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else held.mask(t))

    return masked(text)
