"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case, every run of other than letters and digits
becomes one space).  An item of m characters may differ from a passage of a
document by k = floor(m * rate) edits.  Cut into k + 1 pieces, at least one
piece must occur unchanged, so all pieces of the benchmark go into one
Aho-Corasick automaton, and each hit fixes a stretch of the document that is
verified with Myers' bit-parallel edit distance.

The benchmark is read in blocks of bounded size, each sent to the tasks; every
block runs against all rows of the documents, which are never shuffled.

Defined results: null, empty and symbol-only texts hold nothing; items that
normalise to nothing match nothing; items too short for an error must occur
exactly, as whole words; repeated items or documents give a row each, and of
several copies in a document the nearest counts; a very long text is searched
whole; a null id is carried as null.  Other columns are left alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of an item's characters that may differ.
ERROR_RATE = 0.08
#: Characters of benchmark text in one block; a block's items and automaton stay well under 100 MB.
BLOCK_CHARS = 1_000_000

_TO_SPACE = bytes(c if chr(c).isalnum() or c > 0x7F else 0x20 for c in range(256))


def normalise(text: str | None) -> str:
    """Words of letters and digits in lower case, one space before, between and after them."""
    low = (text or "").lower()
    if not low.isascii():
        for c in set(low):
            if c > "\x7f" and not c.isalnum():
                low = low.replace(c, " ")
    words = low.encode("utf-8", "replace").translate(_TO_SPACE).split()
    return f" {b' '.join(words).decode()} " if words else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Edit distance of one pattern to any stretch of a text, a column of bits a character."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self._eq: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self._eq[c] |= 1 << i
        self._eq = dict(self._eq)

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the best stretch, the first of equals; None if all exceed ``most``."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = full, 0, self.size
        eq, found, limit = self._eq, None, most
        for at, c in enumerate(text):
            e = eq.get(c, 0)
            x = e | down
            d = (((e & up) + up) ^ up) | e
            h_up = down | (full & ~(d | up))
            h_down = up & d
            if h_up & top:
                score += 1
            elif h_down & top:
                score -= 1
            h_up <<= 1  # a stretch may begin anywhere
            up = ((h_down << 1) | (full & ~(x | h_up))) & full
            down = h_up & x & full
            if score <= limit:
                found, limit = (score, at + 1), score - 1
                if score == 0:
                    break
        return found


@dataclass
class Block:
    """Some benchmark items, normalised."""

    items: list[tuple[int | None, str]]
    rate: float

    def __post_init__(self) -> None:
        self._ready = False

    def __getstate__(self):
        return {"items": self.items, "rate": self.rate, "_ready": False}

    def _build(self) -> None:
        spots: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self._errors = [int(len(text) * self.rate) for _, text in self.items]
        for n, (_, text) in enumerate(self.items):
            if text:
                for offset, piece in pieces(text, self._errors[n]):
                    spots[piece].append((n, offset))
        self._machine = ahocorasick.Automaton()
        for piece, where in spots.items():
            self._machine.add_word(piece, (len(piece), where))
        if spots:
            self._machine.make_automaton()
        self._any = bool(spots)
        self._patterns: dict[int, Myers] = {}
        self._ready = True

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, distance, budget) for each item of which the normalised text holds a copy."""
        if not self._ready:
            self._build()
        if not self._any or not text:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self._machine.iter(text):
            for n, offset in where:
                starts[n].add(end + 1 - size - offset)
        out = []
        for n, begins in starts.items():
            item, k = self.items[n][1], self._errors[n]
            best: int | None = None
            low = high = None
            for begin in [*sorted(begins), None]:
                if low is not None and (begin is None or begin - k > high):
                    found = self._verify(n, text[max(0, low) : high], k if best is None else best - 1)
                    if found is not None:
                        best = found
                    low = None
                    if best == 0:
                        break
                if begin is not None:
                    low = begin - k if low is None else low
                    high = begin + len(item) + k
            if best is not None:
                out.append((n, best, k))
        return sorted(out)

    def _verify(self, n: int, window: str, most: int) -> int | None:
        item = self.items[n][1]
        if item in window:
            return 0
        if most < 1:
            return None
        if n not in self._patterns:
            self._patterns[n] = Myers(item)
        found = self._patterns[n].best(window, most)
        return found[0] if found else None


def read_blocks(benchmark: DataFrame, id_col: str, text_col: str, rate: float, chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark in blocks of about ``chars`` characters, one at the driver at a time."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = -(-total // chars)
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block) if n > 1 else items
        found = [(r["id"], normalise(r["text"])) for r in part.collect()]
        yield Block(sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1])), rate)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", rate: float = ERROR_RATE,
) -> DataFrame:
    """``(id, item, distance, budget)`` for each document and item of which it holds a copy within the budget."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def search(block: Block) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                rows = [
                    (doc, own.items[n][0], distance, k)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                    for n, distance, k in own.matches(normalise(text.as_py()))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["id", "item", "distance", "budget"]
                    )

        return texts.mapInArrow(run, "id long, item long, distance long, budget long")

    found = [search(b) for b in read_blocks(benchmark, item_col, item_text_col, rate)]
    empty = spark.createDataFrame([], "id long, item long, distance long, budget long")
    return reduce(DataFrame.unionByName, found) if found else empty


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rate: float = ERROR_RATE,
) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that hold a copy of no item."""
    at = docs.columns.index(text_col)

    def clean(rest: DataFrame, block: Block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                keep = [not own.matches(normalise(t.as_py())) for t in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return rest.mapInArrow(run, docs.schema)

    return reduce(clean, read_blocks(benchmark, item_col, item_text_col, rate), docs)


