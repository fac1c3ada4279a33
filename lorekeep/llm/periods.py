"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a stretch of words with smallest period q, at least ``min_power`` times
q and ``min_words`` long, that no neighbouring word extends.  Each text is
compressed first: its most frequent pair of neighbouring symbols becomes a new
symbol wherever it stands, again and again until no pair is repeated.  In one
round all pairs are replaced that are more frequent than those they overlap, a
text's most frequent one always among them.  What is left is closed by a balanced
tree of further symbols.

A run lies in the expansion of some symbol and crosses the border of its two
halves.  So each distinct symbol is looked at once, in one place where it stands:
a run of four periods has two of them on one side of the border, which is a square
that begins or ends there, and only distances at which the words beside the border
recur can be its period.  What crosses, clipped to the symbol, is carried to all
places where the symbol stands, down the derivation trees; pieces of one run have
its period and overlap by as much, and are merged.

The first count of pairs already tells where runs can lie, as every pair of a run
is there three times: other words never enter the grammar.  Many texts are worked
on at once, with symbols of their own, as columns of numbers.  Work is in
proportion to the words, times the logarithm of what repeats; a text is in one
task, which holds GROUP_WORDS words or one text.

Defined results: null texts and texts without words have no runs and an empty
collapsed text; a very long text is worked on whole; ties of words are equal bytes
(no case folding); repeated rows, null and repeated ids each get a row; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_POWER, MIN_WORDS = 4, 6
#: Words that a task works on at once; a longer text stands alone.
GROUP_WORDS = 1 << 19
#: Periods below are looked up in tables of the next place where words differ; from here on by stretches of so many words.
GRAM = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Grammar:
    """Symbols that stand for two others; symbols below ``words`` are words."""

    words: int
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: A place in the text where the symbol stands.
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # also of words
    #: Where the symbols of each round end; they are made of those of earlier rounds.
    rounds: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.size = np.ones(self.words, np.int64)
        self.rounds.append(self.words)

    def add(self, left: np.ndarray, right: np.ndarray, first: np.ndarray) -> np.ndarray:
        start = len(self.size)
        self.left, self.right, self.first = (np.concatenate(x) for x in ((self.left, left), (self.right, right), (self.first, first)))
        self.size = np.concatenate([self.size, self.size[left] + self.size[right]])
        self.rounds.append(len(self.size))
        return np.arange(start, len(self.size))


def compressed(symbol: np.ndarray, place: np.ndarray, part: np.ndarray, words: int) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """(grammar, one symbol for each part, its place): ``part`` tells where pairs end, symbols of different texts differ."""
    grammar = Grammar(words)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(symbol) > 1:
        pair = np.where(part[1:] == part[:-1], symbol[:-1] * len(grammar.size) + symbol[1:], -1)
        kind, of, times = np.unique(pair, return_inverse=True, return_counts=True)
        times[kind < 0] = 0
        rank = np.empty(len(kind), np.int64)
        rank[np.lexsort((kind.view(np.uint64) * _MIX, times))] = np.arange(len(kind))
        worth = np.where(times[of] > 1, rank[of], -1)
        live = np.zeros(int(part[-1]) + 1, bool)
        live[part[:-1][worth >= 0]] = True
        if not live.all():  # parts without a repeated pair are ready
            stays = live[part]
            done.append((symbol[~stays], place[~stays], part[~stays]))
            pairs = stays[:-1] & stays[1:]
            symbol, place, part = symbol[stays], place[stays], part[stays]
            if len(symbol) < 2:
                break
            joined = np.flatnonzero(pairs)
            fresh = np.full(len(symbol) - 1, -1, np.int64)
            fresh[np.cumsum(stays)[joined] - 1] = worth[joined]
            kinds = np.zeros(len(symbol) - 1, np.int64)
            kinds[np.cumsum(stays)[joined] - 1] = of[joined]
            worth, of = fresh, kinds
        chosen = _tops(worth)
        _, at, new = np.unique(of[chosen], return_index=True, return_inverse=True)
        made = grammar.add(symbol[chosen[at]], symbol[chosen[at] + 1], place[chosen[at]])
        symbol[chosen] = made[new]
        symbol, place, part = (np.delete(x, chosen + 1) for x in (symbol, place, part))
    done.append((symbol, place, part))
    symbol, place, part = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(place, kind="stable")
    return _closed(grammar, symbol[order], place[order], part[order])


def _tops(worth: np.ndarray) -> np.ndarray:
    """Places of the pairs worth more than those they overlap; of a pair that overlaps itself every other place."""
    start = np.flatnonzero(np.concatenate([[True], worth[1:] != worth[:-1]]))
    count = np.diff(np.append(start, len(worth)))
    value = worth[start]
    top = (value >= 0) & (value > np.append(-1, value[:-1])) & (value > np.append(value[1:], -1))
    return np.flatnonzero(np.repeat(top, count) & ((np.arange(len(worth)) - np.repeat(start, count)) % 2 == 0))


def _closed(grammar: Grammar, symbol: np.ndarray, place: np.ndarray, part: np.ndarray) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """Neighbours of a part are joined two by two until one symbol is left of it."""
    while len(symbol) > 1:
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        count = np.diff(np.append(start, len(part)))
        if count.max() == 1:
            break
        even = (np.arange(len(part)) - np.repeat(start, count)) % 2 == 0
        chosen = np.flatnonzero(even[:-1] & (part[1:] == part[:-1]))
        symbol[chosen] = grammar.add(symbol[chosen], symbol[chosen + 1], place[chosen])
        symbol, place, part = (np.delete(x, chosen + 1) for x in (symbol, place, part))
    return grammar, symbol, place


def matches(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from a and b on, in steps of 1 or -1, at most ``limit``."""
    found = np.zeros(len(a), np.int64)
    live, block = np.flatnonzero(limit > 0), 16
    while len(live):
        still = []
        for some in np.array_split(live, len(live) * block // (1 << 20) + 1):
            ahead = found[some][:, None] + np.arange(block)
            inside = ahead < limit[some][:, None]
            ahead = np.where(inside, ahead, 0) * step
            same = inside & (text[a[some][:, None] + ahead] == text[b[some][:, None] + ahead])
            whole = same.all(axis=1)
            found[some] += np.where(whole, block, same.argmin(axis=1))
            still.append(some[whole])
        live, block = np.concatenate(still), min(2 * block, 4096)
    return found


def _short(text: np.ndarray, low: np.ndarray, border: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(symbols, starts, ends, period) of what crosses each border, for periods below GRAM."""
    places = np.arange(len(text))
    for q in range(1, GRAM):
        same = np.zeros(len(text), bool)
        same[:-q] = text[:-q] == text[q:]
        after = np.minimum.accumulate(np.where(same, len(text), places)[::-1])[::-1]
        before = np.maximum.accumulate(np.where(same, -1, places))
        for probe in (border - 1, border - q):  # two periods after the border, or before it
            own = np.flatnonzero((probe >= low) & same[np.maximum(probe, 0)])
            start = np.maximum(before[probe[own]] + 1, low[own])
            end = np.minimum(after[probe[own]] + q, high[own])
            fit = (start < border[own]) & (border[own] < end) & (end - start >= max(MIN_WORDS, MIN_POWER * q))
            yield own[fit], start[fit], end[fit], np.full(int(fit.sum()), q)


def _long(text: np.ndarray, low: np.ndarray, border: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for periods from GRAM on, by the next places where the GRAM words beside a border recur."""
    own = np.flatnonzero(high - low >= MIN_POWER * GRAM)
    if not len(own):
        return
    gram, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while width < GRAM:  # names of stretches of 2, 4, 8 words; a separator makes them single
        gram = np.unique(gram[:-width] * (int(gram.max()) + 1) + gram[width:], return_inverse=True)[1].astype(np.int64)
        width *= 2
    by_gram = np.argsort(gram, kind="stable")
    sorted_ = gram[by_gram] * len(text) + by_gram
    for forward in (True, False):
        node = own[(border[own] + GRAM <= high[own]) if forward else (border[own] - GRAM >= low[own])]
        at = border[node] if forward else border[node] - GRAM
        least = np.full(len(node), GRAM)
        while len(node):
            if forward:
                c = np.searchsorted(sorted_, gram[at] * len(text) + at + least)
                other = by_gram[np.minimum(c, len(by_gram) - 1)]
                fit = (c < len(by_gram)) & (other > at)
            else:
                c = np.searchsorted(sorted_, gram[at] * len(text) + at - least, side="right") - 1
                other = by_gram[np.maximum(c, 0)]
                fit = (c >= 0) & (other < at)
            q = np.abs(other - at)
            side = high[node] - border[node] if forward else border[node] - low[node]
            fit &= (gram[other] == gram[at]) & (q <= np.minimum((high[node] - low[node]) // MIN_POWER, side // 2))
            node, at, q = node[fit], at[fit], q[fit]
            a = border[node] if forward else border[node] - 2 * q  # the square begins here
            near = np.flatnonzero(gram[a + q - GRAM] == gram[a + 2 * q - GRAM]) if forward else np.flatnonzero(gram[a] == gram[a + q])
            some, a, p = node[near], a[near], q[near]
            right = matches(text, a, a + p, high[some] - a - p, 1)
            square = right >= p
            near, some, a, p, right = near[square], some[square], a[square], p[square], right[square]
            start = a - matches(text, a - 1, a + p - 1, a - low[some], -1)
            end = a + p + right
            whole = (start < border[some]) & (border[some] < end) & (end - start >= MIN_POWER * p)
            yield some[whole], start[whole], end[whole], p[whole]
            least = q + 1
            # Longer squares inside this stretch only repeat its period.
            least[near] = ((end - border[some] if forward else border[some] - start) // 2) + 1


def crossing(text: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, ...]:
    """(symbol, start, end, period), starts and ends within the symbol, of what crosses its border; sorted by symbol."""
    size = grammar.size[grammar.words :]
    able = np.flatnonzero(size >= MIN_WORDS)
    low = grammar.first[able]
    border, high = low + grammar.size[grammar.left[able]], low + size[able]
    found = [*_short(text, low, border, high), *_long(text, low, border, high)]
    node, start, end, period = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    start, end = start - low[node], end - low[node]
    order = np.lexsort((period, end, start, node))
    node, start, end, period = (x[order] for x in (node, start, end, period))
    new = np.ones(len(node), bool)  # of one stretch the smallest period
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return able[node[new]] + grammar.words, start[new], end[new], period[new]


def derived(grammar: Grammar, roots: np.ndarray, places: np.ndarray, symbol: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) at all places where the symbols stand."""
    holds = np.zeros(len(grammar.size), bool)
    holds[symbol] = True
    for a, b in zip(grammar.rounds, grammar.rounds[1:], strict=False):
        left, right = grammar.left[a - grammar.words : b - grammar.words], grammar.right[a - grammar.words : b - grammar.words]
        holds[a:b] |= holds[left] | holds[right]
    found = []
    node, at = roots[holds[roots]], places[holds[roots]]
    while len(node):
        low, high = np.searchsorted(symbol, node), np.searchsorted(symbol, node, side="right")
        count = high - low
        run = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        base = np.repeat(at, count)
        found.append((start[run] + base, end[run] + base, period[run]))
        inner = node >= grammar.words
        left, right, at = grammar.left[node[inner] - grammar.words], grammar.right[node[inner] - grammar.words], at[inner]
        node, at = np.concatenate([left, right]), np.concatenate([at, at + grammar.size[left]])
        node, at = node[holds[node]], at[holds[node]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """The maximal intervals: pieces of one period that overlap by it or more are one."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(period * wide + end) - period * wide  # a smaller period's end is below any start
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] + period[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1], period[first]


def find_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text a table of (start, length, period), sorted."""
    count = np.array(list(map(len, texts)), np.int64)
    none = np.zeros((0, 3), np.int64)
    words = np.zeros(int(count.sum()), np.int64)
    at, names = 0, 0
    for text in texts:
        own: dict[bytes, int] = {}
        words[at : at + len(text)] = [own.setdefault(w, len(own)) for w in text]
        words[at : at + len(text)] += names
        at, names = at + len(text), names + len(own)
    doc = np.repeat(np.arange(len(texts)), count)
    if len(words) < MIN_WORDS:
        return [none] * len(texts)
    pair = np.where(doc[1:] == doc[:-1], words[:-1] * names + words[1:], -1)
    kind, of, times = np.unique(pair, return_inverse=True, return_counts=True)
    often = np.concatenate([[0], ((times[of] >= MIN_POWER - 1) & (pair >= 0)).astype(np.int8), [0]])
    begin, stop = np.flatnonzero(np.diff(often) == 1), np.flatnonzero(np.diff(often) == -1) + 1  # words of the part
    long = stop - begin >= MIN_WORDS
    begin, stop = begin[long], stop[long]
    if not len(begin):
        return [none] * len(texts)
    # The parts, each followed by a separator that is like no other symbol.
    width = stop - begin + 1
    head = np.cumsum(width) - width
    source = np.arange(width.sum()) - np.repeat(head - begin, width)
    last = head + width - 1
    text = words[np.minimum(source, len(words) - 1)]
    text[last] = -1 - np.arange(len(last))
    place = np.delete(np.arange(len(text)), last)
    part = np.delete(np.repeat(np.arange(len(width)), width), last)
    used, symbol = np.unique(text[place], return_inverse=True)
    grammar, roots, places = compressed(symbol.astype(np.int64), place, part, len(used))
    start, end, period = merged(*derived(grammar, roots, places, *crossing(text, grammar)))
    part = np.searchsorted(head, start, side="right") - 1
    start, length = start - head[part] + begin[part], end - start
    owner = doc[start]
    first = np.cumsum(count) - count
    table = np.stack([start - first[owner], length, period], axis=1)
    order = np.lexsort((period, start, owner))
    return np.split(table[order], np.searchsorted(owner[order], np.arange(1, len(texts))))


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words outside of runs, and of each run its first period; a word that any run drops goes."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, runs, collapsed)`` per row: runs by start, then period, and the text without their repeats, one blank between words."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def answered(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = find_runs(texts)
        kept = [b" ".join(collapsed(t, r)) for t, r in zip(texts, found, strict=True)]
        ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
        flat = np.concatenate(found)
        runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(kind))
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, runs), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[bytes]] = []
            begin = total = 0
            for row, text in enumerate(batch.column(1).cast(pa.large_binary())):
                words = (text.as_py() or b"").split()  # on bytes: exactly \x20 \x09-\x0D
                if held and total + len(words) > GROUP_WORDS:
                    yield answered(batch.column(0).slice(begin, row - begin), held)
                    held, begin, total = [], row, 0
                held.append(words)
                total += len(words)
            if held:
                yield answered(batch.column(0).slice(begin), held)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
