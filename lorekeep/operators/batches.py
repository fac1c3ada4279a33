"""Batches under a limit of texts and of tokens, planned in parallel.

When a batch closes depends on where the one before closed, which looks as if a
group's rows had to stream through one task.  But each row's *next* start is
known from prefix sums alone, by binary search.  So rows are numbered in order
and cut into chunks, whatever their groups, and each chunk finds at once, by
pointer jumping, where a walk that enters at any of its first rows leaves it.
These small tables are joined in a tree, FAN of them at a time, up to the whole
and down again; then every chunk knows its entry and numbers its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import numbered, stored

#: Rows that a task walks through.
CHUNK = 65_536
#: Chunks' tables that are joined at once.
FAN = 256
_MAP = "chunk long, exits array<int>, counts array<long>, fresh boolean"


@dataclass
class Walk:
    """Next starts of the rows of one chunk, ``own`` of them, followed by the first rows of the next chunk."""

    next: np.ndarray
    own: int
    #: Own rows that are the first of their group.
    fresh: np.ndarray

    @classmethod
    def over(cls, tokens: np.ndarray, change: np.ndarray, own: int, most_texts: int, most_tokens: int | None) -> Walk:
        """``change`` tells of each row whether it begins a group."""
        n = len(tokens)
        here = np.arange(n)
        after = here + most_texts
        if most_tokens is not None:
            total = np.concatenate([[0], np.cumsum(np.maximum(tokens, 0))])
            after = np.minimum(after, np.searchsorted(total, total[:-1] + most_tokens, side="right") - 1)
        begins = np.append(np.flatnonzero(change), n)
        end = begins[np.searchsorted(begins, here, side="right").clip(max=len(begins) - 1)]
        return cls(np.clip(after, here + 1, np.maximum(end, here + 1)), own, np.flatnonzero(change[:own]))

    def transfer(self, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """(exit, batches) for each entry: where the walk enters the next chunk, and its starts since the last group began."""
        n = len(self.next)
        at = np.where(np.arange(n) < self.own, self.next, np.arange(n))
        at = np.append(at, n)  # past all rows there are
        counts = np.append((np.arange(n) < self.own) & (np.arange(n) >= (self.fresh[-1] if len(self.fresh) else 0)), False).astype(np.int64)
        while (at[:n] < self.own).any():
            counts, at = counts + np.where(at < self.own, counts[at], 0), at[at]
        some = np.minimum(np.arange(entries), n)
        return np.maximum(at[some] - self.own, 0).astype(np.int32), counts[some]

    def numbers(self, entry: int, before: int) -> np.ndarray:
        """The batch of each own row, in a chunk that is entered at ``entry`` with ``before`` batches of its first group."""
        starts = np.zeros(self.own, np.int64)
        at = entry
        while at < self.own:
            starts[at] = 1
            at = int(self.next[at])
        total = np.cumsum(starts)
        group = np.searchsorted(self.fresh, np.arange(self.own), side="right")
        base = np.append(-before, total[self.fresh] - 1)
        return total - base[group]


def _composed(exits: list[np.ndarray], counts: list[np.ndarray], fresh: list[bool], entry: np.ndarray, before: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(entry, batches before) of each of some chunks in a row and of what follows, for each entry of the first."""
    found = [(entry, before)]
    for own_exits, own_counts, new in zip(exits, counts, fresh, strict=True):
        entry, before = own_exits[entry], own_counts[entry] + (0 if new else before)
        found.append((entry, before))
    return found


def _columns(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
    arrays = [np.array(table.column(c).to_pylist(), kind) for c, kind in (("exits", np.int64), ("counts", np.int64))]
    return list(arrays[0]), list(arrays[1]), table.column("fresh").to_pylist()


def _entries(maps: DataFrame, last: int) -> DataFrame:
    """``(chunk, entry, before)`` of chunks 0 to ``last``."""
    if last == 0:
        return maps.select("chunk", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("before"))

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        exits, counts, fresh = _columns(table.sort_by("chunk"))
        start = np.arange(len(exits[0]))
        entry, before = _composed(exits, counts, fresh, start, np.zeros(len(start), np.int64))[-1]
        row = {"chunk": [key[0].as_py()], "exits": [entry.tolist()], "counts": [before.tolist()], "fresh": [any(fresh)]}
        return pa.table(row, pa.schema([("chunk", pa.int64()), ("exits", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("fresh", pa.bool_())]))

    def dealt(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        entry, before = (np.array([table.column(c)[0].as_py()]) for c in ("entry", "before"))
        found = _composed(*_columns(table), entry, before)[:-1]
        columns = [table.column("chunk").combine_chunks(), pa.array([int(e[0]) for e, _ in found], pa.int32()), pa.array([int(b[0]) for _, b in found], pa.int64())]
        return pa.table(columns, names=["chunk", "entry", "before"])

    upper = F.floor(F.col("chunk") / FAN).cast("long")
    above = stored(maps.groupBy(upper.alias("upper")).applyInArrow(joined, _MAP), "batch-maps")
    entries = _entries(above, last // FAN).withColumnRenamed("chunk", "upper")
    return maps.withColumn("upper", upper).join(entries, "upper").groupBy("upper").applyInArrow(dealt, "chunk long, entry int, before long")


def plan_batches(texts: DataFrame, group: Sequence[str], order: Sequence[str], most_texts: int, most_tokens: int | None, chunk: int = CHUNK) -> DataFrame:
    """``texts`` (with ``tokens``) with ``batch``, from 1 in each group: in order, as many as both limits allow.

    A text over the token limit goes alone; null tokens count as none.
    """
    chunk = max(chunk, most_texts)
    names = texts.columns
    free = "k" * (1 + max(map(len, names)))  # no column's name is as long
    place, key, at = f"{free}p", f"{free}g", f"{free}c"
    whole = F.coalesce(F.to_json(F.struct(*group)), F.lit("")) if group else F.lit("")
    # The group leads, the rest of the order follows: equal groups are neighbours.
    rows = numbered(texts.withColumn(key, whole), key, *order, name=place)
    last = (rows.agg(F.max(place).alias("n")).first()["n"] or 0) // chunk
    own = F.floor(F.col(place) / chunk).cast("long")
    inside = F.col(place) % chunk
    seen = F.array_compact(F.array(own, F.when((inside < most_texts) & (own > 0), own - 1), F.when((inside == chunk - 1) & (own < last), own + 1)))

    def walk(number: int, table: pa.Table) -> tuple[Walk, pa.Table]:
        """The chunk's walk and its own rows; the row before it only tells whether the group goes on."""
        places = table.column(place).to_numpy()
        groups = table.column(key)
        change = np.ones(len(places), bool)
        if len(places) > 1:
            change[1:] = np.array(groups.slice(1).to_pylist(), object) != np.array(groups.slice(0, len(groups) - 1).to_pylist(), object)
        first, stop = np.searchsorted(places, (number * chunk, (number + 1) * chunk))
        tokens = table.column("tokens").fill_null(0).to_numpy().astype(np.int64)
        return Walk.over(tokens[first:], change[first:], int(stop - first), most_texts, most_tokens), table.slice(first, stop - first)

    def transfer(number: tuple, table: pa.Table) -> pa.Table:
        steps, _ = walk(number[0].as_py(), table.sort_by(place))
        exits, counts = steps.transfer(most_texts)
        kinds = pa.schema([("chunk", pa.int64()), ("exits", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("fresh", pa.bool_())])
        return pa.table({"chunk": [number[0].as_py()], "exits": [exits.tolist()], "counts": [counts.tolist()], "fresh": [len(steps.fresh) > 0]}, kinds)

    def answer(number: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(place)
        entry, before = (table.column(f"{free}{c}")[0].as_py() for c in ("e", "b"))
        steps, mine = walk(number[0].as_py(), table)
        return mine.select(names).append_column("batch", pa.array(steps.numbers(entry, before)))

    slim = rows.select(place, key, "tokens", F.explode(seen).alias(at))
    if last:
        maps = stored(slim.groupBy(at).applyInArrow(transfer, _MAP), "batch-maps")
        entries = _entries(maps, last).select(F.col("chunk").alias(at), F.col("entry").alias(f"{free}e"), F.col("before").alias(f"{free}b"))
        dealt = rows.withColumn(at, F.explode(seen)).join(entries, at)
    else:
        dealt = rows.withColumn(at, own).withColumns({f"{free}e": F.lit(0), f"{free}b": F.lit(0).cast("long")})
    return dealt.groupBy(at).applyInArrow(answer, T.StructType([*rows.select(*names).schema.fields, T.StructField("batch", T.LongType())]))
