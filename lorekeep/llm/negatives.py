"""Hard negatives whose scores lie in a window below each positive's, found slot by slot.

A positive allows negatives between two shares of its own score.  The windows
of an anchor's positives overlap; their upper limits, sorted, part the scores
into disjoint slots, and every window is a row of neighbouring slots, from the
one under its own limit down.  So one pass suffices: each task keeps the best
rows of each (anchor, slot), a ranking in Spark joins the tasks' winners, and a
merge from the lowest slot upward gives the best rows under every limit.  What
lies under a window's lower limit is cut off at the end: it ranks behind all
that does not.

Anchors are taken in blocks, at most BLOCK of them and BLOCK_BYTES of vectors.
A block is broadcast and meets all rows where they lie; each task returns k
rows for an anchor and slot, whatever the number of rows.  Blocks follow each
other, and only one is ever at the driver.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component (also one that 256 times makes infinite), take no part;
rows meet rows of as many components (an empty vector scores 0); rows with the
anchor's own id are the anchor, and neither its positive nor its negative;
repeated rows with other ids are rows of their own, repeats of an anchor count
once; ties of scores go to the smaller id; scores beyond a long are clipped;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import new_path, numbered

POSITIVES, NEGATIVES = 5, 10
#: A negative scores at least LOW and at most HIGH hundredths of its positive.
LOW, HIGH = 30, 90
SCALE = 256
#: Anchors that meet all rows in one pass.
BLOCK, BLOCK_BYTES = 4_096, 1 << 25
#: Scores that a task holds at once.
CELLS = 1 << 20
_MOST = (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole numbers as doubles) for each length of the vectors in a column of lists; odd vectors are left out."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null list has none, a null component is NaN
    start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    for size in np.unique(length[length >= 0]).tolist():
        rows = np.flatnonzero(length == size)
        with np.errstate(over="ignore", invalid="ignore"):
            found = np.floor(SCALE * flat[start[rows][:, None] + np.arange(size)])
        good = np.isfinite(found).all(axis=1)
        if good.any():
            yield rows[good], found[good]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -_MOST, _MOST).astype(np.int64)


class Best:
    """The best ``k`` rows of each cell: higher scores first, then smaller ids."""

    def __init__(self, cells: int, k: int):
        self.k = k
        self.least = np.full(cells, -_MOST)  # a row below its cell's has no chance
        self.cell, self.score, self.row = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, cell: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        cell, score, row = (np.concatenate(x) for x in ((self.cell, cell), (self.score, score), (self.row, row)))
        order = np.lexsort((row, -score, cell))
        cell = cell[order]
        rank = np.arange(len(cell)) - np.searchsorted(cell, cell)
        order = order[rank < self.k]
        self.least[cell[rank == self.k - 1]] = score[order][rank[rank < self.k] == self.k - 1]
        self.cell, self.score, self.row = cell[rank < self.k], score[order], row[order]


class Anchors:
    """A block of anchors, by the length of their vectors."""

    def __init__(self, rows: pd.DataFrame):
        self.place, self.id, self.label = (rows[c].to_numpy(np.int64) for c in ("place", "id", "label"))
        self.groups = dict(self._grouped(pa.array(rows["v"].tolist(), pa.list_(pa.float64()))))

    def _grouped(self, vectors: pa.Array) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        for rows, found in whole_vectors(vectors):
            yield found.shape[1], (rows, found)

    def meet(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchors, ids, labels, scores): some rows with all anchors of their length, a column for each anchor."""
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for rows, found in whole_vectors(batch.column(2)):
                if found.shape[1] not in self.groups:
                    continue
                anchors, theirs = self.groups[found.shape[1]]
                step = max(1, CELLS // len(anchors))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    yield anchors, ids[some], labels[some], products(found[at : at + step], theirs)


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and the greatest score of a positive's negatives: low * p <= 100 * n <= high * p, in whole numbers."""
    return -(-low * score // 100), high * score // 100


def participants(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return found.where("id is not null and label is not null and v is not null")


def best_positives(rows: DataFrame, block: Anchors, k: int) -> DataFrame:
    """``(place, score, id)``: the k best rows of each anchor's own label."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(len(own.id), k)
        for anchors, ids, labels, scores in own.meet(batches):
            fit = (labels[:, None] == own.label[anchors]) & (ids[:, None] != own.id[anchors]) & (scores >= best.least[anchors])
            row, a = np.nonzero(fit)
            best.add(anchors[a], scores[row, a], ids[row])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own.place[best.cell], best.score, best.row)], ["place", "score", "id"])

    found = rows.mapInArrow(run, "place long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def slot_winners(rows: DataFrame, block: Anchors, top: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """``(place, slot, score, id)``: the k best rows of other labels in each slot.

    ``top`` has a row for each anchor: the distinct upper limits, descending,
    then -_MOST.  Slot j holds scores of at most top[j] that are above top[j + 1].
    Scores below ``least`` belong to no window of the anchor.
    """
    shared = rows.sparkSession.sparkContext.broadcast((block, top, least))
    slots = top.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, top, least = shared.value
        best = Best(len(own.id) * slots, k)
        for anchors, ids, labels, scores in own.meet(batches):
            other = (labels[:, None] != own.label[anchors]) & (ids[:, None] != own.id[anchors]) & (scores >= least[anchors])
            for j in range(slots):
                cell = anchors * slots + j
                fit = other & (scores <= top[anchors, j]) & (scores >= best.least[cell])
                if j + 1 < slots:
                    fit &= scores > top[anchors, j + 1]
                row, a = np.nonzero(fit)
                if len(row):
                    best.add(cell[a], scores[row, a], ids[row])
        columns = (own.place[best.cell // slots], best.cell % slots, best.score, best.row)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["place", "slot", "score", "id"])

    found = rows.mapInArrow(run, "place long, slot long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("place", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def suffix_merge(slot: np.ndarray, score: np.ndarray, row: np.ndarray, slots: int, k: int) -> list[np.ndarray]:
    """For each slot, the best k of it and of all slots below, as positions."""
    found, best = [], np.zeros(0, np.int64)
    for j in range(slots - 1, -1, -1):
        both = np.concatenate([np.flatnonzero(slot == j), best])
        best = both[np.lexsort((row[both], -score[both]))][:k]
        found.append(best)
    return found[::-1]


def _block_negatives(rows: DataFrame, block: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    chosen = best_positives(rows, block, positives).toPandas().sort_values(["place", "rank"])  # at most BLOCK * positives
    at = np.searchsorted(block.place, chosen["place"].to_numpy())  # places ascend in a block
    top = np.full((len(block.id), positives), -_MOST)
    least = np.full(len(block.id), _MOST)
    limits: dict[int, list[tuple[int, int, int, int]]] = {}
    for a, positive, score in zip(at.tolist(), chosen["id"].tolist(), chosen["score"].tolist(), strict=True):
        lower, upper = window(score, low, high)
        if lower <= upper:
            limits.setdefault(a, []).append((upper, lower, positive, score))
    for a, own in limits.items():
        ends = sorted({x[0] for x in own}, reverse=True)
        top[a, : len(ends)] = ends
        least[a] = min(x[1] for x in own)
    slot_of = {a: {u: j for j, u in reversed(list(enumerate(top[a].tolist())))} for a in limits}
    named = {int(block.place[a]): (int(block.id[a]), own, slot_of[a]) for a, own in limits.items()}
    shared = rows.sparkSession.sparkContext.broadcast(named)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        anchor, own, slot_of = shared.value[int(pdf["place"].iloc[0])]
        slot, score, row = (pdf[c].to_numpy(np.int64) for c in ("slot", "score", "id"))
        best = suffix_merge(slot, score, row, positives, negatives)
        out = []
        for upper, lower, positive, value in own:
            held = best[slot_of[upper]]
            held = held[score[held] >= lower]
            out += [(anchor, positive, r, int(row[i]), value, int(score[i])) for r, i in enumerate(held.tolist(), 1)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return slot_winners(rows, block, top, least, negatives).groupBy("place").applyInPandas(answer, RESULT)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK,
) -> DataFrame:
    """One row for each anchor, positive and negative, negatives ranked from 1.

    ``is_anchor`` is a condition on the columns of ``rows``.
    """
    spark = rows.sparkSession
    everyone = participants(rows, id_col, label_col, vector_col)
    asking = numbered(participants(rows.where(is_anchor), id_col, label_col, vector_col).distinct(), "id", "label", F.xxhash64("v"))
    total = asking.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    block = max(1, min(block, BLOCK_BYTES // (8 * max(1, total["d"] or 0))))
    if not total["n"]:
        return spark.createDataFrame([], RESULT)
    out = new_path(spark, "negatives")
    for at in range(0, total["n"], block):
        own = Anchors(asking.where(F.col("place").between(at, at + block - 1)).toPandas().sort_values("place"))
        _block_negatives(everyone, own, positives, negatives, low, high).write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out)
