"""Connected components of a link table: a counted small table in one task, others by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut

#: Links that one task joins; beyond, rounds of aggregations and joins give the same result.
AT_ONCE = 100_000


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i] for all i, in one task's memory."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def _in_one_task(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([batch.column(c).to_numpy() for c in (0, 1)]) for batch in batches]
        nodes, both = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *held], axis=1), return_inverse=True)
        root = nodes[merge(np.arange(len(nodes)), *both.reshape(2, -1))]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])

    return pairs.select("u", "v").repartition(1).mapInArrow(run, "node long, root long")


def connected_components(links: DataFrame, left: str, right: str, max_rounds: int = 60, at_once: int | None = None) -> DataFrame:
    """Return ``(node, root)`` for every node that has a link; root is the least node reachable.

    ``links`` are pairs of longs in any order; repeats, loops and nulls are
    allowed and the last two ignored.  Up to ``at_once`` links go to one task.  Beyond, each round runs one large-star and one
    small-star step, each an aggregation and a join on the node, so no group
    is gathered in a task or at the driver; only a count and a checksum
    of the links reach the driver to notice the fixed point.
    """
    pairs = (
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    pairs = cut(pairs)
    seen = _fingerprint(pairs)
    if seen[0] <= (AT_ONCE if at_once is None else at_once):
        return cut(_in_one_task(pairs))
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
