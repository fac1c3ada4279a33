"""Nearest neighbours by lists: vectors lie in folders by their nearest centroid, and a query reads few of them.

Centroids come from k-means over the directions of a bounded sample; they decide
where vectors lie and never what is found.  Each list is a partition of a Parquet
table, so the lists that no query of a block asks for are not read.  With each
list goes its radius, the widest angle of a vector to the centroid.  By the
triangle inequality no vector of a list is nearer to a query than the centroid's
angle less the radius, so an exact search reads the nearest lists first and then
only those that could still hold one of the best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import stored
from .retrieval import PLACES, QUERY_BLOCK, Best, units

#: Vectors that the centroids are learned from.
SAMPLE = 20_000
ROUNDS = 12
CARRIED = ("chunk_id", "project", "rel_path", "content_hash")
#: What rounding may add to a bound.
SLACK = 1e-9


def centroids(vectors: DataFrame, lists: int, column: str = "embedding", sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``lists`` unit vectors, from the ``sample`` vectors of least hash."""
    usable = vectors.select(F.col(column).cast("array<double>").alias("v")).where("v is not null and exists(v, x -> x <> 0)")
    rows = usable.orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.unique(np.array([r["v"] for r in rows]), axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(42)
    found = x[rng.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        nearest = np.argmax(x @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.where(size > 0, size, 1), found)
    return found


def assigned(chunks: DataFrame, found: np.ndarray) -> DataFrame:
    """Chunks with ``list`` and the ``angle`` to its centroid; zero vectors have a list of their own, the last."""
    shared = chunks.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(batch.column(len(CARRIED)))
            cosines = x @ shared.value.T
            nearest = cosines.argmax(axis=1)
            angle = np.arccos(np.clip(cosines[np.arange(len(x)), nearest], -1, 1))
            zero = ~x.any(axis=1)
            nearest[zero], angle[zero] = len(shared.value), np.pi / 2
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "list", "angle"])

    source = chunks.select(*CARRIED, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())]))


def build(chunks: DataFrame, path: str, lists: int) -> Lists:
    """Write the lists of ``chunks`` to ``path``; a list that holds very much is written by several tasks."""
    found = centroids(chunks, lists)
    if len(found):
        assigned(chunks, found).hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/vectors")
        spark = chunks.sparkSession
        held = spark.read.parquet(f"{path}/vectors").groupBy("list").agg(F.max("angle").alias("radius"))
        places = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(found)], "list int, centroid array<double>")
        held.join(places, "list", "left").coalesce(1).write.parquet(f"{path}/lists")
    return Lists(chunks.sparkSession, path)


class Lists:
    """Lists that ``build`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # as many as there are lists
        self._zero = [r["list"] for r in rows if r["centroid"] is None]
        known = [r for r in rows if r["centroid"] is not None]
        self._lists = np.array([r["list"] for r in known], np.int64)
        self._radius = np.array([r["radius"] for r in known])
        self._centroids = np.array([r["centroid"] for r in known])

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = True, block: int = QUERY_BLOCK) -> DataFrame:
        """``(query_id, rank, score, chunk_id, project, rel_path, content_hash)``: the k best of each query.

        ``queries`` are ``(query_id, embedding)``.  Each query reads the ``probes``
        nearest lists; if ``exact``, then all others that could hold one of its
        best k.  Blocks of queries follow each other, and results are ranked as
        by ``retrieval.ranked``.
        """
        total = queries.count()
        blocks = max(1, -(-total // block))
        found = None
        for b in range(blocks):
            part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            rows = part.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).collect()
            if rows:
                one = self._block([r["query_id"] for r in rows], np.array([r["embedding"] for r in rows]), k, probes, exact, queries.schema["query_id"].dataType)
                found = one if found is None else found.unionByName(one)
        if found is None:
            kinds = ", ".join(f"{c} string" for c in CARRIED)
            return self._spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, rank int, score double, {kinds}")
        return found

    def reads(self, asked: np.ndarray, probes: int) -> np.ndarray:
        """Which lists each query reads first, as a mask over all lists."""
        nearest = np.argsort(-(asked @ self._centroids.T), axis=1, kind="stable")[:, :probes]
        mask = np.zeros((len(asked), len(self._lists)), bool)
        mask[np.arange(len(asked))[:, None], nearest] = True
        return mask

    def _block(self, ids: list, vectors: np.ndarray, k: int, probes: int, exact: bool, kind: T.DataType) -> DataFrame:
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        asked = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
        first = self.reads(asked, probes)
        found = self._scan(ids, asked, first, np.zeros(len(ids), bool), k, kind)
        if not exact:
            return _ranked(found, k)
        found = stored(found, "lists")
        kth = _ranked(found, k).where(F.col("rank") == k).select("query_id", "score").toPandas()
        least = pd.Series(kth["score"].to_numpy(), index=kth["query_id"]).reindex(ids).fillna(-np.inf).to_numpy(np.float64)
        angle = np.arccos(np.clip(asked @ self._centroids.T, -1, 1))
        bound = np.cos(np.maximum(angle - self._radius, 0)) + SLACK
        bound[~asked.any(axis=1)] = np.inf  # a query without a direction is as near to all
        more = ~first & (bound >= least[:, None])
        rest = self._scan(ids, asked, more, least <= SLACK, k, kind)
        return _ranked(found.unionByName(rest), k)

    def _scan(self, ids: list, asked: np.ndarray, mask: np.ndarray, zero: np.ndarray, k: int, kind: T.DataType) -> DataFrame:
        """The best rows that each task finds in the lists that ``mask`` allows each query; other lists are not read."""
        used = [*self._lists[mask.any(axis=0)].tolist(), *(self._zero if zero.any() else [])]
        width = int(max([*self._lists.tolist(), *self._zero], default=-1)) + 1
        allowed = np.zeros((len(ids), width), bool)
        allowed[:, self._lists] = mask
        allowed[:, self._zero] = zero[:, None]
        shared = self._spark.sparkContext.broadcast((ids, asked, allowed))
        rows = self._spark.read.parquet(f"{self._path}/vectors").where(F.col("list").isin(used)).select(*CARRIED, "list", "embedding")
        kinds, own_type = dict(rows.dtypes), to_arrow_type(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked, allowed = shared.value
            best = Best(len(ids), k)
            types: list = []
            for batch in batches:
                types = [c.type for c in batch.columns[: len(CARRIED)]]
                for at in range(0, batch.num_rows, 4096):
                    piece = batch.slice(at, 4096)
                    lists = piece.column(len(CARRIED)).to_numpy()
                    own = list(zip(*(c.to_pylist() for c in piece.columns[: len(CARRIED)]), strict=True))
                    x = units(piece.column(len(CARRIED) + 1))
                    for q0 in range(0, len(ids), 256):
                        fit = allowed[q0 : q0 + 256][:, lists]
                        if fit.any():
                            best.offer(np.round(asked[q0 : q0 + 256] @ x.T, PLACES), fit, own, q0)
            out = [(ids[q], -row[0], *row[1:]) for q, row in best]
            if out:
                columns = [pa.array([r[0] for r in out], own_type), pa.array([r[1] for r in out], pa.float64())]
                columns += [pa.array([r[2 + i] for r in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "score", *CARRIED])

        return rows.mapInArrow(run, f"query_id {kind.simpleString()}, score double, " + ", ".join(f"{c} {kinds[c]}" for c in CARRIED))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "score", *CARRIED)
