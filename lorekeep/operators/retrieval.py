"""Nearest chunks for one query or for many, without duplicates and with caps.

Ranking is exact: by cosine to PLACES decimals, so that equal texts tie wherever
they are compared, then by chunk id.  One query is a filter, a score
column and a top-k.  Many queries go against all chunks in blocks of bounded
size: each block is sent to the tasks, every task keeps the best k of what it
sees for each query, and a window merges the tasks' lists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import cosine
from ..sources.shared import stored

SEARCH_K, ANSWER_K = 5, 10
OVERFETCH = 2
PER_FILE, PER_PROJECT, POOL = 3, 5, 40
#: Queries that are sent to the tasks at once.
QUERY_BLOCK = 2_048
PLACES = 12


class RetrievalError(RuntimeError):
    """A search that must not run."""


def resolve_projects(names: Sequence[str], known: Sequence[str]) -> list[str]:
    """The known spelling of each name, whatever its case; unknown names are left out."""
    wanted = {n.strip().casefold() for n in names}
    return [k for k in known if k.casefold() in wanted]


def check_search(query: str, k: int, namespace: str | None, embedder_namespace: str, empty: bool) -> None:
    """Refuses before anything is embedded."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if not query.strip():
        raise RetrievalError("The query is empty.")
    if empty:
        raise RetrievalError("There is no index yet.")
    if namespace != embedder_namespace:
        raise RetrievalError(f"The index holds vectors of {namespace!r}, not of {embedder_namespace!r}; build it again.")


def nearest(
    chunks: DataFrame, vector: Sequence[float], k: int = SEARCH_K, project: str | None = None, exclude: Sequence[str] = ()
) -> DataFrame:
    """The k chunks nearest to one vector, with ``score`` and ``rank``; filters come before the ranking."""
    rows = chunks.where(~F.col("project").isin(list(exclude))) if exclude else chunks
    if project is not None:
        rows = rows.where(F.col("project") == project)
    asked = F.array(*[F.lit(float(v)) for v in vector])
    top = rows.withColumn("score", F.round(cosine(F.col("embedding"), asked), PLACES)).orderBy(F.desc("score"), "chunk_id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")))  # k rows at most


class Best:
    """The best k (score, row) for each query of a block."""

    def __init__(self, n: int, k: int):
        self._k = k
        self._rows: list[list[tuple]] = [[] for _ in range(n)]
        self._least = np.full(n, -np.inf)

    def offer(self, scores: np.ndarray, allowed: np.ndarray | None, rows: list[tuple], q0: int) -> None:
        """``scores`` has a line for each query from q0 on; ``rows`` begin with the chunk id."""
        good = scores >= self._least[q0 : q0 + len(scores), None]
        if allowed is not None:
            good &= allowed
        for q in np.flatnonzero(good.any(axis=1)):
            found = np.flatnonzero(good[q])
            if len(found) > 4 * self._k:  # all that tie with the k-th stay
                line = scores[q, found]
                found = found[line >= np.partition(line, len(line) - self._k)[len(line) - self._k]]
            mine = self._rows[q0 + q] + [(-scores[q, i], *rows[i]) for i in found]
            mine.sort(key=lambda r: r[:2])
            self._rows[q0 + q] = mine[: self._k]
            if len(mine) >= self._k:
                self._least[q0 + q] = -self._rows[q0 + q][-1][0]

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        for q, rows in enumerate(self._rows):
            for row in rows:
                yield q, row


def units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def ranked(chunks: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, score, chunk_id, project, rel_path, content_hash)``: the k best of each query.

    ``queries`` are ``(query_id, embedding)``, with ``project`` (a chunk must be
    of it, if set) and ``exclude`` (of none of these) where wanted.
    """
    spark = chunks.sparkSession
    kinds = dict(chunks.dtypes)
    query_kind = dict(queries.dtypes)["query_id"]
    id_type = to_arrow_type(queries.schema["query_id"].dataType)
    carried = ["chunk_id", "project", "rel_path", "content_hash"]
    source = chunks.select(*carried, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    schema = f"query_id {query_kind}, score double, " + ", ".join(f"{c} {kinds[c]}" for c in carried)

    def search(part: list) -> DataFrame:
        asked = np.array([r["embedding"] for r in part], np.float64)
        size = np.linalg.norm(asked, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast(
            (
                [r["query_id"] for r in part],
                np.divide(asked, size, out=np.zeros_like(asked), where=size > 0),
                [r["project"] if "project" in r else None for r in part],
                [frozenset(r["exclude"] or ()) if "exclude" in r else frozenset() for r in part],
            )
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, only, without = shared.value
            filtered = any(p is not None for p in only) or any(without)
            best = Best(len(ids), k)
            types: list = []
            for batch in batches:
                types = types or [c.type for c in batch.columns[:4]]
                for at in range(0, batch.num_rows, 4096):
                    piece = batch.slice(at, 4096)
                    x = units(piece.column(4))
                    rows = list(zip(*(c.to_pylist() for c in piece.columns[:4]), strict=True))
                    for q0 in range(0, len(ids), 256):
                        allowed = None
                        if filtered:
                            names = [r[1] for r in rows]
                            allowed = np.array(
                                [[(o is None or n == o) and n not in w for n in names] for o, w in zip(only[q0 : q0 + 256], without[q0 : q0 + 256], strict=True)]
                            )
                        best.offer(np.round(vectors[q0 : q0 + 256] @ x.T, PLACES), allowed, rows, q0)
            out = [(ids[q], -row[0], *row[1:]) for q, row in best]
            if out:
                first = pa.array([r[0] for r in out], id_type)
                score = pa.array([r[1] for r in out], pa.float64())
                rest = [pa.array([r[2 + i] for r in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([first, score, *rest], ["query_id", "score", *carried])

        return source.mapInArrow(run, schema)

    first = queries.limit(block + 1).collect()
    if len(first) <= block:  # all of them, computed once
        found = [search(first)] if first else []
    else:
        blocks = -(-queries.count() // block)
        parts = (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks))
        # Each block's winners are stored before the next block comes to the driver.
        found = [stored(search(rows), "ranked") for p in parts if (rows := p.collect())]
    if not found:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1)).select("query_id", "rank", "score", *carried)
    merged = reduce(DataFrame.unionByName, found)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "score", *carried)


def without_duplicates(found: DataFrame, k: int) -> DataFrame:
    """The best row of each content, the first k of those, ranked anew; nothing is filled up."""
    first = W.partitionBy("query_id", "content_hash").orderBy("rank")
    kept = found.withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")
    return _renumbered(kept, k)


def _renumbered(rows: DataFrame, k: int) -> DataFrame:
    again = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return rows.withColumn("rank", again).where(F.col("rank") <= k)


def capped(
    found: DataFrame, k: int = ANSWER_K, per_file: int = PER_FILE, per_project: int | None = PER_PROJECT
) -> DataFrame:
    """At most so many rows of a file, then of a project (None: no cap), then the first k.

    The stacked ranks give what a walk in rank order would: a row that its
    project's cap keeps out never changes what its file's cap lets in.
    """
    if per_file < 1 or (per_project is not None and per_project < 1):
        raise ValueError("caps must be at least 1")
    of_file = W.partitionBy("query_id", "project", "rel_path").orderBy("rank")
    rows = found.withColumn("_n", F.row_number().over(of_file)).where(F.col("_n") <= per_file)
    if per_project is not None:
        of_project = W.partitionBy("query_id", "project").orderBy("rank")
        rows = rows.withColumn("_n", F.row_number().over(of_project)).where(F.col("_n") <= per_project)
    return _renumbered(rows.drop("_n"), k)


def search(chunks: DataFrame, queries: DataFrame, k: int = SEARCH_K) -> DataFrame:
    """Results of each query: twice k candidates, duplicates collapsed, k at most."""
    return without_duplicates(ranked(chunks, queries, k * OVERFETCH), k)


def passages(
    chunks: DataFrame, queries: DataFrame, k: int = ANSWER_K, per_file: int = PER_FILE,
    per_project: int | None = PER_PROJECT, pool: int = POOL,
) -> DataFrame:
    """Passages to answer each query from: a pool of search results under the caps."""
    if pool < k:
        raise ValueError("the pool must hold at least k")
    return capped(search(chunks, queries, pool), k, per_file, per_project)
