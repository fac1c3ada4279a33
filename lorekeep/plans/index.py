"""An index of Parquet parts, merged when it is read, with a pointer to the parts that count.

A part is written whole into a folder of its own and then named by the pointer,
so readers see the index as it was or as it is and never half of a change.  The
first part is the base; an update adds a part with its chunks and the keys of
what they replace, so it writes what it brings and not what is there.  Reading
leaves out what a later part replaces; ``compact`` folds all parts into a new
base, and one that is lost on the way has changed nothing.

Chunks lie in order of project and path, so filters on these skip files, and each
file of the base has a Bloom filter of its chunk ids, so a look-up by id reads the
file that has it and hardly another.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.guards import checked

#: Updates after which ``upsert`` compacts.
PARTS = 16
#: Parquet's own Bloom filters, as large as a file's ids need.
BLOOM = {"parquet.bloom.filter.enabled#chunk_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
_KEYS = "project string, rel_path string, chunk_id string"


class SpaceMismatch(RuntimeError):
    """Vectors of one space must not be put beside those of another."""


class Index:
    """The index at ``root``: chunks with vectors, and what is known about how they came to be."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")

    def _table(self, path: str) -> DataFrame | None:
        try:
            return self._spark.read.parquet(path)
        except AnalysisException:
            return None

    def meta(self) -> dict | None:
        """``version``, ``parts``, ``namespace``, ``excluded`` and ``indexed`` (None: not recorded) of the version that counts."""
        pointers = self._table(f"{self._root}/pointer")
        last = pointers.orderBy(F.desc("written"), F.desc("version")).first() if pointers is not None else None
        return json.loads(last["meta"]) | {"version": last["version"]} if last else None

    def chunks(self) -> DataFrame | None:
        """All chunks that no later part replaces."""
        meta = self.meta()
        if meta is None:
            return None
        return reduce(DataFrame.unionByName, [self._seen(meta["parts"], at) for at in range(len(meta["parts"]))])

    def _seen(self, parts: Sequence[str], at: int) -> DataFrame:
        rows = self._spark.read.parquet(f"{self._root}/parts/{parts[at]}")
        if at + 1 == len(parts):
            return rows
        gone = self._spark.read.schema(_KEYS).parquet(*(f"{self._root}/replaced/{p}" for p in parts[at + 1 :]))
        names = rows.columns
        rows = rows.join(gone.where("chunk_id is null").select("project", "rel_path").distinct(), ["project", "rel_path"], "left_anti")
        return rows.join(gone.where("chunk_id is not null").select("chunk_id").distinct(), "chunk_id", "left_anti").select(names)

    def projects(self) -> list[str]:
        chunks = self.chunks()
        if chunks is None:
            return []
        return [r["project"] for r in chunks.select("project").distinct().orderBy(F.lower("project")).collect()]

    def count(self) -> int:
        chunks = self.chunks()
        return chunks.count() if chunks is not None else 0

    def found(self, chunk_id: str) -> DataFrame | None:
        """The row of one chunk; files whose Bloom filters do not know the id are not read."""
        chunks = self.chunks()
        return chunks.where(F.col("chunk_id") == chunk_id) if chunks is not None else None

    def get(self, chunk_id: str):
        rows = self.found(chunk_id)
        row = rows.first() if rows is not None else None
        if row is None:
            raise KeyError(chunk_id)
        return row

    def _write(self, chunks: DataFrame, excluded: Sequence[str], base: bool) -> str:
        part = uuid.uuid4().hex
        rows = checked(chunks, excluded).repartitionByRange("project", "rel_path").sortWithinPartitions("project", "rel_path", "chunk_index")
        # A filter is 64 kB at least, more than most updates; those are small and read whole.
        rows.write.options(**(BLOOM if base else {})).parquet(f"{self._root}/parts/{part}")
        return part

    def _point(self, parts: Sequence[str], namespace: str, excluded: Sequence[str], indexed: Sequence[str] | None) -> str:
        version = uuid.uuid4().hex
        said = {"parts": list(parts), "namespace": namespace, "excluded": list(excluded), "indexed": None if indexed is None else list(indexed)}
        row = self._spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written"), F.lit(json.dumps(said)).alias("meta"))
        row.coalesce(1).write.mode("append").parquet(f"{self._root}/pointer")
        return version

    def replace(self, chunks: DataFrame, namespace: str, excluded: Sequence[str] = (), indexed: Sequence[str] | None = None) -> str:
        """Make ``chunks`` (with ``embedding``) the whole index; a chunk of an excluded project stops it before anything changes."""
        return self._point([self._write(chunks, excluded, True)], namespace, excluded, indexed)

    def upsert(self, chunks: DataFrame, namespace: str, documents: DataFrame | None = None, parts: int = PARTS) -> str:
        """Chunks by id over those that are there; other chunks of ``documents`` (project, rel_path) go.

        Only the chunks and the keys of what they replace are written.
        """
        meta = self.meta()
        if meta is None:
            return self.replace(chunks, namespace)
        if meta["namespace"] != namespace:
            raise SpaceMismatch(f"the index holds {meta['namespace']}, not {namespace}")
        part = self._write(chunks, meta["excluded"], False)
        written = self._spark.read.parquet(f"{self._root}/parts/{part}")
        none = F.lit(None).cast("string")
        whole = None if documents is None else documents.select("project", "rel_path").distinct()
        # Chunks of documents that go whole need no key of their own.
        others = written if whole is None else written.join(whole, ["project", "rel_path"], "left_anti")
        keys = others.select(none.alias("project"), none.alias("rel_path"), "chunk_id")
        if whole is not None:
            keys = keys.unionByName(whole.withColumn("chunk_id", none))
        keys.write.parquet(f"{self._root}/replaced/{part}")
        version = self._point([*meta["parts"], part], namespace, meta["excluded"], meta["indexed"])
        return self.compact() if len(meta["parts"]) >= parts else version

    def compact(self) -> str | None:
        """All parts as one; nothing that a reader sees changes."""
        meta = self.meta()
        if meta is None or len(meta["parts"]) == 1:
            return meta and meta["version"]
        return self._point([self._write(self.chunks(), meta["excluded"], True)], meta["namespace"], meta["excluded"], meta["indexed"])

    def cache(self) -> DataFrame | None:
        return self._table(f"{self._root}/cache")

    def save_vectors(self, rows: DataFrame) -> None:
        """Append ``(key, vector)`` to the cache; of a key that is written again the last counts."""
        rows.select("key", "vector", F.current_timestamp().alias("written")).write.mode("append").parquet(f"{self._root}/cache")


def upserted(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """``new`` and what of ``old`` it does not replace."""
    return new if old is None else old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)
