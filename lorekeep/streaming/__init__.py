"""Keeping an index up to date from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents
from ..operators.embedding import Embedder
from ..plans.index import Index
from ..plans.runs import embedded


def follow(docs: DataFrame, index: Index, embedder: Embedder, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Chunk, embed and upsert each micro-batch of documents ``(project, rel_path, path, mtime, text)``.

    Chunk ids come from project, path and place, so a batch that runs again
    after a failure replaces its own rows and changes nothing.  All earlier
    chunks of a document go, so one that became shorter leaves none behind.
    Texts whose vectors are saved are not embedded again.
    """

    def one(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        with embedded(index, chunk_documents(batch), embedder) as whole:
            index.upsert(whole, embedder.namespace, batch)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
