"""What the operators need from the cluster: a shared folder, lineage cuts and stored tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, new_path, numbered, shared_dir, stored

__all__ = ["cut", "new_path", "numbered", "only_ids", "release", "runs", "shared_dir", "stored"]

#: Bits of the bitmap that picks rows before they are shuffled: 4 MB whatever the data.
FILTER_BITS = 25


def release() -> None:
    """Give memory that a finished task used back to the machine; a Python worker lives on and serves other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def only_ids(texts: DataFrame, ids: DataFrame, log_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``texts`` whose id may be in ``ids``: all that are, and few others.

    A bitmap of 2**log_bits hashed ids, built by aggregation in pieces of 32,768
    bits, decides; its size does not grow with the data, so it is broadcast.
    It only spares the join that follows the shuffle of texts that match nothing.
    """
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << log_bits))
    bits = (
        ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    )
    octet = F.conv(F.hex(F.expr("substring(bits, int(bitmap_bit_position(spot) div 8) + 1, 1)")), 16, 10).cast("int")
    marked = texts.withColumn("spot", spot).withColumn("piece", F.bitmap_bucket_number("spot"))
    chosen = marked.join(F.broadcast(bits), "piece").where(octet.bitwiseAND(F.expr("shiftleft(1, int(bitmap_bit_position(spot) % 8))")) != 0)
    return chosen.select(*texts.columns)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of equal values in the first ``keys`` columns, which are whole numbers and sorted, as one batch each."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield whole()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()
