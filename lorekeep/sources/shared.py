"""The folder that driver and executors share, tables stored there, and rows numbered in order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the bitmap that picks rows before they are shuffled: 4 MB whatever the data.
FILTER_BITS = 25
#: ``monotonically_increasing_id`` counts within a partition in its lower bits.
_LOCAL_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what the session has set.

    Where neither is set, a local session (one machine, as in tests) gets a
    temporary folder; a cluster's is an error, as its machines share none.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep it in the shared folder, without its lineage.

    A lost executor then costs a read, not a recomputation.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, but as compressed columns: for tables with wide rows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """The rows with their number in ``order``, from 0, as a long.

    Ranges of the order are sorted in parallel and stored; only their sizes, a
    number for each partition, reach the driver, and are added up to offsets.
    Rows that tie in all of ``order`` get numbers in any order, once for all.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(sorted_.withColumn(name, F.monotonically_increasing_id()), name)
    part = F.shiftright(name, _LOCAL_BITS)
    sizes = kept.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row["part"], before))
        before += row["count"]
    found = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part long, __before long")
    local = F.col(name).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return kept.join(F.broadcast(found), part == F.col("__part")).withColumn(name, F.col("__before") + local).drop("__part", "__before")


def only_matching(rows: DataFrame, keys: DataFrame, key: str, log_bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``key`` may be in ``keys``: all that are, and few others.

    A bitmap of 2**log_bits hashed keys, built by aggregation in pieces of 32,768
    bits, decides; its size does not grow with the data, so it is broadcast.
    It only spares the join that follows the shuffle of rows that match nothing.
    """
    spot = F.pmod(F.xxhash64(key), F.lit(1 << log_bits))
    bits = (
        keys.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    )
    octet = F.conv(F.hex(F.expr("substring(bits, int(bitmap_bit_position(spot) div 8) + 1, 1)")), 16, 10).cast("int")
    marked = rows.withColumn("spot", spot).withColumn("piece", F.bitmap_bucket_number("spot"))
    chosen = marked.join(F.broadcast(bits), "piece").where(octet.bitwiseAND(F.expr("shiftleft(1, int(bitmap_bit_position(spot) % 8))")) != 0)
    return chosen.select(*rows.columns)
