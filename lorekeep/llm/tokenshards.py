"""Token ids in training order, written to fixed-stride binary shards.

Every document is encoded and cut into sequences of at most ``length`` tokens.
A keyed hash of (document, text, sequence) deals them to shards of about equal size,
and inside a shard a keyed Feistel network, walked until it lands inside the
shard, permutes their ranks; shard and rank give the global slot, a number from
0 to one less than the number of sequences, each used once.  The slots of a
shard are a range, written by one task in slot order.

A record has a fixed size: document id (8 bytes), sequence number (4), token
count (4), ``length`` token ids, a line feed; so slot n of a shard begins at
n times the stride, and a reader knows where any slot lies without an index.  Spark's
text writer lays the bytes down and commits whole files, so an attempt that is
lost leaves nothing.

Dealing by a hash needs no count before the tokens are known: the texts are
encoded once and shuffled once.  Rows without an id, or that repeat one, are
told apart by their texts; an id and text that many rows repeat is dealt row by
row, so no shard gets them all (which of equal rows is where does not matter).

Defined results: null and empty texts have no sequences; a very long text is
encoded in stretches, as it would be in the whole; special strings are ordinary
text; rows that repeat give sequences each (in the order of their
digest); a null id is written as the least long and read as null, and so is an id
that is the least long itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, blocks
from .cluster import cut
from .tokencount import stable

LENGTH = 256
KEY = 0x5EED
#: Bytes of text whose tokens go to one shard; a task holds one shard.
SHARD_BYTES = 16_000_000
#: An id and text that more rows repeat is dealt to shards row by row.
COPIES = 1_024
BROADCAST_ROWS = 100_000
#: Longer texts are encoded in stretches, cut where the encoding splits anyway.
STRETCH_CHARS = 65_536
_NO_ID = -(1 << 63)
HEAD = np.dtype([("id", "<i8"), ("seq", "<u4"), ("n", "<u4")])


@lru_cache(maxsize=2)
def load(path: str, pattern: str = PATTERN):
    """The encoder of a rank file, one for each Python worker; ``pattern`` cuts texts into words."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = STRETCH_CHARS) -> Iterator[str]:
    """The text in stretches of at least ``size`` that are encoded as they would be in the whole."""
    start = 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at >= 0 and not stable(text, at):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def feistel(index: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0..size-1: a Feistel network over the next even number of bits, cycle-walked."""
    half = max(1, ((max(1, size - 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            with np.errstate(over="ignore"):
                mixed = (right + np.uint64((key * 4 + r + 1) & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[walk] = (left << np.uint64(half)) | right
        walk = walk[out[walk] >= size]
    return out.astype(np.int64)


def stride(length: int, width: int) -> int:
    return HEAD.itemsize + length * width + 1


def sequences(
    docs: DataFrame, path: str, id_col: str, text_col: str, length: int, width: int, pattern: str = PATTERN,
    copies: DataFrame | None = None, key: int = KEY,
) -> DataFrame:
    """``(id, mark, seq, n, tokens)``: a keyed hash of the row, and tokens as little-endian numbers of ``width`` bytes.

    Rows of one id and text have one mark, but those named in ``copies`` (id, h,
    copies) have as many marks as they are, whichever row gets which.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in batches:
            for start, texts in blocks(batch.column(1).to_pylist()):
                rows: list[tuple] = []
                own = batch.slice(start, len(texts))
                for doc, mark, text in zip(own.column(0).to_pylist(), own.column(2).to_pylist(), texts, strict=True):
                    tokens = np.concatenate([np.array(encoder.encode_ordinary(t), f"<u{width}") for t in stretches(text)])
                    rows += [
                        (doc, mark, seq, min(length, len(tokens) - at), tokens[at : at + length].tobytes())
                        for seq, at in enumerate(range(0, len(tokens), length))
                    ]
                if rows:
                    ids, marks, seqs, n, data = zip(*rows, strict=True)
                    longs = [pa.array(c, pa.int64()) for c in (ids, marks)]
                    ints = [pa.array(c, pa.int32()) for c in (seqs, n)]
                    yield pa.RecordBatch.from_arrays([*longs, *ints, pa.array(data, pa.binary())], ["id", "mark", "seq", "n", "tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    place = F.lit(0).cast("long")
    if copies is not None:
        named = copies.withColumnRenamed("id", "i")
        texts = texts.join(named, texts["id"].eqNullSafe(named["i"]) & (texts["h"] == named["h"]), "left").select("id", "text", texts["h"], "copies")
        place = F.when(F.col("copies").isNotNull(), F.monotonically_increasing_id() % F.col("copies")).otherwise(place)
    marked = texts.select("id", "text", F.xxhash64(F.lit(key), "id", "h", place).alias("mark"))
    return marked.mapInArrow(run, "id long, mark long, seq int, n int, tokens binary")


def write_shards(
    docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    width: int = 2, key: int = KEY, shard_bytes: int = SHARD_BYTES, pattern: str = PATTERN,
) -> int:
    """Write the shards under ``out``, a file each, named by their number; returns how many shards there are."""
    if load(path, pattern).n_vocab > 1 << (8 * width):
        raise ValueError(f"token ids do not fit into {width} bytes")
    text = F.col(text_col).cast("string")
    groups = cut(
        docs.groupBy(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"))
        .agg(F.count("*").alias("copies"), F.sum(F.octet_length(text)).alias("size"))
    )
    total = groups.agg(F.sum("size").alias("n")).first()["n"] or 0
    copies = groups.where(F.col("copies") > COPIES).select("id", "h", "copies")
    # Few rows in most tables; joining them must then not shuffle the texts.
    few = copies.limit(BROADCAST_ROWS + 1).count()
    copies = None if few == 0 else F.broadcast(copies) if few <= BROADCAST_ROWS else copies
    shards = max(1, -(-total // shard_bytes))
    size = length * width

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        one = pa.Table.from_batches(held)
        shard, ids, seqs, n = (one.column(c).to_numpy() for c in ("shard", "id", "seq", "n"))
        data = one.column("tokens").combine_chunks()
        del one, held
        slot = np.empty(len(ids), np.int64)
        slot[feistel(np.arange(len(ids)), len(ids), key ^ (int(shard[0]) << 20))] = np.arange(len(ids))
        record = np.dtype([("head", HEAD), ("tokens", f"V{size}"), ("end", "S1")])
        for at in range(0, len(slot), 4096):
            part = slot[at : at + 4096]
            rows = np.zeros(len(part), record)
            rows["head"]["id"], rows["head"]["seq"], rows["head"]["n"] = ids[part], seqs[part], n[part]
            tokens = [x.ljust(size, b"\0") for x in data.take(pa.array(part)).to_pylist()]
            rows["tokens"] = np.frombuffer(b"".join(tokens), f"V{size}")
            whole = rows.tobytes()
            step = record.itemsize
            values = [whole[i : i + step - 1] for i in range(0, len(whole), step)]  # the writer adds the line feed
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])

    dealt = sequences(docs, path, id_col, text_col, length, width, pattern, copies, key).select(
        F.pmod(F.xxhash64("mark", "seq"), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce("id", F.lit(_NO_ID)).alias("id"), "seq", "mark", "n", "tokens",
    )
    ordered = dealt.repartitionById(shards, "shard").sortWithinPartitions("id", "seq", "mark")
    laid = ordered.mapInArrow(lay, "value binary")
    laid.select(F.col("value").cast("string").alias("value")).write.option("compression", "none").text(out)
    return shards


def read_shards(spark: SparkSession, out: str, length: int = LENGTH, width: int = 2) -> DataFrame:
    """``(slot, shard, at, id, seq, n, ids_sha256)`` of every record, read back from the shards.

    ``at`` is the byte at which the record begins in its shard.  The sizes of
    the shards give the first slot of each: 8 bytes for 16 MB of text are sent to the tasks.
    """
    step = stride(length, width)
    files = spark.read.format("binaryFile").load(out)
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    sizes = files.select(number.alias("shard"), (F.col("length") / step).cast("long").alias("n")).toArrow()
    shards, counts = (sizes.column(c).to_numpy() for c in ("shard", "n"))
    first = np.zeros(int(shards.max(initial=-1)) + 2, np.int64)
    first[shards + 1] = counts
    shared = spark.sparkContext.broadcast(np.cumsum(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = np.dtype([("head", HEAD), ("tokens", f"V{length * width}"), ("end", "S1")])
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(content.as_buffer(), record)
                place = np.arange(len(rows))
                digests = [
                    hashlib.sha256(t[: k * width]).hexdigest()
                    for t, k in zip(rows["tokens"].tolist(), rows["head"]["n"].tolist(), strict=True)
                ]
                ids = rows["head"]["id"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(place + int(shared.value[shard])),
                        pa.array(np.full(len(rows), shard, np.int32)),
                        pa.array(place * step),
                        pa.array(ids, mask=ids == _NO_ID),
                        pa.array(rows["head"]["seq"].astype(np.int64)),
                        pa.array(rows["head"]["n"].astype(np.int64)),
                        pa.array(digests, pa.string()),
                    ],
                    ["slot", "shard", "at", "id", "seq", "n", "ids_sha256"],
                )

    return files.select(number.alias("shard"), "content").mapInArrow(
        run, "slot long, shard int, at long, id long, seq long, n long, ids_sha256 string"
    )


def read_slots(spark: SparkSession, out: str, shard: int, start: int, count: int, length: int = LENGTH, width: int = 2) -> list[np.ndarray]:
    """Token ids of ``count`` records of a shard from its record ``start`` on: how a reader resumes, by one seek."""
    step, jvm = stride(length, width), spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(out)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = files.globStatus(jvm.org.apache.hadoop.fs.Path(folder, f"part-{shard:05d}-*"))
    if not named:
        return []
    size = max(0, min(count * step, named[0].getLen() - start * step))
    stream = files.open(named[0].getPath())
    try:
        stream.seek(start * step if size else 0)
        part = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size)))
    finally:
        stream.close()
    heads = [int(np.frombuffer(part, HEAD, 1, at)["n"][0]) for at in range(0, len(part), step)]
    return [np.frombuffer(part, f"<u{width}", n, i * step + HEAD.itemsize) for i, n in enumerate(heads)]
