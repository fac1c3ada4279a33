"""Embedding near-duplicates by cross-polytope hashing, every pair verified.

A vector is rotated (three rounds of random signs and a fast Hadamard
transform) and hashed to the nearest vertex of the cross-polytope: the axis of
its largest coordinate, with the sign.  A bucket of a table joins ``parts`` such
hashes.  Every vector lives in its home bucket of each table and also asks in
the buckets that are nearly as close (multiprobe).

``parts`` is a parameter, the same for tables of every size.  With two, a pair
at a cosine of exactly 0.95 is found with a chance of 0.998 in 64 dimensions
and 0.994 in 256; with one of 1.0; with three of 0.97 and 0.93.  Nearer pairs
are found more surely.  More parts make buckets smaller, for larger tables.

Buckets are met twice.  First with 126 signs of random projections in place of
the vector, 40 bytes a row: a row with no other of near signs in a bucket leaves
it (near leaves six standard deviations about what the cosine gives).  What
stays brings its vector and is compared by its cosine in double precision.

Equal vectors are one class from the start, and only classes are compared.  A
pair can meet in several buckets; both sides' buckets are recomputed from the
vectors, and the pair counts in the first place only, so links are counted
exactly while no pair ever leaves its task: a task returns a count and a
spanning tree's link for each vector.  A task holds the vectors that live in a
block of a bucket, at most BLOCK_BYTES, and those that ask stream past them.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, link with nothing and are kept; vectors of
different lengths never link; rows that repeat an id are vectors of their own;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut, only_ids, stored
from .components import connected_components, merge

TABLES = 5
#: Buckets of a table in which a vector is looked for, its home among them.
PROBES = 3
#: Hashes that a bucket joins.
PARTS = 2
#: Bytes of vectors, as doubles, that a task holds of a bucket.
BLOCK_BYTES = 1 << 25
#: Rows of a bucket that are compared by signs; all rows of a fuller one go on to the cosines.
SIGN_ROWS = 131_072
#: Signs of random projections, in two numbers.
SIGNS = 126
SEED = 20_011


def _hadamard(x: np.ndarray) -> np.ndarray:
    size, h = x.shape[1], 1
    while h < size:
        x = x.reshape(len(x), size // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), size)
        h *= 2
    return x / np.sqrt(size)


@lru_cache(maxsize=256)
def _signs(table: int, part: int, size: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, part, size]).choice([-1.0, 1.0], size=(3, size))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in doubles, without overflow."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(units: np.ndarray, table: int, parts: int, probes: int = PROBES) -> np.ndarray:
    """(rows, probes) bucket numbers of one table, the home bucket first; places that are not used repeat it."""
    n, dim = units.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = units
    width = min(size, probes if parts == 1 else 3)
    vertex, loss = [], []
    for part in range(parts):
        x = padded
        for signs in _signs(table, part, size):
            x = _hadamard(x * signs)
        far = np.abs(x)
        top = np.argsort(-far, axis=1, kind="stable")[:, :width]
        score = np.take_along_axis(far, top, axis=1)
        vertex.append(2 * top + (np.take_along_axis(x, top, axis=1) < 0))
        loss.append((score[:, :1] - score) ** 2)
    combos = list(product(range(width), repeat=parts))
    total = np.stack([sum(loss[p][:, c[p]] for p in range(parts)) for c in combos], axis=1)
    codes = np.zeros((n, len(combos)), np.int64)
    for i, c in enumerate(combos):
        for p in range(parts):
            codes[:, i] = codes[:, i] * (2 * size) + vertex[p][:, c[p]]
    order = np.argsort(total, axis=1, kind="stable")[:, :probes]
    chosen = np.take_along_axis(codes, order, axis=1)
    return np.concatenate([chosen, np.repeat(chosen[:, :1], probes - chosen.shape[1], axis=1)], axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


@lru_cache(maxsize=64)
def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, SIGNS))


def signs(units: np.ndarray) -> np.ndarray:
    """(rows, 2) numbers of SIGNS / 2 bits each: the signs of random projections of each vector."""
    bits = (units @ _directions(units.shape[1]) > 0).reshape(len(units), 2, -1).astype(np.uint64)
    return (bits << np.arange(SIGNS // 2, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def sign_limit(cosine: float) -> int:
    """Signs in which a pair at the cosine may differ: six standard deviations above their number."""
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return int(np.ceil(SIGNS * p + 6 * np.sqrt(SIGNS * p * (1 - p))))


def bucket_keys(units: np.ndarray, tables: int, parts: int) -> np.ndarray:
    """(rows, tables * PROBES) keys: the table in the high half, a hash of bucket and dimension in the low one."""
    found = []
    for table in range(tables):
        mixed = (buckets(units, table, parts).astype(np.uint64) + np.uint64(units.shape[1] << 48)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(32)) | np.uint64(table << 32))
    return np.concatenate(found, axis=1).view(np.int64)


class Block:
    """Vectors that live in one block of a bucket, and what is linked to them."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, units: np.ndarray, table: int, parts: int, cosine: float):
        self._ids, self._weight, self._units = ids, weight, units
        self._table, self._parts, self._cosine = table, parts, cosine
        self._count, self._label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        self._own: list[np.ndarray] | None = None

    def _buckets(self, units: np.ndarray) -> list[np.ndarray]:
        return [buckets(units, t, self._parts) for t in range(self._table + 1)]

    def _near(self, units: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, rows, home rows) of near pairs, some rows at a time."""
        step = max(1, 4_000_000 // max(1, len(self._ids)))
        for at in range(0, len(units), step):
            i, j = np.nonzero(units[at : at + step] @ self._units.T >= self._cosine)
            yield at, i + at, j

    def _first(self, one: list[np.ndarray], i: np.ndarray, j: np.ndarray, lives: np.ndarray, larger: np.ndarray) -> np.ndarray:
        """Which pairs meet here first: row i asks home row j, or lives here as well."""
        fine = np.ones(len(i), bool)
        for t in range(self._table + 1):
            x, y = one[t][i], self._own[t][j]
            asks = (y[:, :1] == x).any(axis=1)  # i looks where j lives
            asked = (x[:, :1] == y).any(axis=1)
            # In this table, where j asks for i in another bucket too, the larger one's meeting counts.
            fine &= ~(asks | asked) if t < self._table else asks & (lives | ~asked | larger)
        return fine

    def inside(self) -> None:
        """Links among the home rows."""
        for _, i, j in self._near(self._units):
            i, j = i[i > j], j[i > j]
            if not len(i):
                continue
            if self._own is None:
                self._own = self._buckets(self._units)
            here = np.ones(len(i), bool)
            fine = self._first(self._own, i, j, here, here)
            i, j = i[fine], j[fine]
            np.add.at(self._count, i, self._weight[j])
            np.add.at(self._count, j, self._weight[i])
            self._label = merge(self._label, i, j)

    def asked(self, ids: np.ndarray, weight: np.ndarray, lives: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, linked rows, linked home id) of rows that ask; ``lives`` are those of another block of the bucket."""
        count, root = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for _, i, j in self._near(units):
            if not len(i):
                continue
            if self._own is None:
                self._own = self._buckets(self._units)
            rows, at = np.unique(i, return_inverse=True)
            fine = self._first(self._buckets(units[rows]), at, j, lives[i], ids[i] > self._ids[j])
            i, j = i[fine], j[fine]
            np.add.at(count, i, self._weight[j])
            np.add.at(self._count, j, weight[i])
            some, first = np.unique(i, return_index=True)
            root[some] = j[first]
            self._label = merge(self._label, j, root[i])
        linked = np.flatnonzero(count)
        return ids[linked], count[linked], self._ids[root[linked]]

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, linked rows, root id) of the home rows."""
        linked = np.flatnonzero(self._count)
        return self._ids[linked], self._count[linked], self._ids[self._label[linked]]


def _usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def hashed(rows: DataFrame, tables: int, parts: int) -> DataFrame:
    """``(id, a, b, signs, more, keys)`` of rows ``(id, a, b, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = _lengths(batch.column(3))
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length)) if (lengths != length).any() else batch
                units = unit(_vectors(part.column(3)))
                keys = bucket_keys(units, tables, parts)
                ends = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(keys.astype(np.uint32).view(np.int32).ravel()))
                said = [pa.array(x) for x in signs(units).view(np.int64).T.copy()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *said, lists], ["id", "a", "b", "signs", "more", "keys"])

    return rows.select("id", "a", "b", "v").mapInArrow(run, "id long, a long, b long, signs long, more long, keys array<int>")


def meetings(classes: DataFrame, cosine: float, tables: int) -> DataFrame:
    """``(key, c, home)``: classes ``(c, signs, more, keys)`` in the buckets where another has near signs."""
    limit = sign_limit(cosine)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, said, more = (batch.column(x).to_numpy() for x in (0, 1, 2))
            keys = batch.column(3).flatten().to_numpy().view(np.uint32).astype(np.int64).reshape(len(c), -1)
            for at in range(keys.shape[1]):
                table, probe = divmod(at, PROBES)
                seen = keys[:, table * PROBES : at]
                new = ~(seen == keys[:, at : at + 1]).any(axis=1)
                # Rows that live in a bucket have an even word.
                columns = (keys[new, at] | table << 32, c[new], said[new] << 1 | (probe > 0), more[new])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "c", "word", "more"])

    def pack(key: np.ndarray, c: np.ndarray, word: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(c), pa.array(word & 1 == 0)], ["key", "c", "home"])

    def near(word: np.ndarray, more: np.ndarray) -> np.ndarray:
        said, more, home = word.view(np.uint64) >> np.uint64(1), more.view(np.uint64), np.flatnonzero(word & 1 == 0)
        found = np.zeros(len(word), bool)
        step = max(1, 4_000_000 // max(1, len(home)))
        for at in range(0, len(word), step):
            differ = np.bitwise_count(said[at : at + step, None] ^ said[None, home])
            close = differ + np.bitwise_count(more[at : at + step, None] ^ more[None, home]) <= limit
            rows = np.arange(at, min(len(word), at + step))
            close &= rows[:, None] != home
            found[rows] |= close.any(axis=1)
            found[home] |= close.any(axis=0)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        last, size = None, 0

        def close() -> list[tuple[np.ndarray, ...]]:
            if not 1 < size <= SIGN_ROWS:
                return []
            rows = [np.concatenate(x) for x in zip(*held, strict=True)] if len(held) > 1 else held[0]
            if (rows[2] & 1 == 1).all():
                return []
            found = near(*rows[2:])
            return [tuple(x[found] for x in rows)] if found.any() else []

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(x).to_numpy() for x in range(4)]
            change = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if columns[0][a] != last:
                    out += close()
                    held, size, last = [], 0, columns[0][a]
                held.append(tuple(x[a:b] for x in columns))
                size += b - a
                if size > SIGN_ROWS:
                    out += held
                    held = []
            if out:
                yield pack(*(np.concatenate(x) for x in zip(*out, strict=True)))
        if out := close():
            yield pack(*out[0])

    rows = classes.select("c", "signs", "more", "keys").mapInArrow(spread, "key long, c long, word long, more long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, c long, home boolean")


def class_links(met: DataFrame, vectors: DataFrame, cosine: float, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(c, n, root)`` partial counts and tree links of classes ``(c, weight, v)`` in the buckets where they meet."""
    kind = dict(vectors.dtypes)["v"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block: Block | None = None
        last: tuple | None = None

        def read(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            c, weight, lives = (rows.column(x).to_numpy(zero_copy_only=False) for x in (4, 5, 6))
            return c, weight, lives.astype(bool), unit(_vectors(rows.column(7)))

        def close() -> list[tuple[np.ndarray, ...]]:
            nonlocal block, held
            if held and block is None and sum(x.num_rows for x in held) > 1:
                settle()
            found = [block.done()] if block is not None else []
            block, held = None, []
            return found

        def settle() -> None:
            nonlocal block, held
            c, weight, _, units = read(pa.concat_batches(held))
            block, held = Block(c, weight, units, last[0] >> 32, parts, cosine), []
            block.inside()

        for batch in batches:
            if not batch.num_rows:
                continue
            key, dim, number, asks = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(4))
            change = np.flatnonzero((key[1:] != key[:-1]) | (dim[1:] != dim[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                now = (int(key[a]), int(dim[a]), int(number[a]))
                if now != last:
                    out += close()
                    last = now
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                elif held or block is not None:
                    if block is None:
                        settle()
                    out.append(block.asked(*read(batch.slice(a, b - a))))
            if out := [x for x in out if len(x[0])]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["c", "n", "root"])
        if (out := close()) and len(out[0][0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out[0]], ["c", "n", "root"])

    full = met.where("home").groupBy("key").agg(F.count("*").alias("homes")).where(F.col("homes") * 8 > block_bytes // 4096)
    dim = F.size("v")
    blocks = F.greatest(F.lit(1), F.ceil(F.coalesce("homes", F.lit(0)) * 8 * dim / block_bytes)).cast("long")
    dealt = met.join(full, "key", "left").join(vectors, "c").withColumns({"dim": dim, "blocks": blocks})
    # A row lives in its block and asks in those before it; a row that only asks does so in all.
    mine = F.when(F.col("home"), F.pmod(F.xxhash64("c"), F.col("blocks"))).otherwise(F.col("blocks"))
    each = F.sequence(F.lit(0).cast("long"), F.least("mine", F.col("blocks") - 1))
    dealt = dealt.withColumn("mine", mine).withColumn("block", F.explode(each)).select(
        "key", "dim", "block", (~F.col("home") | (F.col("block") != F.col("mine"))).alias("asks"), "c", "weight", F.col("home").alias("lives"), "v",
    )
    place = ["key", "dim", "block"]
    return dealt.repartition(*place).sortWithinPartitions(*place, "asks").mapInArrow(compare, "c long, n long, root long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, tables: int = TABLES,
    parts: int = PARTS,
) -> DataFrame:
    """``(id, n_links, component, kept)`` per row."""
    # Floats travel as floats, at half the size; cosines are of doubles either way.
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    marked = rows.withColumn("usable", _usable(F.col("v")) & F.col("id").isNotNull())
    keyed = marked.withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), F.col("v"))})
    used = keyed.where("usable")
    firsts = [F.first(x).alias(x) for x in ("signs", "more", "keys")]  # equal in a class
    classes = stored(
        hashed(used, tables, parts).groupBy("a", "b").agg(F.min("id").alias("id"), F.count("*").alias("weight"), *firsts), "vector-classes"
    )
    met = cut(meetings(classes.withColumnRenamed("a", "c"), cosine, tables))
    wanted = classes.join(met.select(F.col("c").alias("a")).distinct(), "a", "left_semi").select("id", "a", "b", "weight")
    chosen = only_ids(used.select("id", "a", "b", "v"), wanted).join(wanted, ["id", "a", "b"]).dropDuplicates(["a", "b"])
    found = cut(class_links(met, chosen.select(F.col("a").alias("c"), "weight", "v"), cosine, parts))
    counts = found.groupBy("c").agg(F.sum("n").alias("n"))
    roots = connected_components(found, "c", "root").withColumnRenamed("node", "c")
    joined = (
        classes.select("a", "b", "id", "weight", F.col("a").alias("c")).join(counts, "c", "left").join(roots, "c", "left")
        .select("a", "b", "id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "c").alias("root"))
    )
    least = joined.groupBy("root").agg(F.min("id").alias("component"))
    named = joined.join(least, "root").select("a", "b", "n", "component")
    linked = used.select("id", "a", "b").join(named, ["a", "b"]).select("id", F.col("n").alias("n_links"), "component")
    alone = marked.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
