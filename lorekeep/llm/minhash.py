"""Near-duplicates by the Jaccard similarity of five-word shingles, each link verified.

Texts with the same set of shingles are one class.  Candidates come from the
vantage-point trees (five-word fingerprints within three bits) and from
MinHash: a class has a bucket for each of 25 bands of four minima, so a pair at
a similarity of 0.8 shares none with a chance of (1 - 0.8^4)^25, two in a
million; likelier pairs less.

A class keeps a byte of each of its 100 minima.  At a similarity of 0.8 on
average 80 agree, and fewer than LIKELY do with a chance of about one in
ten million; candidates below are not looked at further.  All others are
verified on the sets of 64-bit shingle hashes.

Links are only needed up to components.  Each class is first held against the
likeliest of those that are chosen in its buckets.  What then lies in different
components of a bucket meets in tasks by the minima, 100 bytes a class; only
classes with a likely partner in another component bring their texts, and only
in the first bucket that the two share (told by bytes of the minima, so one pair
in a hundred million is missed), where blocks of them meet in tasks.

A null or wordless text has the empty set and links with its like only; a text
of fewer than five words is one shingle; a very long text has as many shingles
as it has, taken 1,024 at a time for the minima.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, only_ids, release, runs, stored
from .components import connected_components, merge

SEED = 42
SHINGLE = 5
BANDS, ROWS = 25, 4
#: Minima of which a byte must agree in a pair that is verified: six standard deviations below 80 of 100.
LIKELY = 56
#: Rows of one class or bucket that a task handles at once, and their shingles; more are dealt out in parts.
PART = 1_024
PART_SHINGLES = 1 << 20
#: Rows of a bucket whose minima a task compares at once.
SKETCHES = 8_192

_odd = np.random.default_rng(SEED).integers(1 << 63, size=(3, 128), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES, _TIMES, _PLUS = _odd[0, :SHINGLE], _odd[1, : BANDS * ROWS], _odd[2, : BANDS * ROWS]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of one UTF-8 text as sorted hashes."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly \x20 \x09-\x0D
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += each[i : i + n] * _PLACES[i]
    return np.unique(_mixed(total))


def alike(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether the similarity of two sets is 0.8 or more: x / (p + q - x) >= 4 / 5, in whole numbers."""
    return 9 * len(np.intersect1d(one, two, assume_unique=True)) >= 4 * (len(one) + len(two))


def class_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 4096):
        bits = np.unpackbits(found[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found)).view(np.uint64)[0])


def minima(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[at : at + 1024, None] * _TIMES + _PLUS).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _PLACES[0] + column)
    return keys


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, t, c, n, fp, keys, sketch)`` per row with an id: hash of its text, class, shingles, fingerprint, buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, n, fp, keys, sketch = [], [], [], [], []
            for text in batch.column(2):
                found = shingles((text.as_py() or "").encode("utf-8", "replace"))
                c.append(class_of(found))
                n.append(len(found))
                fp.append(fingerprint(found))
                least = minima(found)
                keys.append(band_keys(least) if len(found) else np.zeros(0, np.uint64))
                sketch.append(least.astype(np.uint8).tobytes())
            ends = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            columns = [
                *batch.columns[:2], pa.array(np.array(c, np.uint64).view(np.int64)), pa.array(np.array(n, np.int64)),
                pa.array(np.array(fp, np.uint64).view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64))),
                pa.array(sketch, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "t", "c", "n", "fp", "keys", "sketch"])
        release()

    source = _texts(docs, id_col, text_col).where("id is not null")
    return source.mapInArrow(run, "id long, t long, c long, n long, fp long, keys array<long>, sketch binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def class_texts(docs: DataFrame, id_col: str, text_col: str, marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(c, text)``: one text of each class in ``wanted``."""
    named = marked.select("id", "t", "c").join(wanted, "c", "left_semi")
    one = cut(named.groupBy("c").agg(F.min(F.struct("id", "t")).alias("one")).select("c", "one.id", "one.t"))
    rows = only_ids(_texts(docs, id_col, text_col).where("id is not null"), one)
    return rows.join(one, ["id", "t"]).dropDuplicates(["c"]).select("c", "text")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, hub, same)``: pairs near in size of which LIKELY minima or more agree."""

    def side(name: str) -> DataFrame:
        return classes.select(F.col("c").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in (2, 3))
            same = (one == two).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same)], ["a", "hub", "same"]).filter(pa.array(same >= LIKELY))

    both = pairs.join(side("a"), "a").join(side("hub"), "hub").where(5 * F.least("n_a", "n_hub") >= 4 * F.greatest("n_a", "n_hub"))
    return both.select("a", "hub", "s_a", "s_hub").mapInArrow(run, "a long, hub long, same long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, hub)`` whose Jaccard similarity is 0.8 or more.

    A hub's text is read once for each of its parts, and the others stream past it.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PART).alias("parts"))
    part = F.pmod(F.xxhash64("a", F.lit(SEED)), F.coalesce("parts", F.lit(1).cast("long")))
    asking = pairs.select("a", "hub").join(parts.where("parts > 1"), "hub", "left").select("hub", part.alias("part"), "a")
    asking = asking.join(texts.withColumnRenamed("c", "a"), "a").select("hub", "part", F.lit(1).alias("asks"), "a", "text")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    hubs = parts.select("hub", each.alias("part")).join(texts.withColumnRenamed("c", "hub"), "hub")
    hubs = hubs.select("hub", "part", F.lit(0).alias("asks"), F.col("hub").alias("a"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            hub, asks, a = (batch.column(c).to_pylist() for c in (0, 2, 3))
            for row, text in enumerate(batch.column(4)):
                other = shingles((text.as_py() or "").encode("utf-8", "replace"))
                if not asks[row]:
                    own = other
                    continue
                if alike(own, other):
                    found.append((a[row], hub[row]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "hub"])
        release()

    dealt = hubs.unionByName(asking).repartition("hub", "part").sortWithinPartitions("hub", "part", "asks")
    return dealt.mapInArrow(run, "a long, hub long")


def _rooted(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold classes of more than one component; ``names`` has the roots of linked classes."""
    named = rows.select("k", "band", "c", "met").join(names, "c", "left").withColumn("root", F.coalesce("root", "c"))
    still = named.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return cut(named.join(still.select("k"), "k", "left_semi").select("k", "band", "c", "met", "root"))


def _joined(names: DataFrame, links: DataFrame) -> DataFrame:
    """``(c, root)`` of all linked classes once ``links`` join components: only these are worked on, not those before."""
    side = names.withColumnRenamed("root", "of")
    moved = links.join(side.withColumnRenamed("c", "a"), "a", "left").withColumn("p", F.coalesce("of", "a")).drop("of")
    moved = moved.join(side.withColumnRenamed("c", "hub"), "hub", "left").withColumn("q", F.coalesce("of", "hub"))
    roots = connected_components(moved, "p", "q").withColumnRenamed("root", "top")
    known = names.join(roots.withColumnRenamed("node", "root"), "root", "left").select("c", F.coalesce("top", "root").alias("root"))
    fresh = roots.select(F.col("node").alias("c"), F.col("top").alias("root")).join(names, "c", "left_anti")
    return cut(known.unionByName(fresh))


def against_one(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, hub)``: each class of an open bucket with the likeliest of those chosen for its buckets.

    The class that meets most others is chosen, an original rather than one of its copies.
    """
    chosen = rows.groupBy("k").agg(F.max_by(F.struct("c", "root"), F.struct("met", "c")).alias("one"))
    found = rows.join(chosen, "k").where(F.col("root") != F.col("one.root"))
    pairs = likely(found.select(F.col("c").alias("a"), F.col("one.c").alias("hub")).distinct(), classes)
    return pairs.groupBy("a").agg(F.max_by("hub", F.struct("same", "hub")).alias("hub"))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, by products of their incidence matrix, some shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = times[place] > 1  # what one set alone has is shared by none
    owner, place = owner[twice], (np.cumsum(times > 1) - 1)[place[twice]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    found = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2**24
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, 1024):
        some = slice(*np.searchsorted(place, (at, at + 1024)))
        held = np.zeros((len(sets), 1024), np.float32)
        held[owner[some], place[some] - at] = 1
        found += held @ held.T
    return found


def _dealt(rows: DataFrame, blocks: DataFrame, *columns: str) -> DataFrame:
    """``(k, i, j, ...)``: each block of a bucket with each, for ``blocks`` with their number for each k."""
    own = rows.join(blocks, "k").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return own.withColumn("other", other).select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns)


def _likely_rows(n: np.ndarray, root: np.ndarray, sketch: np.ndarray, band: int) -> np.ndarray:
    """Which rows of a bucket have a likely partner in another component that they meet in no earlier bucket."""
    hit = np.zeros(len(n), bool)
    columns = np.ascontiguousarray(sketch.T)
    for at in range(0, len(n), 256):
        some = slice(at, at + 256)
        same = np.zeros((len(n[some]), len(n)), np.uint8)
        for byte in columns:
            same += byte[some, None] == byte
        least, most = np.minimum(n[some, None], n), np.maximum(n[some, None], n)
        a, b = np.nonzero((same >= LIKELY) & (root[some, None] != root) & (5 * least >= 4 * most))
        for part in range(0, len(a), 65_536):
            x, y = a[part : part + 65_536] + at, b[part : part + 65_536]
            earlier = (sketch[x, : band * ROWS] == sketch[y, : band * ROWS]).reshape(len(x), band, ROWS).all(axis=2).any(axis=1)
            hit[x[~earlier]] = True
    return hit


def with_partners(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows ``(k, c, root, n)`` of classes with a likely partner in another component."""
    blocks = rows.groupBy("k").agg(F.ceil(F.count("*") / SKETCHES).alias("blocks"))
    dealt = _dealt(rows.join(classes.select("c", "n", "sketch"), "c"), blocks, "c", "root", "n", "band", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            root, n, band = (group.column(x).to_numpy() for x in (4, 5, 6))
            if (root == root[0]).all():
                continue
            sketch = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            hit = pa.array(_likely_rows(n, root, sketch, int(band[0])))
            yield pa.RecordBatch.from_arrays([group.column(x) for x in (0, 3, 4, 5)], ["k", "c", "root", "n"]).filter(hit)
        release()

    dealt = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return dealt.mapInArrow(run, "k long, c long, root long, n long").distinct()


def across(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, hub)``: verified links that join what ``with_partners`` left in each bucket.

    Blocks of a bucket meet in tasks, which count what each two sets share and
    give a spanning forest of the links, never the pairs.
    """
    blocks = rows.groupBy("k").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / PART_SHINGLES), F.lit(1)).alias("blocks"))
    dealt = _dealt(rows, blocks, "c", "root").join(texts, "c").select("k", "i", "j", "c", "root", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            if found := linked(group):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "hub"])
        release()

    def linked(group: pa.RecordBatch) -> list[tuple[int, int]]:
        c, root = (group.column(x).to_numpy() for x in (3, 4))
        _, label = np.unique(root, return_inverse=True)
        if not label.any():
            return []
        sets = [shingles((text.as_py() or "").encode("utf-8", "replace")) for text in group.column(5)]
        size = np.array(list(map(len, sets)), np.float32)
        shared = _shared(sets)
        first = np.unique(label, return_index=True)[1][label]  # one row for each component, joined by the links
        joined = first.copy()
        for at in range(0, len(sets), 128):  # pairs that are joined already need not be held
            some = slice(at, at + 128)
            a, b = np.nonzero((9 * shared[some] >= 4 * (size[some, None] + size)) & (joined[some, None] != joined))
            joined = merge(joined, a + at, b)
        moved = np.flatnonzero(joined != first)
        return list(zip(c[moved].tolist(), c[joined[moved]].tolist(), strict=True))

    dealt = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return dealt.mapInArrow(run, "a long, hub long")


def within_bits(classes: DataFrame, trees: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(a, hub)``: classes whose fingerprints are equal, or linked by the trees."""
    prints = classes.where("n > 0").groupBy("fp").agg(F.min("c").alias("hub"))
    equal = classes.where("n > 0").select("fp", F.col("c").alias("a")).join(prints, "fp").where("a <> hub").select("a", "hub")
    near = trees(prints.select("fp"))
    linked = (
        near.join(prints.select(F.col("fp").alias("a"), F.col("hub").alias("c")), "a")
        .join(prints.select(F.col("fp").alias("b"), "hub"), "b").select(F.col("c").alias("a"), "hub").where("a <> hub")
    )
    return equal.unionByName(linked).distinct()


def near_duplicates(docs: DataFrame, trees: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, t, c, root, component)`` per row with an id: hash of its text, class, a class of its group, least id of the group.

    ``trees`` gives links ``(a, b)`` between near fingerprints, for a frame of
    distinct ones in column fp.  Groups that hold one id may share a component;
    their roots differ.
    """
    marked = stored(signatures(docs, id_col, text_col), "signatures")
    firsts = [F.first(x).alias(x) for x in ("n", "fp", "keys", "sketch")]  # equal in a class
    classes = stored(marked.groupBy("c").agg(F.min("id").alias("first"), *firsts), "classes")
    dealt = classes.select("c", F.posexplode("keys").alias("band", "k"))
    shared = dealt.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).where("low < high")
    rows = cut(dealt.join(shared.select("k", "m"), "k").select("k", "band", "c", "m"))
    met = rows.groupBy("c").agg(F.sum("m").alias("met"))
    rows = rows.join(met, "c").select("k", "band", "c", "met")
    seeds = cut(within_bits(classes, trees))
    wanted = rows.select("c").unionByName(seeds.select(F.col("a").alias("c"))).unionByName(seeds.select(F.col("hub").alias("c")))
    texts = stored(class_texts(docs, id_col, text_col, marked, wanted.distinct()), "texts")
    names = connected_components(verified(likely(seeds, classes), texts), "a", "hub").withColumnRenamed("node", "c")
    rows = _rooted(rows, names)
    names = _joined(names, verified(cut(against_one(rows, classes)), texts))
    names = _joined(names, across(cut(with_partners(_rooted(rows, names), classes)), texts))
    joined = classes.select("c", "first").join(names, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = cut(joined.join(least, "root").select("c", "root", "component"))
    return marked.select("id", "t", "c").join(named, "c").select("id", "t", "c", "root", "component")
