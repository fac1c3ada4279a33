"""SimHash near-duplicates, linked exactly through distributed vantage-point trees.

The 64 fingerprint bits are cut into bands.  Two fingerprints that differ in at
most ``max_bits`` bits differ in at most ``max_bits // bands`` bits of some
band, and the Hamming distance inside a band is a metric, so each band gets a
vantage-point tree of its own with that small search radius: a ball of radius 1
in 32 bits crosses far fewer tree boundaries than one of radius 3 in 64.

Where a band parts badly, as among fingerprints that share it, a node takes the
distance over all 64 bits with the full radius instead.

The tree is grown on a bounded sample (it only decides where rows go; results
do not depend on it), until a leaf should hold LEAF_ROWS.  Every fingerprint is
sent to its home leaf, and as a query to each leaf its ball overlaps by the
triangle inequality.  A leaf that the bounded sample leaves fuller is parted
again in its task, by a tree of its own rows.  Leaves verify all 64 bits and
return a spanning forest of their links, never the pairs.

Defined results: a null or wordless text has fingerprint zero and links like
any other; repeated rows each get a row; a null id is allowed, gets its group's
component, and never becomes one (null where no id is reachable).  A very long
text is hashed whole, 4,096 shingles at a time.  Columns other than the two
named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import minhash
from .cluster import cut
from .components import connected_components, merge

SEED = 42
SHINGLE = 3
#: At most so many fingerprints are sampled to grow the trees.
SAMPLE_BOUND = 131_072
#: Fingerprints that a leaf should hold.
LEAF_ROWS = 2_048
#: Fingerprints that a task routes through the trees at once.
ROUTE_ROWS = 262_144
EVERY_BIT = np.uint64(2**64 - 1)


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text as an unsigned integer."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -SHINGLE].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)],
        dtype="<u8",
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            found = np.fromiter((fingerprint(t or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, fp long")


# --- the trees -------------------------------------------------------------


@dataclass
class Node:
    """A vantage point that parts what is within ``mu`` of it, over the bits of ``mask``, from the rest.

    Two fingerprints that are to meet differ by at most ``radius`` in these bits.
    """

    vantage: np.uint64
    mask: np.uint64
    radius: int
    mu: int
    inner: Node | int
    outer: Node | int


def band_masks(bands: int) -> list[np.uint64]:
    width = 64 // bands
    return [np.uint64(((1 << width) - 1) << (width * b)) for b in range(bands)]


def grow(sample: np.ndarray, measures: list[tuple[np.uint64, int]], weight: float, leaf_rows: int = LEAF_ROWS) -> tuple[Node | int, int]:
    """(tree, number of leaves) over a sample, each member of which stands for ``weight`` rows; leaves are numbers.

    ``measures`` are (mask, radius) pairs: a pair that is to be found is near
    in all of them, and each node takes that in which it parts best.
    """
    count = 0

    def node(values: np.ndarray) -> Node | int:
        nonlocal count
        if len(values) * weight > leaf_rows and len(values) >= 4:
            best = None
            for vantage in values[:: max(1, len(values) // 5)][:5]:
                for mask, radius in measures:
                    far = np.bitwise_count((values ^ vantage) & mask)
                    mu = int(np.median(far))
                    inner = int((far <= mu).sum())
                    if inner == len(values):
                        mu -= 1
                        inner = int((far <= mu).sum())
                    if 0 < inner < len(values):
                        crossing = int(((far > mu - radius) & (far <= mu + radius)).sum())
                        badness = abs(2 * inner - len(values)) + crossing
                        if 4 * crossing < 3 * len(values) and (best is None or badness < best[0]):
                            best = (badness, vantage, mask, radius, mu, far <= mu)
            if best is not None:
                _, vantage, mask, radius, mu, near = best
                return Node(vantage, mask, radius, mu, node(values[near]), node(values[~near]))
        count += 1
        return count - 1

    return node(sample), count


def route(tree: Node | int, values: np.ndarray, asking: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, home rows, query rows) for each leaf that any value reaches.

    A home row on the inner side within the radius of the boundary goes on as a
    query outside; outer rows need not, as the pair is met from the other end.
    A query follows every side that its ball can overlap.  ``asking`` are rows
    of ``values`` that only ask; all others live in the tree.
    """
    start = np.arange(0) if asking is None else asking
    todo = [(tree, np.setdiff1d(np.arange(len(values)), start, assume_unique=True), start)]
    while todo:
        at, home, query = todo.pop()
        if not isinstance(at, Node):
            yield at, home, query
            continue
        far = np.bitwise_count((values[home] ^ at.vantage) & at.mask).astype(np.int16)
        ask = np.bitwise_count((values[query] ^ at.vantage) & at.mask).astype(np.int16)
        crossing = home[(far <= at.mu) & (far + at.radius > at.mu)]
        for side, h, q in (
            (at.inner, home[far <= at.mu], query[ask - at.radius <= at.mu]),
            (at.outer, home[far > at.mu], np.concatenate([query[ask + at.radius > at.mu], crossing])),
        ):
            if len(h) or len(q):
                todo.append((side, h, q))


def _compared(home: np.ndarray, query: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a small leaf, all of its pairs compared."""
    both = np.concatenate([home, query])
    label = np.arange(len(both))
    for r in range(0, len(both), 512):
        rows = both[r : r + 512]
        for c in range(0, len(home), 4096):
            if r + 512 <= len(home) and c >= r + 512:
                break  # home against home: the lower triangle is enough
            close = np.bitwise_count(rows[:, None] ^ home[None, c : c + 4096]) <= max_bits
            a, b = np.nonzero(close)
            a, b = a + r, b + c
            keep = a != b
            if keep.any():
                label = merge(label, a[keep], b[keep])
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def leaf_links(home: np.ndarray, query: np.ndarray, max_bits: int, measures: list[tuple[np.uint64, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what is within ``max_bits`` among home rows, and between these and queries.

    A full leaf is parted by a tree of its own, so the work grows with its rows
    and not with their square.
    """
    if len(home) <= 2 * LEAF_ROWS:
        return _compared(home, query, max_bits)
    both = np.concatenate([home, query])
    tree, _ = grow(home, measures, 1.0)
    found = [
        _compared(both[h], both[q], max_bits)
        for _, h, q in route(tree, both, np.arange(len(home), len(both)))
        if len(h) and len(h) + len(q) > 1
    ]
    return tuple(np.concatenate(side) for side in zip(*found, strict=True)) if found else (home[:0], home[:0])


def links(distinct: DataFrame, max_bits: int = 3, bands: int = 2) -> DataFrame:
    """``(a, b)``: links between the distinct fingerprints in column fp that join what is within max_bits."""
    spark = distinct.sparkSession
    total = distinct.count()
    # At most an eighth of the rows, so that the driver never holds the table; the trees only decide where rows go.
    size = min(SAMPLE_BOUND, max(LEAF_ROWS, total // 8))
    taken = distinct.orderBy(F.xxhash64("fp"), "fp").limit(size).toPandas()["fp"].to_numpy()
    sample = taken.astype(np.int64).view(np.uint64)
    measures = [[(mask, max_bits // bands), (EVERY_BIT, max_bits)] for mask in band_masks(bands)]
    grown = [grow(sample, m, max(1.0, total / max(1, len(sample)))) for m in measures]
    first = np.cumsum([0, *(leaves for _, leaves in grown)])
    shared = spark.sparkContext.broadcast([tree for tree, _ in grown])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for fp in _gathered(batches):
            for band, tree in enumerate(trees):
                shard, rows, is_home = [], [], []
                for leaf, home, query in route(tree, fp):
                    for part, flag in ((home, True), (query, False)):
                        if len(part):
                            shard.append(np.full(len(part), first[band] + leaf))
                            rows.append(part)
                            is_home.append(np.full(len(part), flag))
                columns = (np.concatenate(shard), fp[np.concatenate(rows)].view(np.int64), np.concatenate(is_home))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "fp", "home"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, home = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
        own = measures[int(np.searchsorted(first, pdf["shard"].iloc[0], side="right")) - 1]
        a, b = leaf_links(fp[home], fp[~home], max_bits, own)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints of several batches at once: routing visits every node, whatever the number of rows."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        if sum(map(len, held)) >= ROUTE_ROWS:
            yield np.concatenate(held)
            held = []
    if sum(map(len, held)):
        yield np.concatenate(held)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """``(id, fp, component)`` per row: the least id reachable over links of at most max_bits bits."""
    marked = cut(fingerprints(docs, id_col, text_col))
    groups = cut(marked.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(links(groups.select("fp"), max_bits), "a", "b")
    joined = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = cut(joined.join(least, "root").select("fp", "component"))
    return marked.join(named, "fp").select("id", "fp", "component")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one per near-duplicate group: that with the least id.

    Near are texts whose five-word shingles have a Jaccard similarity of 0.8 or
    more.  The trees find candidates within three bits of five-word
    fingerprints, ``minhash`` those further apart, and each is verified on the
    shingle sets; the three bits alone are op1's rule.

    A row is judged by its own text, so rows that repeat an id with texts of
    different groups are kept or not each on its own; of rows that repeat an id
    within a group the one with the least hash of its text stays, and of equal
    texts the one with the least hash of all columns.  Rows without an id
    cannot be told apart and all stay, and take the place of none.
    """
    found = minhash.near_duplicates(docs, links, id_col, text_col)
    kept = found.where("id = component").groupBy("id", "root").agg(F.min("t").alias("t"))
    free = "k" * (1 + max(map(len, docs.columns)))  # no column has names as long
    own, text, place = f"{free}i", f"{free}t", f"{free}p"
    named = docs.withColumns({own: F.col(id_col).cast("long"), text: F.xxhash64(F.col(text_col).cast("string"))}).where(F.col(own).isNotNull())
    chosen = named.join(kept.select(F.col("id").alias(own), F.col("t").alias(text)), [own, text], "left_semi")
    order = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    first = chosen.withColumn(place, F.row_number().over(Window.partitionBy(own, text).orderBy(order))).where(F.col(place) == 1)
    return first.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where(F.col(id_col).cast("long").isNull()))
