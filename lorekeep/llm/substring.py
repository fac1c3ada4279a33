"""Removal of long repeated passages, found through difference-cover anchors.

A window is ``window`` consecutive words.  With a difference cover D modulo v,
any two positions i and j have a shift below v after which both stand at cover
positions, so two equal windows of at least v + w - 1 words share an anchor: a
w-word stretch that begins at a cover position in both documents.  Only these
anchors, |D| of every v positions, are hashed and shuffled.

1. Anchors that lie in more than one document mark the only places where equal
   windows can be.  2. There, and nowhere else, every window is hashed (the
   anchor extended to each window around it), and the least document id of
   each hash is taken.  3. Windows whose least id is below their own document's
   cover words, and those words go.

Whole copies are set apart first: all of a copy's words go, and its windows
add nothing that the original has not.  Nothing is gathered by hash: counts and
least ids are aggregates, joined back.  The windows of passages that very many
documents share are not even shuffled by hash: their anchors' counts tell them,
and their bounds, aggregated in each task first, are joined back to where they
are.

Defined results: a very long text is hashed whole, each word once; null texts have no words; documents of fewer words than a
window lose nothing; rows without an id lose nothing and take nothing from
others; rows that repeat an id are judged each on its own text, and equal ids
are not smaller; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, only_ids

WINDOW = 50
#: A perfect difference set modulo 31 (every remainder is a difference of two members).
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Words whose hashes a Python worker remembers.
CACHE_WORDS = 400_000
#: Anchors with more rows than HOT_ROWS, and more than all but HOT_HASHES can have, mark hot passages.
HOT_ROWS = 1_024
HOT_HASHES = 100_000
#: Parts into which a hot hash is dealt where it has to be shuffled.
SALTS = 64
#: Rows that leave a task at once.
ROWS = 200_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2**64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_WORDS = _WordHashes()


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 4096, 2 * len(held[0]) if held else 0)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        held = _POWERS[base] = (out[0], out[1])
    return held[0][:n], held[1][:n]


def window_hashes(words: list[bytes], size: int, at: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the ``size``-word windows at the given positions."""
    n = len(words)
    own = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    power, inverse = _powers(_BASES[which], n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(own * power[:n], out=sums[1:])
    found = (sums[at + size] - sums[at]) * inverse[at]
    return found ^ (found >> np.uint64(32))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def cover_positions(n: int, width: int) -> np.ndarray:
    """Cover positions at which a document of n words has an anchor."""
    at = np.arange(max(0, n - width + 1))
    return at[np.isin(at % PERIOD, COVER)]


def candidate_starts(anchors: np.ndarray, n: int, window: int, width: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors, ascending."""
    mark = np.zeros(n + 2, np.int64)
    np.add.at(mark, np.maximum(anchors + width - window, 0), 1)
    np.add.at(mark, anchors + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: max(0, n - window + 1)] > 0)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _sequence(words: list[bytes]) -> tuple[int, int, bytes]:
    joined = b" ".join(words)
    digest = xxhash.xxh3_128_intdigest(joined)
    return (digest >> 64) - (1 << 63), (digest & (2**64 - 1)) - (1 << 63), joined


def summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, seq_a, seq_b, whole)`` per row: word count, 128-bit hash and digest of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = _words(text.as_py())
                a, b, joined = _sequence(words)
                rows.append((len(words), a, b, hashlib.sha256(joined).hexdigest()))
            n, a, b, whole = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(whole, pa.string())],
                ["id", "n_words", "seq_a", "seq_b", "whole"],
            )

    return _source(docs, id_col, text_col).mapInArrow(run, "id long, n_words long, seq_a long, seq_b long, whole string")


class _Rows:
    """Gathers (h[, g], id, at) rows and lets them go in batches."""

    def __init__(self) -> None:
        self._held: list[tuple[np.ndarray, ...]] = []
        self._n = 0

    def add(self, doc: int, at: np.ndarray, *hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._held.append((*hashes, np.full(len(at), doc, np.int64), at.astype(np.int32)))
        self._n += len(at)
        if self._n > ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self._n:
            h, *others = (np.concatenate(c) for c in zip(*self._held, strict=True))
            names = ["h", "g", "id", "at"] if len(others) == 3 else ["h", "id", "at"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h.view(np.int64), *others)], names)
        self._held, self._n = [], 0


def anchors(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(h, id, at)``: the anchors of every document long enough for a window."""
    width = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(text.as_py())
                if doc is not None and len(words) >= window:
                    at = cover_positions(len(words), width)
                    yield from out.add(doc, at, window_hashes(words, width, at))
        yield from out.rest()

    return _source(docs, id_col, text_col).mapInArrow(run, "h long not null, id long not null, at int not null")


def _with_bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the least id and the number of rows of their key, keys in one document left out; one shuffle by the key.

    Both sides of the join read the same shuffle.  The place, which is never
    negative, is in the condition so that both read the same columns of it.
    """
    dealt = rows.repartition(*keys)
    bounds = dealt.groupBy(*keys).agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.max("at").alias("far"), F.count("*").alias("rows")
    )
    return dealt.join(bounds.where("least <> most and far >= 0"), keys)


def _with_hot_bounds(rows: DataFrame) -> DataFrame:
    """Like ``_with_bounds`` for windows of few hashes with many rows each, which are not brought together.

    The bounds of each task's rows are taken first.  They are joined back as a
    whole where they are few, and otherwise copied to each of SALTS parts of a hash.
    """
    bounds = cut(rows.groupBy("h", "g").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most"))
    if bounds.limit(HOT_HASHES + 1).count() <= HOT_HASHES:
        return rows.join(F.broadcast(bounds), ["h", "g"])
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int"))
    return salted.join(bounds.withColumn("salt", each), ["h", "g", "salt"]).drop("salt")


def _by_document(rows: DataFrame, heavy: int) -> DataFrame:
    """``(id, places, hot)``: positions by document, no longer than it, and hashes with more than ``heavy`` rows among them."""
    hot = F.collect_set(F.when(F.col("rows") > heavy, F.col("h")))
    return rows.groupBy("id").agg(F.collect_set("at").alias("places"), hot.alias("hot"))


def windows(texts: DataFrame, window: int, hot: np.ndarray, want_hot: bool) -> DataFrame:
    """``(h, g, id, at)`` of every window that holds one of the row's anchors; (h, g) has 96 bits.

    Windows are hot that begin with a stretch whose hash is in ``hot``, in
    every document alike; only these, or only the others, are given.
    """
    width = window - PERIOD + 1
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for batch in batches:
            for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = _words(text.as_py())
                marks = np.array(places.as_py(), np.int64)
                at = candidate_starts(marks[marks + width <= len(words)], len(words), window, width)
                if len(at) and len(shared.value):
                    at = at[np.isin(window_hashes(words, width, at).view(np.int64), shared.value) == want_hot]
                if len(at):
                    h, g = (window_hashes(words, window, at, which) for which in (0, 1))
                    yield from out.add(doc, at, h, (g & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
        yield from out.rest()

    return texts.select("id", "text", "places").mapInArrow(run, "h long not null, g int not null, id long not null, at int not null")


def remaining(texts: DataFrame, window: int) -> DataFrame:
    """``(id, seq_a, seq_b, n_removed, kept)`` for texts with the hashes of their repeated windows by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = _words(text.as_py())
                a, b, _ = _sequence(words)
                said = sorted((x["at"], x["h"]) for x in found.as_py())
                at = np.array([p for p, _ in said], np.int64)
                own = np.array([h for _, h in said], np.int64)
                fits = at + window <= len(words)
                at, own = at[fits], own[fits]
                at = at[window_hashes(words, window, at).view(np.int64) == own]  # of this row's text, where an id repeats
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                gone = np.cumsum(mark)[: len(words)] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((doc, a, b, int(gone.sum()), kept))
            ids, a, b, n, kept = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (ids, a, b, n)), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "seq_a", "seq_b", "n_removed", "kept"],
            )

    return texts.select("id", "text", "repeated").mapInArrow(
        run, "id long, seq_a long, seq_b long, n_removed long, kept string"
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(summaries with copies marked, texts that changed): the parts of the result.

    The first has ``(id, n_words, seq_a, seq_b, whole, copied)`` per row, where
    copied rows lose all words; the second ``(id, seq_a, seq_b, n_removed,
    kept)`` for documents that are no copies and lose some words.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window has more than {PERIOD} words")
    seen = cut(summaries(docs, id_col, text_col))
    first = seen.where("id is not null").groupBy("seq_a", "seq_b").agg(F.min("id").alias("first"))
    marked = cut(
        seen.join(first, ["seq_a", "seq_b"], "left").select(
            *seen.columns, F.coalesce((F.col("n_words") >= window) & (F.col("id") > F.col("first")), F.lit(False)).alias("copied")
        )
    )
    # An id may repeat; it is left out only if all its rows are copies.
    copies = marked.groupBy("id").agg(F.min("copied").alias("copied")).where("copied").select("id")
    shared = _with_bounds(anchors(docs, id_col, text_col, window), ["h"]).select("h", "id", "at", "rows")
    # Fewer than HOT_HASHES hashes can have more rows than this.
    words = seen.where(F.col("n_words") >= window).agg(F.sum("n_words").alias("n")).first()["n"] or 0
    heavy = max(HOT_ROWS, words * len(COVER) // PERIOD // HOT_HASHES)
    # An anti join here would be pushed below the join by hash, and shuffle all anchors once more.
    held = _by_document(shared, heavy).join(copies.withColumn("copied", F.lit(True)), "id", "left")
    places = cut(held.where("copied is null").select("id", "places", "hot"))
    hot = places.select(F.explode("hot").alias("h")).distinct().toPandas()["h"].to_numpy(np.int64)
    texts = _source(docs, id_col, text_col)
    found = only_ids(texts, places).join(places, "id")
    every = _with_bounds(windows(found, window, hot, False), ["h", "g"]).where("id > least").select("id", "at", "h")
    if len(hot):
        every = every.unionByName(_with_hot_bounds(windows(found, window, hot, True)).where("id > least").select("id", "at", "h"))
    repeated = cut(every.groupBy("id").agg(F.collect_set(F.struct("at", "h")).alias("repeated")))
    return marked, remaining(only_ids(texts, repeated).join(repeated, "id"), window)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` per row."""
    marked, changed = remove_repeats(docs, id_col, text_col, window)
    changed = changed.select(
        "id", "seq_a", "seq_b", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept")
    ).dropDuplicates(["id", "seq_a", "seq_b"])
    removed = F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    nothing = hashlib.sha256(b"").hexdigest()
    return marked.join(changed, ["id", "seq_a", "seq_b"], "left").select(
        "id",
        "n_words",
        removed.alias("n_removed"),
        F.when(F.col("copied"), F.lit(nothing)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )
