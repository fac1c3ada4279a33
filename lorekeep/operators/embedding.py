"""Embedding: who does it, in which batches, and what the cache spares."""

from __future__ import annotations

import hashlib
import re
import time
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import STOP_WORDS
from ..functions.text import estimate_tokens
from ..functions.vectors import unit
from ..sources.shared import only_matching
from . import batches

BATCH_TEXTS, BATCH_TOKENS, WINDOW_SECONDS = 100, 12_000, 60
#: Words whose dimension a task remembers: some 10 MB, however many words its texts have.
WORDS_KNOWN = 65_536
#: Characters of a text that come to Python at once, but for the rest of a word.
PIECE_CHARS = 1_000
_WORD = re.compile("[a-z0-9]+")


def bucket(word: Column, dimensions: int) -> Column:
    """The dimension of a word: the first four bytes of its digest, modulo."""
    return (F.conv(F.substring(F.sha2(word, 256), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def keyword_counts(texts: DataFrame, id_col: str, text_col: str, dimensions: int = 256) -> DataFrame:
    """``(id, dimension, weight)``: how many words of a text fall to each dimension."""
    words = F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z0-9]+"), F.lit(0)))
    each = texts.select(F.col(id_col).alias("id"), words.alias("word")).where(~F.col("word").isin(*STOP_WORDS))
    return each.groupBy("id", bucket(F.col("word"), dimensions).alias("dimension")).agg(F.count("*").alias("weight"))


def keyword_vectors(texts: DataFrame, id_col: str, text_col: str, dimensions: int = 256, carry: Sequence[str] = ()) -> DataFrame:
    """``(id, embedding)`` of each row: keyword counts as a unit vector; a text without words gives a zero vector.

    Columns named in ``carry`` come along, so that no join has to bring them back.

    Words are counted where their text lies, so nothing is shuffled.  Texts come
    to Python as pieces in order, each ending where a word may end, so a batch
    has a few MB however long texts are; a word's digest is remembered in a table
    of at most ``WORDS_KNOWN`` words, begun anew when full.
    """
    stop = frozenset(STOP_WORDS)
    kept = ["id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        counts: list[int] | None = None  # of the text that is being read
        owner: pa.RecordBatch | None = None

        def count(piece: str) -> None:
            for word, n in Counter(_WORD.findall(piece)).items():
                if word in stop:
                    continue
                place = known.get(word)
                if place is None:
                    place = int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "big") % dimensions
                    if len(word) <= 64:
                        if len(known) >= WORDS_KNOWN:
                            known.clear()
                        known[word] = place
                counts[place] += n

        def made(owners: pa.RecordBatch, rows: list[list[int]]) -> pa.RecordBatch:
            dense = np.array(rows, np.float64)
            size = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
            dense = np.divide(dense, size, out=dense, where=size > 0)
            ends = pa.array(np.arange(0, dense.size + 1, dimensions, dtype=np.int32))
            vectors = pa.ListArray.from_arrays(ends, pa.array(dense.ravel()))
            return pa.RecordBatch.from_arrays([*owners.columns, vectors], [*kept, "embedding"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                begins = part.column(part.num_columns - 2).to_pylist()
                done: list[list[int]] = []
                for begin, piece in zip(begins, part.column(part.num_columns - 1), strict=True):
                    if begin:
                        if counts is not None:
                            done.append(counts)
                        counts = [0] * dimensions
                    count(piece.as_py() or "")
                # Copies, as a slice would keep the whole batch.
                owners = part.select(kept).take(pa.array(np.flatnonzero(begins)))
                if owner is not None:
                    owners = pa.Table.from_batches([owner, owners]).combine_chunks().to_batches()[0]
                if done:
                    yield made(owners.slice(0, len(done)), done)
                owner = owners.slice(len(done))
        if counts is not None:
            yield made(owner, [counts])

    pieces = F.regexp_extract_all(F.lower(text_col), F.lit(rf"(?s).{{1,{PIECE_CHARS}}}[a-z0-9]*"), F.lit(0))
    source = texts.select(F.col(id_col).alias("id"), *carry, F.posexplode_outer(pieces).alias("_n", "_piece"))
    source = source.select(*kept, (F.coalesce("_n", F.lit(0)) == 0).alias("_begin"), "_piece")
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-2], T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


class Embedder(ABC):
    """Turns texts into vectors of one space, named by ``namespace``."""

    namespace: str

    @abstractmethod
    def documents(self, texts: DataFrame) -> DataFrame:
        """``(key, vector)`` for ``(key, embed_text)``."""

    def save_documents(self, texts: DataFrame, save: Callable[[DataFrame], None]) -> None:
        """Give the vectors of ``texts`` to ``save``."""
        save(self.documents(texts))

    @abstractmethod
    def query(self, text: str) -> list[float]: ...


class KeywordEmbedder(Embedder):
    """Bags of words in a fixed number of dimensions; offline."""

    def __init__(self, spark, dimensions: int = 256):
        self._spark, self.dimensions = spark, dimensions
        self.namespace = f"keyword|{dimensions}"

    def documents(self, texts: DataFrame) -> DataFrame:
        found = keyword_vectors(texts, "key", "embed_text", self.dimensions)
        return found.select(F.col("id").alias("key"), F.col("embedding").alias("vector"))

    def query(self, text: str) -> list[float]:
        one = self._spark.createDataFrame([("q", text)], "key string, embed_text string")
        return list(self.documents(one).first()["vector"])


class DailyQuotaExceeded(RuntimeError):
    """No more today; waiting does not help."""


class RateLimited(RuntimeError):
    """Too fast; ``seconds`` is the wait that the server asked for, None where it gave none."""

    def __init__(self, said: str, seconds: float | None = None):
        super().__init__(said)
        self.seconds = seconds


#: How a service names the parts of a refusal, and the window where it names no wait.
QUOTA_TYPE, RETRY_TYPE, DAY = "QuotaFailure", "RetryInfo", "PerDay"
TOO_MANY = 429


def refusal(code: int, body: dict | None, window: float = WINDOW_SECONDS) -> Exception | None:
    """What to raise for a refused request with this body, None if it was not refused for its rate.

    A quota of the day cannot be waited out, whatever wait is named beside it.
    A refusal that explains nothing has no wait either; all others have one.
    """
    if code != TOO_MANY:
        return None
    error = (body or {}).get("error", body or {})
    parts = [d for d in error.get("details") or () if isinstance(d, dict)] if isinstance(error, dict) else []
    quota, retry = ([d for d in parts if str(d.get("@type", "")).endswith(kind)] for kind in (QUOTA_TYPE, RETRY_TYPE))
    for broken in (v for d in quota for v in d.get("violations") or () if isinstance(v, dict)):
        if DAY in str(broken.get("quotaId", "")):
            return DailyQuotaExceeded(f"the quota of the day is used up: {broken.get('quotaValue') or 'its size was not said'}")
    if not quota and not retry:
        return RateLimited("refused without a reason")
    named = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)s?", str(retry[0].get("retryDelay", "")).strip()) if retry else None
    return RateLimited("too many requests", float(named[1]) if named else window)


class RemoteEmbedder(Embedder):
    """An outside service behind a global rate limit: batches go one after the other.

    ``call`` takes texts and whether they are queries, and returns a vector for
    each.  ``save``, and that of ``save_documents``, gets each batch's rows as
    they come, so a run that breaks off keeps what it has paid for.
    """

    def __init__(
        self, spark, namespace: str, call: Callable[[Sequence[str], bool], list[list[float]]], attempts: int = 4,
        window: float = WINDOW_SECONDS, sleep: Callable[[float], None] = time.sleep,
        save: Callable[[DataFrame], None] = lambda rows: None,
    ):
        self._spark, self.namespace, self._call = spark, namespace, call
        self._attempts, self._window, self._sleep, self._save = attempts, window, sleep, save

    def _once(self, texts: Sequence[str], query: bool) -> list[list[float]]:
        for attempt in range(1, self._attempts + 1):
            try:
                found = self._call(texts, query)
            except DailyQuotaExceeded:
                raise
            except RateLimited as limit:
                if limit.seconds is None or attempt == self._attempts:
                    raise
                self._sleep(limit.seconds + 1)
                continue
            except (ConnectionError, TimeoutError):
                if attempt == self._attempts:
                    raise
                self._sleep(2 ** (attempt - 1))
                continue
            if len(found) != len(texts):
                raise RuntimeError(f"{len(found)} vectors came back for {len(texts)} texts")
            return found
        raise AssertionError

    def _batches(self, texts: DataFrame) -> Iterator[DataFrame]:
        """Rows of each batch once the service has answered.

        Keys and token counts alone are planned; texts come to the driver in the
        order of their batches, from one sort, a batch at a time.  A run that
        starts again plans what the cache still lacks, so it goes on where the
        last one stopped.
        """
        planned = plan_batches(texts.select("key", estimate_tokens("embed_text").alias("tokens")), [], ["key"])
        rows = texts.select("key", "embed_text").join(planned.select("key", "batch"), "key").orderBy("batch", "key")
        for number, group in groupby(rows.toLocalIterator(), key=lambda r: r["batch"]):
            batch = list(group)
            if number > 1:
                self._sleep(self._window)
            vectors = self._once([r["embed_text"] for r in batch], False)
            answers = [(r["key"], [float(x) for x in v]) for r, v in zip(batch, vectors, strict=True)]
            found = self._spark.createDataFrame(answers, "key string, vector array<double>").select("key", unit(F.col("vector")).alias("vector"))
            self._save(found)
            yield found

    def documents(self, texts: DataFrame) -> DataFrame:
        """All vectors at once, for a few texts such as questions; ``save_documents`` holds a batch at a time."""
        none = self._spark.createDataFrame([], "key string, vector array<double>")
        return reduce(DataFrame.unionByName, self._batches(texts), none)

    def save_documents(self, texts: DataFrame, save: Callable[[DataFrame], None]) -> None:
        for rows in self._batches(texts):
            save(rows)

    def query(self, text: str) -> list[float]:
        raw = self._once([text], True)[0]
        size = sum(x * x for x in raw) ** 0.5
        return [x / size for x in raw] if size else list(raw)


def plan_batches(
    texts: DataFrame, group: Sequence[str], order: Sequence[str], most_texts: int = BATCH_TEXTS,
    most_tokens: int | None = BATCH_TOKENS,
) -> DataFrame:
    """``texts`` with ``batch``, from 1 in each group: in order, as many as both limits allow.

    A text over the token limit goes alone.
    """
    return batches.plan_batches(texts, group, order, most_texts, most_tokens)


def pacing_seconds(batches: Column, window: int = WINDOW_SECONDS) -> Column:
    """How long a paced run waits: a window between batches."""
    return F.greatest(batches - 1, F.lit(0)) * window


def with_cache(chunks: DataFrame, cache: DataFrame, namespace: str) -> DataFrame:
    """Chunks with their cache ``key`` and the cached ``vector``, null where there is none.

    Keys meet first, as bits of a bitmap where the cache lies; only vectors of
    keys that may be asked for are moved.
    """
    keyed = chunks.withColumn("key", F.concat_ws("|", F.lit(namespace), "content_hash"))
    return keyed.join(latest(only_matching(cache, keyed.select("key"), "key")), "key", "left")


def latest(cache: DataFrame) -> DataFrame:
    """``(key, vector)`` once for each key of an appended cache: the one written last, where it tells when."""
    when = "written" if "written" in cache.columns else F.lit(0)
    return cache.groupBy("key").agg(F.max_by("vector", when).alias("vector"))


def embedding_plan(looked_up: DataFrame) -> DataFrame:
    """One row: chunks whose vector is saved, and distinct texts that must be embedded."""
    missing = F.when(F.col("vector").isNull(), F.col("key"))
    return looked_up.agg(
        F.count_if(F.col("vector").isNotNull()).alias("reused"), F.count_distinct(missing).alias("to_embed")
    )


def pending(looked_up: DataFrame, order: Sequence[str]) -> DataFrame:
    """``(key, embed_text)`` once for each missing text, with the place where it was first seen."""
    place = F.struct(*order)
    return looked_up.where("vector is null").groupBy("key").agg(
        F.min_by("embed_text", place).alias("embed_text"), F.min(place).alias("first_seen")
    )

