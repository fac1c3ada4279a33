"""A mix of sources by target weights, fitted to its budget by subset sums over document lengths.

Sources, in code point order and null last, have weights that repeat; together
they share a part of all words.  A target stops at ``most`` times its source's
words, and the excess is shared again by weight until none is above.

A source's target is met by whole documents: all of them as often as the target
holds the source, and once more a part of them.  How many of each length is
decided on counts by exact length alone: first every length gives its share,
rounded down, then lengths give one more by what rounding took from them, and
the last words are fitted by a bounded knapsack: which sums the documents left
can reach, by dynamic programming over words, and how.  Its table is a few
times as long as the longest document, whatever the number of documents; a task
holds a source's distinct lengths, never its documents.

Which documents of a length are taken is decided by a seeded hash of id, source
and text.  A length of which very many documents exist is cut at a hash value
found from counts by hash bits, 4,096 buckets at a time, so no task ranks it.

Defined results: null texts, and texts without words, have size 0 and add
nothing; a null source is a source; a null id is allowed; rows that repeat id,
source and text are rows of their own, of which as many as needed are taken;
ties of hashes between them are settled by their place, which changes no row of
the result; a very long text is counted whole; an empty table gives an empty
result; other columns are ignored by ``shares`` and kept by ``mixed``, whatever
their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import numbered, stored

SEED = 42
WEIGHTS = (5, 2, 1)
#: No document is taken more often, and no target is above so many times its source's words.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of hash values, as a power of two, by which a length is cut.
BITS = 12
#: Times the longest document that is left for the knapsack to fit.
RESERVE = 2
#: Words that the knapsack is given at most where it has to be tried again, over more than the remainder.
LARGEST = 1 << 20


def near_sum(size: np.ndarray, left: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length, at most ``left``, add up nearest to ``budget`` words."""
    taken = np.zeros(len(size), np.int64)
    usable = np.flatnonzero((left > 0) & (size > 0))
    if not len(usable) or budget <= 0:
        return taken
    unit = int(np.gcd.reduce(size[usable]))
    top = int(min(2 * budget, budget + int(size[usable].max()))) // unit + 1
    goal = round(budget / unit)
    reached = np.zeros(top + 1, bool)
    by = np.full(top + 1, -1, np.int32)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in usable[::-1].tolist():
        words = int(size[i]) // unit
        rest, times = min(int(left[i]), top // words), 1
        while rest > 0 and not reached[min(goal, top)]:
            times = min(times, rest)
            step = words * times
            new = np.flatnonzero(reached[: top + 1 - step] & ~reached[step:]) + step
            by[new] = len(items)
            reached[new] = True
            items.append((i, times))
            rest -= times
            times *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums * unit - budget))])
    while at:  # a sum was first reached over sums that earlier items reached
        i, times = items[by[at]]
        taken[i] += times
        at -= int(size[i]) // unit * times
    return taken


def counts_for(size: np.ndarray, count: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length are taken once more, for ``budget`` words, less than all documents have."""
    total = int((size * count).sum())
    if not total or budget <= 0:
        return np.zeros(len(size), np.int64)
    share = count * (budget / total)
    best, error = np.zeros(len(size), np.int64), np.inf
    for kept in (1.0, 0.5, 0.0):  # lengths give back some of their share where the words left do not fit
        taken = np.minimum(np.floor(share * kept).astype(np.int64), count)
        rest = budget - int((taken * size).sum())
        reserve = RESERVE * int(size.max()) if kept == 1.0 else LARGEST
        for i in np.argsort(taken - share, kind="stable").tolist():
            if size[i] and taken[i] < count[i] and rest - size[i] >= reserve:
                taken[i] += 1
                rest -= int(size[i])
        if kept < 1.0 and rest > LARGEST:
            break
        taken = taken + near_sum(size, count - taken, rest)
        off = abs(budget - int((taken * size).sum()))
        if off < error:
            best, error = taken, off
        if error <= 0.5:
            break
    return best


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """``(s, source_size, target)`` for ``(s, source, source_size)``; only sums over sources reach the driver."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = numbered(sizes, F.asc_nulls_last("source")).withColumn("weight", weight.cast("long"))
    total = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    budget = min(Fraction(share), most) * total
    over, level = -1, Fraction(0)
    while True:  # the level of words for a weight of 1 rises until no source is above its stop
        above = F.col("source_size").cast("decimal(38,0)") * (most * level.denominator) < F.col("weight").cast("decimal(38,0)") * level.numerator
        stop = F.when(above, most * F.col("source_size")).otherwise(0)
        found = ranked.agg(F.sum(stop).alias("full"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"), F.count_if(above).alias("over")).first()
        if not found["open"] or found["over"] == over:
            break
        over, level = found["over"], (budget - found["full"]) / found["open"]
    shared = (F.lit(float(budget - (found["full"] or 0))) * F.col("weight")) / F.lit(float(found["open"] or 1))
    return ranked.select("s", "source_size", F.when(above, (most * F.col("source_size")).cast("double")).otherwise(shared).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    s = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # joins do not match nulls
    return own.select("id", s.alias("s"), "source", size.alias("size"), _key(id_col="id", text_col="text", source_col="source").alias("key"))


def _key(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.lit(SEED), F.col(id_col), F.col(source_col).cast("string"), F.col(text_col).cast("string"))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """How often all documents of each length are taken, and how many of them once more."""
    pdf = pdf.sort_values("size", ignore_index=True)
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    copies = int(target // total) if total else 0
    extra = counts_for(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), target - copies * total)
    return pdf.assign(copies=copies, extra=extra)


def _cut(counts: DataFrame) -> DataFrame:
    """``(s, size, edge, rest)``: buckets below edge are taken whole, and ``rest`` rows of bucket edge, for ``(s, size, bucket, n, extra)``."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = counts.where("extra > 0").withColumn("before", before).where("before < extra and extra <= before + n")
    return found.select("s", "size", F.col("bucket").alias("edge"), (F.col("extra") - F.col("before")).alias("rest"))


def _bucket(key: str) -> Column:
    return F.shiftright(key, 64 - BITS).bitwiseAND(F.lit((1 << BITS) - 1))


def shares(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST,
) -> DataFrame:
    """``(id, source, key, size, source_size, target, copies)``: how often the mix takes each row, 0 to ``most`` times."""
    rows = stored(_sized(docs, id_col, text_col, source_col).withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "sized")
    buckets = stored(rows.groupBy("s", "size", _bucket("key").alias("bucket")).agg(F.count("*").alias("n")), "buckets")
    sizes = rows.groupBy("s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    aims = stored(targets(sizes, weights, share, most), "targets")
    lengths = buckets.groupBy("s", "size").agg(F.sum("n").alias("n")).join(aims, "s")
    shape = "s string, size long, n long, source_size long, target double, copies long, extra long"
    plan = stored(lengths.groupBy("s").applyInPandas(lambda pdf: _fit(pdf)[[c.split()[0] for c in shape.split(", ")]], shape), "plan")
    edges = _cut(buckets.join(plan.select("s", "size", "extra"), ["s", "size"]))
    # Rows under the edge are taken; those of the edge's bucket are cut again by the whole hash, equal rows by the tie.
    joined = rows.join(plan.drop("n", "extra").join(edges, ["s", "size"], "left"), ["s", "size"])
    state = joined.withColumn("bucket", _bucket("key"))
    done = []
    for level, finer in enumerate((F.col("key"), _bucket("tie")), 1):
        more = F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0)
        state = stored(state.withColumn("copies", F.col("copies") + more), f"mix-{level}")
        here = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
        done.append(state.where(~here))
        state = state.where(here).withColumn("extra", F.col("rest")).drop("edge", "rest").withColumn("bucket", finer)
        counted = state.groupBy("s", "size", "bucket").agg(F.count("*").alias("n"), F.first("extra").alias("extra"))
        state = state.drop("extra").join(_cut(counted), ["s", "size"], "left")
    rank = F.row_number().over(Window.partitionBy("s", "size", "bucket").orderBy("tie"))
    last = F.when((F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (rank <= F.col("rest"))), 1).otherwise(0)
    columns = ("id", "source", "key", "size", "source_size", "target", "copies")
    found = state.withColumn("copies", F.col("copies") + last).select(*columns)
    for part in done:
        found = found.unionByName(part.select(*columns))
    return found


def mixed(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix, each as often as it is taken; ``taken`` are the ``shares`` of ``docs``.

    Of rows that repeat id, source and text, one stands for all.
    """
    key = "k" * (1 + max(map(len, docs.columns)))  # a name that no column has
    often = taken.groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(f"{key}n"), F.count("*").alias(f"{key}m")).where(F.col(f"{key}n") > 0)
    named = docs.withColumn(key, _key(id_col, text_col, source_col)).join(often, key)
    single, repeated = named.where(F.col(f"{key}m") == 1), named.where(F.col(f"{key}m") > 1).dropDuplicates([key])
    each = single.unionByName(repeated).withColumn(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{key}n"))))
    return each.select(*(F.col(f"`{c}`") for c in docs.columns))
