"""Which commits are reachable from which, over the parents column of one log.

A history is mostly lines: commits of one parent that is the parent of no other.
Pointer jumping finds the end of each commit's line and its distance from it in
as many rounds as the longest line has binary digits.  What is reached from
outside is reached at the top of a line and so with all of it; only a starting
commit stands within its line, and reaches what lies below.  The lines, with the
parents of their ends, are a small graph: up to AT_ONCE of its edges one task
walks through, beyond that a frontier is joined with it until it finds no more.

Both sides of each join grow with the log, and a broadcast goes through the
driver; in many rounds many small ones add up.  So joins here shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Edges between lines that one task holds.
AT_ONCE = 100_000


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The two joined by a shuffle, however small a side is found to be."""
    return left.join(right.hint("merge"), on, how)


def edges_of(log: DataFrame, key: str = "hash", parents: str = "parents") -> DataFrame:
    """``(child, parent)`` of commits that are both in the log; a shallow log knows of parents that it lacks."""
    each = log.select(F.col(key).alias("child"), F.explode(parents).alias("parent")).distinct()
    return _met(each, log.select(F.col(key).alias("parent")).distinct(), "parent", "left_semi").select("child", "parent")


def lines_of(log: DataFrame, edges: DataFrame, key: str = "hash") -> DataFrame:
    """``(node, line, depth)``: the end of each commit's line, and how far above it the commit is."""
    single = edges.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).where("n = 1")
    alone = edges.groupBy("parent").agg(F.count("*").alias("n")).where("n = 1").select("parent")
    inner = _met(single, alone, "parent", "left_semi").select(F.col("child").alias("node"), F.col("parent").alias("line"))
    nodes = _met(log.select(F.col(key).alias("node")).distinct(), inner, "node", "left")
    rows = cut(nodes.select("node", F.coalesce("line", "node").alias("line"), F.when(F.col("line").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while True:
        further = rows.select(F.col("node").alias("line"), F.col("line").alias("end"), F.col("depth").alias("more"))
        moved = cut(_met(rows, further, "line").select("node", F.col("end").alias("line"), (F.col("depth") + F.col("more")).alias("depth"), "more"))
        rows = moved.drop("more")
        if moved.where("more > 0").isEmpty():
            return rows


def _closure(edges: DataFrame, seeds: DataFrame, at_once: int) -> DataFrame:
    """``(tag, line)`` that follow from ``seeds`` over ``(line, to)``, the seeds themselves only where an edge leads to them."""
    edges = cut(edges.distinct())
    first = cut(_met(seeds, edges, "line").select("tag", F.col("to").alias("line")).distinct())
    if edges.count() > at_once:
        found = front = first
        while not front.isEmpty():
            further = _met(front, edges, "line").select("tag", F.col("to").alias("line")).distinct()
            front = cut(_met(further, found, ["tag", "line"], "left_anti"))
            found = cut(found.unionByName(front))
        return found
    kind = dict(edges.dtypes)["line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict = {}
        start: dict = {}
        types: list = []
        for batch in batches:
            types = [c.type for c in batch.columns[:2]]
            for tag, line, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if to is None:
                    start.setdefault(tag, []).append(line)
                else:
                    below.setdefault(line, []).append(to)
        for tag, lines in start.items():
            seen, todo = set(lines), list(lines)
            while todo:
                fresh = [x for x in below.get(todo.pop(), ()) if x not in seen]
                seen.update(fresh)
                todo += fresh
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(seen), types[0]), pa.array(list(seen), types[1])], ["tag", "line"])

    none = F.lit(None).cast(dict(first.dtypes)["tag"])
    both = first.select("tag", "line", F.lit(None).cast(kind).alias("to")).unionByName(edges.select(none.alias("tag"), "line", "to"))
    return both.repartition(1).mapInArrow(run, f"tag {dict(first.dtypes)['tag']}, line {kind}")


def reachable(log: DataFrame, starts: DataFrame, key: str = "hash", parents: str = "parents", at_once: int = AT_ONCE) -> DataFrame:
    """``(tag, hash)``: the commits that each of ``starts`` (tag, hash) reaches, itself among them."""
    edges = cut(edges_of(log, key, parents))
    lines = lines_of(log, edges, key)
    begin = cut(_met(starts.select("tag", F.col(key).alias("node")).distinct(), lines, "node"))
    ends = _met(edges.withColumnRenamed("child", "line"), lines.where("depth = 0").select("line"), "line", "left_semi")
    between = _met(ends, lines.select(F.col("node").alias("parent"), F.col("line").alias("to")), "parent").select("line", "to")
    whole = _closure(between, begin.select("tag", "line"), at_once)
    inside = _met(begin.select("tag", "line", F.col("depth").alias("most")), lines, "line").where("depth <= most").select("tag", "node")
    found = _met(whole, lines, "line").select("tag", "node").unionByName(inside).distinct()
    return found.withColumnRenamed("node", key)


def sides(log: DataFrame, heads: DataFrame, key: str = "hash", parents: str = "parents") -> DataFrame:
    """``(project, hash, side)`` for ``heads`` (project, ours, theirs): which of the two reaches a commit, ours, theirs or both.

    Commits of ours alone are not pushed; those of theirs alone are not merged.
    """
    name = F.explode(F.array(F.lit("ours"), F.lit("theirs"))).alias("side")
    asked = heads.select("project", "ours", "theirs", name)
    starts = asked.select(F.struct("project", "side").alias("tag"), F.when(F.col("side") == "ours", F.col("ours")).otherwise(F.col("theirs")).alias(key))
    starts = starts.select(F.to_json("tag").alias("tag"), key)
    rows = reachable(log, starts, key, parents).withColumn("of", F.from_json("tag", "project string, side string")).select("of.*", key)
    both = rows.groupBy("project", key).agg(F.count("*").alias("n"), F.min("side").alias("side"))
    return both.select("project", key, F.when(F.col("n") == 2, "both").otherwise(F.col("side")).alias("side"))
