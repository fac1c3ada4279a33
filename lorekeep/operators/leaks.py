"""Leaks in files: private paths, addresses, keys and private terms, and which are accepted."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import BINARY_SNIFF, LEAKS, PLACEHOLDER, SECRET_KINDS
from ..functions.text import LINE_END, lines
from .terms import mask_terms, term_hits

__all__ = ["added_lines", "classified", "diff_lines", "is_binary", "mask_terms", "numbered_lines", "pattern_hits", "read_diffs", "stale", "term_hits", "totals"]

#: What each match holds for certain: a cheap test before the patterns, which go back and forth on long words.
HINTS = {"drive path": (":\\", ":/"), "home path": ("/home/", "/Users/"), "email": ("@",), "google api key": ("AIza",)}


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes."""
    return F.position(F.lit(b"\0"), F.substring(content, 1, BINARY_SNIFF)) > 0


def numbered_lines(files: DataFrame, key: str = "file", text_col: str = "text") -> DataFrame:
    return files.select(key, F.posexplode(lines(text_col)).alias("n", "text")).select(
        F.col(key), (F.col("n") + 1).alias("line"), "text"
    )


def pattern_hits(each: DataFrame, key: str = "file") -> DataFrame:
    """``(file, line, kind, match)``: every match of every pattern in numbered lines, in one pass."""
    none = F.array().cast("array<struct<kind:string,match:string>>")
    hinted = {kind: reduce(Column.__or__, [F.contains("text", F.lit(h)) for h in hints]) for kind, hints in HINTS.items()}
    found = F.array(
        *[
            F.when(hinted[kind], F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), _named(kind))).otherwise(none)
            for kind, pattern in LEAKS.items()
        ]
    )
    hit = F.explode(F.flatten(found)).alias("hit")
    likely = reduce(Column.__or__, hinted.values())
    rows = each.where(likely).select(F.col(key), "line", hit).select(F.col(key), "line", "hit.*")
    placeholder = (F.col("kind") == "email") & F.col("match").rlike(PLACEHOLDER)
    return rows.withColumn("kind", F.when(placeholder, "placeholder email").otherwise(F.col("kind")))


def _named(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match"))


def classified(hits: DataFrame, accepted: DataFrame, key: str = "file") -> DataFrame:
    """Hits with ``state``: accepted where an entry ``(file, match, count)`` counts as many lines as there are, else new.

    Keys are never accepted.
    """
    match = F.lower("match")
    by_key = W.partitionBy(key, match)
    counted = hits.withColumn("lines", F.size(F.collect_set("line").over(by_key)))
    entries = accepted.select(key, match.alias("_m"), "count").dropDuplicates([key, "_m"])
    rows = counted.withColumn("_m", match).join(entries, [key, "_m"], "left")
    fine = F.coalesce(F.col("lines") == F.col("count"), F.lit(False)) & ~F.col("kind").isin(*SECRET_KINDS)
    return rows.withColumn("state", F.when(fine, "accepted").otherwise("new")).drop("_m", "lines", "count")


def stale(hits: DataFrame, accepted: DataFrame, key: str = "file") -> DataFrame:
    """Entries that count more lines than there are, with the number found."""
    found = (
        hits.where(~F.col("kind").isin(*SECRET_KINDS)).groupBy(key, F.lower("match").alias("_m")).agg(F.count_distinct("line").alias("found"))
    )
    rows = accepted.withColumn("_m", F.lower("match")).join(found, [key, "_m"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.where("found < count").drop("_m")


def diff_lines(diffs: DataFrame, key: str = "hash", diff_col: str = "diff") -> DataFrame:
    """``(hash, raw)``: the lines of each diff in order."""
    return diffs.select(key, F.explode(F.split(diff_col, LINE_END)).alias("raw"))


#: Of each hunk the number of its first new line, and what names a file or its kind before the first hunk.
_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@")
_BINARY = re.compile(r"Binary files .* and (.*) differ$")


def _name(said: str) -> str:
    bare = said.strip().strip('"')
    return bare[2:] if bare[:2] in ("a/", "b/") else bare


class _Diff:
    """Where a walk through the lines of one diff stands."""

    def __init__(self):
        self.file, self.line, self.in_hunk, self.new = None, 0, False, False

    def read(self, raw: str) -> Iterator[tuple[str, str | None, int, str]]:
        """(what, file, line, text): added lines, names of files that are new, and binary files."""
        if raw.startswith("diff --git "):
            yield from self.close()
            self.file, self.line, self.in_hunk, self.new = _name(raw.rpartition(" b/")[2]), 0, False, False
        elif hunk := _HUNK.match(raw):
            self.line, self.in_hunk = int(hunk[1]), True
        elif self.in_hunk:
            if raw.startswith("+"):
                yield "line", self.file, self.line, raw[1:]
            self.line += raw.startswith(("+", " "))
        elif raw.startswith("+++ ") and raw != "+++ /dev/null":
            self.file = _name(raw[4:])
        elif raw.startswith(("rename to ", "copy to ")):
            self.file, self.new = _name(raw.partition(" to ")[2]), True
        elif raw.startswith("new file mode"):
            self.new = True
        elif (binary := _BINARY.match(raw)) and binary[1] != "/dev/null":
            self.file = _name(binary[1])
            yield "binary", self.file, 0, self.file

    def close(self) -> Iterator[tuple[str, str | None, int, str]]:
        if self.new and self.file is not None:
            yield "name", self.file, 0, self.file
            self.new = False


def read_diffs(rows: DataFrame, key: str = "hash") -> DataFrame:
    """``(hash, what, file, line, text)`` of diffs given as lines ``(hash, raw)`` in order: ``what`` is line, name or binary.

    Where rows have a ``problem`` it is handed on in ``text``, as what problem.

    Lines stream through the task that has them, with a few values of state, so
    a diff of any length costs no sort and is never one value.  Added lines are
    numbered as in the new file; a name is of a file that is new, renamed or copied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind = None, _Diff(), pa.null()
        for batch in batches:
            kind = batch.column(0).type
            out: list[tuple] = []
            for own, raw, problem in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != now:
                    out += [(now, *found) for found in state.close()]
                    now, state = own, _Diff()
                out += [(own, "problem", None, 0, problem)] if problem else [(own, *found) for found in state.read(raw or "")]
            if out:
                yield batch_of(out, kind)
        if last := [(now, *found) for found in state.close()]:
            yield batch_of(last, kind)

    def batch_of(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [key, "what", "file", "line", "text"])

    source = rows.select(key, "raw", F.col("problem") if "problem" in rows.columns else F.lit(None).cast("string").alias("problem"))
    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, what string, file string, line long, text string")


def added_lines(diffs: DataFrame, key: str = "hash", diff_col: str = "diff") -> DataFrame:
    """``(hash, file, line, text)``: lines that a diff adds, numbered as in the new file."""
    return read_diffs(diff_lines(diffs, key, diff_col), key).where("what = 'line'").drop("what")


def totals(states: DataFrame) -> DataFrame:
    return states.groupBy("kind").agg(
        F.count_if(F.col("state") == "new").alias("new"), F.count_if(F.col("state") == "accepted").alias("accepted")
    )
