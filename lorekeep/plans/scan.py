"""A leak scan over the tracked files of a repository and over commits that are not pushed.

What git cannot read stops the scan with an error: a file or a commit that was
not looked at must not count as clean.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_utf8
from ..operators import leaks
from ..sources import git
from ..sources.settings import ScanSettings
from ..sources.shared import stored


def _accepted(spark: SparkSession, settings: ScanSettings) -> DataFrame:
    return spark.createDataFrame(
        [(a.file, a.match, a.count, a.note) for a in settings.accepted], "file string, match string, count int, note string"
    )


def _hits(lines: DataFrame, terms: list[str]) -> DataFrame:
    found = leaks.pattern_hits(lines)
    return found.unionByName(leaks.term_hits(lines, terms)) if terms else found


def _in_names(names: DataFrame, terms: list[str]) -> DataFrame:
    """Terms in names of files, for ``(file, line, text)``."""
    return leaks.term_hits(names, terms).withColumn("kind", F.concat("kind", F.lit(" in file name")))


def whole(rows: DataFrame, what: str) -> DataFrame:
    """``rows``, stored, if git could read all of them; else an error that names the first problem."""
    held = stored(rows, "scan")
    if problem := held.where("problem is not null").select("problem").first():
        raise ValueError(f"{what} cannot be read: {problem['problem']}")
    return held


def scan_repository(spark: SparkSession, repo: str, settings: ScanSettings, rev: str | None = "HEAD") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits with their state, binary files, stale entries) of a revision, or of the worktree (None)."""
    repos = spark.createDataFrame([(repo,)], "path string")
    if rev is not None:
        rev = whole(git.resolved(repos, rev), f"revision {rev}").first()["hash"]
    files = whole(git.tracked(repos, rev), f"files of {repo}")
    binary = files.where(leaks.is_binary(F.col("content"))).select("file")
    texts = files.where(~leaks.is_binary(F.col("content"))).select("file", decode_utf8("content").alias("text"))
    terms = list(settings.all_terms)
    hits = _hits(leaks.numbered_lines(texts), terms)
    if terms:
        hits = hits.unionByName(_in_names(files.select("file", F.lit(0).alias("line"), F.col("file").alias("text")), terms))
    accepted = _accepted(spark, settings)
    return leaks.classified(hits, accepted), binary, leaks.stale(hits, accepted)


@dataclass
class CommitScan:
    """What unpushed commits would publish; ``file`` is hash:file, and hash: alone for a message."""

    hits: DataFrame
    #: Binary files, which are not read.
    binary: DataFrame
    #: Commits ``(hash)`` of several parents, of which only the message is read.
    merges: DataFrame


def scan_commits(spark: SparkSession, repo: str, settings: ScanSettings, upstream: str = "origin/main", end: str = "HEAD") -> CommitScan:
    """Hits in messages, added lines and new names of commits past ``upstream``, with their state.

    A line is accepted where the commit's own version of the file still has as
    many such lines as the entry counts; a message or a key never is.
    """
    repos = spark.createDataFrame([(repo, repo)], "project string, path string")
    low, high = (whole(git.resolved(repos, r), f"revision {r}").first()["hash"] for r in (upstream, end))
    log = whole(git.commits(repos, f"{low}..{high}"), f"commits past {upstream}")
    single = log.where(F.size("parents") < 2)
    place = F.concat_ws(":", "hash", "file").alias("file")
    # Lines are read where git gives them: stored first, a long diff could be cut between tasks.
    read = stored(leaks.read_diffs(git.diff_lines(single.select("path", "hash"))), "scan")
    if problem := read.where("what = 'problem'").select("text").first():
        raise ValueError(f"diffs of commits cannot be read: {problem['text']}")
    said = log.select(F.concat_ws(":", "hash", F.lit("")).alias("file"), F.concat_ws("\n", "subject", "body").alias("text"))
    terms = list(settings.all_terms)
    hits = _hits(read.where("what = 'line'").select(place, "line", "text").unionByName(leaks.numbered_lines(said)), terms)
    if terms:
        hits = hits.unionByName(_in_names(read.where("what = 'name'").select(place, "line", "text"), terms))
    hits = stored(hits, "scan")
    # What entries name is counted again in whole files, as they were at the commit.
    name = F.regexp_extract("file", "^[^:]*:(.*)$", 1)
    named = hits.select("file", name.alias("name"), F.lower("match").alias("match")).distinct()
    entries = _accepted(spark, settings).select(F.col("file").alias("name"), F.lower("match").alias("match"), "count", "note")
    asked = stored(named.join(entries, ["name", "match"]).select("file", "match", "count", "note"), "scan")
    places = asked.select(F.lit(repo).alias("path"), F.substring_index("file", ":", 1).alias("hash"), name.alias("file")).distinct()
    versions = whole(git.versions(places), "versions of files")
    texts = versions.select(place, decode_utf8("content").alias("text"))
    fine = leaks.classified(_hits(leaks.numbered_lines(texts), terms), asked).where("state = 'accepted'")
    fine = fine.select("file", F.lower("match").alias("low"), "kind", F.lit("accepted").alias("state")).distinct()
    marked = hits.withColumn("low", F.lower("match")).join(fine, ["file", "low", "kind"], "left")
    return CommitScan(
        marked.select(*hits.columns, F.coalesce("state", F.lit("new")).alias("state")),
        read.where("what = 'binary'").select(place), log.where(F.size("parents") > 1).select("hash"),
    )


def exit_code(*found: DataFrame, stale: DataFrame | None = None) -> int:
    """1 while a hit is new that is no placeholder, or an entry is stale."""
    new = any(not hits.where("state = 'new' and kind <> 'placeholder email'").isEmpty() for hits in found)
    return int(new or (stale is not None and not stale.isEmpty()))
