"""Git history as DataFrames: log, diffs, tracked trees and repository state.

Tasks run git and hand on its output, a record a row as it comes; what the
records say is taken apart, filtered and counted by Spark.
"""

from __future__ import annotations

import os
import select
import subprocess
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from .documents import content_of

#: Separators and fields of the log, and settings that could change git's output.
RECORD, FIELD = "\x1e", "\x1f"
LOG_FORMAT = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%s%x1f%b%x1f"
FIELDS = ("hash", "parents", "author_name", "author_email", "author_date", "subject", "body", "files")
PINNED = ("core.quotePath=false", "log.showSignature=false", "log.showRoot=true", "color.ui=never")
ELSEWHERE = ("GIT_DIR", "GIT_WORK_TREE", "GIT_INDEX_FILE", "GIT_COMMON_DIR")
#: Git may be silent so long; how long its reader takes does not count.
SECONDS = 60.0


class GitError(RuntimeError):
    """A request that git must not get."""


def _records(repo: str, args: list[str], end: bytes | None) -> Iterator[tuple[list[bytes], str | None]]:
    """Git's output cut at ``end`` while it comes (None: whole, at last), then what went wrong, if anything did."""
    environment = {k: v for k, v in os.environ.items() if k not in ELSEWHERE} | {"GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}
    environment["GIT_CEILING_DIRECTORIES"] = os.path.dirname(os.path.abspath(repo))
    settings = [word for pin in PINNED for word in ("-c", pin)]
    try:
        process = subprocess.Popen(["git", *settings, "-C", repo, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE, env=environment)
    except OSError as problem:
        yield [], str(problem)
        return
    complaints: list[bytes] = []
    reader = threading.Thread(target=lambda: complaints.append(process.stderr.read()), daemon=True)
    reader.start()
    silent = False
    with process:
        rest, parts = b"", []
        while True:
            if not select.select([process.stdout], [], [], SECONDS)[0]:
                silent = True
                process.kill()
                break
            if not (block := os.read(process.stdout.fileno(), 1 << 20)):
                break
            if end is None:
                parts.append(block)
                continue
            *whole, rest = (rest + block).split(end)
            if whole:
                yield whole, None
        ended = process.wait()
        reader.join()
    if silent or ended:
        first = b"".join(complaints).decode("utf-8", "replace").strip().partition("\n")[0]
        yield [], f"git said nothing for {SECONDS:g} seconds" if silent else first or f"git ended with {ended}"
    elif end is None:
        yield [b"".join(parts)], None
    elif rest:
        yield [rest], None


def ask(asked: DataFrame, args: Column, end: str | None = None) -> DataFrame:
    """``asked`` (with ``path``) and what git answers to ``args`` there.

    A row for each record in ``said`` (bytes), in git's order; where git fails
    a last row has ``problem`` instead.
    """
    names = [*asked.columns, "said", "problem"]
    at_path, n = asked.columns.index("path"), len(asked.columns)
    cut = None if end is None else end.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = zip(batch.column(at_path).to_pylist(), batch.column(n).to_pylist(), strict=True)
            for row, (path, words) in enumerate(asks):
                for records, problem in _records(path, words, cut):
                    rows = max(1, len(records))
                    own = [c.take(pa.array([row] * rows)) for c in batch.columns[:n]]
                    answers = [pa.array(records or [None], pa.binary()), pa.array([problem] * rows, pa.string())]
                    yield pa.RecordBatch.from_arrays([*own, *answers], names)

    kind = T.StructType([*asked.schema.fields, T.StructField("said", T.BinaryType()), T.StructField("problem", T.StringType())])
    return asked.withColumn("_args", args).mapInArrow(run, kind)


def _words(*words: str | Column) -> Column:
    return F.array(*[F.lit(w) if isinstance(w, str) else w for w in words])


def _text(said: str = "said") -> Column:
    return F.make_valid_utf8(F.col(said).cast("string"))


def commits(repos: DataFrame, ref: str | Column = "HEAD") -> DataFrame:
    """Commits of each ``(project, path)``, newest first, with the files that each touches; ``problem`` where git failed."""
    if isinstance(ref, str) and ref.startswith("-"):
        raise GitError(f"not a ref: {ref!r}")
    log = ask(repos, _words("log", f"--format={LOG_FORMAT}", "--name-only", "--end-of-options", ref, "--"), RECORD)
    parts = F.split(_text(), FIELD)
    rows = log.where("problem is not null or length(said) > 0").withColumn("_f", parts)
    field = {name: F.get("_f", F.lit(i)) for i, name in enumerate(FIELDS)}
    full = F.size("_f") == len(FIELDS)
    return rows.select(
        "project", "path", field["hash"].alias("hash"),
        F.filter(F.split(field["parents"], " "), lambda x: x != "").alias("parents"),
        *[field[x].alias(x) for x in ("author_name", "author_email", "author_date")],
        strip(field["subject"]).alias("subject"), strip(field["body"]).alias("body"),
        F.filter(F.split(field["files"], "\n"), lambda x: strip(x) != "").alias("files"),
        F.coalesce("problem", F.when(~full, "a log record with another number of fields")).alias("problem"),
    )


def _hashed(places: DataFrame) -> DataFrame:
    """``places`` whose hash is one; anything else would reach git as an option or another ref."""
    return places.where(F.col("hash").rlike("^[0-9a-f]{40,64}$"))


def diffs(kept: DataFrame) -> DataFrame:
    """``(path, hash, diff, problem)`` of each commit ``(path, hash)`` against its first parent, without context lines."""
    asked = _hashed(kept.select("path", "hash"))
    shown = ask(asked, _words("show", "--format=", "-U0", "--no-ext-diff", "--no-textconv", "--first-parent", F.col("hash")))
    return shown.select("path", "hash", _text().alias("diff"), "problem")


def diff_lines(kept: DataFrame, renames: bool = True) -> DataFrame:
    """``(path, hash, raw, problem)``: the same a line at a time, if wanted with renames, in git's order within a task."""
    asked = _hashed(kept.select("path", "hash"))
    found = ["-M"] if renames else []
    shown = ask(asked, _words("show", "--format=", "-U0", *found, "--no-ext-diff", "--no-textconv", "--first-parent", F.col("hash")), "\n")
    return shown.select("path", "hash", _text().alias("raw"), "problem")


def resolved(repos: DataFrame, rev: str) -> DataFrame:
    """``(path, hash, problem)``: the commit that a revision names."""
    found = ask(repos.select("path"), _words("rev-parse", "--verify", "-q", "--end-of-options", rev + "^{commit}"))
    problem = F.when(F.col("problem").isNotNull(), F.lit(f"unknown revision {rev!r}"))
    return found.select("path", strip(_text()).alias("hash"), problem.alias("problem"))


def versions(places: DataFrame) -> DataFrame:
    """``(path, hash, file, content, problem)``: files as they are at a commit."""
    asked = _hashed(places.select("path", "hash", "file"))
    return ask(asked, _words("show", F.concat_ws(":", "hash", "file"))).withColumnRenamed("said", "content")


def tracked(repos: DataFrame, rev: str | None = "HEAD") -> DataFrame:
    """``(path, file, content, problem)`` of each tracked file at a revision, or as it lies in the worktree (None).

    The tree is listed first and its files are dealt out, so that tasks share
    the reading of one large repository.
    """
    if rev is not None and rev.startswith("-"):
        raise GitError(f"not a revision: {rev!r}")
    if rev is None:
        listed = ask(repos.select("path"), _words("ls-files", "-z"), "\0").select("path", _text().alias("file"), "problem")
        return _read(listed.repartition("file"))
    entry = ask(repos.select("path"), _words("ls-tree", "-r", "-z", rev), "\0")
    head = F.split(F.substring_index(_text(), "\t", 1), " ")
    name = F.expr("substring(_t, locate('\t', _t) + 1)")
    listed = entry.withColumn("_t", _text()).select("path", name.alias("file"), head.alias("head"), "problem")
    failed = listed.where("problem is not null").select("path", F.lit(None).cast("string").alias("file"), F.lit(None).cast("binary").alias("content"), "problem")
    blobs = listed.where("problem is null and head[1] = 'blob'").select("path", "file", F.col("head")[2].alias("blob")).repartition("blob", "file")
    read = ask(blobs, _words("cat-file", "blob", F.col("blob"))).select("path", "file", F.col("said").alias("content"), "problem")
    return read.unionByName(failed)


def _read(listed: DataFrame) -> DataFrame:
    """Contents of files in a worktree; those that are gone or no files are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, problem in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = content_of(os.path.join(path, file)) if file else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([file], pa.string()), pa.array([found], pa.binary()), pa.array([problem], pa.string())],
                    ["path", "file", "content", "problem"],
                )

    read = listed.mapInArrow(run, "path string, file string, content binary, problem string")
    return read.where("content is not null or problem is not null")


def status(repos: DataFrame) -> DataFrame:
    """``repos`` (with ``path``) with head, branch, default branch, distance to it, and flags; ``problem`` where git failed.

    The default branch is what the remote (origin, else the first by name)
    points its head at, else its main, else its master.
    """
    paths = repos.select("path").distinct()
    questions = {
        "state": ("status", "--porcelain=v2", "--branch", "--untracked-files=no"),
        "remote": ("remote",),
        "ref": ("for-each-ref", "--format=%(refname)%1f%(symref)", "refs/remotes"),
    }
    each = F.explode(F.create_map(*[x for k, words in questions.items() for x in (F.lit(k), _words(*words))])).alias("kind", "words")
    lines = ask(paths.select("path", each), F.col("words"), "\n").withColumn("line", _text())

    def after(head: str) -> Column:
        return F.max(F.when((F.col("kind") == "state") & F.col("line").startswith(head), F.expr(f"substring(line, {len(head) + 1})")))

    ref = F.struct(F.split("line", FIELD)[0].alias("name"), F.split("line", FIELD)[1].alias("target"))
    seen = lines.groupBy("path").agg(
        after("# branch.oid ").alias("head"), after("# branch.head ").alias("branch"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "remote", F.col("line")))).alias("remotes"),
        F.collect_set(F.when((F.col("kind") == "ref") & F.col("line").isNotNull(), ref)).alias("refs"),
        F.max("problem").alias("problem"),
    )
    remote = F.when(F.array_contains("remotes", "origin"), "origin").otherwise(F.get("remotes", F.lit(0)))
    seen = seen.withColumn("remote", remote).withColumn("base", F.concat(F.lit("refs/remotes/"), F.col("remote"), F.lit("/")))
    pointed = F.get(F.filter("refs", lambda r: r["name"] == F.concat("base", F.lit("HEAD"))), F.lit(0))["target"]
    names = F.transform("refs", lambda r: r["name"])
    usual = [F.when(F.array_contains(names, F.concat("base", F.lit(n))), F.concat("base", F.lit(n))) for n in ("main", "master")]
    whole = F.coalesce(F.nullif(pointed, F.lit("")), *usual)
    seen = seen.withColumn("whole", whole).withColumn("default_branch", F.expr("substring(whole, 14)"))  # without refs/remotes/
    seen = seen.withColumn("problem", F.coalesce("problem", F.when(F.col("head") == "(initial)", "no commits yet")))

    compared = seen.where("problem is null and whole is not null").select("path", "whole")
    apart = ask(compared, _words("rev-list", "--left-right", F.concat(F.lit("HEAD..."), F.col("whole"))), "\n").withColumn("line", _text())
    counts = apart.groupBy("path").agg(
        F.count_if(F.col("line").startswith("<")).cast("int").alias("ahead"), F.count_if(F.col("line").startswith(">")).cast("int").alias("behind")
    )
    rows = seen.join(counts, "path", "left").withColumn("branch", F.when(F.col("branch") != "(detached)", F.col("branch")))
    for side in ("ahead", "behind"):
        rows = rows.withColumn(side, F.coalesce(side, F.when(F.col("whole").isNotNull(), 0)))
    holds = {
        "no remote": F.col("remote").isNull(),
        "detached": F.col("branch").isNull(),
        "not on the default branch": F.col("default_branch") != F.concat_ws("/", "remote", "branch"),
        "unpushed commits": F.col("ahead") > 0,
        "behind": F.col("behind") > 0,
    }
    flags = F.array_compact(F.array(*[F.when(held, F.lit(flag)) for flag, held in holds.items()]))
    found = rows.select(
        "path", "head", "branch", "default_branch", "ahead", "behind", F.when(F.col("problem").isNull(), flags).alias("flags"), "problem"
    )
    return repos.join(found, "path")


def file_dates(files: DataFrame) -> DataFrame:
    """``(path, file, date, dated_by)``: the date of the last commit of a file, else of the file, else unknown."""
    asked = files.select("path", "file").distinct()
    committed = ask(asked, _words("log", "-1", "--format=%cs", "--", F.col("file")))
    committed = committed.select("path", "file", F.nullif(strip(_text()), F.lit("")).alias("committed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seconds = []
            for path, file in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                try:
                    seconds.append(os.stat(os.path.join(path, file)).st_mtime)
                except OSError:
                    seconds.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seconds, pa.float64())], ["path", "file", "committed", "seconds"])

    found = committed.mapInArrow(run, "path string, file string, committed string, seconds double")
    touched = F.date_format(F.timestamp_seconds("seconds"), "yyyy-MM-dd")
    by = F.when(F.col("committed").isNotNull(), "git").when(F.col("seconds").isNotNull(), "mtime").otherwise("unknown")
    return found.select("path", "file", F.coalesce("committed", touched, F.lit("unknown")).alias("date"), by.alias("dated_by"), "seconds")
