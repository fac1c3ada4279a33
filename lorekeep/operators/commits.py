"""Commits: which count, what they say, and their chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import VERSION_BUMP, left_out_of_excerpts, looks_secret
from ..functions.text import LINE_END, day, fold, strip
from .chunking import COLUMNS, MAX_CHARS, MIN_CHARS, OVERLAP, split_documents

THIN_CHARS, EXCERPT_CHARS, FILES_LISTED = 200, 800, 30


def message(subject: Column, body: Column) -> Column:
    return F.when(body == "", subject).otherwise(F.concat(subject, F.lit("\n\n"), body))


def classified(commits: DataFrame, emails: list[str], names: list[str]) -> DataFrame:
    """Commits with ``class``: merge, version bump, other author or kept; the first that holds."""
    wanted = [e.strip().lower() for e in emails if e.strip()]
    known = [" ".join(n.split()).lower().replace("ß", "ss") for n in names if n.strip()]
    mine = F.lower(strip("author_email")).isin(wanted) | fold("author_name").isin(known)
    return commits.withColumn(
        "class",
        F.when(F.size("parents") > 1, F.lit("merge"))
        .when(strip("subject").rlike(VERSION_BUMP), F.lit("version bump"))
        .when(~mine, F.lit("other author"))
        .otherwise(F.lit("kept")),
    )


def class_counts(classes: DataFrame, *by: str) -> DataFrame:
    def n(name: str) -> Column:
        return F.count_if(F.col("class") == name)

    return classes.groupBy(*by).agg(
        n("merge").alias("merges"), n("version bump").alias("version_bumps"), n("other author").alias("other_authors"),
        n("kept").alias("kept"),
    )


def is_thin(subject: Column, body: Column, chars: int = THIN_CHARS) -> Column:
    """No body, or too short to say much by itself."""
    return (F.coalesce(body, F.lit("")) == "") | (F.length(message(subject, body)) < chars)


def _path(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.rtrim(F.rtrim(raw)), '^"+|"+$', ""), "^[ab]/", "")


class _Excerpt:
    """Where a walk through the lines of one diff stands, and what it has kept."""

    def __init__(self, room: int):
        self.room, self.kept, self.header, self.skipped = room, [], False, False

    def read(self, line: str, starts: bool, hunk: bool, out: bool, shows: bool) -> None:
        if starts:
            self.header, self.skipped = True, out
        elif hunk:
            self.header = False
        elif self.header:
            self.skipped |= out
        if shows and self.room > 0 and not self.header and not self.skipped:
            self.kept.append(line)
            self.room -= len(line) + 1


def excerpts(lines: DataFrame, by: tuple[str, ...] = ("hash",), chars: int = EXCERPT_CHARS) -> DataFrame:
    """``(*by, excerpt, problem)`` of diffs given as lines ``(*by, raw)`` in order: changed lines, cut to ``chars``.

    A ``diff --git`` line begins a file, lines up to its first hunk head are its
    header, and a name in the header that is left out leaves out the file;
    secret-looking lines are left out too.  Another key begins another diff, and
    so does a row that has ``begin``.  A row with a ``problem`` hands it on.

    What a line is, is told in the JVM; lines then stream through the task that
    has them, so a diff of any length costs no sort and is never one value.
    Only what the excerpt can show is kept.  A diff of which nothing shows has no row.
    """
    size = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kinds = None, _Excerpt(chars), None
        for batch in batches:
            kinds = [*batch.schema.types[:size], pa.string(), pa.string()]
            done: list[tuple] = []
            keys = zip(*(c.to_pylist() for c in batch.columns[:size]), strict=True)
            rest = zip(*(c.to_pylist() for c in batch.columns[size:]), strict=True)
            for own, (begin, problem, *line) in zip(keys, rest, strict=True):
                if begin or own != now:
                    done += closed(now, state)
                    now, state = own, _Excerpt(chars)
                if problem:
                    done.append((*own, None, problem))
                else:
                    state.read(*line)
            if done:
                yield batch_of(done, kinds)
        if last := closed(now, state):
            yield batch_of(last, kinds)

    def closed(own: tuple, state: _Excerpt) -> list[tuple]:
        return [(*own, "\n".join(state.kept)[:chars].rstrip(" \t\n\v\f\r"), None)] if state.kept else []

    def batch_of(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        names = [*by, "excerpt", "problem"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    given = {name: F.col(name) if name in lines.columns else F.lit(None).cast(kind) for name, kind in (("begin", "boolean"), ("problem", "string"))}
    line = F.coalesce("raw", F.lit(""))
    starts, hunk = line.startswith("diff --git "), line.startswith("@@")
    named = F.when(starts, F.regexp_extract(line, r"^.* b/(.*)$", 1)).when(line.rlike(r"^(?:---|\+\+\+) "), F.substring(line, 5, 1 << 30))
    out = F.coalesce((_path(named) != "/dev/null") & left_out_of_excerpts(_path(named)), F.lit(False))
    shows = line.rlike(r"^(?:[+-]|@@)") & ~looks_secret(line)
    # Only these count; told apart before anything dear is asked of a line.
    counts = line.rlike("^(?:diff --git |[+-]|@@)") | given["begin"] | given["problem"].isNotNull()
    told = lines.where(F.coalesce(counts, F.lit(False))).select(
        *by, given["begin"].alias("begin"), given["problem"].alias("problem"), F.substring(line, 1, chars).alias("line"),
        starts.alias("starts"), hunk.alias("hunk"), out.alias("out"), shows.alias("shows"),
    )
    kinds = dict(lines.dtypes)
    return told.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", excerpt string, problem string")


def git_lines(lines: DataFrame) -> DataFrame:
    """Lines as git ends them, cut where else a line may end."""
    return lines.withColumn("raw", F.explode_outer(F.split("raw", LINE_END)))


def diff_excerpts(diffs: DataFrame, key: str = "hash", diff_col: str = "diff", chars: int = EXCERPT_CHARS) -> DataFrame:
    """``(key, excerpt)`` of each diff that is one value, null ones left out."""
    each = diffs.select(key, F.posexplode(F.split(diff_col, LINE_END)).alias("n", "raw"))
    return excerpts(each.select(key, "raw", (F.col("n") == 0).alias("begin")), (key,), chars).select(key, "excerpt")


def commit_text(subject: Column, body: Column, files: Column, excerpt: Column) -> Column:
    """Subject, body, files and excerpt, as far as there are any, with blank lines between."""
    extra = F.size(files) - FILES_LISTED
    listed = F.concat_ws("\n", F.array_join(F.slice(files, 1, FILES_LISTED), "\n"),
                         F.when(extra > 0, F.concat(F.lit("... and "), extra.cast("string"), F.lit(" more"))))
    return F.concat_ws(
        "\n\n",
        subject,
        F.nullif(body, F.lit("")),
        F.when(F.size(files) > 0, F.concat(F.lit("Files changed:\n"), listed)),
        F.when(F.coalesce(excerpt, F.lit("")) != "", F.concat(F.lit("Diff excerpt:\n"), excerpt)),
    )


def commit_chunks(
    commits: DataFrame, shown: DataFrame | None = None, size: int = MAX_CHARS, overlap: int = OVERLAP,
    least: int = MIN_CHARS, thin_chars: int = THIN_CHARS,
) -> DataFrame:
    """Chunks of kept commits ``(project, path, hash, parents, author_*, subject, body, files)``.

    Thin commits that have a parent get the excerpt of their diff in ``shown``
    ``(hash, excerpt)``, which may name a commit for each of its clones.
    """
    if shown is None:
        said = commits.withColumn("excerpt", F.lit(""))
    else:
        thin = is_thin(F.col("subject"), F.col("body"), thin_chars) & (F.size("parents") > 0)
        one = shown.groupBy("hash").agg(F.min("excerpt").alias("excerpt"))
        said = commits.join(one, "hash", "left").withColumn(
            "excerpt", F.when(thin, F.coalesce("excerpt", F.lit(""))).otherwise(F.lit(""))
        )
    text = commit_text(F.col("subject"), F.col("body"), F.col("files"), F.col("excerpt"))
    whole = said.select("project", "path", "hash", "author_name", "author_email", "author_date", "subject", text.alias("text"))
    pieces = split_documents(whole, size=size, overlap=overlap, least=least, headings=False).drop("heading_path")
    short = F.substring("hash", 1, 7)
    head = F.concat(F.col("project"), F.lit(" · commit "), short, F.lit(" · "), day("author_date"))
    body = F.when(F.col("text").startswith(F.col("subject")), F.col("text")).otherwise(F.concat_ws("\n\n", "subject", "text"))
    spoken = F.concat_ws("\n", head, body)
    return pieces.withColumns(
        {
            "chunk_id": F.sha2(F.concat(F.col("project"), F.lit("|git:"), F.col("hash"), F.lit("|"), F.col("chunk_index").cast("string")), 256),
            "rel_path": F.concat(F.lit("commit "), short),
            "heading_path": F.col("subject"),
            "embed_text": spoken,
            "content_hash": F.sha2(spoken, 256),
            "mtime": F.unix_timestamp(F.to_timestamp("author_date")).cast("double"),
            "source": F.lit("git"),
            "commit": F.col("hash"),
            "author": F.col("author_name"),
        }
    ).select(*COLUMNS)

