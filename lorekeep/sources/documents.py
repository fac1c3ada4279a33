"""Documents under a scan root: found, filtered, assigned to projects and read.

Spark's file sources skip names that begin with ``_`` or ``.``, so tasks list
the folders, some at a time, and read the files that are wanted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import casefold, decode_utf8, matches_any
from .settings import Settings
from .shared import stored

#: What a folder holds: files, git roots, and folders that are still to be listed.
LISTED = "path string, rel string, size_bytes long, mtime double, git_root boolean, open boolean"
#: Folders that a task lists before it hands on what is left; those are dealt out anew.
FOLDERS = 256
#: Files that a task reads.
FILES = 256


def _folder(path: str, pruned: frozenset[str]) -> tuple[list[str], list[os.DirEntry], bool]:
    """(names of folders to go on with, other entries, whether it is a git root); links to folders are not followed."""
    folders, files, marked = [], [], False
    try:
        with os.scandir(path) as entries:
            for entry in sorted(entries, key=lambda e: e.name):
                marked |= entry.name == ".git"
                if not entry.is_dir():
                    files.append(entry)
                elif not entry.is_symlink() and not entry.name.startswith(".") and entry.name.lower() not in pruned:
                    folders.append(entry.name)
    except OSError:
        pass
    return folders, files, marked


def _walk(root: str, rel: str, pruned: frozenset[str], most: int) -> Iterator[tuple]:
    """Rows of a folder and of those below it, ``most`` folders in all; what is not reached is given as open."""
    todo = [rel]
    for _ in range(most):
        if not todo:
            return
        here = todo.pop()
        path = os.path.join(root, here) if here else root
        folders, files, marked = _folder(path, pruned)
        if marked:
            yield path, here or ".", 0, 0.0, True, False
        for entry in files:
            try:
                seen = os.stat(entry.path)
            except OSError:
                continue
            yield entry.path, os.path.join(here, entry.name), seen.st_size, seen.st_mtime, False, False
        todo += [os.path.join(here, f) for f in reversed(folders)]
    for here in todo:
        yield os.path.join(root, here), here, 0, 0.0, False, True


def listing(spark: SparkSession, settings: Settings, most: int = FOLDERS) -> DataFrame:
    """Every file below the root and every git root, without pruned folders.

    A task lists some folders and hands on those that it does not reach, which
    are dealt to all tasks; so a small tree takes one step, and a large one is
    shared, however its folders lie.
    """
    root, pruned = settings.scan_root, frozenset(d.lower() for d in settings.exclude_dirs)
    names = [c.split()[0] for c in LISTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                rows = _walk(root, rel, pruned, most)
                while part := list(islice(rows, 4096)):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part])

    todo, steps = spark.createDataFrame([("",)], "rel string").coalesce(1), []
    while True:
        steps.append(stored(todo.mapInArrow(run, LISTED), "listing"))
        left = steps[-1].where("open").select("rel")
        n = left.count()
        if not n:
            return reduce(DataFrame.unionByName, steps).where("not open").drop("open")
        todo = left.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "rel")


def wanted(files: DataFrame, settings: Settings) -> DataFrame:
    """Files whose name matches, or that are markdown below an included folder; none of an excluded path."""
    rel = F.replace("rel", F.lit("\\"), F.lit("/"))
    parts = F.split(rel, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    dirs = [d.lower() for d in settings.include_dirs]
    below = F.exists(folders, lambda p: F.lower(p).isin(dirs)) & F.lower(name).endswith(".md")
    out = F.lit(False)
    for path in settings.exclude_paths:
        clean = path.strip("/")
        out = out | (rel == clean) | rel.startswith(clean + "/")
    return files.where((matches_any(name, settings.include_patterns) | below) & ~out)


def nearest_root(files: DataFrame, roots: DataFrame, path: str = "rel", root: str = "root") -> DataFrame:
    """``files`` with ``root``: the longest root that the path lies under, null where there is none.

    Every folder above a file is looked up by equality, so neither side is
    compared with all of the other.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = files.select(path, F.explode(above).alias(root)).distinct()
    found = asked.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return files.join(found, path, "left")


def discover(spark: SparkSession, settings: Settings) -> DataFrame:
    """``(path, project, project_root, rel_path, size_bytes, mtime)``, sorted by project and path."""
    every = listing(spark, settings)
    roots = every.where("git_root").select(F.when(F.col("rel") == ".", "").otherwise(F.col("rel")).alias("root"))
    files = nearest_root(wanted(every.where("not git_root"), settings), roots)
    top = F.when(F.instr("rel", "/") > 0, F.substring_index("rel", "/", 1)).otherwise("")
    home = F.coalesce("root", top)
    base = settings.scan_root
    project = F.when(home == "", F.lit(os.path.basename(base))).otherwise(F.element_at(F.split(home, "/"), -1))
    rows = files.select(
        "path",
        project.alias("project"),
        F.when(home == "", F.lit(base)).otherwise(F.concat(F.lit(base + "/"), home)).alias("project_root"),
        F.when(home == "", F.col("rel")).otherwise(F.expr("substring(rel, length(coalesce(root, substring_index(rel, '/', 1))) + 2)")).alias("rel_path"),
        "size_bytes",
        "mtime",
    ).dropDuplicates(["path"])
    if settings.exclude_projects:
        rows = rows.where(~casefold("project").isin([p.strip().casefold() for p in settings.exclude_projects]))
    return rows.orderBy(F.lower("project"), F.lower("rel_path"))


def read_texts(found: DataFrame, files: int = FILES) -> tuple[DataFrame, DataFrame]:
    """(documents with ``text``, documents that could not be read); a task reads about ``files`` of them.

    Tasks open the files themselves, as they list them: the file source would
    leave out names that begin with ``_``, even when they are asked for.  What
    they read is stored, so both results are of the same reading.
    """

    names = [*found.columns, "content"]
    at_path = names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                read = [content_of(p) for p in part.column(at_path).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(read, pa.binary())], names)

    kind = T.StructType([*found.schema.fields, T.StructField("content", T.BinaryType())])
    tasks = max(1, -(-found.count() // files))
    read = stored(found.repartition(tasks, "path").mapInArrow(run, kind), "documents")
    texts = read.where("content is not null").withColumn("text", decode_utf8("content")).drop("content")
    return texts, read.where("content is null").drop("content")


def content_of(path: str) -> bytes | None:
    try:
        with open(path, "rb") as file:
            return file.read()
    except OSError:
        return None


def per_project(found: DataFrame) -> DataFrame:
    """Files and bytes of each project, and of all (project null)."""
    return found.rollup("project").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))

