"""The command line: discover, index, search, ask, eval, serve and scan."""

from __future__ import annotations

import argparse
import json
import shlex
import subprocess
import sys
from dataclasses import replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import citation, human_bytes, snippet
from ..operators.embedding import KeywordEmbedder, refusal
from ..operators.terms import Terms
from ..sources import documents, settings, suites
from . import runs, scan
from .index import Index
from .server import Server
from .service import Service


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lorekeep", description=__doc__)
    parser.add_argument("--config", type=Path, default=Path("config.toml"))
    parser.add_argument("--index", default="index")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("discover").add_argument("--json", action="store_true")
    build = commands.add_parser("index")
    build.add_argument("--dry-run", action="store_true")
    build.add_argument("--accept-new", action="append", default=[], metavar="NAME")
    build.add_argument("--accept-all-new", action="store_true")
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("-k", type=int, default=5, choices=range(1, 51), metavar="1-50")
    find.add_argument("--project")
    answer = commands.add_parser("ask")
    answer.add_argument("question")
    answer.add_argument("-k", type=int, default=10, choices=range(1, 51), metavar="1-50")
    answer.add_argument("--project")
    answer.add_argument("--show-context", action="store_true", help="print the passages that the prompt holds")
    answer.add_argument("--model", required=True, metavar="COMMAND", help="gets the prompt on its input and prints the reply")
    score = commands.add_parser("eval")
    score.add_argument("--fixture", type=Path, required=True)
    score.add_argument("--out", type=Path)
    score.add_argument("-k", type=int, default=10, choices=range(1, 51), metavar="1-50")
    commands.add_parser("serve", help="answer a client's requests, one a line, until its input ends")
    leak = commands.add_parser("scan")
    leak.add_argument("--repo", default=".")
    which = leak.add_mutually_exclusive_group()
    which.add_argument("--rev", default="HEAD")
    which.add_argument("--worktree", action="store_true")
    leak.add_argument("--upstream", default="origin/main")
    leak.add_argument("--ignore-accepted", action="store_true", help="report accepted hits as new")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = arguments(argv)
    spark = spark or SparkSession.builder.appName("lorekeep").getOrCreate()
    local = given.config.with_name(given.config.stem + ".local.toml")
    try:
        if given.command == "scan":
            return _scan(spark, given, settings.scan_settings(local))
        found = settings.load([given.config, local])
        if given.command == "discover":
            return _discover(spark, found, given.json)
        index, embedder = Index(spark, given.index), KeywordEmbedder(spark)
        if given.command == "index":
            print(json.dumps(runs.build(spark, found, index, embedder, given.accept_new, given.accept_all_new, given.dry_run)))
            return 0
        if given.command == "search":
            rows = runs.search(index, embedder, given.query, given.k, given.project)
            shown = rows.select("rank", "score", citation("project", "rel_path", "heading_path").alias("where"), snippet("text").alias("text"))
            for row in shown.orderBy("rank").collect():
                print(f"{row['rank']}. [{row['score']:.3f}] {row['where']}\n   {row['text']}")
            return 0
        if given.command == "serve":
            Server(Service(index, embedder, found)).serve(sys.stdin, sys.stdout)
            return 0
        if given.command == "ask":
            return _ask(index, embedder, given)
        return _evaluate(spark, index, embedder, given)
    except (settings.SettingsError, suites.SuiteError, ValueError, RuntimeError) as problem:
        print(problem, file=sys.stderr)
        return 2


def _scan(spark: SparkSession, given: argparse.Namespace, held: settings.ScanSettings) -> int:
    """Reports hits by place and kind; names that hold a private term are masked."""
    if given.ignore_accepted:
        held = replace(held, accepted=())
    rev = None if given.worktree else given.rev
    hits, binary, stale = scan.scan_repository(spark, given.repo, held, rev)
    commits = scan.scan_commits(spark, given.repo, held, given.upstream, rev or "HEAD")
    mask = Terms(held.all_terms).mask

    def place(file: str, of_commit: bool) -> str:
        commit, _, name = file.partition(":") if of_commit else ("", "", file)
        return " ".join(x for x in (commit[:7], mask(name) or "message") if x)

    for rows, of_commit in ((hits, False), (commits.hits, True)):
        for row in rows.orderBy("file", "line").toLocalIterator():
            kind = "PLACEHOLDER" if row["kind"] == "placeholder email" else row["state"].upper()
            print(f"{kind} {place(row['file'], of_commit)}:{row['line']}: {row['kind']}")
    for rows, of_commit in ((binary, False), (commits.binary, True)):
        for row in rows.toLocalIterator():
            print(f"BINARY {place(row['file'], of_commit)}: not read")
    for row in commits.merges.toLocalIterator():
        print(f"MERGE {row['hash'][:7]}: only its message is read")
    for row in stale.toLocalIterator():
        print(f"STALE accepted entry for {mask(row['file'])}: {row['found']} lines, not {row['count']}")
    return scan.exit_code(hits, commits.hits, stale=stale)


class GenerationError(RuntimeError):
    """No reply, and why."""


class Command:
    """A generator that runs a command for each prompt, once.

    A command that was refused for its rate may print the refusal as JSON, with
    its code; it is told apart as any service's.
    """

    def __init__(self, words: str):
        self._words = shlex.split(words)

    def generate(self, prompt: str) -> str:
        try:
            done = subprocess.run(self._words, input=prompt.encode(), capture_output=True)
        except OSError as problem:
            raise GenerationError(f"the model command cannot be run: {problem}") from problem
        said = done.stdout.decode("utf-8", "replace")
        if done.returncode:
            if refused := self._refused(said):
                raise refused
            last = done.stderr.decode("utf-8", "replace").strip().rpartition("\n")[2]
            raise GenerationError(f"the model command ended with {done.returncode}: {last}")
        if not said.strip():
            raise GenerationError("the model command said nothing")
        return said

    @staticmethod
    def _refused(said: str) -> Exception | None:
        try:
            body = json.loads(said)
            return refusal(int(body["error"]["code"]), body)
        except (ValueError, KeyError, TypeError):
            return None


def _ask(index: Index, embedder: KeywordEmbedder, given: argparse.Namespace) -> int:
    said = runs.ask(index, embedder, Command(given.model), given.question, given.k, given.project)
    if given.show_context:
        for row in said["passages"]:
            print(f"[{row['rank']}] {row['project']} / {row['rel_path']} ({row['score']:.3f})\n{row['text']}\n")
    if said["verdict"] == "answered":
        print(said["answer"], *(f"[{r['number']}] {r['line']}" for r in said["citations"]), sep="\n")
        return 0
    print("The reply cites no passage, so it is not shown." if said["verdict"] == "uncited" else "The passages do not answer this. The nearest:")
    for row in said["passages"][:3]:
        print(f"  {row['project']} / {row['rel_path']}")
    return 1


def _discover(spark: SparkSession, found: settings.Settings, as_json: bool) -> int:
    rows = documents.discover(spark, found)
    if as_json:
        print(json.dumps([r.asDict() for r in rows.collect()], ensure_ascii=False))
        return 0
    totals = documents.per_project(rows).withColumn("size", human_bytes("bytes")).orderBy(F.col("project").isNull(), F.lower("project"))
    got = totals.collect()
    for row in got:
        print(f"{row['project'] or 'all'}: {row['files']} files, {row['size']}")
    return 0 if len(got) > 1 else 1


def _evaluate(spark: SparkSession, index: Index, embedder: KeywordEmbedder, given: argparse.Namespace) -> int:
    outcomes, summary = runs.evaluate(index, embedder, suites.read_suite(spark, given.fixture), given.k)
    said = {
        "generated_at": datetime.now(UTC).isoformat(),
        "summary": summary.first().asDict(),
        "questions": [json.loads(r["j"]) for r in outcomes.orderBy("id").select(F.to_json(F.struct("*")).alias("j")).collect()],
    }
    if given.out:
        given.out.mkdir(parents=True, exist_ok=True)
        stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
        (given.out / f"retrieval-v{suites.VERSION}-{stamp}.json").write_text(json.dumps(said, ensure_ascii=False, indent=1), encoding="utf-8")
    print(json.dumps(said["summary"]))
    return int(said["summary"]["failed"] > 0)


if __name__ == "__main__":
    sys.exit(main())
