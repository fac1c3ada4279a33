"""Question suites for evaluation."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluation import QUESTION

VERSION = 2
_NEEDED = {"id", "category", "text", "expected_projects"}
_MORE = {"also_in_corpus", "notes", "expected_text", "lure_project", "lure_text"}


class SuiteError(ValueError):
    """A suite that must not be scored."""


def parse_suite(text: str, name: str = "suite") -> list[dict]:
    try:
        said = tomllib.loads(text)
    except tomllib.TOMLDecodeError as problem:
        raise SuiteError(f"{name}: {problem}") from problem
    if said.get("version") != VERSION:
        raise SuiteError(f"{name}: version must be {VERSION}")
    rows, seen = [], set()
    for n, question in enumerate(said.get("question", []), 1):
        keys = set(question)
        if missing := _NEEDED - keys:
            raise SuiteError(f"{name}: question {n} lacks {', '.join(sorted(missing))}")
        if unknown := keys - _NEEDED - _MORE:
            raise SuiteError(f"{name}: question {n} has unknown {', '.join(sorted(unknown))}")
        for key, value in question.items():
            lists = key in ("expected_projects", "also_in_corpus", "expected_text")
            fits = isinstance(value, list) and all(isinstance(v, str) and v.strip() for v in value) if lists else isinstance(value, str)
            if not fits:
                raise SuiteError(f"{name}: {key} of question {n} has the wrong type")
        if question["id"] in seen:
            raise SuiteError(f"{name}: id {question['id']!r} is there twice")
        if ("lure_project" in keys) != ("lure_text" in keys):
            raise SuiteError(f"{name}: question {n} needs both a lure's project and its text")
        if "lure_text" in keys and question["expected_projects"]:
            raise SuiteError(f"{name}: question {n} has a lure but expects an answer")
        seen.add(question["id"])
        rows.append(question)
    if not rows:
        raise SuiteError(f"{name}: no questions")
    return rows


def read_suite(spark: SparkSession, path: Path) -> DataFrame:
    names = [part.split()[0] for part in QUESTION.split(", ")]
    rows = parse_suite(Path(path).read_text(encoding="utf-8"), Path(path).name)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], QUESTION)
