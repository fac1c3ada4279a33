"""Scoring retrieval against a suite of questions, all of them in one job.

Questions are ``(id, text, expected_projects, expected_text, lure_project,
lure_text)``; results are the passages of each question with ``rank``,
``project``, ``rel_path``, ``chunk_index``, ``text`` and ``score``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold, fold_texts
from ..sources.shared import stored

QUESTION = (
    "id string, category string, text string, expected_projects array<string>, expected_text array<string>,"
    " lure_project string, lure_text string"
)
CHECKS = ("text", "project", "lure", "no-answer")


def _none(name: str):
    return F.coalesce(F.size(name), F.lit(0)) <= 0


def with_check(questions: DataFrame) -> DataFrame:
    """Which check a question asks for, by the fields that it has."""
    return questions.withColumn(
        "check",
        F.when(~_none("expected_text"), "text")
        .when(F.coalesce("lure_text", F.lit("")) != "", "lure")
        .when(_none("expected_projects"), "no-answer")
        .otherwise("project"),
    ).withColumn("expects_no_answer", _none("expected_projects"))


def needles(questions: DataFrame) -> DataFrame:
    """``(id, n, needle, projects)``: the texts to look for, and the projects whose passages count."""
    wanted = F.when(F.col("check") == "lure", F.array("lure_text")).otherwise(F.col("expected_text"))
    where = F.when(F.col("check") == "lure", F.array("lure_project")).otherwise(F.col("expected_projects"))
    return questions.where(F.col("check").isin("text", "lure")).select(
        "id", where.alias("projects"), F.posexplode(wanted).alias("n", "needle")
    )


def text_matches(looked_for: DataFrame, results: DataFrame) -> DataFrame:
    """``(id, n, needle, rank, project, rel_path, chunk_index)``: the first passage of an expected project with each needle.

    Passage text only, by folded words; the project's name must be spelled as expected.
    """
    hay = results.select("id", "rank", "project", "rel_path", "chunk_index", fold_texts("text").alias("hay"))
    found = (
        looked_for.join(hay, "id")
        .where(F.array_contains("projects", F.col("project")) & F.contains("hay", fold("needle")))
        .withColumn("first", F.row_number().over(W.partitionBy("id", "n").orderBy("rank")))
    )
    return found.where("first = 1").select("id", "n", "needle", "rank", "project", "rel_path", "chunk_index")


def evaluate(questions: DataFrame, results: DataFrame) -> DataFrame:
    """An outcome for each question; ``passed`` is null where no answer is expected."""
    results = stored(results, "results")  # a search is not run again for each of its uses
    asked = with_check(questions)
    by_rank = F.transform(F.array_sort(F.collect_list(F.struct("rank", "project"))), lambda x: x["project"])
    returned = results.groupBy("id").agg(
        F.array_distinct(by_rank).alias("returned"), F.min_by("score", "rank").alias("top_score"), F.count("*").alias("n_results")
    )
    matched = text_matches(needles(asked), results).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "n", "needle", "project", "rel_path", "chunk_index"))).alias("matches")
    )
    nothing = F.array().cast("array<string>")
    rows = asked.join(returned, "id", "left").join(matched, "id", "left").withColumn("returned", F.coalesce("returned", nothing))
    hoped = F.when(F.col("expects_no_answer"), nothing).otherwise(F.col("expected_projects"))
    rows = rows.withColumns({"found": F.array_intersect(hoped, "returned"), "missing": F.array_except(hoped, "returned")})
    hit = F.coalesce(F.size("matches") > 0, F.lit(False))
    return rows.withColumn(
        "passed",
        F.when(F.col("check").isin("text", "lure"), hit).when(F.col("check") == "project", F.size("missing") == 0),
    ).withColumn("reason", reason())


def reason():
    """What the outcome rests on: the first passage that holds a text, the projects seen and unseen, or the best score."""
    first = F.get("matches", F.lit(0))
    held = F.format_string("%s: passage %d, %s/%s, chunk %d", first["needle"], first["rank"], first["project"], first["rel_path"], first["chunk_index"])
    by_text = F.col("check").isin("text", "lure")
    parts = (
        F.when(by_text, F.coalesce(held, F.lit("in no passage"))),
        F.when((F.col("check") == "lure") & first.isNull(), F.concat(F.lit("the trap was not set: "), F.col("lure_text"))),
        F.when(F.size("found") > 0, F.concat(F.lit("projects seen: "), F.array_join("found", ", "))),
        F.when(F.size("missing") > 0, F.concat(F.lit("projects unseen: "), F.array_join("missing", ", "))),
        F.when(F.col("check") == "no-answer", F.coalesce(F.format_string("best score %.3f", "top_score"), F.lit("no passage"))),
    )
    return F.concat_ws("; ", *parts)


def summary(outcomes: DataFrame) -> DataFrame:
    """One row of counts."""
    by_check = [
        expression
        for check in ("text", "project", "lure")
        for expression in (
            F.count_if(F.col("check") == check).alias(f"{check}_scored"),
            F.count_if((F.col("check") == check) & F.col("passed")).alias(f"{check}_passed"),
        )
    ]
    expecting = ~F.col("expects_no_answer")
    return outcomes.agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(F.col("passed").isNull()).alias("no_answer"),
        F.count_if(F.col("expects_no_answer")).alias("traps"),
        *by_check,
        F.count_if(expecting).alias("expecting_an_answer"),
        F.count_if(expecting & (F.size("missing") == 0)).alias("all_expected_found"),
        F.count_if(expecting & (F.size("found") > 0)).alias("any_expected_found"),
    )
