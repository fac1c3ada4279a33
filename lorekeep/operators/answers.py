"""Prompts, model replies and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import neutralise, strip

REPLY = "struct<answerable:boolean,answer:string,citations:array<string>>"


def passage_block(number: Column, project: Column, rel_path: Column, heading: Column, text: Column) -> Column:
    """A passage fenced so that its text cannot end it."""
    n = number.cast("string")
    shown = F.when(F.coalesce(heading, F.lit("")) == "", F.lit("(no heading)")).otherwise(heading)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("<<<PASSAGE "), n, F.lit(">>>")),
        F.concat(F.lit("project: "), project),
        F.concat(F.lit("file: "), rel_path),
        F.concat(F.lit("section: "), shown),
        F.lit("---"),
        neutralise(text),
        F.concat(F.lit("<<<END PASSAGE "), n, F.lit(">>>")),
    )


def prompts(rules: str, questions: DataFrame, passages: DataFrame) -> DataFrame:
    """``(query_id, prompt)``: rules, question and the passages in rank order."""
    block = passage_block(F.col("rank"), F.col("project"), F.col("rel_path"), F.col("heading_path"), F.col("text"))
    blocks = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    asked = questions.join(blocks, "query_id", "left")
    joined = F.array_join(F.transform("b", lambda x: x["block"]), "\n")
    return asked.select(
        "query_id",
        F.concat_ws("\n", F.lit(rules), F.concat(F.lit("Question: "), F.col("question")), F.lit(""), F.lit("Passages:"), F.lit(""), joined).alias("prompt"),
    )


def unfenced(text: Column) -> Column:
    """A reply without the code fence that models like to put around JSON."""
    bare = strip(text)
    inner = F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n", ""), r"(?s)```(?:(?!```).)*$", "")
    return F.when(bare.startswith("```"), strip(inner)).otherwise(bare)


def parse_replies(replies: DataFrame, text_col: str = "reply") -> DataFrame:
    """``replies`` with ``raw`` (answerable, answer, citations as integers) or ``problem``.

    Nothing is coerced: a number for a text, ``true`` for a number or a missing
    field is a problem.  Citations may be numbers or texts of digits.
    """
    # Columns of their own, so that each reply is parsed once.
    said = replies.withColumn("_json", unfenced(F.col(text_col))).withColumn("_value", F.try_parse_json("_json"))
    names = ("answerable", "answer", "citations")
    said = said.withColumns({f"_{k}": F.try_variant_get("_value", f"$.{k}", "variant") for k in names})
    value, fields = F.col("_value"), {k: F.col(f"_{k}") for k in names}
    kind = F.schema_of_variant(value)
    kinds = {k: F.schema_of_variant(v) for k, v in fields.items()}
    cited = F.try_variant_get(fields["citations"], "$", "array<variant>")
    good = F.forall(
        cited,
        lambda c: F.coalesce(
            (F.schema_of_variant(c) == "BIGINT")
            | ((F.schema_of_variant(c) == "STRING") & strip(F.try_variant_get(c, "$", "string")).rlike("^[0-9]+$")),
            F.lit(False),
        ),
    )
    missing = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(k)) for k, v in fields.items()]))
    problem = (
        F.when(F.coalesce(F.col("_json"), F.lit("")) == "", "an empty reply")
        .when(value.isNull(), "no JSON")
        .when(~kind.startswith("OBJECT"), "no object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(kinds["answerable"] != "BOOLEAN", "answerable is not true or false")
        .when(kinds["answer"] != "STRING", "answer is not a text")
        .when(~kinds["citations"].startswith("ARRAY"), "citations is not a list")
        .when(~good, "citations are not passage numbers")
    )
    raw = F.struct(
        F.try_variant_get(fields["answerable"], "$", "boolean").alias("answerable"),
        F.try_variant_get(fields["answer"], "$", "string").alias("answer"),
        F.transform(cited, lambda c: strip(F.try_variant_get(c, "$", "string")).cast("int")).alias("citations"),
    )
    return said.withColumn("problem", problem).withColumn("raw", F.when(F.col("problem").isNull(), raw)).drop("_json", "_value", *(f"_{k}" for k in names))


def citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """``(query_id, number, ...)``: each valid citation once, by number; numbers of no passage fall away."""
    cited = answers.select("query_id", F.explode(F.array_distinct("citations")).alias("number"))
    return cited.join(passages.withColumnRenamed("rank", "number"), ["query_id", "number"])


def verdicts(answers: DataFrame, valid: DataFrame) -> DataFrame:
    """``(query_id, verdict, answer)``: answered, refused, or uncited; only an answered text is kept."""
    counted = valid.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = answers.join(counted, "query_id", "left")
    said = F.coalesce(F.col("answerable"), F.lit(False)) & (strip("answer") != "")
    verdict = F.when(~said, "refused").when(F.coalesce("n", F.lit(0)) == 0, "uncited").otherwise("answered")
    return rows.select("query_id", verdict.alias("verdict"), F.when(verdict == "answered", F.col("answer")).alias("answer"))


def changed_since_indexed(now: Column, indexed: Column, source: Column) -> Column:
    """Whether a file is newer than its chunk by over a second; never for commits or files that are gone."""
    return (source != "git") & F.coalesce(now - indexed > 1.0, F.lit(False))
