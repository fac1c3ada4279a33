"""What must be approved before anything is indexed or searched.

All comparisons of project names ignore case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import casefold


def _key(column: str):
    return casefold(F.trim(F.col(column)))


def without_excluded(docs: DataFrame, excluded: DataFrame, project: str = "project", name: str = "name") -> DataFrame:
    """Rows whose project is not excluded."""
    return docs.withColumn("_p", _key(project)).join(excluded.select(_key(name).alias("_p")), "_p", "left_anti").drop("_p")


def checked(chunks: DataFrame, excluded: Sequence[str], project: str = "project") -> DataFrame:
    """The same rows; the job that reads one of an excluded project fails, so nothing it writes comes to count."""
    names = sorted({n.strip().casefold() for n in excluded})
    if not names:
        return chunks
    stop = F.raise_error(F.lit("a chunk of an excluded project reached the index")).cast("boolean")
    return chunks.where(F.when(_key(project).isin(names), stop).otherwise(True))


def unmatched(entries: DataFrame, known: DataFrame, name: str = "name", project: str = "project") -> DataFrame:
    """Entries ``(position, name)`` that name nothing; a typing error would otherwise go unseen."""
    keyed = entries.withColumn("_p", _key(name))
    return keyed.join(known.select(_key(project).alias("_p")), "_p", "left_anti").drop("_p")


def new_projects(found: DataFrame, indexed: DataFrame | None, project: str = "project") -> DataFrame:
    """Projects of ``found`` that the last index did not have; without a record, all of them."""
    names = found.select(project).distinct()
    if indexed is None:
        return names
    return names.withColumn("_p", _key(project)).join(indexed.select(_key(project).alias("_p")), "_p", "left_anti").drop("_p")


def acceptance(new: DataFrame, accepted: DataFrame, project: str = "project") -> DataFrame:
    """``(project, problem)``: names accepted though not new, and new names not accepted."""
    a = accepted.select(F.col(project).alias("project"), _key(project).alias("_p"))
    n = new.select(F.col(project).alias("project"), _key(project).alias("_p"))
    surplus = a.join(n.select("_p"), "_p", "left_anti").withColumn("problem", F.lit("not new"))
    open_ = n.join(a.select("_p"), "_p", "left_anti").withColumn("problem", F.lit("not accepted"))
    return surplus.unionByName(open_).select("project", "problem")


def acceptance_problem(new: Sequence[str], accepted: Sequence[str], accept_all: bool, first_run: bool) -> str | None:
    """Why a run must stop, or None: the same rules for a command line's few names."""
    if accepted and accept_all:
        return "name the new projects or accept all of them, not both"
    if accept_all or not new:
        surplus = [a for a in accepted if a.strip().casefold() not in {n.casefold() for n in new}]
        return f"not new: {', '.join(surplus)}" if surplus else None
    known = {n.casefold() for n in new}
    if surplus := [a for a in accepted if a.strip().casefold() not in known]:
        return f"not new: {', '.join(surplus)}"
    given = {a.strip().casefold() for a in accepted}
    if left := [n for n in new if n.casefold() not in given]:
        said = "no index records which projects are approved; " if first_run else ""
        return f"{said}not accepted: {', '.join(left)}"
    return None


def hidden(names: DataFrame, indexed: DataFrame, excluded_at_index: DataFrame) -> DataFrame:
    """``(position, name, project, state)``: the indexed spelling of each hidden project.

    ``state`` is hidden, absent (left out when the index was built, so fine) or unknown.
    """
    asked = names.withColumn("_p", _key("name"))
    spelled = indexed.select("project", _key("project").alias("_p")).distinct()
    spelled = spelled.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy("project"))).where("_n = 1").drop("_n")
    left_out = excluded_at_index.select(_key("project").alias("_p"), F.lit(True).alias("_out")).distinct()
    rows = asked.join(spelled, "_p", "left").join(left_out, "_p", "left")
    state = F.when(F.col("project").isNotNull(), "hidden").when(F.col("_out"), "absent").otherwise("unknown")
    return rows.select("position", "name", "project", state.alias("state"))
