"""Reachability from one log against git, and over many shapes against a plain walk."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import ancestry
from lorekeep.sources import git


def plain(parents, start):
    seen, todo = set(), [start]
    while todo:
        here = todo.pop()
        if here in parents and here not in seen:
            seen.add(here)
            todo += parents[here]
    return seen


@pytest.mark.parametrize(("seed", "at_once"), [(1, 100_000), (2, 0), (3, 0), (4, 100_000)])
def test_reachable_equals_a_walk(spark, seed, at_once):
    rng = random.Random(seed)
    parents = {}
    for n in range(300):
        some = [n - 1] if rng.random() < 0.8 else rng.sample(range(max(0, n - 20), n), min(n, rng.choice([0, 1, 2, 3])))
        parents[n] = [p for p in some if p >= 0] + ([-7] if n == 40 else [])  # one parent that the log lacks
    log = spark.createDataFrame([(n, p) for n, p in parents.items()], "hash long, parents array<long>")
    starts = [299, 150, 7, 0, 12345]
    got = ancestry.reachable(log, spark.createDataFrame([(f"s{s}", s) for s in starts], "tag string, hash long"), at_once=at_once)
    want = {(f"s{s}", h) for s in starts for h in plain(parents, s)}
    rows = [(r.tag, r.hash) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_a_long_line_takes_few_rounds(spark):
    log = spark.range(5000).select(F.col("id").alias("hash"), F.when(F.col("id") > 0, F.array(F.col("id") - 1)).otherwise(F.array().cast("array<long>")).alias("parents"))
    got = ancestry.reachable(log, spark.createDataFrame([("a", 4321)], "tag string, hash long"))
    assert got.count() == 4322
    assert ancestry.reachable(log.limit(0), spark.createDataFrame([("a", 1)], "tag string, hash long")).count() == 0


@pytest.mark.parametrize("at_once", [100_000, 0])
def test_nothing_is_broadcast(spark, monkeypatch, at_once):
    plans, cut = [], ancestry.cut

    def watched(df):
        kept = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept

    monkeypatch.setattr(ancestry, "cut", watched)
    one = F.when(F.col("id") % 10 == 0, F.floor(F.col("id") / 2)).otherwise(F.col("id") - 1)
    log = spark.range(1, 400).select(F.col("id").alias("hash"), F.array(one).alias("parents"))
    found = ancestry.reachable(log, spark.createDataFrame([("a", 399), ("b", 30)], "tag string, hash long"), at_once=at_once)
    assert len(found.collect()) > 10
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("Broadcast" in plan for plan in plans)


def run(where, *args):
    base = ["git", "-c", "user.name=Me", "-c", "user.email=me@x.y", "-c", "commit.gpgsign=false", "-c", "init.defaultBranch=main"]
    return subprocess.run([*base, "-C", str(where), *args], check=True, capture_output=True, text=True).stdout.split()


def test_sides_equal_git_on_criss_cross_merges(spark, tmp_path):
    run(tmp_path, "init")
    commit = lambda: run(tmp_path, "commit", "--allow-empty", "-m", "c")
    commit()
    run(tmp_path, "branch", "other")
    rng = random.Random(5)
    for _ in range(14):
        branch, far = rng.sample(["main", "other"], 2)
        run(tmp_path, "checkout", "-q", branch)
        commit()
        if rng.random() < 0.5:
            run(tmp_path, "merge", "--no-ff", "-m", "m", f"{far}~{rng.choice([0, 1])}" if rng.random() < 0.5 and len(run(tmp_path, "rev-list", far)) > 3 else far)
    run(tmp_path, "checkout", "-q", "main")
    commit()
    heads = {b: run(tmp_path, "rev-parse", b)[0] for b in ("main", "other")}
    repos = spark.createDataFrame([("p", str(tmp_path))], "project string, path string")
    log = git.commits(repos, "main").unionByName(git.commits(repos, "other")).select("hash", "parents").distinct()
    found = ancestry.sides(log, spark.createDataFrame([("p", heads["main"], heads["other"])], "project string, ours string, theirs string")).collect()
    for side, between in (("ours", "other..main"), ("theirs", "main..other")):
        assert {r.hash for r in found if r.side == side} == set(run(tmp_path, "rev-list", between))
    counts = run(tmp_path, "rev-list", "--left-right", "--count", "main...other")
    assert [str(sum(r.side == s for r in found)) for s in ("ours", "theirs")] == counts
    assert len(found) == len(run(tmp_path, "rev-list", "main", "other"))
