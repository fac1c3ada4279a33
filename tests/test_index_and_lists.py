"""The index of parts, the keyed cache, lists by centroid, and what a remote service refuses."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import embedding, guards, ivf, retrieval
from lorekeep.operators.embedding import DailyQuotaExceeded, RateLimited, RemoteEmbedder
from lorekeep.plans import runs, service
from lorekeep.plans.index import Index
from lorekeep.sources.settings import SettingsError

CHUNK = "chunk_id string, project string, rel_path string, chunk_index int, content_hash string, text string, embedding array<double>"


def rows_of(spark, rows):
    return spark.createDataFrame([(f"{p}/{f}#{i}", p, f, i, t, t, [1.0, float(i)]) for p, f, i, t in rows], CHUNK)


def state(index):
    return {(r.project, r.rel_path, r.chunk_index): r.text for r in index.chunks().collect()}


def files(root):
    return {p: p.stat().st_size for p in Path(root).rglob("*.parquet")}


def scanned(frame):
    """Rows that the scans of a frame that was collected have read."""
    plan = frame._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_updates_write_what_they_bring(spark, tmp_path):
    index, root = Index(spark, f"file://{tmp_path}"), tmp_path
    first = [("A", f"f{n}.md", i, f"old {n} {i}") for n in range(50) for i in range(20)]
    index.replace(rows_of(spark, first), "s", ["Hidden"], ["A"])
    want = {(p, f, i): t for p, f, i, t in first}
    before = files(root)
    # f1 becomes shorter, f2 goes, g is new.
    docs = spark.createDataFrame([("A", "f1.md"), ("A", "f2.md"), ("B", "g.md")], "project string, rel_path string")
    index.upsert(rows_of(spark, [("A", "f1.md", 0, "new"), ("B", "g.md", 0, "g")]), "s", docs)
    want = {k: t for k, t in want.items() if k[1] not in ("f1.md", "f2.md")} | {("A", "f1.md", 0): "new", ("B", "g.md", 0): "g"}
    assert state(index) == want
    new = {p: s for p, s in files(root).items() if p not in before}
    assert all(files(root)[p] == s for p, s in before.items()) and sum(new.values()) < sum(before.values()) / 2
    # By id alone, other chunks of the file stay; a later part wins over an earlier update too.
    index.upsert(rows_of(spark, [("A", "f3.md", 4, "by id"), ("B", "g.md", 0, "g again")]), "s")
    want |= {("A", "f3.md", 4): "by id", ("B", "g.md", 0): "g again"}
    assert state(index) == want and len(index.meta()["parts"]) == 3 and index.meta()["indexed"] == ["A"]
    # A file that was taken away and comes back.
    index.upsert(rows_of(spark, [("A", "f2.md", 0, "back")]), "s", docs.where("rel_path = 'f2.md'"))
    want |= {("A", "f2.md", 0): "back"}
    assert state(index) == want
    index.compact()
    assert state(index) == want and len(index.meta()["parts"]) == 1 and index.projects() == ["A", "B"]


def test_a_lost_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    index = Index(spark, f"file://{tmp_path}")
    index.replace(rows_of(spark, [("A", "a", 0, "x"), ("A", "b", 0, "y")]), "s")
    index.upsert(rows_of(spark, [("A", "a", 0, "z")]), "s")
    want, meta = state(index), index.meta()
    monkeypatch.setattr(index, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.compact()
    assert state(Index(spark, f"file://{tmp_path}")) == want == {("A", "a", 0): "z", ("A", "b", 0): "y"} and index.meta() == meta


def test_many_updates_are_compacted(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}")
    for n in range(4):
        index.upsert(rows_of(spark, [("A", f"f{n % 2}", 0, str(n))]), "s", parts=2)
    assert state(index) == {("A", "f0", 0): "2", ("A", "f1", 0): "3"} and len(index.meta()["parts"]) <= 2


def test_an_excluded_chunk_stops_the_write(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}")
    index.replace(rows_of(spark, [("A", "a", 0, "x")]), "s", ["secret"])
    for write in (lambda: index.replace(rows_of(spark, [("A", "a", 0, "y"), (" Secret", "b", 0, "z")]), "s", ["secret"]),
                  lambda: index.upsert(rows_of(spark, [("SECRET", "b", 0, "z")]), "s")):
        with pytest.raises(Exception, match="excluded project"):
            write()
        assert state(index) == {("A", "a", 0): "x"}
    assert guards.checked(rows_of(spark, [("A", "a", 0, "x")]), ["b"]).count() == 1


def test_a_look_up_reads_the_file_that_has_it(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}")
    names = [f"{random.Random(i).getrandbits(128):032x}" for i in range(4000)]
    rows = spark.createDataFrame([(name, "P", f"f{i // 10:03d}", i % 10, "h", "t", [1.0]) for i, name in enumerate(names)], CHUNK)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.replace(rows, "s")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = len(list(Path(tmp_path).glob("parts/*/*.parquet")))
    assert parts > 2
    found = index.found(names[1234])
    assert [r.rel_path for r in found.collect()] == ["f123"]
    assert 0 < scanned(found) <= 2 * 4000 / parts
    none = index.found("no such id")
    assert none.collect() == [] and scanned(none) <= 4000 / parts
    with pytest.raises(KeyError):
        index.get("none")


def test_only_vectors_that_are_asked_for_move(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}")
    index.save_vectors(spark.range(5000).select(F.concat(F.lit("s|"), F.col("id")).alias("key"), F.array(F.col("id").cast("double")).alias("vector")))
    index.save_vectors(spark.createDataFrame([("s|3", [-3.0])], "key string, vector array<double>"))
    chunks = spark.createDataFrame([("c1", "3"), ("c2", "4"), ("c3", "none"), ("c4", "3")], "chunk_id string, content_hash string")
    found = runs.plan_embedding(index, chunks, "s")
    assert {r.chunk_id: r.vector for r in found.collect()} == {"c1": [-3.0], "c2": [4.0], "c3": None, "c4": [-3.0]}
    moved = embedding.only_matching(index.cache(), found.select("key"), "key")
    assert 3 <= moved.count() <= 10


def exact(vectors, asked, k):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    scores = np.round(unit(asked) @ unit(vectors).T, retrieval.PLACES)
    return [[f"{j:04d}" for j in sorted(range(len(vectors)), key=lambda j: (-line[j], f"{j:04d}"))[:k]] for line in scores]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([c + rng.normal(scale=0.25, size=(150, 16)) for c in rng.normal(size=(12, 16))])
    return np.concatenate([vectors, np.zeros((3, 16))])


def listed(spark, vectors):
    rows = [(f"{i:04d}", "P", f"f{i % 7}", str(i), v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "chunk_id string, project string, rel_path string, content_hash string, embedding array<double>")


def test_lists_find_the_nearest_and_read_less(spark, tmp_path, clustered):
    chunks = listed(spark, clustered)
    lists = ivf.build(chunks, f"file://{tmp_path}", 24)
    asked = np.concatenate([clustered[::20], np.zeros((1, 16)), -clustered[:2]])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, embedding array<double>")
    want = exact(clustered, asked, 10)

    def got(**how):
        rows = lists.search(queries, 10, **how).orderBy("query_id", "rank").collect()
        return [[r.chunk_id for r in rows if r.query_id == q] for q in range(len(asked))]

    assert got(probes=2) == want
    assert got(probes=2, block=8) == want
    near = got(probes=3, exact=False)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near[: len(clustered) // 20], want, strict=False)])
    assert recall >= 0.9
    one = spark.createDataFrame([(0, clustered[5].tolist())], "query_id int, embedding array<double>")
    part = lists.search(one, 10, probes=3, exact=False)
    part.collect()
    assert scanned(part) < len(clustered) / 3


def test_lists_of_odd_tables(spark, tmp_path):
    lists = ivf.build(listed(spark, np.ones((4, 3))), f"file://{tmp_path}/one", 5)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, embedding array<double>")
    assert [r.chunk_id for r in lists.search(queries, 9).orderBy("rank").collect()] == ["0000", "0001", "0002", "0003"]
    assert lists.search(queries.limit(0), 3).count() == 0


def test_recall_of_probes_on_the_table(spark, sf_dir, tmp_path):
    """Every id divisible by 20 against all rows, without the second step."""
    from lorekeep import queries as q

    chunks = q.index_chunks(spark, sf_dir)
    asked = q.index_queries(chunks)
    lists = ivf.build(chunks, f"file://{tmp_path}", 16)
    want = {(r.query_id, r.chunk_id) for r in retrieval.ranked(chunks, asked, 5).collect()}
    got = {(r.query_id, r.chunk_id) for r in lists.search(asked, 5, probes=10, exact=False).collect()}
    assert len(want & got) >= 0.9 * len(want)


def body(*details):
    return {"error": {"code": 429, "details": list(details)}}


def test_refusals_of_a_service():
    day = {"@type": "x/google.rpc.QuotaFailure", "violations": [{"quotaId": "EmbedPerDayPerProject", "quotaValue": "1000"}]}
    minute = {"@type": "x/google.rpc.QuotaFailure", "violations": [{"quotaId": "EmbedPerMinute"}]}
    wait = {"@type": "x/google.rpc.RetryInfo", "retryDelay": "45s"}
    found = embedding.refusal(429, body(wait, day))
    assert isinstance(found, DailyQuotaExceeded) and "1000" in str(found)
    assert embedding.refusal(429, body(minute, wait)).seconds == 45
    assert embedding.refusal(429, body(minute)).seconds == 60
    assert embedding.refusal(429, body({"@type": "RetryInfo", "retryDelay": "soon"})).seconds == 60
    assert embedding.refusal(429, None).seconds is None and embedding.refusal(429, {"error": "no"}).seconds is None
    assert embedding.refusal(500, body(day)) is None


def test_failures_have_tags():
    problems = [runs.SessionCapReached("x"), SettingsError("x"), retrieval.RetrievalError("x"), DailyQuotaExceeded("x"), RateLimited("x"), RateLimited("x", 3.2), OSError("x")]
    tags = [service.tagged(p).split(":")[0] for p in problems]
    assert tags == ["SESSION_CAP", "CONFIG", "NOT_ANSWERABLE_AS_ASKED", "QUOTA_DAILY", "RATE_LIMITED_UNEXPLAINED", "RATE_LIMITED", "SERVICE_ERROR"]


def test_a_stopped_run_asks_for_nothing_twice(spark, tmp_path):
    asked = []

    def call(texts, query):
        if len(asked) == 2 and not getattr(call, "again", False):
            raise DailyQuotaExceeded("no more")
        asked.append(list(texts))
        return [[1.0, 2.0]] * len(texts)

    index = Index(spark, f"file://{tmp_path}")
    chunks = spark.createDataFrame([(str(i), "P", f"f{i}", 0, str(i), f"text {i:03d}") for i in range(330)],
                                   "chunk_id string, project string, rel_path string, chunk_index int, content_hash string, embed_text string")
    waits = []
    embedder = RemoteEmbedder(spark, "far", call, sleep=waits.append)
    with pytest.raises(DailyQuotaExceeded), runs.embedded(index, chunks, embedder):
        pass
    assert list(map(len, asked)) == [100, 100] and index.cache().count() == 200 and len(waits) == 2
    call.again = True
    with runs.embedded(index, chunks, embedder) as whole:
        assert whole.count() == 330
    assert list(map(len, asked)) == [100, 100, 100, 30] and len({t for batch in asked for t in batch}) == 330
