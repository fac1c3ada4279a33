"""Chunking, commits, embedding plans and text columns."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.functions import text, vectors
from lorekeep.functions.patterns import left_out_of_excerpts, looks_secret
from lorekeep.operators import batches, chunking, commits, embedding


def headings(body):
    return [h for h, b in chunking.sections(body) if b]


@pytest.mark.parametrize(
    ("body", "paths"),
    [
        ("# A\n\nx\n\n## B\n\ny\n\n## C\n\nz", ["A", "A > B", "A > C"]),
        ("preamble text here\n\n# Later\n\nbody", ["", "Later"]),
        ("```python\n# not a heading\n```", [""]),
        ("# A\na\n### B\nb\n### C\nc\n### D\nd\n## E\ne", ["A", "A > B", "A > B > C", "A > B > D", "A > E"]),
        ("# T\n~~~\n```\n# x\n~~~\n# U\n", ["T", "U"]),
        ("  ```\n# in\n```js\n# out", ["", "out"]),
        ("# Closed ##\ny", ["Closed"]),
        (" \n\t", []),
    ],
)
def test_sections(body, paths):
    assert headings(body) == paths


def test_empty_sections_and_floor(spark):
    docs = spark.createDataFrame(
        [("P", "a.md", "/a.md", 1.0, "# Empty\n\n# Real\n\n" + "actual content " * 9), ("P", "b.md", "/b.md", 1.0, "@AGENTS.md\n\n# Long\n\n" + "word " * 700),
         ("P", "c.md", "/c.md", 1.0, None), ("P", "d.md", "/d.md", 1.0, "")],
        "project string, rel_path string, path string, mtime double, text string",
    )
    rows = chunking.chunk_documents(docs).orderBy("rel_path", "chunk_index").collect()
    assert [(r.rel_path, r.heading_path) for r in rows][:1] == [("a.md", "Real")]
    long = [r for r in rows if r.rel_path == "b.md"]
    assert [r.chunk_index for r in long] == list(range(len(long))) and len(long) > 2
    assert all(r.heading_path == "Long" and r.embed_text.startswith(("Long\n\n", "# Long")) for r in long)
    assert rows[0].embed_text == rows[0].text and {r.rel_path for r in rows} == {"a.md", "b.md"}
    with pytest.raises(ValueError, match="smaller"):
        chunking.chunk_documents(docs, size=100, overlap=100)


@pytest.mark.parametrize("whole", ["x" * 5000, "字" * 2100, "👩‍👩‍👧" * 600])
def test_unbroken_texts_are_cut_hard(whole):
    pieces = list(chunking.overlapping(whole))
    assert all(len(p) <= 1500 for p in pieces)
    assert "".join([pieces[0], *pieces[1:]]) == whole


@pytest.mark.parametrize("seed", range(30))
def test_pieces_cover_the_text(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé字") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    whole = "".join(w + rng.choice([" ", " ", " ", "\n", "\n\n", "  "]) for w in words).strip()
    at = 0
    for piece in chunking.overlapping(whole, 200, 40):
        assert len(piece) <= 200
        found = whole.index(piece, max(0, at - 40))
        assert whole[at:found].strip() == "" or found <= at
        assert found == 0 or whole[found - 1].isspace() or not whole[found].isspace()
        at = found + len(piece)
    assert at == len(whole)


def test_batches(spark):
    def plan(sizes, most=100, tokens=12_000):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(sizes)], "n long, tokens long")
        got = embedding.plan_batches(rows, [], ["n"], most, tokens).orderBy("n").collect()
        return [sum(r.batch == b for r in got) for b in range(1, max(r.batch for r in got) + 1)]

    assert plan([1000] * 5, tokens=2500) == [2, 2, 1]
    assert plan([1] * 250) == [100, 100, 50]
    assert plan([10, 5000, 10], tokens=1000) == [1, 1, 1]
    assert len(plan([301] * 100)) == 3


def test_batches_of_groups_and_nothing(spark):
    rows = spark.createDataFrame([(g, i, 600) for g in "ab" for i in range(5)], "g string, n long, tokens long")
    got = {(r.g, r.n): r.batch for r in embedding.plan_batches(rows, ["g"], ["n"], 100, 1200).collect()}
    assert got == {(g, i): i // 2 + 1 for g in "ab" for i in range(5)}
    assert embedding.plan_batches(rows.limit(0), ["g"], ["n"]).count() == 0


def one_by_one(rows, most, limit):
    """The plan by a walk in order; rows are (group, order, tokens)."""
    plan, now = {}, None
    for group, n, tokens in sorted(rows):
        if group != now:
            now, number, count, total = group, 1, 0, 0
        elif count >= most or (limit is not None and total + tokens > limit):
            number, count, total = number + 1, 0, 0
        count, total = count + 1, total + tokens
        plan[group, n] = number
    return plan


@pytest.mark.parametrize(("most", "limit", "chunk", "fan"), [(7, 40, 8, 2), (3, None, 5, 3), (10, 25, 64, 256), (100, 300, 128, 2)])
def test_batches_over_many_chunks(spark, most, limit, chunk, fan, monkeypatch):
    monkeypatch.setattr(batches, "FAN", fan)
    rng = random.Random(most)
    groups = ["a"] * 300 + ["b"] * 3 + ["c"] + ["d"] * 200 + ["é"] * 90
    rows = [(g, i, rng.choice([0, 1, 5, 9, 60])) for i, g in enumerate(groups)]
    frame = spark.createDataFrame(rows, "g string, n long, tokens long").repartition(5)
    got = batches.plan_batches(frame, ["g"], ["n"], most, limit, chunk)
    assert got.columns == ["g", "n", "tokens", "batch"]
    assert {(r.g, r.n): r.batch for r in got.collect()} == one_by_one(rows, most, limit)
    assert got.count() == len(rows)


def test_batches_of_one_large_group(spark):
    """A million rows of one group: every task has a chunk, and the plan equals a walk."""
    rows = spark.range(1_000_000, numPartitions=8).select("id", (F.xxhash64("id") % 200).alias("tokens"), F.spark_partition_id().alias("kp"))
    planned = batches.plan_batches(rows.withColumn("tokens", F.abs("tokens")), [], ["id"], 100, 5_000, chunk=50_000)
    got = planned.orderBy("id").select("tokens", "batch").toPandas()
    number, count, total, want = 1, 0, 0, []
    for tokens in got["tokens"].tolist():
        if count >= 100 or (count and total + tokens > 5_000):
            number, count, total = number + 1, 0, 0
        count, total = count + 1, total + tokens
        want.append(number)
    assert got["batch"].tolist() == want and number > 10_000
    assert planned.columns == ["id", "tokens", "kp", "batch"]


def test_keyword_vectors(spark):
    rows = spark.createDataFrame([(1, "Caching the caching"), (2, "the of"), (3, None), (4, "caching")], "id long, text string")
    got = {r.id: r.embedding for r in embedding.keyword_vectors(rows, "id", "text").collect()}
    assert got[1] == got[4] and got[1][235] == 1.0 and sum(got[1]) == 1.0
    assert sum(got[2]) == 0 and sum(got[3]) == 0


def test_keyword_vectors_of_texts_in_pieces(spark):
    words = ["alpha", "é", "x9", "\n", "the", "b" * 1500, "𝒳" * 700]
    texts = [" ".join(words[i % 7] for i in range(n)) for n in (0, 1, 6, 700, 3)] + ["caching " * 40_000, " " * 5_000, None]
    rows = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(texts)], "id long, project string, text string").coalesce(1)
    got = {r.id: (r.project, r.embedding) for r in embedding.keyword_vectors(rows, "id", "text", carry=["project"]).collect()}
    counts = {i: {} for i in range(len(texts))}
    for r in embedding.keyword_counts(rows, "id", "text").collect():
        counts[r.id][r.dimension] = r.weight
    for i in counts:
        size = sum(n * n for n in counts[i].values()) ** 0.5
        assert got[i] == (f"p{i}", pytest.approx([counts[i].get(d, 0) / (size or 1) for d in range(256)]))


def test_keyword_vectors_hold_little(spark, monkeypatch):
    rows = spark.createDataFrame([], "id long, text string")
    asked = {}

    def taken(self, function, schema):
        asked["function"], asked["source"] = function, self
        return self

    with monkeypatch.context() as patch:
        patch.setattr(type(rows), "mapInArrow", taken)
        embedding.keyword_vectors(rows, "id", "text")
    schema = to_arrow_schema(asked["source"].schema)

    def batches():
        for b in range(20):
            values = {"id": [b], "text": [" ".join(f"w{b}x{i}" for i in range(20_000))], "_begin": [True]}
            yield pa.RecordBatch.from_arrays([pa.array(values.get(f.name, values["text"]), f.type) for f in schema], schema=schema)

    tracemalloc.start()
    made = sum(batch.num_rows for batch in asked["function"](batches()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 20 and most < 32e6  # a table of all 400,000 words has 41 MB

    # A long text comes in many rows, each with little of it.
    long_text = spark.createDataFrame([(1, "word " * 100_000)], "id long, text string")
    with monkeypatch.context() as patch:
        patch.setattr(type(rows), "mapInArrow", taken)
        embedding.keyword_vectors(long_text, "id", "text")
    source = asked["source"]
    assert source.select(F.max(F.length(source.columns[-1]))).first()[0] < 2_000


class Remote:
    def __init__(self, problems=()):
        self.calls, self.waits, self._problems = [], [], list(problems)

    def __call__(self, texts, query):
        if self._problems and (problem := self._problems.pop(0)):
            raise problem
        self.calls.append(len(texts))
        return [[float(len(t)), 0.0] for t in texts]


def remote(spark, **kw):
    service = Remote(kw.pop("problems", ()))
    return service, embedding.RemoteEmbedder(spark, "space", service, sleep=service.waits.append, **kw)


def test_remote_embedder_batches_and_waits(spark):
    saved = []
    service, embedder = remote(spark, save=lambda rows: saved.append(rows.count()))
    texts = spark.createDataFrame([(f"k{i:03}", "word") for i in range(230)], "key string, embed_text string")
    got = embedder.documents(texts).collect()
    assert len(got) == 230 and {tuple(r.vector) for r in got} == {(1.0, 0.0)}
    assert service.calls == [100, 100, 30] == saved and service.waits == [60, 60]


def test_remote_embedder_errors(spark):
    service, embedder = remote(spark, problems=[embedding.RateLimited("slow", 5), ConnectionError(), None])
    assert embedder.query("four") == [1.0, 0.0] and service.waits == [6, 2]
    for problem in (embedding.DailyQuotaExceeded("today"), embedding.RateLimited("bare")):
        with pytest.raises(type(problem)):
            remote(spark, problems=[problem])[1].query("x")


def test_cache_and_pending(spark):
    chunks = spark.createDataFrame([("h1", "a", 0), ("h2", "b", 1), ("h2", "b", 2), ("h3", "c", 3)], "content_hash string, embed_text string, n int")
    cache = spark.createDataFrame([("s|h1", [1.0], 1), ("s|h1", [2.0], 2)], "key string, vector array<double>, written int")
    looked_up = embedding.with_cache(chunks, embedding.latest(cache), "s")
    assert looked_up.where("content_hash = 'h1'").first().vector == [2.0]
    assert tuple(embedding.embedding_plan(looked_up).first()) == (1, 2)
    assert sorted((r.key, r.first_seen.n) for r in embedding.pending(looked_up, ["n"]).collect()) == [("s|h2", 1), ("s|h3", 3)]


COMMITS = "project string, path string, hash string, parents array<string>, author_name string, author_email string, author_date string, subject string, body string, files array<string>"


def commit(n, subject="Say more", parents=("p",), name="Me", email="me@x.y", body="", files=("a.py",)):
    return ("P", "/p", f"{n:040x}", list(parents), name, email, "2026-07-02T01:00:00+05:30", subject, body, list(files))


def test_commit_classes(spark):
    rows = [
        commit(1, parents=("p", "q"), subject="chore: bump version to 1.1.0"), commit(2, "chore: bump version to 1.1.0"), commit(3, "v2.3.4"),
        commit(4, "docs: add hook and bump version to 1.0.4"), commit(5, name="Else", email="e@x"), commit(6, name=" mE ", email="e@x"),
        commit(7, "feat: add 1.0.8 changelog section"), commit(8, "chore(release): bump version to 2.0.0", name="Else", email="e@x"),
    ]
    frame = spark.createDataFrame(rows, COMMITS)
    got = {int(r.hash, 16): r["class"] for r in commits.classified(frame, ["ME@x.y"], ["me"]).collect()}
    assert got == {1: "merge", 2: "version bump", 3: "version bump", 4: "kept", 5: "other author", 6: "kept", 7: "kept", 8: "version bump"}
    assert commits.class_counts(commits.classified(frame, [], []).where("hash like '%4'")).first().asDict() == {"merges": 0, "version_bumps": 0, "other_authors": 1, "kept": 0}


DIFF = """diff --git a/app.py b/app.py
index 1..2 100644
--- a/app.py
+++ b/app.py
@@ -1,2 +1,2 @@
--- old note
+new line
+API_KEY=abc123
+API_KEY = ""
diff --git a/uv.lock b/uv.lock
--- a/uv.lock
+++ b/uv.lock
@@ -1 +1 @@
+locked
diff --git a/x.pem b/x.pem
deleted file mode 100644
--- a/x.pem
+++ /dev/null
@@ -1 +0,0 @@
-gone"""


def test_diff_excerpts(spark):
    frame = spark.createDataFrame([("h", DIFF), ("e", ""), ("b", "diff --git a/i b/i\nBinary files differ")], "hash string, diff string")
    got = {r.hash: r.excerpt for r in commits.diff_excerpts(frame).collect()}
    assert got == {"h": '@@ -1,2 +1,2 @@\n--- old note\n+new line\n+API_KEY = ""'}
    long = spark.createDataFrame([("h", "diff --git a/a b/a\n@@ -1 +1 @@\n" + "\n".join("+" + "x" * 50 for _ in range(90)))], "hash string, diff string")
    assert len(commits.diff_excerpts(long).first().excerpt) == 800


def test_excerpts_of_one_long_diff_and_of_clones(spark):
    """A million lines stream through one task; diffs that repeat a key, are null or failed do not run into each other."""
    numbers = spark.range(0, 1_000_000, 1, 1)
    body = F.when(F.col("id") % 1000 == 0, F.concat(F.lit("diff --git a/yarn.lock b/f"), F.col("id"))).when(F.col("id") % 1000 == 1, "@@ -1 +1 @@")
    lines = numbers.select(F.lit("h").alias("hash"), F.coalesce(body, F.concat(F.lit("+"), F.col("id"))).alias("raw"))
    plan = commits.excerpts(lines, chars=5_000_000)
    assert not any(word in plan._jdf.queryExecution().toString() for word in ("Exchange", "Sort", "Window"))
    got = plan.first().excerpt
    want = [r.raw for r in lines.collect() if not r.raw.startswith("diff")]
    assert got == "\n".join(want)[:5_000_000]
    twice = spark.createDataFrame([("h", "+a\r\n+b"), ("h", "+a\r\n+b"), ("n", None), (None, "-c\u2028 d\n@@ e")], "hash string, diff string")
    assert sorted(commits.diff_excerpts(twice.coalesce(1)).collect(), key=str) == [("h", "+a\n+b"), ("h", "+a\n+b"), (None, "-c\n@@ e")]
    failed = spark.createDataFrame([("/r", "h", "+a\r", None), ("/r", "h", None, "lost"), ("/s", "h", "+b", None)], "path string, hash string, raw string, problem string")
    got = commits.excerpts(commits.git_lines(failed.coalesce(1)), ("path", "hash")).collect()
    assert sorted(got, key=str) == [("/r", "h", "+a", None), ("/r", "h", None, "lost"), ("/s", "h", "+b", None)]


def test_secret_lines_and_left_out_files(spark):
    lines = ["AIza" + "a" * 35, "-----BEGIN RSA PRIVATE KEY-----", "API_KEY=abc123", "password: x", "https://u:p@h", "$2b$12$" + "a" * 53, 'API_KEY = ""', "https://example.com/path@v2"]
    rows = spark.createDataFrame([(line,) for line in lines], "line string")
    assert [r[0] for r in rows.select(looks_secret(F.col("line"))).collect()] == [True] * 6 + [False] * 2
    names = spark.createDataFrame([(n,) for n in ("a/uv.lock", "b.PNG", ".env.local", "k.pem", "main.py", "png")], "n string")
    assert [r[0] for r in names.select(left_out_of_excerpts(F.col("n"))).collect()] == [True] * 4 + [False] * 2


def test_commit_chunks(spark):
    rows = [commit(1, "Subject", body="b" * 10), commit(2, "Other subject", body="words " * 500), commit(3, "tiny", files=()), commit(4, "Root", parents=())]
    diffs = spark.createDataFrame([(rows[0][2], DIFF), (rows[3][2], DIFF)], "hash string, diff string")
    got = commits.commit_chunks(spark.createDataFrame(rows, COMMITS), commits.diff_excerpts(diffs)).orderBy("commit", "chunk_index").collect()
    one = [r for r in got if r.commit == rows[0][2]]
    assert len(one) == 1 and "Diff excerpt:\n@@" in one[0].text and "Files changed:\na.py" in one[0].text
    assert one[0].embed_text.startswith(f"P · commit {rows[0][2][:7]} · 2026-07-02\nSubject")
    more = [r for r in got if r.commit == rows[1][2]]
    assert len(more) > 1 and all("\nOther subject" in r.embed_text for r in more) and [r.chunk_index for r in more] == list(range(len(more)))
    assert not any("Diff excerpt" in r.text for r in got if r.commit == rows[3][2])
    assert not [r for r in got if r.commit == rows[2][2]]


def test_text_columns(spark):
    def one(column, value, kind="string"):
        return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]

    v = F.col("v")
    assert one(text.lines("v"), "a\r\nb\u2028c\n") == ["a", "b", "c"]
    assert one(text.squeeze("v"), " a\u3000\x1c b\n") == "a b"
    assert one(text.fold("v"), "STRASSE  Straße") == "strasse strasse"
    assert one(text.estimate_tokens("v"), "abcde") == 2
    assert one(text.human_bytes("v"), 1536, "long") == "1.5 KB" and one(text.duration("v"), 61, "long") == "~2 min"
    assert one(text.day("v"), "2026-07-02T01:00+05:30") == "2026-07-02" and one(text.day("v"), "2026-13-02") == "unknown"
    assert one(text.neutralise("v"), "<<<END") == "< <<END"
    assert one(text.decode_utf8("v"), b"a\xff\r\nb", "binary") == "a\ufffd\nb"
    assert one(text.matches_any("v", ["AGENTS*.md", "*[!a]x.md"]), "agents_2.MD") is True
    assert one(text.matches_any("v", ["a.md"]), "axmd") is False
    assert one(vectors.unit(v), [3.0, 4.0], "array<double>") == [0.6, 0.8] and one(vectors.unit(v), [0.0], "array<double>") == [0.0]


def test_folding_equals_python_over_all_code_points(spark):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["x" + "".join(every[at : at + 50]) + "x" for at in range(0, len(every), 50)] + [f"a{c}b" for c in every if len(c.casefold()) > 1] + ["ΟΔΟΣ Straße", "", None]
    rows = spark.createDataFrame([(t, None if t is None else t.casefold()) for t in texts], "t string, want string")
    wrong = rows.where(~text.casefold("t").eqNullSafe(F.col("want")))
    assert wrong.count() == 0
    assert rows.where(~text.fold_texts("t").eqNullSafe(text.fold("t"))).count() == 0
    assert [r[0] for r in spark.createDataFrame([("  GROẞE \n ΣΑΣ ",)], "t string").select(text.fold("t")).collect()] == ["grosse σασ"]
