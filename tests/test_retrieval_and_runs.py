"""Retrieval, evaluation, answers, guards, leaks, and whole runs over real folders and repositories."""

import io
import json
import os
import random
import re
import subprocess
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lorekeep import queries
from lorekeep.operators import answers, evaluation, guards, leaks, retrieval
from lorekeep.operators.embedding import DailyQuotaExceeded, KeywordEmbedder, RateLimited, RemoteEmbedder
from lorekeep.plans import cli, runs, scan
from lorekeep.plans.index import Index, SpaceMismatch
from lorekeep.plans.server import Server
from lorekeep.plans.service import Service
from lorekeep.sources import documents, git, settings, suites

FOUND = "query_id string, rank int, project string, rel_path string, content_hash string, chunk_id int"


@pytest.mark.parametrize("seed", range(5))
def test_caps_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = [("q", i, rng.choice("AB"), rng.choice("xyz"), str(rng.randint(0, 30)), i) for i in range(1, 41)]
    got = [r.chunk_id for r in retrieval.capped(retrieval.without_duplicates(spark.createDataFrame(rows, FOUND), 40), 10).orderBy("rank").collect()]
    seen, files, projects, want = set(), {}, {}, []
    for _, _, p, f, h, i in rows:
        if h in seen:
            continue
        seen.add(h)
        if files.get((p, f), 0) < 3 and projects.get(p, 0) < 5 and len(want) < 10:
            files[p, f], projects[p] = files.get((p, f), 0) + 1, projects.get(p, 0) + 1
            want.append(i)
    assert got == want


def test_search_in_blocks_is_the_same(spark, sf_dir):
    chunks = queries.index_chunks(spark, sf_dir)
    asked = queries.index_queries(chunks)
    whole = {tuple(r) for r in queries.shown(retrieval.ranked(chunks, asked, 5)).collect()}
    parts = {tuple(r) for r in queries.shown(retrieval.ranked(chunks, asked, 5, block=3)).collect()}
    assert whole == parts and len(whole) == 5 * asked.count()
    assert retrieval.ranked(chunks.limit(0), asked, 5).count() == 0 and retrieval.ranked(chunks, asked.limit(0), 5).count() == 0


def test_refusals():
    for query, k, namespace, empty, problem in (("x", 0, "n", False, "at least 1"), (" ", 1, "n", False, "empty"), ("x", 1, "n", True, "no index"), ("x", 1, None, False, "holds vectors")):
        with pytest.raises((ValueError, retrieval.RetrievalError), match=problem):
            retrieval.check_search(query, k, namespace, "n", empty)


def test_evaluation(spark):
    suite = [("t", "c", "q", ["A", "B"], ["No Such", "two  WORDS"], None, None), ("p", "c", "q", ["A", "C"], None, None, None), ("n", "c", "q", [], None, None, None), ("l", "c", "q", [], None, "B", "lure me")]
    results = [(i, n, p, "f.md", n, t, 1.0 - n / 10) for i in "tpnl" for n, p, t in ((1, "X", "two words"), (2, "B", "says two\nwords"), (3, "A", "other"))]
    frame = spark.createDataFrame(results, "id string, rank int, project string, rel_path string, chunk_index int, text string, score double")
    out = evaluation.evaluate(spark.createDataFrame(suite, evaluation.QUESTION), frame)
    got = {r.id: r for r in out.collect()}
    assert {i: r.passed for i, r in got.items()} == {"t": True, "p": False, "n": None, "l": False}
    assert got["t"].matches[0]["rank"] == 2 and got["p"].missing == ["C"] and got["p"].reason == "projects seen: A; projects unseen: C"
    assert "the trap was not set" in got["l"].reason and got["n"].reason.endswith("best score 0.900")
    counts = evaluation.summary(out).first()
    assert (counts.questions, counts.passed, counts.failed, counts.no_answer, counts.traps) == (4, 1, 2, 1, 2)


def test_suite_files():
    good = 'version = 2\n[[question]]\nid = "a"\ncategory = "c"\ntext = "t"\nexpected_projects = ["A"]\n'
    assert suites.parse_suite(good)[0]["id"] == "a"
    for bad in (good.replace("2", "1"), good + good.split("\n", 1)[1], good.replace("category", "kind"), good.replace('["A"]', '"A"'), "version = 2", good + 'lure_text = "x"\n'):
        with pytest.raises(suites.SuiteError):
            suites.parse_suite(bad)


@pytest.mark.parametrize(
    ("reply", "problem"),
    [
        ('```json\n{"answerable": true, "answer": "x", "citations": [1, "2"]}\n```', None),
        ("", "an empty reply"), ("no", "no JSON"), ("[1]", "no object"), ('{"answer": "x"}', "missing: answerable, citations"),
        ('{"answerable": "yes", "answer": "x", "citations": []}', "answerable is not true or false"),
        ('{"answerable": true, "answer": "x", "citations": [true]}', "citations are not passage numbers"),
        ('{"answerable": true, "answer": "x", "citations": [1.5]}', "citations are not passage numbers"),
        ('{"answerable": true, "answer": "x", "citations": 1}', "citations is not a list"),
    ],
)
def test_replies(spark, reply, problem):
    row = answers.parse_replies(spark.createDataFrame([(reply,)], "reply string")).first()
    assert row.problem == problem
    if problem is None:
        assert row.raw.citations == [1, 2]


def test_citations_and_verdicts(spark):
    said = spark.createDataFrame(
        [("a", True, "x", [2, 2, 9, 0, -1]), ("b", True, "x", [7]), ("c", False, "x", [1]), ("d", True, " ", [1]), ("e", True, "x", [])],
        "query_id string, answerable boolean, answer string, citations array<int>",
    )
    held = spark.createDataFrame([(q, n, "P") for q in "abcde" for n in (1, 2, 3)], "query_id string, rank int, project string")
    valid = answers.citations(said, held)
    assert [(r.query_id, r.number) for r in valid.where("query_id = 'a'").collect()] == [("a", 2)]
    got = {r.query_id: (r.verdict, r.answer) for r in answers.verdicts(said, valid).collect()}
    assert got == {"a": ("answered", "x"), "b": ("uncited", None), "c": ("refused", None), "d": ("refused", None), "e": ("uncited", None)}


def test_acceptance_of_new_projects():
    problem = guards.acceptance_problem
    assert problem([], [], False, False) is None and problem(["A"], ["a"], False, False) is None and problem(["A"], [], True, True) is None
    assert "both" in problem(["A"], ["A"], True, False)
    assert "not accepted: B" in problem(["A", "B"], ["A"], False, False) and "no index" in problem(["A"], [], False, True)
    assert "not new: Z" in problem(["A"], ["A", "Z"], False, False)


def test_leaks(spark):
    lines = [r"see C:\Users\x and /home/me/x, mail you@example.com or me@corp.io", "AIza" + "k" * 35, "http://a/home/x plain", "Alicia and licia", "me@corp.io", None]
    files = spark.createDataFrame([("f", "\n".join(x for x in lines if x))], "file string, text string")
    each = leaks.numbered_lines(files)
    hits = leaks.pattern_hits(each)
    assert sorted((r.line, r.kind) for r in hits.collect()) == [(1, "drive path"), (1, "email"), (1, "home path"), (1, "placeholder email"), (2, "google api key"), (5, "email")]
    terms = leaks.term_hits(each, ["Alicia", "licia"])
    assert sorted((r.line, r.kind, r.match) for r in terms.collect()) == [(4, "term #1", "Alicia"), (4, "term #2", "licia")]
    entries = lambda n: spark.createDataFrame([("f", "ME@corp.io", n, "")], "file string, match string, count int, note string")
    for count, state in ((2, "accepted"), (1, "new"), (3, "new")):
        found = leaks.classified(hits, entries(count)).where("lower(match) = 'me@corp.io'")
        assert {r.state for r in found.collect()} == {state}
    assert leaks.stale(hits, entries(3)).first().found == 2 and leaks.stale(hits, entries(2)).count() == 0
    masked = files.select(leaks.mask_terms(F.lit("xAlicia licia"), ["Alicia", "licia"])).first()[0]
    assert masked == "x[term #1] [term #2]"
    assert [r[0] for r in spark.createDataFrame([(b"a\0b",), (b"ab",)], "c binary").select(leaks.is_binary(F.col("c"))).collect()] == [True, False]


def test_added_lines_are_numbered(spark):
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,0 +5,2 @@\n+five\n+six\n@@ -9 +11 @@\n-old\n+eleven\ndiff --git a/b b/b\n--- /dev/null\n+++ b/b\n@@ -0,0 +1 @@\n+one"
    got = leaks.added_lines(spark.createDataFrame([("h", diff)], "hash string, diff string"))
    assert sorted((r.file, r.line, r.text) for r in got.collect()) == [("a.py", 5, "five"), ("a.py", 6, "six"), ("a.py", 11, "eleven"), ("b", 1, "one")]


def test_added_lines_are_whole(spark):
    text = "x" * 1_000_000 + " jo@corp.io"
    diff = f"diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -0,0 +1 @@\n+{text}"
    got = leaks.added_lines(spark.createDataFrame([("h", diff)], "hash string, diff string"))
    assert [(r.file, r.line, r.text == text) for r in got.collect()] == [("f", 1, True)]


def run(where, *args):
    base = ["git", "-c", "user.name=Me", "-c", "user.email=me@x.y", "-c", "commit.gpgsign=false", "-c", "init.defaultBranch=main"]
    subprocess.run([*base, "-C", str(where), *args], check=True, capture_output=True)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    long = "Caching keeps photos close to the reader of them. " * 4
    for name, body in {
        "Alpha/README.md": f"# Alpha\n\n{long}\n\n## Detail\n\nStorage of old photographs and thumbnails in folders by year.",
        "Alpha/docs/deep/_guide.md": "# Guide\n\nA guide that is long enough to be a chunk of its own, surely so.",
        "Alpha/notes.md": "not wanted", "Alpha/node_modules/README.md": "pruned", "Alpha/.hidden/README.md": "pruned",
        "Alpha/inner/readme.md": "# Inner\n\nThe inner project speaks of tides and moons in some forty letters.",
        "Parent/AI_plan.md": "# Plan\n\nA plan for the parent that speaks of trains and of timetables too.",
        "Secret/README.md": "# Secret\n\nCaching caching caching is what this hidden project is all about.",
        "README.md": "# Top\n\nA file of the root itself, which belongs to the root as a project.",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    for repo in ("Alpha", "Alpha/inner"):
        run(root / repo, "init")
        run(root / repo, "add", "-A")
        run(root / repo, "commit", "-m", "First commit\n\nIt explains at some length what this commit is here for.")
    (root / "Alpha" / "app.py").write_text("print('hello')\nAPI_KEY=abc\nmail = 'real@corp.io'\n")
    run(root / "Alpha", "add", "-A")
    run(root / "Alpha", "commit", "-m", "Add the app")
    run(root / "Alpha", "commit", "--allow-empty", "-m", "v1.2.3")
    return root


def chosen(root, **more):
    return settings.Settings(scan_root=str(root), exclude_projects=("secret",), **more)


def test_discovery(spark, tree):
    found = [(r.project, r.rel_path) for r in documents.discover(spark, chosen(tree)).collect()]
    assert found == [("Alpha", "docs/deep/_guide.md"), ("Alpha", "README.md"), ("inner", "readme.md"), ("Parent", "AI_plan.md"), ("root", "README.md")]
    less = documents.discover(spark, chosen(tree, exclude_paths=("Alpha/docs",)))
    assert less.where("rel_path like 'docs%'").count() == 0
    (tree / "Parent" / "AI_plan.md").write_bytes(b"bad \xff byte")
    texts, unread = documents.read_texts(documents.discover(spark, chosen(tree)))
    assert texts.where("project = 'Parent'").first().text == "bad \ufffd byte" and unread.count() == 0


@pytest.mark.parametrize("most", [1, 3, 256])
def test_a_deep_folder_is_walked_by_many_tasks(spark, tmp_path, most):
    rng = random.Random(4)
    folders = ["top"]
    for n in range(60):
        folders.append(f"{rng.choice(folders)}/d{n}")
    for n, folder in enumerate(folders):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / f"f{n}.md").write_text("x" * n)
    (tmp_path / "top" / "node_modules" / "deep").mkdir(parents=True)
    (tmp_path / "top" / "node_modules" / "deep" / "no.md").write_text("x")
    (tmp_path / "top" / "d0" / ".git").mkdir(parents=True)
    (tmp_path / "link").symlink_to(tmp_path / "top", target_is_directory=True)
    (tmp_path / "own.md").write_text("y")
    rows = documents.listing(spark, chosen(tmp_path), most).collect()
    want = {f"{folder}/f{n}.md": n for n, folder in enumerate(folders)} | {"own.md": 1}
    assert {r.rel: r.size_bytes for r in rows if not r.git_root} == want and len(rows) == len(want) + 1
    assert [r.rel for r in rows if r.git_root] == ["top/d0"]


def test_git_sources(spark, tree):
    repos = spark.createDataFrame([("Alpha", str(tree / "Alpha")), ("None", str(tree / "Parent"))], "project string, path string")
    log = git.commits(repos).collect()
    assert [r.subject for r in log if r.project == "Alpha"] == ["v1.2.3", "Add the app", "First commit"]
    assert [bool(r.problem) for r in log if r.project == "None"] == [True]
    one = next(r for r in log if r.subject == "Add the app")
    assert one.files == ["app.py"] and len(one.parents) == 1 and one.author_email == "me@x.y"
    shown = git.diffs(spark.createDataFrame([(one.path, one.hash)], "path string, hash string")).first()
    assert "+print('hello')" in shown.diff
    assert git.status(repos).where("problem is null").first().flags == ["no remote"]
    dated = git.file_dates(spark.createDataFrame([(one.path, "app.py"), (one.path, "gone")], "path string, file string"))
    assert {r.file: r.dated_by for r in dated.collect()} == {"app.py": "git", "gone": "unknown"}
    with pytest.raises(git.GitError):
        git.commits(repos, "--all")


def test_status_against_the_default_branch(spark, tree, tmp_path):
    run(tmp_path, "clone", "--bare", str(tree / "Alpha"), "far.git")
    run(tmp_path, "clone", "far.git", "near")
    near = tmp_path / "near"
    run(near, "commit", "--allow-empty", "-m", "Not pushed")
    row = git.status(spark.createDataFrame([("near", str(near))], "project string, path string")).first()
    assert (row.project, row.branch, row.default_branch, row.ahead, row.behind) == ("near", "main", "origin/main", 1, 0)
    assert row.flags == ["unpushed commits"] and row.problem is None
    run(near, "reset", "--hard", "HEAD~2")
    run(near, "checkout", "-b", "side")
    row = git.status(spark.createDataFrame([(str(near),)], "path string")).first()
    assert (row.ahead, row.behind, row.flags) == (0, 1, ["not on the default branch", "behind"])
    run(near, "checkout", "--detach")
    assert "detached" in git.status(spark.createDataFrame([(str(near),)], "path string")).first().flags
    (tmp_path / "new").mkdir()
    run(tmp_path / "new", "init")
    assert git.status(spark.createDataFrame([(str(tmp_path / "new"),)], "path string")).first().problem == "no commits yet"
    asked = spark.createDataFrame([("near", str(near))], "project string, path string")
    assert git.commits(asked, "origin/main").count() == 3 and git.commits(asked).count() == 2


def test_tracked_files(spark, tree):
    repo = tree / "Alpha"
    (repo / "app.py").write_bytes(b"changed\0")
    rows = spark.createDataFrame([(str(repo),)], "path string")
    at_head = {r.file: bytes(r.content) for r in git.tracked(rows).collect()}
    lying = {r.file: bytes(r.content) for r in git.tracked(rows, None).collect()}
    assert at_head.keys() == lying.keys() and at_head["app.py"].startswith(b"print") and lying["app.py"] == b"changed\0"
    assert [bool(r.problem) for r in git.tracked(rows, "no-such").collect()] == [True]


def test_service_hides_and_counts(spark, tree, tmp_path):
    index, embedder = Index(spark, f"file://{tmp_path}/index"), KeywordEmbedder(spark)
    with pytest.raises(retrieval.RetrievalError):
        Service(index, embedder, chosen(tree, service_exclude_projects=()))
    runs.build(spark, chosen(tree), index, embedder, accept_all=True)
    with pytest.raises(settings.SettingsError):
        Service(index, embedder, chosen(tree))
    with pytest.raises(ValueError, match="position"):
        Service(index, embedder, chosen(tree, service_exclude_projects=("Alhpa",)))
    held = Service(index, embedder, chosen(tree, service_exclude_projects=("ALPHA", "Secret"), max_searches=1))
    assert held.projects() == ["inner", "Parent", "root"]
    for refused in (lambda: held.search(" "), lambda: held.search("x", project="Alpha")):
        with pytest.raises(retrieval.RetrievalError):
            refused()
    assert "Alpha" not in {r.project for r in held.search("photos caching", 5).collect()}
    with pytest.raises(retrieval.RetrievalError, match="from 1 to 20"):
        held.search("photos", 21)
    with pytest.raises(runs.SessionCapReached):
        held.search("photos")
    one, other = (index.chunks().where(f"project = '{p}'").first().chunk_id for p in ("Alpha", "inner"))
    assert held.get(other).project == "inner"
    with pytest.raises(KeyError):
        held.get(one)


def test_server_answers_requests(spark, tree, tmp_path):
    index, embedder = Index(spark, f"file://{tmp_path}/index"), KeywordEmbedder(spark)
    runs.build(spark, chosen(tree, git_enabled=True, author_names=("me",)), index, embedder, accept_all=True)
    held = Server(Service(index, embedder, chosen(tree, service_exclude_projects=("Alpha",), max_searches=2)))
    asked = [
        ("initialize", {}), ("tools/list", {}), ("tools/call", {"name": "list_projects"}), ("tools/call", {"name": "search", "arguments": {"query": "tides and moons", "k": 2}}),
        ("tools/call", {"name": "search", "arguments": {"query": "x", "project": "alpha"}}), ("tools/call", {"name": "search", "arguments": {"query": "trains"}}),
        ("tools/call", {"name": "search", "arguments": {"query": "more"}}), ("tools/call", {"name": "search", "arguments": {"query": "x", "k": "5"}}), ("other", {}), ("tools/call", {"name": "none"}),
    ]
    lines = [json.dumps({"jsonrpc": "2.0", "id": n, "method": m, "params": p}) for n, (m, p) in enumerate(asked)]
    out = io.StringIO()
    held.serve([*lines, json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), "", "{", "[1]"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [*range(10), None, None]
    results = [g.get("result") for g in got]
    assert results[0]["protocolVersion"] and [t["name"] for t in results[1]["tools"]] == ["list_projects", "search"]
    assert results[2]["structuredContent"] == {"projects": ["inner", "Parent", "root"]}
    first = results[3]["structuredContent"]["results"][0]
    assert (first["citation"], first["source"], first["date_source"], len(results[3]["structuredContent"]["results"])) == ("inner / readme.md", "doc", "git", 2)
    assert results[4]["isError"] and results[4]["content"][0]["text"].startswith("NOT_ANSWERABLE_AS_ASKED")
    assert not results[5]["isError"] and results[6]["content"][0]["text"].startswith("SESSION_CAP")
    assert [g["error"]["code"] for g in got[7:]] == [-32602, -32601, -32602, -32700, -32600]


def test_a_command_that_fails_is_no_reply(tmp_path):
    script = tmp_path / "say.sh"
    for body, kind, said in (("exit 3", cli.GenerationError, "ended with 3"), ("true", cli.GenerationError, "said nothing"),
                             ("echo '{\"error\": {\"code\": 429}}'; exit 1", RateLimited, "without a reason")):
        script.write_text(body)
        with pytest.raises(kind, match=said):
            cli.Command(f"sh {script}").generate("prompt")
    with pytest.raises(cli.GenerationError, match="cannot be run"):
        cli.Command(str(tmp_path / "none")).generate("prompt")


def test_paid_batches_stay_saved(spark, tree, tmp_path):
    asked = []

    def call(texts, query):
        asked.append(len(texts))
        if len(asked) == 2:
            raise DailyQuotaExceeded("no more today")
        return [[1.0, 2.0]] * len(texts)

    index = Index(spark, f"file://{tmp_path}/index")
    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(150)], "key string, embed_text string")
    embedder = RemoteEmbedder(spark, "far", call, sleep=lambda seconds: None)
    with pytest.raises(DailyQuotaExceeded):
        embedder.save_documents(rows, index.save_vectors)
    assert index.cache().count() == 100
    assert embedder.documents(rows).count() == 150 and asked == [100, 50, 100, 50]


def test_index_search_ask_and_evaluate(spark, tree, tmp_path):
    held = chosen(tree, git_enabled=True, author_names=("me",))
    index, embedder = Index(spark, f"file://{tmp_path}/index"), KeywordEmbedder(spark)
    dry = runs.build(spark, held, index, embedder, dry_run=True)
    assert dry["new_projects"] == ["Alpha", "Parent", "inner", "root"] and dry["git_chunks"] == 3 and index.count() == 0
    with pytest.raises(ValueError, match="not accepted"):
        runs.build(spark, held, index, embedder)
    done = runs.build(spark, held, index, embedder, accept_all=True)
    assert index.count() == done["chunks"] == dry["chunks"] and index.projects() == ["Alpha", "inner", "Parent", "root"]
    again = runs.build(spark, held, index, embedder)
    assert (again["to_embed"], again["reused"]) == (0, done["chunks"])
    best = runs.search(index, embedder, "photos caching", 3).orderBy("rank").collect()
    assert best[0].project == "Alpha" and best[0].heading_path == "Alpha" and best[0].score > best[-1].score
    assert {r.project for r in runs.search(index, embedder, "tides", 5, exclude=["ALPHA"]).collect()}.isdisjoint({"Alpha"})
    with pytest.raises(retrieval.RetrievalError, match="No project"):
        runs.search(index, embedder, "x", project="Secret")
    assert index.get(best[0].chunk_id).text == best[0].text
    with pytest.raises(KeyError):
        index.get("none")
    with pytest.raises(SpaceMismatch):
        index.upsert(index.chunks(), "other")

    class Says:
        def __init__(self, reply):
            self.reply = reply

        def generate(self, prompt):
            self.prompt = prompt
            return self.reply

    good = Says('{"answerable": true, "answer": "Close [1].", "citations": [1]}')
    said = runs.ask(index, embedder, good, "Where are photos kept?")
    cited = said["citations"][0]
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", cited.date) and not cited.changed and cited.line.endswith(cited.date)
    assert said["verdict"] == "answered" and cited.number == 1 and "<<<PASSAGE 1>>>" in good.prompt
    assert runs.ask(index, embedder, Says('{"answerable": true, "answer": "x", "citations": [99]}'), "photos")["verdict"] == "uncited"
    suite = spark.createDataFrame([("a", "c", "photos caching", ["Alpha"], ["close to the reader"], None, None)], evaluation.QUESTION)
    outcomes, summary = runs.evaluate(index, embedder, suite)
    assert outcomes.first().passed is True and summary.first().passed == 1


def test_leak_scan_of_a_repository(spark, tree):
    repo = str(tree / "Alpha")
    held = settings.ScanSettings(("hello",), (settings.Accepted("app.py", "real@corp.io", 1, "fine"),))
    hits, binary, stale = scan.scan_repository(spark, repo, held)
    got = {(r.file, r.kind, r.state) for r in hits.where("file = 'app.py'").collect()}
    assert got == {("app.py", "term #1", "new"), ("app.py", "email", "accepted")}
    assert scan.exit_code(hits) == 1 and stale.count() == 0 and binary.count() == 0
    added = scan.scan_commits(spark, repo, held, "HEAD~2")
    got = {(r.file.split(":", 1)[1], r.kind, r.state) for r in added.hits.collect()}
    assert {(k, s) for f, k, s in got if f == "app.py"} == {("term #1", "new"), ("email", "accepted")}
    other = settings.ScanSettings((), (settings.Accepted("app.py", "real@corp.io", 2, "two"),))
    assert {r.state for r in scan.scan_commits(spark, repo, other, "HEAD~2").hits.where("kind = 'email'").collect()} == {"new"}
    assert scan.exit_code(hits.where("state = 'accepted'")) == 0
    assert scan.exit_code(hits.where("state = 'accepted'"), stale=scan.scan_repository(spark, repo, other)[2]) == 1
    with pytest.raises(ValueError, match="no-such"):
        scan.scan_commits(spark, repo, held, "no-such/upstream")
    with pytest.raises(ValueError, match="nosuch"):
        scan.scan_repository(spark, repo, held, "nosuch")


def test_commit_scan_reads_names_binaries_and_merges(spark, tree):
    repo = tree / "Alpha"
    run(repo, "branch", "start")
    (repo / "hush.txt").write_text("plain\n" * 20)
    (repo / "pic.bin").write_bytes(b"\0\1")
    run(repo, "add", "-A")
    run(repo, "commit", "-m", "Add files")
    run(repo, "mv", "hush.txt", "a Hush b.txt")
    run(repo, "commit", "-m", "Rename")
    run(repo, "checkout", "-b", "side", "start")
    run(repo, "commit", "--allow-empty", "-m", "on the side for me@corp.io")
    run(repo, "checkout", "main")
    run(repo, "merge", "--no-ff", "side", "-m", "Merge hush")
    found = scan.scan_commits(spark, str(repo), settings.ScanSettings(("hush",), (), ("hush", "other")), "start")
    got = sorted((r.file.split(":", 1)[1], r.line, r.kind, r.match) for r in found.hits.collect())
    assert got == [("", 1, "email", "me@corp.io"), ("", 1, "term #1", "hush"), ("a Hush b.txt", 0, "term #1 in file name", "Hush"), ("hush.txt", 0, "term #1 in file name", "hush")]
    assert [r.file.split(":")[1] for r in found.binary.collect()] == ["pic.bin"] and found.merges.count() == 1


def break_a_commit(repo):
    """Loses the object of the oldest commit but one, so that the log breaks off part-way."""
    shown = subprocess.run(["git", "-C", str(repo), "rev-list", "HEAD"], check=True, capture_output=True, text=True).stdout.split()
    lost = shown[-2]
    (repo / ".git" / "objects" / lost[:2] / lost[2:]).unlink()


def test_broken_history_is_left_out_and_listed(spark, tree):
    for n in range(5):
        run(tree / "Alpha", "commit", "--allow-empty", "-m", f"Commit {n}\n\nIt explains at some length what this commit is here for.")
    break_a_commit(tree / "Alpha")
    found = runs.collect(spark, chosen(tree, git_enabled=True, author_emails=("me@x.y",)))
    states = {r.project: r.problem for r in found.repositories.collect()}
    assert states["Alpha"] and states["inner"] is None
    git_chunks = found.chunks.where("source = 'git'").select("project").distinct().collect()
    assert [r.project for r in git_chunks] == ["inner"]
    assert found.chunks.where("project = 'Alpha' and source = 'doc'").count() > 0
    with pytest.raises(ValueError):
        scan.scan_commits(spark, str(tree / "Alpha"), settings.ScanSettings((), ()), "HEAD~6")


def test_a_slow_reader_loses_nothing(tree, monkeypatch):
    monkeypatch.setattr(git, "SECONDS", 0.5)
    got = []
    for records, problem in git._records(str(tree / "Alpha"), ["log", "--format=%H%x1e"], b"\x1e"):
        time.sleep(1)
        assert problem is None
        got += records
    assert len([r for r in got if r.strip()]) == 3
    shell = git._records(str(tree / "Alpha"), ["-c", "alias.wait=!sleep 5", "wait"], None)
    assert "nothing for" in list(shell)[-1][1]


@pytest.mark.parametrize("seed", range(3))
def test_terms_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    terms = ["".join(rng.choice("abAB") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts = ["".join(rng.choice("aAbBİ ") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    frame = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, line int, text string")
    want = []
    for i, text in enumerate(texts):
        spans = {(at, at + len(t), min(k for k, u in enumerate(terms, 1) if u.lower() == t.lower()))
                 for t in terms for at in range(len(text)) if text[at : at + len(t)].lower() == t.lower()}
        want += [(i, f"term #{n}", text[a:b]) for a, b, n in spans if not any((x, y) != (a, b) and x <= a and b <= y for x, y, _ in spans)]
    assert sorted((r.line, r.kind, r.match) for r in leaks.term_hits(frame, terms).collect()) == sorted(want)


def test_a_long_diff_is_read_in_one_pass(spark):
    head = ["diff --git a/old.py b/new.py", "similarity index 90%", "rename from old.py", "rename to new.py", "--- a/old.py", "+++ b/new.py"]
    body = [line for i in range(100_000) for line in (f"@@ -{i} +{i * 2 + 1} @@", "-gone", f"+{i}")]
    tail = ["diff --git a/x.bin b/x.bin", "new file mode 100644", "Binary files /dev/null and b/x.bin differ", "diff --git a/gone b/gone", "deleted file mode 100644", "--- a/gone", "+++ /dev/null", "@@ -1 +0,0 @@", "-x"]
    diffs = spark.createDataFrame([("h", "\n".join(head + body + tail)), ("i", "\n".join(head))], "hash string, diff string")
    read = leaks.read_diffs(leaks.diff_lines(diffs)).toPandas()
    lines = read[read.what == "line"]
    assert lines["line"].tolist() == list(range(1, 200_000, 2)) and lines["text"].tolist() == [str(i) for i in range(100_000)] and set(lines["file"]) == {"new.py"}
    others = read[read.what != "line"]
    assert sorted(zip(others.hash, others.what, others.file)) == [("h", "binary", "x.bin"), ("h", "name", "new.py"), ("h", "name", "x.bin"), ("i", "name", "new.py")]


def test_settings(tmp_path):
    base, local = tmp_path / "config.toml", tmp_path / "config.local.toml"
    base.write_text('[discovery]\nexclude_projects = ["A"]\n[git]\nenabled = true\n')
    local.write_text('[discovery]\nexclude_projects = []\n[scan]\nprivate_terms = ["t"]\n')
    got = settings.load([base, local], {"LOREKEEP_SCAN_ROOT": str(tmp_path)})
    assert got.exclude_projects == () and got.git_enabled and settings.Settings().exclude_projects is None
    assert settings.scan_settings(local).terms == ("t",)
    for bad in ("[git]\nenabled = 1", "[git]\nthin_message_chars = true", "[other]\nx = 1", "[mcp]\nmax = 1", "[discovery]\nexclude_paths = [1]", "["):
        with pytest.raises(settings.SettingsError):
            settings.parse(bad)
    with pytest.raises(settings.SettingsError):
        settings.load([base], {})
    with pytest.raises(settings.SettingsError):
        settings.required_exclusions(None, "exclude_projects")


def test_command_line(spark, tree, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("LOREKEEP_SCAN_ROOT", str(tree))
    (tmp_path / "config.toml").write_text('[discovery]\nexclude_projects = ["Secret"]\n')
    base = ["--config", str(tmp_path / "config.toml"), "--index", f"file://{tmp_path}/i"]
    assert cli.main([*base, "discover"], spark) == 0 and "Alpha: 2 files" in capsys.readouterr().out
    assert cli.main([*base, "search", "x"], spark) == 2
    assert cli.main([*base, "index", "--accept-all-new"], spark) == 0
    assert cli.main([*base, "search", "tides and moons", "-k", "1"], spark) == 0 and "inner / readme.md" in capsys.readouterr().out
    reply = tmp_path / "reply.json"
    reply.write_text('{"answerable": true, "answer": "Moons [1].", "citations": [1]}')
    assert cli.main([*base, "ask", "tides and moons", "--model", f"cat {reply}"], spark) == 0
    assert "Moons [1].\n[1] inner / readme.md" in capsys.readouterr().out
    reply.write_text('{"answerable": false, "answer": "", "citations": []}')
    assert cli.main([*base, "ask", "tides", "--model", f"cat {reply}"], spark) == 1 and "Moons" not in capsys.readouterr().out
    (tmp_path / "suite.toml").write_text('version = 2\n[[question]]\nid = "a"\ncategory = "c"\ntext = "tides"\nexpected_projects = ["inner"]\n')
    assert cli.main([*base, "eval", "--fixture", str(tmp_path / "suite.toml"), "--out", str(tmp_path / "out")], spark) == 0
    report = json.loads(next((tmp_path / "out").iterdir()).read_text())
    assert report["summary"]["passed"] == 1


def test_stream_follows_documents(spark, tmp_path):
    from lorekeep.streaming import follow

    schema = "project string, rel_path string, path string, mtime double, text string"
    source, index = f"{tmp_path}/in", Index(spark, f"file://{tmp_path}/index")
    body = "A text about rivers that is long enough to be kept as a chunk by itself."
    for n, word in enumerate(("rivers", "lakes")):
        spark.createDataFrame([("P", "a.md", "/a", 1.0, body.replace("rivers", word)), ("P", f"{n}.md", "/b", 1.0, body)], schema).write.mode("append").parquet(source)
        follow(spark.readStream.schema(schema).parquet(source), index, KeywordEmbedder(spark), f"{tmp_path}/checkpoint").awaitTermination()
    long = "\n\n".join(f"{body} {n}" for n in range(60))
    for text, more in ((long, True), (body, False)):
        spark.createDataFrame([("P", "c.md", "/c", 1.0, text)], schema).write.mode("append").parquet(source)
        follow(spark.readStream.schema(schema).parquet(source), index, KeywordEmbedder(spark), f"{tmp_path}/checkpoint").awaitTermination()
        assert (index.chunks().where("rel_path = 'c.md'").count() > 1) is more
    assert sorted((r.rel_path, "lakes" in r.text) for r in index.chunks().where("rel_path <> 'c.md'").collect()) == [("0.md", False), ("1.md", False), ("a.md", True)]


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    found = db.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted(repr([plain(int(r[i]) if hasattr(r[i], "as_tuple") else r[i]) for i in at]) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists("/root/testdata")
