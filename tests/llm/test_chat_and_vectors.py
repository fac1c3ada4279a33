"""Chat formatting, embeddings, components and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lorekeep.llm import chat, crosspoly, queries
from lorekeep.llm.components import connected_components


def test_chat_texts_come_back():
    rng = random.Random(3)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "<\\/s>", "s>", "|image:", "<|image:0|>", "[ROLE x]", "[/ROLE]", "ROLE ", "a", "\n", " ", "é", "[OUT]", "/"]
    for _ in range(10000):
        turns = [
            (rng.choice(["user", "assistant", "system", "x]y é", None, "tool", "ROLE"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))))
            for _ in range(rng.randint(1, 3))
        ]
        whole = ""
        for role, text in turns:
            segment, _, (a, b) = chat.format_turn(role, [{"kind": "text", "text": text}])
            whole += segment
            assert chat.unescape(segment[a:b]) == text
        assert [(r, t) for r, t, _ in chat.parse(whole)] == [(r or "", t) for r, t in turns]


def test_chat_parts():
    parts = [
        {"kind": "text", "text": "see <"}, {"kind": "text", "text": "/s> "}, {"kind": "image", "ref": "a.png", "width": 100, "height": 60},
        {"kind": "audio", "ref": "b.wav", "seconds": 2.0}, {"kind": "document", "ref": "c.pdf", "pages": 3}, {"kind": "text", "text": "end"},
    ]
    segment, attached, _ = chat.format_turn("user", parts)
    assert [a["tokens"] for a in attached] == [12, 25, 2304]
    assert [a["ref"] for a in attached] == ["a.png", "b.wav", "c.pdf"]
    assert list(chat.parse(segment)) == [("user", "see </s> end", [("image", 0), ("audio", 1), ("document", 2)])]
    with pytest.raises(ValueError, match="unknown content part"):
        chat.format_turn("user", [{"kind": "video"}])


def test_chat_parts_column(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", None, [("image", None, "x", 28, 28, None, None), ("text", "hi", None, None, None, None, None)]), (1, 1, "assistant", "yes", None)],
        f"conv_id long, turn long, role string, text string, parts {chat.PARTS}",
    )
    got = chat.read_back(chat.format_turns(rows, parts_col="parts")).first()
    assert (got.n_turns, got.loss_chars, got.expanded_tokens) == (2, 3, 1)


def test_chat_query(spark, sf_dir):
    convs = {}
    for r in queries.table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    convs[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.op4_chat(spark, sf_dir).collect()}
    assert got.keys() == convs.keys()
    for conv, turns in convs.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_odd_rows(spark):
    rows = spark.createDataFrame(
        [(None, 1, "user", "a", 1), (1, None, "user", "b", 1), (1, 0, None, None, 1), (1, 0, "assistant", "x" * 100_000, 1), (1, 0, "assistant", "x" * 100_000, 1)],
        "conv_id long, turn long, role string, text string, segment int",
    )
    got = {r.conv: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_turns(rows)).collect()}
    assert got == {None: (1, 0), 1: (4, 200_000)}
    assert chat.read_back(chat.format_turns(rows.limit(0))).count() == 0


def slow_links(ids, vectors, cosine=0.95):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    root = list(ids)
    changed = True
    while changed:
        changed = False
        for a, b in np.argwhere(near):
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return {i: (int(n), r) for i, n, r in zip(ids, near.sum(1), root)}


@pytest.mark.parametrize("block_bytes", [1 << 25, 16 * 8 * 64])
@pytest.mark.parametrize("sign_rows", [131_072, 20])
def test_embedding_links_recall(spark, block_bytes, sign_rows, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 64))
    rows = [centres[i % 60] + rng.normal(scale=0.12, size=64) * (i % 3) for i in range(400)]
    rows += [rows[3]] * 60 + [centres[0] + rng.normal(scale=0.02, size=64) for _ in range(90)]
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(crosspoly.class_links, "__defaults__", (block_bytes,))
    monkeypatch.setattr(crosspoly, "SIGN_ROWS", sign_rows)
    got = {r.id: (r.n_links, r.component) for r in crosspoly.near_duplicates(frame).collect()}
    want = slow_links(range(len(rows)), rows)
    true = sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * true
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


@pytest.mark.parametrize(("parts", "recall"), [(1, 0.995), (2, 0.99), (3, 0.93)])
def test_embedding_recall_at_the_limit(spark, parts, recall):
    """Pairs at a cosine of just 0.95, in 64 dimensions, for each number of hashes a bucket."""
    rng = np.random.default_rng(parts)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    both = np.concatenate([x, 0.95001 * x + np.sqrt(1 - 0.95001**2) * y])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in crosspoly.near_duplicates(frame, parts=parts).collect()}
    assert set(got.values()) <= {0, 1}
    assert sum(got.values()) >= recall * len(both)


def test_embedding_sign_limit_spares_pairs_at_the_limit():
    rng = np.random.default_rng(4)
    for dim in (2, 3, 16, 64, 300):
        x = rng.normal(size=(20_000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=x.shape)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        near = 0.95 * x + np.sqrt(1 - 0.95**2) * y
        differ = np.bitwise_count(crosspoly.signs(x) ^ crosspoly.signs(near)).sum(axis=1)
        assert differ.max() <= crosspoly.sign_limit(0.95) < 35


def test_embedding_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], 1),
            (8, [2.0, 0.0], 1), (8, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [1e300, 1e-300], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    got = sorted((r.id or 0, r.n_links, r.component) for r in crosspoly.near_duplicates(frame).collect())
    assert got == [(0, 0, None), *((i, 0, i) for i in range(1, 7)), (7, 3, 7), (8, 3, 7), (8, 3, 7), (9, 0, 9), (10, 3, 7)]
    assert crosspoly.near_duplicates(frame.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    frame = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {i for a, b in links if a != b for i in (a, b)}
    for at_once in (0, 100_000):  # rounds of contractions, or one task
        got = {r.node: r.root for r in connected_components(frame, "a", "b", at_once=at_once).collect()}
        assert got == {i: find(i) for i in linked}
        assert connected_components(frame.limit(0), "a", "b", at_once=at_once).count() == 0


def test_pipeline_equals_its_parts(spark, sf_dir):
    """Brute force over the stages: the same decisions taken document by document."""
    from lorekeep.llm import decontam, pii, quality

    docs = sorted(queries.table(spark, sf_dir, "documents").collect())
    model = quality.train(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"))
    docs = [d for d in docs if model.score(quality.feature_matrix([d.text.encode()]))[0] >= quality.KEEP_SCORE]
    words = [[w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text)) if w] for d in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) > 0:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = [d for i, d in enumerate(docs) if root[i] == i]
    items = [decontam.normalise(r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    docs = [d for d in docs if not any(slow_hit(item, decontam.normalise(d.text)) for item in items)]
    own = Tokenizer.from_file(queries.vocabulary())
    want = {}
    for d in docs:
        text = pii.masked(d.text, pii.find(d.text)[1])
        want[d.doc_id] = hashlib.sha256(np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def slow_hit(item, text):
    from lorekeep.llm.decontam import ERROR_RATE, Myers

    return Myers(item).best(text, int(len(item) * ERROR_RATE)) is not None


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows and ids, clashing names, and none at all."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(150_000))
    rows = [(1, None, "en"), (2, "", None), (3, "one two", "en"), (3, "one two", "en"), (3, "one two", "de"), (3, "quite another text of eight words here", "en"),
            (None, "one two", "en"), (None, None, None), (4, long, "en"), (5, long + " end", "en"), (6, "x" * 2_000_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumns({n: F.lit(1) for n in ("id", "t", "c", "k", "hub", "a", "n", "fp", "score", "h", "ids", "component", "spans")})
    sizes = {"quality": None, "near_duplicates": 7, "decontamination": 11, "personal_data": 11, "encoding": 11}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir).collect()
        assert sizes[name] in (None, len(got)), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        if name == "near_duplicates":
            # 1 stands for all without words, 4 for its near copy; rows without an id stay.
            assert sorted((r.doc_id or 0, len(r.text or "")) for r in got) == sorted(
                [(0, 7), (0, 0), (1, 0), (3, 7), (3, len(rows[5][1])), (4, len(long)), (6, 2_000_000)]
            )


def test_stages_keep_the_columns(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
