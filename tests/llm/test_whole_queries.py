"""Registered queries against versions that share no code with the operators, and very long texts."""

import hashlib
import random
import re

import numpy as np
import xxhash
from public_tokenizers import path as vocabulary_path
from tokenizers import Tokenizer

from lorekeep.llm import decontam, queries, simhash, substring, tokenshards

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in queries.table(spark, sf_dir, "documents").collect()}


def test_personal_data_query(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    got = queries.op10_pii(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    seen = 0
    for r in got:
        text = texts[r.doc_id]
        spans = {k: [m.span() for m in re.finditer(p, text) if holds(k, m[0])] for k, p in PATTERNS.items()}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(spans[k]) for k in PATTERNS]
        base = [f"{k}:{a}:{b}" for k in PATTERNS for a, b in spans[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(base) <= set(every)
        order = list(PATTERNS)
        keys = [(order.index(k), int(a)) for k, a, _ in (s.split(":") for s in every)]
        assert keys == sorted(keys)
        if "@" not in text and not re.search(r"[^\x00-\x7f]|\b(?:at|dot|zero|one|two|three|four|five|six|seven|eight|nine)\b", text, re.I):
            assert every == base
        seen += len(base)
    assert seen > 5


def nearest_stretch(pattern, text):
    """Least edit distance of the pattern to any stretch of the text, a row for each character of the pattern."""
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    places = np.arange(len(letters) + 1)
    row = np.zeros(len(letters) + 1, np.int64)
    for n, c in enumerate(pattern, 1):
        new = np.concatenate([[n], np.minimum(row[1:] + 1, row[:-1] + (letters != ord(c)))])
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def test_decontamination_query(spark, sf_dir):
    def plain(text):
        found = re.sub(r"[\W_]+", " ", (text or "").lower()).strip()
        return f" {found} " if found else ""

    items = {r.item_id: plain(r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()}
    docs = {i: plain(t) for i, t in texts_of(spark, sf_dir).items()}
    want = []
    for i, text in docs.items():
        for item, words in items.items():
            budget = len(words) * 8 // 100
            if len(text) > 6000:  # long ones: at least a piece must occur
                cuts = [len(words) * n // (budget + 1) for n in range(budget + 2)]
                if not any(words[a:b] in text for a, b in zip(cuts, cuts[1:], strict=False)):
                    continue
            if len(text) + budget >= len(words) and (best := nearest_stretch(words, text)) <= budget:
                want.append((i, item, best, budget))
    got = sorted((r.doc_id, r.item_id, r.distance, r.budget) for r in queries.op9_decontam(spark, sf_dir).collect())
    assert got == sorted(want) and len(want) >= 2


def test_token_shards_query(spark, sf_dir):
    library = Tokenizer.from_file(str(vocabulary_path("byte_bpe_50k.json")))
    want = {}
    for i, text in texts_of(spark, sf_dir).items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u2")
        want |= {(i, n): (len(ids[a : a + 256]), hashlib.sha256(ids[a : a + 256].tobytes()).hexdigest()) for n, a in enumerate(range(0, len(ids), 256))}
    rows = queries.op7_token_shards(spark, sf_dir).collect()
    assert {(r.doc_id, r.seq): (r.n_tokens, r.ids_sha256) for r in rows} == want
    assert sorted(r.slot for r in rows) == list(range(len(want)))


def test_decontamination_of_repeats_and_long_texts(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    item = " ".join(rng.choice(words) for _ in range(30))
    wrong = item.replace(item.split()[4], "zzzzzz")
    long = " ".join(rng.choice(words) for _ in range(60_000))
    docs = spark.createDataFrame([(1, f"{long} {wrong} {long}"), (2, item), (2, item), (None, f"{item} x {wrong}")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, ""), (3, None)], "item_id long, text string")
    got = sorted((r.id or 0, r.item, r.distance) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(0, 1, 0)] * 2 + [(1, 1, nearest_stretch(f" {item} ", f" {wrong} "))] * 2 + [(2, 1, 0)] * 4


def test_long_texts_are_fingerprinted_whole():
    rng = random.Random(10)
    words = [f"W{rng.randrange(10**6)}" for _ in range(100_000)]
    ones = np.zeros(64, np.int64)
    low = [w.lower() for w in words]
    for i in range(len(low) - 2):
        h = xxhash.xxh64_intdigest(" ".join(low[i : i + 3]).encode(), 42)
        ones += np.array([h >> b & 1 for b in range(64)])
    want = sum(1 << b for b in range(64) if 2 * ones[b] > len(low) - 2)
    assert simhash.fingerprint(" \n".join(words).encode()) == want


def test_passages_at_the_end_of_long_texts(spark):
    rng = random.Random(11)
    noise = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    passage = noise(60)
    rows = [(1, [*noise(40_000), *passage]), (2, [*noise(35_000), *passage, "end"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs).collect()}
    kept = rows[1][1][:35_000] + ["end"]
    assert got[1] == (40_060, 0, hashlib.sha256(" ".join(rows[0][1]).encode()).hexdigest())
    assert got[2] == (35_061, 60, hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_a_long_text_is_sharded_as_a_whole(spark, tmp_path):
    rng = random.Random(12)
    text = " ".join(rng.choice(["alpha", "beta's", "\n\n", "日本", "12", "x" * 40]) for _ in range(40_000))
    assert len(text) > 3 * tokenshards.STRETCH_CHARS
    ids = np.array(Tokenizer.from_file(str(vocabulary_path("byte_bpe_50k.json"))).encode(text, add_special_tokens=False).ids, "<u2")
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    tokenshards.write_shards(docs, queries.vocabulary("byte_bpe_50k.tiktoken"), f"file://{tmp_path}/long")
    rows = tokenshards.read_shards(spark, f"file://{tmp_path}/long").collect()
    assert {r.seq: r.ids_sha256 for r in rows} == {n: hashlib.sha256(ids[a : a + 256].tobytes()).hexdigest() for n, a in enumerate(range(0, len(ids), 256))}
