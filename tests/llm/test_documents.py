"""Operators on documents against brute force, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from public_tokenizers import path as vocabulary_path
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from lorekeep.llm import bpe, decontam, minhash, pii, quality, queries, simhash, substring, tokencount, tokenshards

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", None),
    (3, "one two", "en", None, 7),
    (3, "one two", "en", None, 7),
    (4, "  \n\t ", "en", "a", 5),
    (5, "word " * 5000, "en", "a", 25000),
    (6, "x" * 30000, "en", "a", 30000),
    (None, "one two", "en", "a", 7),
    (7, "Ünï 日本 😀 <|endoftext|> it's", "en", "a", 20),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def odder(odd):
    """Odd rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "fp", "score", "component", "h", "at", "n", "ids", "spans", "root", "label", "places"]
    return odd.withColumns({n: F.lit(1) for n in names})


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf_dir).collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = components(ids, pairs)
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in ids}


def test_simhash_trees_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 4, 900)], np.uint64)
    points = np.unique(np.concatenate([base, base[rng.integers(0, 300, 900)] ^ flips]))
    found = set()
    for mask in simhash.band_masks(2):
        tree, leaves = simhash.grow(points, [(mask, 1), (simhash.EVERY_BIT, 3)], 1.0, 32)
        assert leaves > 8
        for _, home, query in simhash.route(tree, points):
            both = np.concatenate([home, query])
            near = np.bitwise_count(points[both][:, None] ^ points[home][None, :]) <= 3
            found |= {tuple(sorted((int(both[i]), int(home[j])))) for i, j in zip(*np.nonzero(near))}
    true = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    assert {tuple(sorted(map(int, p))) for p in true} <= found


def test_simhash_full_leaf_finds_the_same(spark, monkeypatch):
    """A leaf that is parted in its task, groups that share a band among its rows."""
    rng = np.random.default_rng(3)
    rows = [int(v) for v in rng.integers(-(2**62), 2**62, 40)]
    near = [v ^ (1 << int(b)) for v in rows for b in rng.integers(0, 63, 30)]
    same = [rows[0] ^ (int(v) << 32) for v in rng.integers(0, 2**30, 300)]
    frame = spark.createDataFrame([(v,) for v in sorted({*rows, *near, *same})], "fp long")
    want = {(r.node, r.root) for r in simhash.connected_components(simhash.links(frame), "a", "b").collect()}
    monkeypatch.setattr(simhash, "SAMPLE_BOUND", 4)
    monkeypatch.setattr(simhash, "grow", lambda *a, grow=simhash.grow: grow(*a[:3], 40))
    monkeypatch.setattr(simhash, "LEAF_ROWS", 40)
    got = {(r.node, r.root) for r in simhash.connected_components(simhash.links(frame), "a", "b").collect()}
    assert got == want and got


def test_simhash_odd_rows(odder):
    got = sorted((r.id or 0, r.fp, r.component) for r in simhash.near_duplicates(odder).collect())
    by_id = {i: (f, c) for i, f, c in got}
    assert len(got) == len(ODD)
    assert by_id[1] == by_id[2] == by_id[4] == (0, 1)
    assert by_id[0] == by_id[3] and by_id[3][1] == 3
    kept = simhash.keep_one(odder)
    assert kept.columns == odder.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 5, 6, 7]


def test_keep_one_judges_rows_that_repeat_an_id_by_their_texts(spark):
    a, b = "one text of seven words is here", "another text that nothing else is near"
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        rows = [[(1, a), (3, a), (3, b)][i] for i in order]
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
        assert sorted(map(tuple, kept.collect())) == [(1, a), (3, b)]


def test_keep_one_takes_one_row_of_an_id_in_a_group(spark):
    base = [f"w{i}" for i in range(200)]
    near = [*base[:100], "other", *base[101:]]
    far = [f"v{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (1, " ".join(near)), (1, " ".join(far)), (2, " ".join(base)), (2, " ".join(far))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [1, 1]
    assert sorted(r.text.split()[0] for r in kept) == ["v0", "w0"]


def test_keep_one_leaves_columns_of_any_name(spark):
    base = " ".join(f"w{i}" for i in range(50))
    shape = "doc_id long, text string, `__id` int, `__text` int, kk int, `a.b` int"
    kept = simhash.keep_one(spark.createDataFrame([(1, base, 7, 8, 9, 10), (2, base, 1, 1, 1, 1)], shape)).collect()
    assert [tuple(r)[2:] for r in kept] == [(7, 8, 9, 10)]


@pytest.mark.parametrize("small", [False, True])
def test_keep_one_equals_jaccard_brute_force(spark, small, monkeypatch):
    """Near copies over a range of similarities about 0.8, chains of them among them; also with blocks of few rows."""
    if small:
        monkeypatch.setattr(minhash, "PART", 2)
        monkeypatch.setattr(minhash, "SKETCHES", 2)
        monkeypatch.setattr(minhash, "against_one", lambda rows, classes: classes.select(F.col("c").alias("a"), F.col("c").alias("hub")).limit(0))
    rng = random.Random(12)
    docs = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([12, 60, 300]))]
        docs.append(base)
        for _ in range(rng.randint(1, 8)):
            copy = list(rng.choice([base, docs[-1]]))
            for _ in range(max(1, round(len(copy) * rng.choice([0.005, 0.02, 0.03, 0.05])))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
            docs.append(copy)
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    root = components(range(len(docs)), near)
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    want = sorted(i for i in range(len(docs)) if root[i] == i)
    assert 40 <= len(want) < len(docs) - 40
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == want


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held) and len(held) > 50


def test_quality_odd_rows(spark, odder):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odder, labels)
    got = quality.scores(odder, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(odder, model).columns == odder.columns
    assert quality.keep_good(odder, model, least=0.0).count() == len(ODD)
    none = quality.train(odder, labels.limit(0))
    assert {r.score for r in quality.scores(odder, none).collect()} == {0.5}


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 9] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20)
    assert (3, 9) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(vocabulary_path("byte_bpe_50k.json")))


def mixed(seed, n):
    rng = random.Random(seed)
    bits = ["a", "b", "  ", " ", "\n", "\t", " ", "\x1c", "<|endoftext|>", "<|endo", "'s", "é", "日本", "😀", "1", "²", "!", "##", "\r\n", "　", " the", "aaaa", "x" * 30, "́"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_the_library(spark, sf_dir, texts, library):
    got = {r.doc_id: r for r in queries.op3_bpe(spark, sf_dir).collect()}
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_bpe_on_mixed_texts(library):
    own = bpe.load(queries.vocabulary())
    some = mixed(1, 3000)
    for text, ids, want in zip(some, own.encode(some), library.encode_batch(some, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert own.decode(ids) == text


def test_word_borders_are_the_librarys_on_all_planes(library):
    """Every character of which the regex module thinks otherwise, each seventh of all, and random texts."""
    own, counter = bpe.load(queries.vocabulary()), tokencount.load(queries.vocabulary())
    every = [chr(c) for c in range(0x40000) if not 0xD800 <= c <= 0xDFFF]
    _, odd = bpe.borders(queries.vocabulary())
    some = [c for n, c in enumerate(every) if n % 7 == 0 or any(a <= c <= b for a, b in zip(odd[::3], odd[2::3]))]
    assert len(some) > 40_000 and odd
    rng = random.Random(11)
    texts = [form.replace("{}", c) for c in some for form in ("{}'s", "1{}", "a{}")]
    texts += ["".join(rng.choice(every) if rng.random() < 0.6 else rng.choice(" a1'!s\n") for _ in range(rng.randint(0, 30))) for _ in range(10_000)]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        want = [w.ids for w in library.encode_batch_fast(part, add_special_tokens=False)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(part)] == want
        assert counter.counts(part) == list(map(len, want))


def test_counts_are_equal_on_both_sides_of_the_chunk_size(library):
    counter = tokencount.load(queries.vocabulary())
    base = " ".join(mixed(7, 4000))
    for size in (tokencount.CHUNK_CHARS + d for d in (-1, 0, 1, 2, 255, 256, 257)):
        text = base[:size]
        assert len(text) == size
        assert counter.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_bpe_round_trip_odd_rows(odder):
    path = queries.vocabulary()
    one = bpe.round_trip(odder, path).collect()
    two = bpe.decode(bpe.encode(odder, path), path).collect()
    assert len(one) == len(ODD) and sorted(map(str, one)) == sorted(map(str, two))
    assert sorted(r.text for r in one) == sorted(r[1] or "" for r in ODD)


def test_counts_equal_the_library(spark, sf_dir, texts, library):
    for r in queries.op8_token_counts(spark, sf_dir).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_counts_resynchronise_at_every_overlap(library):
    counter = tokencount.load(queries.vocabulary())
    rng = random.Random(2)
    for text in mixed(3, 1500):
        want = library.encode(text, add_special_tokens=False).ids
        assert tokencount.spliced(text, counter.encoded, rng.randint(2, 40), rng.randint(1, 9)) == want
        assert counter.counts([text]) == [len(want)]
    unbroken = "é" * 90_000
    assert counter.counts([unbroken]) == [len(library.encode(unbroken, add_special_tokens=False).ids)]


def test_counts_odd_rows(odder, library):
    got = sorted((r.id or 0, r.n_bytes, r.n_tokens) for r in tokencount.token_counts(odder, queries.vocabulary()).collect())
    want = [(i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD]
    assert got == sorted(want)


def slow_removal(docs, window=50):
    words = {i: (t or "").encode().split() for i, t in docs.items()}
    first, out = {}, {}
    for i in sorted(words):
        own, gone = words[i], [False] * len(words[i])
        for p in range(len(own) - window + 1):
            if first.setdefault(tuple(own[p : p + window]), i) < i:
                gone[p : p + window] = [True] * window
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        out[i] = (len(own), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_equal_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_substrings(spark, sf_dir).collect()}
    assert got == slow_removal(texts)
    assert sum(n for _, n, _ in got.values()) > 0


def test_substrings_at_the_limits(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    passage = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 120)]
    docs = {}
    for i in range(40):
        own = [word() for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passage, 2):
            cut = rng.randint(0, 3)
            own += p[cut:] + [word() for _ in range(rng.randint(0, 2))]
        docs[i] = " ".join(own)
    docs[50], docs[51] = docs[7], " ".join(["same"] * 300)
    docs[52] = docs[51]
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(frame).collect()}
    assert got == slow_removal(docs)


@pytest.mark.parametrize("hot_hashes", [100_000, 1])
def test_substrings_in_a_hot_passage(spark, monkeypatch, hot_hashes):
    """A passage of which each window is in many documents, and rows that repeat an id."""
    monkeypatch.setattr(substring, "HOT_ROWS", 8)
    monkeypatch.setattr(substring, "HOT_HASHES", hot_hashes)
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    passage, other = [word() for _ in range(90)], [word() for _ in range(70)]
    docs = {}
    for i in range(120):
        part = passage[rng.randint(0, 20) :][: rng.randint(45, 90)] if i % 3 else other
        docs[i] = " ".join([word() for _ in range(rng.randint(0, 40))] + part + [word() for _ in range(rng.randint(0, 40))])
    rows = [*docs.items(), (7, docs[7]), (119, docs[119])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.id, (r.n_words, r.n_removed, r.kept_sha256)) for r in substring.digests(frame).collect()]
    want = slow_removal(docs)
    assert sorted(got) == sorted((i, want[i]) for i, _ in rows)


def test_substring_cover_is_complete():
    cover = substring.COVER
    assert {(a - b) % substring.PERIOD for a in cover for b in cover} == set(range(substring.PERIOD))


def test_substrings_odd_rows(odder):
    got = sorted((r.id or 0, r.n_words, r.n_removed) for r in substring.digests(odder).collect())
    assert got == sorted((i or 0, len((t or "").split()), 0) for i, t, *_ in ODD)


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_equals_brute_force():
    rng = random.Random(6)
    for _ in range(1500):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 30)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
        k, best = int(len(item) * 0.2), slow_distance(item, text)
        got = decontam.Block([(1, item)], 0.2).matches(text)
        assert got == ([(0, best, k)] if best <= k else [])


def test_decontamination_finds_altered_passages(spark, sf_dir):
    items = [r.text for r in queries.table(spark, sf_dir, "benchmark").orderBy("item_id").collect()]
    swapped = items[0].upper().replace(",", " --").replace(" ", "  ")
    words = items[1].split()
    words[3] = words[3][:-1] + "q"
    docs = spark.createDataFrame(
        [(1, f"before {items[0]} after"), (2, swapped), (3, "intro. " + " ".join(words)), (4, "clean words only"), (5, None), (6, "")],
        "doc_id long, text string",
    )
    benchmark = queries.table(spark, sf_dir, "benchmark")
    got = {(r.id, r.item) for r in decontam.contaminated(docs, benchmark).collect()}
    assert got == {(1, 0), (2, 0), (3, 1)}
    kept = decontam.keep_clean(docs, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6]


def test_decontamination_in_blocks_and_empty(spark, sf_dir, odder):
    benchmark = queries.table(spark, sf_dir, "benchmark")
    blocks = list(decontam.read_blocks(benchmark, "item_id", "text", 0.08, chars=1000))
    assert len(blocks) > 3 and sum(len(b.items) for b in blocks) == benchmark.count()
    assert decontam.contaminated(odder, benchmark).count() == 0
    assert decontam.contaminated(odder, benchmark.limit(0)).count() == 0
    assert decontam.keep_clean(odder, benchmark.limit(0)).count() == len(ODD)


def test_personal_data_base_spans():
    import re

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(digits):
        doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
        return sum(doubled) % 10 == 0

    def fine(kind, text):
        digits = re.sub("[^0-9]", "", text)
        if kind == "ip":
            return all(int(p) <= 255 for p in text.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    rng = random.Random(4)
    bits = ["a", "@", ".", "b1", "+", "1", "23", "-", " ", "(", ")", "4716", "299.1", "10.0.0.1", "4111 1111 1111 1111", "\n", "é", "x.y", "_", "%"]
    for _ in range(30000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        want = {k: [m.span() for m in re.finditer(p, text) if fine(k, m[0])] for k, p in patterns.items()}
        assert pii.base_spans(text) == want, text


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail joe (at) mail.example (dot) com now", "email", "joe (at) mail.example (dot) com"),
        ("joe at mail dot example dot com", "email", "joe at mail dot example dot com"),
        ("see jοe@exаmple.com.", "email", "jοe@exаmple.com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("ip one nine two dot one six eight dot one dot two x", "ip", "one nine two dot one six eight dot one dot two"),
        ("j​oe@example.com" .replace("​", "") + " a[at]b.de", "email", "a[at]b.de"),
    ],
)
def test_personal_data_in_disguise(text, kind, part):
    base, every = pii.find(text)
    start = text.index(part)
    assert (start, start + len(part)) in every[kind]
    assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)
    assert part not in pii.masked(text, every)


def test_personal_data_odd_rows(odder):
    assert pii.personal_data(odder).count() == len(ODD)
    masked = pii.mask(odder)
    assert masked.columns == odder.columns
    assert sorted(map(str, masked.collect())) == sorted(map(str, odder.collect()))


def test_token_shards(spark, sf_dir, texts, library, tmp_path):
    out = f"file://{tmp_path}/shards"
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    shards = tokenshards.write_shards(queries.table(spark, sf_dir, "documents"), path, out, shard_bytes=60_000)
    rows = tokenshards.read_shards(spark, out).collect()
    assert shards > 3
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    want = {}
    for i, text in texts.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u2")
        want |= {(i, s): ids[a : a + 256] for s, a in enumerate(range(0, len(ids), 256))}
    assert {(r.id, r.seq): r.ids_sha256 for r in rows} == {k: hashlib.sha256(v.tobytes()).hexdigest() for k, v in want.items()}
    some = sorted((r for r in rows if r.shard == rows[0].shard), key=lambda r: r.at)
    got = tokenshards.read_slots(spark, out, rows[0].shard, 2, 3)
    assert [g.tolist() for g in got] == [want[r.id, r.seq].tolist() for r in some[2:5]]
    assert len(tokenshards.read_slots(spark, out, rows[0].shard, len(some) - 1, 9)) == 1
    assert tokenshards.read_slots(spark, out, rows[0].shard, len(some) + 5, 2) == tokenshards.read_slots(spark, out, shards + 1, 0, 1) == []
    assert [r.at for r in some] == [n * tokenshards.stride(256, 2) for n in range(len(some))]


def test_token_shards_odd_rows(spark, odder, tmp_path):
    out = f"file://{tmp_path}/odd"
    tokenshards.write_shards(odder, queries.vocabulary("byte_bpe_50k.tiktoken"), out)
    rows = tokenshards.read_shards(spark, out).collect()
    assert {r.id for r in rows} == {3, 4, 5, 6, 7, None}
    empty = f"file://{tmp_path}/empty"
    tokenshards.write_shards(odder.limit(0), queries.vocabulary("byte_bpe_50k.tiktoken"), empty)
    assert tokenshards.read_shards(spark, empty).count() == 0


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_token_shards_deal_repeated_rows_apart(spark, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr(tokenshards, "COPIES", 10)
    monkeypatch.setattr(tokenshards, "BROADCAST_ROWS", broadcast_rows)
    rows = [(None, "the same text without an id")] * 200 + [(1, "another")] * 5 + [(2, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = f"file://{tmp_path}/same{broadcast_rows}"
    shards = tokenshards.write_shards(docs, queries.vocabulary("byte_bpe_50k.tiktoken"), out, shard_bytes=700)
    got = tokenshards.read_shards(spark, out).collect()
    assert sorted(r.slot for r in got) == list(range(305)) and shards > 5
    held = [sum(r.shard == s and r.id is None for r in got) for s in range(shards)]
    assert sum(held) == 200 and max(held) < 80


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(size):
    got = tokenshards.feistel(np.arange(size), size, 99)
    assert sorted(got) == list(range(size))
    assert size < 60 or (got != tokenshards.feistel(np.arange(size), size, 98)).any()


def test_empty_table(spark, odd, sf_dir):
    empty = odd.limit(0)
    labels, benchmark = queries.table(spark, sf_dir, "labels"), queries.table(spark, sf_dir, "benchmark")
    assert simhash.near_duplicates(empty).count() == 0
    assert quality.scores(empty, quality.train(empty, labels)).count() == 0
    assert bpe.round_trip(empty, queries.vocabulary()).count() == 0
    assert tokencount.token_counts(empty, queries.vocabulary()).count() == 0
    assert substring.digests(empty).count() == 0
    assert decontam.contaminated(empty, benchmark).count() == 0
    assert pii.personal_data(empty).count() == 0
