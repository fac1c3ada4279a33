"""Periodic runs against a plain search over all periods."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import periods


def slow_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(6, 4 * q):
                found.setdefault((start, length), q)
            i = max(i, start + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def runs_of(*texts):
    return [list(map(tuple, r.tolist())) for r in periods.find_runs([[b"%d" % w for w in t] for t in texts])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=3))
def test_runs_of_few_words(texts):
    assert runs_of(*texts) == [slow_runs(t) for t in texts]


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_repeated_stretches(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        text = [rng.randrange(5) for _ in range(rng.randint(0, 3))]
        while len(text) < 250:
            unit = [rng.randrange(6) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 13, 30]))]
            unit = unit * rng.randint(1, 3) + [rng.randrange(9) for _ in range(rng.randint(0, 2))]
            text += unit * rng.randint(1, 6)
        texts.append(text)
    assert runs_of(*texts) == [slow_runs(t) for t in texts]


def test_grammar_expands_to_the_text():
    import numpy as np

    rng = random.Random(2)
    words = np.array([rng.randrange(3) for _ in range(400)])
    part = np.repeat(np.arange(4), 100)
    grammar, roots, places = periods.compressed(words.copy(), np.arange(400), part, 3)

    def expanded(s):
        return [s] if s < 3 else expanded(grammar.left[s - 3]) + expanded(grammar.right[s - 3])

    assert [expanded(r) for r in roots] == [words[i : i + 100].tolist() for i in range(0, 400, 100)]
    assert places.tolist() == [0, 100, 200, 300]
    for s in range(3, len(grammar.size)):
        at = grammar.first[s - 3]
        assert expanded(s) == words[at : at + grammar.size[s]].tolist()


def test_long_texts_are_whole():
    rng = random.Random(7)
    noise = [rng.randrange(10**6) for _ in range(50_000)]
    unit = [rng.randrange(10**6) for _ in range(20_000)]
    (got,) = runs_of(noise + unit * 4 + unit[:7] + noise[:9] + [3] * 6)
    assert got == [(50_000, 80_007, 20_000), (130_016, 6, 1)]
    assert runs_of([1] * 100_000) == [[(0, 100_000, 1)]]


def test_periodic_runs_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(periods, "GROUP_WORDS", 8)
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (None, "a a a a a a", 5), (4, "a a a\x0ba  a a a a b", 5), (4, "a a a\x0ba  a a a a b", 5),
            (5, "x y x y x y x y", 5), (6, "x y x y x y x", 5), (7, "A a A a A a", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((r.id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(frame).collect())
    assert got == [
        (0, [(0, 6, 1)], "a"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(1, 6, 1)], "a a a b"), (4, [(1, 6, 1)], "a a a b"),
        (5, [(0, 8, 2)], "x y"), (6, [], "x y x y x y x"), (7, [], "A a A a A a"),
    ]
    assert periods.periodic_runs(frame.limit(0)).count() == 0
