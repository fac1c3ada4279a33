"""Source mixing and hard negatives against plain versions."""

import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import mixing, negatives, queries


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """Sources fill up to their stops one after the other."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, full = Fraction(sum(sizes.values())), {}
    while True:
        open_ = sum(w for s, w in weight.items() if s not in full)
        over = [s for s in names if s not in full and rest * weight[s] > most * sizes[s] * open_]
        if not over:
            return {s: float(full[s] if s in full else rest * weight[s] / open_) for s in names}
        for s in over:
            full[s] = Fraction(most * sizes[s])
        rest = sum(sizes.values()) - sum(full.values())


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing_query(spark, sf_dir):
    docs = {r.doc_id: r for r in queries.table(spark, sf_dir, "documents").collect()}
    got = queries.op12_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sizes, taken = {}, {}
    for r in got:
        d = docs[r.doc_id]
        assert r.size == words(d.text) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[d.source] = sizes.get(d.source, 0) + r.size
        taken[d.source] = taken.get(d.source, 0) + r.taken
    want = slow_targets(sizes)
    for r in got:
        source = docs[r.doc_id].source
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source], rel=1e-12)
    for source, total in taken.items():
        own = [words(d.text) for d in docs.values() if d.source == source]
        sums = {int(want[source] // sizes[source]) * sizes[source]}
        for size in own:
            sums |= {s + size for s in sums}
        assert abs(total - want[source]) == pytest.approx(max(0, min(abs(s - want[source]) for s in sums)), abs=0.51)
    assert sorted(got) == sorted(queries.op12_mixing(spark, sf_dir).collect())


def test_near_sum_is_the_nearest():
    rng = random.Random(3)
    for _ in range(300):
        size = np.array(sorted(rng.sample(range(0, 30), rng.randint(1, 5))))
        left = np.array([rng.randint(0, 4) for _ in size])
        budget = rng.uniform(0, 60)
        got = mixing.near_sum(size, left, budget)
        assert (got >= 0).all() and (got <= left).all()
        best = min(abs(sum(s * k for s, k in zip(size, ks, strict=True)) - budget) for ks in itertools.product(*(range(n + 1) for n in left)))
        assert abs(int((size * got).sum()) - budget) == pytest.approx(best, abs=1e-9)


def test_counts_follow_the_lengths():
    size, count = np.arange(1, 400), np.full(399, 50)
    got = mixing.counts_for(size, count, 0.37 * float((size * count).sum()))
    assert (got <= count).all() and abs(int((size * got).sum()) - 0.37 * int((size * count).sum())) <= 0.5
    assert abs(got - 0.37 * count).mean() < 1.5


def test_mixing_cuts_full_lengths(spark, monkeypatch):
    """Few buckets, many documents of one length and many equal rows, so that every way of cutting is met."""
    monkeypatch.setattr(mixing, "BITS", 2)
    rows = [(i, "a b c", "x", 0) for i in range(700)] + [(9, "a b c", "x", 0)] * 300 + [(i, "w " * (1 + i % 7), "y", 0) for i in range(40)] + [(None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    taken = mixing.shares(docs)
    got = taken.collect()
    assert len(got) == len(rows)
    sizes = {"x": 3000, "y": sum(1 + i % 7 for i in range(40)), None: 0}
    want = slow_targets(sizes)
    for source in sizes:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - want[source]) <= 3 and {r.source_size for r in own} == {sizes[source]}
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1
    mix = mixing.mixed(docs, taken)
    assert mix.columns == docs.columns
    assert mix.where("text is not null").count() == sum(r.copies for r in got if r.size)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.shares(docs.repartition(7)).collect()))


def test_mixing_odd_tables(spark):
    shape = "doc_id long, text string, source string, target string, copies int"
    assert mixing.shares(spark.createDataFrame([], shape)).count() == 0
    empty = spark.createDataFrame([(1, "", "a", "t", 1), (2, None, None, None, None)], shape)
    assert sorted((r.id, r.size, r.target, r.copies) for r in mixing.shares(empty).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    long = spark.createDataFrame([(1, "w " * 300_000, "a", "t", 1), (2, "v", "b", "t", 1)], shape)
    got = {r.id: (r.size, round(r.target), r.copies) for r in mixing.shares(long).collect()}
    assert got == {1: (300_000, 299_998, 1), 2: (1, 3, 3)}


def slow_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    good = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(256 * x) for x in v)]
    found = []
    for anchor, label, own in {(i, lab, tuple(v)) for i, lab, v in good if is_anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i, lab) for i, lab, v in good if i != anchor and len(v) == len(own))
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(s, i) for s, i, lab in scored if lab != label and low * -p <= 100 * -s <= high * -p]
            found += [(anchor, positive, r, i, -p, -s) for r, (s, i) in enumerate(fit[:negatives], 1)]
    return sorted(found)


@pytest.mark.parametrize("block", [4_096, 3])
def test_negatives_with_overlapping_windows(spark, block, monkeypatch):
    monkeypatch.setattr(negatives, "CELLS", 64)  # many small pieces, so that winners are replaced
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 8))
    rows = [(i, i % 4 if i % 11 else None, (centre[i % 4] * rng.uniform(0.3, 1) + rng.normal(scale=0.4, size=8)).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, i % 2, rows[5][2]) for i in range(60)]  # ties
    frame = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = negatives.hard_negatives(frame, F.col("vec_id") % 20 == 0, block=block)
    want = slow_negatives(rows, lambda i: i % 20 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_negatives_odd_rows(spark):
    nan = float("nan")
    rows = [(0, 1, [1.0, 0.0], 1), (1, 1, [1.0, 0.1], 1), (2, 2, [0.5, 0.2], 1), (2, 2, [0.5, 0.2], 1), (3, 2, [0.7, 0.0], 1), (4, 2, None, 1), (5, None, [0.5, 0.0], 1),
            (6, 2, [nan, 0.5], 1), (7, 2, [None, 0.5], 1), (8, 2, [0.6], 1), (None, 2, [0.6, 0.0], 1), (0, 1, [1.0, 0.0], 1), (9, 2, [1e308, 0.0], 1), (10, 2, [], 1),
            (20, 3, [3e9, 1.0], 1), (21, 3, [2e9, 1.0], 1), (22, 4, [1e9, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>, place int")
    got = sorted(map(tuple, negatives.hard_negatives(frame, F.col("vec_id") % 20 == 0).collect()))
    assert [r[:4] for r in got if r[0] == 0] == [(0, 1, 1, 3), (0, 1, 2, 2), (0, 1, 3, 2)]
    assert not [r for r in got if r[0] == 20 and r[4] < 2**63 - 1]  # beyond a long: clipped
    assert negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
