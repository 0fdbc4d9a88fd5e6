"""Hard negatives and whitening against brute force, with awkward rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlake.llm import negatives, whitening
from revlake.llm.negatives import Rules, hard_negatives
from revlake.llm.spectra import Spectrum, rank_one
from revlake.llm.vectors import usable
from revlake.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, scores string, block long, a_ids string, node long, n long, shard int"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    out = [(k, r.normal(0, 0.4, 6).astype(np.float32).tolist(), int(r.integers(0, 3))) for k in range(260)]
    out += [(300 + k, out[0][1], k % 3) for k in range(40)]  # ties with one another, a crowd of one vector
    out += [(400, [0.0] * 6, 1), (401, [0.0] * 6, 1), (402, [0.0] * 6, 2)]  # scores of nothing
    out += [(20, out[20][1], out[20][2])]  # a repeated row
    odd = [
        (500, None, 1), (520, [], 1), (540, [1.0, None] + [0.0] * 4, 1), (560, [math.nan] + [0.0] * 5, 1),
        (580, [math.inf] + [0.0] * 5, 1), (600, [1.0, 2.0], 1), (620, out[3][1], None), (640, [1e9] + [0.0] * 5, 1),
    ]
    return out, odd


def brute(rows, every, rules=Rules()):
    kept = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), label) for i, v, label in rows]
    out = []
    for a, va, la in {i: (i, v, label) for i, v, label in kept if i % every == 0}.values():
        scored = sorted((-int(va @ v), i, label) for i, v, label in kept if i != a)
        scored_all = sorted((-int(va @ v), i, label) for i, v, label in kept)
        for s, p, _ in [x for x in scored if x[2] == la][: rules.positives]:
            inside = [x for x in scored_all if x[2] != la and rules.low * -s <= 100 * -x[0] <= rules.high * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside[: rules.negatives])]
    return sorted(out)


@pytest.mark.parametrize("sent, block", [(1 << 20, 8192), (0, 64)])
def test_hard_negatives_equal_brute_force(spark, rows, monkeypatch, sent, block):
    """With anchors sent along, and dealt out by pairs of small blocks."""
    monkeypatch.setattr(negatives, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    good, odd = rows
    frame = table(spark, good + odd).repartition(5)
    got = hard_negatives(frame, F.col("vec_id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(good, 20)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_hard_negatives_with_other_rules(spark, rows):
    rules = Rules(positives=2, negatives=3, low=0, high=100)
    good, _ = rows
    got = hard_negatives(table(spark, good), F.col("vec_id") % 50 == 0, rules)
    assert sorted(map(tuple, got.collect())) == brute(good, 50, rules)


def test_hard_negatives_of_nothing(spark, rows):
    _, odd = rows
    assert hard_negatives(table(spark, []), F.lit(True)).count() == 0
    one = table(spark, [(None, [1.0], 1), (100, [1.0], 1), (101, [1.0], None)])
    assert hard_negatives(one, F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(table(spark, [(1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") % 100 == 0).count() == 0


def test_lengths_and_whole_vectors(spark, rows):
    good, odd = rows
    kept, length = usable(table(spark, good + odd), "embedding", 2.0**17)
    assert length == 6 and {r.vec_id for r in kept.collect()} == {r[0] for r in good} | {620}


def check_whitened(got, vectors, components):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    cov = (off / n).T @ (off / n) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    white = (off / n) @ axes / np.sqrt(values)
    by = {}
    for row in got:
        by.setdefault(row.vec_id, []).append(row)
    assert len(got) == n * components
    for k in range(components):
        sign = None
        for at, own in enumerate(by):
            row = sorted(by[own], key=lambda r: r.component)[k]
            assert row.component == k + 1 and row.n == n and row.deviation == int((off[own] ** 2).sum())
            assert row.explained == pytest.approx(values[k] / np.trace(cov), rel=1e-9)
            assert row.identity_error < 1e-9
            if sign is None and abs(white[own, k]) > 0.1:
                sign = np.sign(row.whitened * white[own, k])
            if sign is not None:
                assert row.whitened == pytest.approx(sign * white[own, k], abs=1e-8)


def test_whitening_equals_dense_solution(spark):
    r = np.random.default_rng(3)
    vectors = (r.normal(0, 1, (400, 9)) * np.linspace(0.2, 3, 9)).astype(np.float32)
    vectors[200:330] = vectors[0]  # a third of all rows are one vector
    odd = [(900, None, 1), (901, [1.0, None] + [0.0] * 7, 1), (902, [math.nan] * 9, 1), (903, [1.0], 1), (904, [math.inf] * 9, 1)]
    frame = table(spark, [(k, v.tolist(), None) for k, v in enumerate(vectors)] + odd).repartition(7)
    check_whitened(whiten(frame).collect(), vectors, 9)
    check_whitened(whiten(frame, components=4).collect(), vectors, 4)


def test_many_tasks_combine_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    vectors = np.random.default_rng(8).normal(0, 1, (120, 4)).astype(np.float32)
    frame = table(spark, [(k, v.tolist(), None) for k, v in enumerate(vectors)]).repartition(9)
    check_whitened(whiten(frame).collect(), vectors, 4)


def test_whitening_without_variance(spark):
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, [1.0, 2.0], 1)])).count() == 0
    assert whiten(table(spark, [(k, [1.0, 2.0], 1) for k in range(9)])).count() == 0
    line = whiten(table(spark, [(k, [1.0, float(k)], 1) for k in range(9)] + [(None, [1.0, 3.0], 1)]))
    assert [r.component for r in line.collect()] == [1] * 10


def test_rank_one_updates_equal_dense_ones():
    r = np.random.default_rng(2)
    for length, n in ((1, 4), (3, 40), (12, 6), (20, 200)):
        x = np.floor(r.normal(0, 9, (n, length))).astype(np.int64) + 1_000_000
        x[:, -1] = x[:, 0]
        x[n // 2 :] = np.where(r.random(n - n // 2)[:, None] < 0.3, x[0], x[n // 2 :])
        parts = [Spectrum.empty(length) for _ in range(3)]
        for k, row in enumerate(x):
            parts[k % 2].add(row)
        both = parts[2]
        both.merge(parts[0])
        both.merge(parts[1])
        off = x - x.mean(axis=0)
        want = off.T @ off
        got = both.vectors * both.values @ both.vectors.T
        assert both.n == n and (both.sums == x.sum(axis=0)).all()
        assert np.abs(got - want).max() <= 1e-9 * max(1, want.max())
        assert np.abs(both.vectors.T @ both.vectors - np.eye(length)).max() < 1e-11
    times = Spectrum.empty(2)
    times.add(np.array([1, 2]), 3)
    times.add(np.array([4, 2]), 2)
    assert times.values == pytest.approx([0, 3 * 2 / 5 * 9])
    d, q = rank_one(np.zeros(3), np.eye(3), 2.0, np.zeros(3))
    assert (d == 0).all() and (q == np.eye(3)).all()
