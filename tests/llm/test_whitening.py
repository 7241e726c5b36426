"""Whitening against plain numpy, on vectors with nulls, copies, ties, several lengths and large numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lexispark.llm.whitening import whitened

SCHEMA = "vec_id long, embedding array<double>, label int, n int, component string, x string, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "c", "x", 3) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, size):
    """The distinct vectors' covariance by exact fractions, its eigenvalues, and every row's deviation."""
    own = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in own})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    v = np.array([[float(sum(Fraction(n * x[a] - sums[a], n) * Fraction(n * x[b] - sums[b], n) for x in fit) / n) for b in range(size)] for a in range(size)])
    return own, fit, n, sums, v


def check(got, rows, size, components=4):
    own, fit, n, sums, v = plain(rows, size)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, size)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, c + 1) for i, _ in own for c in range(k))
    of = {}
    for i, x in own:
        of.setdefault(i, []).append(x)
    for r in got:
        c = r.component - 1
        assert r.n == n and r.explained == pytest.approx(values[c] / np.trace(v), rel=1e-9)
        assert r.identity_error <= 1e-9
        x = np.array([[n * a - s for a, s in zip(x, sums)] for x in of[r.vec_id]], dtype=object)
        assert r.deviation in {int((d * d).sum()) for d in x}
        y = (x.astype(float) / n) @ axes[:, c] / math.sqrt(values[c])
        assert min(abs(abs(y) - abs(r.whitened))) < 1e-8
    # one sign for all rows
    for c in range(k):
        signs = {np.sign((np.array([n * a - s for a, s in zip(of[r.vec_id][0], sums)], dtype=float) / n) @ axes[:, c] * r.whitened) for r in got if r.component == c + 1 and abs(r.whitened) > 1e-6 and len(of[r.vec_id]) == 1}
        assert len(signs) == 1


def some(seed=5, n=60, size=6, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)) * np.arange(1, size + 1) + offset
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    return rows + [(500 + i, rows[3][1]) for i in range(40)] + [(7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1])]


def test_against_fractions(spark):
    rows = some()
    odd = [(900, None), (901, [None] * 6), (902, [1.0, 2.0, math.nan, 1.0, 1.0, 1.0]), (903, [math.inf] * 6), (904, [-0.0] * 6), (905, [0.0] * 6), (906, [1e300] * 6)]
    got = whitened(table(spark, rows + odd)).collect()
    check(got, rows + [(904, [-0.0] * 6), (905, [0.0] * 6)], 6)


def test_large_offset_keeps_its_digits(spark):
    rows = some(offset=2.0**38)
    check(whitened(table(spark, rows)).collect(), rows, 6)


def test_numbers_beyond_long_arithmetic(spark):
    rows = [(i, [2.0**52 + i * 2.0**40, -(2.0**51) + (i % 7) * 2.0**41]) for i in range(50)]
    own, fit, n, sums, v = plain(rows, 2)
    got = whitened(table(spark, rows)).collect()
    assert len(got) == 100 and all(r.deviation is None for r in got)
    assert {r.component: r.explained for r in got}[1] == pytest.approx(np.linalg.eigvalsh(v)[-1] / np.trace(v), rel=1e-9)


def test_lengths_are_spaces_of_their_own(spark):
    six, two = some(), [(2000 + i, [float(i), float(i * i % 11)]) for i in range(30)]
    got = whitened(table(spark, six + two + [(3000, [])])).collect()
    check([r for r in got if r.vec_id is None or r.vec_id < 2000], six, 6)
    check([r for r in got if r.vec_id is not None and r.vec_id >= 2000], two, 2)


def test_nothing_varies_and_nothing_there(spark):
    got = whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, None, None)] * 4
    flat = whitened(table(spark, [(i, [float(i), 1.0]) for i in range(5)])).collect()
    assert {(r.component, r.explained, r.whitened is None) for r in flat} == {(1, 1.0, False), (2, 0.0, True)}
    assert whitened(table(spark, [])).count() == 0 and whitened(table(spark, [(1, None)])).count() == 0
    assert whitened(table(spark, [])).columns == got[0].__fields__
