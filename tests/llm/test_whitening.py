import random

from tests.llm import brute_new as brute
import numpy as np
import pytest

from veilspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, w string"


def _vectors(n, dims, seed=3):
    rnd = random.Random(seed)
    return [[float(np.float32(rnd.gauss(0.1 * k, 0.05 * (k + 1)))) for k in range(dims)] for _ in range(n)]


def _compare(spark, rows, components=8):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    got = sorted(whitening.whiten(df, components=components).collect(), key=lambda r: (str(r.id), r.component))
    want = sorted(brute.whitening(rows, components), key=lambda r: (str(r[0]), r[1]))
    assert [(r.id, r.component, r.n, r.deviation) for r in got] == [w[:4] for w in want]
    assert np.allclose([abs(r.whitened) for r in got], [w[4] for w in want], atol=1e-9)
    assert np.allclose([r.explained for r in got], [w[5] for w in want], rtol=1e-9)
    assert all(r.identity_error < 1e-9 for r in got)


def test_against_direct_covariances(spark):
    _compare(spark, list(enumerate(_vectors(300, 12))))


def test_fewer_dimensions_than_components(spark):
    _compare(spark, list(enumerate(_vectors(40, 3))))


def test_odd_rows_are_dropped_and_repeats_count(spark):
    good = list(enumerate(_vectors(50, 5)))
    odd = [(90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [float("nan")] * 5), (94, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    _compare(spark, good + odd + [(7, good[7][1]), (None, good[8][1])])


def test_other_lengths_are_dropped(spark):
    rows = list(enumerate(_vectors(20, 4))) + [(50 + i, v) for i, v in enumerate(_vectors(9, 6))]
    df = spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA)
    assert {r.id for r in whitening.whiten(df).collect()} == set(range(20))


def test_without_variance(spark):
    df = spark.createDataFrame([(i, [0.5, 0.25], "", "") for i in range(3)], SCHEMA)
    got = whitening.whiten(df).collect()
    assert len(got) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in got)


def test_one_flat_direction(spark):
    df = spark.createDataFrame([(i, [i / 8, 0.25], "", "") for i in range(9)], SCHEMA)
    got = whitening.whiten(df).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got)
    assert got[0].identity_error < 1e-9


def test_squares_beyond_machine_integers():
    rnd = random.Random(5)
    values = [[rnd.randrange(-(1 << 61), 1 << 61) for _ in range(3)] for _ in range(100)]
    want = [sum(r[k] ** 2 for r in values) for k in range(3)]
    assert whitening._squares(np.array(values)) == want
    assert whitening._squares(np.array(values, object)) == want


def test_centring_beyond_machine_integers():
    x = np.array([[100_000 + 500], [100_000 - 20]])
    n = 1 << 60
    assert whitening._centred(x, n, [n * 100_000 + 7]).tolist() == [[n * 500 - 7], [n * -20 - 7]]


def test_too_large_entries_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30], "", ""), (2, [0.0], "", "")], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(df).collect()


def test_empty_table(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
