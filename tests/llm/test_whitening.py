from fractions import Fraction

import numpy as np
import pytest

from fixlake.llm import whitening as wh


def table(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").repartition(3)


def exact_covariance(x):
    n, means = len(x), [Fraction(sum(int(v) for v in c), len(x)) for c in x.T]
    return np.array([[float(sum((int(a) - p) * (int(b) - q) for a, b in zip(x[:, i], x[:, j], strict=True)) / n) for j, q in enumerate(means)] for i, p in enumerate(means)])


def test_equals_definition(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    odd = [(900, None, 0), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (902, [float("nan")] * 6, 0), (903, [float("inf"), *[0.0] * 5], 0), (904, [], 0), (905, [1.0, 2.0], 0)]
    df = table(spark, rows + odd + [(None, vectors[0].tolist(), 1), rows[3]])
    x = np.floor(64 * np.vstack((vectors, vectors[:1], vectors[3:4])).astype(float)).astype(np.int64) + 1_000_000
    model = wh.fit(df, components=4)
    want = exact_covariance(x)
    assert model.n == 302 and np.array_equal(model.covariance, want)
    out = wh.whiten(df, components=4).toPandas()
    assert len(out) == 302 * 4 and out["component"].tolist().count(4) == 302
    values, axes = np.linalg.eigh(want)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    sums = x.sum(axis=0)
    mine = out[out.vec_id == 17].sort_values("component")
    projected = (x[17] - sums / len(x)) @ axes / np.sqrt(values)
    assert np.allclose(np.abs(mine.whitened), np.abs(projected), atol=1e-9)
    assert set(mine.deviation) == {sum((len(x) * int(v) - int(s)) ** 2 for v, s in zip(x[17], sums, strict=True))}
    assert np.allclose(mine.explained, values / np.trace(want), rtol=1e-12)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    signs = [np.sign(mine.whitened.values * projected)[k] for k in range(4)]
    other = out[out.vec_id == 40].sort_values("component").whitened.values * ((x[40] - sums / len(x)) @ axes / np.sqrt(values))
    assert all(s == np.sign(o) for s, o in zip(signs, other, strict=True))


def test_large_entries_stay_exact(spark):
    rows = [(0, [1e15, -3.0], 0), (1, [-1e15, 5.5], 0), (2, [2e15, 1.0], 0), (3, [1e300, 2.0], 0)]
    df = table(spark, rows, "array<double>")
    model = wh.fit(df)
    x = np.array([[min(max(int(np.floor(64 * c)), -wh.MOST), wh.MOST) + 1_000_000 for c in v] for _, v, _ in rows], dtype=object)
    assert np.allclose(model.covariance, exact_covariance(x), rtol=1e-15)
    assert {r.deviation for r in wh.whiten(df).collect()} == {None}


def test_components_without_variance_have_no_rows(spark):
    df = table(spark, [(i, [float(i), 2.0 * i, 7.0], 0) for i in range(5)])
    out = wh.whiten(df).collect()
    assert {r.component for r in out} == {1} and len(out) == 5 and abs(out[0].explained - 1) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)]])
def test_nothing_to_fit(spark, rows):
    out = wh.whiten(table(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.collect() == []


def test_ties_of_lengths_take_the_longer(spark):
    df = table(spark, [(1, [1.0], 0), (2, [2.0], 0), (3, [1.0, 0.0], 0), (4, [0.0, 2.0], 0)])
    assert {r.vec_id for r in wh.whiten(df).collect()} == {3, 4}
