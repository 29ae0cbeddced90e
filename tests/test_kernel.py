"""The kernel classifier (ML12) against plain numpy, and on classes no plane separates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fpengine.operators import kernel


def rings(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    angle, radius = rng.uniform(0, 2 * np.pi, n), 1.0 + label + 0.15 * rng.normal(size=n)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle), 0.1 * rng.normal(size=n)], axis=1)
    weight = 1.0 + (label == 1)
    rows = [(i, [float(v) for v in x[i]], float(label[i]), int(i % 5), float(weight[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x array<double>, label double, fold int, weight double").repartition(5), x, label, weight


def test_rings_and_sums(spark):
    df, x, label, weight = rings(spark)
    odd = spark.createDataFrame([(900, None, 0.0, 0, 1.0), (901, [1.0], 0.0, 0, 1.0), (902, [1.0, float("nan"), 0.0], 1.0, 0, 1.0),
                                 (903, [1.0, 0.0, 0.0], None, 0, 1.0)], df.schema)
    model = kernel.fit_grid(df.union(odd), gammas=(1e-4, 3.0), costs=(0.1, 100.0), features=128)
    grid = {(g, c): f for g, c, f in model.grid}
    assert len(grid) == 4 and model.best[0] == 3.0
    assert max(grid[3.0, c] for c in (0.1, 100.0)) > 0.95
    assert max(grid[1e-4, c] for c in (0.1, 100.0)) < 0.75  # nearly linear
    # the coefficients are those of one weighted least-squares problem over all rows
    z = kernel.fourier((x - x.mean(0)) / x.std(0), model.base, model.gamma)
    y = np.where(label[:, None] == np.arange(3), 1.0, -1.0)
    want = kernel.solve((z * weight[:, None]).T @ z, (z * weight[:, None]).T @ y, model.best[1])
    assert np.allclose(z @ model.coef, z @ want, atol=1e-6)
    got = model.predict(df.union(odd)).orderBy("id").collect()
    assert [r.id for r in got] == [*range(600), 903]
    assert [r.prediction for r in got[:600]] == (z @ want).argmax(1).tolist()
    # cross-validation by hand for the best point
    f1 = []
    for f in range(5):
        m = np.arange(600) % 5 == f
        zw = z[~m] * weight[~m, None]
        p = (z[m] @ kernel.solve(zw.T @ z[~m], zw.T @ y[~m], model.best[1])).argmax(1)
        f1.append(np.mean([2 * np.sum((p == k) & (label[m] == k)) / (np.sum(p == k) + np.sum(label[m] == k)) for k in range(3)]))
    assert abs(np.mean(f1) - grid[model.best]) < 1e-9


def test_fourier_columns_approach_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4))
    z = kernel.fourier(x, rng.normal(size=(4, 20_000)), 0.3)[:, :-1]
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_empty(spark):
    df, *_ = rings(spark, 10)
    with pytest.raises(ValueError):
        kernel.fit_grid(df.where(F.lit(False)))
