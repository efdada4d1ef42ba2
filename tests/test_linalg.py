"""Column algebra against numpy: pivots, singular systems, repeated eigenvalues."""

import numpy as np
from pyspark.sql import functions as F

from voxelloom.operators import linalg as A


def test_elimination(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 6):
        m = rng.integers(-3, 4, (40, n, n)).astype(float)  # zeros on the diagonal, and singular ones
        b = rng.normal(size=(40, n))
        data = [(i, np.c_[a, x].tolist()) for i, (a, x) in enumerate(zip(m, b))]
        got = {r.i: r.s for r in A.solved(spark.createDataFrame(data, "i long, m array<array<double>>"), F.col("m"), n, "s").collect()}
        for i in range(40):
            if abs(np.linalg.det(m[i])) < 1e-9:
                assert got[i] is None
            else:
                assert np.allclose(got[i], np.linalg.solve(m[i], b[i]), atol=1e-8)


def test_symmetric_eigen(spark):
    rng, data = np.random.default_rng(2), []
    for i in range(60):
        q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        e = [(3, 2, 1), (2, 2, 1), (5, 5, 5), (4, 1, 0), (0, 0, 0), tuple(rng.normal(size=3))][i % 6]
        data.append((i, *map(float, (q @ np.diag(e) @ q.T).ravel())))
    df = spark.createDataFrame(data, "i long, " + ", ".join(f"m{k} double" for k in range(9)))
    m = [[F.col(f"m{3 * i + j}") for j in range(3)] for i in range(3)]
    got = A.eigenvector3(A.eigenvalues3(df, m), m, "e3", "v").orderBy("i").collect()
    for r, row in zip(got, data):
        a = np.reshape(row[1:], (3, 3))
        w = np.linalg.eigvalsh((a + a.T) / 2)[::-1]
        assert np.allclose([r.e1, r.e2, r.e3], w, atol=1e-7)
        if w[1] - w[2] > 1e-3:
            assert np.allclose(a @ np.array(r.v), w[2] * np.array(r.v), atol=1e-6) and abs(np.linalg.norm(r.v) - 1) < 1e-9
