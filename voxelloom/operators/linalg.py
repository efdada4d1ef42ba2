"""Small dense algebra in column expressions: matrices are lists of lists of columns, or array<array<double>> where they are eliminated."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = list[list[Column]]


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[sum((a[i][k] * b[k][j] for k in range(1, len(b))), a[i][0] * b[0][j]) for j in range(len(b[0]))] for i in range(len(a))]


def transposed(a: Matrix) -> Matrix:
    return [list(r) for r in zip(*a)]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def determinant3(a: Matrix) -> Column:
    return dot(a[0], cross(a[1], a[2]))


def augmented(a: Matrix, b: list[Column]) -> Column:
    return F.array(*[F.array(*[v.cast("double") for v in (*row, x)]) for row, x in zip(a, b)])


def solved(rows: DataFrame, system: Column, n: int, name: str, floor: float = 1e-14) -> DataFrame:
    """Adds ``name``: the solution of an augmented n x (n + 1) system by elimination with the largest pivot of each
    column, or null where every pivot left is at most ``floor``."""
    out = rows.withColumn("_m", system)
    for k in range(n):
        out = out.withColumn("_p", _largest(k, n))
        m, p = F.col("_m"), F.col("_p")
        out = out.withColumn("_m", F.transform("_m", lambda r, i: F.when(i == k, F.get(m, p)).when(i == p, F.get(m, F.lit(k))).otherwise(r)))
        out = out.withColumn("_top", F.when(F.abs(m[k][k]) > floor, F.transform(m[k], lambda v: v / m[k][k])))
        top = F.col("_top")
        out = out.withColumn("_m", F.transform("_m", lambda r, i: F.when(i == k, top).otherwise(F.zip_with(r, top, lambda a, b: a - F.get(r, F.lit(k)) * b))))
    return out.withColumn(name, F.when(F.forall("_m", lambda r: r.isNotNull()), F.transform("_m", lambda r: F.get(r, F.lit(n))))).drop("_m", "_p", "_top")


def _largest(k: int, n: int) -> Column:
    """The row at or below k with the largest entry in column k, the first of equal ones."""
    sizes = F.transform(F.slice("_m", k + 1, n - k), lambda r, i: F.struct(F.abs(F.get(r, F.lit(k))).alias("v"), (-i).alias("i")))
    return k - F.array_max(sizes)["i"]


def eigenvalues3(rows: DataFrame, a: Matrix, names: tuple[str, str, str] = ("e1", "e2", "e3")) -> DataFrame:
    """Adds the eigenvalues of a symmetric matrix, largest first: the trigonometric roots, each that is well apart with a Newton step."""
    q = (a[0][0] + a[1][1] + a[2][2]) / 3
    off = a[0][1] * a[0][1] + a[0][2] * a[0][2] + a[1][2] * a[1][2]
    out = rows.withColumns({"_q": q, "_off": off})
    d = [a[i][i] - F.col("_q") for i in range(3)]
    out = out.withColumn("_p", F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * F.col("_off")) / 6))
    det = determinant3([[d[0], a[0][1], a[0][2]], [a[0][1], d[1], a[1][2]], [a[0][2], a[1][2], d[2]]])
    half = F.when(F.col("_p") > 0, det / (2 * F.col("_p") * F.col("_p") * F.col("_p"))).otherwise(0.0)
    out = out.withColumns({"_f": F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3, "_d": determinant3(a), "_c": a[0][0] * a[1][1] + a[0][0] * a[2][2] + a[1][1] * a[2][2] - off})
    out = out.withColumns({n: F.col("_q") + 2 * F.col("_p") * F.cos(F.col("_f") + t) for n, t in zip(names, (0.0, -2 * pi / 3, 2 * pi / 3))})

    def newton(n: str) -> Column:
        x = F.col(n)
        slope = 3 * x * x - 6 * F.col("_q") * x + F.col("_c")
        return F.when(F.abs(slope) > 1e-6 * (F.col("_q") * F.col("_q") + F.col("_p") * F.col("_p")), x - (((x - 3 * F.col("_q")) * x + F.col("_c")) * x - F.col("_d")) / slope).otherwise(x)

    return out.withColumns({n: newton(n) for n in names}).drop("_q", "_off", "_p", "_f", "_d", "_c")


def eigenvector3(rows: DataFrame, a: Matrix, value: str, name: str) -> DataFrame:
    """Adds ``name``: the unit eigenvector (its sign is free) of a symmetric matrix for a simple eigenvalue, as the longest
    product of two rows of A - value; of nulls where there is none."""
    m = [[a[i][j] - F.col(value) * (1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    options = [cross(m[i], m[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    best = F.array_max(F.array(*[F.struct(dot(v, v).alias("n"), F.array(*v).alias("v")) for v in options]))
    out = rows.withColumn("_best", best)
    return out.withColumn(name, F.transform("_best.v", lambda v: F.when(F.col("_best.n") > 0, v / F.sqrt(F.col("_best.n"))))).drop("_best")
