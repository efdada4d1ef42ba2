"""Column builders on splats, points and cameras: no row needs another row here."""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zeroth spherical-harmonic constant; weights of grey; channel statistics of the depth model's input.
SH0 = 0.28209479
GRAY = (77, 150, 29)
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)
# Coefficients of the turbo colour map, of rising power.
TURBO = {
    "r": (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    "g": (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    "b": (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def trunc(c: Column) -> Column:
    """Towards zero, as an integer column; callers clamp first where it could overflow."""
    return c.cast("int")


#: Exponentials at multiples of 1/64 up to this size, each as a double and what it leaves.
_NEAR, _STEP = 8, 64


@cache
def _exponentials() -> tuple[str, str]:
    with localcontext() as c:
        c.prec = 50
        whole = [(Decimal(i) / _STEP).exp() for i in range(-_NEAR * _STEP, _NEAR * _STEP + 1)]
        rest = [float(v - Decimal(float(v))) for v in whole]
    return tuple("array(" + ", ".join(f"{v!r}D" for v in vs) + ")" for vs in (map(float, whole), rest))


def _exp_parts(x: Column) -> tuple[Column, Column]:
    """exp(x) as a double and a small addition, which hold it to some 60 bits together; |x| of at most ``_NEAR``."""
    k = F.rint(x * _STEP)
    big, small = (F.get(F.expr(t), (k + _NEAR * _STEP).cast("int")) for t in _exponentials())
    return big, small + big * F.expm1(x - k / _STEP)


def _once(c: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(c), f)[0]


def exp(c: str | Column) -> Column:
    """The double next to the exponential, where Spark's own may be its neighbour and so decide ties otherwise than C's."""
    return _once(col(c), lambda x: F.when(F.abs(x) <= _NEAR, sum(_exp_parts(x))).otherwise(F.exp(x)))


def ln(c: str | Column) -> Column:
    """The double next to the logarithm: Spark's own, corrected by what its exponential leaves."""

    def corrected(p: Column) -> Column:
        big, small = _exp_parts(p["y"])
        return F.when(F.abs(p["y"]) <= _NEAR, p["y"] + ((p["v"] - big) - small) / p["v"]).otherwise(p["y"])

    return _once(F.struct(col(c).alias("v"), F.ln(col(c)).alias("y")), corrected)


def sigmoid(c: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col(c)))


def logit(p: Column) -> Column:
    return F.ln(p / (1.0 - p))


def sh_to_rgb(c: str | Column) -> Column:
    return 0.5 + SH0 * col(c)


def rgb_to_sh(c: str | Column) -> Column:
    return (col(c) - 0.5) / SH0


def unit_quaternion(w="rot_w", x="rot_x", y="rot_y", z="rot_z") -> list[Column]:
    """Unit length; the zero quaternion becomes the identity."""
    parts = [col(c) for c in (w, x, y, z)]
    n = F.sqrt(sum(c * c for c in parts))
    return [F.when(n > 0, c / n).otherwise(1.0 if i == 0 else 0.0) for i, c in enumerate(parts)]


def rotation(q: list[Column]) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def covariance(scales: list[Column], q: list[Column]) -> dict[str, Column]:
    """Six terms of R diag(s^2) R^T for linear scales s."""
    r = rotation(q)
    term = lambda i, j: reduce(lambda a, b: a + b, (r[i][k] * r[j][k] * scales[k] * scales[k] for k in range(3)))
    return {f"c{i}{j}": term(i, j) for i in range(3) for j in range(i, 3)}


def transform_point(r: list[list], t: list, p: list[Column]) -> list[Column]:
    """R p + t; entries of R and t may be numbers or columns."""
    return [r[i][0] * p[0] + r[i][1] * p[1] + r[i][2] * p[2] + t[i] for i in range(3)]


def camera_centre(r: list[list], t: list) -> list[Column]:
    """-R^T t."""
    return [-(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2]) for i in range(3)]


def det3(m: list[list]) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def symmetric_inverse3(a, b, c, d, e, f, floor: float = 1e-15) -> list[Column]:
    """Inverse of [[a b c] [b d e] [c e f]] by the adjugate; a determinant near zero is floored."""
    det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    det = F.when(F.abs(det) < floor, F.lit(floor)).otherwise(det)
    return [x / det for x in (d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b)]


def angle_axis(r: list[list]) -> list[Column]:
    """Rodrigues logarithm; near the identity the skew part itself."""
    skew = [(r[2][1] - r[1][2]) / 2, (r[0][2] - r[2][0]) / 2, (r[1][0] - r[0][1]) / 2]
    cos = F.least(F.greatest((r[0][0] + r[1][1] + r[2][2] - 1) / 2, F.lit(-1.0)), F.lit(1.0))
    theta, sin = F.acos(cos), F.sqrt(1 - cos * cos)
    return [F.when(sin > 1e-6, s * theta / F.when(sin > 1e-6, sin)).otherwise(s) for s in skew]


def rotation_from_angle_axis(a: list[Column]) -> list[list[Column]]:
    """Rodrigues exponential; first order below an angle of 1e-5."""
    t2 = a[0] * a[0] + a[1] * a[1] + a[2] * a[2]
    t = F.sqrt(t2)
    big = t2 > 1e-10
    s = F.when(big, F.sin(t) / F.when(big, t)).otherwise(1.0)
    c = F.when(big, (1 - F.cos(t)) / F.when(big, t2)).otherwise(0.0)
    k = [[F.lit(0.0), -a[2], a[1]], [a[2], F.lit(0.0), -a[0]], [-a[1], a[0], F.lit(0.0)]]
    return [[(1.0 if i == j else 0.0) + s * k[i][j] + c * (a[i] * a[j] - (t2 if i == j else 0.0)) for j in range(3)] for i in range(3)]


def gray(r="r", g="g", b="b") -> Column:
    return F.shiftright(GRAY[0] * col(r) + GRAY[1] * col(g) + GRAY[2] * col(b), 8)


def pack_rgba(r="r", g="g", b="b", a="a") -> Column:
    """One 64-bit value, red in the low byte."""
    one = [F.shiftleft(col(c).cast("long"), 8 * i) for i, c in enumerate((r, g, b, a))]
    return reduce(lambda x, y: x.bitwiseOR(y), one)


def unpack_rgba(c: str | Column) -> list[Column]:
    return [F.shiftright(col(c), 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(4)]


def horner(coefficients, t: Column) -> Column:
    return reduce(lambda acc, c: acc * t + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def turbo(t: Column) -> dict[str, Column]:
    """Colour bytes of a value in 0..1."""
    return {k: trunc(clamp(horner(c, t), 0.0, 1.0) * 255.0) for k, c in TURBO.items()}


def depth_key(distance: Column, bits: int) -> Column:
    """Integer sort key of a distance: 16 bits in steps of 1/500, 32 bits in steps of 1/10000, clamped before the cast."""
    scale, top = (500.0, 65534.0) if bits == 16 else (10000.0, 2147483647.0)
    return F.least(distance * scale, F.lit(top)).cast("int")


def yaw_pitch_forward(yaw: Column, pitch: Column) -> list[Column]:
    return [F.cos(pitch) * F.sin(yaw), F.sin(pitch), -F.cos(pitch) * F.cos(yaw)]


def sampson(e: list[list[float]], xa, ya, xb, yb) -> Column:
    """First-order epipolar error of a correspondence under E, squared."""
    ex = [e[i][0] * xa + e[i][1] * ya + e[i][2] for i in range(3)]
    et = [e[0][j] * xb + e[1][j] * yb + e[2][j] for j in range(2)]
    n = xb * ex[0] + yb * ex[1] + ex[2]
    return n * n / (ex[0] * ex[0] + ex[1] * ex[1] + et[0] * et[0] + et[1] * et[1] + 1e-10)


def hamming(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(p).bitwiseXOR(F.col(q))) for p, q in zip(a, b)))
