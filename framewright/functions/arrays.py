"""Sample arrays and small transforms as higher-order functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.integer import shr


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def clamp_samples(samples: Column) -> Column:
    """Samples within -1 and 1; a null result marks one that isn't finite."""
    bad = F.exists(samples, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(samples, lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))))


def scale(samples: Column, gain) -> Column:
    return F.transform(samples, lambda x: x * gain)


def energy(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)


def normalise(samples: Column) -> Column:
    """Unit length; silence stays silence."""
    return let(F.sqrt(energy(samples)), lambda n: F.when(n == 0, samples).otherwise(F.transform(samples, lambda x: x / n)))


def mid_side(mid: Column, side: Column) -> tuple[Column, Column]:
    return F.zip_with(mid, side, lambda m, s: m + s), F.zip_with(mid, side, lambda m, s: m - s)


def intensity(left: Column, position: Column, negate: Column) -> Column:
    gain = F.pow(F.lit(2.0), -position / 4) * F.when(negate, -1.0).otherwise(1.0)
    return F.transform(left, lambda x: x * gain)


def inverse_quantize(q: Column, scale_factor: Column) -> Column:
    gain = F.pow(F.lit(2.0), (scale_factor - 100) / 4)
    return F.transform(q, lambda x: F.signum(x.cast("double")) * F.pow(F.abs(x).cast("double"), F.lit(4.0 / 3)) * gain)


def deemphasis(samples: Column, coefficient: float = 27853 / 32768) -> Column:
    """y[n] = x[n] + coefficient * y[n - 1]."""
    start = F.struct(F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        y = x + s["y"] * coefficient
        return F.struct(y.alias("y"), F.concat(s["out"], F.array(y)).alias("out"))

    return F.aggregate(samples, start, step)["out"]


def wrapped_sum16(deltas: Column) -> Column:
    """Running sums of differences that wrap at 16 bits, signed."""
    start = F.struct(F.lit(0).cast("long").alias("y"), F.array().cast("array<long>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        y = F.pmod(s["y"] + x + 32768, F.lit(65536)) - 32768
        return F.struct(y.cast("long").alias("y"), F.concat(s["out"], F.array(y.cast("long"))).alias("out"))

    return F.aggregate(deltas, start, step)["out"]


def permute(values: Column, order: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(values, i))


# Zigzag order of 4x4 blocks.
ZIGZAG4 = [0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15]


def zigzag(n: int) -> list[int]:
    """Row-major places of an n x n block in zigzag order."""
    return [y * n + x for _, _, y, x in sorted((y + x, y if (y + x) % 2 else x, y, x) for y in range(n) for x in range(n))]


def unzigzag(levels: Column, n: int = 4) -> Column:
    order = zigzag(n)
    return permute(levels, [order.index(i) for i in range(n * n)])


def _rows(values: list[Column], n: int) -> list[list[Column]]:
    return [values[n * i : n * i + n] for i in range(n)]


def _at(block: Column, n: int) -> list[Column]:
    return [F.get(block, F.lit(i)) for i in range(n)]


def _step(block: Column, size: int, lines, kernel) -> Column:
    """A one-dimensional kernel over lines of a block, which is computed once, however often the kernel names a value of it."""

    def once(b: Column) -> Column:
        v = _at(b, size)
        out: list[Column] = list(v)
        for line in lines:
            for place, value in zip(line, kernel([v[i] for i in line]), strict=True):
                out[place] = value
        return F.array(*out)

    return let(block, once)


_ROWS4 = [[4 * r + c for c in range(4)] for r in range(4)]
_COLUMNS4 = [[4 * r + c for r in range(4)] for c in range(4)]


def inverse_residual4(block: Column) -> Column:
    """4x4 integer transform of scaled coefficients, rows then columns, rounded by 6 bits."""

    def kernel(x: list[Column]) -> list[Column]:
        a, b, c, d = x[0] + x[2], x[0] - x[2], shr(x[1], 1) - x[3], x[1] + shr(x[3], 1)
        return [a + d, b + c, b - c, a - d]

    once = _step(block, 16, _ROWS4, kernel)
    return F.transform(_step(once, 16, _COLUMNS4, kernel), lambda v: shr(v + 32, 6))


def inverse_walsh4(block: Column) -> Column:
    """4x4 Walsh-Hadamard transform, columns then rows, rounded by 3 bits."""

    def kernel(x: list[Column]) -> list[Column]:
        a, b, c, d = x[0] + x[3], x[1] + x[2], x[1] - x[2], x[0] - x[3]
        return [a + b, c + d, a - b, d - c]

    once = _step(block, 16, _COLUMNS4, kernel)
    return F.transform(_step(once, 16, _ROWS4, kernel), lambda v: shr(v + 3, 3))


def inverse_dct4(block: Column) -> Column:
    """4x4 DCT with 16-bit constants, columns then rows, rounded by 3 bits."""
    by_sin, by_cos = lambda v: shr(v * 35468, 16), lambda v: v + shr(v * 20091, 16)

    def kernel(x: list[Column]) -> list[Column]:
        a, b = x[0] + x[2], x[0] - x[2]
        c, d = by_sin(x[1]) - by_cos(x[3]), by_cos(x[1]) + by_sin(x[3])
        return [a + d, b + c, b - c, a - d]

    once = _step(block, 16, _COLUMNS4, kernel)
    return F.transform(_step(once, 16, _ROWS4, kernel), lambda v: shr(v + 4, 3))


def chroma_dc2(block: Column) -> Column:
    """2x2 Hadamard transform."""
    a, b, c, d = _at(block, 4)
    return F.array(a + b + c + d, a - b + c - d, a + b - c - d, a - b - c + d)


def hadamard(vector: Column, stride: int, count: int) -> Column:
    """Orthonormal Hadamard transform of ``count`` (2, 4 or 8) values that lie ``stride`` apart, for each offset."""
    n = stride * count
    out = vector
    half = 1
    while half < count:
        step, norm = half * stride, 1 / math.sqrt(2)
        out = let(out, lambda v: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i % (2 * step)) < step, F.get(v, i) + F.get(v, i + step)).otherwise(F.get(v, i - step) - F.get(v, i)) * norm))
        half *= 2
    return out


def add_residual(prediction: Column, residual: Column, depth: int) -> Column:
    return F.zip_with(prediction, residual, lambda p, r: F.least(F.greatest(p + r, F.lit(0)), F.lit((1 << depth) - 1)))


def convolve(samples: Column, taps: list[int], bits: int = 7) -> Column:
    """Fixed-point FIR over a row with its ends repeated; the filter is centred left of its middle."""
    before = (len(taps) - 1) // 2

    def row(samples: Column) -> Column:
        n = F.size(samples)
        at = lambda i: F.get(samples, F.least(F.greatest(i, F.lit(0)), n - 1).cast("int"))

        def one(i: Column) -> Column:
            total = F.lit(1 << (bits - 1)).cast("long")
            for k, t in enumerate(taps):
                total = total + at(i + (k - before)) * t
            return F.least(F.greatest(shr(total, bits), F.lit(0)), F.lit(255))

        return F.transform(F.sequence(F.lit(0), n - 1), one)

    return let(samples, row)
