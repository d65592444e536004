"""Codec kernels over arrays of samples, coefficients and codes, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.arrays import _COLUMNS4, _ROWS4, _step, energy, let, unzigzag
from framewright.functions.integer import shr


def _shift(value: Column, left: Column) -> Column:
    """``value`` shifted left, or with a negative amount right, where the half is added first."""
    up = F.call_function("shiftleft", value, F.greatest(left, F.lit(0)).cast("int"))
    down = F.greatest(-left, F.lit(1)).cast("int")
    half = F.call_function("shiftleft", F.lit(1).cast("long"), (down - 1).cast("int"))
    return F.when(left >= 0, up).otherwise(F.call_function("shiftright", value + half, down))


# Scale of 4x4 DC coefficients, and of 8x8 coefficients by class, for each remainder of the quantiser by 6.
DC_SCALE = [10, 11, 13, 14, 16, 18]
SCALE_8X8 = [[20, 18, 32, 19, 25, 24], [22, 19, 35, 21, 28, 26], [26, 23, 42, 24, 33, 31], [28, 25, 45, 26, 35, 33], [32, 28, 51, 30, 40, 38], [36, 32, 58, 34, 46, 43]]


def scale_class(row: int, column: int) -> int:
    """Which column of SCALE_8X8 a coefficient takes, by the parities of its place."""
    kinds = tuple(sorted({0: "whole", 2: "half"}.get(i % 4, "odd") for i in (row, column)))
    return {("whole", "whole"): 0, ("odd", "odd"): 1, ("half", "half"): 2, ("odd", "whole"): 3, ("half", "whole"): 4}.get(kinds, 5)


#: Place in raster order of each 4x4 block of a macroblock in coding order: quadrants, and within them again.
BLOCK_ORDER = [4 * (2 * (i // 8) + i % 4 // 2) + 2 * (i // 4 % 2) + i % 2 for i in range(16)]


def luma_dc(levels: Column, qp: Column) -> Column:
    """DC values of the 16 blocks of a macroblock in coding order from levels in zigzag order."""

    def kernel(x: list[Column]) -> list[Column]:
        a, b, c, d = x[0] + x[2], x[0] - x[2], x[1] - x[3], x[1] + x[3]
        return [a + d, b + c, b - c, a - d]

    block = let(let(unzigzag(levels), lambda b: _step(b, 16, _ROWS4, kernel)), lambda b: _step(b, 16, _COLUMNS4, kernel))
    factor = 16 * F.get(F.array(*map(F.lit, DC_SCALE)), (qp % 6).cast("int"))
    scaled = F.transform(block, lambda v: _shift(v * factor, F.floor(qp / 6) - 6))
    return let(scaled, lambda s: F.transform(F.array(*map(F.lit, BLOCK_ORDER)), lambda i: F.get(s, i)))


def inverse_8x8(coefficients: Column, qp: Column) -> Column:
    """8x8 residual of coefficients with flat weights, rows then columns, rounded by 6 bits."""
    classes = F.array(*(F.lit(scale_class(i // 8, i % 8)) for i in range(64)))
    scales = F.get(F.array(*(F.array(*map(F.lit, row)) for row in SCALE_8X8)), (qp % 6).cast("int"))
    scaled = F.zip_with(coefficients, classes, lambda c, k: _shift(c * 16 * F.get(scales, k), F.floor(qp / 6) - 6))

    def more(v: Column) -> Column:  # one and a half
        return v + shr(v, 1)

    def halves(x: list[Column]) -> list[Column]:
        """Even and odd part of a line: four even sums, four odd ones."""
        low, high = shr(x[2], 1) - x[6], x[2] + shr(x[6], 1)
        even = [x[0] + x[4] + high, x[0] - x[4] + low, x[0] - x[4] - low, x[0] + x[4] - high]
        return even + [x[5] - x[3] - more(x[7]), x[1] + x[7] - more(x[3]), x[7] - x[1] + more(x[5]), x[3] + x[5] + more(x[1])]

    def join(x: list[Column]) -> list[Column]:
        odd = [x[7] - shr(x[4], 2), shr(x[5], 2) - x[6], x[5] + shr(x[6], 2), x[4] + shr(x[7], 2)]
        return [e + o for e, o in zip(x[:4], odd, strict=True)] + [e - o for e, o in zip(reversed(x[:4]), reversed(odd), strict=True)]

    def once(block: Column, lines: list[list[int]]) -> Column:
        return let(let(block, lambda b: _step(b, 64, lines, halves)), lambda b: _step(b, 64, lines, join))

    rows, columns = [[8 * r + c for c in range(8)] for r in range(8)], [[8 * r + c for r in range(8)] for c in range(8)]
    block = once(once(scaled, rows), columns)
    return F.transform(block, lambda v: shr(v + 32, 6))


def lossless_walsh(block: Column, depth: int = 8) -> Column:
    """4x4 transform that loses nothing: rows after a shift by 2 and clamped, then columns."""
    top = 1 << (max(16, depth + 6) - 1)

    def lines(shift: int):
        def kernel(x: list[Column]) -> list[Column]:
            p, q, r, s = (shr(v, shift) for v in x) if shift else x
            first, last = p + q, r - s
            middle = shr(first - last, 1)
            b, c = middle - s, middle - q
            return [first - b, b, c, last + c]

        return kernel

    once = F.transform(let(block, lambda b: _step(b, 16, _ROWS4, lines(2))), lambda v: F.least(F.greatest(v, F.lit(-top)), F.lit(top - 1)))
    return let(once, lambda b: _step(b, 16, _COLUMNS4, lines(0)))


def dc_prediction(above: Column, left: Column) -> Column:
    """Rounded mean of the samples above and to the left; either may be null, both give the middle of 8 bits."""
    both = F.concat(F.coalesce(above, F.array().cast("array<long>")), F.coalesce(left, F.array().cast("array<long>")))
    total = F.aggregate(both, F.lit(0).cast("long"), lambda s, v: s + v)
    return F.when(F.size(both) == 0, F.lit(128)).otherwise(F.floor((total + F.floor(F.size(both) / 2)) / F.size(both)))


def paeth(above: Column, left: Column, corner: Column) -> Column:
    """Row-major block of whichever of left, above and corner is nearest to their plane; ties in this order."""

    def one(a: Column, b: Column) -> Column:
        near_left, near_above, near_corner = F.abs(a - corner), F.abs(b - corner), F.abs(a + b - 2 * corner)
        return F.when((near_left <= near_above) & (near_left <= near_corner), b).when(near_above <= near_corner, a).otherwise(corner)

    return F.flatten(F.transform(left, lambda b: F.transform(above, lambda a: one(a, b))))


def pcm_frames(size: Column, bits: Column, channels: Column) -> Column:
    """Frames of so many bytes of samples; null if a frame is cut."""
    each = F.floor(bits / 8) * channels
    return F.when((each > 0) & (size % each == 0), F.floor(size / each))


def triplet(flag: Column, data: Column) -> tuple[Column, Column, Column]:
    """dx, dy and number of bytes of a glyph point: the flag's low seven bits say how many bits each coordinate has, what
    is added to it and its sign."""
    index = flag % 128

    def group(start: int, across: int, step: int, bits: int, size: int, base: int):
        g = index - start
        return bits, size, F.floor(g / across) * step + base, F.floor(g % across / 4) * step + base, g % 2 == 0, F.floor(g / 2) % 2 == 0

    none, shape = F.lit(False), []  # from which index: bits of dx and dy, bytes, what is added to each, which are negative
    shape.append((10, (0, 8), 1, F.lit(0), F.floor(index / 2) * 256, none, index % 2 == 0))
    shape.append((20, (8, 0), 1, F.floor((index - 10) / 2) * 256, F.lit(0), index % 2 == 0, none))
    for end, args in ((84, (20, 16, 16, (4, 4), 1, 1)), (120, (84, 12, 256, (8, 8), 2, 1)), (124, (120, 4, 0, (12, 12), 3, 0)), (128, (124, 4, 0, (16, 16), 4, 0))):
        bits, size, x, y, minus_x, minus_y = group(*args)
        shape.append((end, bits, size, x, y, minus_x, minus_y))
    dx = dy = size_ = None
    for end, (x_bits, y_bits), size, x, y, minus_x, minus_y in shape:
        number = F.lit(0).cast("long")
        for i in range(size):
            number = number * 256 + F.get(data, F.lit(i))
        a, b = shr(number, y_bits) % (1 << x_bits) + x, number % (1 << y_bits) + y
        a, b = F.when(minus_x, -a).otherwise(a), F.when(minus_y, -b).otherwise(b)
        here = index < end
        dx = F.when(here, a) if dx is None else dx.when(here, a)
        dy = F.when(here, b) if dy is None else dy.when(here, b)
        size_ = F.when(here, size) if size_ is None else size_.when(here, size)
    return dx.cast("long"), dy.cast("long"), size_.cast("long")


def reordered(references: Column, frame: Column, changes: Column, bits: int) -> Column:
    """Frame numbers of ``references`` (oldest first) as a list, newest first, after signed ``changes`` of the predicted number;
    null if one asks for a frame that isn't there. A change of 0 doesn't exist."""
    size = 1 << bits
    start = F.struct(F.reverse(references).alias("list"), frame.alias("at"), F.lit(0).alias("n"))

    def step(s: Column, change: Column) -> Column:
        at = F.pmod(s["at"] + change, F.lit(size).cast("long"))
        head = F.slice(s["list"], 1, s["n"])
        tail = F.filter(F.slice(s["list"], s["n"] + 1, F.size(s["list"])), lambda x: x != at)
        moved = F.when(F.array_contains(references, at), F.concat(head, F.array(at), tail))
        return F.struct(moved.alias("list"), at.alias("at"), (s["n"] + 1).alias("n"))

    return F.aggregate(changes, start, step)["list"]


def merged_palette(above: Column, left: Column) -> Column:
    """Colours of two neighbours in order, each once."""
    return F.array_sort(F.array_distinct(F.concat(above, left)))


def ranked_candidates(candidates: Column) -> Column:
    """Structs (segment, weight, place, ...) by segment, heavier ones first within it, then by place."""
    return F.array_sort(candidates, lambda a, b: F.when(a["segment"] != b["segment"], F.signum(a["segment"] - b["segment"])).when(a["weight"] != b["weight"], F.signum(b["weight"] - a["weight"])).otherwise(F.signum((a["place"] - b["place"]).cast("double"))).cast("int"))


def rotated(vector: Column, angle: Column) -> Column:
    """Neighbours turned in their plane, from the first pair to the last, and back from the last but one to the first."""
    s, c = F.sin(angle), F.cos(angle)

    def chain(v: Column, backwards: bool) -> Column:
        start = F.struct(F.get(v, F.lit(0)).alias("x"), F.array().cast("array<double>").alias("out"))

        def step(t: Column, y: Column) -> Column:
            left, right = (c * t["x"] + s * y, c * y - s * t["x"]) if not backwards else (c * t["x"] - s * y, c * y + s * t["x"])
            return F.struct(right.alias("x"), F.concat(t["out"], F.array(left)).alias("out"))

        return F.aggregate(F.slice(v, 2, F.size(v)), start, step, lambda t: F.concat(t["out"], F.array(t["x"])))

    def back(once: Column) -> Column:
        n = F.size(once)
        # the last pair isn't turned again: what lies before it goes back the other way
        inner = chain(F.reverse(F.slice(once, 1, n - 1)), True)
        return F.when(n < 3, once).otherwise(F.concat(F.reverse(inner), F.slice(once, n, 1)))

    return let(chain(vector, False), back)


def rotated_unit(vector: Column, angle: Column) -> Column:
    return let(rotated(vector, angle), lambda v: F.transform(v, lambda x: x / F.sqrt(energy(v))))


def reflections(codes: Column, bits: int) -> Column:
    """Sines of signed codes of a prediction filter."""
    middle = 1 << (bits - 1)

    def one(code: Column) -> Column:
        signed = F.when(code < middle, code).otherwise(code - 2 * middle)
        return F.sin(signed * (math.pi / 2) / (middle + F.when(signed < 0, 0.5).otherwise(-0.5)))

    return F.transform(codes, one)


def step_up(reflection: Column) -> Column:
    """Filter coefficients, the first one 1, from reflections: each turns the filter so far and adds it to itself."""

    def step(a: Column, r: Column) -> Column:
        longer = F.concat(a, F.array(F.lit(0.0)))
        return F.zip_with(longer, F.reverse(longer), lambda x, y: x + r * y)

    return F.aggregate(reflection, F.array(F.lit(1.0)), step)


def all_pole(samples: Column, filter_: Column) -> Column:
    """y[n] = x[n] - the sum of filter[k] * y[n - k] for k from 1."""

    def step(y: Column, x: Column) -> Column:
        past = F.slice(F.reverse(y), 1, F.least(F.size(y), F.size(filter_) - 1))
        taps = F.slice(filter_, 2, F.size(past))
        return F.concat(y, F.array(x - F.aggregate(F.zip_with(past, taps, lambda p, t: p * t), F.lit(0.0), lambda s, v: s + v)))

    return F.aggregate(samples, F.array().cast("array<double>"), step)


def inverse_mdct(spectrum: Column, size: int) -> Column:
    """``size`` samples of half as many coefficients, neither windowed nor scaled."""

    def one(n: Column) -> Column:
        terms = F.transform(spectrum, lambda x, k: x * F.cos((k + 0.5) * (n + (0.5 + size / 4)) * (2 * math.pi / size)))
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def noise(count: Column, energy_: Column, seed: int = 1) -> Column:
    """Numbers of a linear congruential generator, scaled to a band's energy."""

    def step(s: Column, _: Column) -> Column:
        last = F.coalesce(F.get(s, F.size(s) - 1), F.lit(seed).cast("long"))
        return F.concat(s, F.array((last * 1664525 + 1013904223) % (1 << 32)))

    states = F.aggregate(F.sequence(F.lit(1), count), F.array().cast("array<long>"), step)
    values = F.transform(states, lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v) / float(1 << 31))
    return let(values, lambda v: F.transform(v, lambda x: x * F.pow(F.lit(2.0), energy_ / 4) / F.sqrt(energy(v))))


def coarse_energy(previous: Column, residual: Column, alpha: float, beta: float, floor_before: float, floor_: float) -> Column:
    """Band energies of one channel from the frame before and residuals, of which each leaves its share to later bands."""
    start = F.struct(F.lit(0.0).alias("f"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        value = alpha * F.greatest(x["p"], F.lit(floor_before)) + s["f"] + x["r"]
        return F.struct((s["f"] + (1 - beta) * x["r"]).alias("f"), F.concat(s["out"], F.array(F.greatest(value, F.lit(floor_)))).alias("out"))

    return F.aggregate(F.zip_with(previous, residual, lambda p, r: F.struct(p.alias("p"), r.alias("r"))), start, step)["out"]


def line_at(x0: Column, y0: Column, x1: Column, y1: Column, x: Column) -> Column:
    """A line's whole-numbered height at ``x``, rounded towards the height at ``x0``."""
    return y0 + F.signum((y1 - y0).cast("double")).cast("long") * F.floor(F.abs(y1 - y0) * (x - x0) / (x1 - x0))


def lsp_envelope(coefficients: Column, amplitude: Column, offset: int, place: Column) -> Column:
    """Linear amplitude at ``place`` (0 to 1 of the half circle) of an envelope given by an even number of line spectral pairs."""
    c = F.cos(place * math.pi)

    def product(odd: int) -> Column:
        terms = F.filter(coefficients, lambda _, i: i % 2 == odd)
        return F.aggregate(terms, F.lit(1.0), lambda p, x: p * 4 * (F.cos(x) - c) * (F.cos(x) - c))

    power = (1 - c) / 2 * product(1) + (1 + c) / 2 * product(0)
    return F.exp(F.lit(0.11512925) * (amplitude / F.sqrt(power) - offset))


def celt_layout(configuration: Column) -> tuple[Column, Column, Column, Column]:
    """Blocks (as a power of two), first band, band behind the last and samples of a packet's configuration from 0 to 31;
    null where there is none of that kind."""
    hybrid, whole = configuration.between(12, 15), configuration.between(16, 31)
    blocks = F.when(hybrid, 2 + configuration % 2).when(whole, configuration % 4)
    last = F.when(hybrid, F.when(configuration < 14, 19).otherwise(21)).when(whole, F.get(F.array(*map(F.lit, (13, 17, 19, 21))), F.floor((configuration - 16) / 4).cast("int")))
    return blocks, F.when(hybrid, 17).when(whole, 0), last, F.call_function("shiftleft", F.lit(120), blocks.cast("int"))


def fine_motion(row: Column, column: Column) -> Column:
    """Whether a vector is short enough in both directions for the highest precision."""
    return (F.abs(row) < 64) & (F.abs(column) < 64)
