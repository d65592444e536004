"""Integer formulas of codecs as column expressions; division truncates toward zero, shifts are arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def div(a, b) -> Column:
    """Integer division toward zero."""
    return F.call_function("div", _c(a).cast("long"), _c(b).cast("long"))


def shr(a, n) -> Column:
    return F.call_function("shiftright", _c(a), _c(n).cast("int"))


def shl(a, n) -> Column:
    return F.call_function("shiftleft", _c(a), _c(n).cast("int"))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, _c(low)), _c(high))


def clip8(x: Column) -> Column:
    return clip(x, 0, 255)


def median(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def implicit_weights(current: Column, poc0: Column, poc1: Column) -> tuple[Column, Column]:
    """Weights of two references by their distances in picture order; 32 and 32 where they can't be used."""
    td, tb = clip(poc1 - poc0, -128, 127), clip(current - poc0, -128, 127)
    safe = F.when(td == 0, 1).otherwise(td)
    tx = div(16384 + F.abs(div(safe, 2)), safe)
    scale = clip(shr(tb * tx + 32, 6), -1024, 1023)
    w1 = shr(scale, 2)
    plain = (poc0 == poc1) | (w1 < -64) | (w1 > 128)
    return F.when(plain, 32).otherwise(64 - w1), F.when(plain, 32).otherwise(w1)


def weighted(value: Column, weight, offset, denominator: int) -> Column:
    """One reference's sample, weighted, shifted with rounding and offset."""
    scaled = value * _c(weight)
    return clip8((shr(scaled + (1 << (denominator - 1)), denominator) if denominator else scaled) + _c(offset))


def relative_distance(a: Column, b: Column, bits: int) -> Column:
    """Signed difference of two counters of ``bits`` bits."""
    d, s = a - b, 1 << (bits - 1)
    return d.bitwiseAND(F.lit(s - 1)) - d.bitwiseAND(F.lit(s))


def merge_probability(previous: Column, zero: Column, one: Column, saturation: int, most: int) -> Column:
    """A probability moved toward what was counted, by at most ``most``/256."""
    total = zero + one
    seen = F.when(total == 0, 128).otherwise(clip(div(256 * zero + div(total, 2), F.greatest(total, F.lit(1))), 1, 255))
    factor = div(most * F.least(total, F.lit(saturation)), saturation)
    return shr(previous * (256 - factor) + seen * factor + 128, 8)


# Chroma quantiser for luma quantisers from 30 on.
CHROMA_QP = (29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39)


def chroma_qp(luma_qp: Column, offset) -> Column:
    q = clip(luma_qp + _c(offset), 0, 51)
    return F.when(q < 30, q).otherwise(F.get(F.array(*map(F.lit, CHROMA_QP)), (q - 30).cast("int")))


def context_state(m: Column, n: Column, qp: Column) -> tuple[Column, Column]:
    """State and most probable symbol of an arithmetic coder's context."""
    pre = clip(shr(m * clip(qp, 0, 51), 4) + n, 1, 126)
    return F.when(pre <= 63, 63 - pre).otherwise(pre - 64), (pre > 63).cast("int")


def six_tap(a, b, c, d, e, f) -> Column:
    return a - 5 * b + 20 * c + 20 * d - 5 * e + f


def chroma_bilinear(a: Column, b: Column, c: Column, d: Column, fx: Column, fy: Column) -> Column:
    """Sample between four neighbours at eighths fx, fy."""
    return shr((8 - fx) * (8 - fy) * a + fx * (8 - fy) * b + (8 - fx) * fy * c + fx * fy * d + 32, 6)


def timestamp33(b: list[Column]) -> Column:
    """33-bit time stamp of five bytes with marker bits."""
    one = lambda x, k: shl(shr(x.cast("long"), 1).bitwiseAND(F.lit((1 << k) - 1)), 0)
    return shl(one(b[0], 3), 30) + shl(b[1].cast("long"), 22) + shl(one(b[2], 7), 15) + shl(b[3].cast("long"), 7) + one(b[4], 7)


def round_half_up_div(a: Column, b: Column) -> Column:
    """a / b of non-negative whole numbers, halves up."""
    return div(a + div(b, 2), b)


def padding_frames(ns: Column, rate: Column) -> Column:
    """Frames that a padding of ``ns`` nanoseconds stands for."""
    return F.floor((F.abs(ns).cast("decimal(38,0)") * rate + 500000000) / 1000000000).cast("long")


def kept_frames(duration: Column, time: Column, rate: Column, scale: Column, frames: Column) -> Column:
    """Frames of a packet before the presentation ends; a duration of 0 isn't known."""
    left = div((duration - time) * rate, scale)
    return F.when(duration == 0, frames).otherwise(clip(left, 0, frames))


def display_size(width: Column, height: Column, coded_width: Column, coded_height: Column) -> tuple[Column, Column]:
    """Presentation size rounded up, or the coded size where it is no use."""
    most = (1 << 32) - 1

    def usable(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (x > 0) & (x <= most), F.lit(False))

    both = usable(width) & usable(height)
    return F.when(both, F.ceil(width)).otherwise(coded_width), F.when(both, F.ceil(height)).otherwise(coded_height)


def vp8_quantizers(base: Column, deltas: list[Column], dc: Column, ac: Column) -> list[Column]:
    """Six factors from arrays of 128 steps: Y1 DC and AC, Y2 DC and AC, chroma DC and AC."""
    at = lambda t, d: F.get(t, clip(base + d, 0, 127).cast("int"))
    zero = F.lit(0)
    return [at(dc, deltas[0]), at(ac, zero), at(dc, deltas[1]) * 2, F.greatest(div(at(ac, deltas[2]) * 155, 100), F.lit(8)), F.least(at(dc, deltas[3]), F.lit(132)), at(ac, deltas[4])]


def byte_total(data: Column) -> Column:
    """Sum of bytes. ``data`` is binary."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + F.conv(x, 16, 10).cast("long"))


def byte_sum(data: Column) -> Column:
    """Sum of bytes modulo two to the power 32. ``data`` is binary."""
    return byte_total(data) % (1 << 32)


def checksum32(data: Column) -> Column:
    """Sum of big-endian 32-bit words modulo two to the power 32; the last word is filled up with zeros."""
    pad = F.rpad(F.hex(data), (F.ceil(F.length(data) / 4) * 8).cast("int"), F.lit("0"))
    words = F.regexp_extract_all(pad, F.lit("(.{8})"), F.lit(1))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: (a + F.conv(x, 16, 10).cast("long")) % (1 << 32))


def crc32_mpeg(data: Column) -> Column:
    """CRC-32/MPEG-2: polynomial 04C11DB7, not reflected, all ones at first."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    mask, table = (1 << 32) - 1, []
    for c in range(256):
        c <<= 24
        for _ in range(8):
            c = (c << 1 & mask) ^ (0x04C11DB7 if c >> 31 else 0)
        table.append(c)
    by_byte = F.expr("array(" + ", ".join(f"{c}L" for c in table) + ")")

    def byte(c: Column, x: Column) -> Column:
        at = F.shiftright(c, 24).bitwiseXOR(F.conv(x, 16, 10).cast("long")).cast("int")
        return shl(c, 8).bitwiseAND(F.lit(mask)).bitwiseXOR(F.get(by_byte, at))

    return F.aggregate(pairs, F.lit(mask).cast("long"), byte)


def le_uint(data: Column, at: int, size: int) -> Column:
    """Little-endian number at a byte offset from 0."""
    part = F.hex(F.substring(data, at + 1, size))
    turned = F.concat(*(F.substring(part, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.conv(turned, 16, 10).cast("long")


def be_uint(data: Column, at: int, size: int) -> Column:
    """Big-endian number at a byte offset from 0."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")
