"""Pixel arithmetic as column expressions on whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.integer import clip8, div, shr


def premultiply_truncating(c: Column, alpha: Column) -> Column:
    return F.when(alpha == 255, c).otherwise(div(c * alpha, 255))


def premultiply_rounding(c: Column, alpha: Column) -> Column:
    return div(c * alpha + 127, 255)


def yuv_to_rgb(y: Column, u: Column, v: Column, clamp_luma: bool = True) -> tuple[Column, Column, Column]:
    """BT.601 in eighths of bits; some codecs keep luma below 16, others raise it."""
    luma = 298 * (F.greatest(y - 16, F.lit(0)) if clamp_luma else y - 16)
    d, e = u - 128, v - 128
    return clip8(shr(luma + 409 * e + 128, 8)), clip8(shr(luma - 100 * d - 208 * e + 128, 8)), clip8(shr(luma + 516 * d + 128, 8))


def plane_sizes(width: Column, height: Column, chroma: Column) -> tuple[Column, Column]:
    """Chroma plane width and height for 420, 422, 444 and mono (0 and 0)."""
    half = lambda x: div(x + 1, 2)
    kind = F.substring(chroma, 1, 3)
    w = F.when(chroma == "mono", 0).when(kind == "444", width).otherwise(half(width))
    h = F.when(chroma == "mono", 0).when(kind == "420", half(height)).otherwise(height)
    return w, h


def limited_to_float(y: Column, depth: int) -> Column:
    """Limited-range luma of a bit depth as a fraction."""
    s = 1 << (depth - 8)
    return (y - 16 * s) / (219 * s)


def rotate_index(x: Column, y: Column, width: Column, height: Column, quarter: Column) -> tuple[Column, Column]:
    """Where a pixel goes when the picture turns counter-clockwise by quarters."""
    return (
        F.when(quarter == 0, x).when(quarter == 1, y).when(quarter == 2, width - 1 - x).otherwise(height - 1 - y),
        F.when(quarter == 0, y).when(quarter == 1, width - 1 - x).when(quarter == 2, height - 1 - y).otherwise(x),
    )


# Display scale codes as fractions.
SCALES = {0: (1, 1), 1: (5, 4), 2: (5, 3), 3: (2, 1)}


def scale_ratio(code: Column) -> tuple[Column, Column]:
    a, b = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (p, q) in SCALES.items():
        a, b = F.when(code == k, p).otherwise(a), F.when(code == k, q).otherwise(b)
    return a, b
