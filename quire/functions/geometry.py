"""Matrices, rectangles and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(a, b, c, d, e, f) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(*(lit(v).cast("double").alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f))))


def matrix_concat(m: Column, n: Column) -> Column:
    """m, then n."""
    return matrix(
        m.a * n.a + m.b * n.c, m.a * n.b + m.b * n.d, m.c * n.a + m.d * n.c, m.c * n.b + m.d * n.d,
        m.e * n.a + m.f * n.c + n.e, m.e * n.b + m.f * n.d + n.f,
    )


def transform_point(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m.a * x + m.c * y + m.e).alias("x"), (m.b * x + m.d * y + m.f).alias("y"))


def matrix_scale(m: Column) -> Column:
    return F.sqrt(F.abs(m.a * m.d - m.b * m.c))


def page_transform(rotate: Column, width: Column, height: Column, scale: float = 1.0) -> Column:
    """From page space to a picture with its origin at the top left."""
    s = F.lit(float(scale))
    return (
        F.when(rotate % 360 == 90, matrix(0, s, s, 0, 0, 0)).when(rotate % 360 == 180, matrix(-s, 0, 0, s, width * s, 0))
        .when(rotate % 360 == 270, matrix(0, -s, -s, 0, height * s, width * s)).otherwise(matrix(s, 0, 0, -s, 0, height * s))
    )


def point_in_rect(x: Column, y: Column, r: Column) -> Column:
    return (x >= r.llx) & (x <= r.urx) & (y >= r.lly) & (y <= r.ury)


def rects_overlap(r: Column, s: Column) -> Column:
    return (r.llx < s.urx) & (s.llx < r.urx) & (r.lly < s.ury) & (s.lly < r.ury)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    part = lambda v: (1 - F.least(F.lit(1.0), v + k))
    return F.struct(part(c).alias("r"), part(m).alias("g"), part(y).alias("b"))


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> Column:
    k = 1 - F.greatest(r, g, b)
    part = lambda v: F.when(k < 1, (1 - v - k) / (1 - k)).otherwise(0.0)
    return F.struct(part(r).alias("c"), part(g).alias("m"), part(b).alias("y"), k.alias("k"))


def gray_of_rgb(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


#: Permission bits of the standard security handler.
PERMISSION_BITS = {"can_print": 4, "can_modify": 8, "can_copy": 16, "can_annotate": 32, "can_fill_forms": 256, "can_extract": 512, "can_assemble": 1024, "can_print_high": 2048}


def permissions(p: Column) -> list[Column]:
    return [(p.bitwiseAND(bit) != 0).alias(name) for name, bit in PERMISSION_BITS.items()]


def exponential(x: Column, c0: float, c1: float, n: float) -> Column:
    """Function type 2."""
    return F.lit(c0) + F.pow(x, F.lit(n)) * (c1 - c0)


def stitched(x: Column, bounds: list[float], functions) -> Column:
    """Function type 3: the function of the part of the domain in which x lies."""
    out = None
    for bound, f in zip(bounds, functions):
        out = F.when(x < bound, f(x)) if out is None else out.when(x < bound, f(x))
    return functions[-1](x) if out is None else out.otherwise(functions[-1](x))
