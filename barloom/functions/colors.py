"""color.*: 0xRRGGBB as a long, or, with a transparency, bit 32 set and 0xRRGGBBAA."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

#: The named colours.
NAMES = {
    "black": 0x363A45, "silver": 0xB2B5BE, "gray": 0x787B86, "white": 0xFFFFFF, "maroon": 0x880E4F, "red": 0xF23645, "purple": 0x9C27B0, "fuchsia": 0xE040FB, "green": 0x4CAF50,
    "lime": 0x00E676, "olive": 0x808000, "yellow": 0xFDD835, "navy": 0x311B92, "blue": 0x2962FF, "teal": 0x089981, "aqua": 0x00BCD4, "orange": 0xFF9800,
}
_TAGGED = 1 << 32


def _alpha(c: Column) -> Column:
    return F.when(c >= _TAGGED, c.bitwiseAND(0xFF)).otherwise(F.lit(255))


def _base(c: Column) -> Column:
    return F.when(c >= _TAGGED, F.shiftright(c - _TAGGED, 8)).otherwise(c)


def _made(base: Column, alpha: Column) -> Column:
    return F.when(alpha == 255, base).otherwise(F.lit(_TAGGED) + F.shiftleft(base, 8) + alpha)


def _from_transp(t: Column) -> Column:
    """0 (opaque) to 100 as 255 to 0."""
    return F.floor((100 - F.least(F.greatest(t, F.lit(0.0)), F.lit(100.0))) * 255 / 100 + 0.5).cast("long")


def new(c, transp=0.0) -> Column:
    return _made(_base(col(c).cast("long")), _from_transp(col(transp).cast("double")))


def rgb(red, green, blue, transp=0.0) -> Column:
    r, g, b = (F.floor(F.least(F.greatest(col(x).cast("double"), F.lit(0.0)), F.lit(255.0)) + 0.5).cast("long") for x in (red, green, blue))
    return _made(r * 65536 + g * 256 + b, _from_transp(col(transp).cast("double")))


def r(c) -> Column:
    return F.shiftright(_base(col(c).cast("long")), 16).bitwiseAND(0xFF)


def g(c) -> Column:
    return F.shiftright(_base(col(c).cast("long")), 8).bitwiseAND(0xFF)


def b(c) -> Column:
    return _base(col(c).cast("long")).bitwiseAND(0xFF)


def t(c) -> Column:
    return F.floor(100 - _alpha(col(c).cast("long")) * 100 / 255 + 0.5).cast("long")


def from_gradient(value, bottom, top, bottom_color, top_color) -> Column:
    """Between two colours by the value's place between two bounds, which hold it; equal bounds give the top one."""
    low, high = col(bottom_color).cast("long"), col(top_color).cast("long")
    share = F.coalesce((col(value) - col(bottom)) / F.nullif(col(top) - col(bottom), F.lit(0.0)), F.lit(1.0))

    def between(f) -> Column:
        return F.floor(f(low) + (f(high) - f(low)) * share + 0.5).cast("long")

    mixed = _made(between(r) * 65536 + between(g) * 256 + between(b), between(_alpha))
    return F.when(col(value).isNotNull(), F.when(share <= 0, low).when(share >= 1, high).otherwise(mixed))
