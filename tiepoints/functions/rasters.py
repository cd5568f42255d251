"""Columns over packed rasters: one byte per pixel, row-major (pixel ``(iy, ix)`` at ``iy * w + ix``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside nested lambdas.

    Without it the optimizer may inline an array-valued column into a lambda and compute the
    whole array again for every element.
    """
    return F.transform(F.array(value), body)[0]


def mask_at(mask: Column, width: Column, ix: Column, iy: Column) -> Column:
    """Whether a pixel of a packed mask is valid; False outside."""
    at = iy * width + ix
    found = (ix >= 0) & (iy >= 0) & (ix < width) & (F.substring(mask, at + 1, F.lit(1)) == F.lit(b"\x01"))
    return F.coalesce(found, F.lit(False))


def byte_values(packed: Column) -> Column:
    """Bytes as an array of integers, for reports; whole images stay packed."""

    def value(i: Column) -> Column:
        return F.conv(F.hex(F.substring(packed, i + 1, F.lit(1))), 16, 10).cast("int")

    return F.transform(F.sequence(F.lit(0), F.octet_length(packed) - 1), value)
