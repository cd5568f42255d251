"""Pixel and map coordinates of matched points.

Axes are crossed on purpose throughout: the window row ``wx`` is added to y and the window
column ``wy`` to x, and the scan position uses the *column* crop offset with ``wx``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_to_map(pixel: Column, origin: Column, resolution: Column, offset: Column) -> Column:
    """One axis of the pixel-to-map transform: origin + (pixel + window offset) * resolution.

    The resolution is signed. The formula is this package's own definition.
    """
    return origin + (pixel + offset) * resolution


def map_point(x: Column, y: Column, geo: Column, image: int, wx: Column, wy: Column) -> tuple[Column, Column]:
    """Map coordinates of a window-local point of image 1 or 2."""
    return (
        pixel_to_map(x, geo[f"x0{image}"], geo[f"xres{image}"], wy),
        pixel_to_map(y, geo[f"y0{image}"], geo[f"yres{image}"], wx),
    )


def displacement(X1: Column, Y1: Column, X2: Column, Y2: Column) -> dict[str, Column]:
    """Length and the two components of the displacement, image 1 minus image 2."""
    return {
        "distance": F.hypot(X1 - X2, Y1 - Y2),
        "along": Y1 - Y2,
        "across": X1 - X2,
    }


def full_image_point(x: Column, y: Column, wx: Column, wy: Column) -> tuple[Column, Column]:
    """Window-local pixel to full-image pixel."""
    return x + wy, y + wx


def global_position(geo: Column, wx: Column, wy: Column) -> dict[str, Column]:
    """Scan and pixel position of the window in the uncropped image."""
    return {
        "global_scan": (geo["crop_col_offset"] + wx).cast("int"),
        "global_pix": (geo["crop_row_offset"] + wy).cast("int"),
    }


def affine_residual(m: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance in image-2 pixels between the mapped point and its match."""
    dx = m["a"] * x1 + m["b"] * y1 + m["c"] - x2
    dy = m["d"] * x1 + m["e"] * y1 + m["f"] - y2
    return F.sqrt(dx * dx + dy * dy)


def moments(x: Column, y: Column, u: Column, v: Column) -> dict[str, Column]:
    """What a least-squares affine map from (x, y) to (u, v) is made of, as values to be summed over its points."""
    return {
        "s_x": x, "s_y": y, "s_xx": x * x, "s_xy": x * y, "s_yy": y * y,
        "s_u": u, "s_xu": x * u, "s_yu": y * u, "s_v": v, "s_xv": x * v, "s_yv": y * v,
    }


#: Of the product of both variances; below it points count as being on one line.
COLLINEAR = 1e-9


def affine_from_sums(n: Column) -> Column:
    """Least-squares affine map from the sums of ``moments`` over ``n`` points, NULL if they are on one line."""
    s = {name: F.col(f"s_{name}") for name in ("x", "y", "xx", "xy", "yy", "u", "xu", "yu", "v", "xv", "yv")}
    xx, xy, yy = n * s["xx"] - s["x"] * s["x"], n * s["xy"] - s["x"] * s["y"], n * s["yy"] - s["y"] * s["y"]
    det = xx * yy - xy * xy

    def row(t: str) -> list[Column]:
        xt, yt = n * s[f"x{t}"] - s["x"] * s[t], n * s[f"y{t}"] - s["y"] * s[t]
        first, second = (xt * yy - yt * xy) / det, (yt * xx - xt * xy) / det
        return [first, second, (s[t] - first * s["x"] - second * s["y"]) / n]

    model = F.struct(*[c.alias(name) for name, c in zip("abcdef", [*row("u"), *row("v")])])
    return F.when((n >= 3) & (det > COLLINEAR * xx * yy), model)
