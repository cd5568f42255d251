"""Numpy kernels over the pixels of one chip, row-major: pixel ``(iy, ix)`` at ``iy * w + ix``.

Except for truncation on quantising, the definitions are this package's own.
"""

from __future__ import annotations

import numpy as np

FILLS = ("row", "nearest")


def valid_mask(values: np.ndarray, null: np.ndarray, nodata: float | None) -> np.ndarray:
    """True where a pixel is neither NULL nor the nodata value; a NaN nodata value means NaN pixels."""
    if nodata is None:
        return ~null
    return ~null & ~(np.isnan(values) if np.isnan(nodata) else values == nodata)


def normalize(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Valid pixels scaled to [0, 1] by their least and greatest, all others 0.

    A flat or empty chip is 0 everywhere. NaN is greater than any number, so one valid NaN beside a number
    turns all valid pixels into NaN.
    """
    out = np.zeros(len(values))
    kept = values[mask].astype(np.float64)
    nan = np.isnan(kept)
    if not len(kept) or nan.all():
        return out
    if nan.any():
        out[mask] = np.nan
        return out
    low, high = kept.min(), kept.max()
    if high > low:
        out[mask] = (kept - low) / (high - low)
    return out


def fill_row(image: np.ndarray, mask: np.ndarray, width: int) -> np.ndarray:
    """Nodata takes the nearest valid pixel to the left in its row, else to the right, else 0."""
    image, mask = image.reshape(-1, width), mask.reshape(-1, width)
    at = np.where(mask, np.arange(width), -1)
    np.maximum.accumulate(at, axis=1, out=at)
    first = np.where(mask.any(axis=1), mask.argmax(axis=1), 0)
    at = np.where(at < 0, first[:, None], at)
    out = np.take_along_axis(image, at, axis=1)
    out[~mask.any(axis=1)] = 0.0
    return out.ravel()


def nearest_valid(mask: np.ndarray) -> np.ndarray:
    """For every pixel of a 2-D mask the flat index of the nearest valid pixel, -1 if there is none.

    A distance transform: nearest valid pixel within each column first, then over the columns as far as the
    best distance so far allows. Of equally near pixels the first in row-major order is taken.
    """
    height, width = mask.shape
    rows = np.arange(height)[:, None]
    up = np.maximum.accumulate(np.where(mask, rows, -height * 4), axis=0)
    down = np.minimum.accumulate(np.where(mask, rows, height * 4)[::-1], axis=0)[::-1]
    nearest = np.where(rows - up <= down - rows, up, down)  # of two as near the upper one
    held = (nearest >= 0) & (nearest < height)
    none = np.iinfo(np.int64).max
    place = height * width
    iy, ix = np.nonzero(~mask)
    best = np.full(len(iy), none)
    for dx in range(width):
        active = np.flatnonzero(dx * dx <= best // place) if dx else np.arange(len(iy))
        if not len(active):
            break
        for column in {-dx, dx}:
            x = ix[active] + column
            inside = (x >= 0) & (x < width)
            rows_at, to = iy[active][inside], x[inside]
            found = held[rows_at, to]
            rows_at, to, which = rows_at[found], to[found], active[inside][found]
            y = nearest[rows_at, to]
            # Distance first, then the place: one integer orders both.
            key = ((rows_at - y) ** 2 + dx * dx) * place + y * width + to
            best[which] = np.minimum(best[which], key)
    out = np.arange(place).reshape(height, width)
    out[iy, ix] = np.where(best == none, -1, best % place)
    return out


def fill_nearest(image: np.ndarray, mask: np.ndarray, width: int) -> np.ndarray:
    """Nodata takes the value of the nearest valid pixel, 0 if there is none."""
    if mask.all():
        return image.copy()
    at = nearest_valid(mask.reshape(-1, width)).ravel()
    return np.where(at >= 0, image[at], 0.0)


def fill(image: np.ndarray, mask: np.ndarray, width: int, how: str = "row") -> np.ndarray:
    return fill_row(image, mask, width) if how == "row" else fill_nearest(image, mask, width)


def quantize_u8(image: np.ndarray) -> np.ndarray:
    """Times 255, clipped to [0, 255] and truncated."""
    return np.clip(image * 255.0, 0.0, 255.0).astype(np.uint8)


def block_mean(values: np.ndarray, null: np.ndarray, width: int, height: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the pixels of every k x k block that are not NULL, and which blocks have none."""
    rows, columns = np.arange(0, height, k), np.arange(0, width, k)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.add.reduceat(x.reshape(height, width), rows, axis=0), columns, axis=1).ravel()

    count = summed((~null).astype(np.int64))
    total = summed(np.where(null, 0.0, values.astype(np.float64)))
    return total / np.maximum(count, 1), count == 0
