"""Squared distances on lattices, one axis at a time."""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 60  # no seed on any line so far


def lower_envelope(field: np.ndarray) -> np.ndarray:
    """``min over j of field[..., j] + (i - j)**2`` for each place ``i`` of the last axis; ``NONE`` stays on lines without a seed.

    Shifted copies are taken in by growing offsets, until the square of the offset alone is no less than every value: work follows the greatest distance on
    the lines, not their length.
    """
    seeded = (field < NONE).any(axis=-1)
    if not seeded.any():
        return field
    lines = field[seeded]
    best = lines.copy()
    for o in range(1, lines.shape[-1]):
        if o * o >= best.max():
            break
        np.minimum(best[:, o:], lines[:, :-o] + o * o, out=best[:, o:])
        np.minimum(best[:, :-o], lines[:, o:] + o * o, out=best[:, :-o])
    out = field.copy()
    out[seeded] = best
    return out


def planes_field(x: np.ndarray, z: np.ndarray, y: np.ndarray, z_range: tuple[int, int], y_range: tuple[int, int], x_range: tuple[int, int]) -> np.ndarray:
    """Squared distances in each plane of constant x to the seeds of that plane: an array ``[x, z, y]`` over the given ranges, ends included.

    Seeds may lie outside the ranges of z and y.
    """
    z0, z1 = min(z_range[0], int(z.min())), max(z_range[1], int(z.max()))
    y0, y1 = min(y_range[0], int(y.min())), max(y_range[1], int(y.max()))
    seeds = np.full((x_range[1] - x_range[0] + 1, y1 - y0 + 1, z1 - z0 + 1), NONE, np.int64)
    seeds[x - x_range[0], y - y0, z - z0] = 0
    along_z = lower_envelope(seeds)[:, :, z_range[0] - z0 : z_range[1] - z0 + 1]
    return lower_envelope(np.ascontiguousarray(along_z.swapaxes(1, 2)))[:, :, y_range[0] - y0 : y_range[1] - y0 + 1]
