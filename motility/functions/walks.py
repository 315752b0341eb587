"""Walks: from frame to frame with a segmentation that the next frame is held against, and from point to point."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np

from motility.functions.grouped import merged_pieces, voxel_components


def box_centre(places: np.ndarray) -> np.ndarray:
    return (places.min(axis=0) + places.max(axis=0)) / 2


def nearest_part(region: np.ndarray, references: list[np.ndarray]) -> np.ndarray:
    """The number of the reference whose centroid is nearest to each voxel; of equal ones the first."""
    return np.stack([((region - r.mean(axis=0)) ** 2).sum(axis=1) for r in references]).argmin(axis=0)


def best_parts(region: np.ndarray, pieces: np.ndarray, references: list[np.ndarray]) -> np.ndarray:
    """The reference of each piece: pieces are joined while that brings them closer to one, then each goes to the one it shares most with, or, if it meets none, to the nearest."""
    owner = {tuple(v): k for k, r in reversed(list(enumerate(references))) for v in np.rint(r).astype(np.int64).tolist()}
    counts: dict[tuple[int, int], int] = {}
    for piece, v in zip(pieces.tolist(), region.tolist(), strict=True):
        k = owner.get(tuple(v))
        if k is not None:
            counts[piece, k] = counts.get((piece, k), 0) + 1
    sizes = dict(zip(*(x.tolist() for x in np.unique(pieces, return_counts=True)), strict=True))
    group = merged_pieces(counts, sizes, {k: len(r) for k, r in enumerate(references)})
    part = np.full(len(region), -1)
    for head in sorted(set(group.values())):
        members = [p for p in group if group[p] == head]
        shared = [sum(counts.get((p, k), 0) for p in members) for k in range(len(references))]
        if max(shared):
            part[np.isin(pieces, members)] = int(np.argmax(shared))
    for piece in np.unique(pieces[part < 0]).tolist():
        own = pieces == piece
        part[own] = nearest_part(region[own].mean(axis=0)[None], references)[0]
    return part


def walked(references: list[np.ndarray], frames: Iterable[tuple[int, np.ndarray]], least_share: float = 0.1) -> Iterator[tuple[int, np.ndarray]]:
    """``(frame, part of each voxel)`` for the frames of one region, from the one next to the event on; each frame's parts are the references of the next.

    The references are moved so that the middle of their common box is that of the region. A region of fewer connected pieces than references is split among their centroids; one of as many or more has its pieces
    dealt to them. The walk ends at the first frame that can't be split: where a part would have less than ``least_share`` of the voxels of its reference.
    """
    for frame, region in frames:
        pieces = voxel_components(region, 26)
        moved = [r + box_centre(region) - box_centre(np.concatenate(references)) for r in references]
        part = nearest_part(region, moved) if pieces.max() < len(references) else best_parts(region, pieces, moved)
        sizes = np.bincount(part, minlength=len(references))
        if any(n <= 0 or n < least_share * len(r) for n, r in zip(sizes.tolist(), references, strict=True)):
            return
        yield frame, part
        references = [region[part == k] for k in range(len(references))]


def greedy_chain(points: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The place of each point in the chain that begins at the one nearest to ``start`` and goes on to the nearest one left; of equal ones the first.

    Points are held in the cells of a grid of about two points each; a search goes outward ring by ring until nothing nearer can follow. The grid is built anew for what is left when half of it is gone, so its cells keep their
    size in points.
    """
    place, left, here, done = np.empty(len(points), np.int64), np.arange(len(points)), np.asarray(start, float), 0
    while len(left):
        rows = points[left]
        low, spans = rows.min(axis=0), np.ptp(rows, axis=0)
        wide = spans[spans > 0]
        size = float((np.prod(wide) * 2 / len(left)) ** (1 / len(wide))) if len(wide) else 1.0
        size = max(size, float(spans.max(initial=0)) / 1e6, 1e-9)
        cell_of = {i: tuple(c) for i, c in zip(left.tolist(), np.floor((rows - low) / size).astype(np.int64).tolist(), strict=True)}
        at = dict(zip(left.tolist(), map(tuple, rows.tolist()), strict=True))
        cells: dict[tuple, list[int]] = {}
        for i, c in cell_of.items():
            cells.setdefault(c, []).append(i)
        i = int(left[np.argmin(((rows - here) ** 2).sum(axis=1))])
        for _ in range(len(left) - len(left) // 2):
            place[i], done = done, done + 1
            cells[cell_of[i]].remove(i)
            here, home = at[i], cell_of.pop(i)
            i = _nearest(here, home, cells, cell_of, at, size)
        left, here = np.array(sorted(cell_of), np.int64), np.array(here)
    return place


def _nearest(here: tuple, home: tuple, cells: dict, left: dict, at: dict, size: float) -> int:
    """The point of ``left`` nearest to ``here``, which is in the cell ``home``; -1 if none is left."""
    best, found, ring = float("inf"), -1, 0
    while left and best >= ((ring - 1) * size * (1 - 1e-9)) ** 2 or ring == 0:
        if (2 * ring + 1) ** len(home) > 8 * len(left) + 64:  # fewer points than cells: all of them
            near = left
        else:
            steps = range(-ring, ring + 1)
            near = (i for step in itertools.product(steps, repeat=len(home)) if max(map(abs, step)) == ring for i in cells.get(tuple(map(sum, zip(home, step, strict=True))), ()))
        for i in near:
            p = at[i]
            far = 0.0
            for a, b in zip(p, here, strict=True):
                far += (a - b) * (a - b)
            if far < best or far == best and i < found:
                best, found = far, i
        if near is left:
            break
        ring += 1
    return found
