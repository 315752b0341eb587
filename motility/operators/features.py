"""The cell table: 52 measures of a track and 22 of the cell itself, for every node of every track.

A job of the operators before it: kinematics, angle to the vessel, time-weighted statistics and extrema of a track are joined to its nodes, gaps are filled, and the
cell's own measures follow. All steps are keyed by capture and track, so nothing but the capture's line meets all tracks of a capture.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from motility.operators.dynamics import angle_to_vessel, fill_missing, track_extrema, track_kinematics, weighted_stats
from motility.operators.selection import assemble_features
from motility.operators.tracks import CAPTURE
from motility.sources.tables import stored

# The measures of a cell, in the order of the table; the score comes last.
SHAPE = ["vol", "surface", "height", "width", "height_to_width", "sphericity", "prolate", "oblate", "axis_1", "axis_2", "axis_3", "extent", "solidity", "diameter"]
ORIENTATION = ["azimuth", "elevation", "roll"]
POLAR = ["polar_radius", "polar_angle"]
DISTANCE = ["centre_distance", "surface_distance"]
CELL = [*SHAPE, *ORIENTATION, *POLAR, *DISTANCE, "score"]
_mean, _std = (lambda c: f"{c}_mean"), (lambda c: f"{c}_std")
TRACK = [
    "n_nodes", "path", "max_speed", "mean_speed", "ends_over_path", "path_over_ends", "angle",
    *map(_mean, SHAPE), *map(_std, SHAPE), *map(_mean, POLAR), *map(_std, POLAR), *map(_mean, ORIENTATION), *map(_std, ORIENTATION), *map(_mean, DISTANCE),
    "min_distance", "score_mean", "max_score", "min_score", "range_score",
]
RATIOS = ["ends_over_path", "path_over_ends"]
BLOCKS = [f(c) for f in (_mean, _std) for c in (*POLAR, *ORIENTATION)]


def track_features(nodes: DataFrame, calibration: DataFrame, line: DataFrame, keys: Sequence[str] = CAPTURE, half: int = 84) -> DataFrame:
    """``(keys, track_id, node_id, *TRACK)`` of each node. ``nodes`` has the places ``t, y, x, z`` and the columns CELL; ``line`` has ``pos, y, x``.

    Missing ratios are -1, and so are all weighted polar and orientation measures of a track that lacks one of them at any node.
    """
    node = stored(nodes.select(*keys, "track_id", "node_id", "t", "y", "x", "z", *CELL), "cell-nodes")
    weighted = weighted_stats(node, CELL, keys, half)
    whole = track_kinematics(node, calibration, keys).join(angle_to_vessel(node, line, keys), [*keys, "track_id"], "left")
    whole = whole.join(track_extrema(node, keys, "surface_distance", "score"), [*keys, "track_id"])
    out = fill_missing(weighted.join(whole, [*keys, "track_id"]), RATIOS, BLOCKS, keys)
    return out.select(*keys, "track_id", "node_id", *TRACK)


def cell_table(nodes: DataFrame, calibration: DataFrame, line: DataFrame, keys: Sequence[str] = CAPTURE, half: int = 84) -> DataFrame:
    """``(keys, track_id, node_id, features array<double>)``: the 52 measures of the track and the 22 of the cell, as the selection and the behaviours take them."""
    on = [*keys, "track_id", "node_id"]
    return assemble_features(track_features(nodes, calibration, line, keys, half), nodes.select(*on, *CELL), TRACK, CELL, on)
