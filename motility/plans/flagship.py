"""The flagship query: from track nodes to a summary of movement by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motility.operators.dynamics import track_kinematics
from motility.operators.tracks import CAPTURE, distance_network, filter_short_tracks
from motility.plans import fixtures
from motility.plans.registry import query

SQL = """
WITH long AS (SELECT * FROM track_nodes QUALIFY count(*) OVER (PARTITION BY grp, volume, capture, track_id) > 21),
h AS (SELECT l.*, dt, z * (dz / 0.5) AS zz, sqrt((z - lag(z) OVER g) ** 2 + (y - lag(y) OVER g) ** 2 + (x - lag(x) OVER g) ** 2) AS hop,
 sqrt((round(z * (dz / 0.5)) - lag(round(z * (dz / 0.5))) OVER g) ** 2 + (round(y) - lag(round(y)) OVER g) ** 2 + (round(x) - lag(round(x)) OVER g) ** 2) AS grid_hop
 FROM long l JOIN calibration USING (grp, volume, capture) WINDOW g AS (PARTITION BY grp, volume, capture, track_id ORDER BY t, node_id)),
s AS (SELECT grp, track_id, count(*) AS n_nodes, sum(hop) AS path, avg(grid_hop) / any_value(dt) AS speed,
 sqrt((arg_max(z, t) - arg_min(z, t)) ** 2 + (arg_max(y, t) - arg_min(y, t)) ** 2 + (arg_max(x, t) - arg_min(x, t)) ** 2) AS ends FROM h GROUP BY grp, volume, capture, track_id)
SELECT grp, count(*) AS n_tracks, round(avg(path), 6) AS mean_path, round(avg(ends / path), 6) AS mean_meander, round(avg(speed), 6) AS mean_speed FROM s GROUP BY grp"""


def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = filter_short_tracks(fixtures.view(spark, sf_dir, "track_nodes"))
    measures = distance_network(nodes)
    speeds = track_kinematics(nodes, fixtures.view(spark, sf_dir, "calibration")).select(*CAPTURE, "track_id", "mean_speed")
    both = measures.join(speeds, [*CAPTURE, "track_id"])
    return both.groupBy("grp").agg(
        F.count("*").alias("n_tracks"), F.round(F.avg("path"), 6).alias("mean_path"), F.round(F.avg("meander"), 6).alias("mean_meander"), F.round(F.avg("mean_speed"), 6).alias("mean_speed")
    )


@query("track_summary", SQL, "track_nodes calibration")
def _registered(v):
    return track_summary(v.spark, v.sf_dir)
