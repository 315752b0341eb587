"""Domain views over the base tables: the same text for Spark and DuckDB, in exact integer arithmetic.

``a // b`` is whole division, ``SERIES(a, b)`` a row for each whole number from a to b, ``ELEM(list, i)`` a list's element, counted
from 0, ``COUNTS(list)`` the list's length. A volume holds as much as it can at some 20 000 parts and 600 000 orders; beyond, ``voxels`` and ``boxes`` get
further captures.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Parts whose voxels one task makes, some 50 for each.
PARTS_A_TASK = 10_000

VIEWS = {
    "track_nodes": """
        SELECT CAST(1 + user_id % 4 AS BIGINT) AS grp, CAST(1 + (user_id // 4) % 3 AS BIGINT) AS volume, CAST(1 + (user_id // 12) % 2 AS BIGINT) AS capture,
               CAST(user_id AS BIGINT) AS track_id, CAST(event_id AS BIGINT) AS node_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS t,
               CAST(event_id * 37 % 2560 AS DOUBLE) / 10 AS y, CAST(event_id * 61 % 2560 AS DOUBLE) / 10 AS x, CAST(event_id * 17 % 160 AS DOUBLE) / 10 AS z,
               CAST(value AS DOUBLE) * 8 AS vol, CAST(4 + event_id % 9 AS DOUBLE) AS dx, CAST(4 + event_id % 7 AS DOUBLE) AS dy,
               CAST(event_id * 13 % 1000 AS DOUBLE) / 1000 AS score
        FROM events""",
    "calibration": """
        SELECT CAST(1 + n_nationkey % 4 AS BIGINT) AS grp, CAST(1 + (n_nationkey // 4) % 3 AS BIGINT) AS volume, CAST(1 + (n_nationkey // 12) % 2 AS BIGINT) AS capture,
               1 + CAST(n_nationkey % 3 AS DOUBLE) / 2 AS dz, CAST(10 + n_nationkey % 5 AS DOUBLE) AS dt
        FROM nation WHERE n_nationkey < 24""",
    "boxes": """
        SELECT CAST(o_orderkey AS BIGINT) AS box_id, CAST(o_custkey % 8 + 8 * ((o_orderkey - 1) // 600000) AS BIGINT) AS capture, CAST(1 + o_orderkey % 20 AS BIGINT) AS t,
               CAST(o_orderkey * 31 % 200 AS DOUBLE) AS y1, CAST(o_orderkey * 57 % 200 AS DOUBLE) AS x1, CAST(o_orderkey * 7 % 12 AS DOUBLE) AS z1,
               CAST(o_orderkey * 31 % 200 + 5 + o_custkey % 20 AS DOUBLE) AS y2, CAST(o_orderkey * 57 % 200 + 5 + o_orderkey % 20 AS DOUBLE) AS x2,
               CAST(o_orderkey * 7 % 12 + 1 + o_orderkey % 4 AS DOUBLE) AS z2, CAST(o_orderkey * 13 % 1000 AS DOUBLE) / 1000 AS score
        FROM orders""",
    "voxels": """
        SELECT capture, t, z, y, x, min(p) AS label
        FROM (
          SELECT p % 4 + 4 * ((p - 1) // 20000) AS capture, 1 + (p // 4) % 5 AS t, p * 7 % 13 + oz AS z, p * 37 % 61 + oy AS y, p * 53 % 67 + ox AS x, p
          FROM (SELECT *, SERIES(-3, 3) AS ox FROM (SELECT *, SERIES(-3, 3) AS oy FROM (SELECT CAST(p_partkey AS BIGINT) AS p, CAST(p_size AS BIGINT) AS size, SERIES(-3, 3) AS oz FROM part) AS a) AS b) AS c
          WHERE oz * oz + oy * oy + ox * ox <= (1 + size % 3) * (1 + size % 3)
        ) AS d
        WHERE z BETWEEN 0 AND 15 AND y BETWEEN 0 AND 69 AND x BETWEEN 0 AND 69
        GROUP BY capture, t, z, y, x""",
    "grid": """
        SELECT CAST(o_orderkey % 3 AS BIGINT) AS capture, CAST(1 + o_orderkey // 4992 AS BIGINT) AS t, CAST((o_orderkey // 192) % 26 AS BIGINT) AS z, CAST((o_orderkey // 3) % 8 AS BIGINT) AS y,
               CAST((o_orderkey // 24) % 8 AS BIGINT) AS x, CAST(o_orderkey * 97 % 65536 AS BIGINT) AS raw,
               CAST(o_orderkey * 7 % 101 AS DOUBLE) / 50 - 1 AS l0, CAST(o_orderkey * 11 % 103 AS DOUBLE) / 50 - 1 AS l1, CAST(o_orderkey * 13 % 107 AS DOUBLE) / 50 - 1 AS l2
        FROM orders""",
    "cells": """
        SELECT row_id, grp, cluster, feature, CAST(ELEM(embedding, feature) AS DOUBLE) AS value
        FROM (SELECT CAST(vec_id AS BIGINT) AS row_id, CAST(1 + vec_id % 4 AS BIGINT) AS grp, CAST(1 + label AS BIGINT) AS cluster, embedding, SERIES(0, 63) AS feature FROM embeddings) AS a""",
    "paths": """
        SELECT 'group' || grp || '/' || volume || '_capture' || capture || '/T' || lpad(CAST(t AS STRING), 5, '0') || '.mat' AS path FROM (SELECT DISTINCT grp, volume, capture, t FROM track_nodes) AS a
        UNION ALL
        SELECT 'group' || grp || '__' || volume || '_capture' || capture || '__T' || lpad(CAST(t AS STRING), 5, '0') || '__' || node_id % 5 || '.mat' AS path FROM track_nodes
        UNION ALL
        SELECT 'group' || grp || '/' || volume || '_capture' || capture || '/raw_t' || lpad(CAST(t AS STRING), 3, '0') || '_z' || lpad(CAST(node_id % 26 AS STRING), 3, '0') || '_c' || lpad(CAST(node_id % 3 AS STRING), 3, '0') || '.tif' AS path FROM track_nodes""",
    "members": """
        SELECT member, feature, CAST(member AS DOUBLE) / 10 AS mu, 1 + CAST(feature AS DOUBLE) / 10 AS sd, CAST((member * 7 + feature * 3) % 11 - 5 AS DOUBLE) / 10 AS coef, CAST(0 AS DOUBLE) AS intercept
        FROM (SELECT member, SERIES(0, 63) AS feature FROM (SELECT CAST(n_nationkey AS BIGINT) AS member FROM nation WHERE n_nationkey < 4) AS a) AS b""",
    "scored": """
        SELECT CAST(event_id AS BIGINT) AS id, event_type AS kind, CAST(event_id * 13 % 1000 AS DOUBLE) / 1000 AS score, CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS label FROM events""",
    "cell_nodes": """
        SELECT grp, volume, capture, track_id, node_id, t, y, x, z, vol, score, CAST(20 + node_id % 173 AS DOUBLE) AS surface, CAST(node_id * 7 % 31 AS DOUBLE) AS height, CAST(1 + node_id * 11 % 29 AS DOUBLE) AS width,
               CAST(node_id * 7 % 31 AS DOUBLE) / (1 + node_id * 11 % 29) AS height_to_width, CAST(node_id * 19 % 100 AS DOUBLE) / 100 AS sphericity, CAST(node_id * 23 % 100 AS DOUBLE) / 100 AS prolate, CAST(node_id * 29 % 100 AS DOUBLE) / 100 AS oblate,
               CAST(9 + node_id % 5 AS DOUBLE) AS axis_1, CAST(5 + node_id % 4 AS DOUBLE) AS axis_2, CAST(1 + node_id % 3 AS DOUBLE) AS axis_3, CAST(node_id * 31 % 97 AS DOUBLE) / 97 AS extent, CAST(node_id * 37 % 89 AS DOUBLE) / 89 AS solidity,
               CAST(4 + node_id * 41 % 13 AS DOUBLE) AS diameter, CAST(node_id * 43 % 360 AS DOUBLE) - 180 AS azimuth, CAST(node_id * 47 % 180 AS DOUBLE) - 90 AS elevation, CAST(node_id * 53 % 360 AS DOUBLE) - 180 AS roll,
               CASE WHEN node_id % 997 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(node_id * 59 % 101 AS DOUBLE) / 50 END AS polar_radius, CAST(node_id * 61 % 628 AS DOUBLE) / 100 AS polar_angle,
               CAST(node_id * 67 % 211 AS DOUBLE) / 10 AS centre_distance, CAST(node_id * 71 % 199 AS DOUBLE) / 10 AS surface_distance
        FROM track_nodes""",
    "features": """
        SELECT grp, volume, capture, track_id, node_id, t, score, vol AS f1, CASE WHEN node_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE dx * dy END AS f2, x / (1 + dy) AS f3 FROM track_nodes""",
}


def _spark(text: str) -> str:
    text = text.replace("//", " div ")
    text = re.sub(r"SERIES\((-?\w+), (-?\w+)\)", r"explode(sequence(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT)))", text)
    return re.sub(r"ELEM\((\w+), (\w+)\)", r"\1[\2]", text)


def _duck(text: str) -> str:
    text = re.sub(r"SERIES\((-?\w+), (-?\w+)\)", r"unnest(generate_series(\1, \2))", text)
    return re.sub(r"ELEM\((\w+), (\w+)\)", r"\1[\2 + 1]", text).replace("AS STRING)", "AS VARCHAR)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view ``voxels``, made volume by volume: parts are dealt to tasks by capture and frame before their balls are filled, ``PARTS_A_TASK`` to a task, so a task holds a few volumes at any size and what goes by volume needs no further shuffle.

    A file of parts is small for the voxels it stands for; read as it is, one task would make and add up those of a whole row group.
    """
    p = F.col("p")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p"), F.col("p_size").cast("long").alias("size"))
    n = max(spark.sparkContext.defaultParallelism, -(-parts.count() // PARTS_A_TASK))
    placed = parts.select(F.expr("p % 4 + 4 * ((p - 1) div 20000)").alias("capture"), F.expr("1 + (p div 4) % 5").alias("t"), "p", (1 + F.col("size") % 3).alias("r")).repartition(n, "capture", "t")
    left = F.col("r") * F.col("r")  # of the squared radius; a row is only as long as the ball is there, so no place outside it is made
    for o in ("oz", "oy", "ox"):
        half = F.floor(F.sqrt(left.cast("double")))
        placed = placed.withColumn(o, F.explode(F.sequence(-half, half)))
        left = left - F.col(o) * F.col(o)
    ball = placed.select("capture", "t", (p * 7 % 13 + F.col("oz")).alias("z"), (p * 37 % 61 + F.col("oy")).alias("y"), (p * 53 % 67 + F.col("ox")).alias("x"), "p")
    return ball.where("z BETWEEN 0 AND 15 AND y BETWEEN 0 AND 69 AND x BETWEEN 0 AND 69").groupBy("capture", "t", "z", "y", "x").agg(F.min("p").alias("label"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view, or a base table, as a DataFrame."""
    if name == "voxels":
        return voxels(spark, sf_dir)
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = _spark(VIEWS[name])
    used = {n: view(spark, sf_dir, n) for n in [*VIEWS, *TABLES] if re.search(rf"FROM {n}\b", text)}
    for n in used:
        text = re.sub(rf"FROM {n}\b", f"FROM {{{n}}}", text)
    return spark.sql(text, **used)


def with_views(names: list[str], sql: str) -> str:
    """The SQL for DuckDB, after the views that it uses."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if re.search(rf"FROM {other}\b", VIEWS[name]):
                add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    sql = sql.strip()
    if ctes:
        head = next((h for h in ("WITH RECURSIVE ", "WITH ") if sql.upper().startswith(h)), "")
        sql = f"{head}{ctes}, {sql[len(head):]}" if head else f"WITH {ctes} {sql}"
    return _duck(sql)
