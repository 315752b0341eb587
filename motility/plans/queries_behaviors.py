"""Queries of the behaviour and explanation operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from motility.operators import behaviors as B
from motility.operators import explain as X
from motility.operators.detections import roc_auc
from motility.plans.queries_tracks import rounded
from motility.plans.registry import query


@query("i1_union_selected", "SELECT node_id, grp, score FROM features WHERE score > 0.3 AND grp IN (1, 3)", "features")
def i1(v):
    d = v.features.withColumn("selected", F.col("score") > 0.3).select("node_id", "grp", "score", "selected")
    return B.union_selected([d.where("grp = 1"), d.where("grp = 3")]).drop("selected")


@query("i2_global_track_ids", "SELECT node_id, dense_rank() OVER (ORDER BY grp, volume, capture, track_id) AS global_track FROM track_nodes", "track_nodes")
def i2(v):
    return B.global_track_ids(v.track_nodes).select("node_id", "global_track")


Z = "z AS (SELECT row_id, grp, cluster, c.feature, (value - m) / s AS value FROM cells c JOIN (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM cells WHERE grp <= 2 GROUP BY feature) USING (feature))"


def _z(v):
    return B.standardize(v.cells, F.col("grp") <= 2)


@query("i3_standardize", f"WITH {Z} SELECT row_id, feature, round(value, 6) + 0.0::DOUBLE AS value FROM z", "cells")
def i3(v):
    return rounded(_z(v), "value").select("row_id", "feature", "value")


@query("i4_kmeans")
def i4(v):
    rows, _, _ = B.kmeans(B.to_vectors(_z(v).where("grp <= 2"), ["row_id", "grp"]), 5, replicates=100)
    return rows.select("row_id", "grp", "cluster")


HIST = """h AS (SELECT grp, cluster, count(e.vec_id) AS n FROM (SELECT DISTINCT 1 + vec_id % 4 AS grp FROM embeddings) CROSS JOIN (SELECT DISTINCT 1 + label AS cluster FROM embeddings) LEFT JOIN embeddings e ON 1 + e.vec_id % 4 = grp AND 1 + e.label = cluster GROUP BY grp, cluster),
hs AS (SELECT CAST(grp AS BIGINT) AS grp, CAST(cluster AS BIGINT) AS cluster, n, n::DOUBLE / sum(n) OVER (PARTITION BY grp) AS share FROM h)"""


def _hist(v):
    rows = v.embeddings.select((1 + F.col("vec_id") % 4).cast("long").alias("grp"), (1 + F.col("label")).cast("long").alias("cluster"))
    return B.behavior_histogram(rows)


@query("i5_behavior_histogram", f"WITH {HIST} SELECT grp, cluster, n, round(share, 6) AS share FROM hs")
def i5(v):
    return rounded(_hist(v), "share")


@query("i6_histogram_intersection", f"WITH {HIST} SELECT a.grp AS a, b.grp AS b, round(sum(least(a.share, b.share)), 6) AS overlap FROM hs a JOIN hs b ON a.cluster = b.cluster AND a.grp < b.grp GROUP BY ALL")
def i6(v):
    return rounded(B.histogram_intersection(_hist(v)), "overlap")


@query("i7_select_k", """
WITH r AS (SELECT k, CAST(1 + vec_id % 4 AS BIGINT) AS grp, CAST((label * 7 + vec_id % 3) % k AS BIGINT) AS cluster FROM embeddings, (SELECT CAST(unnest(range(2, 11)) AS BIGINT) AS k)),
n AS (SELECT k, grp, cluster, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY k, grp) AS share FROM n),
o AS (SELECT a.k, a.grp AS a, b.grp AS b, sum(least(a.share, b.share)) AS v FROM s a JOIN s b ON a.k = b.k AND a.cluster = b.cluster AND a.grp < b.grp GROUP BY ALL),
c AS (SELECT k, round(max(v), 9) AS value FROM o GROUP BY k), w AS (SELECT *, lag(value) OVER (ORDER BY k) AS a, lead(value) OVER (ORDER BY k) AS b FROM c),
p AS (SELECT coalesce(arg_min(k, value), 1) AS k FROM (SELECT * FROM w WHERE value < a AND value < b ORDER BY value, k LIMIT 1))
SELECT c.k, round(value, 6) AS value, c.k = p.k AS chosen FROM c, p""")
def i7(v):
    """The criterion over labels folded to k values, as a sweep would give them, and the k that it picks."""
    ks = v.embeddings.withColumn("k", F.explode(F.sequence(F.lit(2).cast("long"), F.lit(10).cast("long"))))
    folded = ks.select("k", (1 + F.col("vec_id") % 4).cast("long").alias("grp"), ((F.col("label") * 7 + F.col("vec_id") % 3) % F.col("k")).cast("long").alias("cluster"))
    curve = B.worst_overlaps(folded).withColumn("value", F.round("value", 9))
    picked = B.select_k(curve).withColumnRenamed("k", "best")
    return rounded(curve.crossJoin(F.broadcast(picked)).select("k", "value", (F.col("k") == F.col("best")).alias("chosen")), "value")  # one row


@query("w3_choose_behaviors")
def w3(v):
    """The sweep over the number of behaviours of the discovery groups, and the final clusters."""
    rows, _, k = B.choose_behaviors(B.to_vectors(_z(v).where("grp <= 2"), ["row_id", "grp"]), restarts=100)
    return rows.select("row_id", "grp", "cluster", F.lit(k).cast("long").alias("k"))


@query("i8_assign_nearest_centroid", f"""
WITH {Z}, c AS (SELECT cluster, feature, avg(value) AS centre FROM z WHERE grp <= 2 GROUP BY ALL),
d AS (SELECT row_id, c.cluster, sum((value - centre) * (value - centre)) AS d FROM z JOIN c ON z.feature = c.feature WHERE grp > 2 GROUP BY ALL)
SELECT row_id, cluster FROM d QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(d, 9), cluster) = 1""", "cells")
def i8(v):
    z = _z(v)
    return B.assign_nearest_centroid(z.where("grp > 2").drop("cluster"), B.long_centroids(z.where("grp <= 2")))


@query("i9_davies_bouldin", """
WITH c AS (SELECT cluster, feature, avg(value) AS m FROM cells GROUP BY ALL), r AS (SELECT x.cluster, row_id, sqrt(sum((value - m) * (value - m))) AS d FROM cells x JOIN c ON x.cluster = c.cluster AND x.feature = c.feature GROUP BY ALL),
s AS (SELECT cluster, avg(d) AS s FROM r GROUP BY cluster), a AS (SELECT p.cluster AS a, q.cluster AS b, sqrt(sum((p.m - q.m) * (p.m - q.m))) AS m FROM c p JOIN c q ON p.feature = q.feature AND p.cluster != q.cluster GROUP BY ALL),
w AS (SELECT a, max((x.s + y.s) / m) AS r FROM a JOIN s x ON x.cluster = a JOIN s y ON y.cluster = b GROUP BY a) SELECT round(avg(r), 6) AS davies_bouldin FROM w""", "cells")
def i9(v):
    return rounded(B.davies_bouldin(v.cells), "davies_bouldin")


@query("i10_sweep_top")
def i10(v):
    rows = B.to_vectors(v.cells, ["row_id"])
    return B.sweep_top(rows, [{"k": k, "seed": 1, "columns": c} for k in (2, 3, 4) for c in (None, (0, 1, 2, 3))], 3)


MOMENTS = "m AS (SELECT cluster, feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM cells GROUP BY ALL)"


@query("i11_cluster_moments", f"WITH {MOMENTS} SELECT cluster, feature, n, round(mean, 6) + 0.0::DOUBLE AS mean, round(std, 6) AS std FROM m", "cells")
def i11(v):
    return rounded(X.cluster_moments(v.cells), "mean", "std").select("cluster", "feature", "n", "mean", "std")


def _normal_sql(z: str) -> str:
    """The normal distribution function at ``z``, a column."""
    poly = lambda values: reduce(lambda acc, v: f"({acc} * abs({z}) + {v!r}::DOUBLE)", reversed(values[:-1]), f"{values[-1]!r}::DOUBLE")
    far = reduce(lambda acc, k: f"(abs({z}) + {k}::DOUBLE / {acc})", (4, 3, 2, 1), f"(abs({z}) + 0.65::DOUBLE)")
    tail = f"exp(-{z} * {z} / 2) * CASE WHEN abs({z}) < {X.TAIL_FROM!r}::DOUBLE THEN {poly(X.TAIL_ABOVE)} / {poly(X.TAIL_BELOW)} ELSE 1 / ({far} * sqrt(2 * pi())) END"
    return f"CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END"


def _overlap_sql(above: int, pairs: str, ids: str) -> str:
    """CTEs up to ``o`` (the ``ids`` and ``ovl``) from ``pairs`` of ``m1, s1, m2, s2``: crossings of the densities and areas between them. The densities of two deviations of which none is 0 are given by the views."""
    area = lambda a, b, m, s: f"({_normal_sql(f'(({b} - {m}) / {s})')}) - ({_normal_sql(f'(({a} - {m}) / {s})')})"
    return f"""p AS ({pairs}),
u AS (SELECT {ids}, CASE WHEN (s1, m1) <= (s2, m2) THEN m1 ELSE m2 END AS m, least(s1, s2) AS s, CASE WHEN (s1, m1) <= (s2, m2) THEN m2 ELSE m1 END AS n, greatest(s1, s2) AS w, least(m1 - 6 * s1, m2 - 6 * s2) AS lo, greatest(m1 + {above} * s1, m2 + {above} * s2) AS hi FROM p),
v AS (SELECT *, (1 / (w * w) - 1 / (s * s)) / 2 AS a, (m - n) / (w * w) AS b, (n - m) * (n - m) / (2 * w * w) + ln(w / s) AS c FROM u),
x AS (SELECT *, (-b - sqrt(b * b - 4 * a * c)) / (2 * a) + m AS r1, (-b + sqrt(b * b - 4 * a * c)) / (2 * a) + m AS r2 FROM v),
y AS (SELECT *, least(hi, greatest(lo, least(r1, r2))) AS x, least(hi, greatest(lo, greatest(r1, r2))) AS y FROM x),
o AS (SELECT {ids}, {area("lo", "x", "m", "s")} + {area("x", "y", "n", "w")} + {area("y", "hi", "m", "s")} AS ovl FROM y)"""


PAIRS = "SELECT a.feature, a.cluster AS ci, b.cluster AS cj, a.mean AS m1, a.std AS s1, b.mean AS m2, b.std AS s2 FROM m a JOIN m b ON a.feature = b.feature AND a.cluster < b.cluster"


@query("i12_gaussian_overlap", f"WITH {MOMENTS}, {_overlap_sql(6, PAIRS, "feature, ci, cj")} SELECT feature, ci, cj, round(ovl, 6) AS ovl FROM o", "cells")
def i12(v):
    return rounded(X.gaussian_overlap(X.cluster_moments(v.cells)), "ovl")


@query("i13_hierarchy_importance", f"""
WITH {MOMENTS}, {_overlap_sql(6, PAIRS, "feature, ci, cj")}, b AS (SELECT feature, ci AS c1, cj AS c0, ovl FROM o UNION ALL SELECT feature, cj, ci, ovl FROM o),
hn AS (SELECT DISTINCT n.cluster AS node, c.cluster, CASE WHEN c.cluster <= n.cluster THEN 1 WHEN c.cluster = 10 AND n.cluster = 1 THEN -1 ELSE 0 END AS side FROM (SELECT DISTINCT cluster FROM cells WHERE cluster < 4) n, (SELECT DISTINCT cluster FROM cells) c)
SELECT x.node, feature, round(1 - max(ovl), 6) AS importance FROM hn x JOIN hn y ON x.node = y.node AND x.side = 1 AND y.side = 0 JOIN b ON c1 = x.cluster AND c0 = y.cluster GROUP BY x.node, feature""", "cells")
def i13(v):
    clusters = v.cells.select("cluster").distinct()
    nodes = clusters.where("cluster < 4").withColumnRenamed("cluster", "node")
    hierarchy = nodes.crossJoin(clusters).withColumn("side", F.when(F.col("cluster") <= F.col("node"), 1).when((F.col("cluster") == 10) & (F.col("node") == 1), -1).otherwise(0))
    return rounded(X.hierarchy_importance(X.gaussian_overlap(X.cluster_moments(v.cells)), hierarchy), "importance")


@query("i14_best_division", """
WITH cl AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS b, count(*) OVER () AS nk FROM (SELECT DISTINCT cluster FROM cells)),
f AS (SELECT cluster, b, feature, count(*) AS n, sum(value) AS s1, sum(value * value) AS s2 FROM cells JOIN cl USING (cluster) GROUP BY ALL),
k AS (SELECT unnest(range(1, CAST(2 ** (max(nk) - 1) AS BIGINT))) * 2 AS mask FROM cl), sd AS (SELECT mask, feature, CASE WHEN (mask & (1 << b::INT)) > 0 THEN 1 ELSE 0 END AS side, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2 FROM k, f GROUP BY ALL),
q AS (SELECT mask, feature, side, s1 / n AS mean, sqrt((s2 - s1 * s1 / n) / (n - 1)) AS std FROM sd),
""" + _overlap_sql(3, "SELECT a.mask, a.feature, a.mean AS m1, a.std AS s1, b.mean AS m2, b.std AS s2 FROM q a JOIN q b ON a.mask = b.mask AND a.feature = b.feature AND a.side = 0 AND b.side = 1", "mask, feature") + """,
best AS (SELECT mask FROM (SELECT mask, round(median(ovl), 9) AS ovl FROM o GROUP BY mask) ORDER BY ovl, mask LIMIT 1),
z AS (SELECT 'split' AS kind, CASE WHEN (mask & (1 << b::INT)) > 0 THEN 1 ELSE 0 END AS cluster, row_id, feature, value FROM cells JOIN cl USING (cluster), best UNION ALL SELECT 'whole', cluster, row_id, feature, value FROM cells),
c AS (SELECT kind, cluster, feature, avg(value) AS m FROM z GROUP BY ALL), r AS (SELECT kind, cluster, row_id, sqrt(sum((value - m) * (value - m))) AS d FROM z JOIN c USING (kind, cluster, feature) GROUP BY ALL),
s AS (SELECT kind, cluster, avg(d) AS s FROM r GROUP BY ALL), a AS (SELECT p.kind, p.cluster AS a, q.cluster AS b, sqrt(sum((p.m - q.m) * (p.m - q.m))) AS m FROM c p JOIN c q ON p.kind = q.kind AND p.feature = q.feature AND p.cluster != q.cluster GROUP BY ALL),
w AS (SELECT a.kind, a, max((x.s + y.s) / m) AS r FROM a JOIN s x ON x.kind = a.kind AND x.cluster = a JOIN s y ON y.kind = a.kind AND y.cluster = b GROUP BY ALL), db AS (SELECT kind, avg(r) AS i FROM w GROUP BY kind),
n AS (SELECT count(*) FILTER ((mask & (1 << b::INT)) > 0) * 2 <= count(*) AS small FROM cl, best)
SELECT cl.cluster, CASE WHEN ((mask & (1 << b::INT)) > 0) = small THEN 1 ELSE 0 END AS side, (SELECT max(i) FILTER (kind = 'split') < max(i) FILTER (kind = 'whole') FROM db) AS accepted FROM cl, best, n""", "cells")
def i14(v):
    """The best two-way division of all clusters, the side with fewer clusters as side 1, and whether it is accepted."""
    clusters = sorted(r[0] for r in v.cells.select("cluster").distinct().collect())  # a row per cluster
    moments = X.cluster_moments(v.cells)
    mask = X.divisions(moments, clusters).orderBy(F.round("ovl", 9), "mask").first()["mask"]
    one = [c for i, c in enumerate(clusters) if mask >> i & 1]
    split, whole = X.split_indices(v.cells, one, clusters)
    one = one if 2 * len(one) <= len(clusters) else [c for c in clusters if c not in one]
    return v.cells.select("cluster").distinct().select("cluster", F.col("cluster").isin(one).cast("int").alias("side"), F.lit(split < whole).alias("accepted"))


@query("i15_build_hierarchy")
def i15(v):
    clusters = sorted(r[0] for r in v.cells.select("cluster").distinct().collect())  # a row per cluster
    return X.build_hierarchy(v.cells, clusters)


@query("i16_l1_path")
def i16(v):
    rows = B.to_vectors(_z(v), ["row_id", "cluster"]).withColumn("side", (F.col("cluster") <= 5).cast("long"))
    return X.l1_path(rows)[0]


@query("i17_select_lambda", '''
WITH r AS (SELECT feature, cluster <= 5 AS y, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk FROM cells),
s AS (SELECT feature, sum(y::INT) AS p, sum(1 - y::INT) AS n, sum(CASE WHEN y THEN rk ELSE 0 END) AS rs FROM r GROUP BY feature),
p AS (SELECT CAST(feature + 1 AS DOUBLE) / 100 AS "lambda", round(CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0::DOUBLE) / (p * n) ELSE 1 END, 9) AS auc FROM s)
SELECT coalesce(min("lambda") FILTER (auc < (SELECT arg_min(auc, "lambda") FROM p) * 0.985::DOUBLE), max("lambda")) AS "lambda" FROM p''', "cells")
def i17(v):
    """The curve is the ranking quality of each feature alone, in place of that of a model per lambda."""
    scored = v.cells.select("feature", F.col("value").alias("score"), (F.col("cluster") <= 5).cast("long").alias("label"))
    path = roc_auc(scored, by=["feature"]).select(((F.col("feature") + 1).cast("double") / 100).alias("lambda"), F.round("auc", 9).alias("auc"))
    return X.select_lambda(path)


@query("i18_rank_contributions", """
WITH s AS (SELECT feature, abs(sum(value * coef)) AS total, sum(abs(value * coef)) AS absolute FROM cells JOIN (SELECT feature, coef FROM members WHERE member = 1) USING (feature) GROUP BY feature)
SELECT feature, round(total, 6) AS total, round(absolute, 6) AS absolute, row_number() OVER (ORDER BY round(total, 9) DESC, round(absolute, 9) DESC, feature) AS place FROM s""", "cells members")
def i18(v):
    weights = v.members.where("member = 1").select("feature", F.col("coef").alias("weight"))
    return rounded(X.rank_contributions(v.cells, weights), "total", "absolute")


@query("i19_diag_lda_error", """
WITH tr AS (SELECT cluster, feature, count(*) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM cells WHERE grp <= 2 GROUP BY ALL), pv AS (SELECT feature, sum((n - 1) * v) / sum(n - 1) AS v FROM tr GROUP BY feature),
d AS (SELECT c.row_id, c.cluster, tr.cluster AS k, sum((value - m) * (value - m) / pv.v) AS d FROM cells c JOIN tr ON c.feature = tr.feature JOIN pv ON pv.feature = c.feature WHERE grp > 2 GROUP BY ALL),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(d, 9), k) = 1) SELECT round(avg((k != cluster)::INT), 6) AS error FROM b""", "cells")
def i19(v):
    return rounded(X.diag_lda_error(v.cells.where("grp <= 2"), v.cells.where("grp > 2"), "cluster"), "error")


@query("i20_kfold", """
WITH r AS (SELECT node_id AS row_id, row_number() OVER (ORDER BY md5(node_id || '#1'), node_id) - 1 AS p, count(*) OVER () AS n FROM track_nodes)
SELECT row_id, p * 7 // n + 1 AS fold FROM r""", "track_nodes")
def i20(v):
    return X.kfold(v.track_nodes.select(F.col("node_id").alias("row_id")), 7)


@query("i21_forward_selection")
def i21(v):
    long = v.cells.withColumn("label", (F.col("cluster") <= 5).cast("long"))
    chosen = X.forward_selection(long, list(range(64)), tol=0.01)
    return long.where(F.col("feature").isin(chosen)).groupBy("feature").agg(F.count("*").alias("n"))


@query("i22_explain_text", """
WITH w AS (SELECT member AS node, 'feature ' || feature AS name, coef AS weight FROM members),
s AS (SELECT *, round(abs(weight) / sum(abs(weight)) OVER (PARTITION BY node) * 100, 1) AS share FROM w)
SELECT node, string_agg(CASE WHEN weight > 0 THEN '+ ' ELSE '- ' END || name || ' ' || CAST(CAST(share AS DECIMAL(5, 1)) AS VARCHAR) || '%', chr(10) ORDER BY -abs(weight), name) AS text FROM s WHERE weight != 0 GROUP BY node""", "members")
def i22(v):
    return X.explain_text(v.members.select(F.col("member").alias("node"), F.concat(F.lit("feature "), F.col("feature").cast("string")).alias("name"), F.col("coef").alias("weight")))
