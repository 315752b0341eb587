"""Explanation of behaviours: overlaps, divisions, hierarchies, sparse models and feature ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motility.operators.behaviors import davies_bouldin
from motility.operators.detections import roc_auc
from motility.sources.tables import stored

def cluster_moments(long: DataFrame) -> DataFrame:
    """``(cluster, feature, n, mean, std)`` with the sums ``s1, s2`` from which those of unions follow."""
    sums = long.groupBy("cluster", "feature").agg(F.count("*").alias("n"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    return with_mean_and_std(sums)


def with_mean_and_std(sums: DataFrame) -> DataFrame:
    spread = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1))).otherwise(0.0)
    return sums.withColumn("mean", F.col("s1") / F.col("n")).withColumn("std", F.sqrt(spread))


# The rational approximation of the upper tail of the normal distribution by Hart (1968), to about 1e-15; numerator and denominator from the constant term on.
TAIL_ABOVE = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911)
TAIL_BELOW = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184)
#: From here on a continued fraction takes its place.
TAIL_FROM = 7.07106781186547


def normal_cdf(x: Column) -> Column:
    """The distribution function of the standard normal, as an expression: Spark has no error function."""
    z = F.abs(x)
    poly = lambda values: reduce(lambda acc, v: acc * z + v, reversed(values[:-1]), F.lit(values[-1]))
    far = reduce(lambda acc, k: z + F.lit(float(k)) / acc, (4, 3, 2, 1), z + 0.65)
    tail = F.exp(-z * z / 2) * F.when(z < TAIL_FROM, poly(TAIL_ABOVE) / poly(TAIL_BELOW)).otherwise(1 / (far * math.sqrt(2 * math.pi)))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def overlap_area(m1: Column, s1: Column, m2: Column, s2: Column, below: float = 6.0, above: float = 6.0) -> Column:
    """The area under the lesser of two normal densities, exactly.

    It runs from ``below`` deviations under the lower mean to ``above`` over the higher one. The densities cross at the roots of a quadratic: between them the wider one is the lesser, outside the narrower; equal
    deviations cross once. Without deviation the area is 1 for equal means, else 0.
    """
    narrow = F.struct(s1.alias("s"), m1.alias("m")) <= F.struct(s2.alias("s"), m2.alias("m"))
    lo, hi = F.least(m1 - below * s1, m2 - below * s2), F.greatest(m1 + above * s1, m2 + above * s2)
    given = F.struct(
        F.when(narrow, m1).otherwise(m2).alias("m"), F.when(narrow, s1).otherwise(s2).alias("s"), F.when(narrow, m2).otherwise(m1).alias("n"), F.when(narrow, s2).otherwise(s1).alias("w"), lo.alias("lo"), hi.alias("hi"),
    )

    def crossed(p: Column) -> Column:
        d = p["n"] - p["m"]  # the narrower one stands at 0
        a, b, c = (1 / (p["w"] * p["w"]) - 1 / (p["s"] * p["s"])) / 2, -d / (p["w"] * p["w"]), d * d / (2 * p["w"] * p["w"]) + F.ln(p["w"] / p["s"])
        q = -(b + F.when(b < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * a * c))) / 2
        one, two = F.when(a != 0, q / a).otherwise(F.when(d > 0, float("-inf")).otherwise(float("inf"))), F.when(q != 0, c / q).otherwise(F.lit(float("inf")))
        held = lambda x: F.least(p["hi"], F.greatest(p["lo"], x + p["m"]))
        return F.struct(*(p[k].alias(k) for k in ("m", "s", "n", "w", "lo", "hi")), held(F.least(one, two)).alias("x"), held(F.greatest(one, two)).alias("y"))

    def area(p: Column) -> Column:
        # the signed places whose distribution functions add up to the area
        terms = F.array(*(F.struct(F.lit(sign).alias("sign"), ((at - p[m]) / p[w]).alias("z")) for sign, at, m, w in (
            (1.0, p["x"], "m", "s"), (-1.0, p["lo"], "m", "s"), (1.0, p["y"], "n", "w"), (-1.0, p["x"], "n", "w"), (1.0, p["hi"], "m", "s"), (-1.0, p["y"], "m", "s"),
        )))
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["sign"] * normal_cdf(t["z"]))

    exact = F.get(F.transform(F.transform(F.array(given), crossed), area), F.lit(0))
    return F.when((s1 > 0) & (s2 > 0), exact).when(m1 == m2, 1.0).otherwise(0.0)


def gaussian_overlap(moments: DataFrame, below: float = 6.0, above: float = 6.0) -> DataFrame:
    """``(feature, ci, cj, ovl)`` for all pairs of clusters ci < cj."""
    side = lambda n: moments.select("feature", F.col("cluster").alias(f"c{n}"), F.col("mean").alias(f"m{n}"), F.col("std").alias(f"s{n}"))
    both = side("i").join(side("j"), "feature").where("ci < cj")
    return both.select("feature", "ci", "cj", overlap_area(F.col("mi"), F.col("si"), F.col("mj"), F.col("sj"), below, above).alias("ovl"))


def hierarchy_importance(overlaps: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``(node, feature, importance)``: one less the greatest overlap of a cluster on side 1 and one on side 0."""
    both = overlaps.union(overlaps.select("feature", "cj", "ci", "ovl")).toDF("feature", "c1", "c0", "ovl")
    one = hierarchy.where("side = 1").select("node", F.col("cluster").alias("c1"))
    zero = hierarchy.where("side = 0").select("node", F.col("cluster").alias("c0"))
    return one.join(zero, "node").join(both, ["c1", "c0"]).groupBy("node", "feature").agg((1 - F.max("ovl")).alias("importance"))


def divisions(moments: DataFrame, clusters: Sequence[int]) -> DataFrame:
    """``(mask, ovl)``: the median overlap over the features of each two-way split of the clusters.

    ``mask`` has the bit of each cluster on side 1; the first cluster is always on side 0, because a split and its complement are one. Moments of a side are
    added up from the clusters', and no row is read again.
    """
    clusters = sorted(clusters)
    spark = moments.sparkSession
    masks = spark.range(1, 1 << (len(clusters) - 1)).select((F.col("id") * 2).alias("mask"))
    bits = spark.createDataFrame([(c, 1 << i) for i, c in enumerate(clusters)], "cluster long, bit long")
    sides = masks.crossJoin(F.broadcast(bits)).withColumn("side", F.when(F.col("mask").bitwiseAND(F.col("bit")) > 0, 1).otherwise(0))  # at most 2**(K-1) * K rows
    sums = sides.join(moments, "cluster").groupBy("mask", "side", "feature").agg(*(F.sum(c).alias(c) for c in ("n", "s1", "s2")))
    both = with_mean_and_std(sums)
    side = lambda k: both.where(F.col("side") == k).select("mask", "feature", F.col("mean").alias(f"m{k}"), F.col("std").alias(f"d{k}"))
    pairs = side(0).join(side(1), ["mask", "feature"]).withColumn("ovl", overlap_area(F.col("m0"), F.col("d0"), F.col("m1"), F.col("d1"), 6.0, 3.0))
    return pairs.groupBy("mask").agg(F.median("ovl").alias("ovl"))


def best_division(long: DataFrame, moments: DataFrame, clusters: Sequence[int]) -> tuple[list[int], list[int]] | None:
    """The split with the least median overlap as ``(side 1, side 0)``, side 1 the one with fewer clusters; None unless its Davies-Bouldin index is below that of the clusters."""
    clusters = sorted(clusters)
    if len(clusters) < 2:
        return None
    mask = divisions(moments, clusters).orderBy(F.round("ovl", 9), "mask").first()["mask"]
    one = [c for i, c in enumerate(clusters) if mask >> i & 1]
    rest = [c for c in clusters if c not in one]
    split, whole = split_indices(long, one, clusters)
    if len(clusters) > 2 and not split < whole:
        return None
    return (one, rest) if len(one) <= len(rest) else (rest, one)


def split_indices(long: DataFrame, one: Sequence[int], clusters: Sequence[int]) -> tuple[float, float]:
    """The Davies-Bouldin index of the clusters in two parts, ``one`` and the rest, and that of the clusters."""
    mine = long.where(F.col("cluster").isin(list(clusters)))
    split = davies_bouldin(mine.withColumn("cluster", F.col("cluster").isin(list(one)).cast("long"))).first()[0]
    return split, davies_bouldin(mine).first()[0]


def build_hierarchy(long: DataFrame, clusters: Sequence[int]) -> DataFrame:
    """``(node, cluster, side)``: nodes from 1; side is 1, 0, or -1 for a cluster that the node leaves out.

    The best division is repeated on each side. Where it is refused, each cluster is set against the rest. At most 2K - 1 divisions are tried.
    """
    moments = stored(cluster_moments(long), "moments")
    nodes: list[tuple[list[int], list[int]]] = []
    work = [sorted(clusters)]
    while work:
        here = work.pop(0)
        if len(here) < 2:
            continue
        found = best_division(long, moments, here)
        if found is not None:
            nodes.append(found)
            work += [sorted(found[0]), sorted(found[1])]
        else:
            nodes += [([c], [d for d in here if d != c]) for c in here]
    rows = [(i, c, 1 if c in one else 0 if c in zero else -1) for i, (one, zero) in enumerate(nodes, 1) for c in sorted(clusters)]
    return long.sparkSession.createDataFrame(rows, "node long, cluster long, side long")


#: The default path: 101 values from 0.001 to 1, evenly spaced by their logarithm.
LAMBDAS = tuple(10 ** (-3 + 3 * i / 100) for i in range(101))


def _quadratic_steps(grams: np.ndarray, grads: np.ndarray, starts: np.ndarray, lambdas: np.ndarray, shared: bool) -> np.ndarray:
    """The least point of each penalised quadratic model by coordinate descent; the last coordinate is the intercept, which bears no penalty.

    Models go from the greatest lambda down. A ``shared`` model begins where the one before it ended; others begin at their own start. Only features that the gradient or the weights make likely are visited; those left out are checked after.
    """
    out, width = starts.copy(), starts.shape[1]
    for n, k in enumerate(np.argsort(-lambdas)):
        gram, lam = grams[0 if shared else k], lambdas[k]
        linear = grads[0 if shared else k] - gram @ starts[k]
        w = out[np.argsort(-lambdas)[n - 1]].copy() if shared and n else starts[k].copy()
        slope = gram @ w + linear
        active = np.flatnonzero((w != 0) | (np.abs(slope) > 0.9 * lam) | (np.arange(width) == width - 1))
        while True:
            for _ in range(1000):
                most = 0.0
                for j in active:
                    curve = gram[j, j]
                    if curve <= 1e-12:
                        continue
                    raw = w[j] - slope[j] / curve
                    new = raw if j == width - 1 else math.copysign(max(0.0, abs(raw) - lam / curve), raw)
                    if new != w[j]:
                        most = max(most, abs(new - w[j]) * math.sqrt(curve))
                        slope += gram[:, j] * (new - w[j])
                        w[j] = new
                if most < 1e-9:
                    break
            missed = np.setdiff1d(np.flatnonzero(np.abs(slope) > lam * (1 + 1e-9)), active)
            if not len(missed):
                break
            active = np.union1d(active, missed)
        out[k] = w
    return out


def l1_path(rows: DataFrame, lambdas: Sequence[float] = LAMBDAS, features: str = "features", label: str = "side", max_iter: int = 50, tol: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """L1 logistic models of side 1 against side 0 for each lambda: ``(lambda, auc, nonzero)`` and ``(lambda, feature, weight)``. Features are standardised already; the intercept bears no penalty.

    All lambdas are fitted together: a pass over the rows adds up the loss, the gradient and the curvature at the weights of every lambda that has not settled, and the driver solves their small quadratic models, the
    first one, common to all, along the path. So the number of passes is that of Newton steps, about ten, however many lambdas there are. Without rows of both sides all weights are 0 and each AUC is 1.
    """
    spark = rows.sparkSession
    data = stored(rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("y"), F.col(features).cast("array<double>").alias("x")), "sides")
    told = data.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.max(F.size("x")).alias("p")).first()
    lams, n, p = np.array(lambdas, float), told["n"], told["p"] or 0
    weights = np.zeros((len(lams), p + 1))
    if n and 0 < told["ones"] < n:
        weights[:, p] = math.log(told["ones"] / (n - told["ones"]))
        best, old, waiting = np.full(len(lams), np.inf), weights.copy(), np.arange(len(lams))
        for step in range(max_iter):
            loss, grad, gram = _logistic_sums(data, weights[:1] if step == 0 else weights[waiting], p)
            if step == 0:
                weights = _quadratic_steps(gram / n, grad / n, weights, lams, True)
                best[:] = loss[0] / n
                continue
            worth = loss / n + lams[waiting] * np.abs(weights[waiting, :p]).sum(axis=1)
            worse = worth > best[waiting] + 1e-12
            # a step that went too far is halved; others go on from where they are
            slope, w = grad / n, weights[waiting]
            gap = np.where(w[:, :p] != 0, np.abs(slope[:, :p] + lams[waiting, None] * np.sign(w[:, :p])), np.maximum(0, np.abs(slope[:, :p]) - lams[waiting, None]))
            settled = ~worse & (np.maximum(gap.max(axis=1, initial=0), np.abs(slope[:, p])) < tol)
            for k, at in enumerate(waiting):
                if worse[k]:
                    weights[at] = (weights[at] + old[at]) / 2
                elif not settled[k]:
                    old[at], best[at] = weights[at], worth[k]
                    weights[at] = _quadratic_steps(gram[k : k + 1] / n, slope[k : k + 1], weights[at : at + 1], lams[at : at + 1], False)[0]
            waiting = waiting[~settled]
            if not len(waiting):
                break

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch, p)
            score = np.round(1 / (1 + np.exp(-np.clip(x @ weights.T, -700, 700))), 12)
            for k, lam in enumerate(lams):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), lam)), pa.array(y.astype(np.int64)), pa.array(score[:, k])], names=["lambda", "label", "score"])

    auc = roc_auc(stored(data.mapInArrow(scored, "lambda double, label long, score double"), "scores"), by=["lambda"])
    counts = spark.createDataFrame([(float(lam), int((np.abs(w[:p]) > 1e-9).sum())) for lam, w in zip(lams, weights, strict=True)], "lambda double, nonzero long")
    path = counts.join(F.broadcast(auc), "lambda", "left").select("lambda", F.coalesce("auc", F.lit(1.0)).alias("auc"), "nonzero")  # a row per lambda
    return path, spark.createDataFrame([(float(lam), j, float(w[j])) for lam, w in zip(lams, weights, strict=True) for j in range(p)], "lambda double, feature long, weight double")


def _matrix(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The features with a column of ones, and the labels."""
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
    return np.column_stack([x, np.ones(len(x))]), batch.column(0).to_numpy(zero_copy_only=False)


def _logistic_sums(data: DataFrame, weights: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of the logistic loss at each row of ``weights``, summed over all rows in tasks first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), 1 + (p + 1) + (p + 1) ** 2))
        for batch in batches:
            x, y = _matrix(batch, p)
            for k, w in enumerate(weights):
                z = x @ w
                chance = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                total[k, 0] += (np.logaddexp(0, z) - y * z).sum()
                total[k, 1 : p + 2] += x.T @ (chance - y)
                total[k, p + 2 :] += ((x * (chance * (1 - chance))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights))), pa.array(list(total), pa.list_(pa.float64()))], names=["model", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = table.column("sums").combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(axis=0)
        return pa.Table.from_arrays([table.column("model").slice(0, 1), pa.array([total], pa.list_(pa.float64()))], names=["model", "sums"])

    schema = "model long, sums array<double>"
    parts = data.mapInArrow(sums, schema).groupBy("model").applyInArrow(added, schema)  # a row per task and model comes in
    total = np.array([r["sums"] for r in parts.orderBy("model").collect()])
    return total[:, 0], total[:, 1 : p + 2], total[:, p + 2 :].reshape(-1, p + 1, p + 1)


def select_lambda(path: DataFrame, level: float = 0.985) -> DataFrame:
    """The first lambda whose AUC is under ``level`` times that of the least lambda; the greatest one if none is. One row ``lambda``."""
    full = path.agg(F.min_by("auc", "lambda").alias("full"), F.max("lambda").alias("last"))  # a row per lambda
    under = path.crossJoin(F.broadcast(full)).agg(F.coalesce(F.min(F.when(F.col("auc") < F.col("full") * level, F.col("lambda"))), F.max("last")).alias("lambda"))
    return under


def rank_contributions(long: DataFrame, weights: DataFrame) -> DataFrame:
    """``(feature, total, absolute, place)``: features by the size of the sum of their contributions, then of the sum of sizes."""
    part = F.col("value") * F.col("weight")
    sums = long.join(weights, "feature").groupBy("feature").agg(F.abs(F.sum(part)).alias("total"), F.sum(F.abs(part)).alias("absolute"))
    return sums.withColumn("place", F.row_number().over(Window.orderBy(F.round("total", 9).desc(), F.round("absolute", 9).desc(), "feature")).cast("long"))  # a row per feature


def diag_lda_error(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """The share of misclassified rows of diagonal linear discriminant analysis with pooled variances and equal priors: one row ``error``."""
    sums = train.groupBy(label, "feature").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    pooled = sums.groupBy("feature").agg((F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))) / F.sum(F.col("n") - 1)).alias("v"))
    model = sums.select(F.col(label).alias("_k"), "feature", "m").join(pooled, "feature")
    gap = F.col("value") - F.col("m")
    far = test.join(model, "feature").groupBy("row_id", label, "_k").agg(F.sum(F.when(F.col("v") > 0, gap * gap / F.col("v")).otherwise(0.0)).alias("d"))
    chosen = far.groupBy("row_id", label).agg(F.min_by("_k", F.struct(F.round("d", 9), "_k")).alias("_k"))
    return chosen.agg(F.avg((F.col("_k") != F.col(label)).cast("double")).alias("error"))


def kfold(df: DataFrame, m: int, seed: int = 1, row_id: str = "row_id") -> DataFrame:
    """Adds ``fold`` (1 to m): a random permutation cut into near-equal runs; a fold's training rows are those of the others.

    The permutation is that of a hash of the id and the seed, numbered in buckets of the hash, so no task holds all rows.
    """
    h = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"#{seed}")).cast("binary"))
    at = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 2))
    sizes = at.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_b"), F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy("_h", row_id))
    placed = at.withColumn("_l", local).join(F.broadcast(before), "_b")  # 256 rows
    place = F.col("_before") + F.col("_l") - 1
    return placed.withColumn("fold", (F.call_function("div", place * F.lit(m), F.col("_all")) + 1).cast("long")).drop("_h", "_b", "_l", "_before", "_all")


def forward_selection(long: DataFrame, candidates: Sequence[int], tol: float = 0.03, folds: int = 2, seed: int = 1, label: str = "label") -> list[int]:
    """Greedily chosen features: the one with the least cross-validated error is added while that gains more than ``tol``. Up to 3 candidates are all taken.

    A step rates all candidates in one grouped pass: distances of single features are kept, and those of the chosen ones are added up once.
    """
    if len(candidates) <= 3:
        return list(candidates)
    rows = kfold(long.select("row_id").distinct(), folds, seed)
    data = long.where(F.col("feature").isin(list(candidates))).join(rows, "row_id")
    parts = []
    for f in range(1, folds + 1):
        train, test = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        sums = train.groupBy(label, "feature").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
        pooled = sums.groupBy("feature").agg((F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))) / F.sum(F.col("n") - 1)).alias("v"))
        model = sums.select(F.col(label).alias("_k"), "feature", "m").join(pooled, "feature")
        gap = F.col("value") - F.col("m")
        parts.append(test.join(model, "feature").select("row_id", label, "_k", "feature", F.when(F.col("v") > 0, gap * gap / F.col("v")).otherwise(0.0).alias("d")))
    single = parts[0]
    for p in parts[1:]:
        single = single.unionByName(p)
    single = stored(single, "distances")
    chosen: list[int] = []
    error = 1.0
    while len(chosen) < len(candidates):
        rest = single.where(~F.col("feature").isin(chosen)) if chosen else single
        if chosen:
            base = single.where(F.col("feature").isin(chosen)).groupBy("row_id", "_k").agg(F.sum("d").alias("base"))
            rest = rest.join(base, ["row_id", "_k"]).withColumn("d", F.col("d") + F.col("base"))
        told = rest.groupBy("feature", "row_id", label).agg(F.min_by("_k", F.struct(F.round("d", 9), "_k")).alias("k"))
        best = told.groupBy("feature").agg(F.avg((F.col("k") != F.col(label)).cast("double")).alias("e")).orderBy(F.round("e", 12), "feature").first()
        if best is None or chosen and error - best["e"] <= tol:
            break
        chosen.append(int(best["feature"]))
        error = best["e"]
    return chosen


def explain_text(weights: DataFrame) -> DataFrame:
    """``(node, text)``: a line ``+ name 42.0%`` per feature with a weight, the largest share first; shares of a node sum to 100."""
    share = F.abs("weight") / F.sum(F.abs("weight")).over(Window.partitionBy("node")) * 100
    lines = weights.where("weight != 0").withColumn("share", F.round(share, 1))
    line = F.concat(F.when(F.col("weight") > 0, "+ ").otherwise("- "), F.col("name"), F.lit(" "), F.col("share").cast("decimal(5,1)").cast("string"), F.lit("%"))
    listed = F.array_sort(F.collect_list(F.struct((-F.abs("weight")).alias("o"), "name", line.alias("line"))))  # as many as a node's features
    return lines.groupBy("node").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))
