"""A reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Only DataFrame functions are used. The permutation acts on pairs of digits to the base ceil(sqrt(n)), so it leaves the range of
the n row numbers for at most 2 * sqrt(n) + 1 values, and walks back in a step or two. How many steps are enough is
found beforehand on those values alone.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motility.llm.common import fresh, named, quoted
from motility.llm.numbering import md5_bucket, numbered

ROUNDS = 6
_P, _Q = 2147483647, 2147483629  # the two largest primes below 2**31


def round_keys(seed: int) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(1, _P), draw.randrange(1, _P)) for _ in range(ROUNDS)]


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def base_of(n: int) -> int:
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def permuted_once(x: Column, base: int, seed: int) -> Column:
    """The Feistel permutation of 0 .. base * base - 1. Every product stays below 2**62."""
    mod = lambda a, b: a % F.lit(b).cast("long")

    def turn(state, key):
        t = mod(state["r"] * key["m"] + key["c"], _P)
        t = mod(mod(t * t, _Q) * key["c"] + key["m"], _P)
        return F.struct(state["r"].alias("l"), mod(state["l"] + t, base).alias("r"))

    keys = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c")) for m, c in round_keys(seed)))
    start = F.struct(_div(x, base).alias("l"), mod(x, base).alias("r"))
    return F.aggregate(keys, start, turn, lambda s: s["l"] * F.lit(base).cast("long") + s["r"])


def walk_steps(spark: SparkSession, n: int, seed: int) -> int:
    """Steps that surely lead every number below n to one below n.

    A walk that leaves the range goes over the values from n on. Their number still outside after k steps stops
    falling once only cycles that never meet the range are left, and no walk from the range runs into those.
    """
    base = base_of(n)
    outside = spark.range(n, base * base).select(F.col("id").alias("x"))
    steps, before = 1, base * base - n
    while before:
        outside = outside.select(permuted_once(F.col("x"), base, seed).alias("x")).where(F.col("x") >= n)
        now = outside.count()
        if now == before:
            break
        before, steps = now, steps + 1
    return steps


def permuted(x: Column, n: int, seed: int, steps: int) -> Column:
    """The place of row number ``x`` in the shuffle of 0 .. n - 1: a bijection."""
    base = base_of(n)
    first = permuted_once(x, base, seed)
    if steps == 1:
        return first
    return F.aggregate(F.sequence(F.lit(2), F.lit(steps)), first, lambda p, _: F.when(p < n, p).otherwise(permuted_once(p, base, seed)))


def shard(df: DataFrame, key: str = "doc_id", n_shards: int = 8, seed: int = 11, order: list[str] | None = None) -> DataFrame:
    """Deals all rows to ``n_shards`` in a reproducible random order; returns ``df`` with ``row_number``, ``shard int``, ``slot long``.

    The row number is the place by (MD5 bucket of the key and ``order``, key, ``order``), p its image under the permutation; then
    shard = p mod n_shards and slot = p div n_shards, so shard sizes differ by one at most and slots are gapless. The same rows and seed give
    the same places on any cluster.

    Rows with a null key come first in their bucket; many of them, or of any key, are spread over buckets by ``order`` (by default a hash of all columns). Rows that tie
    in the key and ``order`` may swap places. Texts of any length are carried along but not ordered by. An empty table gives no rows. Columns of ``df`` with one of the three
    added names are replaced, all others kept, whatever their names.
    """
    df = df.drop("row_number", "shard", "slot")
    bucket, tie, place = fresh([*df.columns, "row_number", "shard", "slot"], "bucket", "tie", "place")
    hashed = [quoted(f.name) for f in df.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    keyed = df.withColumn(tie, F.xxhash64(*(map(quoted, order) if order else hashed)))
    keyed = keyed.withColumn(bucket, md5_bucket(F.col(quoted(key)), *(F.col(quoted(c)) for c in order or [tie])))
    rows, n = numbered(keyed, bucket, [key, *(order or ()), tie])
    at = permuted(F.col("row_number"), n, seed, walk_steps(df.sparkSession, n, seed))
    rows = rows.withColumn(place, at)
    return rows.select(*named(df.columns), "row_number", (F.col(place) % n_shards).cast("int").alias("shard"), _div(F.col(place), n_shards).alias("slot"))


def write_shards(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Writes sharded rows as ``path/shard=k/...``, each file a gapless run of slots in order."""
    (part,) = fresh(df.columns, "part")
    dealt = df.withColumn(part, _div(F.col("slot"), rows_per_file)).repartition("shard", part).sortWithinPartitions("shard", "slot")
    dealt.drop(part).write.partitionBy("shard").parquet(path)
