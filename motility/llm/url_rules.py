"""URL rules by a sort-merge range join.

A host is keyed by its labels in reverse, so a rule for a host and its subdomains is an interval of keys, and the intervals
of two rules are nested or apart. Sorted keys are swept against sorted rules with a stack of the rules that are open;
each open host holds its path prefixes.

A rule table within ``broadcast_rows`` goes to the tasks, and urls are judged where they are read. A larger one is cut into
ranges of keys; urls are dealt to the range (and, where a range holds many, to one of its shares), and each range also gets the
few rules that are open where it begins.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motility.llm.common import ascii_lower, fresh, named, quoted, written

RANGE_RULES, SHARE_URLS = 50_000, 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    """Labels in reverse, each closed by a dot: a host's key is a prefix of those of its subdomains only."""
    return ".".join(reversed(host.split("."))) + "."


def nested_hosts(rules: Sequence[tuple[str, str, int]]) -> list[tuple[str, dict[str, int], list[int]]]:
    """Rules ``(host, path, number)`` as sorted ``(key, number by path, path lengths, longest first)``; of equal rules the least number."""
    by_key: dict[str, dict[str, int]] = {}
    for host, path, number in rules:
        paths = by_key.setdefault(host_key(host), {})
        paths[path] = min(number, paths.get(path, number))
    return [(k, p, sorted({*map(len, p)}, reverse=True)) for k, p in sorted(by_key.items())]


def sweep(hosts: Sequence[str], paths: Sequence[str], rules: list[tuple[str, dict[str, int], list[int]]]) -> list[int]:
    """The number of the longest fitting rule of each url, or -1; of equally long rules the one with the longer host."""
    keys = [host_key(h) for h in hosts]
    found, open_rules, ahead = [-1] * len(keys), [], 0
    if keys and rules:
        # rules before the first key that aren't open at it can be left out
        first = min(keys)
        ahead = bisect.bisect_left(rules, first, key=lambda r: r[0])
        open_rules = [rules[i] for i in _open_at(first, rules, ahead)]
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        key = keys[i]
        while open_rules and not key.startswith(open_rules[-1][0]):
            open_rules.pop()
        while ahead < len(rules) and rules[ahead][0] <= key:
            if key.startswith(rules[ahead][0]):
                open_rules.append(rules[ahead])
            ahead += 1
        best = 0
        for rule_key, by_path, lengths in open_rules:
            for n in lengths:
                if n <= len(paths[i]) and (number := by_path.get(paths[i][:n])) is not None:
                    if len(rule_key) - 1 + n >= best:
                        best, found[i] = len(rule_key) - 1 + n, number
                    break
    return found


def _open_at(key: str, rules: list, before: int) -> list[int]:
    """Places below ``before`` of the rules whose interval holds ``key``, outermost first."""
    at = []
    for end in (i + 1 for i, c in enumerate(key) if c == "."):
        i = bisect.bisect_left(rules, key[:end], 0, before, key=lambda r: r[0])
        if i < before and rules[i][0] == key[:end]:
            at.append(i)
    return at


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", broadcast_rows: int = 100_000) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``urls``. ``rules`` has ``host``, ``path`` and ``verdict``.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins (``rule`` is its host and path), and
    ``default`` holds where none fits. A null url, or one without ``://``, has an empty host and path.

    Hosts of rules are lower-cased; rules with a null host are left out, a null path is ``/``, a null verdict is the default. Of rules with the
    same host and path, the least verdict in the alphabet holds. Repeated urls are judged each; empty tables do no harm. Urls of any length are taken whole. Columns of ``urls`` with the
    added names are replaced.
    """
    urls = urls.drop("host", "path", "rule", "verdict")
    clean = rules.where("host is not null").groupBy(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("/")).alias("path")).agg(F.coalesce(F.min("verdict"), F.lit(default)).alias("verdict"))
    rows = urls.withColumn("host", host_of(F.col(quoted(url_col)))).withColumn("path", path_of(F.col(quoted(url_col))))
    if clean.limit(broadcast_rows + 1).count() <= broadcast_rows:
        kept = [tuple(r) for r in clean.collect()]
        sent = urls.sparkSession.sparkContext.broadcast((nested_hosts([(h, p, i) for i, (h, p, _) in enumerate(kept)]), [h + p for h, p, _ in kept], [v for *_, v in kept]))

        @F.pandas_udf("rule string, verdict string")
        def found(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
            nested, names, verdicts = sent.value
            at = sweep(hosts.tolist(), paths.tolist(), nested)
            return pd.DataFrame({"rule": [names[i] if i >= 0 else None for i in at], "verdict": [verdicts[i] if i >= 0 else default for i in at]}, dtype=object)

        (f,) = fresh(rows.columns, "found")
        return rows.withColumn(f, found("host", "path")).select(*named(rows.columns), f"{f}.rule", f"{f}.verdict")
    return _by_ranges(rows, clean, default)


def _by_ranges(rows: DataFrame, clean: DataFrame, default: str) -> DataFrame:
    spark = rows.sparkSession
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    n = max(1, clean.count() // RANGE_RULES)
    cut = written(clean.withColumn("key", key).repartitionByRange(n, "key").withColumn("range", F.spark_partition_id()), "rules")
    starts = sorted((r[1], r[0]) for r in cut.groupBy("range").agg(F.min("key")).collect())  # a row per range
    begins = spark.sparkContext.broadcast(([s for s, _ in starts], [r for _, r in starts]))
    # rules that are open where a range begins: prefixes of its first key
    opened = [(r, s[: i + 1]) for s, r in starts for i, c in enumerate(s[:-1]) if c == "."]
    opened = spark.createDataFrame(opened, "to int, key string").join(cut, "key").where("to != range").select("key", "host", "path", "verdict", F.col("to").alias("range"))
    all_rules = cut.unionByName(opened)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        firsts, numbers = begins.value
        return keys.map(lambda k: numbers[max(0, bisect.bisect_right(firsts, k) - 1)])

    row, key_ = fresh(rows.columns, "row", "key")
    # row numbers hold once they are written; only hosts and paths go through the sweep
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "urls")
    at = rows.select(F.col(row).alias("row"), "host", "path", range_of(key).alias("range"))
    shares = written(at.groupBy("range").agg(F.ceil(F.count("*") / SHARE_URLS).cast("int").alias("shares")), "shares")
    dealt = at.join(F.broadcast(shares), "range").withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int")).drop("shares")
    spread = all_rules.join(F.broadcast(shares), "range").select("host", "path", "verdict", "range", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["host", "path"], ignore_index=True)
        found = sweep(left["host"].tolist(), left["path"].tolist(), nested_hosts(list(zip(right["host"], right["path"], range(len(right)), strict=True))))
        names, verdicts = (right["host"] + right["path"]).tolist(), right["verdict"].tolist()
        return pd.DataFrame({"key": left["row"], "rule": [names[i] if i >= 0 else None for i in found], "verdict": [verdicts[i] if i >= 0 else default for i in found]}).astype({"rule": object, "verdict": object})

    judged = dealt.groupBy("range", "share").cogroup(spread.groupBy("range", "share")).applyInPandas(run, "key long, rule string, verdict string")
    kept = [c for c in rows.columns if c != row]
    return rows.join(judged.toDF(key_, "rule", "verdict"), F.col(row) == F.col(key_)).select(*named(kept), "rule", "verdict")
