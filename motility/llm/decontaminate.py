"""Benchmark decontamination by winnowing.

Both sides keep the least 5-word hash of each run of six (the rightmost on ties), so a shared span of 10 words or more always
shares a kept fingerprint. Fingerprints of documents are joined with those of the benchmark; at each hit the
10-word windows that hold it are compared word by word, which extends the hit to the whole shared span.
Items of fewer words are one window, kept whole.

The join has two ways. A benchmark whose measured size is within ``broadcast_bytes`` is sent to the tasks, and the
documents are read once without a shuffle. A larger one is joined by shuffles: fingerprints first, then windows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motility.llm import words
from motility.llm.common import fresh, named, quoted, small_batches, written

WINDOW, GRAM = 10, 5
RUN = WINDOW - GRAM + 1
_NEVER = np.uint64(2**64 - 1)


def kept_grams(part: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: the positions that some run of RUN windows in one text keeps, and their hashes."""
    hashes, at = part.grams(GRAM)
    n = len(part.hashes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    line = np.full(len(part.hashes), _NEVER)
    line[at] = hashes
    text = part.text_of_word()
    inside = text[:n] == text[WINDOW - 1 :]
    least = line[:n].copy()
    for j in range(1, RUN):
        np.minimum(least, line[j : n + j], out=least)
    kept = np.zeros(len(line), bool)
    for j in range(RUN - 1, -1, -1):
        here = inside & (line[j : n + j] == least)
        kept[j : n + j] |= here
        inside &= ~here
    at = np.flatnonzero(kept)
    return at, line[at]


def windows_of_item(text: str | None) -> list[tuple[int, bytes, int]]:
    """``(words, text, fingerprint)`` of each window of one item."""
    found = []
    for part in words.slices(pa.array([text], pa.string()), words.ALNUM):
        n = len(part.hashes)
        if 0 < n < WINDOW:
            found.append((n, part.span(0, n), int(part.grams(n)[0][0])))
        for s in range(n - WINDOW + 1):
            run = part.grams_at(np.arange(s, s + RUN), GRAM)
            found.append((WINDOW, part.span(s, s + WINDOW), int(run.min())))
    return found


def candidate_windows(part: words.Words, at: np.ndarray) -> np.ndarray:
    """Starts of the 10-word windows, each in one text, that hold one of the 5-word windows ``at``."""
    starts = np.unique((at[:, None] - np.arange(RUN)).ravel())
    starts = starts[(starts >= 0) & (starts <= len(part.hashes) - WINDOW)]
    text = np.searchsorted(part.bounds, starts, "right")
    return starts[text == np.searchsorted(part.bounds, starts + WINDOW - 1, "right")]


def merged(windows: list[tuple[int, int]]) -> list[dict]:
    """Sorted disjoint spans that cover ``(start, length)`` windows."""
    spans: list[list[int]] = []
    for s, n in sorted(windows):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], s + n)
        else:
            spans.append([s, s + n])
    return [{"start": s, "length": e - s} for s, e in spans]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    name: str = "leak", broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """Marks the words of each document that lie in a window of a benchmark item.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Returns the rows of ``docs`` with a struct ``name``: ``(n_words, n_hit,
    n_items, spans, items, items_sha256, contaminated)``, where spans count words and are disjoint, and items are ids as strings, sorted.

    Null, empty and wordless texts have no words and no hits. Repeated rows and null ids are kept, row by row. An item without words has no
    window; items with equal texts or ids count by id. A null item id never appears in ``items`` but its windows
    hit. An empty benchmark hits nothing, an empty table gives no rows. Whole texts of any length are searched; memory follows the longest. Equal hashes of a run tie, and the last is its
    fingerprint. Other columns are kept, but for one called ``name``, which is replaced.
    """
    small_batches(docs.sparkSession)
    side = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    size = side.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length(F.coalesce("item", F.lit("")))), F.lit(0))).first()[0]
    out = (_in_tasks if size <= broadcast_bytes else _by_shuffle)(docs, side, text_col, name)
    got = F.col(quoted(name))
    hit = F.aggregate(got["spans"], F.lit(0).cast("long"), lambda n, s: n + s["length"])
    items = F.array_sort(got["items"])
    return out.select(
        *named(c for c in docs.columns if c != name),
        F.struct(
            got["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(got["items"]).cast("long").alias("n_items"), got["spans"].alias("spans"),
            items.alias("items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(got["spans"]) > 0).alias("contaminated"),
        ).alias(name),
    )


def _in_tasks(docs: DataFrame, side: DataFrame, text_col: str, name: str) -> DataFrame:
    owners: dict[bytes, set[str]] = defaultdict(set)
    prints = defaultdict(set)
    for row in side.collect():
        for n, text, fingerprint in windows_of_item(row["text"]):
            owners[text] |= {row["item"]} - {None}
            prints[n].add(fingerprint)
    known = docs.sparkSession.sparkContext.broadcast((dict(owners), {n: np.array(sorted(p), np.uint64) for n, p in prints.items()}))

    @F.arrow_udf(_FOUND)
    def leaks(texts: pa.Array) -> pa.Array:
        owners, prints = known.value
        n_words, spans, shared = [], [], []
        for part in words.slices(texts, words.ALNUM):
            hits: list[list[tuple[int, int]]] = [[] for _ in part.counts]
            items: list[set[str]] = [set() for _ in part.counts]
            for size, starts in _candidates(part, prints):
                for s, i in zip(starts, np.searchsorted(part.bounds, starts, "right") - 1, strict=True):
                    if (own := owners.get(part.span(s, s + size))) is not None:
                        hits[i].append((int(s - part.bounds[i]), size))
                        items[i] |= own
            n_words += part.counts.tolist()
            spans += map(merged, hits)
            shared += map(list, items)
        columns = pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(shared, pa.list_(pa.string()))
        return pa.StructArray.from_arrays(columns, ["n_words", "spans", "items"])

    return docs.withColumn(name, leaks(quoted(text_col)))


_FOUND = "n_words long, spans array<struct<start:long,length:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _candidates(part: words.Words, prints: dict[int, np.ndarray]):
    """Starts of the windows of each length that hold a known fingerprint."""
    for size, known in prints.items():
        if size == WINDOW:
            at, hashes = kept_grams(part)
            yield size, candidate_windows(part, at[_among(hashes, known)])
        else:
            hashes, at = part.grams(size)
            yield size, at[_among(hashes, known)]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def _by_shuffle(docs: DataFrame, side: DataFrame, text_col: str, name: str) -> DataFrame:
    kept = [c for c in docs.columns if c != name]
    (row,) = fresh([*docs.columns, name], "row")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # row numbers hold once they are written
    rows = docs.select(F.col(row).alias("_row"), F.col(quoted(text_col)).alias("text"))

    def item_windows(batches):
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                found = windows_of_item(text.as_py())
                cols = [pa.array([item.as_py()] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.array(np.array([f[2] for f in found], np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["item", "size", "window", "print"])

    known = written(side.mapInArrow(item_windows, "item string, size int, window binary, print long"), "windows")
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # at most WINDOW numbers

    def prints(batches):
        for batch in batches:
            n = 0
            for part in words.slices(batch.column(1), words.ALNUM):
                for size in sizes:
                    hashes, at = part.grams(size) if size < WINDOW else kept_grams(part)[::-1]
                    text = np.searchsorted(part.bounds, at, "right") - 1
                    cols = [batch.column(0).take(pa.array(n + text)), pa.array(np.full(len(at), size), pa.int32()), pa.array(at - part.bounds[text], pa.int64()), pa.array(hashes.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["_row", "size", "at", "print"])
                n += len(part.counts)

    hits = rows.mapInArrow(prints, "_row long, size int, at long, print long").join(known.select("size", "print").distinct(), ["size", "print"], "left_semi")
    places = hits.groupBy("_row").agg(F.collect_set(F.struct("size", "at")).alias("places"))

    def windows(batches):
        for batch in batches:
            n = 0
            for part in words.slices(batch.column(1), words.ALNUM):
                found = []
                for i, places in enumerate(batch.column(2).slice(n, len(part.counts)).to_pylist()):
                    base, mine = part.bounds[i], []
                    for size in {p["size"] for p in places or ()}:
                        at = np.array(sorted(p["at"] for p in places if p["size"] == size)) + base
                        starts = candidate_windows(part, at) if size == WINDOW else at
                        mine += [{"start": int(s - base), "size": size, "window": part.span(s, s + size)} for s in starts]
                    found.append(mine)
                cols = [batch.column(0).slice(n, len(found)), pa.array(part.counts, pa.int64()), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int32()), ("window", pa.binary())])))]
                n += len(found)
                yield pa.RecordBatch.from_arrays(cols, names=["_row", "n_words", "windows"])

    placed = rows.join(places, "_row", "left").select("_row", "text", "places")
    seen = written(placed.mapInArrow(windows, "_row long, n_words long, windows array<struct<start:long,size:int,window:binary>>"), "seen")
    windows_of = seen.select("_row", F.inline("windows"))
    hits = windows_of.join(known.select("window").distinct(), "window", "left_semi").groupBy("_row").agg(F.collect_set(F.struct("start", "size")).alias("hits"))
    # items meet documents one by one, so a window that many items share gathers nothing
    owners = windows_of.select("_row", "window").distinct().join(known.select("window", "item").distinct(), "window").groupBy("_row").agg(F.collect_set("item").alias("items"))
    found = hits.join(owners, "_row")

    @F.pandas_udf("array<struct<start:long,length:long>>")
    def disjoint(column: pd.Series) -> pd.Series:
        return column.map(lambda hits: merged([(w["start"], w["size"]) for w in hits]))

    spans = found.select("_row", disjoint("hits").alias("spans"), "items")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    got = seen.select("_row", "n_words").join(spans, "_row", "left").select("_row", F.struct("n_words", F.coalesce("spans", none("struct<start:long,length:long>")).alias("spans"), F.coalesce("items", none("string")).alias("items")).alias("found"))
    key, found = fresh(docs.columns, "key", "found")
    return docs.join(got.toDF(key, found), F.col(row) == F.col(key)).select(*named(kept), F.col(found).alias(name))
