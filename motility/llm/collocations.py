"""Collocations by top-order marginalisation: only the longest windows are counted, and ROLLUP sums their prefixes.

At every word a lead window holds that word and those behind it in its piece, padded where the piece ends. Windows of the full length are all that is counted. A window
of fewer words is a prefix of exactly one full window at each of its places, so a ROLLUP over the window's columns gives the counts of all shorter phrases, of words, and of a language.

How the work grows: a task counts the windows of some megabytes of text by numbers, and sends each dealer of windows one sorted text with a line per distinct window, which is a third of what a row
per window takes. Windows are dealt by all words but the last, so a common word is spread over what follows it; where all these words are among the most common ones, by the last word too. A dealer
adds the windows up; those under the least count can't be candidates or parts of them, so their last word is dropped and they only go on as prefixes. What is left for ROLLUP is a
row per frequent window and a few per rarer prefix. All else is joins and aggregates of frequent phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motility.llm import words
from motility.llm.common import Scratch, ascii_lower, grows, small_batches

SLICE_BYTES = 1 << 23
#: The most common words of a bounded number of texts. They only decide where windows are added up, never what is counted.
COMMON, COMMON_TEXTS = 256, 1000
#: The last words of a language that are ranked before the ranks of all are settled in one place.
SHARES = 64

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
#: ``[^\x20\x09]`` but for the characters that part pieces.
_WORDS = words._table(lambda b: b not in (0x20, 0x09) and not _BREAKS[b])


def word_column(part: words.Words) -> pa.Array:
    """The words of a slice, A-Z lower-cased."""
    sizes = part.ends - part.starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(part.starts - offsets[:-1], sizes)
    raw = words.lowered(part.data[at].tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def piece_of_word(part: words.Words) -> np.ndarray:
    """A number per word that changes where a piece or a text ends."""
    return np.cumsum(_BREAKS[part.data])[part.starts] + part.text_of_word() * (len(part.data) + 1)


def windows(part: words.Words, langs: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray]:
    """The distinct windows of a slice: its words in order, and by window the language, the numbers of its words (-1: padding) and how often it stands there. Windows are in order."""
    column = word_column(part).dictionary_encode()
    order = pc.sort_indices(column.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word, piece = rank[column.indices.to_numpy()], piece_of_word(part)
    lead = [word]
    for k in range(1, size):
        ahead = np.full(len(word), -1)
        same = piece[k:] == piece[: len(piece) - k]
        ahead[: len(word) - k][same] = word[k:][same]
        lead.append(ahead)
    code = np.repeat(langs, part.counts).astype(np.int64)
    for ahead in lead:  # the order of codes is that of languages and windows
        _, code = np.unique(code * (len(order) + 1) + ahead + 1, return_inverse=True)
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return column.dictionary.take(pa.array(order)), np.repeat(langs, part.counts)[first], [x[first] for x in lead], n


def dealt(batches: Iterator[pa.RecordBatch], size: int, common: frozenset[bytes], dealers: int) -> Iterator[pa.RecordBatch]:
    """The distinct windows of each slice of ``(lang, text)``: a row per language and dealer, with a line per window and the counts."""
    for batch in batches:
        named = batch.column(0).dictionary_encode()
        for part in words.slices(batch.column(1), _WORDS, SLICE_BYTES):
            if not len(part.starts):
                continue
            known, lang, lead, n = windows(part, named.indices.to_numpy()[part.lo : part.hi], size)
            raw = known.to_pylist()
            crc = np.array([*map(zlib.crc32, raw), 0], np.uint64)  # the last one is that of the padding
            hot = np.array([*(w in common for w in raw), False])
            key, all_hot = np.zeros(len(n), np.uint64), np.ones(len(n), bool)
            for ahead in lead[:-1]:
                key = words.mixed(key * np.uint64(31) + crc[ahead])
                all_hot &= hot[ahead]
            key = np.where(all_hot, words.mixed(key * np.uint64(31) + crc[lead[-1]]), key)
            to = (key % np.uint64(dealers)).astype(np.int64)
            order = np.lexsort((np.arange(len(n)), all_hot, lang, to))
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1) | np.diff(lang[order], prepend=-1) | np.diff(all_hot[order].astype(int), prepend=-1))
            text = pa.concat_arrays([known, pa.array([b""], pa.large_binary())])
            lines = pc.binary_join_element_wise(*(text.take(pa.array(np.where(x < 0, len(raw), x)[order])) for x in lead), pa.scalar(b" ", pa.large_binary()))
            rows = [pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, b - a], pa.int64()), lines.slice(a, b - a)), pa.scalar(b"\n", pa.large_binary())) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
            counts = [n[order[a:b]].astype(np.int32).tobytes() for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
            head = order[cuts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[head].astype(np.int32)), named.dictionary.take(pa.array(lang[head])), pa.array([x[0].as_py() for x in rows], pa.binary()), pa.array(counts, pa.binary()), pa.array(all_hot[head])],
                names=["dealer", "lang", "lines", "counts", "spread"],
            )


def added_up(table: pa.Table, size: int, least: int) -> pa.Table:
    """The windows of one dealer and language with their sums. Those under ``least`` only go on in the sum of their prefix, and that in the sum of its own where all windows with it are under ``least`` together.

    All windows with a prefix one word shorter are here, so that prefix can be judged, but no shorter one. Windows dealt by their last word too (``spread``) have others of their prefix elsewhere, so there
    none is.
    """
    lines = pa.concat_arrays([_split(x.as_buffer()) for x in table.column("lines").combine_chunks()])
    own = lines.dictionary_encode()
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table.column("counts").combine_chunks()])
    rest = total = np.bincount(own.indices.to_numpy(), n, len(own.dictionary)).astype(np.int64)
    got, kept_lines, kept_n = own.dictionary, [], []
    last = size - 1 if table.column("spread")[0].as_py() else max(1, size - 2)
    for k in range(size - 1, last - 1, -1):
        keep = total >= least
        out = keep & (rest > 0)
        kept_lines.append(got.filter(pa.array(out)))
        kept_n.append(rest[out])
        own = _without_word(got, k).dictionary_encode()
        at, got = own.indices.to_numpy(), own.dictionary
        total, rest = (np.bincount(at, x, len(got)).astype(np.int64) for x in (total, np.where(keep, 0, rest)))
    kept_lines.append(got.filter(pa.array(rest > 0)))
    kept_n.append(rest[rest > 0])
    cells = pc.split_pattern(pa.concat_arrays([x.cast(pa.large_string()) for x in kept_lines]), " ")
    n_rows, flat = len(cells), cells.flatten()
    columns = [flat.take(pa.array(np.arange(n_rows) * size + k)).cast(pa.string()) for k in range(size)]
    return pa.Table.from_arrays([pa.repeat(table.column("lang")[0], n_rows), *columns, pa.array(np.concatenate(kept_n))], names=["lang", *(f"w{k + 1}" for k in range(size)), "n"])


def _split(raw: pa.Buffer) -> pa.Array:
    """The lines of a text."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    sizes = np.diff(ends, prepend=-1) - 1
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[data != 10].tobytes())])


def _without_word(lines: pa.Array, k: int) -> pa.Array:
    """The lines with their word ``k`` (from 0) and all behind it left empty."""
    if not len(lines):
        return lines
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    spaces = data == 32
    before = np.concatenate([[0], np.cumsum(spaces)])
    column = before[:-1] - np.repeat(before[offsets[:-1]], np.diff(offsets)) - spaces
    keep = spaces | (column < k)
    sizes = np.add.reduceat(keep, offsets[:-1], dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lines), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())])


def frequent_phrases(scratch: Scratch, docs: DataFrame, size: int, least: int) -> DataFrame:
    """``(lang, words, phrase, f)``: all phrases of up to ``size`` words with a count of ``least`` or more, and per language, with no words and an empty phrase, the number of all words.

    ``docs`` has the columns ``lang`` and ``text``, without nulls.
    """
    spark = docs.sparkSession
    small_batches(spark)
    dealers = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = docs.limit(COMMON_TEXTS).select(F.explode(F.split("text", r"[\x20\x09-\x0D.,;:!?]+")).alias("w")).where("w != ''")
    top = first.groupBy(ascii_lower(F.col("w")).alias("w")).count().orderBy(F.desc("count"), "w").limit(COMMON).collect()
    common = frozenset(r["w"].encode() for r in top)
    columns = [f"w{k + 1}" for k in range(size)]
    sent = docs.select("lang", "text").mapInArrow(lambda batches: dealt(batches, size, common, dealers), "dealer int, lang string, lines binary, counts binary, spread boolean")
    added = sent.groupBy("dealer", "lang", "spread").applyInArrow(lambda table: added_up(table, size, least), ", ".join(["lang string", *(f"{c} string" for c in columns), "n long"]))
    summed = added.groupBy("lang", *columns).agg(F.sum("n").alias("n"))
    rolled = summed.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    rolled_up = F.lit(size) - F.length(F.regexp_replace(F.bin("gid"), "0", ""))  # the words that are not rolled up
    kept = rolled.withColumn("words", rolled_up.cast("int")).where((F.col("words") >= 0) & ((F.col("words") == 0) | (F.col("f") >= least)))
    last = F.element_at(F.array(*columns), F.greatest("words", F.lit(1)))
    kept = kept.where((F.col("words") == 0) | (last != ""))  # a padded window is no phrase of its full length
    phrase = F.array_join(F.slice(F.array(*columns), F.lit(1), F.col("words")), " ")
    return scratch.write(kept.select("lang", "words", F.when(F.col("words") > 0, phrase).otherwise("").alias("phrase"), "f"), "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 3, least: int = 10, top: int = 2000, covered: int = 50) -> DataFrame:
    """The ``top`` phrases of 2 to ``size`` words of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    A is lower-cased to Z in texts, ``[.,;:!?\\n-\\r]`` part pieces, spaces and tabs part words. ``a`` is how often the phrase stands in pieces of the language, overlaps included, and is ``least`` at least; of its cuts in two,
    with counts ``l`` and ``r``, the one with the least ``score = floor(1000000 * a * a / (l * r))`` counts, of equal ones that with the shortest first part. A phrase goes if its words lie in a longer candidate that has ``covered`` per
    cent of its count. Ranks go by score, count and phrase (in bytes). ``n`` is the number of all words of the language. Arithmetic is exact up to counts of 10**15.

    Null texts are empty; a null language is ``und``. Very long texts are counted whole, and repeated rows each. A language without candidates has no rows; so has an empty table. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    phrases = frequent_phrases(scratch, rows, size, least)
    found = phrases.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    count = phrases.where("words > 0").select("lang", "phrase", "f")
    cuts = cuts.join(grows(count.toDF("lang", "first", "l")), ["lang", "first"]).join(grows(count.toDF("lang", "rest", "r")), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), exact("l") * exact("r"))
    least_cut = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = found.where("words >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    longer = inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rest = least_cut.join(grows(longer), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    rest = rest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = rest.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)  # then SHARES * top rows of a language at most
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    totals = phrases.where("words = 0").select("lang", F.col("f").alias("n"))  # a row per language
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
