"""Quality rules: base counts of a text, and how far its characters and common words are from its language's.

Only DataFrame functions are used. Documents are read once: their counts are written, language references are the
sums of those counts over all documents of a language, and each document is then held against its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motility.llm.common import fresh, named, quoted, written

# Common function words by language.
COMMON_WORDS = {
    "de": ["das", "dem", "den", "der", "des", "die", "ein", "eine", "es", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu", "auf"],
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"],
    "es": ["con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y", "al"],
    "fr": ["au", "avec", "dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "pas", "pour", "que", "qui", "sur", "un", "une"],
}
ALL_COMMON = sorted({w for ws in COMMON_WORDS.values() for w in ws})
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Documents with fewer words have too thin histograms to be judged by them.
MIN_CHAR_WORDS, MIN_COMMON_WORDS = 60, 100
MAX_CHAR_DISTANCE, MAX_COMMON_DISTANCE = 0.30, 0.29


def words_of(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(text, SPACE), "")


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 5-word windows that are found twice or more. Hashes rule the repeats out; where they don't, the words decide."""
    window = lambda i: F.slice(words, i, F.lit(5))
    starts = F.sequence(F.lit(1), n - 4)
    hashes = F.transform(starts, lambda i: F.xxhash64(window(i)))
    listed = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(window(i), " ").alias("g"), i.alias("i"))))

    def again(rows: Column) -> Column:
        """Sorted starts of the windows that equal the one before or after them."""
        same = lambda a, b: F.coalesce(F.get(rows, a)["g"] == F.get(rows, b)["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(rows, lambda r, k: F.when(k > 0, same(k, k - 1)).otherwise(False) | same(k, k + 1)), lambda r: r["i"]))

    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  computes value once
    covered = lambda at: F.aggregate(F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.coalesce(F.least(F.lit(5), b - a), F.when(a.isNotNull(), F.lit(5)), F.lit(0))), F.lit(0), lambda s, x: s + x)
    repeated = bound(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < 6, 0).when(~repeated, 0).otherwise(bound(bound(listed, again), covered)).cast("long")


def _common_counts(words: Column, common: Column) -> Column:
    """How often each word of ``common`` is among the words, in any case."""
    # what is no common word of any language goes first; a doubled space lets neighbours be counted both
    lower = F.filter(F.split(F.lower(F.array_join(words, " ")), " "), lambda w: w.isin(ALL_COMMON))
    line = F.concat(F.lit(" "), F.array_join(lower, "  "), F.lit(" "))
    take = lambda line: F.transform(common, lambda w: F.call_function("div", F.length(line) - F.length(F.replace(line, F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))), F.length(w) + 2))
    return F.get(F.transform(F.array(line), take), F.lit(0))


def _common_of(lang: Column) -> Column:
    """The common words of a language; those of all four, each once, for any other."""
    lists = F.create_map(*(x for k, ws in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))))
    return F.coalesce(F.try_element_at(lists, lang), F.array(*map(F.lit, ALL_COMMON)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two histograms of counts; 0 where either is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    bits = lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2
    each = F.zip_with(p, q, lambda a, b: bits(a / total(p), b / total(q)))
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), total(each)))).otherwise(0.0)


def counts(docs: DataFrame, text_col: str, lang_col: str | None, name: str) -> DataFrame:
    """Adds the struct ``name`` with the base counts and the two histograms of each text."""
    t, w, n, g, c = fresh([*docs.columns, name], "text_", "words_", "n_", "lang_", "counted_")
    rows = docs.withColumn(t, F.coalesce(F.col(quoted(text_col)), F.lit(""))).withColumn(w, words_of(F.col(t)))
    rows = rows.withColumn(n, F.size(w)).withColumn(g, F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("")) if lang_col else F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_lines = F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0))
    n_chars, symbols = F.length(t), _without(F.col(t), SYMBOLS)
    word_chars = F.length(F.array_join(w, ""))
    upper, digits, points = (_without(F.col(t), p) for p in ("[A-Z]+", "[0-9]+", r"[.,;:!?'\"()\-]+"))
    accents = F.octet_length(t) - n_chars
    rows = rows.withColumn(
        c,
        F.struct(
            F.col(g).alias("lang"), F.col(n).cast("long").alias("n_words"), word_chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
            n_lines.cast("long").alias("n_dup_lines"), _repeat_words(F.col(w), F.col(n)).alias("n_repeat_words"),
            n_chars.alias("n_chars"), upper.alias("upper"), digits.alias("digits"), points.alias("points"), accents.alias("accents"),
            _common_counts(F.col(w), _common_of(F.col(g))).alias("common"),
        ),
    )
    kept, c, d = docs.columns, F.col(c), lambda x: x.cast("double")
    rest = F.greatest(F.lit(0), c["word_chars"] - c["upper"] - c["digits"] - c["points"] - c["n_symbols"] - c["accents"])
    chars = F.array(d(rest), d(c["upper"]), d(c["digits"]), d(c["points"]), d(c["n_symbols"]), d(c["accents"]), d(c["n_chars"] - c["word_chars"]))
    words = F.transform(c["common"], d)
    other = d(c["n_words"]) - F.aggregate(words, F.lit(0.0), lambda s, x: s + x)
    base = [c[x].alias(x) for x in ("lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select(*named(x for x in kept if x != name), F.struct(*base, chars.alias("chars"), F.concat(words, F.array(other)).alias("common")).alias(name))


def references(counted: DataFrame, name: str) -> DataFrame:
    """``(lang, ref_chars, ref_common)``: the histograms of a language, summed over all its documents."""
    c = F.col(quoted(name))
    both = F.concat(F.transform(c["chars"], lambda x: x), c["common"])
    cells = counted.select(c["lang"].alias("lang"), F.size(c["chars"]).alias("k"), F.posexplode(both).alias("at", "n"))
    sums = cells.groupBy("lang", "k", "at").agg(F.sum("n").alias("n"))
    listed = sums.groupBy("lang", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("sums"))  # as many as a histogram has
    return listed.select("lang", F.slice("sums", F.lit(1), F.col("k")).alias("ref_chars"), F.slice("sums", F.col("k") + 1, F.size("sums") - F.col("k")).alias("ref_common"))


def judge_quality(
    docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", name: str = "quality", keep: list[str] | None = None, small_refs: int = 1000,
) -> DataFrame:
    """Adds a struct ``name`` to the rows of ``docs`` (to its columns ``keep``, by default all).

    Fields: ``lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, common_distance, base_failed, kept``. A text fails the base rules with
    fewer than 10 words, or if more than a fifth of its words lie in 5-word windows that it repeats. It is kept if it passes and, where it has words enough for
    the histogram (60 for characters, 100 for common words), is no farther from its language than the two limits.

    A null text has no words and fails; a null language is a language of its own, with the common words of all. Whole texts of any length are judged, in the memory of the text and
    its words. No result depends on an order, so ties do nothing. Repeated rows are judged each. An empty table gives no rows. A column called ``name`` is replaced, all others are kept as they are.
    """
    base = docs.drop(name)
    columns = [c for c in (keep or base.columns) if c != name]
    counted = written(counts(base, text_col, lang_col, name).select(*named(columns), quoted(name)), "counts")
    refs = written(references(counted, name), "references")
    g, ref_chars, ref_common, char, common = fresh(counted.columns, "lang_", "ref_chars_", "ref_common_", "char_", "common_")
    small = refs.limit(small_refs + 1).count() <= small_refs
    refs = refs.toDF(g, ref_chars, ref_common)
    c = F.col(quoted(name))
    rows = counted.join(F.broadcast(refs) if small else refs, c["lang"] == F.col(g), "left")
    failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
    near = lambda n, d, most: (c["n_words"] < n) | (d <= most)
    rows = rows.withColumn(char, distance(c["chars"], F.col(ref_chars))).withColumn(common, distance(c["common"], F.col(ref_common)))
    kept = ~failed & near(MIN_CHAR_WORDS, F.col(char), MAX_CHAR_DISTANCE) & near(MIN_COMMON_WORDS, F.col(common), MAX_COMMON_DISTANCE)
    base_fields = [c[x].alias(x) for x in ("lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    verdict = F.struct(*base_fields, F.col(char).alias("char_distance"), F.col(common).alias("common_distance"), failed.alias("base_failed"), kept.alias("kept"))
    return rows.select(*named(columns), verdict.alias(name))
