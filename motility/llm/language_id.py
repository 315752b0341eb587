"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary of byte pieces.

A language gives every piece of the vocabulary a probability. A word, with a space before it, may be cut into pieces in many ways; a forward pass over its bytes sums
the probabilities of all of them. A text's likelihood is the product over its words. Probabilities are learnt by expectation and maximisation, in which the same
forward pass and a backward one give the expected number of each piece over all segmentations.

How the work grows: Spark counts the words of every language, summed in tasks before they are shuffled, and writes the counts; each step of learning reads distinct words, not texts,
and only sums per language and piece come to the driver, so their number is bounded by the vocabulary and the languages. Scoring is one narrow pass; a task segments each distinct
word of a slice of texts once, for all languages together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motility.llm import words
from motility.llm.common import Scratch, small_batches

UNKNOWN = "und"
STEPS = 3
#: The share of a language's probability that all pieces have alike.
EVEN = 1e-4
#: Bytes of a word that are segmented together; longer words are cut into runs of so many.
RUN = 32
#: A factor per byte that keeps sums of products far from the least double.
SCALE = 32.0
SLICE_BYTES = 1 << 22
#: Numbers in one lattice of sums, about.
CELLS = 1 << 22

#: ASCII letters and all bytes of other characters: what other bytes part is never one word.
_MAYBE = words._table(lambda b: chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" or b >= 128)
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces that lower-case letters can be cut into, from a file of ``base64 rank`` lines: single bytes, and pieces without ASCII other than letters and a leading space."""
    with open(path, "rb") as file:
        pieces = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    usable = lambda p: all(b >= 128 or 97 <= b <= 122 for b in p[p[:1] == b" " :])
    return sorted({p for p in pieces if p and usable(p)} | {bytes([b]) for b in (32, *range(97, 123), *range(128, 256))})


class Lattice:
    """A trie of the pieces, and the sums over all segmentations of many words at a time."""

    def __init__(self, pieces: Sequence[bytes]):
        self.n_pieces = len(pieces)
        used = sorted({b for p in pieces for b in p})
        self.code = np.zeros(256, np.int64)
        self.code[used] = np.arange(len(used))
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, p in enumerate(pieces):
            node = 0
            for b in p:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = k
        self.ends = np.array(ends)
        self.step = np.zeros((len(children), len(used)), np.int32)  # no node leads to the root, so 0 is none
        for node, found in enumerate(children):
            for b, child in found.items():
                self.step[node, self.code[b]] = child

    def arcs(self, data: np.ndarray, offsets: np.ndarray) -> Arcs:
        """Every piece at every place of the words ``data[offsets[i]:offsets[i + 1]]``."""
        lengths = np.diff(offsets)
        word = np.repeat(np.arange(len(lengths)), lengths)
        start = np.arange(len(data))
        stop = offsets[1:][word]
        codes = self.code[data]
        node, found = np.zeros(len(data), np.int64), []
        size = 0
        while len(start):
            node = self.step[node, codes[start + size]]
            size += 1
            ended = node > 0
            start, node, stop = start[ended], node[ended], stop[ended]
            piece = self.ends[node]
            whole = piece >= 0
            found.append(np.stack([start[whole], start[whole] + size, piece[whole]]))
            on = start + size < stop
            start, node, stop = start[on], node[on], stop[on]
        begin, end, piece = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        at = word[begin] if len(word) else begin
        return Arcs(len(lengths), lengths, begin + at, end + at, piece, begin - offsets[at], end - offsets[at], at, offsets[:-1] + np.arange(len(lengths)))


@dataclass
class Arcs:
    """Pieces as arcs between slots; a word of n bytes has n + 1 of them, the first at ``first``."""

    n_words: int
    lengths: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    local_begin: np.ndarray
    local_end: np.ndarray
    word: np.ndarray
    first: np.ndarray

    def _waves(self, local: np.ndarray, target: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arcs by ``local``, in rising order, with the distinct target slots and where the arcs of each begin."""
        order = np.lexsort((target, local))
        cuts = np.flatnonzero(np.diff(local[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            chosen = order[a:b]
            t = target[chosen]
            heads = np.flatnonzero(np.diff(t, prepend=-1))
            yield chosen, t[heads], heads

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Sums over all ways from the begin of a word to each of its slots; ``weight`` has a row per arc."""
        total = np.zeros((int(self.lengths.sum()) + self.n_words, *weight.shape[1:]))
        total[self.first] = 1.0
        for chosen, slots, heads in self._waves(self.local_end, self.end):
            total[slots] += np.add.reduceat(total[self.begin[chosen]] * weight[chosen], heads, axis=0)
        return total

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """Sums over all ways from each slot of a word to its end."""
        total = np.zeros((int(self.lengths.sum()) + self.n_words, *weight.shape[1:]))
        total[self.first + self.lengths] = 1.0
        for chosen, slots, heads in self._waves(int(self.lengths.max(initial=0)) - self.local_begin, self.begin):
            total[slots] += np.add.reduceat(total[self.end[chosen]] * weight[chosen], heads, axis=0)
        return total


def units_of(found: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of letters of words given in UTF-8, as bytes and offsets, and the word of each. A run has a space before it and is cut every RUN bytes."""
    units, owner = [], []
    for k, raw in enumerate(found):
        for run in [raw] if raw.isascii() else [x.encode() for x in _LETTERS.findall(raw.decode("utf-8", "replace").lower())]:
            run = b" " + run
            for a in range(0, len(run), RUN):
                units.append(run[a : a + RUN])
                owner.append(k)
    offsets = np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64)
    return np.frombuffer(b"".join(units), np.uint8), offsets, np.array(owner, np.int64)


def distinct(part: words.Words, salt: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a slice, lower-cased; each word's number in them; and each distinct word's first place. ``salt``, by word, keeps equal words apart."""
    keys = part.hashes if salt is None else words.mixed(part.hashes + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return [words.lowered(part.data[part.starts[i] : part.ends[i]].tobytes()) for i in first], inverse, first


def word_scores(lattice: Lattice, prob: np.ndarray, found: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The log-probability of each word in each language (the columns of ``prob``), and whether it has a letter."""
    data, offsets, owner = units_of(found)
    scores, n = np.zeros((len(found), prob.shape[1])), len(offsets) - 1
    scaled = prob * SCALE
    size = max(1, CELLS // (RUN * 4 * max(1, prob.shape[1])))
    for a in range(0, n, size):
        b = min(n, a + size)
        arcs = lattice.arcs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        # a piece of k bytes is scaled k times
        weight = scaled[arcs.piece] * SCALE ** (arcs.end - arcs.begin - 1)[:, None]
        last = arcs.first + arcs.lengths
        sums = np.log(arcs.forward(weight)[last]) - arcs.lengths[:, None] * np.log(SCALE)
        np.add.at(scores, owner[a:b], sums)
    return scores, np.bincount(owner, minlength=len(found)) > 0


def expected_counts(lattice: Lattice, prob: np.ndarray, found: Sequence[bytes], langs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected numbers of pieces, by piece and language, over all segmentations of words that each stand ``counts`` times in the language ``langs``."""
    data, offsets, owner = units_of(found)
    out = np.zeros(prob.size)
    size = CELLS // (RUN * 4)
    for a in range(0, len(offsets) - 1, size):
        b = min(len(offsets) - 1, a + size)
        arcs = lattice.arcs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        lang = langs[owner[a:b]][arcs.word]
        weight = prob[arcs.piece, lang] * SCALE ** (arcs.end - arcs.begin)
        ahead, behind = arcs.forward(weight), arcs.backward(weight)
        whole = ahead[arcs.first + arcs.lengths]
        share = ahead[arcs.begin] * weight * behind[arcs.end] / whole[arcs.word]
        out += np.bincount(arcs.piece * prob.shape[1] + lang, share * counts[owner[a:b]][arcs.word], prob.size)
    return out.reshape(prob.shape)


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: CRC-32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class LanguageModel:
    pieces: list[bytes]
    langs: list[str]
    prob: np.ndarray  # by piece and language
    log_prior: np.ndarray

    def identified(self, docs: DataFrame, text_col: str = "text", name: str = "language") -> DataFrame:
        """Adds the struct ``name``: ``lang``, and ``score``, its posterior probability given the whole text.

        ``und``, with a score of 0, where the text is null or has no letter, or where nothing was learnt. Equal scores go to the first language by name. Very long texts are scored whole; a word of more than RUN
        bytes is cut into runs. Every row is scored, repeated ones alike; an empty table stays empty. Other columns are kept; one called ``name`` is replaced.
        """
        small_batches(docs.sparkSession)
        sent = docs.sparkSession.sparkContext.broadcast((self.pieces, self.langs, self.prob, self.log_prior))  # as large as the vocabulary and the languages

        @F.arrow_udf("lang string, score double")
        def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            pieces, langs, prob, log_prior = sent.value
            lattice = Lattice(pieces)
            for texts in batches:
                best, score = [], []
                for part in words.slices(texts, _MAYBE, SLICE_BYTES):
                    lang, sure = predicted(lattice, prob, log_prior, part)
                    best += [langs[k] if k >= 0 else UNKNOWN for k in lang]
                    score.append(sure)
                yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(np.concatenate([np.empty(0), *score]))], names=["lang", "score"])

        return docs.withColumn(name, identify(text_col))


def predicted(lattice: Lattice, prob: np.ndarray, log_prior: np.ndarray, part: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's language (-1: none) and its posterior probability."""
    n = part.hi - part.lo
    found, inverse, _ = distinct(part)
    if not found or not prob.shape[1]:
        return np.full(n, -1), np.zeros(n)
    scores, lettered = word_scores(lattice, prob, found)
    has = np.bincount(part.text_of_word()[lettered[inverse]], minlength=n) > 0
    total = np.zeros((n, prob.shape[1]))
    some = np.flatnonzero(part.counts)
    total[some] = np.add.reduceat(scores[inverse], part.bounds[:-1][some], axis=0)
    total += log_prior
    best = total.argmax(axis=1)
    sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(has, best, -1), np.where(has, sure, 0.0)


def fit(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", steps: int = STEPS) -> LanguageModel:
    """Learns from every text of a known language whose id isn't held out.

    ``vocabulary`` is read on the driver and its pieces are sent to the tasks. Null ids, texts and languages are left out. Each word counts as often as it stands in a language; repeated rows count each. A language's prior is its share
    of the texts. Nothing to learn from: a model without languages. Languages are labels, so there should be few hundred of them at most: a task holds their probabilities of the pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "language")
    pieces = read_vocabulary(vocabulary)
    lang = F.col(lang_col).cast("string")
    known = docs.where(F.col(id_col).isNotNull() & lang.isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(lang.alias("lang"), F.col(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column(0).dictionary_encode()
            for part in words.slices(batch.column(1), _MAYBE, SLICE_BYTES):
                ids = named.indices.to_numpy()[part.lo : part.hi]
                found, inverse, first = distinct(part, np.repeat(ids, part.counts))
                texts = part.text_of_word()[first]
                kinds = np.concatenate([ids[texts], ids])
                n_docs = np.concatenate([np.zeros(len(found), np.int64), np.ones(len(ids), np.int64)])
                n = np.concatenate([np.bincount(inverse, minlength=len(found)), np.zeros(len(ids), np.int64)])
                column = pa.array(found, pa.binary()), pa.nulls(len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(kinds)), pa.concat_arrays(column), pa.array(n), pa.array(n_docs)], names=["lang", "word", "n", "docs"])

    rows = known.mapInArrow(counted, "lang string, word binary, n long, docs long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = table = scratch.write(rows, "words")
    shares = {r["lang"]: r["docs"] for r in table.where("word is null").collect()}  # a row per language
    langs = sorted(shares)
    model = LanguageModel(pieces, langs, np.full((len(pieces), len(langs)), 1 / len(pieces)), np.log(np.array([shares[x] for x in langs], float) / max(1, sum(shares.values()))))
    table = table.where("word is not null")
    for _ in range(steps if langs else 0):
        sent = spark.sparkContext.broadcast((pieces, langs, model.prob))

        def expected(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, names, prob = sent.value
            lattice, number, total = Lattice(own), {x: k for k, x in enumerate(names)}, np.zeros((len(own), len(names)))
            for batch in batches:
                ids = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
                total += expected_counts(lattice, prob, batch.column(1).to_pylist(), ids, batch.column(2).to_numpy().astype(float))
            piece, kind = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, kind])], names=["lang", "piece", "n"])

        sums = table.select("lang", "word", "n").mapInArrow(expected, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # a row per language and piece
        n = np.zeros_like(model.prob)
        n[sums["piece"], sums["lang"]] = sums["n"]
        total = n.sum(axis=0, keepdims=True)
        model.prob = np.where(total > 0, (1 - EVEN) * n / np.maximum(total, 1e-300) + EVEN / len(pieces), 1 / len(pieces))
        sent.unpersist()
    scratch.drop(counts)
    return model
