"""Language-model scores by masked pseudo-likelihood.

A small network sees RADIUS words to each side of a word, never the word itself, and predicts it; the sum of the log-probabilities of all
words scores a document. A word's probability has three factors: two digits of its class, each a softmax over SIDE values of the network, and its share of the class. The
most frequent words are classes of their own; all others share the remaining classes, and there the counts of the whole corpus decide.

What is gathered grows with the corpus: Spark counts every word, and the counts of rare words are joined to their places, never collected. Each
round of training deals all documents, as word numbers, to shards of bounded size by a hash of the row, so weights depend neither on files nor on partitions;
every shard trains from the same weights, and Spark averages them by words. What comes to the driver is the vocabulary of the network and one set of weights, both bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motility.llm import words
from motility.llm.common import Scratch, fresh, named, quoted, small_batches

SIDE, DIM, RADIUS = 32, 16, 3
CODES = SIDE * SIDE
#: Classes of one word; classes that the other words share; words with a vector of their own; vectors that all other words share by hash.
SINGLES = 704
RESTS = CODES - SINGLES
VOCABULARY, BUCKETS = 8192, 4 * RESTS
#: The most frequent words, whose counts go to all tasks; those of other words are joined.
KNOWN = 1 << 17
OFFSETS = [j for j in range(-RADIUS, RADIUS + 1) if j]
ROUNDS, RATE, CHUNK = 2, 0.08, 4096
#: Words that a shard trains on, and distinct words that a task counts before it hands them on, about.
SHARD_WORDS, COUNTED = 4_000_000, 1 << 19
_SHAPES = {"scale": (len(OFFSETS), DIM), "bias": (DIM,), "out1": (DIM, SIDE), "bias1": (SIDE,), "digit": (SIDE, DIM), "out2": (DIM, SIDE), "bias2": (SIDE,)}
_SHIFT = 40


@dataclass
class Lexicon:
    """The network's words, most frequent first, then its buckets, then the mark of text ends: classes and shares by number."""

    hashes: np.ndarray  # sorted
    numbers: np.ndarray  # of the hashes
    class_of: np.ndarray  # -1 for the mark
    log_share: np.ndarray  # of a word in its class; for a bucket what a count's logarithm is to be added to
    log_unseen: float  # stands for the logarithm of the count of a word that the corpus doesn't have
    known: np.ndarray  # sorted hashes of the words whose counts are at hand
    log_count: np.ndarray  # of these words

    @property
    def mark(self) -> int:
        return len(self.class_of) - 1

    def counted(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of the count of each word, and whether it is known; 0 where it isn't."""
        if not len(self.known):
            return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[at] == hashes
        return np.where(hit, self.log_count[at], 0.0), hit

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        own = (hashes >> np.uint64(_SHIFT)).astype(np.int64) % BUCKETS + len(self.hashes)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            own = np.where(self.hashes[at] == hashes, self.numbers[at], own)
        return own.astype(np.int32)


def lexicon_of(known: np.ndarray, known_counts: np.ndarray, rest: dict[int, tuple[int, int, int]]) -> Lexicon:
    """From the most frequent words' hashes and counts, falling, and by shared class the ``(words counted, distinct words, words found once)`` of all words that hash to it."""
    known = known.astype(np.int64).view(np.uint64)
    hashes, counts = known[:VOCABULARY], known_counts[:VOCABULARY].astype(np.float64)
    shared = (hashes >> np.uint64(_SHIFT)).astype(np.int64) % RESTS
    totals = np.array([rest.get(j, (0, 0, 0)) for j in range(RESTS)], np.float64)
    np.subtract.at(totals[:, 0], shared[:SINGLES], counts[:SINGLES])
    np.subtract.at(totals[:, 1], shared[:SINGLES], 1)
    mass = np.log(np.maximum(1, totals[:, 0] + totals[:, 2]))  # words found once hint at how many there are that were not found
    k = len(hashes)
    class_of = np.concatenate([np.arange(k), SINGLES + np.arange(BUCKETS) % RESTS, [-1]]).astype(np.int32)
    class_of[SINGLES:k] = SINGLES + shared[SINGLES:]
    share = np.concatenate([np.zeros(min(k, SINGLES)), np.log(counts[SINGLES:]) - mass[shared[SINGLES:]], -mass[np.arange(BUCKETS) % RESTS], [0]])
    unseen = (totals[:, 2].sum() + 1) / (totals[:, 1].sum() + 1)
    order = np.argsort(hashes)
    by_hash = np.argsort(known)
    return Lexicon(hashes[order], order.astype(np.int32), class_of, share, math.log(min(1.0, unseen)), known[by_hash], np.log(known_counts[by_hash].astype(np.float64)))


@dataclass
class Weights:
    """Embeddings by number (the last, of text ends, stays 0), a scale per neighbour, and the two output layers."""

    embed: np.ndarray
    scale: np.ndarray
    bias: np.ndarray
    out1: np.ndarray
    bias1: np.ndarray
    digit: np.ndarray
    out2: np.ndarray
    bias2: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), *(getattr(self, k).ravel() for k in _SHAPES)])


def from_flat(x: np.ndarray, numbers: int) -> Weights:
    """The weights of a lexicon with so many numbers."""
    cut, parts = 0, {}
    for k, shape in {"embed": (numbers, DIM), **_SHAPES}.items():
        n = int(np.prod(shape))
        parts[k] = np.array(x[cut : cut + n], np.float32).reshape(shape)
        cut += n
    return Weights(**parts)


def start_weights(seed: int, numbers: int) -> Weights:
    draw = np.random.default_rng(seed)
    w = {k: draw.normal(0, 0.1, shape).astype(np.float32) for k, shape in {**_SHAPES, "embed": (numbers, DIM)}.items()}
    w["scale"] += 0.5
    w["embed"][-1] = 0
    for k in ("bias", "bias1", "bias2"):
        w[k][:] = 0
    return Weights(**w)


def laid_out(numbers: np.ndarray, counts: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers with RADIUS end marks before each text and after the last, and the places of the words."""
    places = np.arange(len(numbers)) + RADIUS * (1 + np.repeat(np.arange(len(counts)), counts))
    line = np.full(len(numbers) + RADIUS * (len(counts) + 1), mark, np.int32)
    line[places] = numbers
    return line, places


def _shifted(z: np.ndarray) -> np.ndarray:
    """z, lowered by the maximum of each row if single-precision exponentials could overflow."""
    if z.size and max(z.max(), -z.min()) > 60:
        z -= z.max(axis=1, keepdims=True)
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    """Probabilities by row, in place of z."""
    np.exp(_shifted(z), out=z)
    z /= z @ np.ones((z.shape[1], 1), np.float32)
    return z


def _log_softmax_at(z: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The logarithm of one probability of each row; z is overwritten."""
    own = _shifted(z)[row, column]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], np.float32))


def hidden(w: Weights, x: np.ndarray, n: int) -> np.ndarray:
    """The states of the n places from RADIUS on, from their neighbours' embeddings x."""
    h = np.tile(w.bias, (n, 1))
    for j, scale in zip(OFFSETS, w.scale, strict=True):
        h += x[RADIUS + j : RADIUS + j + n] * scale
    return np.tanh(h, out=h)


def log_probabilities(w: Weights, class_of: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Of the class of each number of ``line`` but its first and last RADIUS, given its neighbours. Values at end marks mean nothing."""
    found = []
    for at in range(0, len(line) - 2 * RADIUS, CHUNK):
        part = line[at : at + CHUNK + 2 * RADIUS]
        n = len(part) - 2 * RADIUS
        code = np.maximum(class_of[part[RADIUS : RADIUS + n]], 0)
        first, second, row = code // SIDE, code % SIDE, np.arange(n)
        h = hidden(w, w.embed[part], n)
        z1 = h @ w.out1
        z1 += w.bias1
        h += w.digit[first]
        z2 = h @ w.out2
        z2 += w.bias2
        found.append(_log_softmax_at(z1, row, first) + _log_softmax_at(z2, row, second))
    return np.concatenate(found or [np.empty(0, np.float32)]).astype(np.float64)


def gradients(w: Weights, class_of: np.ndarray, line: np.ndarray) -> tuple[float, int, dict, np.ndarray, np.ndarray]:
    """Sum of the losses over the words of ``line``, their number, gradients of the mean, and those of the embeddings ``(numbers, values)``."""
    n = len(line) - 2 * RADIUS
    code = class_of[line[RADIUS : RADIUS + n]]
    real = code >= 0
    code = np.maximum(code, 0)
    first, second, row = code // SIDE, code % SIDE, np.arange(n)
    count = int(real.sum())
    x = w.embed[line]
    h = hidden(w, x, n)
    p1 = _softmax(h @ w.out1 + w.bias1)
    h2 = h + w.digit[first]
    p2 = _softmax(h2 @ w.out2 + w.bias2)
    loss = -(np.log(np.maximum(p1[row, first], 1e-30)) + np.log(np.maximum(p2[row, second], 1e-30)))[real].sum()
    p1[row, first] -= 1
    p2[row, second] -= 1
    if count == n:
        p1 *= np.float32(1 / n)
        p2 *= np.float32(1 / n)
    else:
        weight = (real / max(1, count)).astype(np.float32)[:, None]
        p1 *= weight
        p2 *= weight
    ones = np.ones(n, np.float32)  # a product with it adds up faster than a sum along the first axis
    back2 = p2 @ w.out2.T
    dh = (p1 @ w.out1.T + back2) * (1 - h * h)
    one_hot = np.zeros((n, SIDE), np.float32)
    one_hot[row, first] = 1
    grad = {"out1": h.T @ p1, "bias1": ones @ p1, "out2": h2.T @ p2, "bias2": ones @ p2, "digit": one_hot.T @ back2, "bias": ones @ dh}
    dx = np.zeros_like(x)
    scale = np.empty_like(w.scale)
    for k, j in enumerate(OFFSETS):
        scale[k] = ones @ (dh * x[RADIUS + j : RADIUS + j + n])
        dx[RADIUS + j : RADIUS + j + n] += dh * w.scale[k]
    grad["scale"] = scale
    order = np.argsort(line.astype(np.uint16), kind="stable")  # a radix sort
    ordered = line[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    values = np.add.reduceat(dx[order], begins, axis=0)
    return float(loss), count, grad, ordered[begins], values


class Trainer:
    """AdaGrad from given weights; the sums of squares start anew in each round."""

    def __init__(self, w: Weights, class_of: np.ndarray):
        self.w, self.class_of, self.words, self.loss = w, class_of, 0, 0.0
        self.sums = {k: np.full(v.shape, 1e-6, np.float32) for k, v in vars(w).items()}

    def learn(self, line: np.ndarray) -> None:
        for at in range(0, len(line) - 2 * RADIUS, CHUNK):
            loss, n, grad, numbers, values = gradients(self.w, self.class_of, line[at : at + CHUNK + 2 * RADIUS])
            self.loss, self.words = self.loss + loss, self.words + n
            for k, g in grad.items():
                s, v = self.sums[k], getattr(self.w, k)
                s += g * g
                v -= RATE * g / np.sqrt(s)
            keep = numbers != len(self.class_of) - 1
            numbers, values = numbers[keep], values[keep]
            self.sums["embed"][numbers] += values * values
            self.w.embed[numbers] -= RATE * values / np.sqrt(self.sums["embed"][numbers])


@dataclass
class LanguageModel:
    lexicon: Lexicon
    weights: Weights
    counts: DataFrame  # (hash, n) of every word of the corpus

    def scored(self, docs: DataFrame, text_col: str = "text", name: str = "lm", keep: list[str] | None = None) -> DataFrame:
        """Adds the struct ``name`` to the rows of ``docs`` (to its columns ``keep``, by default all): ``n_tokens``, ``log_prob`` (sum over the tokens) and ``mean_log_prob`` (null without tokens).

        Null, empty and blank texts have no tokens and a sum of 0. Whole texts of any length are scored. Equal texts have equal scores. Rows are kept, repeated ones too;
        a column called ``name`` is replaced. An empty table gives no rows.
        """
        spark = docs.sparkSession
        small_batches(spark)
        sent = spark.sparkContext.broadcast((self.lexicon, self.weights))
        columns = [c for c in (keep or docs.columns) if c != name]
        row, got = fresh([*docs.columns, name], "row", "got")

        @F.arrow_udf("n_tokens long, log_prob double, rare array<long>")
        def score(texts: pa.Array) -> pa.Array:
            lexicon, weights = sent.value
            n_tokens, sums, ends, rare = [np.empty(0, np.int64)], [np.empty(0)], [np.zeros(1, np.int64)], [np.empty(0, np.int64)]
            for part in words.slices(texts, words.SPACED, 1 << 20):
                numbers = lexicon.numbered(part.hashes)
                line, places = laid_out(numbers, part.counts, lexicon.mark)
                each = log_probabilities(weights, lexicon.class_of, line)[places - RADIUS] + lexicon.log_share[numbers]
                other = np.flatnonzero(numbers >= len(lexicon.hashes))
                logs, hit = lexicon.counted(part.hashes[other])
                each[other] += logs
                other = other[~hit]
                each = np.concatenate([[0.0], np.cumsum(each)])
                sums.append(each[part.bounds[1:]] - each[part.bounds[:-1]])
                n_tokens.append(part.counts)
                ends.append(ends[-1][-1] + np.searchsorted(other, part.bounds[1:]))
                rare.append(part.hashes[other].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(rare)))
            return pa.StructArray.from_arrays([pa.array(np.concatenate(n_tokens)), pa.array(np.concatenate(sums)), lists], ["n_tokens", "log_prob", "rare"])

        table = Scratch(spark, "scores").write(docs.select(*named(columns), F.monotonically_increasing_id().alias(row), score(quoted(text_col)).alias(got)), "first")
        # the words beyond those known, of which none is more than one in KNOWN, meet their counts
        seen = table.select(row, F.explode(f"{got}.rare").alias("hash")).join(self.counts, "hash").groupBy(row).agg(F.sum(F.log("n")).alias("logs"), F.count("*").alias("n"))
        rest = F.coalesce("logs", F.lit(0.0)) + F.lit(self.lexicon.log_unseen) * (F.size("rare") - F.coalesce("n", F.lit(0)))
        sides = table.select(row, f"{got}.*").join(seen, row, "left")
        sums = sides.select(row, "n_tokens", (F.col("log_prob") + rest).alias("log_prob"))
        sums = sums.select(row, F.struct("n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob")).alias(name))
        return table.select(*named(columns), row).join(sums, row).select(*named(columns), name)


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """``(hash, n)`` of every word of every text."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            hashes, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return hashes, np.bincount(at, np.concatenate([n for _, n in held]), len(hashes)).astype(np.int64)

        def given():
            hashes, n = merged()
            for i in range(0, len(hashes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["hash", "n"])

        for batch in batches:
            for part in words.slices(batch.column(0), words.SPACED):
                held.append(np.unique(part.hashes, return_counts=True))
                size += len(held[-1][0])
                if size > 2 * COUNTED:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > COUNTED:
                        yield from given()
                        held, size = [], 0
        if held:
            yield from given()

    return docs.select(text_col).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent words, of equal ones those with the least hash.

    A histogram of counts first tells how frequent they are, so that tasks do not each send the driver as many words.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    held = 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.level):  # a few hundred rows
        held, least = held + r.k, r.level
        if held >= size:
            break
    return (counts.where(level >= least) if held else counts).orderBy(F.desc("n"), "hash").limit(size)


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, seed: int = 3) -> LanguageModel:
    """Counts and trains on every word of every text. Without words anywhere, the weights stay as they start.

    The result depends on the rows of ``docs`` (whatever their columns are called) but not on their order, files or partitions: rows are dealt by a hash of all their columns and
    ordered by it; rows that tie in it are equal, or as good as equal. Nulls, empty and blank texts teach nothing; a repeated row counts each time. Texts of any length are taken whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "language-model")
    counts = scratch.write(count_words(docs, quoted(text_col)), "counts")
    top = most_frequent(counts, KNOWN).toPandas().sort_values(["n", "hash"], ascending=[False, True])
    shared = F.pmod(F.shiftrightunsigned("hash", _SHIFT), F.lit(RESTS)).cast("int")
    rest = counts.groupBy(shared.alias("j")).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.count(F.when(F.col("n") == 1, 1)).alias("once"))
    rest = {r.j: (r.n, r.k, r.once) for r in rest.collect()}  # a row per shared class
    lexicon = lexicon_of(top["hash"].to_numpy(), top["n"].to_numpy(), rest)
    weights = start_weights(seed, len(lexicon.class_of))
    shards = -(-sum(r[0] for r in rest.values()) // SHARD_WORDS)
    sent_lexicon = spark.sparkContext.broadcast(lexicon)

    @F.arrow_udf("binary")
    def coded(texts: pa.Array) -> pa.Array:
        found = []
        for part in words.slices(texts, words.SPACED):
            numbers = sent_lexicon.value.numbered(part.hashes).astype(np.uint16)
            found += [numbers[a:b].tobytes() for a, b in zip(part.bounds[:-1], part.bounds[1:], strict=True)]
        return pa.array(found, pa.binary())

    hashed = [quoted(f.name) for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    lines = scratch.write(docs.select(F.xxhash64(*hashed).alias("h"), coded(quoted(text_col)).alias("words")), "lines") if shards else None
    for _ in range(rounds if shards else 0):
        sent = spark.sparkContext.broadcast(weights)

        def run(batches, sent=sent):
            lexicon = sent_lexicon.value
            before = sent.value.flat()
            trainer = Trainer(from_flat(before, len(lexicon.class_of)), lexicon.class_of)
            for batch in batches:
                held, size = [], 0
                for text in batch.column(0):
                    held.append(np.frombuffer(text.as_py(), np.uint16))
                    size += len(held[-1])
                    if size > 1 << 17:
                        trainer.learn(laid_out(np.concatenate(held), np.array([*map(len, held)]), lexicon.mark)[0])
                        held, size = [], 0
                if size:
                    trainer.learn(laid_out(np.concatenate(held), np.array([*map(len, held)]), lexicon.mark)[0])
            if trainer.words:
                after = trainer.w.flat()
                moved = np.flatnonzero(after != before)
                steps = (after[moved] - before[moved]).astype(np.float64) * trainer.words
                for i in range(0, len(moved), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(moved[i : i + (1 << 16)]), pa.array(steps[i : i + (1 << 16)])], names=["at", "step"])
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([float(trainer.words)])], names=["at", "step"])

        dealt = lines.repartition(shards, "h").sortWithinPartitions("h", "words").select("words")
        got = dealt.mapInArrow(run, "at long, step double").groupBy("at").agg(F.sum("step").alias("step")).toPandas()  # one number per weight at most
        at, step = got["at"].to_numpy(), got["step"].to_numpy()
        flat = weights.flat().astype(np.float64)
        flat[at[at >= 0]] += step[at >= 0] / step[at < 0][0]
        weights = from_flat(flat, len(lexicon.class_of))
    if lines is not None:
        scratch.drop(lines)
    return LanguageModel(lexicon, weights, counts)
