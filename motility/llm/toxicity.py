"""Toxicity by a convolutional text classifier trained in NumPy.

Each word has four hashed embeddings side by side: two of the word, so that two words are taken for one another only if both hashes
meet, and those of its first four and six bytes, so that inflected forms share some. Filters over
one, two and three words are pooled by their maximum over the whole text; a linear layer scores the maxima. Embeddings start from how
much more often a bucket stands in toxic texts, because a maximum passes its gradient to one place only. A bounded sample trains the network; the score and
the thresholds of the languages are calibrated on all labelled rows, each scored by a network that has not learnt from it.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motility.llm import words
from motility.llm.common import small_batches, written

BUCKET_BITS, DIM, FILTERS, WIDTHS = 16, 8, 8, (1, 2, 3)
TABLES = 4
PAD = max(WIDTHS) - 1
N_BUCKETS = 1 << BUCKET_BITS
#: Labelled rows, and words of them, that networks are trained on at most. Calibration takes all.
MAX_LABELLED, MAX_WORDS = 6000, 6_000_000
#: Words of one text that are embedded at a time.
SPAN = 1 << 16
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Toxic labelled rows (of a language), below which 0.7 (the common threshold) holds.
MIN_POSITIVES = 15
#: Parts of the sample. A network learns from all parts but one and scores that; the final network is the one without part 0.
FOLDS = 5
GRID = np.round(np.arange(0.3, 0.9001, 0.02), 2)
#: Bins in which logits meet for the sigmoid, by unit; beyond the limit they count as the limit.
BINS, FAR = 64, 50.0
#: Bytes of a network in one row, and the tasks that send those rows to the driver, one after the other.
PIECE, SENDERS = 1 << 18, 16


def bucket_numbers(part: words.Words) -> np.ndarray:
    """The bucket numbers of each word, one for each table."""
    top = np.uint64(64 - BUCKET_BITS)
    numbers = [part.hashes >> top, part.hashes & np.uint64(N_BUCKETS - 1), part.prefixes(4) >> top, part.prefixes(6) >> top]
    return np.stack(numbers, axis=1).astype(np.int32)


@dataclass
class Network:
    """Tables of N_BUCKETS + 1 embeddings (the last, of padding, stays 0), filters by width, output layer."""

    tables: list[np.ndarray]
    filters: list[np.ndarray]  # (width, TABLES * DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, *self.biases, self.out, self.out_bias]


def new_network(seed: int) -> Network:
    draw = np.random.default_rng(seed)
    tables = [np.vstack([draw.normal(0, 0.02, (N_BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32) for _ in range(TABLES)]
    filters = [draw.normal(0, 0.15, (w, TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, ::DIM, : FILTERS // 2] = 0.3  # half of the filters begin by looking at the first number of each embedding
    return Network(tables, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.zeros(1, np.float32))


def laid_out(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in a row, each followed by PAD padding words: pairs, begins, and places where a filter may begin (one at least)."""
    begins = np.concatenate([[0], np.cumsum(counts + PAD)[:-1]]).astype(np.int64)
    out = np.full((int(counts.sum()) + PAD * len(counts), TABLES), N_BUCKETS, np.int32)
    out[np.arange(len(pairs)) + np.repeat(np.arange(len(counts)) * PAD, counts)] = pairs
    return out, begins, np.maximum(counts, 1)


def activations(net: Network, x: np.ndarray) -> list[np.ndarray]:
    """The filters' values at each place, before the maximum."""
    found = []
    for f, b in zip(net.filters, net.biases, strict=True):
        a = x @ f[0]
        for j in range(1, len(f)):
            a[:-j] += x[j:] @ f[j]
        found.append(a + b)
    return found


def embedded(net: Network, pairs: np.ndarray) -> np.ndarray:
    return np.concatenate([t[pairs[:, k]] for k, t in enumerate(net.tables)], axis=1)


def pooled(net: Network, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The maximum of each filter over each text, at least 0."""
    flat, begins, places = laid_out(pairs, counts)
    bounds = np.stack([begins, begins + places], axis=1).ravel()
    bounds[-1] = min(bounds[-1], len(flat) - 1)
    each = [np.maximum.reduceat(a, bounds)[::2] for a in activations(net, embedded(net, flat))]
    return np.maximum(np.concatenate(each, axis=1), 0)


def logits(net: Network, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if len(counts) == 1 and counts[0] > SPAN:  # a long text alone: the maximum over its parts, each of which also sees the words behind it
        ends = [(s, min(s + SPAN, len(pairs))) for s in range(0, len(pairs), SPAN)]
        parts = [np.concatenate([a[: e - s] for a in activations_of(net, pairs[s : e + PAD], e + PAD > len(pairs))], axis=1).max(axis=0) for s, e in ends]
        return np.maximum(np.max(parts, axis=0), 0)[None] @ net.out + net.out_bias
    return pooled(net, pairs, counts) @ net.out + net.out_bias


def activations_of(net: Network, pairs: np.ndarray, at_end: bool) -> list[np.ndarray]:
    """The filters' values over a part of a text, with padding behind it where the text ends."""
    if at_end:
        pairs = np.concatenate([pairs, np.full((PAD, TABLES), N_BUCKETS, np.int32)])
    return activations(net, embedded(net, pairs))


def start_from_counts(net: Network, texts: list[np.ndarray], toxic: np.ndarray) -> None:
    """Sets the first number of each embedding by how far the toxic share of the texts with its bucket is from the common share."""
    share = toxic.mean()
    for k in range(TABLES):
        seen, hits = np.zeros(N_BUCKETS + 1), np.zeros(N_BUCKETS + 1)
        for pairs, y in zip(texts, toxic, strict=True):
            at = np.unique(pairs[:, k])
            seen[at] += 1
            hits[at] += y
        z = (hits - seen * share) / np.sqrt(seen * share * (1 - share) + 1)
        net.tables[k][:, 0] += np.clip(z, -6, 6).astype(np.float32) / 3


def train(texts: list[np.ndarray], toxic: np.ndarray, seed: int = 5) -> Network:
    """Adam on the logistic loss, over texts given as bucket numbers. One class only: the network is returned as it starts."""
    net = new_network(seed)
    if not 0 < toxic.sum() < len(toxic):
        return net
    start_from_counts(net, texts, toxic)
    draw = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    table_sums = [np.full((len(t), 1), 1e-8, np.float32) for t in net.tables]
    step, n_filters = 0, len(WIDTHS) * FILTERS
    for _ in range(EPOCHS):
        order = draw.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            counts = np.array([len(texts[i]) for i in chosen])
            pairs, begins, places = laid_out(np.concatenate([texts[i] for i in chosen]), counts)
            x = embedded(net, pairs)
            acts = np.concatenate(activations(net, x), axis=1)
            top = np.stack([b + acts[b : b + n].argmax(axis=0) for b, n in zip(begins, places, strict=True)])
            best = acts[top, np.arange(n_filters)]
            z = np.maximum(best, 0) @ net.out + net.out_bias
            dz = ((1 / (1 + np.exp(-z)) - toxic[chosen]) / len(chosen)).astype(np.float32)
            grads_out, grad_bias = np.maximum(best, 0).T @ dz, np.array([dz.sum()])
            back = dz[:, None] * net.out * (best > 0)
            grads_f, grads_b = [], []
            dx: list[tuple[np.ndarray, np.ndarray]] = []
            for k, f in enumerate(net.filters):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g, where = back[:, cols], top[:, cols]
                grads_b.append(g.sum(axis=0))
                grads_f.append(np.stack([np.einsum("dfe,df->ef", x[np.minimum(where + j, len(x) - 1)], g) for j in range(len(f))]))
                dx += [(np.minimum(where + j, len(x) - 1).ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, TABLES * DIM)) for j in range(len(f))]
            step += 1
            for p, g, (m, v) in zip(net.parameters(), [*grads_f, *grads_b, grads_out, grad_bias], moments, strict=True):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            spots, values = np.concatenate([a for a, _ in dx]), np.concatenate([b for _, b in dx])
            for k, table in enumerate(net.tables):
                rows, inverse = np.unique(pairs[spots, k], return_inverse=True)
                g = np.zeros((len(rows), DIM), np.float32)
                np.add.at(g, inverse, values[:, k * DIM : (k + 1) * DIM])
                g[rows == N_BUCKETS] = 0
                table_sums[k][rows] += (g * g).mean(axis=1, keepdims=True)
                table[rows] -= 0.05 * g / np.sqrt(table_sums[k][rows])
    return net


def fitted_sigmoid(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method over logits z that stand for n rows each, with targets drawn in as Platt does; (1, 0) for one class only."""
    n1, n0 = n[y == 1].sum(), n[y == 0].sum()
    if not (n1 and n0):
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        w = w - np.linalg.solve(hessian, x.T @ (n * (p - target)) + 1e-3 * (w - [1.0, 0.0]))
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def probabilities(z: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * z.astype(np.float64) + offset, -30, 30)))


def best_threshold(rows: np.ndarray, toxic: np.ndarray, default: float) -> float:
    """The middle of the best run of thresholds of GRID by F1; ``default`` where too little is toxic to tell.

    Entry k of ``rows`` and ``toxic`` counts the rows whose score reaches exactly the first k thresholds.
    """
    if toxic.sum() < MIN_POSITIVES:
        return default
    reached, hits = (x[::-1].cumsum()[::-1][1:] for x in (rows, toxic))
    f1 = 2 * hits / np.maximum(1, reached + toxic.sum())
    return float(np.median(GRID[f1 >= f1.max() - 1e-9]))


@dataclass
class ToxicityModel:
    net: Network
    slope: float
    offset: float
    threshold: float
    by_language: dict[str, float] = field(default_factory=dict)
    sent: Broadcast | None = field(default=None, repr=False, compare=False)  # the network, where executors have it already

    def scored(self, docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", name: str = "toxicity") -> DataFrame:
        """Adds the struct ``name``: ``score`` of the whole text, the ``threshold`` of its language, ``flagged`` (at or above it).

        A null or empty text is scored as a text without words; a null or new language has the common threshold. Very long texts are scored whole, in spans; every row is scored, repeated ones alike, and a score at
        the threshold is flagged. An empty table stays empty. Rows and other columns are kept; a column called ``name`` is replaced.
        """
        small_batches(docs.sparkSession)
        sent, slope, offset = self.sent or docs.sparkSession.sparkContext.broadcast(self.net), self.slope, self.offset

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            found = [probabilities(logits(sent.value, bucket_numbers(p), p.counts), slope, offset) for p in words.slices(texts, words.ALNUM, 1 << 19)]
            return pa.array(np.concatenate([np.empty(0), *found]))

        limits = F.lit(self.threshold)
        if lang_col and self.by_language:
            pairs = F.create_map(*(F.lit(x) for item in sorted(self.by_language.items()) for x in item))
            limits = F.coalesce(F.try_element_at(pairs, F.coalesce(F.col(lang_col).cast("string"), F.lit(""))), limits)
        rows = docs.withColumn(name, score(text_col))
        return rows.withColumn(name, F.struct(F.col(name).alias("score"), limits.alias("threshold"), (F.col(name) >= limits).alias("flagged")))


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: CRC-32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "toxic", max_labelled: int = MAX_LABELLED,
) -> ToxicityModel:
    """Trains on a sample of ``max_labelled`` labelled rows at most, those first by a hash of the id, without those that would bring it over MAX_WORDS words; held-out ids are left out.

    The score and the thresholds are calibrated on all labelled rows that are not held out: those of the sample are scored by networks trained on the
    other four fifths of it, all others by the final network, which learns from four fifths of the sample. Whole texts of any length are used. Null ids and
    labels are left out; of several labels of an id the greatest counts, and of several rows one. No labelled rows: an untrained network whose scores are under 0.5.
    """
    spark = docs.sparkSession
    small_batches(spark)
    one = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    one = one.groupBy("_id").agg(F.greatest(F.lit(0), F.least(F.lit(1), F.max("_y"))).alias("_y"))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lang.alias("_lang")).where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    first = written(one.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled), "first")
    rows = named.join(F.broadcast(first), "_id").dropDuplicates(["_id"])

    def hashed(batches):
        for batch in batches:
            n = 0
            for part in words.slices(batch.column(0), words.ALNUM):
                pairs = bucket_numbers(part)
                found = [pairs[a:b].tobytes() for a, b in zip(part.bounds[:-1], part.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(n, len(found)) for k in (1, 2, 3, 4)] + [pa.array(part.counts, pa.int64()), pa.array(found, pa.binary())], names=["_id", "part", "lang", "y", "n", "pairs"])
                n += len(found)

    def trained(key, table):
        fold = key[0].as_py()
        found = [table.column(k).to_pylist() for k in ("part", "lang", "y", "pairs")]
        net, tested = fold_of(list(zip(*found, strict=True)), fold)
        kept = [(None, None, *r) for r in tested]
        if fold == 0:
            whole = pickle.dumps(net)
            kept += [(at, whole[at : at + PIECE], None, None, None) for at in range(0, len(whole), PIECE)]
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.float64())
        return pa.Table.from_arrays([pa.array([r[k] for r in kept], kind) for k, kind in enumerate(kinds)], names=["at", "net", "lang", "y", "z"])

    def within(batches):
        total = 0
        for batch in batches:
            taken = []
            for n in batch.column(1).to_pylist():
                taken.append(total + n <= MAX_WORDS)
                total += n * taken[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(taken, pa.bool_()))], names=["_id"])

    part = F.pmod(F.xxhash64(F.col("_id"), F.lit(1)), F.lit(FOLDS))
    kind = docs.schema[id_col].dataType.simpleString()
    got = written(rows.select("_text", "_id", part.alias("part"), "_lang", "_y").mapInArrow(hashed, f"_id {kind}, part long, lang string, y int, n long, pairs binary"), "hashed")
    # ids and numbers of words only, max_labelled rows at most
    ranked = got.select("_id", "n", F.xxhash64("_id").alias("_h")).repartition(1).sortWithinPartitions("_h", "_id")
    sample = F.broadcast(written(ranked.mapInArrow(within, f"_id {kind}"), "sample"))
    dealt = got.join(sample, "_id").select("part", "lang", "y", "pairs").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    # the sample is bounded, and a task trains on all of it but one part
    nets = written(dealt.groupBy("fold").applyInArrow(trained, "at long, net binary, lang string, y int, z double"), "networks")
    # the driver's JVM holds a few pieces at a time: a network in one row is copied there some ten times on its way
    pieces = {r.at: bytes(r.net) for r in nets.where("net is not null").select("at", "net").repartition(SENDERS, "at").toLocalIterator()}
    if not pieces:
        return ToxicityModel(new_network(0), 0.0, -2.0, 0.7)
    net = pickle.loads(b"".join(pieces[at] for at in sorted(pieces)))
    del pieces
    sent = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def logit(texts: pa.Array) -> pa.Array:
        found = [logits(sent.value, bucket_numbers(p), p.counts) for p in words.slices(texts, words.ALNUM, 1 << 19)]
        return pa.array(np.concatenate([np.empty(0), *found]))

    # scores meet the labels without the texts
    others = named.select("_id", "_lang", logit("_text").alias("_z")).join(one.join(sample, "_id", "left_anti"), "_id")
    others = others.groupBy("_id").agg(F.min(F.struct("_lang", "_z")).alias("_row"), F.max("_y").alias("_y"))
    logged = nets.where("net is null").select("lang", "y", "z").union(others.select("_row._lang", "_y", "_row._z"))
    model = calibrated(net, written(logged, "logits"))
    model.sent = sent
    return model


def fold_of(rows: list[tuple[int, str, int, bytes]], fold: int) -> tuple[Network, list[tuple[str, int, float]]]:
    """The network that learns from ``(part, language, label, bucket numbers)`` of all parts but ``fold``, and that part's ``(language, label, logit)``."""
    rows = sorted(rows, key=lambda r: (r[3], r[2], r[1], r[0]))
    texts = [np.frombuffer(r[3], np.int32).reshape(-1, TABLES) for r in rows]
    learnt = [i for i, r in enumerate(rows) if r[0] != fold]
    net = train([texts[i] for i in learnt], np.array([rows[i][2] for i in learnt], np.float32))
    return net, [(r[1], r[2], float(logits(net, t, np.array([len(t)]))[0])) for r, t in zip(rows, texts, strict=True) if r[0] == fold]


def calibrated(net: Network, logged: DataFrame) -> ToxicityModel:
    """The model of the network, from the ``(lang, y, z)`` of all labelled rows: only histograms come to the driver."""
    near = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), "z"))
    bins = logged.groupBy("y", F.round(near * BINS).alias("bin")).agg(F.avg(near).alias("z"), F.count("*").alias("n")).orderBy("y", "bin").collect()
    z, y, n = (np.array([r[k] for r in bins], np.float64) for k in ("z", "y", "n"))
    slope, offset = fitted_sigmoid(z, y, n)

    @F.arrow_udf("int")
    def reach(zs: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(GRID, probabilities(zs.to_numpy(zero_copy_only=False), slope, offset), "right").astype(np.int32))

    counts = written(logged.select("lang", "y", reach("z").alias("k")).groupBy("lang", "k").agg(F.count("*").alias("n"), F.sum("y").alias("toxic")), "counts")
    enough = counts.groupBy("lang").agg(F.sum("toxic").alias("_all")).where(F.col("_all") >= MIN_POSITIVES).select("lang")
    common, by_language = np.zeros((2, len(GRID) + 1), np.int64), {}
    for r in counts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect():
        common[:, r.k] = r.n, r.toxic
    for r in counts.join(enough, "lang").collect():  # a row per language and step of the grid at most
        by_language.setdefault(r.lang, np.zeros_like(common))[:, r.k] = r.n, r.toxic
    threshold = best_threshold(*common, 0.7)
    return ToxicityModel(net, slope, offset, threshold, {k: best_threshold(*v, threshold) for k, v in by_language.items()})
