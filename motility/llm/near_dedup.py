"""Near-duplicate groups by MinHash: universal hash minima, banding, signature and set verification, components.

How the work grows: one narrow pass makes a profile per document; documents with equal shingle sets fall together in a
class before anything is paired. Every band bucket pairs its members with two centres, the member that shares most buckets with others and one drawn by hash, so a bucket of m
members gives fewer than 2 * m pairs. Buckets whose members then still lie in several components are settled to the end: first a prefix filter leaves out members
that can be alike to none of another component (two sets that are alike enough share one of their rarest shingles, so documents that share a
template but hold a fifth or more of their own meet nobody), then the rest meet in blocks of bounded size, those outside a bucket's largest component against all.
There, sizes and the numbers of shingles found elsewhere rule out most pairs, then signatures, then full sets; only links that connect components are put out.

Keys that may be hot are salted: a bucket or a centre with many members is dealt to many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motility.llm import words
from motility.llm.common import Scratch, fresh, grows, small_batches
from motility.llm.components import linked

#: Members, and shingles, that one block of a bucket holds, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Members of a bucket, and pairs of a centre, that go to one task, about.
SHARE = 50_000
_SHORT = np.uint64(0xA24BAED4963EE407)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, slice by slice; the whole sequence where it has fewer words."""
    for part in words.slices(texts, words.SPACED):
        hashes, at = part.grams(size)
        cut = np.searchsorted(at, part.bounds)
        sets = []
        for i, n in enumerate(part.counts):
            if n >= size:
                sets.append(np.unique(hashes[cut[i] : cut[i + 1]]))
            elif n:
                acc = _SHORT + np.uint64(n)
                for x in part.hashes[part.bounds[i] : part.bounds[i + 1]]:
                    acc = words.mixed(np.array([acc ^ x]))[0]
                sets.append(np.array([acc], np.uint64))
            else:
                sets.append(np.empty(0, np.uint64))
        yield sets


def minima(sets: list[np.ndarray], multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of each multiply-shift hash (32 bits) over each set; all sets have elements."""
    x = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(multipliers)), np.uint32)
    values = np.empty_like(x)
    for k in range(len(multipliers)):
        np.multiply(x, multipliers[k], out=values)
        values += offsets[k]
        out[:, k] = np.minimum.reduceat(values, begins) >> np.uint64(32)
    return out


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def profiles(docs: DataFrame, shingle: int, bands: int, rows: int, seed: int) -> DataFrame:
    """``(doc_id, key, n_shingles, digest, signature, bands)`` of each row of ``docs(doc_id, key, text)``; empty sets have the last three null."""
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)
    names = ["doc_id", "key", "n_shingles", "digest", "signature", "bands"]

    def run(batches):
        for batch in batches:
            n = 0
            for sets in shingle_sets(batch.column(2), shingle):
                full = [i for i, s in enumerate(sets) if len(s)]
                digests, signatures, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    lows = minima([sets[i] for i in full], a, b)
                    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(full), 1))
                    for r in range(rows):
                        key = words.mixed(key * words._STEP + lows[:, r::rows].astype(np.uint64))
                    for j, i in enumerate(full):
                        digests[i] = digest_of(sets[i])
                        signatures[i] = lows[j].tobytes()
                        keys[i] = key[j].astype(np.int64)
                cols = [batch.column(0).slice(n, len(sets)), batch.column(1).slice(n, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                n += len(sets)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key binary, n_shingles long, digest binary, signature binary, bands array<long>")


def set_table(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(node, shingles array<long>)`` of the classes in ``wanted(node, doc_id, digest)``, each once."""

    def run(batches):
        for batch in batches:
            for sets in shingle_sets(batch.column(0), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(map(digest_of, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])

    # texts without an id are few or hot, and go through without a shuffle
    texts = docs.where("doc_id is not null").join(grows(wanted.select("doc_id").where("doc_id is not null")), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    return texts.select("text").mapInArrow(run, "digest binary, shingles array<long>").join(grows(wanted.select("node", "digest")), "digest").select("node", "shingles").dropDuplicates(["node"])


def _alike(percent: int) -> Column:
    """Whether the sets x_set and y_set are that similar: whole numbers, so exact."""
    both = F.size(F.array_intersect("x_set", "y_set"))
    return F.lit(100) * both >= F.lit(percent) * (F.size("x_set") + F.size("y_set") - both)


def _shares(n: Column) -> Column:
    return F.ceil(n / SHARE).cast("int")


def _share_of(node: Column, shares: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(9)), shares).cast("int")


def verified(scratch: Scratch, pairs: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int, slack: float) -> DataFrame:
    """Those of ``pairs(x, y, share)`` whose signatures agree in nearly enough places and whose full sets are alike.

    ``slack`` is how far below the threshold a signature may fall. An ``x`` with many pairs is dealt to many tasks by ``share``.
    """
    need = percent / 100 - slack

    def agree(batches):
        for batch in batches:
            p, q = (_signatures(batch.column(c)) for c in ("x_sig", "y_sig"))
            if len(p):
                yield batch.select(["x", "y", "share"]).filter(pa.array((p == q).mean(axis=1) >= need))

    def both(pairs: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
        side = lambda c: table.select(F.col("node").alias(c), F.col(column).alias(f"{c}_{name}"))
        xs = pairs.select("x", "share").distinct().join(grows(side("x")), "x")
        return pairs.join(grows(side("y")), "y").join(grows(xs), ["x", "share"])

    near = scratch.write(both(pairs, signatures, "signature", "sig").mapInArrow(agree, "x long, y long, share int"), "near")
    return both(near, sets, "shingles", "set").where(_alike(percent)).select(F.col("x").alias("u"), F.col("y").alias("v"))


def _signatures(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint32).reshape(len(rows), -1) if rows else np.empty((0, 1), np.uint32)


def centre_pairs(buckets: DataFrame) -> DataFrame:
    """``(x, y, share)``: each member y of ``buckets(bucket, node, m, share)`` with the centres x of its buckets, once."""
    met = buckets.groupBy("node").agg(F.sum("m").alias("met"))
    drawn = F.xxhash64("node", F.lit(1))
    firsts = F.array_distinct(F.array(F.min_by("node", F.struct(-F.col("met"), drawn, "node")), F.min_by("node", F.struct(drawn, "node"))))
    centres = buckets.join(grows(met), "node").groupBy("bucket").agg(firsts.alias("x"), F.max("m").alias("m")).select("bucket", F.explode("x").alias("x"), "m")
    centres = centres.select("bucket", "x", F.explode(F.sequence(F.lit(0), _shares(F.col("m")) - 1)).alias("share"))
    return buckets.join(grows(centres), ["bucket", "share"]).where("x != node").groupBy("x", F.col("node").alias("y")).agg(F.min("share").alias("share"))


def prefix_filter(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(node, n, w)`` of those ``members(node, comp)`` that may be alike to one of another component: set size, and how many shingles other members have, too.

    Shingles are ordered by how many members have them. Of two sets that are alike enough, each has a shared shingle among its ``n - ceil(n * percent / 100) + 1``
    first ones. Shingles of one member alone come first, so a member with more of them than that is left out, and so is one that shares its first ones with its own component only.
    """
    own = sets.join(grows(members), "node").select("node", "comp", F.size("shingles").alias("n"), "shingles")
    each = own.select("node", "comp", "n", F.explode("shingles").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("k")).where("k > 1")
    shared = each.join(grows(counts), "s").groupBy("node", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("shared"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - (F.col("n") - F.size("shared"))
    postings = shared.withColumn("first", first).where("first > 0").select("node", "comp", "n", F.size("shared").alias("w"), F.explode(F.slice("shared", F.lit(1), F.col("first"))).alias("p"))
    postings = postings.select(F.col("p.s").alias("s"), "node", "comp", "n", "w")
    mixed = postings.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("s")
    return postings.join(grows(mixed), "s", "left_semi").select("node", "n", "w").distinct()


def _block_links(percent: int, slack: float):
    """For one pair of blocks: links that connect alike members of different components, without needless ones."""
    need = percent / 100 - slack

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf["side"] == s].drop_duplicates("node").reset_index(drop=True) for s in (0, 1))
        links = []
        if len(left) and len(right):
            p, q = (np.stack([np.frombuffer(s, np.uint32) for s in side["signature"]]) for side in (left, right))
            q_sets, q_comp, q_n, q_w = list(right["shingles"]), right["comp"].to_numpy(), right["n"].to_numpy(), right["w"].to_numpy()
            parent = {c: c for c in {*left["comp"], *right["comp"]}}

            def root(c):
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            for i, (n, w, comp) in enumerate(zip(left["n"], left["w"], left["comp"], strict=True)):
                ours = np.sort(left["shingles"][i])
                # what both may have in common at most, against what they need
                may = (100 * np.minimum(q_n, n) >= percent * np.maximum(q_n, n)) & ((100 + percent) * np.minimum(q_w, w) >= percent * (q_n + n)) & (q_comp != comp)
                at = np.flatnonzero(may)
                for j in at[(q[at] == p[i]).mean(axis=1) >= need]:
                    u, v = root(comp), root(q_comp[j])
                    if u == v:
                        continue
                    both = len(np.intersect1d(ours, q_sets[j], assume_unique=True))
                    if 100 * both >= percent * (n + q_n[j] - both):
                        parent[max(u, v)] = min(u, v)
                        links.append((u, v))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def leftover_links(members: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int, slack: float) -> DataFrame:
    """Links between the components that still share a bucket of ``members(bucket, node, comp, n, w)``.

    In a bucket, members outside its largest component meet all members, in blocks of bounded size.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    total = sizes.groupBy("bucket").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("k"), F.max(F.struct("m", "comp", "n")).alias("main")).where("k > 1")
    blocks = lambda m, n: F.ceil(F.greatest(m / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    main = F.col("main")
    todo = total.select("bucket", main["comp"].alias("main"), blocks(F.col("m") - main["m"], F.col("n") - main["n"]).alias("n_odd"), blocks(F.col("m"), F.col("n")).alias("n_all"))
    at = members.join(grows(todo), "bucket").withColumn("odd", F.col("comp") != F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    facts = ["bucket", "node", "comp", "n", "w"]
    left = at.where("odd").select(*facts, F.lit(0).alias("side"), block("n_odd").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"))
    right = at.select(*facts, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("n_odd") - 1)).alias("i"), block("n_all").alias("j"))
    dealt = left.unionByName(right).join(grows(signatures.select("node", "signature")), "node").join(grows(sets), "node")
    return dealt.groupBy("bucket", "i", "j").applyInPandas(_block_links(percent, slack), "u long, v long")


def _groups(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, slack: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of ``docs(doc_id, key, text)``: a row ``(doc_id, key, n_shingles, digest)`` for each, and ``(digest, comp, first_id)`` of each class.

    A class is all rows with one shingle set; ``comp`` numbers the components of classes and ``first_id`` is the least id of a class.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near")
    # row numbers hold once they are written
    base = scratch.write(profiles(docs, shingle, bands, rows, seed).withColumn("row", F.monotonically_increasing_id()), "profiles")
    classes = scratch.write(base.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id")), "classes")
    one = base.withColumnRenamed("row", "node").join(grows(classes.select("node")), "node", "left_semi")
    members = one.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    buckets = scratch.write(members.join(grows(sizes), "bucket").select("bucket", "node", "m", _share_of(F.col("node"), _shares(F.col("m"))).alias("share")), "buckets")
    wanted = buckets.select("node").distinct()
    signatures = scratch.write(one.join(grows(wanted), "node", "left_semi").select("node", "doc_id", "digest", "signature"), "signatures")
    sets = scratch.write(set_table(docs, signatures.select("node", "doc_id", "digest"), shingle), "sets")

    pairs = scratch.write(centre_pairs(buckets), "pairs")
    found, _ = linked(verified(scratch, pairs, signatures, sets, percent, slack))

    at = buckets.join(grows(found), "node", "left").withColumn("comp", F.coalesce("component", "node"))
    # of three members and two centres, all pairs have been decided
    open_buckets = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("m").alias("m")).where("lo != hi and m > 3")
    loose = scratch.write(at.join(grows(open_buckets.select("bucket")), "bucket", "left_semi").select("bucket", "node", "comp"), "loose")
    if not loose.isEmpty():
        left = prefix_filter(loose.select("node", "comp").distinct(), sets, percent)
        more = scratch.write(loose.join(grows(left), "node").select("bucket", "node", "comp", "n", "w"), "more")
        links = leftover_links(more, signatures, sets, percent, slack)
        newer, n = linked(links)
        if n:
            moved = found.join(grows(newer.select(F.col("node").alias("component"), F.col("component").alias("to"))), "component", "left")
            found = scratch.write(moved.select("node", F.coalesce("to", "component").alias("component")).union(newer), "found")
        scratch.drop(more)
    scratch.drop(buckets, signatures, sets, pairs, loose)
    comps = classes.join(grows(found), "node", "left").select("digest", F.coalesce("component", "node").alias("comp"), "first_id")
    return base.select("doc_id", "key", "n_shingles", "digest"), comps


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    bands: int = 24, rows: int = 4, slack: float = 0.2, seed: int = 7,
) -> DataFrame:
    """Groups documents whose word-shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``: the size of its set, the least id reachable over links, and whether that is
    its own. Every link is confirmed on the full sets. A pair at exactly 0.8 shares none of 24 bands of 4 rows with a probability of 3.2e-6, and its
    signatures agree in fewer than 0.6 of 96 places with one of 3.0e-6, so 6.2e-6 of such pairs are lost at most; all others are found.

    Ids are whole numbers. Rows of one id with different texts are one node: what is linked to any of them is linked to all. A row with a null id is grouped by its
    text; its ``component_id`` is the least id of its group, null if that has none, and it is kept only in the latter case. Null, empty and blank texts have an empty
    set and are linked with nothing. Documents with equal sets are linked whatever their texts. Whole texts of any length are taken; memory follows the longest. Of ties (equal least
    ids) nothing depends. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows_of, comps = _groups(_columns(docs, id_col, text_col, F.lit(None).cast("binary")), shingle, percent, bands, rows, slack, seed)
    named = Scratch(docs.sparkSession, "groups").write(rows_of.join(grows(comps), "digest", "left"), "named")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    again = named.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    again = again.where("n > 1 and lo is not null")
    if not again.where("lo != hi").isEmpty():  # ids with several texts join their groups
        links = named.where("comp is not null").join(again.where("lo != hi"), "doc_id").select(F.col("comp").alias("u"), F.col("lo").alias("v"))
        joined, _ = linked(links)
        least = least.join(joined, F.col("comp") == F.col("node"), "left").select("comp", F.coalesce("component", "comp").alias("to"), "least")
        least = least.select("comp", "to").join(least.groupBy("to").agg(F.min("least").alias("least")), "to").select("comp", "least")
    # a row without words takes part through the other rows of its id
    own = again.join(least.withColumnRenamed("comp", "lo"), "lo").select("doc_id", F.col("least").alias("own"))
    out = named.join(grows(least), "comp", "left").join(grows(own), "doc_id", "left")
    component = F.coalesce("least", "own", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    bands: int = 24, rows: int = 4, slack: float = 0.2, seed: int = 7,
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of texts, linked as ``near_duplicates`` links them, the one with the least id.

    Here texts are linked and not ids: rows of one id with texts that aren't alike all stay. Of rows with equal id and text one stays, whatever their other columns
    hold. Null ids come last in a group; of equal ids the least MD5 sum of the text decides. Texts without words are alike to nothing and stay, but for repeats. All columns are kept,
    whatever their names. An empty table gives no rows.
    """
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.length(text_col), F.col(text_col)).cast("binary")))
    rows_of, comps = _groups(_columns(docs, id_col, text_col, key), shingle, percent, bands, rows, slack, seed)
    rows_of = rows_of.join(grows(comps.select("digest", "comp")), "digest", "left")
    kept = rows_of.where("comp is not null").groupBy("comp").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("key")).select("key")
    (k,) = fresh(docs.columns, "row_key")
    kept = kept.union(rows_of.where("comp is null").select("key")).toDF(k)
    return docs.withColumn(k, key).join(grows(kept), k, "left_semi").dropDuplicates([k]).drop(k)


def _columns(docs: DataFrame, id_col: str, text_col: str, key: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
