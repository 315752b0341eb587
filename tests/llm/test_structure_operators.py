"""Collocations, language identification and the Merkle manifest against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motility.llm import collocations, language_id, manifest
from motility.llm.queries import op12_language


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves):
    """All levels, by the rule read aloud: sixteen at a time until one is left."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        low = at // 16 * 16
        out.append((level[low:at], level[at + 1 : low + 16]))
        at //= 16
    return out


def told(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


@pytest.mark.parametrize("sizes", [{"a": 700, None: 1, "é": 17, "b": 256, "c": 257, "": 16}, {"only": 4200}, {"one": 1}, {f"g{i}": 1 for i in range(300)}], ids=["several", "large", "one", "many groups"])
def test_manifest(spark, sizes):
    draw = random.Random(4)
    rows = [(draw.randrange(10**6) if draw.random() > 0.01 else None, g, draw.choice(["Text", "", None, "ÄB c"]) and f"Text {draw.randrange(50)} Ä") for g, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lower("text")).otherwise(F.col("text"))
    sealed = manifest.seal(docs.repartition(5), ("doc_id", "source", "text"), found={"text": changed}, with_proofs=True)
    got = collections.Counter((r.doc_id, r.source, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified, r.proof) for r in sealed.collect())
    groups = {}
    for i, g, text in rows:
        later = text and (text.lower() if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else text)
        leaf, seen = h(told(i, g, text)), h(told(i, g, later))
        groups.setdefault(g, []).append((i is not None, i or 0, leaf, seen if seen != leaf else "", i, seen))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([x[2] for x in sorted(groups[g], key=lambda x: x[:4])]) for g in names}
    top = tree_of([trees[g][-1][0] for g in names])
    want = collections.Counter()
    for k, g in enumerate(names):
        for at, (_, _, leaf, _, i, seen) in enumerate(sorted(groups[g], key=lambda x: x[:4])):
            proof = way(trees[g], at) + way(top, k)
            folded = seen
            for left, right in proof:
                folded = h(*left, folded, *right)
            text = ";".join(f"{''.join(left)},{''.join(right)}" for left, right in proof)
            want[i, g, leaf, trees[g][-1][0], top[-1][0], h(*(x for level in proof for side in level for x in side)), folded, folded == top[-1][0], text] += 1
    assert got == want
    assert len(rows) < 17 or {r[7] for r in want} == {True, False}


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string, root string")
    assert manifest.seal(docs).count() == 0


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            yield from ([word[:k], *rest] for rest in segmentations(word[k:], pieces))


def test_sums_over_all_segmentations():
    pieces = sorted({bytes([b]) for b in b" abc"} | {b" a", b"ab", b"abc", b"bc", b"ca", b" ab"} | {bytes([b]) for b in range(128, 256)})
    draw = np.random.default_rng(1)
    prob = draw.dirichlet(np.ones(len(pieces)), 3).T
    found = [b"abcab", b"c", "abé".encode(), b"cabcabbacab", "—".encode(), b"abc" * 21]
    scores, lettered = language_id.word_scores(language_id.Lattice(pieces), prob, found)
    assert lettered.tolist() == [True, True, True, True, False, True]
    at = {p: k for k, p in enumerate(pieces)}
    langs, counts = np.array([0, 1, 2, 1, 0, 1]), np.array([3, 1, 2, 5, 1, 0])
    want = np.zeros_like(prob)
    for w, word in enumerate(found[:4]):
        ways = list(segmentations(b" " + word, at))
        for lang in range(3):
            each = [math.prod(prob[at[p], lang] for p in way) for way in ways]
            assert scores[w, lang] == pytest.approx(math.log(sum(each)))
            if lang == langs[w]:
                for way, p in zip(ways, each, strict=True):
                    for piece in way:
                        want[at[piece], lang] += counts[w] * p / sum(each)
    assert np.allclose(language_id.expected_counts(language_id.Lattice(pieces), prob, found[:4], langs[:4], counts[:4]), want)
    assert (scores[4] == 0).all() and np.isfinite(scores[5]).all()


def test_language_of_unseen_documents(spark):
    rows = op12_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in unseen) / len(unseen) > 0.98
    assert all(0 < r.score <= 1 for r in rows)


def test_language_does_not_depend_on_labels_of_unseen_rows_or_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = language_id.fit(docs, path), language_id.fit(other.repartition(7), path)
    assert a.langs == b.langs and np.allclose(a.prob, b.prob)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- ²³ —"), (4, "Das ist nicht das Haus und die der")], "doc_id long, text string")
    got = {r.doc_id: r.language for r in a.identified(odd).collect()}
    assert [got[i].lang for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang == "de" and got[1].score == 0
    none = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")), path)
    assert {r.language.lang for r in none.identified(odd).collect()} == {"und"}


def plain_collocations(docs, size, least, top, covered):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, size + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = set()
    for lang, counts in f.items():
        candidates = {p for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p in candidates:
            a = counts[p]
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * counts[q] >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in candidates):
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out |= {(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}
    return out


@pytest.mark.parametrize(("size", "common"), [(3, 256), (3, 0), (3, 4), (4, 3), (2, 2)])
def test_collocations(spark, monkeypatch, size, common):
    monkeypatch.setattr(collocations, "COMMON", common)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 3000)
    draw = random.Random(size * 10 + common)
    vocabulary = ["of", "The", "the", "é", "Éa", "x\x00y", "a-b", "ab", "c'd", *map(str, range(12))]
    text = lambda: "".join(draw.choices(vocabulary, [9, 8, 7] + [2] * (len(vocabulary) - 3))[0] + draw.choices([" ", "\t ", ". ", "\n", ",", "  ", " "], [30, 2, 1, 1, 1, 1, 1])[0] for _ in range(draw.randrange(60)))
    docs = [(text(), draw.choice(["en", "de", None, "und"])) for _ in range(400)] + [(None, "en"), ("", "fr"), ("of the of the " * 400, "en")] + [("one of the two", "nl")] * 30
    got = collocations.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(3), size=size, least=4, top=40)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == plain_collocations(docs, size, 4, 40, 50)


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, None)], [("a b", "en")]):
        assert collocations.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_windows_stay_in_their_piece_and_text():
    part = next(collocations.words.slices(pa.array(["a b. c", "d", "", "e f g h"]), collocations._WORDS))
    known, _, lead, n = collocations.windows(part, np.zeros(4, int), 3)
    names = [*(w.decode() for w in known.to_pylist()), ""]
    assert [tuple(names[x[i]] for x in lead) for i in range(len(n))] == [("a", "b", ""), ("b", "", ""), ("c", "", ""), ("d", "", ""), ("e", "f", "g"), ("f", "g", "h"), ("g", "h", ""), ("h", "", "")]
    assert list(itertools.chain(n)) == [1] * 8
