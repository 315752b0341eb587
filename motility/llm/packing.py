"""Packing by power-of-two decomposition: no sequence crosses documents, and none but the 2048s needs padding.

A document is cut into pieces of 2048 tokens and then the binary digits of the rest, longest first. Every piece is a
sequence of its own; sequences of one length are numbered in a row, so a batch takes equal lengths.

Tokenizing costs most. A byte-level BPE parts a text before every single space between two other characters, so each such
chunk has ids of its own; a task asks the tokenizer for chunks it has not met lately, and joins their ids. Words are parted and
numbered by Arrow and their ids laid out by NumPy, so Python handles the distinct words of a batch only.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motility.llm.common import small_batches, written
from motility.llm.numbering import md5_bucket, numbered

END = 1
#: A text is parted here without any effect on its ids: the space always belongs to what follows it.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Chunks that a task remembers at least, their longest length, and characters that are parted at a time.
MEMORY, CHUNK, STEP = 1 << 19, 48, 1 << 21


def _plain(word: str) -> bool:
    """Whether a space before this word is a place to cut, and the word, of those between spaces, is a chunk but for that space."""
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


def _name(chunk: str) -> str:
    """What a chunk is known by: its word if it is a space and a plain word, else itself behind a space, which no word has."""
    return chunk[1:] if chunk[0] == " " and _plain(chunk[1:]) and " " not in chunk[1:] else " " + chunk


def _chunk(name: str) -> str:
    """The chunk that is known by this name."""
    return name[1:] if name[0] == " " else " " + name


def parts_at_spaces(spec: dict) -> bool:
    """Whether the tokenizer of this JSON is a byte-level BPE by the usual pattern, so that chunks can be encoded one by one."""
    before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = any(" " in x["content"] or any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for x in added)
    return plain and not odd and not spec.get("normalizer") and not spec.get("truncation") and (spec.get("model") or {}).get("dropout") is None


class Encoder:
    """The ids of texts, as ``encode(text, add_special_tokens=False)`` of the tokenizer gives them: added tokens in a text have their own ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.parted = parts_at_spaces(spec)
        # chunks met lately, and those met before these
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # bytes that each id stands for; in a byte-level vocabulary a character is a byte
        names = {i: len(x) for x, i in self.tokenizer.get_vocab(with_added_tokens=False).items()} | {x["id"]: len(x["content"].encode()) for x in spec.get("added_tokens") or []}
        self.n_bytes = np.zeros(max(names) + 1, np.int64)
        self.n_bytes[list(names)] = list(names.values())

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, names: list[str]) -> None:
        """Adds the ids of the chunks of these names to those known. Plain chunks that begin with a space go to the tokenizer as one text."""
        row, rest = [], []
        for c in names:
            (row if len(c) < CHUNK and _plain(c) else rest).append(c)
        if row:
            (ids,) = self._raw([" " + " ".join(row)])
            ends = np.cumsum([len(c.encode()) + 1 for c in row])
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, "right").tolist()
            held = memoryview(ids).cast("B")
            self.known.update(zip(row, (bytes(held[4 * i : 4 * j]) for i, j in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))
        self.known.update(zip(rest, (x.tobytes() for x in self._raw([_chunk(c) for c in rest])), strict=True))

    def _found(self, names: list[str]) -> list[bytes | None]:
        """The ids of the chunks of these names, of those unknown so far too; None for a name that stands between spaces and isn't plain."""
        found = list(map(self.known.get, names))
        lost = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in lost:
            c = names[i]
            if (ids := self.older.get(c)) is not None:
                self.known[c] = found[i] = ids
            elif c[:1] == " " or _plain(c):
                new.append(i)
        if new:
            self._learn([names[i] for i in new])
            for i in new:
                found[i] = self.known[names[i]]
                if len(names[i]) >= CHUNK:
                    self.known.pop(names[i])
        return found

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        """Arrow parts the texts at spaces and numbers the words; Python sees each word of these texts once, and NumPy lays out the ids."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        found = self._found(coded.dictionary.to_pylist())
        odd = np.fromiter((x is None for x in found), bool, len(found))
        # a text with white space beside a space is parted by the rule itself; all others have one chunk with no space before it
        uneven = np.logical_or.reduceat(odd[codes], bounds[:-1]) if len(texts) else np.empty(0, bool)
        chunks = [(_CUT.split(x) if x else []) if u else [x.partition(" ")[0]] for x, u in zip(texts, uneven.tolist(), strict=True)]
        names = [[_name(c) for c in p] if u else [" " + c for c in p] for p, u in zip(chunks, uneven.tolist(), strict=True)]
        distinct = list(set().union(*names))
        heads = dict(zip(distinct, self._found(distinct), strict=True))
        empty = len(found)
        for i in np.flatnonzero(uneven).tolist():
            codes[bounds[i] : bounds[i + 1]] = empty
        codes[bounds[:-1]] = empty + 1 + np.arange(len(texts))
        found += [b"", *(b"".join([heads[c] for c in p]) for p in names)]
        ids = np.frombuffer(b"".join([x or b"" for x in found]), np.uint32)
        sizes = np.fromiter((len(x or b"") >> 2 for x in found), np.int64, len(found))
        begins = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        laid = ids[np.repeat(begins[codes] - ends + n, n) + np.arange(int(n.sum()))]
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        stops = [0, *ends[bounds[1:] - 1].tolist()]
        return [laid[i:j] for i, j in zip(stops[:-1], stops[1:], strict=True)]

    def _long(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, a bounded number of characters at a time (but for a longer chunk)."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + STEP)
            past = cut.start() if cut else len(text)
            yield self._together([text[at:past]])[0]
            at = past

    def encoded(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit numbers."""
        held: list[str] = []
        size = 0
        for text in texts:
            if not self.parted:
                yield self._raw([text])[0]
                continue
            if size + len(text) > STEP:
                yield from self._together(held)
                held, size = [], 0
            if len(text) > STEP:
                yield np.concatenate(list(self._long(text)))
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._together(held)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of n tokens: as many of length ``most`` as fit, then falling powers of two."""
    whole = n - n % most
    cut = [(s, most) for s in range(0, whole, most)]
    for bit in range(most.bit_length() - 2, -1, -1):
        if n % most >> bit & 1:
            cut.append((whole, 1 << bit))
            whole += 1 << bit
    return cut


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, most: int, with_ids: bool) -> DataFrame:
    """A row per piece of each document, with its token ids if wanted."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            source: list[int] = []
            pieces: list[np.ndarray] = []
            for i, found in enumerate(encode.encoded(text.as_py() or "" for text in batch.column(1))):
                ids = np.append(found, np.uint32(END)).astype("<u4", copy=False)
                for start, length in pieces_of(len(ids), most):
                    piece = ids[start : start + length]
                    rows.append((start, length, zlib.crc32(piece), len(ids)))
                    source.append(i)
                    if with_ids:
                        pieces.append(piece)
            cols = [batch.column(0).take(pa.array(source, pa.int64())), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))]
            if with_ids:
                ends = np.cumsum([0, *(r[1] for r in rows)]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int64), *pieces]).astype(np.int64)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(cols)])

    small_batches(docs.sparkSession)
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def public_vocabulary() -> str:
    """The JSON file of the public 50k byte-level BPE, with its added token ``<|endoftext|>``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_tokens: int = 2048, with_ids: bool = True) -> DataFrame:
    """Packs all documents into sequences of at most ``max_tokens`` (a power of two) tokens.

    Returns per piece ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` and, if asked for, its token ``ids``. A document's ids are those of
    its whole text, without special tokens added, and an end id. ``tokenizer`` is the JSON file of a tokenizer; by default the public 50k byte-level BPE. Where
    an added token of that file stands in a text it has its own id. Sequence ids are gapless from 0, longest sequences first; offset is always 0.

    A null or empty text is the end id alone. Very long texts are tokenized whole, parted a million characters at a time at places that do not change the ids; memory
    follows the longest text. Null and repeated ids are packed row by row. Pieces that tie in length, id, start, ids and document length are equal and numbered in any
    order. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    if max_tokens < 1 or max_tokens & max_tokens - 1:
        raise ValueError("max_tokens must be a power of two")
    pieces = written(tokenized_pieces(docs, id_col, text_col, tokenizer or public_vocabulary(), max_tokens, with_ids), "pieces")
    # twelve lengths times 256 buckets; the longest first
    spread = md5_bucket(*(F.col(c) for c in ("doc_id", "start", "ids_crc32")), digits=2)
    pieces = pieces.withColumn("bucket", F.concat(F.lpad((F.lit(max_tokens) - F.col("length")).cast("string"), 10, "0"), spread))
    out, _ = numbered(pieces, "bucket", ["doc_id", "start", "ids_crc32", "doc_tokens"], "sequence_id")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)


def batches(packed: DataFrame, sequences: int) -> DataFrame:
    """Adds ``batch``: the number of the batch that a sequence goes to; a batch holds sequences of one length only."""
    firsts = packed.groupBy("length").agg(F.min("sequence_id").alias("first"))  # a row per power of two
    at = F.call_function("div", F.col("sequence_id") - F.col("first"), F.lit(sequences).cast("long"))
    return packed.join(F.broadcast(firsts), "length").withColumn("batch", F.struct("length", at.alias("number"))).drop("first")
