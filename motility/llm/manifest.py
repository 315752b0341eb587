"""A Merkle manifest of a table by time-forward processing: a digest per row, a root per group, a root of all, and a proof per row.

Nodes of a tree are labelled by level and place, so every message goes to a later label. A sweep in the order of the labels sends the digest of each child to
its parent; a sweep in the reversed order sends each node's proof suffix (the siblings on the way from it to the root) to its children. Messages wait in a priority
queue ordered by label. Between blocks of BLOCK neighbouring nodes that queue is external: Spark's shuffle, sorted by group, block and place, brings messages and nodes
to a task in the order in which the sweep meets them. Inside a block, which is bounded, it is a heap. A round of shuffles climbs BLOCK_LEVELS levels, so ten billion rows take five,
and a group of any size is dealt out by its blocks. Proofs are made from suffixes where a leaf is; only one suffix a block is sent.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motility.llm.common import Scratch, quoted, small_batches

#: Children of a node.
FAN = 16
#: Levels that one round climbs, and the nodes that a block of it holds at most.
BLOCK_LEVELS = 2
BLOCK = FAN**BLOCK_LEVELS

Level = tuple[str, str]  # the siblings on the left and on the right, their digests joined


def joined_digest(*columns: Column) -> Column:
    """SHA-256, in lowercase hex, of the columns in order: each ``-`` if null, else its bytes in UTF-8, ``:``, and the value as text."""
    told = (F.coalesce(F.concat(F.octet_length(c), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns))
    return F.sha2(F.concat(*told).cast("binary"), 256)


def hashed(left: str, middle: str, right: str = "") -> str:
    return hashlib.sha256(f"{left}{middle}{right}".encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def forward(digests: Sequence[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The sweep from the leaves of a block to its root: the root's digest, and what each node was sent by its children, by label."""
    queue = [(1, i // FAN, i, d) for i, d in enumerate(digests)] if levels else []  # in order already, so it is a heap
    runs: dict[tuple[int, int], list[str]] = {}
    digest = digests[0]
    while queue:
        level, place = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, place):
            run.append(heapq.heappop(queue)[3])
        digest = hashed("", "".join(run))
        runs[level, place] = run
        if level < levels:
            heapq.heappush(queue, (level + 1, place // FAN, place, digest))
    return digest, runs


def backward(n: int, runs: dict[tuple[int, int], list[str]], levels: int, suffix: list[Level]) -> Iterator[tuple[int, list[Level]]]:
    """The sweep from the root of a block, which has the proof ``suffix``, to its n leaves: each leaf's place and proof, level by level from the leaf."""
    queue = [(-levels, 0, suffix)]
    while queue:
        level, place, proof = heapq.heappop(queue)
        if level == 0:
            yield place, proof
            continue
        run = runs[-level, place]
        for k in range(len(run)):
            heapq.heappush(queue, (level + 1, place * FAN + k, [("".join(run[:k]), "".join(run[k + 1 :])), *proof]))


def folded(leaf: str, proof: list[Level]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in proof:
        leaf = hashed(left, leaf, right)
    return leaf


def levels_of(block: int, n: int) -> int:
    """A group's only block ends where one node is left; one of several climbs all levels of its round, be it a single node."""
    return BLOCK_LEVELS if block else height(n)


def packed(proof: list[Level]) -> str:
    return ";".join(f"{left},{right}" for left, right in proof)


def unpacked(text: str) -> list[Level]:
    return [tuple(part.split(",")) for part in text.split(";")] if text else []


def numbered_in_groups(scratch: Scratch, rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Adds ``place``: 0, 1, 2 ... in each group (nulls are one) by ``order``. Groups are never gathered.

    Rows are dealt to ranges of ``(group, *order)``, sorted and counted where they lie. Only the first group of a range can have begun before it, so one number
    per range, which the driver adds up, completes the places.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, local, now = TaskContext.get().partitionId(), 0, 0, ()
        for batch in batches:
            runs, locals_ = [], []
            for g in batch.column(at).to_pylist():
                if now != (g,):
                    run, local, now = run + bool(now), 0, (g,)
                runs.append(run)
                locals_.append(local)
                local += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int64()), pa.array(locals_, pa.int64())], names=[*names, "part", "run", "local"])

    names, at = rows.columns, rows.columns.index(group)
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema)
    got = scratch.write(dealt.mapInArrow(counted, f"{fields}, part int, run long, local long"), label)
    ends = got.groupBy("part").agg(F.min_by(group, "run").alias("first"), F.max_by(group, "run").alias("last"), F.max("run").alias("runs"), F.max_by("local", F.struct("run", "local")).alias("local"))
    before, offsets = None, []
    for r in ends.orderBy("part").collect():  # a row per range
        offset = before[1] if before and before[0] == (r["first"],) else 0
        offsets.append((r["part"], offset))
        before = ((r["last"],), r["local"] + 1 + (offset if r["runs"] == 0 else 0))
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, offset long"))
    place = F.col("local") + F.when(F.col("run") == 0, F.col("offset")).otherwise(0)
    return got.join(known, "part").select(*map(quoted, names), place.alias("place"))


def _in_order(rows: DataFrame, *then: str) -> DataFrame:
    """The external queue: all of a block in one task, in the order of the sweep."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", *then)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, list[dict]]]:
    """The rows of one block after another."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if now != (row["grp"], row["block"]):
                if now:
                    yield *now, rows
                now, rows = (row["grp"], row["block"]), []
            rows.append(row)
    if now:
        yield *now, rows


def _sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _gathered(found: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    rows = []
    for row in found:
        rows.append(row)
        if len(rows) == size:
            yield _sent(rows, schema)
            rows = []
    if rows:
        yield _sent(rows, schema)


_NODE = pa.schema([("grp", pa.string()), ("place", pa.int64()), ("digest", pa.string())])
_SUFFIX = pa.schema([("grp", pa.string()), ("place", pa.int64()), ("path", pa.string()), ("subroot", pa.string())])
_LEAF = pa.schema([("key", pa.string()), ("grp", pa.string()), ("place", pa.int64()), ("digest", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("reached", pa.string()), ("path", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def climb(scratch: Scratch, nodes: DataFrame, label: str) -> list[DataFrame]:
    """Rounds of the forward sweep over ``nodes(grp, place, digest)``: the nodes themselves, then the roots of blocks, up to one root per group."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = ((g, block, forward([r["digest"] for r in rows], levels_of(block, len(rows)))[0]) for g, block, rows in _blocks(batches))
        return _gathered(roots, _NODE)

    rounds = [nodes]
    while len(rounds) == 1 or (rounds[-1].agg(F.max("place")).first()[0] or 0) > 0:
        rows = rounds[-1].select("grp", F.floor(F.col("place") / BLOCK).alias("block"), "place", "digest")
        rounds.append(scratch.write(_in_order(rows, "place").mapInArrow(up, _ddl(_NODE)), f"{label}-round"))
    return rounds


def descend(scratch: Scratch, rounds: list[DataFrame], suffixes: DataFrame, label: str, with_paths: bool = False) -> DataFrame:
    """The reversed sweep: ``suffixes(grp, place, path, subroot)`` of the last round's nodes go down to those of the first.

    Its rows may have a ``key``, which is kept, and ``seen``, a digest found at another time, which is folded in place of ``digest``. ``path`` is null unless it is asked for.
    """

    def met(last: bool):
        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _gathered(messages(batches), _LEAF if last else _SUFFIX)

        def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for g, block, (sent, *rows) in _blocks(batches):
                levels = levels_of(block, len(rows))
                _, runs = forward([r["digest"] for r in rows], levels)
                for k, proof in backward(len(rows), runs, levels, unpacked(sent["path"])):
                    row = rows[k]
                    if last:
                        siblings = hashed("", "".join(part for level in proof for part in level))
                        yield row["key"], g, row["place"], row["digest"], sent["subroot"], siblings, folded(row["seen"] or row["digest"], proof), packed(proof) if with_paths else None
                    else:
                        yield g, row["place"], packed(proof), sent["subroot"]

        return down

    nothing = F.lit(None).cast("string")
    for k in range(len(rounds) - 2, -1, -1):
        nodes = rounds[k]
        extra = [F.col(c).cast("string").alias(c) if c in nodes.columns else nothing.alias(c) for c in ("key", "seen")]
        children = nodes.select("grp", F.floor(F.col("place") / BLOCK).alias("block"), F.lit(1).alias("kind"), "place", "digest", *extra, nothing.alias("path"), nothing.alias("subroot"))
        sent = suffixes.select("grp", F.col("place").alias("block"), F.lit(0), F.lit(-1).cast("long"), nothing, nothing, nothing, "path", "subroot")
        swept = _in_order(sent.union(children).toDF(*children.columns), "kind", "place").mapInArrow(met(k == 0), _ddl(_LEAF if k == 0 else _SUFFIX))
        suffixes = swept if k == 0 else scratch.write(swept, f"{label}-suffixes")
    return suffixes


def seal(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source",
    found: Mapping[str, Column] | None = None, with_proofs: bool = False,
) -> DataFrame:
    """A manifest row per row of ``docs``: ``(id, group, place, leaf, subroot, root, proof_sha256, folded_root, verified)``.

    A leaf is ``joined_digest`` of the ``fields``. In a group leaves ascend by id (null first), then by digest; while several nodes are left, every FAN of them become the digest of their joined digests. The
    groups' roots, null first and then by the bytes of their names, become ``root`` in the same way; a lone leaf or group is its own root. ``proof_sha256`` is the digest of all siblings
    on the way from the leaf to the root. ``found`` gives fields as they are found later: ``folded_root`` is what the leaf of those leads to, and ``verified`` tells
    whether it is ``root``. ``with_proofs`` adds ``proof``: per level ``left,right``, the joined digests on each side, levels parted by ``;``.

    Null fields have a mark of their own, so null and an empty text differ; a null group is a group. Texts of any length are hashed whole. Repeated rows are leaves each, with equal digests,
    side by side. An empty table gives no rows. Columns other than the fields, id and group are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "manifest")
    at = {c: F.col(quoted(c)) for c in {*fields, id_col, group_col}}
    leaf, changed = joined_digest(*(at[c] for c in fields)), F.lit(False)
    seen = F.lit(None).cast("string")
    if found:
        later = {c: v.cast("string") for c, v in found.items()}
        for c, v in later.items():
            changed = changed | ~v.eqNullSafe(at[c].cast("string"))
        seen = F.when(changed, joined_digest(*(later.get(c, at[c]) for c in fields)))
    digests = docs.select(at[group_col].cast("string").alias("grp"), at[id_col].alias("key"), leaf.alias("digest"), seen.alias("seen"))
    digests = scratch.write(digests, "digests")
    placed = numbered_in_groups(scratch, digests, "grp", ["key", "digest", "seen"], "leaves")
    rounds = climb(scratch, placed, "leaves")
    groups = rounds[-1].select(F.lit("all").alias("one"), F.col("grp").alias("key"), "digest")
    tops = climb(scratch, numbered_in_groups(scratch, groups, "one", ["key", "digest"], "groups").withColumnRenamed("one", "grp"), "groups")
    top = tops[-1].first()
    root = top["digest"] if top else None
    start = tops[-1].select("grp", "place", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"))
    ways = descend(scratch, tops, start, "groups", with_paths=True)
    suffixes = scratch.write(ways.select(F.col("key").alias("grp"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot")), "ways")
    told = descend(scratch, rounds, suffixes, "leaves", with_proofs)
    kind = docs.schema[id_col].dataType
    out = [F.col("key").cast(kind).alias(id_col), F.col("grp").cast(docs.schema[group_col].dataType).alias(group_col), F.col("place"), F.col("digest").alias("leaf"), F.col("subroot"), F.lit(root).cast("string").alias("root")]
    out += [F.col("proof_sha256"), F.col("reached").alias("folded_root"), (F.col("reached") == F.lit(root)).alias("verified")]
    return told.select(*out, *([F.col("path").alias("proof")] if with_proofs else []))
