"""Chat formatting by quotation linking.

Messages are parsed into their own text and quoted passages with their level; normalised passages, and the lines and sentences of them, are hashed and joined to the messages of
the conversation that wrote them first. A message answers the one whose passage it quotes at the lowest level, or else the message before it. The first
answer to a message continues its thread, any further one begins a new thread; threads are put out in the order of their turns, without quotes.

No step gathers a conversation: neighbours and positions are found in blocks of turns, and threads by pointer jumping over runs.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motility.llm.common import Scratch, small_batches

TURNS = 1024
_MARK = re.compile(r"[ \t]{0,3}>")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+")
_SAID = re.compile(r"(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$", re.IGNORECASE)


def quote_level(line: str) -> tuple[int, str]:
    """How many quotation marks begin the line, and what follows them."""
    level = 0
    while (mark := _MARK.match(line)) is not None:
        level, line = level + 1, line[mark.end() :]
    return level, line.strip() if level else line


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def passage_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(normalised(text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(text: str | None) -> tuple[str, list[int], list[tuple[int, int, int]]]:
    """Own text, hashes of its passages, and quoted passages as ``(level, hash, length)``.

    A passage is a run of lines of one level without a blank line, whatever their breaks; its single lines and its sentences count too, so a quote may be
    trimmed to some of them and broken anew. A line that introduces a quote ("... wrote:") belongs to the quote.
    """
    lines = [quote_level(x) for x in (text or "").split("\n")]
    quoted_next, kept = False, []
    for level, x in reversed(lines):  # from the end, so that the next line with text is known
        if level or not (quoted_next and _SAID.search(x)):
            kept.append((level, x))
        if x.strip():
            quoted_next = level > 0
    lines = kept[::-1]
    own = [x for level, x in lines if not level]
    runs: list[tuple[int, list[str]]] = []
    fresh = True
    for level, x in lines:
        if not x.strip():
            fresh = True
            continue
        if fresh or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(x)
        fresh = False
    mine, quoted = set(), []
    for level, run in runs:
        whole = " ".join(run)
        for passage in {" ".join(x.split()) for x in (whole, *run, *_SENTENCE.split(whole))}:
            if level:
                quoted.append((level, passage_hash(passage), len(passage)))
            else:
                mine.add(passage_hash(passage))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), sorted(mine), quoted


def reply_threads(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Returns ``(conv_id, place, turn, role, thread, position, parent, linked, text)``: a row per message, in reply order by ``conv_id, thread, position``.

    ``place`` counts the messages of a conversation from 0 by turn. ``thread`` is the place of the message that begins it, ``position`` counts the thread's messages from 0, ``parent``
    is the place of the message answered (null for the first), ``linked`` says whether a quote told so, and ``text`` is the message without quotes. A passage belongs to
    the earliest message of its conversation that says it itself; quotes of later or unknown messages link nothing, nor do parts of a sentence. Quote levels count: the lowest level that is found
    decides, then the longer match, then the later message.

    Every row of ``messages`` is a message. Those with equal conversation and turn are placed by a hash of role and text, then role and text; equal rows in any order. Null conversations are
    one conversation, null turns come before all others, a null text is empty. Whole texts of any length are parsed. Other columns are ignored, whatever their names. Empty tables give no rows.
    """
    small_batches(messages.sparkSession)
    scratch = Scratch(messages.sparkSession, "quotes")
    # a key that joins nulls, too
    c = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    rows = messages.select(c.alias("c"), F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"))

    @F.arrow_udf("own string, passages array<long>, quotes array<struct<level:int,hash:long,n:long>>")
    def parsed(texts: pa.Array) -> pa.Array:
        got = [parse(x.as_py()) for x in texts]
        quotes = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())]))
        columns = pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([[dict(zip(("level", "hash", "n"), q, strict=True)) for q in g[2]] for g in got], quotes)
        return pa.StructArray.from_arrays(columns, ["own", "passages", "quotes"])

    block = lambda column: F.call_function("div", F.col(column), F.lit(TURNS).cast("long"))
    order = ["turn", F.xxhash64("role", "text"), "role", "text"]
    rows = rows.withColumn("b", block("turn")).withColumn("local", F.row_number().over(Window.partitionBy("c", "b").orderBy(*order)))
    rows = scratch.write(rows.withColumn("p", parsed("text")).select("c", "conv_id", "turn", "role", "b", "local", "p.*"), "parsed")
    begins = rows.groupBy("c", "b").agg(F.count("*").alias("m"))
    begins = begins.select("c", F.coalesce("b", F.lit(-(2**62))).alias("b"), F.coalesce(F.sum("m").over(Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    placed = rows.withColumn("b", F.coalesce("b", F.lit(-(2**62)))).join(begins, ["c", "b"])
    said = scratch.write(placed.select("c", "conv_id", "turn", "role", (F.col("begin") + F.col("local") - 1).cast("long").alias("place"), F.col("own").alias("text"), "passages", "quotes"), "said")

    quotes = said.select("c", "place", F.inline("quotes"))
    wanted = quotes.select("c", "hash").distinct()
    origin = said.select("c", "place", F.explode("passages").alias("hash")).join(wanted, ["c", "hash"], "left_semi").groupBy("c", "hash").agg(F.min("place").alias("origin"))
    found = quotes.join(origin, ["c", "hash"]).where("origin < place").groupBy("c", "place", "level", "origin").agg(F.sum("n").alias("n"))
    links = found.groupBy("c", "place").agg(F.min_by("origin", F.struct("level", -F.col("n"), -F.col("origin"))).alias("quoted"))

    # places are gapless, so the message before is known without a window
    nodes = said.select("c", "place", block("place").alias("b")).join(links, ["c", "place"], "left")
    nodes = nodes.withColumn("parent", F.coalesce("quoted", F.when(F.col("place") > 0, F.col("place") - 1)))
    first = nodes.where("parent is not null").groupBy("c", "parent").agg(F.min("place").alias("place"), F.lit(True).alias("goes_on"))
    nodes = nodes.join(first.drop("parent"), ["c", "place"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    # runs of messages that each go on from the one before, within a block
    goes = F.col("goes_on") & (F.col("parent") == F.col("place") - 1) & (F.col("place") % TURNS != 0)
    run = F.sum(F.when(goes, 0).otherwise(1)).over(Window.partitionBy("c", "b").orderBy("place"))
    nodes = nodes.withColumn("run", run).withColumn("head", F.min("place").over(Window.partitionBy("c", "b", "run")))
    nodes = scratch.write(nodes.select("c", "place", "b", "parent", "goes_on", F.col("quoted").isNotNull().alias("linked"), "head"), "nodes")

    heads = nodes.where("place = head").select("c", F.col("place").alias("head"), F.when(F.col("goes_on"), F.col("parent")).alias("place"))
    to = heads.where("place is not null").join(nodes.select("c", "place", F.col("head").alias("to")), ["c", "place"]).select("c", "head", "to")
    to = scratch.write(to, "links")
    while not to.isEmpty():
        far = to.select("c", F.col("head").alias("to"), F.col("to").alias("far"))
        ahead = scratch.write(to.join(far, ["c", "to"], "left").select("c", "head", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "links")
        to = ahead.drop("moved")
        if ahead.where("moved").isEmpty():
            break
    nodes = nodes.join(to, ["c", "head"], "left").withColumn("thread", F.coalesce("to", "head"))
    sizes = nodes.groupBy("c", "thread", "b").agg(F.count("*").alias("n"))
    sizes = sizes.select("c", "thread", "b", F.coalesce(F.sum("n").over(Window.partitionBy("c", "thread").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    local = F.row_number().over(Window.partitionBy("c", "thread", "b").orderBy("place"))
    threads = nodes.withColumn("local", local).join(sizes, ["c", "thread", "b"]).select("c", "place", "thread", (F.col("begin") + F.col("local") - 1).cast("long").alias("position"), "parent", "linked")
    out = threads.join(said.select("c", "place", "conv_id", "turn", "role", "text"), ["c", "place"])
    return out.select("conv_id", "place", "turn", "role", "thread", "position", "parent", "linked", "text")
