r"""Quotation linking: conversations ordered by replies, without their quotes.

A line's quote level is the number of `>` at its start (spaces between them allowed). Runs of lines of one level are
passages. A passage is normalised (A-Z lower-cased, everything but letters and digits dropped to single spaces) and hashed;
so is every own (level 0) passage, paragraph, line, sentence and whole message that it may repeat. A quoted passage links by
its whole if it can, else by its paragraphs, else its lines, else its sentences, to the message that has most characters of
them, in the same conversation if there is one. Each part's original is the one with the same hash: an own passage of another, earlier message of the same conversation if there is one, else of the
earliest message of any conversation with a smaller (conv_id, turn). A message replies to the original of its passage at
the lowest level, the first such in the text; deeper levels are its originals' quotes and give further links.

Replies form trees; each message carries its root, its depth and its place in the tree. A message only replies to earlier ones,
so places, in the order of (conv_id, turn), put each message behind the one that it replies to; sorting by root and place
orders conversations by replies, and nobody has to gather one. Messages without a linked quote start a tree of their own
but keep the order of their turns. Ancestors are found by doubling, in as many rounds as the logarithm of the depth, with one
row a message. Large trees are numbered over many tasks; equal rows share a place.

A quoted passage whose hash very many messages share is no hot group: originals are reduced to the first by partial minima.

Edge cases: a null text is empty; a part shorter than `least` characters after normalising links inside its conversation only;
a piece of a sentence that is no line links to nothing, but goes from the text; a row with a null conv_id or turn takes no part in links; rows that repeat (conv_id, turn) are messages of
their own, ordered by text; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import tidy
from loomgraph.operators.stats import numbered
from loomgraph.storage import dropped, materialise

_MARK = re.compile(r"[ \t]*>")
_GAP = re.compile(r"[^0-9a-z\x80-\U0010ffff]+")
LEAST = 12


def level_of(line: str) -> tuple[int, str]:
    """Quote level of a line and what stands behind its marks."""
    at = n = 0
    while m := _MARK.match(line, at):
        at, n = m.end(), n + 1
    return n, line[at:] if n else line


def passages(text: str | None) -> list[tuple[int, str]]:
    """(level, text) of each maximal run of lines of one level."""
    out: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        n, rest = level_of(line)
        if out and out[-1][0] == n:
            out[-1][1].append(rest)
        else:
            out.append((n, [rest]))
    return [(n, "\n".join(lines)) for n, lines in out]


def normalise(passage: str) -> str:
    return _GAP.sub(" ", passage.encode().lower().decode()).strip()


def key(passage: str, least: int = LEAST) -> int | None:
    """Hash of a normalised passage; None if it is too short to tell messages apart."""
    norm = normalise(passage)
    return xxhash.xxh3_64_intdigest(norm) - (1 << 63) if len(norm) >= least else None


def grains(passage: str) -> list[list[str]]:
    """The passage; its paragraphs; its lines; its sentences."""
    paragraphs = re.split(r"\n[ \t]*\n", passage)
    return [[passage], paragraphs, passage.split("\n"), [x for q in paragraphs for x in re.split(r"(?<=[.!?])\s+", q)]]


def parse(text: str | None) -> tuple[str, list[tuple[int, list[tuple[int, int, int]]]], list[int]]:
    """The text without quotes; of each quoted passage in order the level and its parts (grain, hash, characters); hashes of what others may quote."""
    ps = passages(text)
    own = [p for n, p in ps if n == 0]
    quoted = []
    for n, p in ps:
        if n:
            parts: dict[int, tuple[int, int, int]] = {}
            for grain, of in enumerate(grains(p)):
                for x in of:
                    if (k := key(x, 1)) is not None:
                        parts.setdefault(k, (grain, k, len(normalise(x))))
            if parts:
                quoted.append((n, list(parts.values())))
    said = ["\n".join(own), *[x for p in own for of in grains(p) for x in of]]
    return "\n".join(p.strip("\n") for p in own if p.strip()), quoted, sorted({k for p in said if (k := key(p, 1)) is not None})


SCHEMA = "conv_id long, turn long, copy long, role string, body string, quoted array<struct<level:int,parts:array<struct<grain:int,k:long,size:int>>>>, own array<long>"


def messages(conversations: DataFrame) -> DataFrame:
    """A row for each message: its body, quoted passages and the hashes others may quote it by. copy tells equal ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(t.as_py()) for t in b.column("text")]
            part = pa.struct([("grain", pa.int32()), ("k", pa.int64()), ("size", pa.int32())])
            rows = [[{"level": n, "parts": [dict(zip(("grain", "k", "size"), x, strict=True)) for x in parts]} for n, parts in q] for _, q, _ in got]
            quoted = pa.array(rows, pa.list_(pa.struct([("level", pa.int32()), ("parts", pa.list_(part))])))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("copy"), b.column("role"), pa.array([x for x, _, _ in got], pa.string()), quoted, pa.array([o for _, _, o in got], pa.list_(pa.int64()))], ["conv_id", "turn", "copy", "role", "body", "quoted", "own"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"), F.col("role").cast("string").alias("role"), "text")
    return rows.mapInArrow(tidy(run), SCHEMA)


def _id(prefix: str = "") -> list[str]:
    return [f"{prefix}{c}" for c in ("conv_id", "turn", "copy")]


def links(msgs: DataFrame, least: int = LEAST) -> DataFrame:
    """at (the quoting message), n (place of the passage), level, to (the original): structs (conv_id, turn, copy)."""
    able = msgs.filter("conv_id is not null and turn is not null")
    me = F.struct(*_id())
    quoted = able.filter(F.size("quoted") > 0).select(me.alias("at"), F.posexplode("quoted").alias("n", "q")).select("at", "n", "q.level", F.explode("q.parts").alias("p")).select("at", "n", "level", "p.*")
    asked = quoted.select("k").distinct()
    said = able.select(me.alias("to"), F.explode("own").alias("k")).join(asked, "k", "left_semi")
    first = said.groupBy("k").agg(F.min("to").alias("anywhere"))
    here = said.groupBy("k", F.col("to.conv_id").alias("conv_id")).agg(F.min("to").alias("here"))
    both = quoted.withColumn("conv_id", F.col("at.conv_id")).join(here, ["k", "conv_id"], "left").join(first, "k")
    before = lambda c: F.when(F.col(c) < F.col("at"), F.col(c))
    far = F.when(F.col("size") >= least, before("anywhere"))
    to = both.withColumn("to", F.coalesce(before("here"), far)).filter("to is not null")
    sums = to.groupBy("at", "n", "level", "grain", "to").agg(F.sum("size").alias("size"))
    rank = F.struct("grain", (F.col("to.conv_id") != F.col("at.conv_id")).alias("away"), (-F.col("size")).alias("size"), "to")
    return sums.groupBy("at", "n", "level").agg(F.min(rank).alias("m")).select("at", "n", "level", F.col("m.to").alias("to"))


def link(conversations: DataFrame, least: int = LEAST) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, n_linked, reply_conv, reply_turn, root_conv, root_turn, depth, place (in the tree, from 1)."""
    msgs = materialise(messages(conversations), "messages")
    found = materialise(links(msgs, least), "links")
    parent = found.groupBy("at").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "n", "to")).alias("m")).select("at", "n_linked", F.col("m.to").alias("up"))
    parent = materialise(parent, "parents")
    # doubling: of each replying message, the farthest ancestor found so far and how many steps away it is
    state = materialise(parent.select("at", "up", F.lit(1).cast("long").alias("depth")), "ancestors")
    while True:
        more = state.select(F.col("at").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        if not state.join(more, "up", "left_semi").limit(1).count():
            break
        new = state.join(more, "up", "left").select("at", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
        new = materialise(new, "ancestors")
        dropped(state)
        state = new
    tree = state.select("at", F.col("up").alias("root"), "depth").join(parent.withColumnRenamed("up", "reply"), "at")
    top = tree.select(F.col("root").alias("at")).distinct().withColumn("root", F.col("at"))
    # only messages of trees with replies are numbered, by their ids
    placed = numbered(tree.unionByName(top, allowMissingColumns=True), ["at"], ["root"], "place")
    m = msgs.withColumn("at", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.struct(*_id())))
    root = F.coalesce("root", "at")
    return m.join(placed, "at", "left").select(
        "conv_id", "turn", "role", "body", F.size("quoted").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.col("reply.conv_id").alias("reply_conv"), F.col("reply.turn").alias("reply_turn"), root["conv_id"].alias("root_conv"), root["turn"].alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.when(F.col("at").isNotNull(), F.coalesce("place", F.lit(1))).alias("place"),
    )
