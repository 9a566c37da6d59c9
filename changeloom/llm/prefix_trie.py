"""Prefix trie of conversations: a Cartesian tree over the LCP array of the sorted conversations (operator 13).

A node of the trie at depth d is a run of sorted conversations that share their first d turns. With lcp[p], the number of turns
that conversation p shares with the one before it, the nodes that begin at p are those of the depths lcp[p] + 1 to its
length, and each ends before the next q with lcp[q] < d, its nearest smaller value. Depths that more than one of the
different conversations share are found so; below them a conversation is alone, and its nodes are its own turns.

1. ``Turns`` are numbered and their bytes added up over parts of the order (``numbering.running``), and known by digests.
2. Conversations that are equal as a whole become one, with its members' number, least id and digest of ids.
3. They are sorted by their first ``CHUNK`` turns; those that are longer and still equal go on with the next, in rounds. A task
   compares neighbours; only the edges of the parts go through the driver (two keys of ``CHUNK`` digests for each part).
4. Positions are dealt into blocks, at most ``BLOCKS`` of them. In each, all nearest smaller values are found with a stack; nodes
   of equal LCP are one, missing depths are filled up, and members, children, leaves and saved bytes are added up from
   children to parents. What reaches over a block's edge comes out as a part: one row for each depth that neighbours on
   both sides of the edge share. The blocks' minima say where those end, and their parts are put together (``Spine``), on
   the driver: some ``BLOCKS`` times the depth shared at an edge.
5. The turns below the shared depths are added, with what follows from their place alone.

No window or group spans a conversation, a first turn or the members of a node. One conversation's turns, or the ids of
equal conversations, are a stream for what needs them in order (a digest). A stretch of turns that two different conversations
share is held by one task, some bytes for each turn, and takes a round for each ``CHUNK``.

Turns are ordered by turn, null first, equal ones by a digest of role and text. Null roles and texts are empty; rows without an id
belong to no conversation; texts of any length are read whole; repeated rows are turns of their own; other columns are ignored,
whatever their names; an empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import running
from .common import few, in_arrow, written

#: Turns that are compared in a round, and characters of a digest.
CHUNK, WIDTH = 64, 32
#: Blocks of positions at most, and the least size of one.
BLOCKS, LEAST = 20_000, 1024
#: Head turns that a rebuilt conversation takes are fewer than this; conversations that share a head.
HEADS, SIBLINGS = 9, 5
EMPTY = hashlib.sha256().hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, digest, bytes (of the text), place (from 1) and total (bytes so far) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row_no"))
    return running(slim, [F.asc_nulls_first("turn"), F.col("digest"), F.col("row_no")], ("conv_id",), total=F.col("bytes")).drop("turn", "row_no")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: their turns, as ``turns_of`` gives them, and (conv_id, length, total) of each, turnless ones too.

    The first h turns come from the conversation that begins the group of ``SIBLINGS``, where h is drawn from a checksum of the id;
    the rest are its own after its first h.
    """
    turns = written(turns_of(conversations), "turns")
    early = F.when(F.col("place") < HEADS, F.struct("place", "digest", "bytes", "total"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("own_total"), F.array_sort(F.collect_list(early)).alias("early"))
    convs = written(convs.withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int"), "first": F.col("conv_id") - F.col("conv_id") % SIBLINGS}), "conversations")
    heads = convs.select(F.col("conv_id").alias("first"), F.col("early").alias("head"))
    both = convs.join(heads, "first", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(convs.schema["early"].dataType)), F.lit(1), F.col("h")))
    bytes_to = lambda c, k: F.coalesce(F.get(F.col(c)["total"], F.least(F.size(c), k) - 1), F.lit(0))
    plan = both.select("conv_id", "h", "head", F.size("head").alias("taken"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), bytes_to("early", F.col("h")).alias("left_out"), bytes_to("head", F.col("h")).alias("head_total"), "own_total")
    plan = written(plan.withColumn("total", F.col("head_total") + F.col("own_total") - F.col("left_out")), "plan")
    own = turns.join(plan.select("conv_id", "h", "taken", "left_out", "head_total"), "conv_id").where("place > h")
    own = own.select("conv_id", "digest", "bytes", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), (F.col("total") - F.col("left_out") + F.col("head_total")).alias("total"))
    head = plan.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.digest", "x.bytes", "x.place", "x.total")
    return written(own.unionByName(head), "rebuilt"), plan.select("conv_id", "length", "total")


def _table(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    return pa.record_batch([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "), strict=True)], [x.split()[0] for x in schema.split(", ")])


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    return _table(list(zip(*rows, strict=True)) if rows else [()] * len(schema.split(", ")), schema)


DISTINCT = "rep long, length long, total long, n long, ends string"


def distinct(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``DISTINCT``: different conversations by their least id, with the number of their members and the digest of their ids."""
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "place", "digest")).alias(f"mark{k}") for k in (1, 2)]
    known = convs.join(turns.groupBy("conv_id").agg(*marks), "conv_id", "left")
    key = ["length", "mark1", "mark2"]
    together = known.repartition(*key).sortWithinPartitions(*key, "conv_id")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for b in batches:
            for conv, *mine in zip(*(b[c].to_pylist() for c in ("conv_id", *key, "total")), strict=True):
                if mine != last:
                    if last:
                        out.append((rep, last[0], last[-1], n, sha.hexdigest()))  # noqa: F821
                    last, rep, n, sha = mine, conv, 0, hashlib.sha256()
                sha.update(f"{',' * bool(n)}{conv}".encode())
                n += 1
            yield _rows(out, DISTINCT)
            out = []
        if last:
            yield _rows([(rep, last[0], last[-1], n, sha.hexdigest())], DISTINCT)

    return written(in_arrow(together.select("conv_id", *key, "total"), unite, DISTINCT), "distinct")


def shared_turns(a: str, b: str) -> int:
    """Digests that two keys have in common at their beginning."""
    if a == b:
        return len(a) // WIDTH
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * WIDTH] == b[: middle * WIDTH] else (low, middle - 1)
    return low


NEIGHBOURS = "part long, idx long, rep long, length long, tie binary, lcp long, at long, key string"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the turns shared with the row before, -1 where that is of another run; the part's edges keep their keys."""
    part, idx, last, held = TaskContext.get().partitionId(), 0, None, None
    for b in batches:
        out = []
        for at, key, rep, length, tie in zip(*(b[c].to_pylist() for c in ("at", "key", "rep", "length", "tie")), strict=True):
            lcp = None if last is None else shared_turns(last[1], key) if last[0] == at else -1
            if held:
                out.append(held if held[1] == 0 else (*held[:-1], None))
            held, last, idx = (part, idx, rep, length, tie, lcp, at, key), (at, key), idx + 1
        yield _rows(out, NEIGHBOURS)
    yield _rows([held] if held else [], NEIGHBOURS)


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (rep, length, at, key, tie) in order of run, key and length: with ``place`` from 0 and ``lcp`` with the row before.

    ``lcp`` is -1 for the first of each run ``at``. A part's edges, two rows of it, meet on the driver.
    """
    spark = rows.sparkSession
    spread = rows.repartitionByRange("at", "key", "length", "rep").sortWithinPartitions("at", "key", "length", "rep")
    found = written(in_arrow(spread.select("at", "key", "rep", "length", "tie"), _neighbours, NEIGHBOURS), "neighbours")
    before, last, bases = 0, None, []
    by_part: dict[int, list] = {}
    for r in found.where("key is not null").select("part", "idx", "at", "key").collect():
        by_part.setdefault(r.part, []).append((r.idx, r.at, r.key))
    for part in sorted(by_part):
        edges = sorted(by_part[part])
        first = edges[0]
        bases.append((part, before, shared_turns(last[2], first[2]) if last and last[1] == first[1] else -1))
        before, last = before + edges[-1][0] + 1, edges[-1]
    base = spark.createDataFrame(bases, "part long, base long, first long")  # one row for each part
    return found.join(F.broadcast(base), "part").select("rep", "length", "at", "tie", (F.col("base") + F.col("idx")).alias("place"), F.coalesce("lcp", "first").alias("lcp"))


def ordered(turns: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, pos, lcp) of different conversations: places in an order that keeps every prefix together, and turns shared with the one before."""
    mine = turns.join(reps.select("rep", "length"), F.col("conv_id") == F.col("rep"))
    chunk = F.floor((F.col("place") - 1) / CHUNK).cast("long")
    keys = mine.groupBy("rep", chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), "").alias("key"))
    keys = written(keys, "keys")
    active, done, k = reps.select("rep", "length", F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("lead")), None, 0
    while True:
        seen = CHUNK * (k + 1)
        rows = active.join(keys.where(F.col("chunk") == k).select("rep", "key"), "rep", "left").withColumn("key", F.coalesce("key", F.lit("")))
        tie = F.when(F.col("length") > seen, F.unhex(F.md5(F.concat_ws(":", F.col("at").cast("string"), "key"))))
        ranked = _ranked(rows.select("rep", "length", "at", "key", tie.alias("tie")))
        starts = ranked.groupBy(F.col("at").alias("run")).agg(F.min("place").alias("start"))
        ranked = ranked.join(starts, F.col("at") == F.col("run")).join(active.select(F.col("rep").alias("r"), "lead"), F.col("rep") == F.col("r"))
        ranked = ranked.select("rep", "length", "tie", (F.col("at") + F.col("place") - F.col("start")).alias("pos"), F.when(F.col("lcp") < 0, F.col("lead")).otherwise(F.col("lcp") + CHUNK * k).alias("lcp"))
        ranked = written(ranked, "ranked")
        tied = ranked.where("tie is not null").groupBy("tie").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at"), F.min_by("lcp", "pos").alias("lead")).where("n > 1")
        tied = written(tied.select("tie", "at", "lead"), "tied")
        if tied.isEmpty():
            now = ranked.select("rep", "pos", "lcp")
            return now if done is None else done.unionByName(now)
        now = ranked.join(tied.select("tie"), "tie", "left_anti").select("rep", "pos", "lcp")
        done = now if done is None else done.unionByName(now)
        active, k = written(ranked.join(tied, "tie").select("rep", "length", "at", "lead"), "active"), k + 1


#: What blocks give. kind 0: a node; 1: a part of a node that reaches over an edge; 2: where a conversation's own turns begin; 3: the block's least LCP.
#: ``start`` and ``parent`` are positions where a node and its parent begin, null if that is before the block.
FOUND = "kind long, block long, start long, depth long, n long, conv long, children long, leaves long, saved long, bytes long, parent long, ended boolean"
NODE, PART, HOME, MINIMUM = range(4)


class _Entry:
    """An open node on the stack."""

    __slots__ = ("bytes", "children", "conv", "ended", "leaves", "n", "saved", "start")

    def __init__(self, start: int | None, size: int, ended: bool):
        self.start, self.bytes, self.ended = start, size, ended
        self.n = self.children = self.leaves = self.saved = 0
        self.conv = None

    def add(self, n: int, conv: int | None, leaves: int, saved: int) -> None:
        self.n, self.leaves, self.saved = self.n + n, self.leaves + leaves, self.saved + saved
        self.conv = conv if self.conv is None else self.conv if conv is None else min(self.conv, conv)


class _Block:
    """The nodes of one block: a stack of the depths that are open, by nearest smaller values on both sides."""

    def __init__(self, block: int, lcp: int):
        self.block, self.out, self.least = block, [], lcp
        self.stack = [_Entry(None, 0, False) for _ in range(lcp + 1)]

    def close(self, depth: int, open_: bool = False) -> None:
        """Take nodes below ``depth`` off the stack and add them to their parents."""
        while len(self.stack) > depth + 1:
            e, d = self.stack.pop(), len(self.stack)
            whole = e.start is not None and not open_
            saved = e.saved + (e.n - 1) * e.bytes * whole
            parent = self.stack[-1] if self.stack else None
            self.out.append((NODE if whole else PART, self.block, e.start, d, e.n, e.conv, e.children, e.leaves, saved, e.bytes, parent and parent.start, e.ended))
            if parent:
                parent.add(e.n, e.conv, e.leaves, saved)

    def put(self, pos: int, lcp: int, after: int, length: int, n: int, rep: int, tail: int, sizes: list[int]) -> None:
        """The next position; ``after`` is the LCP behind it, ``sizes`` the bytes of the shared turns that begin here."""
        self.close(lcp)
        self.least = min(self.least, lcp)
        for k, size in enumerate(sizes):
            self.stack[-1].children += 1
            self.stack.append(_Entry(pos, size, lcp + 1 + k == length))
        top = self.stack[-1]
        own = length > len(self.stack) - 1
        top.children += own
        top.ended |= length == 0
        top.add(n, rep, int(after < length), tail)
        if own:
            self.out.append((HOME, self.block, pos, len(self.stack) - 1, None, None, None, None, None, None, top.start, None))
        self.last = after

    def end(self) -> None:
        """Close what ends here, and give parts of what goes on."""
        self.close(self.last)
        self.close(-1, open_=True)
        self.out.append((MINIMUM, self.block, None, self.least, *[None] * 8))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here = None
    for b in batches:
        for block, *row in zip(*(b[c].to_pylist() for c in ("block", "pos", "lcp", "after", "length", "n", "rep", "tail", "sizes")), strict=True):
            if here is None or here.block != block:
                if here:
                    here.end()
                    yield _rows(here.out, FOUND)
                here = _Block(block, row[1])
            here.put(*row)
            if len(here.out) > 10_000:
                yield _rows(here.out, FOUND)
                here.out = []
    if here:
        here.end()
        yield _rows(here.out, FOUND)


class Spine:
    """Nodes that reach over edges of blocks, put together from their parts.

    ``open`` holds the node at each depth that goes on; a block's least LCP ends all that are deeper, as the next smaller block
    minimum does in a search for nearest smaller values.
    """

    def __init__(self, rows: list):
        self.nodes = [{"start": 0, "depth": 0, "n": 0, "conv": None, "children": 0, "leaves": 0, "saved": 0, "bytes": 0, "parent": None, "ended": False}]
        self.inherited: list[tuple[int, int, int]] = []
        open_, blocks = [0], {}
        for r in rows:
            blocks.setdefault(r.block, []).append(r)
        for block in sorted(blocks):
            parts = sorted((r for r in blocks[block] if r.kind == PART), key=lambda r: r.depth)
            for r in parts:
                if r.start is None:
                    self.merge(open_[r.depth], r)
                    self.inherited.append((block, r.depth, self.nodes[open_[r.depth]]["start"]))
            del open_[1 + next(r.depth for r in blocks[block] if r.kind == MINIMUM) :]
            for r in parts:
                if r.start is not None:
                    self.nodes.append({"start": r.start, "depth": r.depth, "n": 0, "conv": None, "children": 0, "leaves": 0, "saved": 0, "bytes": r.bytes, "parent": open_[-1], "ended": False})
                    open_.append(len(self.nodes) - 1)
                    self.merge(open_[-1], r)
        more = [0] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            e = self.nodes[k]
            more[k] += (e["n"] - 1) * e["bytes"]
            e["saved"] += more[k]
            if k:
                more[e["parent"]] += more[k]

    def merge(self, k: int, r) -> None:
        e = self.nodes[k]
        for c in ("n", "children", "leaves", "saved"):
            e[c] += r[c]
        e["conv"] = r.conv if e["conv"] is None else e["conv"] if r.conv is None else min(e["conv"], r.conv)
        e["ended"] |= r.ended

    def rows(self) -> list[tuple]:
        return [(e["start"], e["depth"], e["n"], e["conv"], e["children"], e["leaves"], e["saved"], self.nodes[e["parent"]]["start"] if e["depth"] else None, e["ended"]) for e in self.nodes]


NODES = "start long, depth long, n long, conv long, children long, leaves long, saved long, parent long, ended boolean"


def trie(turns: DataFrame, convs: DataFrame, size: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, start: every node of the trie.

    ``turns`` are (conv_id, digest, bytes, place, total), ``convs`` (conv_id, length, total), as ``rebuilt`` gives them. ``start`` is
    the place of a node's first conversation among the different ones in order. ``size`` is the number of positions of a block.
    """
    spark = turns.sparkSession
    reps = distinct(turns, convs)
    many = reps.count()
    size = size or max(LEAST, -(-many // BLOCKS))
    places = written(ordered(turns, reps).withColumn("lcp", F.greatest("lcp", F.lit(0))), "places")
    behind = places.select((F.col("pos") - 1).alias("pos"), F.col("lcp").alias("after"))
    whole = reps.join(places, "rep").join(behind, "pos", "left").withColumn("after", F.coalesce("after", F.lit(-1)))
    whole = written(whole.withColumn("deep", F.greatest("lcp", "after")), "whole")
    at = turns.join(whole.where("deep > 0").select("rep", "lcp", "deep"), F.col("conv_id") == F.col("rep")).where("place <= deep and (place > lcp or place = deep)")
    begun = F.when(F.col("place") > F.col("lcp"), F.struct("place", "bytes"))
    shared = at.groupBy("rep").agg(F.array_sort(F.collect_list(begun))["bytes"].alias("sizes"), F.max("total").alias("above"))
    rows = whole.join(shared, "rep", "left").select(
        F.floor(F.col("pos") / size).cast("long").alias("block"), "pos", "lcp", "after", "length", "n", "rep",
        ((F.col("n") - 1) * (F.col("total") - F.coalesce("above", F.lit(0)))).alias("tail"), F.coalesce("sizes", F.array().cast("array<long>")).alias("sizes"),
    )
    found = written(in_arrow(rows.repartition("block").sortWithinPartitions("block", "pos"), _trees, FOUND), "found")
    if not many:
        spine, inherited = [], []
    else:
        across = Spine(found.where(F.col("kind").isin(PART, MINIMUM)).collect())
        spine, inherited = across.rows(), across.inherited
    before = few(written(spark.createDataFrame(inherited, "b long, d long, s long").coalesce(1), "inherited"))
    resolved = lambda df, depth: df.join(before, (F.col("block") == F.col("b")) & (F.col("d") == depth) & F.col("parent").isNull(), "left").withColumn("parent", F.coalesce("parent", "s")).drop("b", "d", "s")
    nodes = resolved(found.where(F.col("kind") == NODE), F.col("depth") - 1).select(*[x.split()[0] for x in NODES.split(", ")])
    nodes = written(nodes.unionByName(spark.createDataFrame(spine, NODES)), "nodes")
    by_place = nodes.select(F.col("start").alias("up"), F.col("depth").alias("up_depth"), F.col("conv").alias("parent_conv_id"))
    ends = whole.select(F.col("pos").alias("p"), "ends")
    upper = nodes.join(by_place, (F.col("parent") == F.col("up")) & (F.col("depth") - 1 == F.col("up_depth")), "left")
    upper = upper.join(ends, (F.col("start") == F.col("p")) & F.col("ended"), "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"), "start",
    )
    homes = resolved(found.where(F.col("kind") == HOME), F.col("depth"))
    homes = homes.join(by_place, (F.col("parent") == F.col("up")) & (F.col("depth") == F.col("up_depth"))).select(F.col("start").alias("p"), "parent_conv_id")
    alone = whole.where("length > deep").join(homes, F.col("pos") == F.col("p")).select("rep", "deep", "length", F.col("total").alias("all_bytes"), "n", "ends", "pos", "parent_conv_id")
    alone = written(alone, "alone")
    own = turns.join(alone, F.col("conv_id") == F.col("rep")).where("place > deep")
    lower = own.select(
        "conv_id", F.col("place").cast("long").alias("depth"), F.when(F.col("place") - 1 > F.col("deep"), F.col("rep")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("place") < F.col("length"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("all_bytes") - F.col("total") + F.col("bytes"))).alias("saved_tokens"), F.when(F.col("place") == F.col("length"), F.col("ends")).otherwise(EMPTY).alias("ends_sha256"), F.col("pos").alias("start"),
    )
    return upper.unionByName(lower)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).drop("start")
