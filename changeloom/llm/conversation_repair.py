"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles (operator 11).

Initials of roles must read ``(s?(ua)+)?``. Every row is kept (0), given the role user or assistant (1) or deleted (2, and blank
rows and repeated ones must be); an empty turn of user or assistant may be inserted anywhere (5); a truncated row that stays adds 5.
Of the cheapest edits the audit, their initials in order, is the least in ASCII: D, I, K, R. A row's first fault counts: blank,
duplicate (role and text stood earlier in the conversation), truncated.

The method is layers of growing cost (``layers``): for each cost a bitset of the grammar's states at each row from which the end
is reached at that cost or less, each made of shifted lower layers by table look-ups; the first layer that holds the state
at hand gives its cost, and bits of lower layers show the least edit (``decisions``). Numpy does it for many blocks at once.

A block is at most ``BLOCK`` consecutive rows of a conversation, so a conversation of any length is dealt out: rows without texts
are sorted by range, packed to blocks, and, for conversations of several blocks, each block is summed up as a matrix of least costs
between states (parallel), the matrices are passed through from the last to the first (a stream of one small row for each
block), and each block then finds its decisions alone. What remains for one task is what its result asks for, one digest over
a whole conversation: it reads texts and decisions in order, as a stream, and holds one batch and the audit.

Rows are ordered by turn, null first; equal turns by a digest of original role and text. A null id is a conversation of its own;
null roles and texts are one space each (``damaged``); an empty role has no initial and can't be kept; a text is read whole,
however long. Rows that are repeated in full are duplicates. Other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, written

#: Rows of a block.
BLOCK = 64
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a; nothing and after a may end. What an inserted turn, or a new role, leads to.
STEP, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: What a kept row leads to from each state, by its initial: none of the three, s, u, a.
KEPT = ((-1, -1, -1, -1), (1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1))
#: Costs; the least costs from each state to the end, where no row is left.
REROLE, DELETE, INSERT, STUB = 1, 2, 5, 5
LAST = (0, 2 * INSERT, INSERT, 0)
#: Bits of a row's code beside its initial (0 to 3): it must go, it is truncated, it repeats an earlier one. ``PAD`` fills a block up.
GONE, CUT, AGAIN, PAD = 4, 8, 16, 32
FAR = 1 << 40


def _before(leads: tuple[int, ...]) -> np.ndarray:
    """For each set of states, the set of those that lead into it."""
    return np.array([sum(1 << s for s in range(4) if leads[s] >= 0 and x >> leads[s] & 1) for x in range(16)], np.uint8)


_BY_STEP = _before(STEP)
_BY_KEPT = np.array([_before(k) for k in KEPT])


def layers(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bitsets [cost + 6, row, block] of the states at each row from which the end is reached at that cost; the first six are empty.

    ``codes`` [block, row] are padded; ``ends`` [block, state] has the costs after the last row, ``FAR`` where there is no way.
    """
    many, n = codes.shape
    top = 2 * n + 2 * INSERT + int(ends[ends < FAR].max(initial=0))
    out = np.zeros((top + 7, n + 1, many), np.uint8)
    gone, pad, initial = (codes & GONE).T != 0, (codes & PAD).T != 0, (codes & 3).T
    stub = ((codes & CUT) != 0).T & ~gone
    lanes = np.arange(many)
    for c in range(6, top + 7):
        cur = out[c]
        for s in range(4):
            cur[n] |= ((ends[:, s] <= c - 6).astype(np.uint8)) << s
        for i in range(n - 1, -1, -1):
            at = np.where(stub[i], c - STUB, c)
            same, one = out[at, i + 1, lanes], out[at - REROLE, i + 1, lanes]
            stays = np.where(gone[i], 0, _BY_KEPT[initial[i], same] | _BY_STEP[one])
            cur[i] = np.where(pad[i], cur[i + 1], out[c - DELETE, i + 1] | stays | _BY_STEP[out[c - INSERT, i]] | out[c - 1, i])
        if (cur == 15).all():
            return out[: c + 1]
    return out


def costs(found: np.ndarray) -> np.ndarray:
    """Least costs [row, block, state] from layers; ``FAR`` where no layer has the state."""
    has = np.stack([(found[6:] >> s & 1).astype(bool) for s in range(4)], -1)
    return np.where(has.any(0), has.argmax(0), FAR)


def decisions(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each block and row a byte with the least edit from each state, two bits each: 0 D, 1 I, 2 K, 3 R."""
    found = layers(codes, ends)
    at, n = costs(found)[:-1] + 6, codes.shape[1]
    row, lane = np.arange(n)[:, None], np.arange(len(codes))[None, :]
    stub = np.where((codes & CUT).T != 0, STUB, 0)
    out = np.zeros((n, len(codes)), np.uint8)
    for s in range(4):
        c = np.minimum(at[..., s], len(found) - 1)
        to = np.array([k[s] for k in KEPT])[(codes & 3).T]
        keeps = (to >= 0) & ((codes & GONE).T == 0) & (found[c - stub, row + 1, lane] >> np.maximum(to, 0) & 1 != 0)
        letter = np.where(keeps, 2, 3)
        letter = np.where(found[c - INSERT, row, lane] >> STEP[s] & 1 != 0, 1, letter)
        letter = np.where(found[c - DELETE, row + 1, lane] >> s & 1 != 0, 0, letter)
        out |= letter.astype(np.uint8) << 2 * s
    return out.T


def matrix(codes: np.ndarray) -> np.ndarray:
    """Least costs [block, from, to] of passing a whole block, inserts before its rows included."""
    out = np.empty((len(codes), 4, 4), np.int64)
    for to in range(4):
        ends = np.full((len(codes), 4), FAR)
        ends[:, to] = 0
        out[:, :, to] = costs(layers(codes, ends))[0]
    return out


def _alike(blocks: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places of blocks of similar length, and their codes, padded; some megabytes of layers at most."""
    order = sorted(range(len(blocks)), key=lambda k: len(blocks[k]))
    while order:
        n = max(1, len(blocks[order[0]]))
        n = n if n <= 8 else 1 << (n - 1).bit_length()
        most = max(1, (16 << 20) // ((2 * n + 20) * (n + 1)))
        size = next((k for k, x in enumerate(order[:most]) if len(blocks[x]) > n), min(len(order), most))
        yield order[:size], np.array([list(blocks[k].ljust(n, bytes([PAD]))) for k in order[:size]], np.uint8)
        order = order[size:]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, tie: rows damaged as a checksum of their id says; ``copies`` is 0 for a dropped row."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(say("text"), ".!?", "")).otherwise(say("text"))
    tie = F.unhex(F.md5(F.concat(F.char_length(say("role")).cast("string"), F.lit(":"), say("role"), say("text"))))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(say("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"), tie.alias("tie"))


def _blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, turn, tie (of the first row), codes: rows without texts, in blocks; ``block`` grows with the order of rows."""
    role, text = F.col("role"), F.col("text")
    initial = F.when(role.startswith("s"), 1).when(role.startswith("u"), 2).when(role.startswith("a"), 3).otherwise(0)
    fault = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), GONE).when(text.rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"), CUT).otherwise(0)
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    slim = turns.where("copies > 0").select("conv_id", "turn", "tie", (initial + fault).alias("code"), digest.alias("digest"), F.monotonically_increasing_id().alias("row_no"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    slim = written(slim, "turns")  # fixes row_no; what follows reads no text
    order = ["turn", "tie", "row_no", "copy"]
    first = slim.groupBy("conv_id", "digest").agg(F.min(F.struct(*order)).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = written(first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "f.row_no", "f.copy"), "repeated").withColumnsRenamed({"row_no": "r", "copy": "k"})
    both = slim.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("r").isNotNull() & ((F.col("r") != F.col("row_no")) | (F.col("k") != F.col("copy"))) & (F.col("code").bitwiseAND(GONE) == 0)
    code = F.when(again, F.col("code").bitwiseAND(3) + (GONE | AGAIN)).otherwise(F.col("code"))
    rows = both.select("conv_id", *order, code.alias("code"))
    spread = rows.repartitionByRange(F.col("conv_id"), *order).sortWithinPartitions("conv_id", *order)
    return written(in_arrow(spread.select("conv_id", "turn", "tie", "code"), _pack, "conv_id long, block long, turn long, tie binary, codes binary"), "blocks")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, key, head, codes = TaskContext.get().partitionId() << 33, None, None, bytearray()

    def out() -> tuple:
        nonlocal number
        number += 1
        return (key, number, *head, bytes(codes))

    for b in batches:
        rows = []
        for conv, turn, tie, code in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "tie", "code")), strict=True):
            if head and (conv != key or len(codes) == BLOCK):
                rows.append(out())
                head = None
            if not head:
                key, head, codes = conv, (turn, tie), bytearray()
            codes.append(code)
        yield _table(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), ("conv_id", "block", "turn", "tie", "codes"))
    if head:
        yield _table([out()], (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), ("conv_id", "block", "turn", "tie", "codes"))


def _table(rows: list[tuple], kinds: tuple, names: tuple[str, ...]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blocks, out = b["codes"].to_pylist(), {}
        for places, codes in _alike(blocks):
            out.update(zip(places, matrix(codes).reshape(-1, 16).tolist(), strict=True))
        yield pa.record_batch([b["conv_id"], b["block"], pa.array([out[k] for k in range(len(blocks))], pa.list_(pa.int64()))], ["conv_id", "block", "matrix"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs after each block from the matrices of those behind it, which come first."""
    key, ends = (), None
    for b in batches:
        out = []
        for conv, flat in zip(b["conv_id"].to_pylist(), b["matrix"].to_pylist(), strict=True):
            if key != (conv,):
                key, ends = (conv,), LAST
            out.append(list(ends))
            ends = [min(flat[4 * s + t] + ends[t] for t in range(4)) for s in range(4)]
            least = min(ends)
            ends = [x - least for x in ends]
        yield pa.record_batch([b["conv_id"], b["block"], pa.array(out, pa.list_(pa.int64()))], ["c", "k", "ends"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blocks, out = b["codes"].to_pylist(), {}
        ends = np.array([x or LAST for x in b["ends"].to_pylist()], np.int64).reshape(-1, 4)
        for places, codes in _alike(blocks):
            for k, row in zip(places, decisions(codes, ends[places]), strict=True):
                out[k] = row[: len(blocks[k])].tobytes()
        yield pa.record_batch([b["conv_id"], b["block"], b["turn"], b["tie"], b["codes"], pa.array([out[k] for k in range(len(blocks))], pa.binary())], ["conv_id", "block", "turn", "tie", "codes", "edits"])


def _in_order(turns: DataFrame) -> DataFrame:
    """Rows with texts and, before them, the blocks that decide on them; a conversation lies in one partition, in order."""
    blocks = _blocks(turns)
    several = blocks.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
    long = blocks.join(written(several, "several"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "block", "codes")
    matrices = in_arrow(long, _matrices, "conv_id long, block long, matrix array<long>")
    back = matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    ends = written(in_arrow(back, _ends, "c long, k long, ends array<long>"), "ends")
    known = blocks.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")), "left").drop("c", "k")
    decided = in_arrow(known, _decide, "conv_id long, block long, turn long, tie binary, codes binary, edits binary")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(None).cast("long").alias("block"), "turn", "tie", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("edits"), "copies", "role", "text")
    both = rows.unionByName(decided, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie", F.asc_nulls_last("block"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, turn, role before, code, role after, text) of every edit, in order; the edit of a dropped row is empty."""
    key, state, codes, edits = None, 0, bytearray(), bytearray()

    def close() -> Iterator[tuple]:
        nonlocal state
        while state in (1, 2):
            yield (key[0], "I", None, None, 0, ROLE[state], "")
            state = STEP[state]

    for b in batches:
        for conv, turn, role, text, copies, code, edit in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "codes", "edits")), strict=True):
            if key != (conv,):
                if key:
                    yield from close()
                key, state, codes, edits = (conv,), 0, bytearray(), bytearray()
            if edit is not None:
                codes, edits = codes + code, edits + edit
                continue
            if not copies:
                yield (conv, "", turn, role, 0, None, "")
            for k in range(copies):
                while (letter := edits[k] >> 2 * state & 3) == 1:
                    yield (conv, "I", None, None, 0, ROLE[state], "")
                    state = STEP[state]
                if letter == 0:
                    yield (conv, "D", turn, role, codes[k], None, text)
                elif letter == 2:
                    yield (conv, "K", turn, role, codes[k], role, text)
                    state = KEPT[codes[k] & 3][state]
                else:
                    yield (conv, "R", turn, role, codes[k], ROLE[state], text)
                    state = STEP[state]
            del codes[:copies], edits[:copies]
    if key:
        yield from close()


EDITS = "conv_id long, place long, edit string, turn long, role_before string, role string, text string, fault string"


def fault(code: int) -> str:
    """The fault that a row's code names."""
    return "duplicate" if code & AGAIN else "blank" if code & GONE else "truncated" if code & CUT else ""


def repair(turns: DataFrame) -> DataFrame:
    """``EDITS``: the least of the cheapest edits of each conversation, in the order of ``place``.

    ``turns`` has conv_id, turn, role, text, copies and tie, as ``damaged`` makes them. Rows with a role are the repaired conversation.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split() for x in EDITS.split(", ")), strict=True)
        kinds = [pa.int64() if k == "long" else pa.string() for k in kinds]
        key, place, size, held = None, 0, 0, []
        for conv, edit, turn, before, code, after, text in _walk(batches):
            place, key = (place + 1 if key == (conv,) else 0), (conv,)
            if not edit:
                place -= 1
                continue
            held.append((conv, place, edit, turn, before, after, text, fault(code)))
            size += len(text)
            if size > 1 << 20 or len(held) == 10_000:
                yield _table(held, kinds, names)
                size, held = 0, []
        yield _table(held, kinds, names)

    return in_arrow(_in_order(turns), rows, EDITS)


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summary(turns: DataFrame) -> DataFrame:
    """``DIGEST``: one row for each conversation of ``turns``, of the same edits as ``repair``."""

    def one(key: tuple, seen: dict, audit: bytearray, sha) -> tuple:
        gaps = seen["high"] - seen["low"] + 1 - seen["turns"] if seen["turns"] else 0
        return (key[0], gaps, seen["blank"], seen["duplicate"], seen["truncated"], seen["illegal"], seen["cost"], audit.decode(), sha.hexdigest())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split() for x in DIGEST.split(", ")), strict=True)
        kinds = [pa.int64() if k == "long" else pa.string() for k in kinds]
        key, held, size = None, [], 0
        for conv, edit, turn, before, code, after, text in _walk(batches):
            if key != (conv,):
                if key:
                    held.append(one(key, seen, audit, sha))  # noqa: F821
                    size += len(audit)  # noqa: F821
                    if len(held) == 10_000 or size > 1 << 20:
                        yield _table(held, kinds, names)
                        held, size = [], 0
                key, audit, sha, lines = (conv,), bytearray(), hashlib.sha256(), 0
                seen = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0) | {"low": None, "high": None, "last": None}
            if not edit:
                continue
            audit += edit.encode()
            seen["cost"] += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit] + (STUB if edit in "KR" and code & CUT else 0)
            if after is not None:
                sha.update(f"{chr(10) * bool(lines)}{after}:{text}".encode())
                lines += 1
            if before is not None:
                if code & (GONE | CUT):
                    seen[fault(code)] += 1
                if seen["last"] is not None and seen["last"] + before[:1] not in ("su", "ua", "au"):
                    seen["illegal"] += 1
                seen["last"] = before[:1]
                if turn is not None and turn != seen["high"]:
                    seen["turns"] += 1
                    seen["low"], seen["high"] = turn if seen["low"] is None else seen["low"], turn
        if key:
            held.append(one(key, seen, audit, sha))
        yield _table(held, kinds, names)

    return in_arrow(_in_order(turns), rows, DIGEST)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and digest of the repair of every damaged conversation."""
    return summary(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
