r"""Exact deduplication by composable polynomial fingerprints (operator 2).

Two texts are equal if the same bytes remain once every byte of ``[\x20\x09-\x0D]`` is deleted. What remains, b_0 ...
b_{n-1}, has the fingerprint sum b_i * P^(n-1-i) modulo two primes. Fingerprints compose: that of two strings on end is
the first one's, shifted by the other's length, plus the other's. So a text is hashed in chunks, each on its own. Texts of
more than ``huge`` bytes are cut into spans that go to other tasks, whose hashes are added up in any order with the power
for their distance to the end; their text is never needed in one place again.

Texts with equal fingerprint and length are candidates only. Each is compared with its group's leader chunk by chunk:
chunks travel as rows, keyed by group, chunk number and a salt that grows with the group, and the leader's chunks are
repeated once for each salt. A group of any size is thus spread over tasks, and no task holds more than a chunk of each
of two texts. Texts that differ from their leader, which needs a collision of both primes, form groups of their own in a
further round, until none is left.

Of equal texts the row with the most code points in the original text stays, then the smallest id. Null text counts as
empty, and all empty texts are equal. A null id sorts last. Of rows that repeat both id and text one stays; those that share
an id alone are told apart, by 128 bits of a hash of both. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, few, in_arrow, row_key, staying, texts_of, written

#: Two primes below 2^31 and a base for each.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353)
SPACE = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 16
#: Texts with more bytes than this are fingerprinted in spans by several tasks.
HUGE = 8 << 20
#: Rows of a group that share a salt.
SALTED = 64


class Fingerprint:
    """Fingerprints modulo the given primes, chunk by chunk."""

    def __init__(self, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES, chunk: int = CHUNK):
        self.primes, self.bases, self.chunk, self.tables = primes, bases, chunk, []
        for p, b in zip(primes, bases, strict=True):
            table = [1] * chunk
            for i in range(1, chunk):
                table[i] = table[i - 1] * b % p
            self.tables.append(np.array(table[::-1], dtype=np.uint64))

    def shift(self, value: int, k: int, length: int) -> int:
        """What a fingerprint counts for with ``length`` bytes after it."""
        return value * pow(self.bases[k], length, self.primes[k]) % self.primes[k]

    def of(self, data: bytes) -> tuple[int, int]:
        """The fingerprint of ``data``: chunk hashes, combined by their lengths."""
        raw, out = np.frombuffer(data, dtype=np.uint8), [0, 0]
        for at in range(0, len(raw), self.chunk):
            part = raw[at : at + self.chunk].astype(np.uint64)
            for k in (0, 1):
                mine = int(part @ self.tables[k][self.chunk - len(part) :]) % self.primes[k]
                out[k] = (self.shift(out[k], k, len(part)) + mine) % self.primes[k]
        return out[0], out[1]


_MADE: dict[tuple, Fingerprint] = {}


def fingerprint(primes: tuple[int, int]) -> Fingerprint:
    """This process's tables for the primes."""
    if primes not in _MADE:
        _MADE[primes] = Fingerprint(primes)
    return _MADE[primes]


KEY = "doc_id long, row_key binary, row long"
FACTS = f"{KEY}, fp0 long, fp1 long, n_bytes long, n_points long, text_sha256 string"
SPANS = f"{FACTS}, span binary, after long"
PARTS = "row_key binary, keep_key binary, salt int, no int, part binary"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text): the key tells rows apart that share an id, and stands for a missing one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")


def fingerprints(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE) -> DataFrame:
    """One row of ``FACTS`` for each row: fingerprint, bytes left, code points of the original, and SHA-256."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = fingerprint(primes)
        for b in batches:
            rows = []
            for doc_id, key, row, text in zip(b["doc_id"].to_pylist(), b["row_key"].to_pylist(), b["row"].to_pylist(), texts_of(b["text"]), strict=True):
                left = text.translate(None, SPACE)
                points = len(text) if text.isascii() else len(text.decode())
                sha = hashlib.sha256(left).hexdigest()
                if len(left) <= huge:
                    rows.append((doc_id, key, row, *make.of(left), len(left), points, sha, None, 0))
                    continue
                for at in range(0, len(left), CHUNK):
                    part = left[at : at + CHUNK]
                    rows.append((doc_id, key, row, 0, 0, len(left), points, sha, part, len(left) - at - len(part)))
            yield batch(rows, SPANS)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, names = fingerprint(primes), [x.split()[0] for x in SPANS.split(", ")]
        for b in batches:
            rows = []
            for row in zip(*(b[x].to_pylist() for x in names), strict=True):
                found = make.of(row[8])
                rows.append((*row[:3], *(make.shift(found[k], k, row[9]) for k in (0, 1)), *row[5:8], None, row[9]))
            yield batch(rows, SPANS)

    # The number of a row tells repeated rows apart; it is written down with the facts, and so stays the same.
    raw = written(in_arrow(keyed(docs).withColumn("row", F.monotonically_increasing_id()), facts, SPANS), "fingerprints")
    cut = in_arrow(raw.where("span is not null").repartition(F.xxhash64("row", "after")), spans, SPANS)
    cut = cut.groupBy("doc_id", "row_key", "row", "n_bytes", "n_points", "text_sha256").agg(*[F.pmod(F.sum(f"fp{k}"), F.lit(primes[k])).alias(f"fp{k}") for k in (0, 1)])
    names = [x.split()[0] for x in FACTS.split(", ")]
    return raw.where("span is null").select(names).unionByName(cut.select(names))


GROUP = ["fp0", "fp1", "n_bytes", "level"]


def leaders(rows: DataFrame) -> DataFrame:
    """The row of each group that stays, and the group's size."""
    best = F.min(F.struct((-F.col("n_points")).alias("fewest"), F.col("doc_id").isNull().alias("lost"), "doc_id", "row_key", "row")).alias("best")
    found = rows.groupBy(*GROUP).agg(best, F.count(F.lit(1)).alias("group_size"))
    return found.select(*GROUP, F.col("best.doc_id").alias("keep_id"), F.col("best.row_key").alias("keep_key"), F.col("best.row").alias("keep_row"), "group_size")


def parts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The chunks (``PARTS``) of the normalised texts of ``rows`` (row_key, keep_key, salt), read from ``docs`` again.

    ``rows`` hold a key once, so repeated rows of ``docs`` give their chunks once each. The rows are broadcast if they are few, which is counted; else both sides are shuffled.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for key, keep, salt, text in zip(b["row_key"].to_pylist(), b["keep_key"].to_pylist(), b["salt"].to_pylist(), texts_of(b["text"]), strict=True):
                left = text.translate(None, SPACE)
                for no, at in enumerate(range(0, len(left), CHUNK)):
                    out.append((key, keep, salt, no, left[at : at + CHUNK]))
                    size += len(out[-1][4])
                    if size > 8 << 20:
                        yield batch(out, PARTS)
                        out, size = [], 0
            yield batch(out, PARTS)

    return in_arrow(keyed(docs).join(few(rows), "row_key").select("row_key", "keep_key", "salt", "text"), cut, PARTS)


def decisions(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE, salted: int = SALTED) -> DataFrame:
    """doc_id, row_key, keep_id, keep_key, group_size, kept, text_sha256 for each row of ``docs``."""
    rest = fingerprints(docs, primes, huge).withColumn("level", F.lit(0))
    settled, level = [], 0
    while True:
        # Written before it is joined, so that both sides of the join are plain shuffles, which the engine can split.
        lead = written(leaders(rest), "leaders")
        groups = lead.where("group_size > 1 and n_bytes > 0").withColumn("salts", F.ceil(F.col("group_size") / F.lit(salted)).cast("int"))
        members = rest.join(groups, GROUP).where("row_key != keep_key")
        members = written(members.select("row_key", "keep_key", F.pmod(F.xxhash64("row_key"), "salts").cast("int").alias("salt")).distinct(), "members")
        theirs = parts(docs, members)
        ours = parts(docs, written(members.groupBy("keep_key").agg((F.max("salt") + 1).alias("salt")).select(F.col("keep_key").alias("row_key"), "keep_key", "salt"), "compared"))
        # A leader may be repeated in the documents; its chunks are combined before they are dealt to the salts.
        ours = ours.groupBy("keep_key", "no").agg(F.any_value("salt").alias("salt"), F.any_value("part").alias("other"))
        ours = ours.select("keep_key", "no", F.explode(F.sequence(F.lit(0), F.col("salt") - 1)).alias("salt"), "other")
        both = theirs.join(ours, ["keep_key", "salt", "no"], "left")
        unequal = written(both.where(~F.col("part").eqNullSafe(F.col("other"))).select("row_key").distinct(), "unequal")
        if unequal.isEmpty():
            settled.append((rest, lead))
            break
        level += 1
        alone = rest.join(unequal, "row_key", "left_anti")
        settled.append((alone, written(leaders(alone), "leaders")))
        rest = written(rest.join(unequal, "row_key", "left_semi").withColumn("level", F.lit(level)), "collided")
    out = None
    for rows, lead in settled:
        found = rows.join(lead, GROUP)
        found = found.select("doc_id", "row_key", "keep_id", "keep_key", "group_size", ((F.col("row_key") == F.col("keep_key")) & (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")
        out = found if out is None else out.unionByName(found)
    return out


def exact_duplicates(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE, salted: int = SALTED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    return decisions(docs, primes, huge, salted).drop("row_key", "keep_key")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, with all of their columns, that stay; of rows that repeat id and text one stays."""
    return staying(docs, written(decisions(docs).select("row_key", (F.col("row_key") == F.col("keep_key")).alias("stays")), "decisions"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every document."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as left_ from documents),
w as (select *, first_value(doc_id) over (partition by left_ order by length(text) desc, doc_id) as keep_id, count(*) over (partition by left_) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(left_) as text_sha256 from w
"""
