"""N-gram Jaccard join with Bayesian candidate pruning (operator 3).

Finds all pairs of documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

1. Documents with the same shingle set form a class; its row of least id represents it, and only representatives go on. A
   class of any size costs one row, as the classes are combined before the shuffle.
2. ``HASHES`` MinHash values of each representative are cut into bands of ``ROWS``; representatives that agree in a band
   share a bucket. Two at similarity 0.8 share none with probability (1 - 0.8^4)^32 < 5e-8. Buckets that hold the same
   representatives as another one are left out.
3. Within a bucket, MinHash values of pairs are compared ``STEP`` at a time. After m values with k equal ones the
   similarity has the posterior Beta(k + 1, m - k + 1); a pair is dropped once the probability that it reaches the
   threshold falls below ``TOLERANCE``. The pairs that are left make groups: connected components, found in the bucket
   first, of which only the least member that each one reaches goes on. So texts that are just weakly alike, as many that
   share a bucket are, don't chain into groups.
4. Within a group pairs are pruned in the same way and then verified exactly on their shingle sets; only members of groups
   have their sets made again and moved.
5. A bucket or group with many members or long texts is dealt into blocks, and each pair of blocks is a unit of work of its
   own, of bounded memory. Pairs are counted and united where they are found: a unit returns a row for each member,
   with its links and the least one that it reached, and never the pairs.
6. Components of what was reached are the classes of the result.

Shingles are known by 64-bit hashes of their words (runs outside ``[\\x20\\x09-\\x0D]``, as they are), sets by 128-bit hashes
of their shingles, rows by 128 bits of their id and text. A text of one to four words is a single shingle. A text without
words, null included, has none, and is in a class of its own without links. Rows that share an id have a class each, by
their text; a row without an id joins its class and links like any other, and a class without any id has none. Repeated
rows share a class. A very long text is held whole by the task that reads it, a small multiple of its size. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, few, in_arrow, row_key, staying, texts_of, written
from .components import components

WORDS, THRESHOLD, HASHES, ROWS, STEP, TOLERANCE = 5, 0.8, 128, 4, 16, 1e-7
#: Documents and shingles of a block, about. Survivors of a unit from which similarities are counted by matrix products.
BLOCK, SHINGLES, MANY, COLUMNS = 512, 1 << 20, 2000, 4096
_draw = np.random.default_rng(20_240_817)
FACTORS = _draw.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.split()
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    m = len(words) - n + 1
    mixed = each[:m].copy()
    for i in range(1, n):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + each[i : i + m]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, a row each."""
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        for k in range(HASHES):
            out[at:end, k] = np.minimum.reduceat(x * FACTORS[k] + SHIFTS[k], starts)
        at = end
    return out


@lru_cache
def least_equal(threshold: float, tolerance: float) -> list[int]:
    """For each number m of compared values, the fewest equal ones with which a pair stays.

    P(J >= t) under Beta(k + 1, m - k + 1) is P(Binomial(m + 1, t) <= k).
    """
    out = [0]
    for m in range(1, HASHES + 1):
        total, k = 0.0, -1
        while total < tolerance:
            k += 1
            total += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        out.append(k)
    return out


def survivors(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no comparison of sizes or MinHash values rules out."""
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    left = small >= threshold * large - 1e-9
    a, b = a[left], b[left]
    equal, need = np.zeros(len(a), dtype=np.int32), least_equal(threshold, tolerance)
    for at in range(0, HASHES, STEP):
        equal += (sigs[a, at : at + STEP] == sigs[b, at : at + STEP]).sum(axis=1, dtype=np.int32)
        left = equal >= need[at + STEP]
        a, b, equal = a[left], b[left], equal[left]
    return a, b


def common(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: one by one, or for very many pairs by products of incidence matrices."""
    if len(a) <= MANY:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows.tolist()])
    _, column, often = np.unique(np.concatenate([sets[i] for i in rows.tolist()]), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(rows), len(rows)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(rows), COLUMNS), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        total += part @ part.T
    return total[place[: len(a)], place[len(a) :]].astype(np.int64)


def unit(keys: list[bytes], blocks: np.ndarray, across: bool, sizes: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray] | None, threshold: float, tolerance: float) -> list[tuple[bytes, bytes, int]]:
    """(key, least key reached, links) of the members with links among those of one block, or of two against each other.

    ``keys`` ascend. Without ``sets`` a pair that can't be ruled out is a link.
    """
    a, b = np.triu_indices(len(keys), 1)
    if across:
        other = blocks[a] != blocks[b]
        a, b = a[other], b[other]
    a, b = survivors(a, b, sizes, sigs, threshold, tolerance)
    if not len(a):
        return []
    if sets is not None:
        both = common(a, b, sets)
        linked = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
        a, b = a[linked], b[linked]
    links = np.bincount(a, minlength=len(keys)) + np.bincount(b, minlength=len(keys))
    label = np.arange(len(keys))
    while True:  # least labels run along the links
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            break
        label = new
    return [(keys[i], keys[label[i]], int(links[i])) for i in np.flatnonzero(links).tolist()]


SETS = "doc_id long, row_key binary, key binary, n int, sig binary"
MEMBER = "key binary, n int, sig binary, place binary, blocks int, block int, sets binary"
FOUND = "key binary, other binary, links long"


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``SETS`` of every row: a 128-bit key of the shingle set (null if empty), its size, and its MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, texts = b["doc_id"].to_pylist(), b["row_key"].to_pylist(), texts_of(b["text"])
            for at in range(0, len(ids), 256):
                sets = [shingles(x) for x in texts[at : at + 256]]
                sigs = iter(signatures([s for s in sets if len(s)]))
                made = [(xxhash.xxh3_128_digest(s.tobytes()), len(s), next(sigs).tobytes()) if len(s) else (None, 0, None) for s in sets]
                yield batch([(i, r, *m) for i, r, m in zip(ids[at : at + 256], rows[at : at + 256], made, strict=True)], SETS)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text"), run, SETS)


def compared(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``FOUND``: what the units of ``members`` (``MEMBER``) find; ``place`` is the bucket or group, ``sets`` are null for buckets."""
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("place", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "block", "n", "sig", "sets")
    dealt = dealt.repartition("place", "i", "j").sortWithinPartitions("place", "i", "j", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("place", "i", "j", "key", "block", "n", "sig", "sets")
        rows = (row for b in batches for row in zip(*(b[c].to_pylist() for c in names), strict=True))
        out = []
        for (_, i, j), group in groupby(rows, key=lambda r: r[:3]):
            group = list({r[3]: r for r in group}.values())
            if len(group) > 1:
                sets = None if group[0][7] is None else [np.frombuffer(r[7], dtype=np.uint64) for r in group]
                sigs = np.frombuffer(b"".join(r[6] for r in group), dtype=np.uint32).reshape(-1, HASHES)
                out += unit([r[3] for r in group], np.array([r[4] for r in group]), i != j, np.array([r[5] for r in group]), sigs, sets, threshold, tolerance)
            if len(out) > 10_000:
                yield batch(out, FOUND)
                out = []
        yield batch(out, FOUND)

    return in_arrow(dealt, compare, FOUND)


def block_of(key: str = "key"):
    """The block of a member among ``blocks``."""
    return F.pmod(F.xxhash64(key), "blocks").cast("int").alias("block")


def candidate_groups(reps: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """(node, root): groups of representatives (key, n, sig) that may be linked."""
    band = F.explode(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1))).alias("band")
    rows = reps.select("key", "sig", band).select("key", F.xxhash64("band", F.expr(f"substring(sig, band * {4 * ROWS} + 1, {4 * ROWS})")).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")).where("size > 1")
    buckets = written(sizes.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("size") / F.lit(block)).cast("int").alias("blocks")), "buckets")
    # Only now do signatures travel, for representatives that share a bucket with another one.
    shared = written(rows.join(buckets, "bucket"), "shared")
    members = shared.join(reps.select("key", "n", "sig"), "key").select("key", "n", "sig", F.col("bucket").cast("string").cast("binary").alias("place"), "blocks", block_of(), F.lit(None).cast("binary").alias("sets"))
    return components(compared(members, threshold, tolerance).select(F.col("key").alias("a"), F.col("other").alias("b")))


def links(docs: DataFrame, reps: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, most: int = SHINGLES) -> DataFrame:
    """``FOUND`` for the representatives (key, rep_row, n, sig) that have links; a row for each unit of work."""
    groups = written(candidate_groups(reps, threshold, tolerance, block).join(reps.select(F.col("key").alias("node"), "rep_row", "n"), "node"), "groups")
    sizes = groups.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n") / F.lit(most))).cast("int").alias("blocks"))
    members = written(groups.join(sizes, "root").select(F.col("rep_row").alias("row_key"), F.col("node").alias("key"), F.col("root").alias("place"), "blocks", block_of("node")), "members")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places, blocks, own = (b[c].to_pylist() for c in ("key", "place", "blocks", "block"))
            out, size = [], 0
            for text, *rest in zip(texts_of(b["text"]), keys, places, blocks, own, strict=True):
                found = shingles(text)
                out.append((rest[0], len(found), signatures([found])[0].tobytes(), *rest[1:], found.tobytes()))
                size += len(out[-1][6])
                if size > 4 << 20:
                    yield batch(out, MEMBER)
                    out, size = [], 0
            yield batch(out, MEMBER)

    texts = docs.select(row_key().alias("row_key"), "text").join(few(members), "row_key")
    made = in_arrow(texts.select("key", "place", "blocks", "block", "text"), rebuild, MEMBER)
    if not docs.select(row_key().alias("row_key")).join(few(members), "row_key").groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        made = made.dropDuplicates(["key"])  # a row that represents its class may be repeated; combined before it is dealt
    return compared(made, threshold, tolerance)


def classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, most: int = SHINGLES) -> DataFrame:
    """doc_id, row_key, rep_id, class_id, class_row (the row of the class that stays), n_links of every row of ``docs``."""
    sets = written(shingle_sets(docs), "shingle-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row_key")).alias("first")
    reps = sets.where("key is not null").groupBy("key").agg(first, F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    reps = written(reps.select("key", "first", F.col("first.row_key").alias("rep_row"), "n", "sig"), "representatives")
    found = written(links(docs, reps, threshold, tolerance, block, most), "links")
    roots = components(found.select(F.col("key").alias("a"), F.col("other").alias("b")))
    linked = reps.select("key", "first").join(roots.withColumnRenamed("node", "key"), "key")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "root").join(found.groupBy("key").agg(F.sum("links").alias("n_links")), "key")
    # Written before it is joined to all rows, so that the join can be split where very many rows share a set.
    by_key = written(reps.select("key", "first").join(linked.select("key", "head", "n_links"), "key", "left"), "by-key")
    rows = sets.select("doc_id", "row_key", "key").join(by_key, "key", "left")
    own = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row_key")
    rows = rows.select("doc_id", "row_key", F.coalesce("first", own).alias("first"), F.coalesce("head", "first", own).alias("head"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("doc_id", "row_key", F.col("first.doc_id").alias("rep_id"), F.col("head.doc_id").alias("class_id"), F.col("head.row_key").alias("class_row"), "n_links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, most: int = SHINGLES) -> DataFrame:
    """doc_id, rep_id, class_id, n_links of every row of ``docs``.

    ``rep_id``: the least id with the same shingles. ``class_id``: the least id of all that links lead to. ``n_links``: the
    number of other shingle sets, whatever the number of their copies, that are similar enough.
    """
    return classes(docs, threshold, tolerance, block, most).drop("row_key", "class_row")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all of their columns, that represent their class; of repeated rows one stays."""
    found = classes(docs, **options).select("row_key", (F.col("row_key") == F.col("class_row")).alias("stays"))
    return staying(docs, written(found, "decisions"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
