"""Exact statistics of whole texts, shared by the quality operators.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``, lines are split at ``\\n``. Null counts as empty, and an empty text
has zero for every statistic. Memory is a small multiple of one text's size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, texts_of

#: Counts, in order. repeat_words: words in 5-word windows found twice or more in the text.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_adjacent", "n_upper", "n_digits", "n_marks", "n_stops", "n_packed", "n_chars"]
_CLASSES = np.zeros((256, 6), dtype=np.int64)
for _k, _members in enumerate([b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?\"'()[]{}:;-_=+/\\~^@`", b".,", bytes(range(0x80, 0xC0))]):
    _CLASSES[list(_members), _k] = 1
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def repeated_words(words: list[bytes], ids: np.ndarray) -> int:
    """Words inside 5-word windows that occur at least twice. Windows are hashed first; equal hashes are compared."""
    n = len(ids) - 4
    if n < 2:
        return 0
    mixed = ids.astype(np.uint64)
    key = sum(mixed[i : i + n] * _WEIGHTS[i] for i in range(5))
    order = np.sort(key)
    twice = order[1:] == order[:-1]
    if not twice.any():
        return 0
    at = np.flatnonzero(np.isin(key, order[1:][twice]))
    windows = [tuple(words[i : i + 5]) for i in at.tolist()]
    often = Counter(windows)
    hit = np.zeros(len(ids) + 1, dtype=np.int64)
    begin = at[[often[w] > 1 for w in windows]]
    np.add.at(hit, begin, 1)
    np.add.at(hit, begin + 5, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The values of ``COUNTS`` for a text in UTF-8."""
    words = text.split()
    if not words:
        return (0,) * (len(COUNTS) - 1) + (len(text.decode()),)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    symbols, upper, digits, marks, stops, inner = (np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _CLASSES).tolist()
    lines = [x for x in text.split(b"\n") if x.strip()]
    space = len(text) - sum(map(len, words))
    n_chars = len(text) - inner
    return (
        len(words), n_chars - space, symbols, len(lines) - len(set(lines)), repeated_words(words, ids), len(lines), len(seen),
        int((ids[1:] == ids[:-1]).sum()), upper, digits, marks, stops, len(zlib.compress(text, 1)), n_chars,
    )


def features(c: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Names and values of transformed statistics, a row for each row of counts."""
    v = dict(zip(COUNTS, c.astype(np.float64).T, strict=True))
    words, chars = np.maximum(v["n_words"], 1), np.maximum(v["word_chars"], 1)
    soft = lambda x, least: np.log(x + least)
    made = {
        "log_words": np.log1p(v["n_words"]),
        "word_length": np.log1p(v["word_chars"] / words),
        "symbols": soft(v["n_symbols"] / chars, 0.002),
        "marks": soft(v["n_marks"] / chars, 0.002),
        "stops": soft(v["n_stops"] / words, 0.01),
        "upper": soft(v["n_upper"] / chars, 0.005),
        "digits": soft(v["n_digits"] / chars, 0.005),
        "distinct": v["n_distinct"] / words ** 0.9,
        "adjacent": soft(v["n_adjacent"] / words, 0.01),
        "repeats": np.sqrt(v["n_repeat_words"] / words),
        "dup_lines": np.sqrt(v["n_dup_lines"] / np.maximum(v["n_lines"], 1)),
        "line_words": np.log1p(words / np.maximum(v["n_lines"], 1)),
        "packed": np.log((v["n_packed"] + 8) / (v["n_chars"] + 8)) + 0.1 * np.log1p(v["n_chars"]),
    }
    return list(made), np.column_stack(list(made.values())) if len(c) else np.zeros((0, len(made)))


def with_counts(docs: DataFrame, then, schema: str) -> DataFrame:
    """Apply ``then(doc_ids, counts) -> arrays in the schema's order`` to the documents, a batch at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found = np.array([counts(x) for x in texts_of(b["text"])], dtype=np.int64)
            yield pa.record_batch(then(b["doc_id"], found), names)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def held_out(column: str = "doc_id"):
    """Whether the crc32 of the id as text leaves 0 modulo 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_counts(docs: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and quality of at most ``most`` labelled documents that are not held out, those of least hash.

    The bound keeps what goes through the driver small whatever the corpus; labels outside 0 and 1 are ignored. Of documents that
    repeat an id with other texts the one of the least counts is taken, whatever the partitioning.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").where(~held_out())
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    spark = docs.sparkSession
    rows = picked.collect()
    if not rows:
        return np.zeros((0, len(COUNTS))), np.zeros(0)
    chosen = F.broadcast(spark.createDataFrame(rows, "doc_id long, quality int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)])
    found = with_counts(texts, lambda ids, c: [ids, *(pa.array(x) for x in c.T)], schema).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("least")).select("doc_id", "least.*").toArrow()
    c = np.column_stack([found[x].to_numpy() for x in COUNTS]) if found.num_rows else np.zeros((0, len(COUNTS)))
    place = {d: i for i, d in enumerate(found["doc_id"].to_pylist())}
    pairs = sorted((r.doc_id, r.quality) for r in rows if r.doc_id in place)
    return c[[place[d] for d, _ in pairs]] if pairs else c[:0], np.array([q for _, q in pairs], dtype=np.float64)
