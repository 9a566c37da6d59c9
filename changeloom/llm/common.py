"""What several operators share: written tables, keys of rows, and access to texts in Arrow batches."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dropped, new_path, remove_at_end, shared_dir, written  # noqa: F401  (used by the operators)

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes of an Arrow batch at most, on either side of a Python worker.
BATCH_BYTES = 4 << 20


def tidy() -> None:
    """Give memory back that Arrow's pool and the C library hold for later: workers live as long as the executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def in_arrow(df: DataFrame, f, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_BYTES``: rows may be long, and a batch is held in both processes.

    After every batch, and at the end, memory that is not used any more goes back to the system.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = df.sparkSession.conf.get(key).rstrip("b")
    if not known.isdigit() or int(known) > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one_by_one() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                del b
                tidy()

        yield from f(one_by_one())
        tidy()

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text in an Arrow column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def single_threaded() -> None:
    """Keep native libraries on the task's own core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


#: Rows of ids that are broadcast at most; 16 bytes each.
FEW_IDS = 500_000


def few(ids: DataFrame) -> DataFrame:
    """``ids``, which are a written table, with a broadcast hint if they have at most ``FEW_IDS`` rows, which is counted."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def row_key():
    """128 bits that tell rows apart by id and text; a null text counts as an empty one."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))))


def staying(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents, with all of their columns, that ``rows`` say stay.

    ``rows`` is a written table with ``row_key`` and ``stays`` of every document; of rows that repeat a key that stays, one does.
    Keys are broadcast if they are few, which is counted; else both sides are shuffled by key.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    gone = few(rows.where("not stays").select(F.col("row_key").alias(key)).distinct())
    twice = rows.where("stays").groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = written(twice.select(F.col("row_key").alias(key)), "twice")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.withColumn(key, row_key()).join(gone, key, "left_anti")
    if not twice.isEmpty():
        again = few(twice)
        once = out.join(again, key, "left_semi").dropDuplicates([key])
        out = out.join(again, key, "left_anti").unionByName(once)
    return out.select(columns)


KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of a schema (DDL, flat) as an Arrow batch."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))
