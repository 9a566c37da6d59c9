"""Length-delimited binary records of token ids, with a separate offset index (operator 5).

File format. A data set is a folder of shards; a shard is a run of frames, one for each document:

    u64 length | u32 masked(crc32(length)) | payload | u32 masked(crc32(payload)) | 0x0A
    payload: u8 flags (1: has an id, 2: ids are 4 bytes wide, else 2) | i64 doc_id | ids

All numbers are little-endian. ``masked`` rotates a checksum right by 15 bits and adds 0xA282EAD8, so that a
checksum of data that hold checksums stays sound. Shards hold ascending ranges of ids, as do frames in a shard. The
index is a Parquet table (doc_id, shard, offset, n_bytes, n_tokens, start, ids_crc32) derived from the shards
themselves; a reader that shuffles takes offsets from it and reads single frames.

Spark's own writer commits the shards, so they can lie in any file system that Spark knows, and a lost executor
leaves no half shard. A shard holds a range of runs (``encode.encoded_runs``), the ids of some 32 MB of text, more where the text
would make more than 200,000 shards (from 6 TB of text on); a small table is cut for the cores at hand. A reader holds one shard at a time.

Null text counts as empty (its record is the end id alone); a null id is kept, flagged, and sorts first; of equal ids the one whose
text has the lesser hash comes first; repeated rows give one record each; a text of any length is one record, of 2 GB at
most; other columns are ignored, whatever their names; an empty table gives no shard and an empty index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, new_path, remove_at_end
from .encode import RUN_BYTES, encoded_runs, encoder

HEAD, TAIL, META = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq")
END = b"\n"
#: Bytes of text whose ids a shard holds, about: readers hold a shard as one row, in both processes.
SHARD_BYTES = 32 << 20
INDEX = "shard int, path string, doc_id long, offset long, n_bytes long, n_tokens long, start_in_shard long, ids_crc32 long"


def masked(data: bytes) -> int:
    """The masked checksum of ``data``."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, code: str) -> bytes:
    """One record without its last byte, which the writer of lines adds."""
    payload = META.pack((doc_id is not None) | (code == "I") << 1, doc_id or 0) + ids
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload))))


def frames(data: bytes, at: int = 0) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, n_bytes, doc_id, ids as u4) of every frame from ``at`` on; raises ValueError on any damage."""
    view = memoryview(data)
    while at < len(view):
        if at + HEAD.size > len(view):
            raise ValueError(f"cut header at {at}")
        size, check = HEAD.unpack_from(view, at)
        if masked(view[at : at + 8]) != check:
            raise ValueError(f"damaged length at {at}")
        begin, end = at + HEAD.size, at + HEAD.size + size
        if end + TAIL.size + 1 > len(view) or view[end + TAIL.size] != END[0]:
            raise ValueError(f"cut record at {at}")
        if masked(view[begin:end]) != TAIL.unpack_from(view, end)[0]:
            raise ValueError(f"damaged record at {at}")
        flags, doc_id = META.unpack_from(view, begin)
        ids = np.frombuffer(view[begin + META.size : end], dtype="<u4" if flags & 2 else "<u2").astype("<u4")
        yield at, end + TAIL.size + 1 - at, doc_id if flags & 1 else None, ids
        at = end + TAIL.size + 1


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every text, append ``end_id``, and write the shards, one for each range of runs, to ``path`` in ascending order of id."""
    code = encoder(tokenizer).code

    def to_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [frame(doc_id, ids.as_py(), code) for doc_id, ids in zip(b["doc_id"].to_pylist(), b["ids"], strict=True)]
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    framed = in_arrow(encoded_runs(docs, tokenizer, end_id, RUN_BYTES, SHARD_BYTES).select("doc_id", "ids"), to_frames, "value binary")
    # The text writer puts a row's bytes down as they are and ends each with the frame's last byte.
    framed.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "none").text(path)


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """Read all shards, check every frame, and describe it (columns of ``INDEX``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                rows, start, shard = [], 0, int(where.rsplit("/part-", 1)[1].split("-")[0])
                for at, size, doc_id, ids in frames(content.as_buffer()):
                    rows.append((shard, where, doc_id, at, size, len(ids), start, zlib.crc32(ids.tobytes())))
                    start += len(ids)
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return in_arrow(files.select("path", "content"), scan, INDEX)


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """Write the offset index of the shards at ``path`` to ``path``-index and return it, with ``start`` over all shards.

    Only one number for each shard goes through the driver.
    """
    found = scan_records(spark, path)
    found.write.parquet(f"{path}-index")
    index = spark.read.schema(INDEX).parquet(f"{path}-index")
    before, bases = 0, []
    for shard, total in index.groupBy("shard").agg(F.sum("n_tokens")).orderBy("shard").collect():
        bases.append((shard, before))
        before += total
    bases = spark.createDataFrame(bases, "shard int, base long")
    return index.join(F.broadcast(bases), "shard").select("doc_id", "shard", "path", "offset", "n_bytes", "n_tokens", (F.col("base") + F.col("start_in_shard")).alias("start"), "ids_crc32")


def read_shuffled(spark: SparkSession, path: str, seed: int, epoch: int = 0) -> DataFrame:
    """(doc_id, ids) in an order drawn from ``seed`` and ``epoch``: frames are cut out of their shards by the index."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, offsets in zip(b["content"], b["offsets"].to_pylist(), strict=True):
                shard, picked, size = content.as_buffer(), [], 0
                for last, at in enumerate(offsets, 1 - len(offsets)):
                    picked.append(next(frames(shard, at))[2:])
                    size += len(picked[-1][1])
                    if size > 1 << 20 or not last:
                        ends = np.cumsum([0, *(len(ids) for _, ids in picked)], dtype=np.int32)
                        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x for _, x in picked]).astype(np.int64)))
                        yield pa.record_batch([pa.array([d for d, _ in picked], pa.int64()), ids], ["doc_id", "ids"])
                        picked, size = [], 0

    index = spark.read.schema(INDEX).parquet(f"{path}-index")
    places = index.groupBy("path").agg(F.collect_list("offset").alias("offsets"))  # bounded by the size of a shard
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = in_arrow(files.join(places, "path"), cut, "doc_id long, ids array<long>")
    order = F.xxhash64(F.lit(seed), F.lit(epoch), "doc_id")
    return rows.repartition(F.pmod(order, F.lit(1 << 20))).sortWithinPartitions(order)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "token-records")
    for made in (path, f"{path}-index"):
        remove_at_end(spark, made)
    write_records(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return index_records(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "n_bytes")
