"""Order-preserving packing of documents into token windows by dynamic programming (operator 8).

Documents lie in ascending order of id and are cut into runs of similar size by the data alone (``encode.run_starts``). A
run's documents, each followed by the end id, form one string of ids; windows of at most ``window`` ids are cut out of it, in
order and without gaps, so every id lies in exactly one piece. Cuts may fall after a document (no penalty), after a sentence
(``SENTENCE``) or, in stretches with neither, every ``STRIDE`` ids (``INSIDE``). With f[j] the least cost of all windows up to
cut c_j,

    f[j] = min over i with c_j - c_i <= window of f[i] + (window - (c_j - c_i)) + penalty[j]

and as f[i] + c_i is all that depends on i, a monotone queue of the cuts within reach gives each minimum in constant
time. Penalties are in padding ids. ``BUFFER`` windows are solved at a time: up to the cheapest cut in the last of them,
from where the next buffer goes on; so a document of any length takes no more memory than its ids. What remains at the
end of a run is cut into windows whose sizes are powers of two, which are not padded.

Null text counts as empty (the end id alone); null ids sort first; rows with equal ids are in the order of a hash of their
text, and repeated rows are packed each; other columns are ignored; an empty table gives no piece; a document longer than
a window lies in as many pieces as it needs. The result is the same however the table and the cluster are partitioned.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_arrow
from .encode import RUN_BYTES, Encoder, encoded_runs, encoder

WINDOW = 2048
#: Penalties of cuts, in padding ids, and the ids between cuts where no sentence ends.
SENTENCE, INSIDE, STRIDE = 2.0, 8.0, 32
#: Windows that are solved together.
BUFFER = 128
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(enc: Encoder) -> np.ndarray:
    """For each id whether its token ends a sentence: it ends with ``.``, ``!`` or ``?``, or holds a newline."""
    size = enc.tok.get_vocab_size()
    texts = (enc.tok.id_to_token(i) or "" for i in range(size))
    return np.fromiter((t[-1:] in (".", "!", "?") or "Ċ" in t or "\n" in t for t in texts), dtype=bool, count=size)


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cuts of a run of ids, 0 and its length included, and their penalties."""
    n = len(ids)
    penalty = np.full(n + 1, np.inf)
    penalty[0] = 0
    penalty[np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1] = SENTENCE
    penalty[doc_ends] = 0
    penalty[n] = min(penalty[n], INSIDE)
    at = np.flatnonzero(np.isfinite(penalty))
    more = (np.diff(at) - 1) // stride  # cuts to add in each gap
    first = np.repeat(np.cumsum(more) - more, more)
    penalty[np.repeat(at[:-1], more) + stride * (np.arange(len(first)) - first + 1)] = INSIDE
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def windows(cuts: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the windows of least padding and penalty that leave less than a window at the end.

    Cuts ascend from 0 and are at most ``window`` apart. What is left belongs to a window that goes on, so it costs nothing.
    """
    c, pen = cuts.tolist(), penalty.tolist()
    key, back = [0.0] * len(c), [0] * len(c)  # key: f[i] + c_i
    queue = deque([0])
    for j in range(1, len(c)):
        here = c[j]
        while here - c[queue[0]] > window:
            queue.popleft()
        back[j] = queue[0]
        mine = key[j] = key[queue[0]] + window + pen[j]  # f[j] + c_j
        while queue and key[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    out, j = [], min(range(bisect_right(c, c[-1] - window), len(c)), key=lambda j: key[j] - c[j])
    while j:
        out.append(c[j])
        j = back[j]
    return out[::-1]


def powers(n: int, window: int = WINDOW) -> list[int]:
    """Ends of windows that hold ``n`` ids without padding: whole ones, then powers of two."""
    out, at = [], 0
    while at < n:
        at += min(window, 1 << (n - at).bit_length() - 1)
        out.append(at)
    return out


def pack_run(docs: Iterator[tuple[int | None, np.ndarray]], ends: np.ndarray, base: int, window: int = WINDOW) -> Iterator[tuple]:
    """Rows of ``PIECES`` for documents in order; sequences count from ``base``."""
    held: deque[list] = deque()  # [doc_id, ids, first id not packed yet]
    size, sequence = 0, base

    def emit(stops: list[int]) -> Iterator[tuple]:
        nonlocal sequence, size
        at = 0
        for stop in stops:
            offset = 0
            while at < stop:
                doc_id, ids, first = held[0]
                n = min(stop - at, len(ids) - first)
                yield doc_id, first, n, zlib.crc32(ids[first : first + n].astype("<u4").tobytes()), len(ids), sequence, offset
                at, offset, held[0][2] = at + n, offset + n, first + n
                if held[0][2] == len(ids):
                    held.popleft()
            sequence += 1
        size -= at

    def solve() -> list[int]:
        """Ends of windows over the first ids that are held, no more than a buffer of them."""
        parts, stops, n = [], [], 0
        for _, ids, first in held:
            parts.append(ids[first : first + BUFFER * window - n])
            n += len(parts[-1])
            if first + len(parts[-1]) < len(ids):
                break
            stops.append(n)
        return windows(*cut_points(np.concatenate(parts), np.array(stops, dtype=np.int64), ends), window)

    for doc_id, ids in docs:
        held.append([doc_id, ids, 0])
        size += len(ids)
        while size >= BUFFER * window:
            yield from emit(solve())
    if held:
        yield from emit(solve())
        yield from emit(powers(size, window))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Pack all documents; see the module. Sequence ids are unique and ascend with the documents."""
    enc = encoder(tokenizer)
    ends, kind = sentence_ends(enc), f"<u{enc.width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = [x.split()[0] for x in PIECES.split(", ")], []
        rows = (row for b in batches for row in zip(b["run"].to_pylist(), b["doc_id"].to_pylist(), b["ids"], strict=True))
        for number, mine in groupby(rows, key=lambda r: r[0]):
            encoded = ((doc_id, np.frombuffer(ids.as_py(), dtype=kind)) for _, doc_id, ids in mine)
            for piece in pack_run(encoded, ends, number << 32, window):
                out.append(piece)
                if len(out) == 20_000:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                    out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return in_arrow(encoded_runs(docs, tokenizer, end_id, run_bytes), run, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
