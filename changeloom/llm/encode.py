"""Exact, cached encoding with the ``tokenizers`` library.

Tokenizers that split at white space before they merge give the same ids for a text as for its pieces, one
after the other, if the cuts lie where their own splitting cuts in any case. Texts are cut, and their pieces numbered, by
Arrow's kernels; only pieces that a group of texts has not shown before go to the library, many of them in one string with a
piece between them whose ids are known. A worker keeps the ids of the pieces that it has met, the ones not met for long
going first.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import batch, dropped, in_arrow, single_threaded, texts_of, written

#: White space as the tokenizers' regular expressions know it (the Unicode property).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+$")
#: If none of these is in a text, its only white space is single spaces and newlines. The first stands for a cut.
_ODD = (b"\0", b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: Where a long text may be cut for any tokenizer that is cut at all: before the space.
_BETWEEN = re.compile(rb"[A-Za-z0-9](?= [A-Za-z0-9])")
#: Pieces that a worker keeps at most, and the longest piece that it keeps, in bytes. About 40 bytes a piece.
KEEP, LONGEST = 250_000, 48
#: Bytes of text that are encoded together; a longer text is cut, where it has a space between words.
GROUP = 2 << 20
#: Pieces that go to the library as one string.
JOINED = 500
#: Bytes of text of a run on average, the number of runs at most, and marks that are drawn for each run.
RUN_BYTES, MOST_RUNS, MARKS = 4 << 20, 200_000, 8
#: Bytes of text of which one task gets the ids.
PART_BYTES = 256 << 20
#: Stands for a missing id in the order of rows.
NO_ID = -(1 << 63)


def _words(texts: list[bytes]) -> pa.ListArray:
    """Pieces for a tokenizer whose tokens never hold white space. Case is left to the library, which composes letters first."""
    return pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))


def _runs(texts: list[bytes]) -> pa.ListArray:
    """Pieces for a byte-level tokenizer, of texts without ``_ODD``: newlines, and words with the space before them."""
    cut = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.binary()), b" ", b"\0 "), b"\n", b"\0\n\0")
    return pc.split_pattern(cut, b"\0")


def _odd_runs(texts: list[bytes]) -> pa.ListArray:
    """Pieces for a byte-level tokenizer, of any texts: each a run of white space with what follows it up to the next run."""
    return pa.array([[x.encode() for x in _PIECE.findall(text.decode())] for text in texts], pa.list_(pa.binary()))


def _whole(texts: list[bytes]) -> pa.ListArray:
    """Each text as its only piece."""
    return pa.array([[x] for x in texts], pa.list_(pa.binary()))


def kind(config: dict) -> str:
    """``runs``, ``words`` or ``whole``: the finest exact way to cut texts for the tokenizer that ``config`` (its JSON) describes."""
    before, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "runs"
    first = (before.get("pretokenizers") or [{}])[0]
    kinds = [x["type"] for x in (norm or {}).get("normalizers", [])]
    if kinds == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern", {}).get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+"):
        return "words"
    return "whole"


class Encoder:
    """Encodes texts to packed little-endian ids, ``code`` 'H' (two bytes) if the vocabulary allows, else 'I'.

    With ``literal`` the names of special tokens are text like any other (the library's ``encode_special_tokens``); without,
    they are the tokens, which is the library's default and what ``encoder`` gives.
    """

    def __init__(self, path: str, keep: int = KEEP, literal: bool = True):
        single_threaded()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = literal
        self.code = "H" if self.tok.get_vocab_size() <= 1 << 16 else "I"
        config = json.loads(self.tok.to_str())
        self.kind = kind(config)
        added = [x for x in config.get("added_tokens") or [] if not (literal and x["special"])]
        #: Texts that hold one of these are encoded whole: added tokens are matched before anything else is done.
        self.added = re.compile("|".join(re.escape(x["content"]) for x in added).encode()) if added else None
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] for x in added):
            self.kind = "whole"
        #: What stands between pieces in a string of many, and its id; None where that isn't a single one.
        self.between = {"runs": "\n", "words": " \x01 "}.get(self.kind)
        mark = self._each([self.between]) if self.between else [b""]
        self.mark = int.from_bytes(mark[0], "little") if len(mark[0]) == self.width else None
        #: Pieces that are known, the place of each one's ids in ``store``, and the group that last held it.
        self.keep, self.group = keep, 0
        self.known = pa.array([], pa.binary())
        self.starts, self.lengths, self.met = (np.zeros(0, dtype=np.int32) for _ in range(3))
        self.store = np.zeros(0, dtype=f"<u{self.width}")

    @property
    def width(self) -> int:
        """Bytes of an id."""
        return 2 if self.code == "H" else 4

    def _each(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text from the library."""
        out = []
        for at in range(0, len(texts), 20_000):
            out += [array(self.code, x.ids).tobytes() for x in self.tok.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]
        return out

    def _plain(self, pieces: pa.Array) -> np.ndarray:
        """Whether each piece may stand in a string of many: it has a word, and nothing that ``between`` could merge with or equal."""
        if self.kind == "runs":
            odd = pc.is_in(pieces, pa.array([b"", b" ", b"\n"], pa.binary()))
        else:
            odd = pc.or_(pc.equal(pc.binary_length(pieces), 0), pc.match_substring(pieces, b"\x01"))
        return ~odd.to_numpy(zero_copy_only=False)

    def _new(self, pieces: pa.Array, joined: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces from the library, many pieces at a time if ``joined``; where each one's begin, and how many there are."""
        starts, lengths = (np.zeros(len(pieces), dtype=np.int32) for _ in range(2))
        alone, parts, size = np.ones(len(pieces), dtype=bool), [], 0
        if joined and self.mark is not None:
            alone = ~self._plain(pieces)
            rows = np.flatnonzero(~alone)
            for at in range(0, len(rows), JOINED * 40):
                mine = rows[at : at + JOINED * 40]
                first = np.append(np.arange(0, len(mine), JOINED), len(mine)).astype(np.int32)
                texts = pc.binary_join(pa.ListArray.from_arrays(first, pieces.take(pa.array(mine))), self.between.encode())
                found = self.tok.encode_batch_fast([x.decode() for x in texts.to_pylist()], add_special_tokens=False)
                for k, x in enumerate(found):
                    ids, here = np.array(x.ids, dtype=self.store.dtype), mine[first[k] : first[k + 1]]
                    ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
                    if len(ends) != len(here):
                        alone[here] = True
                        continue
                    begin = np.append(0, ends[:-1] + 1)
                    starts[here], lengths[here] = size + begin, ends - begin
                    parts.append(ids)
                    size += len(ids)
        rows = np.flatnonzero(alone)
        ids = self._each([x.decode() for x in pieces.take(pa.array(rows)).to_pylist()])
        n = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // self.width
        starts[rows], lengths[rows] = size + np.cumsum(n) - n, n
        return np.concatenate([*parts, np.frombuffer(b"".join(ids), dtype=self.store.dtype)]), starts, lengths

    def _rows(self, pieces: pa.Array, joined: bool) -> np.ndarray:
        """Rows of distinct pieces among the known ones, to which those are added that aren't; the long ones come last."""
        at = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        if len(new):
            long = pc.greater(pc.binary_length(pieces), LONGEST).to_numpy(zero_copy_only=False)[new]
            new = np.concatenate([new[~long], new[long]])
            fresh = pieces.take(pa.array(new))
            ids, starts, lengths = self._new(fresh, joined)
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.starts, self.lengths = np.concatenate([self.starts, starts + len(self.store)]), np.concatenate([self.lengths, lengths])
            self.met = np.concatenate([self.met, np.zeros(len(new), dtype=np.int32)])
            self.store = np.concatenate([self.store, ids])
        self.group += 1
        self.met[at] = self.group
        return at

    def _forget(self) -> None:
        """Keep no long pieces, and half of the pieces if there are too many, those met last."""
        short = pc.less_equal(pc.binary_length(self.known), LONGEST).to_numpy(zero_copy_only=False)
        stay = np.flatnonzero(short)
        if len(stay) > self.keep:
            stay = stay[np.argsort(-self.met[stay], kind="stable")[: self.keep // 2]]
        elif len(stay) == len(self.known):
            return
        self.known = self.known.take(pa.array(stay))
        self.store, self.lengths, self.met = self._gather(stay), self.lengths[stay], self.met[stay]
        self.starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of known pieces, one after the other."""
        mine = self.lengths[rows]
        place = np.repeat(self.starts[rows] - (np.cumsum(mine, dtype=np.int32) - mine), mine)
        place += np.arange(len(place), dtype=np.int32)
        return self.store[place]

    def _flat(self, pieces: pa.ListArray, joined: bool) -> list[bytes]:
        """Packed ids of texts from their lists of pieces."""
        flat = pieces.flatten()
        numbered = (flat.cast(pa.binary()) if pa.types.is_string(flat.type) else flat).dictionary_encode()
        at, offsets = self._rows(numbered.dictionary, joined)[numbered.indices.to_numpy()], pieces.offsets.to_numpy()
        ends = np.append(0, np.cumsum(self.lengths[at], dtype=np.int64)) * self.width
        out, cuts = self._gather(at).tobytes(), ends[offsets - offsets[0]].tolist()
        self._forget()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, packed."""
        way = []
        for x in texts:
            if self.kind == "whole" or self.added is not None and self.added.search(x):
                way.append(_whole)
            elif self.kind == "words":
                way.append(_words)
            else:
                way.append(_odd_runs if any(o in x for o in _ODD) else _runs)
        out: list[bytes] = [b""] * len(texts)
        for cut in set(way):
            mine = [i for i, w in enumerate(way) if w is cut]
            if cut is _whole:
                found = self._each([texts[i].decode() for i in mine])
            else:
                found = self._flat(cut([texts[i] for i in mine]), cut is not _odd_runs)
            for i, x in zip(mine, found, strict=True):
                out[i] = x
        return out

    def spans(self, text: bytes) -> Iterator[bytes]:
        """The text in spans of about ``GROUP`` bytes that can be encoded apart."""
        at = 0
        while self.kind != "whole" and len(text) - at > GROUP and (cut := _BETWEEN.search(text, at + GROUP)):
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:] if at else text

    def stream(self, rows: Iterable[tuple[object, bytes]]) -> Iterator[tuple[object, bytes]]:
        """(key, ids) of (key, text) in order, a bounded number of bytes at a time."""
        parts: list[bytes] = []

        def flush(group: list[tuple[object, bool, bytes]]) -> Iterator[tuple[object, bytes]]:
            for (key, last, _), ids in zip(group, self.encode([x[2] for x in group]), strict=True):
                parts.append(ids)
                if last:
                    yield key, parts[0] if len(parts) == 1 else b"".join(parts)
                    parts.clear()

        group, size = [], 0
        for key, text in rows:
            spans = list(self.spans(text))
            for n, span in enumerate(spans, 1):
                group.append((key, n == len(spans), span))
                size += len(span)
                if size >= GROUP:
                    yield from flush(group)
                    group, size = [], 0
        yield from flush(group)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for the file; it lives as long as the worker, over tasks."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, literal=False)
    return _LOADED[path]


class Runs(NamedTuple):
    """Ids and hashes of the rows that begin runs, in order; bytes of all texts, and splits of the table that hold rows."""

    ids: np.ndarray
    hashes: np.ndarray
    size: int
    splits: int


def run_starts(docs: DataFrame, target: int = RUN_BYTES) -> Runs:
    """The rows that begin the runs; rows are ordered by id and hash.

    Runs depend on the rows alone, not on how they are spread. A row is marked with a probability of its text's share of
    ``target / MARKS`` bytes, by a hash, and every ``MARKS``-th mark begins a run; so runs are of similar size, whatever the
    ids. One pass over the texts writes the marks; only ``MARKS * MOST_RUNS`` of them, about, go through the driver: with more
    text the least draws stay, and runs are longer.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("split"))
    seen = Observation()
    rows = rows.observe(seen, F.sum("size").alias("size"), F.approx_count_distinct("split").alias("splits"))
    draw = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1 << 31)) / F.lit(1 << 31) / F.nullif("size", F.lit(0))
    marks = written(rows.select("doc_id", "hash", draw.alias("draw")).where(F.col("draw") < MARKS / target), "marks")
    size, splits = seen.get["size"] or 0, seen.get["splits"]
    found = marks.where(F.col("draw") < MARKS / max(target, size / MOST_RUNS)).select("doc_id", "hash").distinct().toArrow()
    dropped(marks)
    ids, hashes = (found[c].to_numpy() for c in ("doc_id", "hash"))
    order = np.lexsort([hashes, ids])[MARKS - 1 :: MARKS]
    return Runs(ids[order], hashes[order], size, splits)


def runs_of(ids: pa.Array, hashes: pa.Array, starts: Runs) -> np.ndarray:
    """The number of the run of each row; rows without an id come first."""
    here, h = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), hashes.to_numpy()
    out, right = np.searchsorted(starts.ids, here, "left"), np.searchsorted(starts.ids, here, "right")
    for i in np.flatnonzero(out < right).tolist():
        out[i] += np.searchsorted(starts.hashes[out[i] : right[i]], h[i], "right")
    return out.astype(np.int32)


ENCODED = "part int, run int, doc_id long, hash long, ids binary"


def encoded_runs(docs: DataFrame, tokenizer: str, end_id: int, target: int = RUN_BYTES, part: int = PART_BYTES) -> DataFrame:
    """``ENCODED``: the packed ids of every text with ``end_id`` after them. A partition is a range of runs, and in order of id.

    Texts are encoded where they are read; only ids, two bytes each for most vocabularies, are shuffled. If fewer splits hold rows
    than there are cores, rows are spread first: then a table is small, or badly cut. Partitions are as many as their size asks
    for (``part`` bytes of text), or the cores, but no more than there are runs; what a run holds doesn't depend on that. Rows
    with equal ids are in the order of a hash of their text, rows without one come first.
    """
    starts = run_starts(docs, target)
    cores, runs = docs.sparkSession.sparkContext.defaultParallelism, len(starts.ids) + 1
    parts = min(runs, max(-(-starts.size // part), 2 * cores))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = end_id.to_bytes(enc.width, "little")

        def rows() -> Iterator[tuple[object, bytes]]:
            for b in batches:
                run = runs_of(b["doc_id"], b["hash"], starts)
                keys = zip((run.astype(np.int64) * parts // runs).tolist(), run.tolist(), b["doc_id"].to_pylist(), b["hash"].to_pylist(), strict=True)
                yield from zip(keys, texts_of(b["text"]), strict=True)

        out, size = [], 0
        for key, ids in enc.stream(rows()):
            out.append((*key, ids + end))
            size += len(ids)
            if size > GROUP:
                yield batch(out, ENCODED)
                out, size = [], 0
        yield batch(out, ENCODED)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    if starts.splits < cores:
        slim = slim.repartition(min(runs, 4 * cores), "hash", "doc_id")
    return in_arrow(slim, encode, ENCODED).repartitionById(parts, "part").sortWithinPartitions("run", F.coalesce("doc_id", F.lit(NO_ID)), "hash")
