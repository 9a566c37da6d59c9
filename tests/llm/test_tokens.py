"""Encoding, token records and packing against brute force and round trips."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from changeloom.llm import encode as E
from changeloom.llm import packing as K
from changeloom.llm import token_records as R
from changeloom.llm.encode import Encoder, encoder

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ROWS = [(3, "Hello  world.\n\n\n It's 5 o'clock"), (1, None), (2, ""), (3, "again the same id"), (None, "no id"), (7, "x" * 3000 + " y"), (8, "One. Two! Three? " * 900), (1, None)]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, 5, "z") for d, t in rows], "doc_id long, text string, start long, path string")


def ids_of(path, text):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_same_ids(path):
    rng = random.Random(1)
    signs = ["a", "B", "é", " ", " ", "\n", "\t", ".", "'s", "1", "日", "  ", "\x1c", "!", "É", "İ", "\0", "\u3000", "\u2019", "e\u0301", "T\u0308", "J\u030c", "W\u030a", "\x01", "<|endoftext|>", "\u00a0"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    for keep in (0, 500, 100_000):
        enc = Encoder(path, keep)
        found = [np.frombuffer(x, dtype="<u2").tolist() for x in enc.encode([t.encode() for t in texts])]
        assert found == [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
        assert len(enc.known) <= keep + 30_000


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_operators_encode_as_the_library_does(spark, tmp_path, path):
    rng = random.Random(3)
    signs = ["a", "B", "one", " ", " ", "\n", ".", "É", "T\u0308", "H\u0331", "\x01", "\u3000", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|", "|>"]
    texts = ["one <|endoftext|> two", "x<|startoftext|>", "<|EndOfText|>", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(3000))]
    expected = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    enc = encoder(path)
    for _ in range(2):
        assert [np.frombuffer(x, dtype="<u2").tolist() for x in enc.encode([t.encode() for t in texts])] == expected
    rows = spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string")
    R.write_records(rows, f"file://{tmp_path}/out", path)
    assert {r.doc_id: r.n_tokens for r in R.index_records(spark, f"file://{tmp_path}/out").collect()} == {i: len(x) + 1 for i, x in enumerate(expected[:50])}
    assert {r.doc_id: r.doc_tokens for r in K.pack(rows, path).collect()} == {i: len(x) + 1 for i, x in enumerate(expected[:50])}


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(E, "GROUP", 64)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["one", "Two.", "3", "\n", "", "É", "<|endoftext|>", "x" * 90]) for _ in range(rng.choice([0, 5, 80]))) for _ in range(300)]
    for path in (WORD, BYTE):
        expected = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        found = list(Encoder(path, 200, literal=False).stream(enumerate(t.encode() for t in texts)))
        assert [(k, np.frombuffer(x, dtype="<u2").tolist()) for k, x in found] == list(enumerate(expected))


def test_runs_depend_on_the_rows_alone(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(400)]), " ".join(rng.choice(["one", "two.", "three"]) for _ in range(rng.choice([0, 3, 400])))) for _ in range(600)]
    packs = []
    for n in (1, 3, 17):
        docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(n)
        found = K.pack(docs, BYTE, run_bytes=20_000).collect()
        packs.append(sorted(map(tuple, found), key=repr))
    assert packs[0] == packs[1] == packs[2]
    assert len({r[5] >> 32 for r in packs[0]}) > 5
    starts = E.run_starts(spark.createDataFrame(rows, "doc_id long, text string"), 20_000)
    ordered = sorted(zip(*(x.tolist() for x in starts[:2]), strict=True))
    assert ordered == list(zip(*(x.tolist() for x in starts[:2]), strict=True)) and len(ordered) == len(set(ordered))
    keys = [(d, h) for d, h in ordered[:3]] + [(ordered[0][0], ordered[0][1] - 1), (None, 5), (10**6, 0)]
    got = E.runs_of(pa.array([d for d, _ in keys], pa.int64()), pa.array([h for _, h in keys], pa.int64()), starts).tolist()
    assert got == [1, 2, 3, 0, 0, len(ordered)]


def test_packing_of_more_than_a_buffer(monkeypatch):
    monkeypatch.setattr(K, "BUFFER", 3)
    rng = random.Random(8)
    ends = np.zeros(100, dtype=bool)
    ends[:8] = True
    docs = [(i, np.array([rng.randint(0, 99) for _ in range(rng.choice([1, 30, 700, 5000]))], dtype="<u2")) for i in range(60)]
    pieces = list(K.pack_run(iter(docs), ends, 7 << 32, 512))
    at = {}
    sums = defaultdict(int)
    for doc_id, start, n, crc, total, sequence, offset in pieces:
        assert start == at.get(doc_id, 0) and offset == sums[sequence]
        assert crc == zlib.crc32(docs[doc_id][1][start : start + n].astype("<u4").tobytes()) and total == len(docs[doc_id][1])
        at[doc_id], sums[sequence] = start + n, offset + n
    assert at == {i: len(x) for i, x in docs}
    assert [p[0] for p in pieces] == sorted(p[0] for p in pieces) and list(sums) == sorted(sums)
    assert max(sums.values()) <= 512 and sum(512 - n for n in sums.values() if n & (n - 1)) < 0.1 * sum(sums.values())


def test_records_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    R.write_records(table(spark), path, WORD)
    found = R.index_records(spark, path).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in found if r.doc_id) == sorted((d, len(ids_of(WORD, t))) for d, t in ROWS if d)
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [None, 1, 1, 2, 3, 3, 7, 8]
    by_crc = {zlib.crc32(np.array(ids_of(WORD, t), "<u4").tobytes()) for _, t in ROWS}
    assert {r.ids_crc32 for r in found} == by_crc
    shuffled = [(r.doc_id, r.ids) for r in R.read_shuffled(spark, path, seed=1).collect()]
    assert sorted(shuffled, key=repr) == sorted(((d, ids_of(WORD, t)) for d, t in ROWS), key=repr)


def test_shard_numbers_of_six_digits(spark, tmp_path):
    for name, doc_id in (("part-10000-x.txt", 1), ("part-100000-x.txt", 2)):
        (tmp_path / "out").mkdir(exist_ok=True)
        (tmp_path / "out" / name).write_bytes(R.frame(doc_id, struct.pack("<3H", 1, 2, 3), "H") + R.END)
    assert sorted((r.doc_id, r.shard, r.start) for r in R.index_records(spark, f"file://{tmp_path}/out").collect()) == [(1, 10000, 0), (2, 100000, 3)]


def test_damage_is_found():
    good = R.frame(5, struct.pack("<3H", 1, 2, 3), "H") + R.END
    assert [(d, i.tolist()) for _, _, d, i in R.frames(good * 2)] == [(5, [1, 2, 3])] * 2
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(R.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(R.frames(good[:-3]))


def test_empty_table(spark, tmp_path):
    empty = table(spark).where("false")
    R.write_records(empty, f"file://{tmp_path}/e", WORD)
    assert R.index_records(spark, f"file://{tmp_path}/e").count() == 0
    assert K.pack(empty, BYTE).count() == 0


def test_windows_are_best():
    rng = random.Random(2)
    for _ in range(200):
        window = rng.randint(4, 12)
        cuts = [0]
        while len(cuts) < rng.randint(3, 12):
            cuts.append(cuts[-1] + rng.randint(1, window))
        pen = [0.0, *(rng.choice([0, 2.0, 5.0]) for _ in cuts[1:])]
        best = [0.0] + [float("inf")] * (len(cuts) - 1)
        for j in range(1, len(cuts)):
            for i in range(j):
                if cuts[j] - cuts[i] <= window:
                    best[j] = min(best[j], best[i] + window - (cuts[j] - cuts[i]) + pen[j])
        ends = K.windows(np.array(cuts), np.array(pen), window)
        at, cost = 0, 0.0
        for e in ends:
            assert e - at <= window
            cost, at = cost + window - (e - at) + pen[cuts.index(e)], e
        assert cuts[-1] - at < window and cost == min(b for c, b in zip(cuts, best, strict=True) if c > cuts[-1] - window)


def test_packing_holds_every_id_once(spark):
    rows = K.pack(table(spark), BYTE, window=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    for doc_id, text in ROWS:
        ids = np.array(ids_of(BYTE, text), "<u4")
        mine = [r for r in by_doc[doc_id] if r.doc_tokens == len(ids)]
        copies = sum((d, t) == (doc_id, text) for d, t in ROWS)
        assert sum(r.length for r in mine) == copies * len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    sums = [sum(r.length for r in p) for p in by_sequence.values()]
    padded = sum(256 - n for n in sums if n & (n - 1))
    assert padded < 0.05 * sum(sums)
