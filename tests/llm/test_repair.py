"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from changeloom.llm import conversation_repair as R

BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    """Rows (conv_id, turn, role, text) of a conversation in order, after damage."""
    say = lambda x: " " if x is None else str(x)
    tie = lambda r: hashlib.md5(f"{len(say(r[2]))}:{say(r[2])}{say(r[3])}".encode()).digest()
    out = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, tie(r))):
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(conv, rows):
    rows, seen, faults = damage(rows), set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANK)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def next_state(state, initial):  # the last initial so far, "" at the start
        return initial if (initial == "s" and state == "") or (initial == "u" and state in ("", "s", "a")) or (initial == "a" and state == "u") else None

    @lru_cache(None)
    def best(i, state, inserted=0):
        """(cost, audit, output) of the rest, the least in this order."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        options = []
        if inserted < 3:
            options += [(5, "I", i, name, "", inserted + 1) for name in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i][1:]
            options.append((2, "D", i + 1, None, None, 0))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                options += [(more, "K", i + 1, role, text, 0)] + [(1 + more, "R", i + 1, name, text, 0) for name in ("user", "assistant")]
        for cost, letter, j, name, text, n in options:
            to = state if name is None else next_state(state, name[:1])
            if to is not None and (rest := best(j, to, n)):
                found.append((cost + rest[0], letter + rest[1], ((f"{name}:{text}",) if name is not None else ()) + rest[2]))
        return min(found) if found else None

    for i in range(len(rows), 0, -50):
        for s in ("", "s", "u", "a"):
            best(i, s)
    cost, audit, lines = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversation(rng, conv, n):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Yes.", "No!", "a b", " ", None, "é?\n", "x" * 300 + ".", "w", "Why? ", "1.", "2.", "3.", "4.", "5."]
    turn = lambda k: rng.choice([k, k, k, k + 3, None, k // 2])
    tidy = rng.random() < 0.5
    role = lambda k: ("user", "assistant")[k % 2] if tidy and rng.random() < 0.8 else rng.choice(roles)
    text = lambda k: f"{k}." if tidy and rng.random() < 0.7 else rng.choice(texts)
    return [(conv, k if tidy else turn(k), role(k), text(k)) for k in range(n)]


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(5)
    out = {c: conversation(rng, c, rng.randrange(1, 9)) for c in range(150)}
    out |= {c: conversation(rng, c, n) for c, n in ((200, 63), (201, 64), (202, 65), (203, 200), (204, 300), (-7, 130), (None, 5))}
    out[300] = [(300, 1, "user", "same.")] * 9
    out[301] = [(301, None, None, None), (301, None, "system", "s.")]
    dropped = next(t for t in range(99) if zlib.crc32(f"302:{t}".encode()) % 20 == 0)
    out[302] = [(302, dropped, "user", "gone.")]
    return out


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as block", "2 as codes", "'x' as row_no", "'y' as copy") if extra else df


def test_summary_against_search(spark, conversations):
    rows = [r for c in conversations.values() for r in c]
    random.Random(1).shuffle(rows)
    found = {r[0]: tuple(r) for r in R.summary(R.damaged(frame(spark, rows).repartition(5))).collect()}
    assert found == {c: expected(c, r) for c, r in conversations.items()}


def test_edits_make_what_the_summary_says(spark, conversations):
    rows = [r for c in conversations.values() for r in c]
    edits = R.repair(R.damaged(frame(spark, rows))).collect()
    for c in (0, 203, -7, None, 301):
        mine = sorted((r for r in edits if r.conv_id == c), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        want = expected(c, conversations[c])
        assert "".join(r.edit for r in mine) == want[7]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine if r.role is not None).encode()).hexdigest() == want[8]
        assert [sum(r.fault == f for r in mine) for f in ("blank", "duplicate", "truncated")] == list(want[2:5])


def test_no_rows(spark):
    assert R.summary(R.damaged(frame(spark, []))).collect() == []
    assert R.repair(R.damaged(frame(spark, [], extra=False))).collect() == []


def test_matrices_of_blocks_multiply():
    rng = np.random.default_rng(3)
    codes = rng.choice([0, 1, 2, 3, 4, 20, 8, 10, 11, 2, 3], size=(40, 12)).astype(np.uint8)
    whole = R.matrix(codes)
    parts = R.matrix(np.ascontiguousarray(codes[:, :5])), R.matrix(np.ascontiguousarray(codes[:, 5:]))
    both = np.minimum((parts[0][:, :, :, None] + parts[1][:, None, :, :]).min(2), R.FAR)
    assert (whole == both).all()


def test_layers_begin_empty_and_grow():
    found = R.layers(np.array([[2, 3, 2]], np.uint8), np.array([R.LAST]))
    assert not found[:6].any()
    assert ((found[7:] & found[6:-1]) == found[6:-1]).all()
    assert R.costs(found)[0, 0, 0] == 2
