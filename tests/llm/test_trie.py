"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from changeloom.llm import prefix_trie as P


def sequences(rows):
    """Rebuilt conversations by id: lists of (role, text)."""
    own = defaultdict(list)
    say = lambda x: x or ""
    digest = lambda r: hashlib.md5(f"{len(say(r[2]))}:{say(r[2])}{say(r[3])}".encode()).hexdigest()
    for conv, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        own[conv].append((say(role), say(text)))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def expected(rows):
    members, texts = defaultdict(list), {}
    for c, turns in sorted(sequences(rows).items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, ends = defaultdict(list), defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    for c, turns in sorted(sequences(rows).items()):
        ends[tuple(turns)].append(c)
    leaves, saved, out = {}, {}, []
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        texts[key] = len(key[-1][1].encode()) if key else 0
        saved[key] = (len(members[key]) - 1) * texts[key] + sum(saved[k] for k in children[key])
        out.append((members[key][0], len(key), members[key[:-1]][0] if key else None, len(members[key]), len(children[key]), leaves[key], saved[key], hashlib.sha256(",".join(map(str, ends[key])).encode()).hexdigest()))
    return sorted(out, key=str)


def table(rng, convs, longest=8, words=3):
    return [(c, rng.choice([None, k, k]) if rng.random() < 0.1 else k, rng.choice(["user", "assistant", None]), rng.choice(["a", "é b", None, "ccc"][:words])) for c in convs for k in range(rng.randrange(1, longest))]


def long_ones(rng):
    """Conversations beyond one round of comparison: copies, a shared beginning of 150 turns, and one that ends where others go on."""
    base = [("user" if k % 2 else "assistant", f"t{k}") for k in range(200)]
    made = {25: base, 35: base, 40: base[:150] + [("user", "x")] * 30, 45: base[:128], 50: base[:64], 55: [("user", "z")] + base[1:], 60: base[:150] + [("user", "y")]}
    return [(c, k, *turn) for c, turns in made.items() for k, turn in enumerate(turns)]


def found(spark, rows, size=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as digest", "1 as place", "'y' as rep")
    out = P.trie(*P.rebuilt(df.repartition(5)), size=size)
    return sorted((tuple(r)[:8] for r in out.collect()), key=str)


@pytest.mark.parametrize(("seed", "size"), [(1, None), (2, 1), (3, 2), (4, 7)])
def test_against_prefixes(spark, seed, size):
    rng = random.Random(seed)
    convs = rng.sample(range(60), 40) if seed % 2 else range(70)
    rows = table(rng, convs, words=2 + seed % 2)
    rng.shuffle(rows)
    assert found(spark, rows, size) == expected(rows)


@pytest.mark.parametrize("size", [None, 1, 3])
def test_long_conversations(spark, size):
    rows = long_ones(random.Random(1)) + table(random.Random(7), range(20))
    assert found(spark, rows, size) == expected(rows)


def test_odd_tables(spark):
    assert found(spark, []) == []
    for rows in ([(None, 1, "user", "a")], [(5, None, None, None)], [(3, 1, "user", "a")], [(7, 0, "user", "a"), (7, 0, "user", "a")], [(c, 0, "user", "same") for c in range(0, 50, 5)]):
        assert found(spark, rows) == expected(rows)


def test_shared_turns():
    a, b = "a" * 32, "b" * 32
    assert [P.shared_turns(x, y) for x, y in ((a + b, a + b), (a + b, a), (a, b), ("", a), (a + b + a, a + b + b))] == [2, 1, 0, 0, 2]
