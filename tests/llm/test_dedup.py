"""Exact and near duplicates against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from changeloom.llm import exact_dedup as X
from changeloom.llm import jaccard_join as J
from changeloom.llm.components import components


def table(spark, rows):
    return spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, row_key string")


EXACT = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, " "), (6, ""), (7, "b a"), (8, "é\u00a0x"), (9, "éx"), (10, "é\u00a0 x"), (2, "ab"), (11, "q" * 5000), (12, "q" * 4999), (13, "q " * 5000), (2, "other")]


def normal(text):
    return "".join(c for c in (text or "") if c not in " \t\n\x0b\x0c\r")


def decide(rows):
    """Of each group the longest text, then the least id (null last) stays; of rows that repeat both, one does."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append((-len(t or ""), d is None, d or 0, t or ""))
    out, seen = [], set()
    for d, t in rows:
        best = min(groups[normal(t)])
        mine = (-len(t or ""), d is None, d or 0, t or "")
        first = mine == best and mine not in seen
        seen.add(mine)
        out.append((d, None if best[1] else best[2], len(groups[normal(t)]), first))
    return sorted(out, key=repr)


LEAST = -(1 << 63)
HARD = [*EXACT, *[(50, "again and again")] * 1000, *[(51, "again  and again")] * 3, *[(LEAST, "a b c")] * 2, (LEAST, "abc"), (None, "abc"), (None, "only"), (None, "only"), (None, " o n l y"), (60, ""), (60, None)]


@pytest.mark.parametrize("options", [{}, {"primes": (7, 5)}, {"huge": 3}, {"huge": 3, "primes": (7, 5), "salted": 1}])
@pytest.mark.parametrize("rows", [EXACT, HARD], ids=["plain", "hard"])
def test_exact(spark, rows, options):
    found = X.exact_duplicates(table(spark, rows), **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=repr) == decide(rows)


def test_repeated_rows_are_not_multiplied(spark):
    docs = table(spark, HARD)
    members = spark.createDataFrame([(50, "again and again", 51), (51, "again  and again", 51)], "doc_id long, text string, keep long")
    keys = members.select(X.row_key().alias("row_key"), X.row_key().alias("keep_key"), F.lit(0).alias("salt"))
    assert X.parts(docs, keys).count() == 1003


def test_exact_stage_and_empty(spark):
    out = X.deduplicated(table(spark, EXACT))
    assert out.columns == ["doc_id", "text", "row_key"]
    assert sorted(normal(r.text) for r in out.collect()) == sorted({normal(t) for _, t in EXACT})
    assert sorted(normal(r.text) for r in X.deduplicated(table(spark, HARD)).collect()) == sorted({normal(t) for _, t in HARD})
    assert X.exact_duplicates(table(spark, []).where("false")).count() == 0


def test_fingerprints_compose():
    f, rng = X.Fingerprint(chunk=16), random.Random(4)
    for _ in range(200):
        a, b = rng.randbytes(rng.randint(0, 50)), rng.randbytes(rng.randint(0, 50))
        both, first, second = f.of(a + b), f.of(a), f.of(b)
        assert both == tuple((f.shift(first[k], k, len(b)) + second[k]) % f.primes[k] for k in (0, 1))
        assert both[0] == sum(c * pow(f.bases[0], len(a + b) - 1 - i, f.primes[0]) for i, c in enumerate(a + b)) % f.primes[0]


def words(rng, n):
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def near_rows(seed=5):
    rng = random.Random(seed)
    rows, n = [], 0
    for family in range(12):
        base = words(rng, rng.randint(30, 120))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(["x", "y", "z"])
            rows.append((n, " ".join(copy)))
            n += 1
            if family % 3 == 0:
                rows.append((n, "\n".join(copy)))
                n += 1
    return rows + [(n, "one two"), (n + 1, "one two"), (n + 2, "three"), (n + 3, ""), (n + 4, None), (n + 5, " "), (0, rows[0][1]), (n + 6, "long " * 30_000)]


def brute(rows, threshold=0.8):
    """(doc_id, rep_id, class_id, n_links) of every row, and the classes as lists of rows."""

    def shingles(t):
        w = (t or "").split()
        return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset({tuple(w)} if w else [])

    least = lambda ids: min((d for d in ids if d is not None), default=None)
    sets = defaultdict(list)
    for d, t in rows:
        if shingles(t):
            sets[shingles(t)].append(d)
    links, parent = defaultdict(set), {s: s for s in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            links[a].add(b)
            links[b].add(a)
            parent[root(b)] = root(a)
    ids = defaultdict(list)
    for s, d in sets.items():
        ids[root(s)] += d
    out = []
    for d, t in rows:
        s = shingles(t)
        out.append((d, least(sets[s]), least(ids[root(s)]), len(links[s])) if s else (d, d, d, 0))
    kinds = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        kinds[root(shingles(t)) if shingles(t) else i if d is None else (d, t or "")].append((d, t))
    return sorted(out, key=repr), list(kinds.values())


def shared_ids(seed=9):
    """Texts that share an id, rows without one, repeated rows, and groups of near copies over several ids."""
    rng = random.Random(seed)
    rows = []
    for _ in range(8):
        base = words(rng, 80)
        for _ in range(rng.randint(2, 6)):
            copy = list(base)
            copy[rng.randrange(80)] = "x"
            rows += [(rng.choice([None, 1, 2, 3, 4, LEAST, 1 << 62]), " ".join(copy))] * rng.choice([1, 1, 3])
    return rows + [(1, "A b c d e"), (5, "A b c d e"), (5, "c d e f g"), (1, "A b c d e"), (None, "k l m"), (None, "k l m"), (7, ""), (7, None)]


@pytest.mark.parametrize("options", [{}, {"block": 2, "most": 60}])
@pytest.mark.parametrize("make", [near_rows, shared_ids])
def test_near(spark, make, options):
    rows = make()
    found = J.near_duplicates(table(spark, rows), **options).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)[0]


@pytest.mark.parametrize("make", [near_rows, shared_ids])
def test_near_stage_keeps_one_row_of_each_class(spark, make):
    rows = make()
    out = J.one_of_each(table(spark, rows))
    assert out.columns == ["doc_id", "text", "row_key"]
    kept = Counter((r.doc_id, r.text or "") for r in out.collect())
    kinds = brute(rows)[1]
    assert sum(kept.values()) == len(kinds)
    for kind in kinds:
        assert sum(kept[x] for x in {(d, t or "") for d, t in kind}) == 1


def test_links_between_texts_of_one_id(spark):
    rng = random.Random(11)
    a, b = words(rng, 60), words(rng, 60)
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b))]
    assert sorted(tuple(r) for r in J.near_duplicates(table(spark, rows)).collect()) == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 1, 1)]


def test_near_empty(spark):
    assert J.near_duplicates(table(spark, near_rows()).where("false")).count() == 0
    assert J.one_of_each(table(spark, near_rows()).where("false")).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(6)
    need, lost = J.least_equal(0.8, J.TOLERANCE), 0
    for _ in range(4000):
        equal = np.cumsum(rng.random(J.HASHES) < 0.8)
        lost += any(equal[m - 1] < need[m] for m in range(J.STEP, J.HASHES + 1, J.STEP))
    assert lost <= 2
    assert need[128] > 64  # and pairs far below it go


def test_products_agree_with_intersections():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(80)]
    a, b = np.triu_indices(80, 1)
    assert len(a) > J.MANY
    assert J.common(a, b, sets).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(200, i) for i in range(201, 260)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in found) == sorted((x, root(x)) for x in parent)
