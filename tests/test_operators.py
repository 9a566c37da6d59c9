"""Cleaning, sampling, labels, metrics, rules and checks on small cases."""

import itertools
import json
import math
import random
import re
from collections import Counter, defaultdict
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changeloom import schemas
from changeloom.operators import clean as C
from changeloom.operators import containment as K
from changeloom.operators import labels as L
from changeloom.operators import metrics as M
from changeloom.operators import sampling as S
from changeloom.operators import security as Z
from changeloom.operators import validate as V
from changeloom.sources import io
from changeloom.streaming.resume import incremental

FILE = "array<struct<filename string, status string>>"


def kept_files(spark, files, dirs):
    df = spark.createDataFrame([(files, dirs)], f"f {FILE}, d array<string>")
    return [x.filename for x in df.select(C.files_in_dirs(F.col("f"), F.col("d")).alias("k")).first().k]


def test_files_in_dirs(spark):
    dirs = ["skills/foo", "skills/bar"]
    assert kept_files(spark, [("skills/foo/SKILL.md", "modified"), ("skills/foo/a.py", "added")], dirs) == ["skills/foo/SKILL.md", "skills/foo/a.py"]
    assert kept_files(spark, [("skills/new/SKILL.md", "added"), ("skills/new/a.py", "added")], dirs) == []
    assert kept_files(spark, [("skills/bar/SKILL.md", "removed"), ("skills/bar/x", "removed")], dirs) == []
    assert kept_files(spark, [("README.md", "modified"), (".github/x.yml", "modified")], dirs) == []
    assert kept_files(spark, [("skills/foo/SKILL.md", "modified"), ("skills/new/SKILL.md", "added")], dirs) == ["skills/foo/SKILL.md"]
    assert kept_files(spark, [("skills/foo/sub/SKILL.md", "added"), ("skills/foo/sub/x", "added")], dirs) == []
    assert kept_files(spark, [("a", "modified")], ["."]) == []


def branches(spark, rows):
    """Rows (upstream, owner, branch, shas), the order being the row number."""
    data = [(i, u, o, b, [(s, "m") for s in shas]) for i, (u, o, b, shas) in enumerate(rows)]
    df = spark.createDataFrame(data, "row_no long, upstream string, fork_owner string, fork_branch string, commits array<struct<sha string, message string>>")
    return sorted(r.row_no for r in C.dedup_branches(df).collect())


def maximal(rows):
    """The rows to keep, by comparing all pairs."""
    out = []
    for i, (u, o, b, shas) in enumerate(rows):
        mine, first = {s for s in shas if s}, b in ("main", "master")
        for j, (v, p, c, other) in enumerate(rows):
            theirs = {s for s in other if s}
            if i != j and (u, o) == (v, p) and (mine < theirs or mine == theirs and (c not in ("main", "master"), j) < (not first, i)):
                break
        else:
            out.append(i)
    return out


def test_dedup_branches(spark):
    cases = [
        [("u", "o", "x", ["1"])],
        [("u", "o", "x", ["1", "2"]), ("u", "o", "main", ["2", "1"])],
        [("u", "o", "x", ["1"]), ("u", "o", "y", ["1", "2"])],
        [("u", "o", "x", ["1"]), ("u", "o", "y", ["2"])],
        [("u", "o", "x", ["1"]), ("u", "o", "y", ["1", "2"]), ("u", "o", "z", ["1", "2", "3"])],
        [("u", "o", "x", ["1"]), ("u", "p", "x", ["1"]), ("v", "o", "x", ["1"])],
        [("u", "o", "x", []), ("u", "o", "y", [""])],
        [("u", "o", "x", []), ("u", "o", "y", ["1"])],
    ]
    for rows in cases:
        assert branches(spark, rows) == maximal(rows), rows


def test_dedup_branches_random(spark):
    rng = random.Random(3)
    rows = [(f"u{rng.randint(0, 30)}", "o", rng.choice(["main", "a", "b"]), [rng.choice("123") for _ in range(rng.randint(0, 3))]) for _ in range(200)]
    assert branches(spark, rows) == maximal(rows)


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_maximal_sets_with_items_that_all_share(spark, hot):
    rng = random.Random(hot)
    rows = [(i, rng.choice([None, "g"]), rng.choice([True, False, False]), sorted({"all", *(f"x{rng.randrange(40)}" for _ in range(rng.randrange(7)))} if rng.random() < 0.97 else set())) for i in range(600)]
    df = spark.createDataFrame(rows, "row_no long, u string, d boolean, s array<string>").repartition(5)
    found = sorted(r.row_no for r in C.maximal_sets(df, ["u"], "s", F.col("d"), hot=hot).collect())
    beats = lambda a, b: a[0] != b[0] and a[1] == b[1] and (set(b[3]) < set(a[3]) or (set(a[3]) == set(b[3]) and (not a[2], a[0]) < (not b[2], b[0])))
    assert found == [b[0] for b in rows if not any(beats(a, b) for a in rows)]


def test_maximal_sets_of_no_rows(spark):
    df = spark.createDataFrame([], "row_no long, u string, d boolean, s array<string>")
    assert C.maximal_sets(df, ["u"], "s", F.col("d")).collect() == []


def outdone(rows):
    """Ids of the rows (id, group, first, set) to keep, by comparing all pairs of a group."""
    groups = defaultdict(list)
    for i, g, d, s in rows:
        groups[g].append((frozenset(s), not d, i))
    return sorted(i for sets in groups.values() for s, d, i in sets if not any(s < t or s == t and (e, j) < (d, i) for t, e, j in sets))


def test_maximal_keys_reads_rows_once(spark):
    read, rng = spark.sparkContext.accumulator(0), random.Random(5)
    rows = [(i, i % 40, rng.random() < 0.3, sorted({f"x{rng.randrange(9)}" for _ in range(rng.randrange(6))})) for i in range(400)]

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "row_no long, u long, d boolean, s array<string>")
    for hot in (20, 500_000):
        before = read.value
        found = C.maximal_keys(df.mapInArrow(counted, df.schema), ["u"], "s", F.col("d"), hot=hot).collect()
        assert sorted(r.row_no for r in found) == outdone(rows) and all(r.u == r.row_no % 40 for r in found)
        assert read.value - before == len(rows)


@pytest.mark.parametrize("hot", [40, 700, 500_000])
def test_maximal_sets_of_large_groups_without_pairs(spark, hot):
    rng = random.Random(hot)
    rows = [(i, rng.choice([None, 1, 2]), rng.random() < 0.3, ["everywhere", *{f"x{int(rng.random() ** 2 * 30)}" for _ in range(rng.randrange(8))}]) for i in range(1500)]
    rows += [(2000 + i, 3, False, [f"y{j:04}" for j in range(i)]) for i in (0, 1, 2, 1100, 1101, 1102)]  # a chain of long sets
    df = spark.createDataFrame(rows, "row_no long, u int, d boolean, s array<string>").repartition(3)
    assert sorted(r.row_no for r in C.maximal_keys(df, ["u"], "s", F.col("d"), hot=hot).collect()) == outdone(rows)


def test_units_are_compared_in_bounded_steps(monkeypatch):
    """Rows of a unit come in many batches, and steps are few: they grow with the sets, not with their pairs."""
    rng, found = random.Random(4), {}
    monkeypatch.setattr(K, "ROWS", 64)
    monkeypatch.setattr(K, "STEPS", 50)
    rows = [(i, i % 3, False, sorted({f"x{rng.randrange(12):02}" for _ in range(rng.randrange(7))})) for i in range(500)]
    kind = pa.schema([("u", pa.int64()), ("g", pa.struct([("k", pa.int64())])), ("items", pa.list_(pa.string())), ("n", pa.int32()), ("probe", pa.bool_()), ("a", pa.int32()), ("b", pa.int64())])
    table = pa.Table.from_pylist([{"u": g, "g": {"k": g}, "items": s, "n": len(s), "probe": True, "a": 1, "b": i} for i, g, _, s in sorted(rows, key=lambda r: r[1])], kind)
    assert sorted(b for x in K._compared(iter(table.to_batches(max_chunksize=17))) for b in x["b"].to_pylist()) == outdone(rows)

    monkeypatch.undo()
    for n in (4000, 8000):
        steps, step = [], K._Tries._next
        monkeypatch.setattr(K._Tries, "_next", lambda self, *a, step=step, steps=steps: steps.append(int(np.minimum(a[4], a[5]).sum())) or step(self, *a))
        many = [{"u": 0, "g": {"k": 0}, "items": s, "n": len(s), "probe": True, "a": 1, "b": i} for i in range(n) if (s := sorted({f"x{rng.randrange(200):03}" for _ in range(rng.randrange(1, 8))}))]
        list(K._compared(iter(pa.Table.from_pylist(many, kind).to_batches())))
        found[n] = sum(steps)
        monkeypatch.undo()
    assert found[8000] < 2.5 * found[4000] and found[8000] < 8000**2 / 100


def test_prevalence_and_bundles_of_a_large_vocabulary(spark):
    rng = random.Random(9)
    names = [f"c{i:02}" for i in range(90)]
    rows = [(i, rng.choice([None, "u", "v", "w"]), rng.choices(names, k=rng.randrange(5)) + rng.choice([[], [None]]), rng.choices(["s", "t", "x", "y", "z"], k=rng.randrange(4))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, upstream string, categories array<string>, skills array<string>")
    sizes, hits, reach, ups, weights = Counter(r[1] for r in rows), Counter(), defaultdict(set), defaultdict(set), Counter()
    every = {(u, s) for _, u, _, skills in rows for s in skills}
    for _, u, categories, skills in rows:
        mine = sorted({c for c in categories if c})
        for n in (1, 2, 3):
            for b in itertools.combinations(mine, n):
                hits[b] += 1
                weights[b] += 1 / math.sqrt(sizes[u])
                ups[b].add(u)
                reach[b] |= {(u, s) for s in skills}
    total = sum(math.sqrt(n) for n in sizes.values())
    found = {r.category: r for r in M.prevalence(df).collect()}
    assert set(found) == {b[0] for b in hits if len(b) == 1}
    for name, r in found.items():
        assert (r.hits, r.analyzed, r.skills, r.observed_skills, r.upstreams, r.observed_upstreams) == (hits[(name,)], 300, len(reach[(name,)]), len(every), len(ups[(name,)]), 4)
        assert r.adjusted_prevalence == pytest.approx(weights[(name,)] / total)
    out = M.bundles(df).orderBy("rank").collect()
    assert len(out) == sum(len(b) > 1 for b in hits)
    for r in out:
        b = tuple(r.bundle.split(" + "))
        assert (r["size"], r.support, r.skills, r.upstream_coverage) == (len(b), hits[b], len(reach[b]), len(ups[b]) / 4)
        assert r.lift == pytest.approx(hits[b] / 300 / math.prod(hits[(c,)] / 300 for c in b))
    assert [(-r.prevalence, r["size"], r.bundle) for r in out] == sorted((-r.prevalence, r["size"], r.bundle) for r in out)
    assert M.prevalence(df.limit(0)).collect() == [] and M.bundles(df.limit(0)).collect() == []


def test_vocabularies_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_NAMES", 2)
    df = spark.createDataFrame([(1, "u", ["a", "b", "c"], ["s"])], "id int, upstream string, categories array<string>, skills array<string>")
    for f in (M.prevalence, M.bundles, M.pairs):
        with pytest.raises(ValueError, match="more than 2"):
            f(df)


def test_scan_without_gates(spark):
    """Matches of random lines against all tests of every rule, one after the other."""
    rng = random.Random(12)
    words = ["inject", "into file", "code", "curl", "http://x", "wget ", "CURL", "\u017fudo x", "sudo", "rm -rf /", " rm\t", "exec (", "exec(", "decode", "api_key", "to\u212aen", "password", "nc -l", "nc  -e /", ".SSH/", "~/.ssh/", "==", "force", "install", "--upgrade", "npm i -g", "base64.decode", "chr (1) + chr", "vars()[x]", "prod then", "if PROD then system", "pip install a --global", "eval(", "github.com", "> /etc/", ":>", "dd x of=/", "getattr(a, 'b')(", "é", "x", "/etc/", "su ", "credentials.json"]
    lines = [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, content string")
    low, line = F.lower("content"), F.col("content")
    tests = []
    for i, r in enumerate(Z.RULES):
        ok = reduce(or_, [F.contains(low, F.lit(t)) for t in Z.GLOBAL])
        for d in r.allowed:
            ok &= ~F.contains(low, F.lit(d.lower()))
        tests.append(F.when(ok & line.rlike(Z.one_of(r.prefilters)) & line.rlike(Z.one_of(r.patterns)), i))
    plain = {(r.id, i) for r in df.select("id", F.array(*tests).alias("m")).collect() for i in r.m if i is not None}
    assert {(r.id, r.rule_no) for r in Z.scan(df).collect()} == plain and len({i for _, i in plain}) == len(Z.RULES)


def test_texts_that_patterns_need():
    cases = {r"\bcurl\b": "curl", r"requests\.": "requests.", r"nc\s+": "nc", r">\s*/(?:etc|usr)/": ">", "a|b": "", r"ab(c|d)efg": "efg", "xy?z": "x", "ab+c": "ab", r"[ab]cd": "cd", r"a\(x|y\)": ""}
    assert {p: Z.needed_text(p) for p in cases} == cases
    pattern = re.compile(Z.any_of(("ab", "abc", "b.d", "")) or "(?:)")
    assert pattern.search("zzz")
    pattern = re.compile(Z.any_of(("ab", "abc", "b.d", "c ")).replace("\\x{2e}", r"\."))
    assert [bool(pattern.search(t)) for t in ("xab", "b.d", "bxd", "c", "c ", "a")] == [True, True, False, False, True, False]


def test_shared_history_and_scope(spark):
    rows = [(0, "u", "a", "x", "ok", ["1", "2"]), (1, "u", "b", "x", "ok", ["2", "3"]), (2, "v", "a", "x", "ok", ["2"]), (3, "u", "a", "y", "no_diff", ["9"]), (4, "u", "c", "x", "ok", ["2"])]
    data = [(i, u, o, b, s, [(c, "m") for c in shas]) for i, u, o, b, s, shas in rows]
    df = spark.createDataFrame(data, "row_no long, upstream string, fork_owner string, fork_branch string, status string, commits array<struct<sha string, message string>>")
    out = {r.row_no: [c.sha for c in r.commits] for r in C.drop_shared_history(df).collect()}
    assert out == {0: ["1"], 1: ["3"], 2: ["2"]}
    diffs = spark.createDataFrame([(0, "u", "fix", [("1", "edit")], [("skills/foo/SKILL.md", "modified"), ("skills/foo/a.png", "added"), ("README.md", "modified")]), (1, "u", "auto-sync", [("1", "x")], [("skills/foo/SKILL.md", "modified")]), (2, "u", "x", [("1", "Synced with upstream")], [("skills/foo/SKILL.md", "modified")]), (3, "u", "y", [("1", "z")], [("other", "modified")])], f"row_no long, upstream string, fork_branch string, commits array<struct<sha string, message string>>, files {FILE}")
    index = spark.createDataFrame([("u", "skills/foo/SKILL.md")], "repo string, path string")
    found = C.in_scope(diffs, index).collect()
    assert [(r.row_no, [f.filename for f in r.files]) for r in found] == [(0, ["skills/foo/SKILL.md"])]
    new = spark.createDataFrame([("u", [("skills/new/SKILL.md", "added")]), ("u", [("skills/foo/SKILL.md", "added"), ("skills/new/SKILL.md", "added")]), ("v", [("x", "added")])], f"upstream string, files {FILE}")
    assert {r.category: (r["count"], r.denominator) for r in C.new_packages(new, index).collect()} == {"modifies_existing": (1, 3), "adds_new": (2, 3), "modifies_existing_and_adds_new": (1, 3), "adds_new_only": (1, 3)}


def test_clean_commits(spark):
    df = spark.createDataFrame([([("1", "Merge branch 'x'"), ("2", "add step\n\nSigned-off-by: me"), ("3", "bump"), ("4", "Fixes: 1"), ("5", None)],)], "c array<struct<sha string, message string>>")
    assert [(c.sha, c.message) for c in df.select(C.clean_commits(F.col("c")).alias("c")).first().c] == [("2", "add step")]


def test_active(spark):
    rows = [("2024-01-01T00:00:00Z", "2024-01-01T00:05:00Z", False), ("2024-01-01T00:00:00Z", "2024-01-01T00:05:01Z", True), (None, "2024-01-01T00:00:00Z", True), ("bad", "2024-01-01T00:00:00Z", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, p string, e boolean")
    assert df.where(C.is_active(F.col("c"), F.col("p")) != F.col("e")).count() == 0


def dealt(sizes, n):
    """Quotas by the rules, for strata in the order in which they are first seen."""
    floors = [min(1, k) for k in sizes]
    floors = floors if sum(floors) <= n else [0] * len(sizes)
    rooms, left = [k - f for k, f in zip(sizes, floors, strict=True)], n - sum(floors)
    if left <= 0 or not sum(rooms):
        return floors
    whole = [min(left * r // sum(rooms), r) for r in rooms]
    out = [f + w for f, w in zip(floors, whole, strict=True)]
    by_fraction = sorted(range(len(sizes)), key=lambda i: (-math.modf(left * rooms[i] / sum(rooms))[0], i))
    for i in [i for i in by_fraction if whole[i] < rooms[i]][: max(left - sum(whole), 0)]:
        out[i] += 1
    return out


def test_quotas(spark):
    rng = random.Random(5)
    cases = [([100, 10, 1], 30), ([5, 5, 5], 2), ([3, 3], 100), ([7], 0), *(([rng.randint(1, 40) for _ in range(rng.randint(1, 6))], rng.randint(0, 90)) for _ in range(20))]
    for sizes, n in cases:
        names = [None, *"abcdef"][: len(sizes)]
        df = spark.createDataFrame([(i * 1000 + k, names[i]) for i, size in enumerate(sizes) for k in range(size)], "id long, s string").coalesce(1)
        assert {r["s"]: r["quota"] for r in S.quotas(df, "s", "id", n).collect()} == dict(zip(names, dealt(sizes, n), strict=True)), (sizes, n)
    assert dealt([100, 10, 1], 30) == [26, 3, 1]


def test_a_null_stratum_is_drawn(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "id int, s string")
    drawn = S.stratified(df, "s", "id", 10).collect()
    assert len(drawn) == 10 and {r.sample_stratum for r in drawn} == {"repo:", "repo:a"} and S.everything(df).where("sample_stratum = 'full'").count() == 20


def test_messages_that_lack_an_input_raise(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "modification_id string")
    assert L.message_instances(rows("a", "b"), rows("a", "b", "c"), rows("b", "a")).count() == 2
    with pytest.raises(Exception, match="no instance for b"):
        L.message_instances(rows("a", "b"), rows("a", "b"), rows("a")).collect()


def test_null_upstreams_count(spark):
    df = spark.createDataFrame([(1, None, ["x"], ["s"]), (2, "u", ["x"], [])], "id int, upstream string, categories array<string>, skills array<string>")
    assert M.prevalence(df).first().analyzed == 2


def test_lines_before_the_first_hunk(spark):
    inst = spark.createDataFrame([(1, "diff --git a a  [modified +1/-1]\n+sudo x\n@@\n-sudo q\n@@\n+wget y\n")], "id int, patch string")
    lines = Z.diff_lines(inst, hunks=True)
    found = {r.block: (r.hunk_status, r.deleted_only) for r in Z.hunks(Z.scan(lines), Z.hunk_roles(lines)).collect()}
    assert found == {0: ("added", False), 1: ("removed", True), 2: ("added", False)}
    assert [(r.id, r.matches) for r in Z.deleted_only(Z.scan(lines.where("role = 'removed'"))).collect()] == [(1, 1)]


def test_lines_of_json_keep_their_order(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.json").write_text("".join(json.dumps({"a": 100 + i, "pad": "x" * 200}) + "\n" for i in range(300)))
    (tmp_path / "d" / "a.json").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = io.read_jsonl(spark, str(tmp_path / "d"), "a int").orderBy("row_no").collect()
        assert [r.a for r in rows] == [1, 2, *range(100, 400)] and len({r.row_no for r in rows}) == 302
        assert [r.line for r in io.read_jsonl(spark, str(tmp_path / "d"), "a int", bad=True).collect()] == ["broken"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rewrite_takes_the_old_rows_back(spark, tmp_path):
    path = tmp_path / "r"
    io.rewrite(spark.range(3), str(path))
    path.rename(tmp_path / "r.old")  # as a crash between the renames leaves it
    with pytest.raises(Exception):
        io.rewrite(spark.range(1).selectExpr("raise_error('no')"), str(path))
    assert spark.read.json(str(path)).count() == 3
    io.rewrite(spark.range(2), str(path))
    assert spark.read.json(str(path)).count() == 2 and not (tmp_path / "r.old").exists()


def test_draws(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 90 else "c") for i in range(100)], "id int, s string")
    drawn = S.stratified(df, "s", "id", 20)
    counts = {r["s"]: r["count"] for r in drawn.groupBy("s").count().collect()}
    assert counts == {r["s"]: r["quota"] for r in S.quotas(df, "s", "id", 20).collect()} and {r.sample_stratum for r in drawn.collect()} == {"repo:a", "repo:b", "repo:c"}
    assert {r.id for r in drawn.collect()} == {r.id for r in S.stratified(df.repartition(7), "s", "id", 20).collect()}
    assert S.simple(df, "id", 1000).count() == 100
    with pytest.raises(ValueError):
        M.cochran(F.lit(1), 0.5)
    assert spark.range(1).select(M.cochran(F.lit(1220)).alias("n")).first().n == 293


def test_final_labels(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["b", "c"], ["c", "a", "d"])], "p array<string>, r array<string>, a array<string>")
    row = df.select(L.final_ordered(*map(F.col, "pra")).alias("o"), L.final_set(*map(F.col, "pra")).alias("s"), L.final_strict(*map(F.col, "pra")).alias("t")).first()
    assert row.o == ["a", "a", "c", "d"] and sorted(row.s) == ["a", "c", "d"] and sorted(row.t) == ["a", "d"]


def test_label_joins(spark):
    out = spark.createDataFrame([("1", ["a"]), ("2", ["b"]), ("3", [])], "id string, labels array<string>")
    consensus = spark.createDataFrame([("1", []), ("3", ["c"])], "id string, labels array<string>")
    assert {(r.id, tuple(r.labels)) for r in L.with_consensus(out, consensus, "id").collect()} == {("2", ("b",)), ("3", ("c",))}
    merged = L.upsert(spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, v string, w int"), spark.createDataFrame([(2, None), (3, "z")], "k int, v string"), "k")
    assert {tuple(r) for r in merged.collect()} == {(1, "x", 5), (2, None, 6), (3, "z", None)}
    pred = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a"])], "modification_id string, pred_labels array<string>")
    truth = spark.createDataFrame([("1", ["a"]), ("2", ["b"])], "modification_id string, gt_labels array<string>")
    verdicts = spark.createDataFrame([("1", ["b"], ["c"])], "modification_id string, remove_labels array<string>, add_labels array<string>")
    assert {(r.modification_id, tuple(r.pred_labels)) for r in L.predictions(pred, truth, verdicts).collect()} == {("1", ("a", "c")), ("2", ("a",))}


def test_metrics_zero_cases(spark):
    empty = spark.createDataFrame([], "a array<string>, b array<string>")
    row = M.agreement(empty).first()
    assert (row.records, row.macro_kappa, row.positive_agreement, row.alpha) == (0, 0.0, 1.0, 1.0)
    both = spark.createDataFrame([([], []), ([], [])], "a array<string>, b array<string>")
    assert M.agreement(both).first().mean_jaccard == 1.0
    rec = M.recall(spark.createDataFrame([(["a"], [])], "pred array<string>, ref array<string>")).first()
    assert (rec.n, rec.recall, rec.any_hit) == (0, 0.0, 0.0)
    low, high = M.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 0.0)


def test_prevalence_by_hand(spark):
    rows = [(1, "u", ["a", "b", "a"], ["s", "t"]), (2, "u", ["a"], []), (3, "v", [], ["s"]), (4, "v", ["b"], ["q"])]
    df = spark.createDataFrame(rows, "id int, upstream string, categories array<string>, skills array<string>")
    out = {r.category: r for r in M.prevalence(df).collect()}
    assert set(out) == {"a", "b"} and out["a"].hits == 2 and out["a"].prevalence == 0.5 and out["a"].upstream_coverage == 0.5
    assert (out["a"].skills, out["a"].observed_skills, out["b"].skills) == (2, 4, 3) and abs(out["b"].adjusted_prevalence - 0.5) < 1e-12
    assert M.pairs(df).first().together == 1
    assert M.bundles(df).select("bundle", "support").collect()[0] == ("a + b", 1)


RULE_LINES = {
    "curl http://x": ["NET001"], "curl https://github.com/x": [], "mywget x": [], "wget x": ["NET001"], "curl -d @x": ["NET002"], "cat ~/.ssh/id": ["FILE001"], "my token": [], "auth_token": ["FILE001"],
    "rm -rf /": ["FILE002", "CMD001"], "chmod 777 x": ["FILE002", "CMD001"], "sudo x": ["CMD001"], "os.system('x')": ["CMD002"], "exec(x)": ["CMD002", "INJ002"], "inject this code": ["INJ001"],
    "eval (x)": ["INJ002"], "nc -l -e /bin/sh": ["NET002", "INJ003"], "gem install x": ["DEP001"], "pip install --upgrade x": ["DEP002"], "base64.decode": ["OBF001"], "vars()[x]": ["OBF002"], "hello": [], "ésu x": [],
}


def test_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(RULE_LINES)], "id int, content string")
    found = {}
    for r in Z.scan(df.withColumn("line", F.lit(1))).orderBy("id", "rule_no").collect():
        found.setdefault(r.id, []).append(r.rule)
    assert [found.get(i, []) for i in range(len(RULE_LINES))] == list(RULE_LINES.values())


def test_instances_without_matches(spark):
    inst = spark.createDataFrame([(1, "diff --git a a  [modified +1/-1]\n@@\n+sudo x\n+wget y\n-eval(z)\n@@\n-sudo q\n"), (2, ""), (3, "diff --git b b  [removed +0/-1]\n@@\n-sudo x\n")], "id int, patch string")
    lines = Z.diff_lines(inst)
    m = Z.scan(lines)
    out = {r.id: r for r in Z.by_instance(inst, m.where("role = 'added'"), sort=("file_no", "line", "rule_no")).collect()}
    assert (out[1].rules, out[1].severity, out[2].flagged, out[3].matches) == ("CMD001;NET001", "CRITICAL", False, 0)
    row = Z.origin(m).first()
    assert (row.added, row.context, row.both, row.added_only, row.context_only) == (1, 2, 1, 0, 1)
    assert {(r.id, r.rule) for r in Z.removed_alone(m).collect()} == {(1, "CMD001"), (3, "CMD001")}
    assert {(r.edit, r.instances) for r in Z.line_edits(m).collect()} == {("added", 1)}
    hunks = {(r.id, r.block): r for r in Z.hunks(m, Z.hunk_roles(lines)).collect()}
    assert hunks[1, 0].hunk_status == "modified" and hunks[1, 1].deleted_only
    assert Z.summary(Z.by_instance(inst, m)).first().instances == 3


def test_label_errors(spark):
    good = ("u", "o", "b", "1", ["x"], [("x", "high", [("patch", "s", None)])], [], False, "sufficient", "{}", "")
    bad = ("u", "o", "b", "2", ["y", "x"], [("x", "high", [("branch_name", "s", None)]), ("x", "low", [])], [], False, "?", "{}", "")
    out = spark.createDataFrame([good, bad], schemas.LABELS).select(V.label_errors("1", ["x"]).alias("e")).collect()
    assert out[0].e == [] and out[1].e == ["version", "assignments differ from labels", "repeated assignment", "unknown label", "no evidence", "high confidence without patch evidence", "patch sufficiency"]


def test_coding_errors(spark):
    kind = "pred_labels array<string>, families array<string>, message_what_families array<string>, what_expression_categories array<string>, why_expression_categories array<string>, why_intentions array<string>"
    rows = [(["x"], ["f"], ["f"], ["w"], ["missing-why"], []), (["x", "x", "q"], ["f"], [], ["w", "missing-what"], ["y"], []), (["x"], ["f"], ["f"], [], ["z"], ["i"])]
    out = spark.createDataFrame(rows, kind).select(V.coding_errors(["x"], ["w", "missing-what"], ["y", "missing-why"]).alias("e")).collect()
    assert out[0].e == [] and out[1].e == ["unknown label", "repeated label", "families differ from labels", "a missing category isn't alone", "intentions"] and out[2].e == ["unknown category", "no category"]
    ids = V.id_errors(spark.createDataFrame([("a",), ("a",), ("z",)], "modification_id string"), spark.createDataFrame([("a",), ("b",)], "modification_id string"))
    assert {tuple(r) for r in ids.collect()} == {("a", "repeated"), ("z", "unknown"), ("b", "not coded")}


def test_io(spark, tmp_path):
    assert io.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").orderBy("row_no").collect()] == [1, 2]
    (tmp_path / "d").mkdir()
    for name in ("one", "two", "manifest"):
        (tmp_path / "d" / f"{name}.json").write_text(json.dumps({"a": 1}, indent=1))
    assert sorted(r.stem for r in io.read_json_folder(spark, str(tmp_path / "d"), "a int").collect()) == ["one", "two"]
    with pytest.raises(ValueError):
        io.read_verdicts(spark, str(tmp_path / "d" / "one.json"), schemas.VERDICTS)
    io.write_csv(spark.createDataFrame([(1, 0.03125)], "a int, b double"), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).collect()[1].value == "1,0.0312"
    io.rewrite(spark.range(3), str(tmp_path / "r"))
    io.rewrite(spark.range(2), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    io.write_per_row(spark.createDataFrame([("s", 1)], "stem string, a int"), str(tmp_path / "rows"))
    payload = io.tasks_payload(spark.createDataFrame([("b", 1), ("a", 2)], "k string, v int"), "k", {"what": ["x"]}).first().payload
    assert json.loads(payload) == {"order": ["a", "b"], "records": {"a": {"v": 2}, "b": {"v": 1}}, "vocabs": {"what": ["x"]}}
    assert io.repos_config({"defaults": {"prefix": "s"}, "repos": [{"repo": "a"}, {"repo": "b", "prefix": ""}]}) == [("a", "s"), ("b", "")]


def test_incremental(spark, tmp_path):
    src, sink = tmp_path / "src", str(tmp_path / "sink")
    src.mkdir()
    run = lambda: incremental(spark, str(src), sink, str(tmp_path / "cp"), "k int, v string", ["k"]).awaitTermination()
    (src / "1.json").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n')
    run()
    (src / "2.json").write_text('{"k": 2, "v": "c"}\n{"k": 3, "v": "d"}\n')
    run()
    assert {tuple(r) for r in spark.read.parquet(sink).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_features(spark):
    from changeloom.operators import features as T

    kind = "row_no long, upstream string, fork_owner string, fork_branch string, head_sha string, commits array<struct<sha string, message string>>, files array<struct<filename string, previous_filename string, status string, additions bigint, deletions bigint, patch string>>"
    files = [("s/SKILL.md", None, "modified", 2, 1, "@@\n ---\n+description: é\n ---"), ("s/scripts/a.py", None, "added", 3, None, None), ("s/AGENTS.md", "s/old", "renamed", 0, 0, "")]
    df = spark.createDataFrame([(1, "u/r", "me", "a b", "h", [("1", "x")], files), (0, "u/r", "me", "a b", "first", [("1", "Merge x y")], files[:1])], kind)
    row = T.candidates(df).first()
    assert (row.modification_id, row.head_sha, row.has_merge_commit, row.skill_md_file_count, row.total_additions, row.skill_patch_chars) == ("u/r::me::a b", "first", True, 1, 2, len(files[0][5]))
    inputs = T.label_inputs(T.candidates(df.where("row_no = 1")).withColumn("sample_stratum", F.lit("full")))
    assert inputs.first().stem == "u-r--me--a-b" and inputs.first().files[1].deletions == 0
    inst = T.analysis_instances(inputs, spark.createDataFrame([("u-r--me--a-b", [T.METADATA])], "stem string, labels array<string>"))
    assert [(r.group, r.instances, r.share) for r in T.metadata_split(inst).collect()] == [("metadata_instances", 1, 1.0), ("on_description", 1, 1.0), ("other_fields_only", 0, 0.0)]
    assert [r.category for r in T.surface_prevalence(inst).collect()] == ["SKILL.md", "AGENTS.md", "scripts"]
    assert [r.file for r in T.companion_prevalence(inst).collect()] == ["AGENTS.md"]
    text = inputs.select(T.render_diff(F.col("commits"), F.col("files")).alias("t")).first().t
    assert text.startswith("## Commit messages\n\n\n```\nx\n```\n\n\n## Files\n\n\n### `s/SKILL.md`  (modified, +2/-1)") and "_renamed from `s/old`_\n\n_(empty patch" in text


def test_pages():
    from changeloom.sources import remote as W

    calls, waits = [], []

    def listing(url, headers):
        calls.append(url)
        n = int(url.rsplit("page=", 1)[1])
        if len(calls) == 1:
            return 500, {}, ""
        return 200, {"link": '<x>; rel="next"'} if n < 3 else {}, json.dumps([] if n == 2 else [{"i": n}])

    assert [x["i"] for x in W.pages("http://x/forks", {}, None, listing, waits.append)] == [1, 3] and waits == [1]
    search = lambda url, _: (200, {}, json.dumps({"items": [{"i": i} for i in range(100 if url.endswith("page=1") else 40)]}))
    assert len(list(W.pages("http://x/search?q=a", {}, 1000, search))) == 140 and len(list(W.pages("http://x/s?q=a", {}, 30, search))) == 30
    assert list(W.pages("http://x", {}, None, lambda u, h: (404, {}, ""))) == []
    with pytest.raises(RuntimeError):
        W.fetch("http://x", {}, lambda u, h: (429, {"x-ratelimit-reset": "0"}, ""), waits.append)


def test_checkout(spark, tmp_path):
    from changeloom.sources import remote as W

    for p in ("a/SKILL.md", "b/c/SKILL.md", "b/x.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"---\nname: {p}\n---\n# T\n")
    assert sorted(r.path for r in W.checkout_definitions(spark, str(tmp_path)).collect()) == ["a/SKILL.md", "b/c/SKILL.md"]
    assert [r.path for r in W.checkout_definitions(spark, str(tmp_path), "b/").collect()] == ["b/c/SKILL.md"]


def test_compared(spark):
    kind = "found boolean, prefix string, commits array<struct<sha string, message string>>, files array<struct<filename string>>"
    rows = [(True, "s/", [("1", "a"), ("2", "b")], [("s/x",), ("t",)]), (True, "s/", [], [("t",)]), (False, "", None, None), (True, "", [], [("t",)])]
    out = C.compared(spark.createDataFrame(rows, kind)).collect()
    assert [(r.status, r.head_sha, len(r.files)) for r in out] == [("ok", "2", 1), ("no_diff", None, 0), ("not_found", None, 0), ("ok", None, 1)]


def test_audit(spark):
    from changeloom.operators import audit as T

    df = spark.createDataFrame([(f"r{i:04d}",) for i in range(1220)], "k string")
    drawn = [r.k for r in T.cochran_draw(df, "k").collect()]
    assert len(drawn) == 293 and drawn == sorted(drawn)
    seen, verdict = T.verdict_state(F.col("v"), F.col("x"))
    states = spark.createDataFrame([(True, None), (True, "wrong"), (None, "wrong"), (False, None)], "v boolean, x string").select(seen, verdict).collect()
    assert [tuple(r) for r in states] == [(True, "correct"), (True, "wrong"), (False, None), (False, None)]
    kind = "record string, set string, predicted_labels string, remove_labels array<string>, add_labels array<string>"
    a = spark.createDataFrame([("1", "sample", "x, y", ["y"], []), ("2", "low-confidence", "(none)", None, ["z"])], kind)
    b = spark.createDataFrame([("1", "sample", "x, y", [], []), ("2", "low-confidence", "(none)", [], ["z"])], kind)
    rows = {r.comparison: r for r in T.agreement_rows([a, b], a).collect()}
    assert rows["auditors"].mean_jaccard == 0.75 and rows["model, sample"].precision == 0.5 and rows["model, all"].records == 2 and rows["model, low-confidence"].recall == 0.0
    with pytest.raises(ValueError):
        T.first_two([a])
    out = spark.createDataFrame([([("p", "low", [("patch", " s ", "f.md")])], "why", "sufficient", False)], "a array<struct<name string, confidence string, evidence array<struct<type string, summary string, file string>>>>, r string, s string, u boolean")
    text = out.select(T.render_labels(*map(F.col, "arsu")).alias("t")).first().t
    assert text == "## Model prediction\n\n\n### `p` — confidence: **low** ⚠️ LOW\n\n- s\n  ↳ `f.md`\n\n\n## Rationale\n\nwhy\n\n\n---\n_patch_sufficiency: sufficient · uninformative_commit_messages: False_"


def test_one_file_for_each_record(spark, tmp_path):
    rows = spark.createDataFrame([("a-b", 1), ("a b%", None), ("a-b", 0)], "stem string, x int")
    io.write_per_row(rows, str(tmp_path / "rows"))
    assert sorted(p.name for p in (tmp_path / "rows").glob("*.json")) == ["a b%.json", "a-b.json"] and not (tmp_path / "rows.tmp").exists()
    assert json.loads((tmp_path / "rows" / "a-b.json").read_text()) == {"x": 1} and json.loads((tmp_path / "rows" / "a b%.json").read_text()) == {"x": None}
    assert {r.stem: r.x for r in io.read_json_folder(spark, str(tmp_path / "rows"), "x int").collect()}["a-b"] == 1
    about = {"population": 3, "confidence": 0.95, "margin": 0.05, "p": 0.5, "z": 1.96, "seed": 1, "folder": "in"}
    assert io.write_sample(rows, rows.where("x = 1"), str(tmp_path / "sample"), about) == 1
    written = json.loads((tmp_path / "sample" / "manifest.json").read_text())
    assert (written["files"], written["sample_size"], written["population"]) == (["a-b.json"], 1, 3)
    assert [r.stem for r in io.read_json_folder(spark, str(tmp_path / "sample"), "x int").collect()] == ["a-b"]


def test_first_rows_and_stamp(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "row_no long")
    assert [[r.row_no for r in C.first_rows(df, n, zero=z).orderBy("row_no").collect()] for n, z in ((2, "all"), (0, "all"), (0, "none"), (9, "all"))] == [[1, 2], [1, 2, 3], [], [1, 2, 3]]
    from datetime import datetime, timezone

    said = datetime.fromisoformat(spark.range(1).select(C.utc_now().alias("t")).first().t)
    assert abs((datetime.now(timezone.utc) - said).total_seconds()) < 60 and said.microsecond == 0


def test_tokens_and_quota():
    from changeloom.sources import remote as W

    def fails():
        raise OSError("no client")

    assert [W.token({"GITHUB_TOKEN": " a "}, fails), W.token({}, lambda: "b\n"), W.token({}, lambda: "\n"), W.token({}, fails)] == ["a", "b", None, None]
    assert W.with_token("a")["Authorization"] == "Bearer a" and "Authorization" not in W.with_token(None)
    waits = []
    answer = lambda left: lambda u, h: (200, {"x-ratelimit-remaining": left, "x-ratelimit-reset": "0"}, "[]")
    assert [W.fetch("http://x", {}, answer(n), waits.append)[1] for n in ("50", "49")] == ["[]", "[]"] and waits == [5]


def test_a_lenient_listing_keeps_what_it_has(monkeypatch):
    from pyspark.sql.datasource import InputPartition
    from pyspark.sql.types import StringType, StructField, StructType

    from changeloom.sources import remote as W

    def broken(*_):
        yield {"name": "main"}
        raise RuntimeError("no answer")

    monkeypatch.setattr(W, "pages", broken)
    schema = StructType([StructField("key", StringType()), StructField("name", StringType())])
    read = lambda **more: list(W.PagedReader(schema, {"url": "http://x/{key}", **more}).read(InputPartition("f")))
    assert read(lenient="true") == [("f", "main")]
    with pytest.raises(RuntimeError):
        read()
