"""The pipeline against the decisions of its operators, one after the other."""

import os

import pytest

import corpus_pipeline as C
from changeloom.llm.common import written

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables aren't there")


def normal(t):
    return "".join(c for c in t if c not in " \t\n\x0b\x0c\r")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, seen = docs.columns, [docs]
    for name, stage in C.STAGES[:-1]:
        seen.append(written(stage(spark, seen[-1], DATA), name.replace(" ", "-")))
        assert seen[-1].columns == names
    raw, good, exact, near, mixed = ([(r.doc_id, r.text) for r in d.collect()] for d in seen)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids = {d for d, _ in good}
    assert sum(d in ids for d, _ in raw if labels.get(d) == 1) >= 0.98 * sum(labels.get(d) == 1 for d, _ in raw)
    assert sum(d in ids for d, _ in raw if labels.get(d) == 0) <= 0.2 * sum(labels.get(d) == 0 for d, _ in raw)
    assert sorted(map(normal, {normal(t): t for _, t in good})) == sorted(normal(t) for _, t in exact)

    def shingles(t):
        w = t.split()
        return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)])

    sets = {d: shingles(t) for d, t in exact}
    left = {d for d, _ in near}
    linked = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert not any(a in left and b in left for a, b in linked)
    assert all(any(d in p for p in linked) for d in set(sets) - left)
    assert {d for d, _ in mixed} == left
    pieces = C.run(spark, DATA).collect()
    assert sum(p.length for p in pieces) > 0 and {p.doc_id for p in pieces} == left


HARD = [
    *[(i, f"word{i % 7} and other words number {i} make a text that is long enough to be read by all stages " * 3) for i in range(40)],
    (None, None), (None, ""), (None, "a text without an id"), (None, "a text without an id"), (7, None), (7, ""), (8, " \n\t "), (9, "x"), (9, "x"), (9, "another text of nine"),
    (-(1 << 63), "the least id of all"), ((1 << 63) - 1, "the greatest id"), (100, "very long " * 60_000), (101, "very long " * 60_000 + "end"), (102, "<|endoftext|> stands here"),
]


@pytest.mark.parametrize("rows", [HARD, []], ids=["hard", "empty"])
def test_stages_of_hard_tables(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, tokens int, epoch string, hash int, run int, key string, gone string"
    docs = spark.createDataFrame([(d, t, None, ["hot", None][i % 5 == 0], None, "k", 1, "e", 2, 3, "z", "g") for i, (d, t) in enumerate(rows)], schema)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 1, None), (3, None, None), (1, 7, 0)] if rows else [], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    before = None
    for name, stage in C.STAGES[:-1]:
        out = written(stage(spark, seen, f"file://{tmp_path}"), name.replace(" ", "-"))
        assert out.schema == seen.schema and {r.row_key for r in out.collect()} <= {"k"}
        texts = {normal(r.text or "") for r in out.collect()}
        if name == "exact dedup":
            assert texts == before and out.count() == len(texts)
        if name == "mixing":
            assert texts == before
        seen, before = out, texts
    pieces = C.STAGES[-1][1](spark, seen, f"file://{tmp_path}").collect()
    kept = seen.collect()
    assert sum(p.start == 0 for p in pieces) == len(kept) and {p.doc_id for p in pieces} == {r.doc_id for r in kept}
    assert bool(kept) == bool(rows)
