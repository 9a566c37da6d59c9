"""Text, path and diff functions on hand-made cases."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from changeloom.functions import anonymize as A
from changeloom.functions import diffs as D
from changeloom.functions import paths as P
from changeloom.functions import text as X


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r["v"] for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


NOISE_CASES = [
    (None, "empty"), ("", "empty"), (" \n ", "empty"), ("Squashed commit of the following:\nx", "squashed"), ("Squashed 'a/' changes from 1..2", "squashed_subtree"),
    ("Merge pull request #12 from a/b", "merge_pr"), ("merge branch 'x'", "merge_branch"), ("Merge remote-tracking branch 'o/m'", "merge_branch"), ("Merge two things", "merge_other"),
    ("Merge upstream", None), ("Merged it", None), ("Revert \"x\"", "revert"), ("revert \"x\"", None), ("Release v1.2", "release_note"), ("v1.2.3", "release_note"), ("1.2.3x", "release_note"),
    ("Bump version to 2", "release_note"), ("Initial commit", "initial_commit"), ("initial commits", None), ("Update README", "update_readme"), ("Update readme.md", "update_readme"),
    ("Create using x", "create_using"), ("Created with y", "create_using"), ("Add a step", None), ("  Merge branch x  \nrest", "merge_branch"),
]


def test_noise(spark):
    # 1.2.3x: a word boundary can't follow 3, white space neither, so it isn't a release
    expected = [e if m != "1.2.3x" else None for m, e in NOISE_CASES]
    expected[[m for m, _ in NOISE_CASES].index("Merge upstream")] = None
    assert values(spark, [m for m, _ in NOISE_CASES], X.noise_class) == expected


def test_maintenance(spark):
    cases = {"Auto-sync now": "upstream_sync", "the catalog": "catalog_index", "counts": "catalog_index", "new CI job": "ci_workflow", "specific": None, "éci": None, "plugin": "plugin_manifest", "bump": "release_version", "Readme": "repo_docs", "uv lock": "dependency_config", "allowlist": "local_settings", "add step\nplugin": None, " ": "empty"}
    assert values(spark, list(cases), X.maintenance_class) == list(cases.values())


def test_trim_footers(spark):
    cases = {"a\n\nSigned-off-by: x\n\n\nb": "a\n\nb", "Fixes: 1": "", "see: it\nkeep See: this": "keep See: this", "🤖 Generated: x\ny": "y", " x ": "x", "a\n\n\n\nb": "a\n\nb"}
    assert values(spark, list(cases), X.trim_footers) == list(cases.values())


def test_lines_are_pythons(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029 ") for _ in range(rng.randint(0, 12))) for _ in range(800)]
    assert values(spark, texts, X.lines) == [t.splitlines() for t in texts]


def test_slug_and_labels(spark):
    assert values(spark, ["a/b", "//", "", "a b-", "x.y_z"], X.slug) == ["a-b", "x", "x", "a-b", "x.y_z"]
    assert values(spark, ["a, b", "(none)", None, "", " a ,,b "], X.label_list) == [["a", "b"], [], [], [], ["a", "b"]]


def test_redact(spark):
    cases = {
        "x ghp_" + "a" * 20 + " y": "x <REDACTED> y", "ghp_short": "ghp_short", "token: abc;d": "token=<REDACTED>;d", "API-KEY='q w": "API-KEY=<REDACTED> w", "my_token=1": "my_token=1",
        "/Users/ann/x": "<LOCAL_USER_PATH>/x", "/home/bo": "<LOCAL_USER_PATH>", "C:\\Users\\cy\\z": "<LOCAL_USER_PATH>\\z",
    }
    assert values(spark, list(cases), X.redact) == list(cases.values())


def snippet(text):
    """Redaction of a line, key by key."""
    secret = re.compile(r"api[_-]?key|token|password|secret", re.I)
    name = r"([A-Za-z_][A-Za-z0-9_-]*)"
    text = re.sub(rf"(['\"]){name}\1\s*:\s*(['\"])[^'\"]+\3", lambda m: f"{m[1]}{m[2]}{m[1]}: {m[3]}<redacted>{m[3]}" if secret.search(m[2]) else m[0], text)
    text = re.sub(rf"\b{name}\b\s*=\s*(['\"])[^'\"]+\2", lambda m: f"{m[1]}={m[2]}<redacted>{m[2]}" if secret.search(m[1]) else m[0], text)
    text = re.sub(rf"\b{name}\b\s*=\s*(?!['\"])[^\s;&]+", lambda m: f"{m[1]}=<redacted>" if secret.search(m[1]) else m[0], text)
    return re.sub(r"(Bearer\s+)[A-Za-z0-9._~+/=-]+", r"\1<redacted>", text, flags=re.I)


def test_redact_snippet(spark):
    rows = ["api_key = 'x'", "color = 'x'", "a=b&my_token=c;d", "{'password': 'p', \"name\": \"n\"}", "bearer abc.def", "SECRET=\"q\" token = t", "tokenize=1", "x = token=2"]
    assert values(spark, rows, X.redact_snippet) == [snippet(r) for r in rows]


def test_redact_snippet_lines(spark, tmp_path):
    from changeloom.plans.queries import QUERIES, document_lines

    texts = ["Plain words first.\nThen token = \"04dbebab91\" inside\n\nand color = 'x'", "one two Bearer ab.cd/ef== end\nnext {'my-secret': 'é q', \"name\": \"n\"}", "x\t= 1; API_KEY=q&b=c;password = p\r\nu = \"v\" and token='w' twice token='z'", "", "=\n'token' : \"\" token = é=1 'tokens'='a'"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.id, r.line): r.content for r in QUERIES["redact_snippet_lines"](spark, str(tmp_path)).collect()}
    expected = {(r.id, r.line): snippet(r.content) for r in document_lines(spark, str(tmp_path)).collect()}
    assert found == expected and {k for k, v in expected.items() if "<redacted>" in v} == {(0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (4, 1)}


def test_fixed4(spark):
    rows = [0.03125, 0.09375, 1234567.5, 2.0, 1 / 3, -0.5]
    assert values(spark, rows, X.fixed4, "double") == [f"{x:.4f}" for x in rows]


PATHS = {"SKILL.md": "SKILL.md", "a/SKILL.md": "SKILL.md", "README.md": "README.md", "scripts/x": "scripts", "x/docs/y": "references", "x/y": "additional directories", "conf.json": "configuration", "my-example.txt": "examples", "reference.txt": "references", "a.png": "assets", "run.sh": "scripts", "notes.txt": "additional files", "": "additional files", ".": "additional files", "agents/a": "agents/", "tests/a": "examples", "LICENSE.txt": "LICENSE.txt"}


def test_surfaces(spark):
    assert values(spark, list(PATHS), P.surface) == list(PATHS.values())


def test_paths(spark):
    assert values(spark, ["a/b/c", "c", "/a/b/"], P.parent) == ["a/b", ".", "a"]
    assert values(spark, ["x.env.example", ".env", "a.", "b.tar.gz"], P.suffix) == [".example", "", "", ".gz"]
    assert values(spark, ["a/b/c"], P.ancestors) == [["a", "a/b", "a/b/c"]]
    assert values(spark, ["", "docs/x", "readme.md", "x/readme.md", ".github/a"], P.is_maintenance) == [True, True, True, False, True]
    roots = values(spark, [["s/SKILL.md", "s/a/x", "t/y", "z"], ["r/x", "y"]], P.skill_roots, "array<string>")
    assert [sorted(r) for r in roots] == [["s", "t"], ["(root)", "r"]]
    assert values(spark, [["s/SKILL.md", "s/a/x", "t/y"]], P.file_relatives, "array<string>") == [["SKILL.md", "a/x", "y"]]


def test_assets(spark):
    roots = F.array(F.lit("my/skill"))
    rows = {"my/skill/a.md": True, "my/skill/a.png": False, "my/skill/bin": False, "my/skill/scripts/bin": True, "skills/x/y.py": True, "other/x.py": False, "skills/x.py": False, "docs/SKILL.md": False, "q/Skill.md": True, "my/skill/.env.example": True}
    assert values(spark, list(rows), lambda c: P.is_asset(c, roots)) == list(rows.values())


DIFF = "intro\n+before\n@@ -1 +1 @@ f\n a\n+b\n-c\n+++ x\n---\n@@ -5 +5 @@\n+d\n\\ No newline"


def test_block_and_hunk_lines(spark):
    (found,) = values(spark, [DIFF], D.block_lines)
    assert [(r.line, r.block, r.role, r.content) for r in found] == [(2, 0, "added", "before"), (4, 0, "context", "a"), (5, 0, "added", "b"), (6, 0, "removed", "c"), (10, 1, "added", "d")]
    (found,) = values(spark, [DIFF], D.hunk_lines)
    assert [r.block for r in found] == [0, 1, 1, 1, 2]


def test_patch_round_trip(spark):
    kind = "array<struct<filename string, previous_filename string, status string, additions bigint, deletions bigint, patch string>>"
    rows = [[("a.md", None, "modified", 1, 2, "@@\n+x"), ("b c.md", "old.md", "renamed", None, None, None)]]
    (patch,) = values(spark, rows, D.patch, kind)
    assert patch == "diff --git a.md a.md  [modified +1/-2]\n@@\n+x\ndiff --git old.md b c.md  [renamed +0/-0]"
    (files,) = values(spark, ["junk\n" + patch], D.files)
    assert [(f.path, f.status, f.diff) for f in files] == [("a.md", "modified", "@@\n+x\n"), ("b c.md", "renamed", "")]
    assert values(spark, ["diff --git a b a b  [added +1/-0]"], D.paths) == [["b a b"]]  # headers don't quote


@pytest.mark.parametrize("diff,hit", [(" ---\n+description: x\n ---", True), (" ---\n name: x\n+description_cn: y\n ---\n", True), (" ---\n description: |\n+  more\n ---", True), (" ---\n description: x\n+name: y\n ---", False), (" ---\n name: x\n ---\n+description: z", False), ("+description: z", False), (" ---\n description: x\n ---", False)])
def test_touches_field(spark, diff, hit):
    assert values(spark, [diff], lambda c: D.touches_field(c, "description")) == [hit]


def test_headings(spark):
    text = "# One\nx\n```\n# no\n```\n### Three  \n#none\n~~~\n## in\n```\n####### seven\n## Two"
    (found,) = values(spark, [text], D.headings)
    assert [(h.level, h.text, h.line) for h in found] == [(1, "One", 1), (3, "Three", 6), (2, "Two", 12)]


def test_frontmatter(spark):
    assert values(spark, ["---\na: 1\n---\nx", "x\n---\na\n---\n", "---\na"], D.frontmatter) == ["a: 1", None, None]


def test_pseudonyms(spark):
    import hashlib
    import uuid

    space = uuid.UUID(bytes=hashlib.sha256(A.SALT.encode()).digest()[:16])
    ids = ["u/r::me::main", "u/r::you::main", "plain", "a::b", "é::ü::ß"]
    assert values(spark, ids, A.modification_id) == [str(uuid.uuid5(space, i)) if i.count("::") == 2 else i for i in ids]
    assert values(spark, ["x"], lambda c: A.digest(c, "sha")) == ["sha-" + hashlib.sha256(f"{A.SALT}:sha:x".encode()).hexdigest()[:12]]


def test_views(spark, tmp_path):
    diffs = spark.createDataFrame([("u/r", "ann", "main", "m1", None, [("s1", "token: abc"), ("", "/home/ann/x")], None)], "upstream string, fork_owner string, fork_branch string, merge_base_sha string, head_sha string, commits array<struct<sha string, message string>>, files array<struct<patch string>>")
    row = A.diff_view(diffs).first()
    assert row.fork_owner.startswith("fork-owner-") and row.merge_base_sha.startswith("sha-") and row.head_sha is None and row.files is None
    assert row.commits[0].sha.startswith("sha-") and row.commits[0].message == "token=<REDACTED>" and row.commits[1].sha == "" and row.upstream == "u/r"
    forks = spark.createDataFrame([("ann", "ann/ann-repo", "https://x/ann/ann-repo.git", 3)], "owner string, full_name string, clone_url string, size bigint")
    row = A.fork_view(forks).first()
    assert row.full_name == f"{row.owner}/ann-repo" and row.clone_url == f"https://x/{row.owner}/ann-repo.git" and row.size == 3
    assert A.release(forks, "forks", str(tmp_path / "out")) == 1 and spark.read.json(str(tmp_path / "out")).count() == 1


def test_frontmatter_fields(spark):
    texts = ["---\na: 1\nb: [x, é]\n---\nrest", "---\na: [\n---\n", "---\n- a\n---\n", "no block", None, "---\nwhen: 2024-01-02\n---\n", "---\n\n---\n", "---\n? {a: 1}\n: 2\n---\n"]
    assert values(spark, texts, D.frontmatter_fields) == ['{"a": 1, "b": ["x", "é"]}', "{}", "{}", "{}", "{}", '{"when": "2024-01-02"}', "{}", "{}"]


def plain_lines(diff, apart):
    """Lines of a diff with blocks and roles, one after the other."""
    out, block, head = [], -1, False
    for n, x in enumerate(diff.splitlines(), 1):
        is_head = x.startswith("@@")
        role = None if is_head or x.startswith(("+++", "---")) else {"+": "added", "-": "removed", " ": "context"}.get(x[:1])
        if is_head and (head or apart):
            block += 1
        elif is_head or (role and block < 0):
            block = max(block, 0)
        head |= is_head
        if role:
            out.append((n, block, role, x[1:]))
    return out


def plain_headings(text):
    """ATX headings outside fences."""
    out, fence = [], False
    for n, x in enumerate(text.splitlines(), 1):
        if re.match(r"\s*(```|~~~)", x):
            fence = not fence
        elif not fence and (m := re.fullmatch(r"(#{1,6})\s+(.+?)\s*", x)):
            out.append((len(m[1]), m[2], n))
    return out


def plain_files(text):
    """Files of a patch."""
    out = []
    for x in text.splitlines():
        if m := re.match(r"diff --git (.+?) (.+?)(?:  \[|$)", x):
            out.append([m[2].strip(), (re.search(r"\[(\w+)", x) or ["", ""])[1], ""])
        elif out:
            out[-1][2] += x + "\n"
    return [tuple(x) for x in out]


def test_lines_of_random_texts(spark):
    rng = random.Random(4)
    kinds = ["@@ -1 +1 @@", "+a", "-b", " c", "+++ x", "--- y", "", "# one", "## two ", "```", "~~~ x", "#no", "plain", "diff --git a.md b c.md  [modified +1/-2]", "diff --git a b", "+é"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(40))) + rng.choice(["", "\n"]) for _ in range(150)] + ["", "\n", "@@", "+x", "```\n# in\n```\n# out"]
    flat = lambda found: [[tuple(r) for r in x] for x in found]
    assert flat(values(spark, texts, D.block_lines)) == [plain_lines(t, False) for t in texts]
    assert flat(values(spark, texts, D.hunk_lines)) == [plain_lines(t, True) for t in texts]
    assert flat(values(spark, texts, D.headings)) == [plain_headings(t) for t in texts]
    assert flat(values(spark, texts, D.files)) == [plain_files(t) for t in texts]


def test_a_patch_of_a_million_lines(spark):
    lines = ["@@ -1 +1 @@", "+a", "-b", " c"]
    patch = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("id") + 1).cast("int")), lambda i: F.element_at(F.array(*map(F.lit, lines)), (i % 4 + 1).cast("int"))), "\n")

    def seconds(n):
        began = time.perf_counter()
        out = spark.range(n - 1, n).select(F.array_join(F.array("id"), ""), patch.alias("p")).select(D.block_lines(F.col("p")).alias("l")).select(F.size("l").alias("n"), F.element_at("l", -1)["line"].alias("last")).first()
        assert out.n == n * 3 // 4 and out["last"] in (n, n - 1)
        return time.perf_counter() - began

    seconds(1000)
    half, whole = seconds(500_000), seconds(1_000_000)
    assert whole < 4 * half + 2
