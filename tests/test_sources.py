"""Data sources and sinks of the library: what they push, stage, publish and take up again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from changeloom.sources import comparisons as Q
from changeloom.sources import files, io
from changeloom.sources import versions as V
from changeloom.streaming import resume


def requests(n=60):
    rng = random.Random(3)
    out = []
    for i in range(n):
        files = [{"filename": rng.choice(["s/", "docs/"]) + f"f{k}", "status": "modified", "additions": k, "deletions": 0, "patch": "@@"} for k in range(rng.randrange(3))]
        body = json.dumps({"ahead_by": i, "behind_by": 0, "merge_base_commit": {"sha": "m"}, "commits": [{"sha": f"c{i}", "commit": {"message": "é"}}], "files": files})
        out.append((f"u{i % 3}", None if i == 7 else f"o{i % 5}", f"b{i}", "main", rng.choice(["s/", "", None]), None if i % 4 == 0 else body))
    return out


KIND = "upstream string, fork_owner string, fork_branch string, base string, prefix string, body string"


def test_comparisons_filter_while_reading(spark, tmp_path, capsys):
    rows = requests()
    path = f"file://{tmp_path}/requests"
    Q.stage(spark.createDataFrame(rows, KIND).repartition(3), path, per_file=7)
    df = Q.read_comparisons(spark, path)
    every = {r.fork_branch: r for r in df.collect()}
    for u, o, b, base, prefix, body in rows:
        files = [f["filename"] for f in json.loads(body)["files"] if f["filename"].startswith(prefix or "")] if body else []
        r = every[b]
        assert (r.upstream, r.fork_owner, r.base, r.prefix) == (u, o, base, prefix)
        assert (r.status, [f.filename for f in r.files]) == ("not_found" if not body else "ok" if files else "no_diff", files)
        assert (r.head_sha, r.merge_base_sha) == ((f"c{b[1:]}", "m") if body else (None, None))
    tests = ["status = 'ok'", "status != 'ok' and upstream = 'u1'", "upstream in ('u1', 'u2') and fork_owner is null", "fork_owner <=> null", "not (status in ('ok', 'no_diff'))", "ahead_by > 20 and status = 'ok'", "fork_owner != 'o1'", "prefix is not null and status = 'no_diff'"]
    for t in tests:
        kept = {r.fork_branch for r in spark.createDataFrame(list(every.values()), df.schema).where(t).collect()}
        assert {r.fork_branch for r in df.where(t).collect()} == kept, t
    df.where("status = 'ok' and upstream = 'u1'").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(status), IsNotNull(upstream), EqualTo(status,ok), EqualTo(upstream,u1)]" in plan and "Filter [" not in plan


def test_comparisons_ask_only_for_what_passes(spark, tmp_path):
    import http.server
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = json.dumps({"files": [{"filename": "s/x"}]}).encode()
            self.send_response(404 if "gone" in self.path else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = [("u", "a", "x y", "main", "", None), ("u", "b", "gone", "main", "", None), ("v", "c", "z", "main", "", None)]
    path = f"file://{tmp_path}/requests"
    Q.stage(spark.createDataFrame(rows, KIND), path)
    df = Q.read_comparisons(spark, path, url=f"http://127.0.0.1:{server.server_port}/{{upstream}}/{{base}}...{{fork_owner}}:{{fork_branch}}")
    assert {(r.fork_branch, r.status) for r in df.where("upstream = 'u'").collect()} == {("x y", "ok"), ("gone", "not_found")}
    assert sorted(asked) == ["/u/main...a:x%20y", "/u/main...b:gone"]
    server.shutdown()


def test_comparisons_of_nothing(spark, tmp_path):
    Q.stage(spark.createDataFrame([], KIND), f"file://{tmp_path}/none")
    assert Q.read_comparisons(spark, f"file://{tmp_path}/none").collect() == []


def test_a_file_for_each_row(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    rows = spark.range(20_000).select(F.concat(F.lit("é "), F.col("id").cast("string")).alias("stem"), "id", F.lit(None).cast("string").alias("none"))
    assert io.write_per_row(rows.unionByName(rows.limit(5)), path) == 20_000
    assert json.loads((tmp_path / "rows" / "é 7.json").read_text()) == {"id": 7, "none": None}
    assert len(list((tmp_path / "rows").glob("*.json"))) == 20_000 and not list((tmp_path / "rows" / "_staged").iterdir())
    io.write_per_row(rows.limit(1).withColumn("id", F.lit(-1)), path)
    assert json.loads((tmp_path / "rows" / "é 0.json").read_text())["id"] == -1 and len(list((tmp_path / "rows").glob("*.json"))) == 20_000
    assert io.write_per_row(rows.limit(0), path) == 0


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.lit("a/b")).otherwise(F.col("id").cast("string")).alias("stem"), "id")
    with pytest.raises(Exception, match="name of a file"):
        io.write_per_row(bad.repartition(4), path)
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == []


def test_a_commit_is_taken_up_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/rows"
    rows = spark.range(50).select(F.col("id").cast("string").alias("stem"), F.col("id").cast("string").alias("value"))
    moved = files.publish
    monkeypatch.setattr(files, "publish", lambda *_: 0)  # the driver is lost after the commit
    files.write_files(rows, path)
    assert not list((tmp_path / "rows").glob("*.json"))
    (tmp_path / "rows" / "_staged" / "open").mkdir()  # a job that was never committed
    (tmp_path / "rows" / "_staged" / "open" / "0-0").mkdir()
    (tmp_path / "rows" / "_staged" / "open" / "0-0" / "no.json").write_text("")
    monkeypatch.setattr(files, "publish", moved)
    assert moved(spark, path) == 50 and moved(spark, path) == 0
    assert sorted(int(p.stem) for p in (tmp_path / "rows").glob("*.json")) == list(range(50))


def test_versions(spark, tmp_path):
    path, kind = f"file://{tmp_path}/t", "id long"
    assert V.read_version(spark, path, kind).collect() == [] and V.version(spark, path) == 0
    rows = lambda: sorted(r.id for r in V.read_version(spark, path, kind).collect())
    for n in range(1, 6):
        assert V.replace_rows(spark.range(n), path) == n
        assert rows() == list(range(n))
    assert V.replace_rows(V.read_version(spark, path, kind).where("id > 2"), path, after=5) == 6  # from itself
    assert rows() == [3, 4] and sorted(r.id for r in V.read_version(spark, path, kind, number=5).collect()) == list(range(5))
    assert len(list((tmp_path / "t").glob("rows-*"))) == 2
    with pytest.raises(V.ConflictError):
        V.replace_rows(spark.range(1), path, after=5)
    with pytest.raises(ValueError):
        V.read_version(spark, path, kind, number=99)
    assert rows() == [3, 4]


def test_versions_after_a_crash_at_any_step(spark, tmp_path, monkeypatch):
    path, kind = f"file://{tmp_path}/t", "id long"
    rows = lambda: sorted(r.id for r in V.read_version(spark, path, kind).collect())
    V.replace_rows(spark.range(2), path)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # rows are written, nothing is published
        m.setattr(V, "publish", lost)
        with pytest.raises(RuntimeError):
            V.replace_rows(spark.range(5), path)
    assert rows() == [0, 1]
    (tmp_path / "t" / "_versions" / "000000000002").write_text("rows-cut")  # the pointer is made, its line isn't complete
    assert rows() == [0, 1] and V.version(spark, path) == 1
    assert V.replace_rows(spark.range(3), path, after=1) == 3 and rows() == [0, 1, 2]
    with monkeypatch.context() as m:  # published; what is old isn't removed
        made = V.publish
        m.setattr(V, "publish", lambda *a: made(*a) and lost())
        with pytest.raises(RuntimeError):
            V.replace_rows(spark.range(4), path)
    assert rows() == [0, 1, 2, 3]


def test_two_writers_of_a_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    V.replace_rows(spark.range(1), path)
    seen, other = V._pointers, tmp_path / "t" / "_versions" / "000000000002"

    def pointers(*a):
        found = seen(*a)
        if not other.exists():  # another writer publishes between the look and the act
            other.write_text("rows-other\n")
        return found

    monkeypatch.setattr(V, "_pointers", pointers)
    assert V.publish(spark, path, "rows-mine") == 3


LISTINGS = {"a": 430, "b": 0, "c": 1, "d": 200, "none": None}


@pytest.fixture
def listings():
    """A server of paged listings, and the pages that were asked for."""
    import http.server
    import threading
    from urllib.parse import parse_qs, urlsplit

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            key, page = urlsplit(self.path).path[1:], int(parse_qs(urlsplit(self.path).query)["page"][0])
            asked.append((key, page))
            size = LISTINGS[key]
            self.send_response(404 if size is None else 200)
            last = -(-(size or 0) // 100)
            if page < last:
                self.send_header("Link", f'<http://x/{key}?per_page=100&page={page + 1}>; rel="next", <http://x/{key}?per_page=100&page={last}>; rel="last"')
            self.end_headers()
            self.wfile.write(json.dumps([{"id": i} for i in range((page - 1) * 100, min(size or 0, page * 100))]).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{{key}}", asked
    server.shutdown()


def test_a_listing_goes_on_where_it_stopped(spark, tmp_path, listings):
    from changeloom.sources import remote

    url, asked = listings
    spark.dataSource.register(remote.PagedSource)
    out, expected = [], sorted((k, i) for k, n in LISTINGS.items() for i in range(n or 0))

    def run(stop_after):
        seen = []

        def put(df, n):
            rows = [(r.key, int(r.id)) for r in df.collect()]
            if len(seen) == stop_after:
                raise RuntimeError("lost")
            seen.append(n)
            done = {m for m, _ in out}
            if n not in done:  # a batch may be run again
                out.append((n, rows))

        stream = spark.readStream.format("paged").schema("key string, id string").options(url=url, keys=json.dumps(list(LISTINGS)), pages="2", state=f"file://{tmp_path}/state").load()
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"file://{tmp_path}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for stop_after in (1, 0, 2):
        with pytest.raises(Exception, match="lost"):
            run(stop_after)
    run(100)
    assert sorted(x for _, rows in out for x in rows) == expected
    assert max(len({k for k in rows}) for _, rows in out) <= 200
    before = len(asked)
    run(100)  # nothing is left: only the last listing is looked at again
    assert len(asked) - before <= 2 and sorted(x for _, rows in out for x in rows) == expected


def test_last_page():
    from changeloom.sources import remote as W

    answer = lambda headers, body: lambda *_: (200, headers, json.dumps(body))
    assert W.last_page("u", {}, None, answer({"link": '<http://x?per_page=100&page=2>; rel="next", <http://x?per_page=100&page=147>; rel="last"'}, [])) == 147
    assert W.last_page("u", {}, None, answer({}, [{}])) == 1 and W.last_page("u", {}, 150, answer({}, {"total_count": 999})) == 2
    assert W.last_page("u", {}, None, answer({}, {"total_count": 0, "items": []})) == 0 and W.last_page("u", {}, None, lambda *_: (404, {}, "")) == 0


def test_keys_are_kept_in_a_state_store(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    spark.createDataFrame([(1, "a", "old")], "k long, l string, v string").write.parquet(str(sink))

    def run(name, rows):
        (source / f"{name}.json").write_text("".join(json.dumps(dict(zip("klv", r, strict=True))) + "\n" for r in rows))
        resume.incremental(spark, str(source), str(sink), str(tmp_path / "checkpoint"), "k long, l string, v string", ["k", "l"], lambda df: df.where("v != 'no'")).awaitTermination()

    rows = lambda: sorted((tuple(r) for r in spark.read.parquet(str(sink)).collect()), key=repr)
    run("1", [(1, "a", "x"), (1, "b", "y"), (1, "b", "x"), (2, None, "z"), (None, None, "n"), (5, "c", "no")])
    first = [(1, "a", "old"), (1, "b", "x"), (2, None, "z"), (None, None, "n")]
    assert rows() == sorted(first, key=repr)
    kept = {p: p.read_bytes() for p in sink.glob("*.parquet")}
    for p in kept:
        p.write_bytes(b"no batch reads the sink")
    run("2", [(2, None, "again"), (1, "a", "again"), (None, None, "again"), (5, "c", "c"), (6, "d", "d")])
    for p, data in kept.items():
        p.write_bytes(data)
    assert rows() == sorted([*first, (5, "c", "c"), (6, "d", "d")], key=repr)


def test_a_batch_that_is_put_again(spark, tmp_path):
    for _ in range(2):
        resume.put(spark.range(10).repartition(3), 4, f"{tmp_path}/out")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(10))


def test_files_at_commits(spark, tmp_path):
    import subprocess

    from changeloom.sources import remote

    def git(*args):
        run = subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", str(tmp_path / "o" / "r"), *args], capture_output=True, text=True, check=True)
        return run.stdout.strip()

    (tmp_path / "o" / "r" / "s" / "x y").mkdir(parents=True)
    git("init", "-q")
    place = tmp_path / "o" / "r"
    shas = []
    for n, text in enumerate(["one\n", "zwei é", ""]):
        (place / "s" / "x y" / "SKILL.md").write_text(text)
        (place / "SKILL.md").write_text(f"root {n}")
        (place / "s" / "other.md").write_text("no")
        (place / "s" / f"SKILL{n}.md").write_text("no")
        git("add", "-A")
        git("commit", "-q", "-m", "m")
        shas.append(git("rev-parse", "HEAD"))
    commits = spark.createDataFrame([("o/r", s) for s in (*shas, shas[0])], "repo string, head_sha string")
    found = {(r.head_sha, r.path): r.text for r in remote.definitions_at(spark, str(tmp_path), commits).collect()}
    assert found == {(s, p): t for s, t, n in zip(shas, ["one\n", "zwei é", ""], range(3), strict=True) for p, t in (("s/x y/SKILL.md", t), ("SKILL.md", f"root {n}"))}
    assert [r.path for r in remote.definitions_at(spark, str(tmp_path), commits, prefix="s/").collect()] == ["s/x y/SKILL.md"] * 3
    assert remote.definitions_at(spark, f"file://{tmp_path}", commits.limit(0)).collect() == []
    with pytest.raises(Exception, match="can't be read"):
        remote.definitions_at(spark, str(tmp_path), spark.createDataFrame([("o/r", "--help")], "repo string, head_sha string")).collect()


def test_rules_and_repos_of_a_config(spark, tmp_path):
    from changeloom.operators import security as Z

    config = {"network_rules": [{"id": r.id, "name": r.name, "severity": r.severity, "patterns": list(r.patterns), "allowed_domains": list(r.allowed)} for r in Z.RULES if r.category == "network"], "own_rules": [{"id": "OWN1", "severity": "WARNING", "patterns": ["sudo"]}], "other": 1}
    (tmp_path / "rules.yaml").write_text(json.dumps(config))
    rules = io.rules_from(io.read_yaml(str(tmp_path / "rules.yaml")))
    assert [(r.id, r.category) for r in rules] == [(r.id, "network") for r in Z.RULES if r.category == "network"] + [("OWN1", "own")]
    assert rules[:2] == tuple(r for r in Z.RULES if r.category == "network")
    lines = spark.createDataFrame([(1, "wget x"), (2, "sudo y"), (3, "plain")], "id int, content string")
    assert {(r.id, r.rule, r.category) for r in Z.scan(lines, rules).collect()} == {(1, "NET001", "network"), (2, "OWN1", "own")}


def test_lines_are_added_and_searched_for(spark, tmp_path, capsys):
    path = str(tmp_path / "lines")
    for n in (1, 2):
        io.append_jsonl(spark.createDataFrame([(n, "é")], "a long, b string"), path)
    assert sorted(tuple(r)[:2] for r in io.read_jsonl(spark, path, "a long, b string").collect()) == [(1, "é"), (2, "é")]
    assert io.search_query("agents in:path", 20, 5) == "agents in:path stars:>=20 forks:>=5"
    io.listing(spark.createDataFrame([("x" * 60,)], "c string"))
    assert "x" * 60 in capsys.readouterr().out


def test_variants_of_a_folder(spark, tmp_path):
    for name, text in (("a", '{"k": [1, {"z": "é"}]}'), ("b", "no json"), ("c", "[]"), ("manifest", "{}")):
        (tmp_path / f"{name}.json").write_text(text)
    found = io.read_variants(spark, str(tmp_path)).select("stem", F.try_variant_get("value", "$.k[1].z", "string").alias("z"), F.col("value").isNull().alias("none")).collect()
    assert {tuple(r) for r in found} == {("a", "é", False), ("b", None, True), ("c", None, False)}
    assert io.read_variants(spark, str(tmp_path / "gone")).count() == 0


def test_time_matrix_and_blind_messages(spark):
    from datetime import datetime, timezone

    from changeloom.operators import clean as C
    from changeloom.operators import features as T

    said = spark.range(1).select(C.utc_now().alias("t")).first().t
    assert abs((datetime.now(timezone.utc) - datetime.fromisoformat(said)).total_seconds()) < 120 and said.endswith("+00:00") and "." not in said
    blind = T.message_inputs(spark.createDataFrame([("1", ["m"], ["truth"])], "modification_id string, msg array<string>, gt_labels array<string>"))
    assert blind.columns == ["modification_id", "msg"]
