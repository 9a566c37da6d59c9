"""Paged REST listings as a Spark data source, at once or as a stream, and checkouts of repositories as tables.

The source reads ``url`` page by page in one task for each of the ``keys`` that fill its ``{key}``; as a stream it reads each page in
a task of its own and goes on, after a stop or a crash, at the page where it was. The transport is a function
``(url, headers) -> (status, headers, text)``, so tests and other clients can put in their own.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Items of a page, most items of a search, tries, longest wait between them in seconds, requests to keep back.
PAGE, CAP, TRIES, LONGEST, SPARE = 100, 1000, 5, 60, 50
Transport = Callable[[str, dict], tuple[int, dict, str]]


def http(url: str, headers: dict) -> tuple[int, dict, str]:
    """Fetch over HTTP."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, ""


def token(env: dict | None = None, ask: Callable[[], str] | None = None) -> str | None:
    """Token for the API: from the environment, else what the command line client is logged in with, else none."""
    found = (os.environ if env is None else env).get("GITHUB_TOKEN", "").strip()
    if found:
        return found
    try:
        answer = ask() if ask else subprocess.run(["gh", "auth", "token"], capture_output=True, text=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return None
    return answer.strip() or None


def with_token(of: str | None) -> dict[str, str]:
    """Request headers, with a token where there is one."""
    return {"Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {of}"} if of else {})


def wait_for_quota(found: dict, sleep: Callable[[float], None]) -> None:
    """Sleep until the quota is renewed if few requests are left."""
    left, reset = found.get("x-ratelimit-remaining"), found.get("x-ratelimit-reset")
    if left and reset and int(left) < SPARE:
        sleep(max(int(reset) - int(time.time()), 0) + 5)


def fetch(url: str, headers: dict, transport: Transport = http, sleep: Callable[[float], None] = time.sleep) -> tuple[dict, str] | None:
    """Headers and text of a page; None if it isn't there (404, 422); raises after the last try."""
    for k in range(TRIES):
        status, found, text = transport(url, headers)
        if status == 200:
            wait_for_quota(found, sleep)
            return found, text
        if status in (404, 422):
            return None
        reset = found.get("x-ratelimit-reset")
        sleep(max(int(reset) - int(time.time()), 0) + 5 if reset and status in (403, 429) else min(2**k, LONGEST))
    raise RuntimeError(f"no answer after {TRIES} tries: {url}")


def page_url(url: str, n: int) -> str:
    """The address of page ``n`` of a listing."""
    return f"{url}{'&' if '?' in url else '?'}per_page={PAGE}&page={n}"


def pages(url: str, headers: dict, most: int | None = None, transport: Transport = http, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Items of a listing. It ends where no ``Link`` header names a next page; a search also at a short page or at the cap."""
    n, seen = 1, 0
    while most is None or seen < most:
        got = fetch(page_url(url, n), headers, transport, sleep)
        if got is None:
            return
        found = json.loads(got[1])
        items = found.get("items", []) if isinstance(found, dict) else found
        for item in items:
            if most is not None and seen >= most:
                return
            seen += 1
            yield item
        if (len(items) < PAGE) if isinstance(found, dict) else 'rel="next"' not in got[0].get("link", ""):
            return
        n += 1


class PagedReader(DataSourceReader):
    """Reads a listing for each key in a task of its own."""

    def __init__(self, schema, options):
        self.columns = schema.names
        self.url, self.keys = options["url"], json.loads(options.get("keys", '[""]'))
        self.most = int(options["most"]) if "most" in options else None
        self.headers = json.loads(options.get("headers", "{}"))
        self.lenient = options.get("lenient", "false") == "true"

    def partitions(self):
        return [InputPartition(k) for k in self.keys]

    def read(self, partition):
        try:
            for item in pages(self.url.replace("{key}", str(partition.value)), self.headers, self.most):
                yield (partition.value, *[None if item.get(c) is None else str(item[c]) for c in self.columns[1:]])
        except RuntimeError:
            if not self.lenient:
                raise


def last_page(url: str, headers: dict, most: int | None = None, transport: Transport = http, sleep: Callable[[float], None] = time.sleep) -> int:
    """The number of pages of a listing, from its first one: what ``Link`` says of the last, or a search's total; 0 if it isn't there."""
    got = fetch(page_url(url, 1), headers, transport, sleep)
    if got is None:
        return 0
    found = json.loads(got[1])
    if isinstance(found, dict):
        n = -(-int(found.get("total_count", len(found.get("items", [])))) // PAGE)
    else:
        named = re.search(r'[?&]page=(\d+)[^>]*>; rel="last"', got[0].get("link", ""))
        n = int(named[1]) if named else 1
    return n if most is None else min(n, -(-most // PAGE))


class PagedStream(DataSourceStreamReader):
    """Listings as a stream. An offset is the number of a batch; which pages a batch has is written to ``state`` before it is given out.

    So a batch that is run again has the same pages, and a reader that starts anew knows what has been given out, whatever the
    engine had noted of it: no page is read for two batches. ``pages`` is the number of pages of a batch.
    """

    def __init__(self, schema, options):
        self.columns, self.url = schema.names, options["url"]
        self.keys, self.headers = json.loads(options.get("keys", '[""]')), json.loads(options.get("headers", "{}"))
        self.most = int(options["most"]) if "most" in options else None
        self.size, self.state = int(options.get("pages", "100")), options["state"]
        self.lasts: dict[str, int] = {}

    def _batch(self, n: int) -> list[list] | None:
        """The (key, page) of batch n, None if it hasn't been given out."""
        system, root = fs.FileSystem.from_uri(self.state)
        if not system.get_file_info(f"{root}/{n}.json").is_file:
            return None
        with system.open_input_stream(f"{root}/{n}.json") as f:
            return json.loads(f.read())

    def _given(self) -> int:
        """The number of the last batch that has been given out."""
        system, root = fs.FileSystem.from_uri(self.state)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return max([int(f.base_name[:-5]) for f in found if f.base_name[:-5].isdigit()], default=0)

    def _next(self, key: str, page: int) -> list[list]:
        """The pages that follow a page in the order of keys, as many as a batch has."""
        out, at = [], self.keys.index(key) if key in self.keys else 0
        for k in self.keys[at:]:
            if k not in self.lasts:
                self.lasts[k] = last_page(self.url.replace("{key}", str(k)), self.headers, self.most)
            first = page + 1 if k == key else 1
            out += [[k, n] for n in range(first, self.lasts[k] + 1)][: self.size - len(out)]
            if len(out) == self.size:
                break
        return out

    def initialOffset(self):
        return {"batch": 0}

    def latestOffset(self):
        n = self._given()
        key, page = self._batch(n)[-1] if n else (self.keys[0] if self.keys else None, 0)
        batch = self._next(key, page)
        if not batch:
            return {"batch": n}
        system, root = fs.FileSystem.from_uri(self.state)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/_next") as out:
            out.write(json.dumps(batch).encode())
        system.move(f"{root}/_next", f"{root}/{n + 1}.json")
        return {"batch": n + 1}

    def partitions(self, start, end):
        return [InputPartition(tuple(x)) for n in range(start["batch"] + 1, end["batch"] + 1) for x in self._batch(n) or []]

    def read(self, partition):
        key, page = partition.value
        got = fetch(page_url(self.url.replace("{key}", str(key)), page), self.headers)
        found = json.loads(got[1]) if got else []
        left = PAGE if self.most is None else self.most - (page - 1) * PAGE
        for item in (found.get("items", []) if isinstance(found, dict) else found)[:left]:
            yield (key, *[None if item.get(c) is None else str(item[c]) for c in self.columns[1:]])

    def commit(self, end):
        pass  # what has been given out stays on record


class PagedSource(DataSource):
    """``spark.read.format("paged").schema("key string, full_name string, ...")`` with options url, keys, most, headers, lenient.

    A key that still fails after the last try raises, or, if lenient, yields the pages read so far. ``spark.readStream`` also takes
    ``state``, a folder for what has been given out, and ``pages``, the pages of a batch.
    """

    @classmethod
    def name(cls):
        return "paged"

    def reader(self, schema):
        return PagedReader(schema, self.options)

    def streamReader(self, schema):
        return PagedStream(schema, self.options)


def checkout_definitions(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(path, text) of the definition files below a checkout, read as whole files."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "SKILL.md").text(path, wholetext=True)
    relative = F.substring_index(F.col("_metadata.file_path"), path.rstrip("/").removeprefix("file://") + "/", -1)
    return files.select(relative.alias("path"), F.col("value").alias("text")).where(F.col("path").startswith(prefix))


class GitReader(DataSourceReader):
    """One (repository, commit) for each task, whose tree is listed once and whose blobs come from one process."""

    def __init__(self, options):
        self.commits = json.loads(options["commits"])
        self.root, self.name, self.prefix = options["root"].removeprefix("file://"), options.get("file", "SKILL.md"), options.get("prefix", "")

    def partitions(self):
        return [InputPartition(tuple(x)) for x in self.commits] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        repo, sha = partition.value
        if not re.fullmatch(r"[0-9a-f]{4,64}", sha) or ".." in repo.split("/"):
            raise ValueError(f"{repo} at {sha} can't be read")
        git = ["git", "-c", "safe.directory=*", "-C", os.path.join(self.root, repo)]
        listed = subprocess.run([*git, "ls-tree", "-r", "-z", sha], capture_output=True, check=True).stdout
        found = []
        for entry in listed.split(b"\0")[:-1]:
            about, path = entry.split(b"\t", 1)
            kind, blob = about.split()[1:3]
            place = path.decode(errors="replace")
            if kind == b"blob" and place.rsplit("/", 1)[-1] == self.name and place.startswith(self.prefix):
                found.append((place, blob))
        if not found:
            return
        with subprocess.Popen([*git, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
            for place, blob in found:  # asked and answered one by one, so neither side waits for a full pipe
                run.stdin.write(blob + b"\n")
                run.stdin.flush()
                size = int(run.stdout.readline().split()[2])
                text = run.stdout.read(size + 1)[:-1]
                yield (repo, sha, place, blob.decode(), text.decode(errors="replace"))
            run.stdin.close()


class GitSource(DataSource):
    """Files at commits: options root (a folder of clones), commits (JSON of (repository, commit)), file (the name), prefix."""

    @classmethod
    def name(cls):
        return "git_blobs"

    def schema(self):
        return "repo string, head_sha string, path string, blob string, text string"

    def reader(self, schema):
        return GitReader(self.options)


def definitions_at(spark: SparkSession, root: str, commits: DataFrame, prefix: str = "", file: str = "SKILL.md") -> DataFrame:
    """(repo, head_sha, path, blob, text) of the definition files of each commit, as they were at that commit.

    ``commits`` has (repo, head_sha), one row for each repository that is read, and goes through the driver, as partitions do. The
    clones lie below ``root``, a folder that the executors share; neither a checkout nor a working tree is needed.
    """
    spark.dataSource.register(GitSource)
    pairs = [list(r) for r in commits.select("repo", "head_sha").distinct().orderBy("repo", "head_sha").collect()]
    return spark.read.format("git_blobs").options(root=root, commits=json.dumps(pairs), prefix=prefix, file=file).load()
