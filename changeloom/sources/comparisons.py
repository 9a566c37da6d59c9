"""Comparisons of branches with their base as a Spark data source that filters while it reads.

A request is a line of JSON (upstream, fork_owner, fork_branch, base, prefix) in a folder that Spark wrote (``stage``), so neither
requests nor answers go through the driver, and a task reads one file of them. Filters on the request's columns are dealt with
before anything is fetched, the prefix while files are read, and filters on ``status`` before a row is made. The answer is
the text of a comparison as the API gives it: in the request itself (``body``, as staged before), or fetched from the option
``url``, whose ``{base}`` and the like are filled in.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not

from .remote import fetch

#: The request's columns, and what is made of the answer.
REQUEST = ("upstream", "fork_owner", "fork_branch", "base", "prefix")
SCHEMA = (
    "upstream string, fork_owner string, fork_branch string, base string, prefix string, status string, ahead_by bigint, behind_by bigint, merge_base_sha string, head_sha string, "
    "commits array<struct<sha:string,message:string>>, files array<struct<filename:string,previous_filename:string,status:string,additions:bigint,deletions:bigint,patch:string>>"
)


def stage(requests: DataFrame, path: str, per_file: int = 1000) -> None:
    """Write requests as files of at most about ``per_file`` lines each; a task reads one file."""
    requests.write.option("maxRecordsPerFile", per_file).json(path)


def typed(request: dict, body: str | None) -> tuple:
    """A row of ``SCHEMA`` from a request and the answer's text, None where there is no such branch: then the row is a tombstone."""
    read = json.loads(body) if body else {}
    prefix = request.get("prefix") or ""
    files = [f for f in read.get("files") or [] if (f.get("filename") or "").startswith(prefix)]
    commits = [(c.get("sha"), (c.get("commit") or {}).get("message")) for c in read.get("commits") or []]
    status = "not_found" if not body else "ok" if files else "no_diff"
    of = ("filename", "previous_filename", "status", "additions", "deletions", "patch")
    return (
        *(request.get(c) for c in REQUEST), status, read.get("ahead_by"), read.get("behind_by"), (read.get("merge_base_commit") or {}).get("sha"),
        commits[-1][0] if commits else None, commits, [tuple(f.get(c) for c in of) for f in files],
    )


def test_of(f: Filter) -> tuple[str, Callable[[object], bool]] | None:
    """Column and test of a filter that this source can deal with, or None."""
    if isinstance(f, Not):
        inner = test_of(f.child)
        return inner and not isinstance(f.child, (EqualNullSafe, IsNull, IsNotNull)) and (inner[0], lambda v: v is not None and not inner[1](v)) or None
    if len(f.attribute) != 1 or f.attribute[0] not in (*REQUEST, "status"):
        return None
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return f.attribute[0], lambda v: v == f.value and (v is not None or isinstance(f, EqualNullSafe))
    if isinstance(f, In):
        return f.attribute[0], lambda v: v is not None and v in f.value
    if isinstance(f, (IsNull, IsNotNull)):
        return f.attribute[0], lambda v: (v is None) == isinstance(f, IsNull)
    return None


class ComparisonReader(DataSourceReader):
    """One file of requests for each task."""

    def __init__(self, options):
        self.path, self.url = options["path"], options.get("url")
        self.headers = json.loads(options.get("headers", "{}"))
        self.before: list[tuple[str, Callable]] = []
        self.after: list[Callable] = []

    def pushFilters(self, filters):
        for f in filters:
            found = test_of(f)
            if found is None:
                yield f
            elif found[0] == "status":
                self.after.append(found[1])
            else:
                self.before.append(found)

    def partitions(self):
        system, at = fs.FileSystem.from_uri(self.path)
        files = system.get_file_info(fs.FileSelector(at))
        return [InputPartition(f.path) for f in files if f.is_file and f.base_name.startswith("part-")] or [InputPartition(None)]

    def read(self, partition) -> Iterator[tuple]:
        if partition.value is None:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.value) as f:
            for line in f.read().splitlines():
                request = json.loads(line)
                if not all(test(request.get(c)) for c, test in self.before):
                    continue
                body = request.get("body")
                if body is None and self.url:
                    got = fetch(self.url.format(**{c: quote(str(request.get(c) or ""), safe="/") for c in REQUEST}), self.headers)
                    body = got and got[1]
                row = typed(request, body)
                if all(test(row[5]) for test in self.after):
                    yield row


class ComparisonSource(DataSource):
    """``spark.read.format("comparisons").option("path", ...)``, with options url and headers."""

    @classmethod
    def name(cls):
        return "comparisons"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ComparisonReader(self.options)


def read_comparisons(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Comparisons for the staged requests at ``path``; filters on the result are pushed into the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ComparisonSource)
    return spark.read.format("comparisons").options(path=path, **options).load()
