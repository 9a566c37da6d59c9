"""A file for each row, written by the tasks themselves and committed in two phases.

Tasks write their files below ``path/_staged/<job>/<attempt>/``. The commit is one small file there that names the attempts
that count; it is what decides. A job that fails leaves nothing: its folder goes. ``publish`` then moves the files of committed
jobs to ``path``, in parallel, which can be done again after a crash: what has been moved is skipped, and the next call for the
same path goes on with it. Nothing loops over files on the driver.

The file system is opened in the tasks, by URI (what pyarrow knows: local and mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's attempt."""

    folder: str


class FilesWriter(DataSourceWriter):
    """Writes ``stem`` and ``value`` as ``<stem>.json``."""

    def __init__(self, options):
        self.path, self.job = options["path"], options["job"]

    def _place(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, f"{root}/_staged/{self.job}"

    def write(self, iterator):
        system, place = self._place()
        folder = f"{place}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        system.create_dir(folder)
        for row in iterator:
            stem = row["stem"]
            if not stem or "/" in stem or stem in (".", ".."):
                raise ValueError(f"{stem!r} can't be the name of a file")
            with system.open_output_stream(f"{folder}/{stem}.json") as out:
                out.write(row["value"].encode())
        return Written(folder)

    def commit(self, messages):
        system, place = self._place()
        system.create_dir(place)
        with system.open_output_stream(f"{place}/_names") as out:
            out.write("\n".join(m.folder for m in messages if m).encode())
        system.move(f"{place}/_names", f"{place}/_committed")

    def abort(self, messages):
        system, place = self._place()
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class FilesSink(DataSource):
    """``df.write.format("file_for_each_row")`` with options path and job."""

    @classmethod
    def name(cls):
        return "file_for_each_row"

    def schema(self):
        return "stem string, value string"

    def writer(self, schema, overwrite):
        return FilesWriter(self.options)


def publish(spark: SparkSession, path: str) -> int:
    """Move the files of all committed jobs to ``path``; gives their number. A task moves those of one attempt."""
    system, root = fs.FileSystem.from_uri(path)
    if system.get_file_info(f"{root}/_staged").type != fs.FileType.Directory:
        return 0
    jobs = [j.path for j in system.get_file_info(fs.FileSelector(f"{root}/_staged")) if system.get_file_info(f"{j.path}/_committed").is_file]
    folders = [f for j in jobs for f in system.open_input_stream(f"{j}/_committed").read().decode().split("\n") if f]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, _ = fs.FileSystem.from_uri(path)
        for b in batches:
            moved = []
            for folder in b["folder"].to_pylist():
                found = here.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                for f in found:
                    here.move(f.path, f"{root}/{f.base_name}")
                moved.append(len(found))
            yield pa.record_batch([pa.array(moved, pa.int64())], ["n"])

    n = 0
    if folders:
        rows = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders))  # one for each task that wrote
        n = rows.mapInArrow(move, "n long").groupBy().sum("n").first()[0]
    for j in jobs:
        system.delete_dir(j)
    return n


def write_files(rows: DataFrame, path: str) -> int:
    """Write ``rows`` (stem, value), with distinct stems, as files in ``path``, over files of the same names; gives their number."""
    spark = rows.sparkSession
    spark.dataSource.register(FilesSink)
    publish(spark, path)  # what an earlier call has committed and not moved
    rows.select("stem", "value").write.format("file_for_each_row").option("path", path).option("job", uuid.uuid4().hex).mode("append").save()
    return publish(spark, path)
