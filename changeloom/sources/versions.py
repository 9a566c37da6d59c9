"""Tables that are replaced as a whole: folders of rows, and one pointer that says which of them is the table.

``path/rows-<id>`` holds a version's rows and ``path/_versions/<number>`` names it. A version is published by creating the file of
the next number, which only one writer can do, and which counts once its line is complete; readers take the greatest number
that does. So a crash at any step leaves the old rows or the new ones under the same name, for every reader, with no call
that would have to mend anything. Rows and pointers before the last ``keep`` versions go when a later one is published.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class ConflictError(Exception):
    """Another writer has published a version since the one that rows were made from."""


def _system(spark: SparkSession, path: str):
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark._jsc.hadoopConfiguration()), to


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str | None]]:
    """(number, folder) of all versions, the latest first; the folder is None where the line isn't complete."""
    fs, to = _system(spark, path)
    folder = to(f"{path}/_versions")
    if not fs.exists(folder):
        return []
    out = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.isdigit():
            with_line = fs.open(status.getPath())
            line = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(with_line)).decode()
            with_line.close()
            out.append((int(name), line[:-1] if line.endswith("\n") else None))
    return sorted(out, reverse=True)


def version(spark: SparkSession, path: str) -> int:
    """The number of the latest complete version, 0 if there is none."""
    return next((n for n, folder in _pointers(spark, path) if folder), 0)


def read_version(spark: SparkSession, path: str, schema: str, form: str = "json", number: int | None = None) -> DataFrame:
    """The rows of the latest version, or of the one with this number; none where nothing has been published."""
    folder = next((f for n, f in _pointers(spark, path) if f and number in (None, n)), None)
    if folder is None:
        if number:
            raise ValueError(f"{path} has no version {number}")
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(form).load(f"{path}/{folder}")


def publish(spark: SparkSession, path: str, folder: str, after: int | None = None) -> int:
    """Make a folder below ``path`` its latest version; gives the number. Raises if another one came after version ``after``."""
    fs, to = _system(spark, path)
    fs.mkdirs(to(f"{path}/_versions"))
    while True:
        known = _pointers(spark, path)
        latest = next((n for n, f in known if f), 0)
        if after is not None and latest != after:
            raise ConflictError(f"{path} has version {latest}; the rows were made from {after}")
        number = max([n for n, _ in known], default=0) + 1
        try:
            out = fs.create(to(f"{path}/_versions/{number:012d}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            continue  # another writer was faster
        out.write(bytearray(f"{folder}\n".encode()))
        out.close()
        return number


def replace_rows(df: DataFrame, path: str, form: str = "json", after: int | None = None, keep: int = 2) -> int:
    """Replace the table at ``path`` by ``df``, which may have been read from it; gives the new version's number.

    With ``after``, the number of the version that ``df`` was made from, another writer's version in between raises.
    """
    spark, folder = df.sparkSession, f"rows-{uuid.uuid4().hex}"
    df.write.format(form).save(f"{path}/{folder}")
    number = publish(spark, path, folder, after)
    fs, to = _system(spark, path)
    for n, old in [x for x in _pointers(spark, path) if x[0] <= number][keep:]:
        if old:
            fs.delete(to(f"{path}/{old}"), True)
        fs.delete(to(f"{path}/_versions/{n:012d}"), False)
    return number
