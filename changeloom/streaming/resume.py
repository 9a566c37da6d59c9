"""Incremental append with Structured Streaming: rows arrive as files, keys that are done are skipped, the rest is appended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.io import exists

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Lets one row of each key through, the least of the batch in which the key comes first; keys of the initial state are done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.done.exists():
            self.done.update((True,))
            yield min(rows, key=lambda r: [(v is not None, str(v)) for v in r])

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.done.update((True,))

    def close(self) -> None:
        pass


def put(rows: DataFrame, batch: int, sink: str) -> None:
    """Add a batch's rows to a folder of Parquet files, under names that the batch gives: a batch that is put again changes nothing."""
    spark = rows.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path
    staged, place = to(f"{sink}/_staged-{batch}"), to(sink)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").parquet(staged.toString())
    for n, file in enumerate(sorted(f.getPath().getName() for f in fs.listStatus(staged) if f.getPath().getName().startswith("part-"))):
        target = to(place, f"batch-{batch:09d}-{n:05d}.parquet")
        fs.delete(target, False)
        if not fs.rename(to(staged, file), target):
            raise OSError(f"{target} could not be put in its place")
    fs.delete(staged, True)


def incremental(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, key: list[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append rows of new files in ``source`` (JSON lines) to ``sink`` (Parquet), each key once; stops when none is left.

    Keys that are done are in a state store, which is looked up by key: what a batch costs doesn't grow with the sink. At the very
    first start the keys that the sink holds are taken into it. ``transform`` works row by row. A batch that is run again
    after a failure has the same state before it and puts the same rows, so it adds nothing.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = transform(spark.readStream.schema(schema).json(source))
    before = None
    if not exists(spark, checkpoint) and exists(spark, sink):
        before = spark.read.parquet(sink).select(*key).distinct().groupBy(*key)
    new = rows.groupBy(*key).transformWithState(FirstOfKey(), rows.schema, "Append", "None", before)
    return new.writeStream.outputMode("append").foreachBatch(lambda df, n: put(df, n, sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
