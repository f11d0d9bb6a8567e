"""Streams: files in, aggregates and ordered folds with state for each key.

Rows of a key must reach the stream in order, across files; inside a micro-batch they are put in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.session import shared_folder
from lamina.streaming.analysis import checked


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over a table of the folder, with the table's schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def watchers(stream: DataFrame, *aggregates: Column, within: list[str] | None = None) -> DataFrame:
    """Several running aggregates in one pass, whole or for each key."""
    return checked(stream.groupBy(*within).agg(*aggregates) if within else stream.agg(*aggregates))


def folded(stream: DataFrame, key: str, order: list[str], step: Callable[[tuple, object], tuple[tuple, list[dict]]], start: tuple, state: str, out: str, held_open: Callable[[object, tuple], list[dict]] | None = None) -> DataFrame:
    """An ordered fold with state for each key: step gets (state, row) and gives the new state and rows to emit.

    Serves accumulators, iteration with early exit (a state that no longer changes) and positional grouping (a row on each change of key).
    held_open: gets (key, state) after a key's rows of each micro-batch and gives rows too, for what only the end of the stream would emit."""
    checked(stream)
    columns = [c.split()[0] for c in out.split(",")]

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        rows: list[dict] = []
        for row in pd.concat(list(pdfs)).sort_values(order, kind="stable").itertuples(index=False):
            now, emitted = step(now, row)
            rows += emitted
        held.update(tuple(now))
        if held_open:
            rows += held_open(k[0], now)
        yield pd.DataFrame(rows, columns=columns)

    return stream.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def runs(stream: DataFrame, key: str, order: list[str], begins: Callable[[tuple, object], bool], mark: Callable[[object], tuple], start: tuple, state: str) -> DataFrame:
    """Positional groups of each key's rows: (key, grp, n), also those still open, whose rows come again with each micro-batch; the longest counts.

    begins: whether a row begins a group, from the state after the row before it; mark: what the state keeps of a row; start, state: the marks
    before the first row, and their types."""
    kind = stream.schema[key].dataType.simpleString()

    def step(now: tuple, row) -> tuple[tuple, list[dict]]:
        *marks, grp, n = now
        if n and not begins(tuple(marks), row):
            return (*mark(row), grp, n + 1), []
        return (*mark(row), grp + 1, 1), ([{key: getattr(row, key), "grp": grp, "n": n}] if n else [])

    def held_open(k, now: tuple) -> list[dict]:
        return [{key: k, "grp": now[-2], "n": now[-1]}]

    return folded(stream, key, order, step, (*start, 0, 0), f"{state}, grp long, n long", f"{key} {kind}, grp long, n long", held_open)


def cancelled(stream: DataFrame, after: float = 0.0) -> dict[str, bool]:
    """Starts the stream without a sink's output, stops it, and says whether it ran before and after."""
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{shared_place(stream.sparkSession)}/progress").start()
    ran = query.isActive
    if after:
        query.awaitTermination(after)
    query.stop()
    return {"before": ran, "after": query.isActive}


def shared_place(spark: SparkSession) -> str:
    """A folder for a query's progress and results, below the shared folder."""
    return f"{shared_folder(spark)}/lamina-stream-{uuid.uuid4().hex}"


def run_now(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Takes all that the source has now, in micro-batches, and gives the result as a table.

    complete and update results come batch by batch through foreachBatch, of which the last complete one counts."""
    spark = stream.sparkSession
    place = shared_place(spark)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/progress").outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{place}/rows").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def event_windows(df: DataFrame, time: str, length: str, *aggregates: Column, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Extension: tumbling or sliding windows of event time, with a watermark for streams.  The engine's language has no such thing."""
    rows = df.withWatermark(time, late) if late else df
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.groupBy(window.alias("w")).agg(*aggregates).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")
