"""Event pipelines on Structured Streaming."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def event_source(spark: SparkSession, folder: str, table: str, files_per_batch: int = 8) -> DataFrame:
    """A stream over the Parquet files of a table with the table's own schema."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    glob = path if os.path.isdir(path) else os.path.dirname(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if not os.path.isdir(path):
        reader = reader.option("pathGlobFilter", os.path.basename(path))
    return reader.parquet(glob)


def transform_all(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        stream = stream.transform(step)
    return stream


def event_time(stream: DataFrame, column: str, late: str) -> DataFrame:
    """The event-time column as a timestamp with a watermark."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def window_counts(stream: DataFrame, ts: str, width: str, *keys: str, slide: str | None = None) -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    s = F.session_window(ts, gap)
    return stream.groupBy(s.alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def deduplicated(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First delivery of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there and return it as a table.

    Output and checkpoint are on shared storage; no row passes the driver.  In
    complete mode each batch replaces the table, in the others it adds to it.
    """
    spark = stream.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/stream-{name}-{os.urandom(6).hex()}"
    journaled(stream, f"{root}/out", f"{root}/state", mode=mode)
    return spark.read.schema(stream.schema).parquet(f"{root}/out/*")


def matched(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str) -> DataFrame:
    """Events of two streams joined on a key where the right one comes at or up to ``within`` after the left one.

    Both sides need watermarks; with the bound on the times Spark drops the
    state of events that can find no partner any more.
    """
    l, r = left.alias("l"), right.alias("r")
    near = F.expr(f"r.{right_time} >= l.{left_time} AND r.{right_time} <= l.{left_time} + INTERVAL {within}")
    return l.join(r, (F.col(f"l.{key}") == F.col(f"r.{key}")) & near)


def journaled(stream: DataFrame, path: str, checkpoint: str, process: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "append") -> None:
    """Exactly-once output by batch: each batch writes its own folder, so a repeated batch replaces itself.

    In complete mode every batch holds the whole result and all share one folder.
    """
    if mode == "update":
        raise ValueError("a table of files can not update rows")

    def commit(batch: DataFrame, batch_id: int) -> None:
        out = process(batch, batch_id) if process else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={0 if mode == 'complete' else batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fan_out(stream: DataFrame, sinks: Sequence[Callable[[DataFrame], None]], checkpoint: str) -> None:
    """One pass over each batch for several views."""

    def notify(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch)
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(notify).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def filtered_tail(stream: DataFrame, text: str, regex: bool = False, column: str = "value") -> DataFrame:
    return stream.where(F.col(column).rlike(text) if regex else F.contains(F.col(column), F.lit(text)))


def context_stacks(df: DataFrame, key: str, order: str, op: str, item: str, max_depth: int) -> DataFrame:
    """(key, order, depth, top): push / pop / clear events replayed per key with bounded depth.

    Replayed as a stream of partitions in order with a state per key, so no
    key's history is held.
    """
    import pandas as pd

    schema = df.select(key, order).schema.add("depth", "integer").add("top", "string")

    def replay(batches):
        stacks: dict = {}
        for pdf in batches:
            depth, top = [], []
            for k, o, x in zip(pdf[key], pdf[op], pdf[item]):
                if k not in stacks:
                    stacks = {k: []}
                s = stacks[k]
                if o == "push":
                    s.append(x)
                    del s[max_depth:]
                elif o == "pop" and s:
                    s.pop()
                elif o == "clear":
                    s.clear()
                depth.append(len(s))
                top.append(s[-1] if s else None)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "depth": pd.array(depth, "Int32"), "top": top})

    return df.select(key, order, op, item).repartition(key).sortWithinPartitions(key, order).mapInPandas(replay, schema)


def batches_of(df: DataFrame, order: str, size: int) -> DataFrame:
    """(batch, n, first, last): messages in order, in batches of bounded size."""
    from ..operators.ordinal import with_ordinal

    d = with_ordinal(df.select(order), order, start=0)
    return d.groupBy(F.expr(f"ordinal div {size}").alias("batch")).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def burst(df: DataFrame, ts: str, width: str, item: Column) -> DataFrame:
    """(start, items): what arrived in each window, coalesced."""
    return df.groupBy(F.window(F.col(ts).cast("timestamp"), width).alias("w")).agg(F.array_sort(F.collect_set(item)).alias("items")).select(F.col("w.start").alias("start"), "items")


def window_stats(stream: DataFrame, ts: str, width: str, value: str) -> DataFrame:
    """(start, mean, high): what a graph of the stream shows."""
    return stream.groupBy(F.window(ts, width).alias("w")).agg(F.avg(value).alias("mean"), F.max(value).alias("high")).select(F.col("w.start").alias("start"), "mean", "high")


def periodic(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 seconds"):
    """A running query that hands the sink a batch in a fixed rhythm; the caller stops it."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def await_or_stop(query, seconds: float) -> bool:
    """Wait so long for a running query; stop it and return False when time is up."""
    done = query.awaitTermination(seconds)
    if not done:
        query.stop()
    return bool(done)


def progress(spark: SparkSession, notify: Callable[[dict], None]):
    """Register a listener told of every batch and of the end; returns it so that it can be removed."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            notify({"kind": "started", "id": str(event.id)})

        def onQueryProgress(self, event):
            notify({"kind": "progress", "rows": event.progress.numInputRows, "batch": event.progress.batchId})

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            notify({"kind": "ended", "error": event.exception})

    listener = Listener()
    spark.streams.addListener(listener)
    return listener
