"""Resumable streams: queues, block walks, audit tails, token buckets and event-time windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillgraph.operators.access import refill
from quillgraph.operators.ingest import block_walk, drain


def drain_queue(queue: DataFrame, work: Callable[[list[str]], None], checkpoint: str):
    """Runs work(repos) over each batch of a queue stream (seq, repo), a repo once, in order of first request."""

    def each(batch: DataFrame, _: int) -> None:
        work([r["repo"] for r in drain(batch).select("repo").toLocalIterator()])

    return queue.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def walk_blocks(blocks: DataFrame, watched: DataFrame, path: str, checkpoint: str):
    """Follows a block stream: checkpoints, events and orphans of each batch go to folders of their own under path.

    A batch is written under its number, and written over if it is run again, so nothing of the history is rewritten;
    `walked` reads the tables.  Of the stored checkpoints only those at or one before the batch's heights are read.
    """
    spark = blocks.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        found = block_walk(batch, watched, _at_heights(walked(spark, path, "checkpoints", number), batch))
        for name, rows in (("orphans", found["orphans"]), ("events", found["events"].select("number", "block", "tx", "address")), ("checkpoints", batch.select("number", "hash").dropDuplicates(["number"]))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return blocks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _at_heights(stored: DataFrame, batch: DataFrame) -> DataFrame:
    heights = batch.select(F.explode(F.array(F.col("number"), F.col("number") - 1)).alias("number")).distinct()
    return stored.join(heights, "number", "left_semi")


WALKED = {"checkpoints": "number long, hash string", "events": "number long, block string, tx string, address string", "orphans": "number long, orphan string, by string"}


def walked(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame:
    """A table of walk_blocks: of checkpoints the last one at a height, of the others each row once; before: only of batches before."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], WALKED[name])
    rows = spark.read.schema(f"{WALKED[name]}, batch long").parquet(f"{path}/{name}")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    if name == "checkpoints":
        return rows.groupBy("number").agg(F.max_by("hash", "batch").alias("hash"))
    return rows.drop("batch").dropDuplicates(["tx", "address"] if name == "events" else ["number", "orphan", "by"])


def audit_tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New records of an audit folder of JSON lines, as they come."""
    return spark.readStream.schema(schema).json(path)


def token_bucket(calls: DataFrame, burst: float, rate: float) -> DataFrame:
    """A stream of calls (principal, call_id, ts double, cost double) with whether each was let through."""

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (burst, None)
        for frame in frames:
            frame = frame.sort_values(["ts", "call_id"])
            allowed = []
            for ts, cost in zip(frame["ts"], frame["cost"], strict=True):
                level, last = refill(level, ts if last is None else last, ts, burst, rate), ts
                allowed.append(level >= cost)
                level -= cost if allowed[-1] else 0
            yield pd.DataFrame({"principal": key[0], "call_id": frame["call_id"], "allowed": allowed})
        state.update((level, last))

    kinds = dict(calls.dtypes)
    return calls.groupBy("principal").applyInPandasWithState(each, f"principal {kinds['principal']}, call_id {kinds['call_id']}, allowed boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout)


class _Bucket(StatefulProcessor):
    """A principal's bucket; its state goes once it is full again, since a new one is full too."""

    def __init__(self, burst: float, rate: float):
        self.burst, self.rate = burst, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("bucket", "level double, last double")

    def handleInputRows(self, key, rows, timerValues):
        level, last = tuple(self.held.get()) if self.held.exists() else (self.burst, None)
        calls = pd.concat(list(rows), ignore_index=True).sort_values(["seconds", "call_id"])
        allowed = []
        for ts, cost in zip(calls["seconds"], calls["cost"], strict=True):
            level, last = refill(level, ts if last is None else last, ts, self.burst, self.rate), ts
            allowed.append(bool(level >= cost))
            level -= cost if allowed[-1] else 0
        self.held.update((float(level), float(last)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((last + (self.burst - level) / self.rate) * 1000) + 1)
        yield pd.DataFrame({"principal": [key[0]] * len(calls), "call_id": calls["call_id"].tolist(), "allowed": allowed}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.clear()
        yield pd.DataFrame({"principal": [], "call_id": [], "allowed": []}, dtype=object)

    def close(self) -> None:
        """Nothing is held."""


def expiring_bucket(calls: DataFrame, burst: float, rate: float, late: str) -> DataFrame:
    """token_bucket with event-time timers: the state of a principal goes as soon as its bucket would be full again by the
    stream's watermark, which follows the calls' times by `late`.  What is let through is the same."""
    kinds = dict(calls.dtypes)
    timed = calls.select("principal", "call_id", F.col("ts").cast("double").alias("seconds"), F.col("cost").cast("double").alias("cost"), F.timestamp_seconds(F.col("ts").cast("double")).alias("at")).withWatermark("at", late)
    return timed.groupBy("principal").transformWithStateInPandas(_Bucket(burst, rate), f"principal {kinds['principal']}, call_id {kinds['call_id']}, allowed boolean", "append", "EventTime")


class _Walk(StatefulProcessor):
    """A chain's last checkpoints by height; heights beyond finality go."""

    def __init__(self, finality: int):
        self.finality = finality

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getMapState("points", "number long", "hash string")
        self.tip = handle.getValueState("tip", "number long")

    def handleInputRows(self, key, rows, timerValues):
        blocks = pd.concat(list(rows), ignore_index=True).sort_values(["number", "turn"])
        out = []
        tip = self.tip.get()[0] if self.tip.exists() else None
        for number, hash_, parent in zip(blocks["number"].tolist(), blocks["hash"], blocks["parent_hash"], strict=True):
            if tip is not None and number <= tip - self.finality:
                out.append((key[0], "late", number, hash_, None))
                continue
            old = self.points.getValue((number,))[0] if self.points.containsKey((number,)) else None
            if old == hash_:
                continue
            if old is not None:
                out.append((key[0], "orphan", number, old, hash_))
            before = self.points.getValue((number - 1,))[0] if self.points.containsKey((number - 1,)) else None
            if before is not None and before == parent:
                out.append((key[0], "spine", number, hash_, before))
            self.points.updateValue((number,), (hash_,))
            if tip is None or number > tip:
                for gone in range(number - self.finality if tip is None else tip - self.finality, number - self.finality + 1):
                    if self.points.containsKey((gone,)):
                        self.points.removeKey((gone,))
                tip = number
        if tip is not None:
            self.tip.update((tip,))
        yield pd.DataFrame(out, columns=["chain", "what", "number", "hash", "other"], dtype=object)

    def close(self) -> None:
        """Nothing is held."""


def walk_states(blocks: DataFrame, finality: int = 64) -> DataFrame:
    """A stream of (chain, what, number, hash, other) over a stream of blocks (chain, number, hash, parent_hash): `spine` where a
    block's parent is the checkpoint before it (other), `orphan` where another hash (other) comes at a checkpoint's height,
    `late` where a block lies below what is final.

    A chain's state are the checkpoints of its last `finality` heights; repeats tell nothing.  In a batch, blocks count by
    height, of one height in the order of the column `turn` where there is one.
    """
    turned = blocks if "turn" in blocks.columns else blocks.withColumn("turn", F.lit(0))
    rows = turned.select("chain", "number", "hash", "parent_hash", "turn")
    return rows.groupBy("chain").transformWithStateInPandas(_Walk(finality), f"chain {dict(blocks.dtypes)['chain']}, what string, number long, hash string, other string", "append", "None")


def windowed(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of an event stream (ts, event_type, value) by event-time window; late rows up to `late`."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(events: DataFrame, key: list[str], late: str) -> DataFrame:
    """A stream without repeats of a key within the watermark's delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


class ProgressLines(StreamingQueryListener):
    """Writes one JSON line for each start, batch and end of the session's streams to a writer, such as a file's write."""

    def __init__(self, write: Callable[[str], object]):
        self.write = write

    def _line(self, **fields) -> None:
        self.write(json.dumps(fields, separators=(",", ":")) + "\n")

    def onQueryStarted(self, event) -> None:
        self._line(event="started", stream=event.name, id=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._line(event="progress", stream=p.name, id=str(p.id), batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        """Nothing is told of idle streams."""

    def onQueryTerminated(self, event) -> None:
        self._line(event="failed" if event.exception else "done", id=str(event.id), error=event.exception)
