"""Metric points, log lines and conversations as streams. The same functions work on batch tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: After so long without a turn a conversation's state goes.
IDLE_MS = 3_600_000


def long_points(wide: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """key, value rows of wide gauges; nulls give no point."""
    return wide.unpivot(ids, values, "key", "value").where("value is not null")


def scalar(column: str) -> F.Column:
    """A metric text as double: booleans as 0 and 1, lists as the mean of their numbers, else null."""
    items = F.filter(F.transform(F.split(F.regexp_replace(column, r"^\s*\[|\]\s*$", ""), ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    mean = F.aggregate(items, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(items), F.lit(0))
    c = F.trim(F.col(column))
    return F.when(F.lower(c) == "true", 1.0).when(F.lower(c) == "false", 0.0).when(c.startswith("["), mean).otherwise(c.try_cast("double"))


def last_seen(rows: DataFrame, by: str, order: list[str], value: F.Column, name: str) -> DataFrame:
    """For each row the last non-null value so far."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def windowed(points: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Means and counts by event-time window and key; an extension, for streams with late points."""
    source = points.withWatermark("ts", late) if points.isStreaming else points
    return source.groupBy(F.window("ts", width), "key").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "key", "n", "mean")


def write_points(points: DataFrame, path: str, checkpoint: str):
    """Appends points in micro-batches of 1.5 s, exactly once by the checkpoint."""
    return points.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="1500 milliseconds").start()


def sse_events(lines: list[str]) -> Iterator[tuple[str | None, str, str]]:
    """(id, event, data) of server-sent lines: ids stick, data lines join, comments and empty events don't count."""
    last = None
    for filled, frame in groupby(lines, key=bool):  # frames are parted by empty lines
        fields = [(name, value.removeprefix(" ")) for name, _, value in (x.partition(":") for x in frame)] if filled else []
        of = {kind: [v for name, v in fields if name == kind] for kind in ("id", "event", "data")}
        last = of["id"][-1] if of["id"] else last
        if of["data"]:
            yield last, (of["event"] or ["message"])[-1], "\n".join(of["data"])


def server_events(bodies: DataFrame) -> DataFrame:
    """stream, pos, id, event, data of server-sent texts (stream, body), as expressions; see sse_events."""
    line = lambda frame, name: F.transform(F.filter(F.split(frame, "\n"), lambda x: x.rlike(f"^{name}(:|$)")), lambda x: F.regexp_replace(x, f"^{name}:? ?", ""))
    frames = bodies.select("stream", F.posexplode(F.split(F.regexp_replace("body", "\r\n?", "\n"), "\n\n+")).alias("pos", "frame"))
    parsed = frames.select("stream", "pos", F.try_element_at(line(F.col("frame"), "id"), F.lit(-1)).alias("own"), F.coalesce(F.try_element_at(line(F.col("frame"), "event"), F.lit(-1)), F.lit("message")).alias("event"), line(F.col("frame"), "data").alias("data"))
    sticky = F.last("own", ignorenulls=True).over(Window.partitionBy("stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))  # of one response
    return parsed.withColumn("id", sticky).where(F.size("data") > 0).select("stream", "pos", "id", "event", F.array_join("data", "\n").alias("data"))


def conversation_state(turns: DataFrame, searches: int = 2) -> DataFrame:
    """Streams turns (conv_id, turn, action: search, answer or invalid) through the agent's rules.

    Two invalid actions in a row, or anything but an answer after the last search, end a conversation with -0.5; an answer ends it; a search
    resets the count of invalid actions. Emits conv_id, turn, search_count, terminated, reward. Turns of a micro-batch
    are taken in order whatever Arrow batches they come in; a conversation without turns for an hour is forgotten.
    """

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        searched, invalid, done = state.get if state.exists else (0, 0, False)
        out = []
        for r in pd.concat(list(batches)).sort_values("turn").itertuples():  # of one conversation
            if done:
                break
            reward = 0.0
            if r.action == "search" and searched < searches:
                searched, invalid = searched + 1, 0
            elif r.action == "answer":
                done = True
            else:
                invalid += r.action != "search"
                done = invalid >= 2 or searched >= searches
                reward = -0.5 if done else 0.0
            out.append((key[0], r.turn, searched, done, reward))
        state.update((searched, invalid, done))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "search_count", "terminated", "reward"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, search_count int, terminated boolean, reward double", "searched int, invalid int, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
