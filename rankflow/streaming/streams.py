"""Streams: incremental ingest, checkpoint snapshots, changed live matches, request windows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import DUMP
from ..sources.readers import duels_of, season_of
from ..sources.sinks import append_new


def ingest(spark: SparkSession, source: str, games_path: str, participants_path: str, checkpoint: str) -> StreamingQuery:
    """New dump files become rows once: each batch appends only keys that are not there yet, so a replayed batch adds nothing."""
    files = spark.readStream.schema(DUMP).option("multiLine", True).json(source)
    named = files.withColumn("path", F.col("_metadata.file_path")).withColumns({"season": season_of(F.col("path")), "source_file": F.element_at(F.split("path", "/"), -1)})

    def batch(df: DataFrame, _: int) -> None:
        games, players = duels_of(df)
        append_new(games, games_path, ["game_id"], "season")
        append_new(players, participants_path, ["game_id", "profile_id"])

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_counts(events: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window, replay, slot and kind; rows later than the watermark are dropped by it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "replay_id", "player_slot", "kind").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def cumulative_snapshots(events: DataFrame, minutes: int = 5, keep: str = "2 hours") -> DataFrame:
    """Running totals at each checkpoint: (replay_id, player_slot, kind, minute, events, value), in update mode.

    ``events`` has replay_id, player_slot, kind, time_s (since the start of the
    match), value and ts.  A checkpoint's row counts all events up to it, and
    comes again, corrected, if an event arrives late.  Checkpoints reach as far
    as the key's last event.  The state of a key (a count and a sum for each
    checkpoint with events) goes once nothing came for ``keep`` of event time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    length = int(pd.Timedelta(keep).total_seconds() * 1000)

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = {k: (n, v) for k, n, v in zip(*state.get, strict=True)} if state.exists else {}
        changed, latest = None, 0
        for frame in frames:
            at = (-(-frame["time_s"].clip(lower=0) // (60 * minutes))).astype(int).clip(lower=1)  # the checkpoint that ends at or after it
            for k, own in frame.groupby(at):
                n, v = seen.get(int(k), (0, 0.0))
                seen[int(k)] = (n + len(own), v + float(own["value"].fillna(0).sum()))
            changed = int(at.min()) if changed is None else min(changed, int(at.min()))
            latest = max(latest, int(frame["ts"].max().timestamp() * 1000))
        places = sorted(seen)
        state.update((places, [seen[k][0] for k in places], [seen[k][1] for k in places]))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + length)
        rows, n, v = [], 0, 0.0
        for k in range(1, places[-1] + 1):
            n, v = n + seen.get(k, (0, 0.0))[0], v + seen.get(k, (0, 0.0))[1]
            if k >= changed:
                rows.append((*key, k * minutes, n, v))
        yield pd.DataFrame(rows, columns=["replay_id", "player_slot", "kind", "minute", "events", "value"])

    known = events.withWatermark("ts", keep).select("replay_id", "player_slot", "kind", F.col("time_s").cast("double").alias("time_s"), F.col("value").cast("double").alias("value"), "ts")
    schema = "replay_id long, player_slot int, kind string, minute int, events long, value double"
    return known.groupBy("replay_id", "player_slot", "kind").applyInPandasWithState(each, schema, "at array<int>, n array<long>, v array<double>", "update", GroupStateTimeout.EventTimeTimeout)


def changed_matches(live: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (profile, match, start) once: what a poller would report as a change."""
    return live.withWatermark("polled_at", late).dropDuplicatesWithinWatermark(["profile_id", "match_id", "started_at"])


def requests_per_minute(requests: DataFrame, limit: int = 60, late: str = "2 minutes") -> DataFrame:
    """Requests of each client in sliding minutes, and whether that is over the limit."""
    counts = requests.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds", "10 seconds"), "client").agg(F.count("*").alias("n"))
    return counts.withColumn("limited", F.col("n") > limit)


class Refreshed:
    """A value that is loaded anew once it is older than ``ttl`` seconds; where that fails, the stale one is used."""

    def __init__(self, load: Callable[[], object], ttl: float, clock: Callable[[], float] = time.monotonic):
        self.load, self.ttl, self.clock = load, ttl, clock
        self.value, self.at, self.stale = None, None, False

    def get(self):
        now = self.clock()
        if self.at is None or now - self.at >= self.ttl:
            try:
                self.value, self.at, self.stale = self.load(), now, False
            except Exception:
                if self.at is None:
                    raise
                self.stale = True
        return self.value


def refreshed_scores(stream: DataFrame, load_dimension: Callable[[], DataFrame], score, sink, checkpoint: str, ttl: float = 0.0) -> StreamingQuery:
    """Score each batch against a dimension that is read anew after ``ttl`` seconds; if that fails, the last one is used."""
    dimension = Refreshed(load_dimension, ttl)

    def batch(df: DataFrame, number: int) -> None:
        sink(score(df, dimension.get()), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
