"""What a channel remembers from frame to frame: the map of the frame before, and the profile that its first frame set.

frames: (channel long, frame_id long, at timestamp, patch array<int>, p array<double>, profile array<double>), a row a frame;
frame_id rises with `at`. Both forms give (channel, frame_id, patch, p, before, profile, dropped): `before` holds the
previous frame's p of each patch (null for patches it lacks, and for the first frame), `profile` is the first frame's.

In a stream frames wait until the watermark has passed their time and are then taken in order, so frames that come late or
shuffled give what the batch form gives. A frame that comes after one with a greater frame_id was taken is dropped;
`dropped` counts these so far for its channel (0 in the batch form). Of two frames with one frame_id the first taken stays.
Null channels, ids or times are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

FRAMES = "channel long, frame_id long, at timestamp, patch array<int>, p array<double>, profile array<double>"
OUT = "channel long, frame_id long, patch array<int>, p array<double>, before array<double>, profile array<double>, dropped long"
_WAITING = "frame_id long, at_ms long, patch array<int>, p array<double>, profile array<double>"
_FACTS = "last_frame long, last_ms long, profile array<double>, dropped long"


def packed_frames(patches: DataFrame, at: Column, profile: Column | None = None) -> DataFrame:
    """Frames as rows, from (channel, frame_id, patch, p); `at` and the profile (the mean p, if none is named) are aggregates."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("patch").cast("int").alias("patch"), F.col("p").cast("double").alias("p"))))
    d = patches.groupBy(F.col("channel").cast("long").alias("channel"), F.col("frame_id").cast("long").alias("frame_id"))
    d = d.agg(at.cast("timestamp").alias("at"), rows.alias("r"), (F.array(F.avg("p")) if profile is None else profile).alias("profile"))
    return d.select("channel", "frame_id", "at", F.col("r.patch").alias("patch"), F.col("r.p").alias("p"), "profile")


def _named(frames: DataFrame) -> DataFrame:
    return frames.where("channel is not null and frame_id is not null and at is not null")


def remember_batch(frames: DataFrame) -> DataFrame:
    """Each frame of a table with what its channel remembers."""
    w = Window.partitionBy("channel").orderBy("frame_id")
    d = _named(frames).dropDuplicates(["channel", "frame_id"])
    d = d.withColumns({"_last": F.lag(F.struct("patch", "p")).over(w), "profile": F.first("profile").over(w)})
    known = F.map_from_arrays(F.col("_last.patch"), F.col("_last.p"))
    before = F.transform("patch", lambda x: F.when(F.col("_last").isNotNull(), known[x]))
    return d.select("channel", "frame_id", "patch", "p", before.alias("before"), "profile", F.lit(0).cast("long").alias("dropped"))


class Memory(StatefulProcessor):
    """Waiting frames (list), the last map (map), and the last frame's number and time, the profile and the drops (value)."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.last = handle.getMapState("last", "patch int", "p double")
        self.facts = handle.getValueState("facts", _FACTS)

    def _facts(self) -> tuple:
        return self.facts.get() or (None, None, None, 0)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, last_ms, profile, dropped = self._facts()
        for some in rows:
            for r in some.itertuples():
                if last is not None and r.frame_id <= last:
                    dropped += 1
                    continue
                floats = lambda x: [float(v) for v in x]
                self.waiting.appendValue((int(r.frame_id), int(r.at_ms), [int(v) for v in r.patch], floats(r.p), floats(r.profile)))
                self.handle.registerTimer(int(r.at_ms) + 1)
        self.facts.update((last, last_ms, profile, dropped))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [x for x in held if x[1] < now], [x for x in held if x[1] >= now]
        last, last_ms, profile, dropped = self._facts()
        if self.idle_ms is not None and not held and last_ms is not None and last_ms + self.idle_ms < now:
            self.waiting.clear()
            self.last.clear()
            self.facts.clear()  # a channel that is heard again starts afresh
            return
        if not due:
            return
        out, known = [], dict((k[0], v[0]) for k, v in self.last.iterator()) if last is not None else {}
        for frame, at_ms, patch, p, own in due:
            if last is not None and frame <= last:
                dropped += 1
                continue
            profile = list(own) if profile is None else profile
            out.append((key[0], frame, list(patch), list(p), [known.get(x) if last is not None else None for x in patch], list(profile), dropped))
            known, last, last_ms = dict(zip(patch, p, strict=True)), frame, at_ms
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if out:
            self.last.clear()
            for x, v in known.items():
                self.last.updateValue((x,), (v,))
        self.facts.update((last, last_ms, profile, dropped))
        if self.idle_ms is not None and last_ms is not None:
            self.handle.registerTimer(last_ms + self.idle_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["channel", "frame_id", "patch", "p", "before", "profile", "dropped"])

    def close(self) -> None:
        pass


def remember_stream(frames: DataFrame, lateness: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """remember_batch for a stream of frames that come at most `lateness` after later ones.

    `idle_ms`: a channel without a frame for so long (in the frames' time) is forgotten. State is in the state store, which
    must be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    # the time goes on as a number: as a watermarked column Spark would drop late rows before they are counted
    d = _named(frames).withWatermark("at", lateness).select("channel", "frame_id", F.unix_millis("at").alias("at_ms"), "patch", "p", "profile")
    return d.groupBy("channel").transformWithStateInPandas(Memory(idle_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def temporal_change(remembered: DataFrame) -> DataFrame:
    """(channel, frame_id, patch, p, moved, profile, dropped) a patch: how far p moved from the frame before, 0..1 inside its
    frame; 0 in a first frame and where the frame before lacks the patch."""
    step = F.zip_with("p", "before", lambda a, b: F.coalesce(F.abs(a - b), F.lit(0.0)))
    d = remembered.withColumn("_step", step)
    low, high = F.array_min("_step"), F.array_max("_step")
    moved = F.transform("_step", lambda x: (x - low) / (high - low + F.lit(1e-8)))
    d = d.withColumn("r", F.explode(F.arrays_zip("patch", "p", moved.alias("moved"))))
    return d.select("channel", "frame_id", "r.patch", "r.p", "r.moved", "profile", "dropped")
