"""Streaming forms of the batch operators."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.aggregates import job_status
from ..operators.sequences import replay


def stream_job_status(jobs: DataFrame) -> DataFrame:
    """``job_status`` of a stream; write it in update or complete mode."""
    return job_status(jobs)


def stream_drift(positions: DataFrame, threshold: float = 150, tick: str = "200 milliseconds", late: str = "1 second") -> DataFrame:
    """(session_id, window, main, sub): ticks whose last positions lie more than ``threshold`` apart while both tracks play; late rows are dropped.

    ``positions``: session_id, track, ts, event_id, position, playing. The last row of a track in a
    tick, by ts and event_id, says where it is and whether it plays; a tick must hold rows of both.
    """
    at = F.struct("ts", "event_id")
    last = lambda t: F.max_by(F.struct("position", "playing"), F.when(F.col("track") == t, at)).alias(t)
    state = positions.withWatermark("ts", late).groupBy("session_id", F.window("ts", tick)).agg(last("main"), last("sub"))
    far = F.col("main.playing") & F.col("sub.playing") & (F.abs(F.col("main.position") - F.col("sub.position")) > threshold)
    return state.where(far).select("session_id", "window", F.col("main.position").alias("main"), F.col("sub.position").alias("sub"))


#: What ``stream_history`` keeps its state in; a session names it in spark.sql.streaming.stateStore.providerClass.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _History(StatefulProcessor):
    """Rows wait until the watermark has passed their time; then they are replayed in order on the history of their user."""

    def __init__(self, default: str | None):
        self.default = default

    def init(self, handle) -> None:
        self.handle = handle
        # Lists travel as one value each, for every value costs a message to the state store.
        self.history = handle.getListState("history", "keys binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for part in rows:
            ms = part["ts"].astype("datetime64[ms]").astype("int64")
            new += zip(ms.tolist(), part["seq"].tolist(), part["op"].tolist(), part["key"].tolist(), strict=True)
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
            self.handle.registerTimer(min(r[0] for r in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        rows = [r for x in self.waiting.get() for r in pickle.loads(x[0])]
        due = sorted(r for r in rows if r[0] < now)
        if not due:
            return
        later = [r for r in rows if r[0] >= now]
        if later:
            # The next timer is that of the first row which still waits.
            self.handle.registerTimer(min(r[0] for r in later) + 1)
            self.waiting.put([(pickle.dumps(later),)])
        else:
            self.waiting.clear()
        kept = [k for x in self.history.get() for k in pickle.loads(x[0])]
        before = kept or ([] if self.default is None else [self.default])
        ops = [(r[2], r[3]) for r in due]
        after = replay([("push", k) for k in before] + ops) if self.default is None else replay([("push", k) for k in before[1:]] + ops, self.default)
        if kept and after[: len(kept)] == kept:
            if after[len(kept) :]:
                self.history.appendValue((pickle.dumps(after[len(kept) :]),))
        elif after:
            self.history.put([(pickle.dumps(after),)])
        else:
            self.history.clear()
        yield pd.DataFrame({"user_id": [key[0]], "history": [after]})


def stream_history(ops: DataFrame, default: str | None = None, late: str = "1 second") -> DataFrame:
    """(user_id, history) of ops (user_id, seq, ts, op, key), in update mode: ``replay_history`` of a user's rows up to the watermark, in the order of ts and seq, whatever batch they came in.

    A row counts when the watermark, which is ``late`` behind the latest ts, has passed its ts; rows that come after that are dropped. The
    history and the rows that wait are kept in RocksDB (``ROCKS``), and new keys are added to a history without writing it anew.
    """
    schema = f"user_id {dict(ops.dtypes)['user_id']}, history array<string>"
    rows = ops.select("user_id", F.col("seq").cast("long").alias("seq"), "ts", "op", "key").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_History(default), schema, "Update", "eventTime")
