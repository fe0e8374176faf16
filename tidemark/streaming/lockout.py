"""Sign-in lockout as a stateful stream keyed by user name and by source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key_type string, key_value string, locked_at timestamp, locked_until timestamp, failures long"
STATE = "times array<timestamp>, counts array<long>, locked_until timestamp"


def _step(max_failures: int, window: pd.Timedelta, lockout: pd.Timedelta):
    def counted(frames: Iterator[pd.DataFrame]) -> dict[pd.Timestamp, tuple[int, bool]]:
        """Failures and whether there was a success, by time; frames are dropped one by one."""
        out: dict[pd.Timestamp, tuple[int, bool]] = {}
        for frame in frames:
            tally = frame.groupby(["ts", "outcome"]).size()
            for (ts, outcome), n in tally.items():
                failed, good = out.get(ts, (0, False))
                out[ts] = (failed + int(n), good) if outcome == "failure" else (failed, True)
        return out

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, counts, locked_until = state.get if state.exists else ([], [], None)
        recent = {pd.Timestamp(t): n for t, n in zip(times, counts)}
        locked_until = None if locked_until is None else pd.Timestamp(locked_until)
        events = counted(frames)
        out = []
        for ts in sorted(events):
            failed, good = events[ts]
            if failed:
                recent = {t: n for t, n in recent.items() if ts - t <= window}
                recent[ts] = recent.get(ts, 0) + failed
                total = sum(recent.values())
                if total >= max_failures and (locked_until is None or ts >= locked_until):
                    locked_until = ts + lockout
                    out.append((*key, ts, locked_until, total))
            if good:  # at one moment failures come first
                recent = {}
        state.update((list(recent), list(recent.values()), locked_until))
        state.setTimeoutTimestamp(int(max(
            (max(events) + window + lockout).timestamp() * 1000, state.getCurrentWatermarkMs() + 1)))
        if out:
            yield pd.DataFrame(out, columns=["key_type", "key_value", "locked_at", "locked_until", "failures"])

    return update


def stream_lockout(
    events: DataFrame, *, max_failures: int = 5, window_min: int = 15, lockout_min: int = 15,
    delay: str = "10 minutes",
) -> DataFrame:
    """One row per lockout of a user name or a source: enough failures inside the window since the last success.

    ``failures`` counts all of them. The source 'unknown' is no key. State holds a count per moment
    with failures inside the window, not the events.
    """
    update = _step(max_failures, pd.Timedelta(minutes=window_min), pd.Timedelta(minutes=lockout_min))
    source = F.col("source") if "source" in events.columns else F.lit("unknown")
    keys = F.array_compact(F.array(
        F.struct(F.lit("username").alias("key_type"), F.lower(F.trim("username")).alias("key_value")),
        F.when(source != "unknown", F.struct(F.lit("source").alias("key_type"), source.alias("key_value")))))
    timed = events.filter(F.col("outcome").isin("failure", "success")).select(
        F.explode(keys).alias("k"), F.col("ts").cast("timestamp").alias("ts"), "outcome",
    ).select("k.key_type", "k.key_value", "ts", "outcome").withWatermark("ts", delay)
    return timed.groupBy("key_type", "key_value").applyInPandasWithState(
        update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
