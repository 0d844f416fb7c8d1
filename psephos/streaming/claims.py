"""Idempotent claims over a stream of object events, one state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from psephos.operators.events import STALE_SECONDS, TTL_DAYS, Claim

OUT = "claim_key string, event_id long, outcome string, claims long"
STATE = "state string, since long, claims long"


def _claim(stale: int, ttl_days: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        claim = Claim(*state.get) if state.exists else Claim()
        rows = []
        for event in pd.concat(list(frames)).sort_values(["micros", "event_id"]).itertuples():
            free = claim.free(int(event.micros), stale, ttl_days)
            if free:
                claim = Claim(event.status, int(event.micros), claim.claims + 1)
            rows.append((key[0], int(event.event_id), "claimed" if free else "duplicate", claim.claims))
        state.update(tuple(claim))
        state.setTimeoutTimestamp(max(claim.since // 1000 + ttl_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["claim_key", "event_id", "outcome", "claims"])

    return run


def claim_stream(events: DataFrame, stale: int = STALE_SECONDS, ttl_days: int = TTL_DAYS, late: str = "1 day") -> DataFrame:
    """Outcome of each event of a stream (claim_key, micros, event_id, status).

    There is one writer for each key, so no optimistic check is needed; FAILED and stale keys may be
    claimed again, which a deduplication within a watermark would not allow.  A key's state goes once the
    watermark passes its expiry, so state is bounded by the keys of the last ``ttl_days``.  Events of one
    micro-batch are taken in time order whatever files they come from; one that comes in a later batch
    than a younger event of its key counts as of its own time, and one more than ``late`` behind the
    newest event is dropped.
    """
    timed = events.withColumn("at", F.timestamp_micros("micros")).withWatermark("at", late)
    return timed.groupBy("claim_key").applyInPandasWithState(_claim(stale, ttl_days), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
