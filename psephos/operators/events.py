"""Object events: newest of a batch, replay of idempotent claims, what is still to do."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_SECONDS, TTL_DAYS = 130, 7


def newest(events: DataFrame, order: Column, groups: list[str]) -> DataFrame:
    """The event of each batch whose order string is largest; the first one if equal."""
    names = [c for c in events.columns if c not in groups]
    best = F.max_by(F.struct(*names), F.struct(order.alias("o"), (-F.col("event_id")).alias("first")))
    return events.groupBy(*groups).agg(best.alias("_e")).select(*groups, "_e.*")


class Claim(NamedTuple):
    """What is known of a key: the status and time of its last claim, and how many there were."""

    status: str | None = None
    since: int = 0
    claims: int = 0

    def free(self, micros: int, stale: int, ttl_days: int) -> bool:
        """Whether an event may claim the key: none holds it, the last claim failed, expired, or is stale."""
        waited = micros - self.since
        stale_now = self.status == "IN_PROGRESS" and waited >= stale * 1_000_000
        return self.status is None or self.status == "FAILED" or stale_now or waited >= ttl_days * 86_400_000_000


def _replay(stale: int, ttl_days: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, claim = object(), Claim()
        for batch in batches:
            rows = []
            for key, micros, event, status in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    last, claim = key, Claim()
                free = claim.free(micros, stale, ttl_days)
                if free:
                    claim = Claim(status, micros, claim.claims + 1)
                rows.append((key, event, "claimed" if free else "duplicate", claim.claims))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "event_id", "outcome", "claims"])

    return run


def claims(events: DataFrame, key: str, time: str, status: str, stale: int = STALE_SECONDS, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Replay of claims in time order: outcome of each event (claimed or duplicate).

    Each outcome depends on the last claim of its key.  Events are dealt out by key and sorted, and one
    claim is carried from row to row, so a key's history is never held in memory however long it is.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), "event_id", F.col(status).alias("s"))
    outcomes = rows.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInArrow(_replay(stale, ttl_days), "key string, event_id long, outcome string, claims long")
    return outcomes.withColumnRenamed("key", key)


def transitions(held: DataFrame, changes: DataFrame) -> DataFrame:
    """Claims (claim_key, status, created_at, updated_at, ttl, details) after changes (claim_key, status, at, details).

    The last change of a key sets its status and time; details stay where a change has none, and the
    expiry stays that of the claim.  A change of a key that isn't held makes a row without claim times.
    """
    latest = changes.groupBy("claim_key").agg(F.max_by(F.struct("status", "at"), "at").alias("c"), F.max_by("details", F.when(F.col("details").isNotNull(), F.col("at"))).alias("told"))
    both = held.join(latest, "claim_key", "full")
    changed = F.col("c").isNotNull()
    return both.select("claim_key", F.when(changed, F.col("c.status")).otherwise(F.col("status")).alias("status"), "created_at", F.when(changed, F.col("c.at")).otherwise(F.col("updated_at")).alias("updated_at"), "ttl", F.coalesce("told", "details").alias("details"))


def response(records: Column, outcome: Column) -> Column:
    """What a batch answers: ignored without a record, duplicate, or ok."""
    return F.when(F.coalesce(records, F.lit(0)) == 0, "ignored").when(outcome == "duplicate", "duplicate").otherwise("ok")


def pending(listed: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return listed.join(processed.select(key).distinct(), key, "left_anti")


def expiry(claimed: Column, days: int = TTL_DAYS) -> Column:
    return F.unix_timestamp(claimed + F.make_dt_interval(F.lit(days)))


def created_at(text: Column) -> Column:
    """ISO time stamps of any dialect; null where it isn't one."""
    return F.try_to_timestamp(text)


def box_as_of(ballots: DataFrame, history: DataFrame, time: str) -> DataFrame:
    """Each ballot with the box location that held at its time, from the history of changes.

    Rows are taken together by site and day, in time order; what held before a day comes from the last
    change of each earlier one, of which a site has one a day.  So a busy site is many small groups.
    """
    a = ballots.select("site", F.col(time).alias("t"), F.lit(1).alias("kind"), "ballot", F.lit(None).cast("string").alias("box"))
    b = history.select("site", F.col("updated_at").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("ballot"), "box")
    rows = a.unionByName(b).withColumn("day", F.date_trunc("day", "t"))
    days = rows.groupBy("site", "day").agg(F.max_by("box", F.when(F.col("kind") == 0, F.col("t"))).alias("last"))
    earlier = Window.partitionBy("site").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("site", "day", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    w = Window.partitionBy("site", "day").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("box", F.last("box", ignorenulls=True).over(w)).filter("kind = 1")
    return held.join(days, ["site", "day"]).select("site", "ballot", F.col("t").alias(time), F.coalesce("box", "before").alias("box"))
