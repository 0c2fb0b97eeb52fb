"""Keyed state over streams of service events; each has a batch twin in ``operators``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirespark.operators.health import breaker_step


def daily_usage(events: DataFrame, key: str, at: str, tokens: str, zone: str, late: str = "1 day") -> DataFrame:
    """Requests and tokens by calendar day of a time zone; a day is final once ``late`` has passed."""
    local = events.withColumn("_local", F.from_utc_timestamp(F.col(at), zone)).withWatermark("_local", late)
    days = local.groupBy(key, F.window("_local", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))
    return days.select(key, F.date_format("w.start", "yyyy-MM-dd").alias("day"), "requests", "tokens")


def once(events: DataFrame, external_id: str, at: str, late: str = "2 days") -> DataFrame:
    """Deliveries counted once by external id within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([external_id])


def hold_sessions(events: DataFrame, key: str, at: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap without events."""
    s = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def breaker(events: DataFrame, key: str) -> DataFrame:
    """The circuit breaker's state after each event (key, us, event_id, failed, account), in order within a micro-batch."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        held = None if held is None else (held[0], held[1], bool(held[2]), held[3])
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        out = []
        for us, event, failed, account in rows[["us", "event_id", "failed", "account"]].itertuples(index=False):
            held, (name, consecutive, until) = breaker_step(held, us, failed, account)
            out.append((k[0], us, event, name, consecutive, until))
        state.update(held)
        yield pd.DataFrame(out, columns=[key, "us", "event_id", "state", "consecutive", "blocked_until"])

    return events.groupBy(key).applyInPandasWithState(
        run,
        f"{key} long, us long, event_id long, state string, consecutive long, blocked_until long",
        "consecutive long, opens long, fatal boolean, blocked long",
        "append",
        GroupStateTimeout.NoTimeout,
    )
