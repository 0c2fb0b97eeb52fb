"""Circuit breakers, quotas and paces of services, as folds over their events in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.operators.folds import ordered_fold

SECOND = 1_000_000  # times are microseconds
#: Shortest wait, failures that open, first and longest opening, account failures, longest block of all.
COOLDOWN, OPEN_AFTER, FIRST_OPEN, LONGEST_OPEN = 60 * SECOND, 3, 120 * SECOND, 3600 * SECOND
ACCOUNT, CEILING = 6 * 3600 * SECOND, 35 * 86400 * SECOND


def breaker_step(state, at: int, failed: bool, account: bool):
    """One outcome: (consecutive, opens, fatal, blocked until) after it, and what is reported."""
    consecutive, opens, fatal, blocked = state or (0, 0, False, 0)
    if not failed:
        return (0, 0, False, 0), ("closed", 0, 0)
    if account:
        fatal, until = True, at + ACCOUNT
    else:
        fatal, consecutive, until = False, consecutive + 1, at + COOLDOWN
        if consecutive >= OPEN_AFTER:
            opens += 1
            until = at + min(FIRST_OPEN * 2 ** min(opens - 1, 40), LONGEST_OPEN)
    blocked = min(max(blocked if blocked > at else 0, until), at + CEILING)
    name = "open" if fatal or consecutive >= OPEN_AFTER else "cooldown"
    return (consecutive, opens, fatal, blocked), (name, consecutive, blocked)


def breaker_states(events: DataFrame, key: str, at: str, tie: str, failed: str, account: str) -> DataFrame:
    """(key, at, tie, state, consecutive, blocked_until) after each event; columns ``failed`` and ``account`` are booleans."""
    return ordered_fold(events, [key], [at, tie], [at, failed, account], tuple, breaker_step, {"state": "string", "consecutive": "long", "blocked_until": "long"})


def paced_starts(requests: DataFrame, key: str, at: str, tie: str, tokens: str, per_minute: int, tokens_per_minute: int | None = None) -> DataFrame:
    """When each request may start: spaced by the requests a minute, and within the tokens of any 60 seconds.

    A request larger than the whole limit passes once the window is empty.
    """
    gap, minute = -(-60 * SECOND // per_minute), 60 * SECOND

    def step(state, now, n):
        last, window = state
        start = max(now, last + gap) if last is not None else now
        if tokens_per_minute:
            window = tuple(w for w in window if w[0] > start - minute)
            while window and sum(w[1] for w in window) + n > tokens_per_minute:
                start = max(start, window[0][0] + minute)
                window = window[1:]
            window = (*window, (start, n))
        return (start, window), (start, start - now)

    return ordered_fold(requests, [key], [at, tie], [at, tokens], lambda: (None, ()), step, {"start": "long", "waited": "long"})


def daily_usage(events: DataFrame, key: str, at: str, tokens: str, zone: str) -> DataFrame:
    """(key, day, requests, tokens) by calendar day of a service's time zone; ``at`` is a UTC timestamp."""
    day = F.date_format(F.from_utc_timestamp(F.col(at), zone), "yyyy-MM-dd")
    return events.groupBy(key, day.alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))
