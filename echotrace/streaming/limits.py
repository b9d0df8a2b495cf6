"""Requests under an exact limit in the trailing time, with bans that end by themselves.

State is keyed by user: the times of requests that may still count, and when a ban ends. A request in a ban is refused, but
counts. Otherwise a user with more than the limit of requests in the trailing time, this one included and the far end
excluded, is banned from then on for a fixed time. A timer ends the ban when the watermark passes its end and lets go of
times that can't count any more, so a user who stays away leaves no state.

A call of the state is a message to Spark and back, so a user has one value and one timer: for what is due next.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: ``outcome``: run, over_limit (the request that brings the ban), banned, released (no request; the ban's end).
DECISION = "user string, id bigint, at timestamp, outcome string, ban_expires timestamp"
#: The same with times in microseconds, as the processor has them.
DECIDED = Row("user", "id", "at", "outcome", "ban_expires")


class Limit(StatefulProcessor):
    def __init__(self, most: int, seconds: int, ban_seconds: int) -> None:
        self.most, self.span, self.ban = most, seconds * 1_000_000, ban_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "times binary, until bigint, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        own = sorted(((r["micros"], r["id"]) for r in rows), key=lambda x: (x[0], x[1] is None, x[1] or 0))
        before, until, due = self._held()
        times = array("q", (at for at, _ in own))
        for k, (at, ident) in enumerate(own, 1):
            if until is not None and until - self.ban <= at < until:
                yield DECIDED(key[0], ident, at, "banned", until)
            elif k - bisect_right(times, at - self.span, 0, k) + bisect_right(before, at) - bisect_right(before, at - self.span) > self.most:
                until = at + self.ban
                yield DECIDED(key[0], ident, at, "over_limit", until)
            else:
                yield DECIDED(key[0], ident, at, "run", None)
        # What a late request may still ask for stays.
        oldest = min(timerValues.getCurrentWatermarkInMs() * 1000, times[-1]) - self.span
        seen = array("q", sorted(before + times)) if before else times
        self._hold(seen[bisect_right(seen, oldest) :], until, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        times, until, _ = self._held()
        if until is not None and until <= max(watermark, expiredTimerInfo.getExpiryTimeInMs() * 1000):
            yield DECIDED(key[0], None, until, "released", until)
            until = None
        kept = times[bisect_right(times, watermark - self.span) :]
        if kept or until is not None:
            self._hold(kept, until, None)
        else:
            self.state.clear()

    def _held(self) -> tuple[array, int | None, int | None]:
        """The times in order, the ban's end, the timer's time."""
        times = array("q")
        held = self.state.get()
        if held is None:
            return times, None, None
        times.frombytes(bytes(held[0]))
        return times, held[1], held[2]

    def _hold(self, times: array, until: int | None, due: int | None) -> None:
        # Timers have milliseconds; one fires after its time.
        ends = [-(-(times[-1] + self.span) // 1000) + 1] if times else []
        if until is not None:
            ends.append(-(-until // 1000))
        # A timer that fires too early is set anew then.
        if due is None or min(ends) < due:
            if due is not None:
                self.handle.deleteTimer(due)
            due = min(ends)
            self.handle.registerTimer(due)
        self.state.update((times.tobytes(), until, due))

    def close(self) -> None:
        pass


def limited(stream: DataFrame, user: str, ident: str, at: str, *, most: int, seconds: int = 3600, ban_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """DECISION for each request of a stream, and a row for each ban that ends; requests later than ``late`` are left out by Spark.

    The session needs state stores of PROVIDER.
    """
    rows = stream.select(F.col(user).cast("string").alias("user"), F.col(ident).cast("bigint").alias("id"), F.col(at).cast("timestamp").alias("at")).where("user IS NOT NULL AND at IS NOT NULL")
    rows = rows.withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    decided = rows.groupBy("user").transformWithState(Limit(most, seconds, ban_seconds), outputStructType="user string, id bigint, at bigint, outcome string, ban_expires bigint", outputMode="Append", timeMode="EventTime")
    return decided.withColumns({c: F.timestamp_micros(c) for c in ("at", "ban_expires")})
