"""Request, login and status monitors: streams, and the same rules on tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import ordered

#: State stores that keep named states and timers; the setting of the streams below.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which named states and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


# -- counters -------------------------------------------------------------------------------

def requests_per_minute(requests: DataFrame, key: str, ts: str, late: str = "2 minutes") -> DataFrame:
    """Requests per key and wall-clock minute; the same plan serves streams and tables."""
    return requests.withWatermark(ts, late).groupBy(F.window(ts, "1 minute").alias("w"), key).agg(
        F.count("*").alias("n")
    ).select(key, F.col("w.start").alias("minute"), "n")


def rate_limit_sessions(requests: DataFrame, key: str, ts: str, gap: str = "15 minutes", limit: int = 100, late: str = "2 minutes") -> DataFrame:
    """Inactivity sessions per key with their request count; ``limited`` once the limit is reached."""
    s = requests.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start"), "n", (F.col("n") >= limit).alias("limited"))


def rate_limit_sessions_table(requests: DataFrame, key: str, ts: str, tie: str, gap_seconds: int = 900, limit: int = 100) -> DataFrame:
    s = ordered.sessions(requests, [key], ts, tie, gap_seconds, F.to_date(ts))
    return s.withColumn("limited", F.col("n") >= limit)


def distinct_paths(requests: DataFrame, key: str, path: str, ts: str, gap: str = "1 hour", late: str = "2 minutes") -> DataFrame:
    """Approximate number of distinct paths per key and session; state of fixed size per session."""
    s = requests.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(
        F.approx_count_distinct(path).alias("paths")
    )
    return s.select(key, F.col("w.start").alias("start"), "paths")


def distinct_paths_table(requests: DataFrame, key: str, path: str, ts: str, tie: str, gap_seconds: int = 3600) -> DataFrame:
    """Exact number of distinct paths per key and session."""
    rows = ordered.with_session(requests.select(key, path, ts, tie), [key], ts, tie, gap_seconds, F.to_date(ts))
    return rows.groupBy(key, F.col("session_start").alias("start")).agg(F.countDistinct(path).alias("paths"))


def slow_requests(requests: DataFrame, seconds: str, longer_than: float = 5.0) -> DataFrame:
    return requests.filter(F.col(seconds) > longer_than)


def newest_requests(requests: DataFrame, ts: str, key: str, k: int = 100) -> DataFrame:
    """The bounded view kept of a feed."""
    return requests.orderBy(F.desc(ts), F.desc(key)).limit(k)


# -- login lockout ----------------------------------------------------------------------------

class _Lockout(StatefulProcessor):
    """Failures in a row of one user: a count and the time of the last one, removed by a timer when the hold is over."""

    def __init__(self, attempts: int, hold: int):
        self.attempts, self.hold = attempts, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "failures long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        count, last = self.run.get() if self.run.exists() else (0, 0)
        for row in sorted(rows, key=lambda r: (r.micros, r.tie)):
            if row.ok or row.micros - last > self.hold:
                count = 0
            if not row.ok:
                count, last = count + 1, row.micros
                if count >= self.attempts:
                    yield Row(user=key[0], failures=count, locked_until=row.micros + self.hold)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if count:
            self.run.update((count, last))
            self.handle.registerTimer(max((last + self.hold) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        else:
            self.run.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.run.clear()
        return iter(())

    def close(self) -> None:
        pass


def lockouts(
    logins: DataFrame, user: str, ts: str, success: str, attempts: int = 5, minutes: int = 30, late: str = "10 minutes", tie: str = "event_id"
) -> DataFrame:
    """(user, failures, locked_until): a row for every failure from the ``attempts``-th on.

    A success clears the count, and so do ``minutes`` without a failure. The state of a user is a
    count and the time of the last failure; it is removed when the watermark has passed the hold. ``tie`` orders rows of one time.
    """
    keyed_state(logins.sparkSession)
    rows = logins.withWatermark(ts, late).select(
        F.col(user).alias("user"), F.col(ts), F.unix_micros(F.col(ts)).alias("micros"), F.col(tie).alias("tie"), F.col(success).alias("ok")
    )
    schema = T.StructType([rows.schema["user"], T.StructField("failures", T.LongType()), T.StructField("locked_until", T.LongType())])
    out = rows.groupBy("user").transformWithState(_Lockout(attempts, minutes * 60 * 1_000_000), schema, "append", "eventTime")
    return out.withColumn("locked_until", F.timestamp_micros("locked_until"))


def lockouts_table(logins: DataFrame, user: str, ts: str, tie: str, success: str, attempts: int = 5, minutes: int = 30) -> DataFrame:
    """(user, first_failure, failures, locked_until): runs of failures that end in a lock."""
    rows = logins.withColumn("ok", F.col(success))
    opens = F.col("ok") | F.coalesce("prev_ok", F.lit(True)) | ordered.gap_opens(ts, minutes * 60)
    found = ordered.runs(rows, [user], ts, tie, opens, F.to_date(ts), [ts, "ok"], {"successes": F.col("ok").cast("int")})
    locked = found.filter((F.col("successes") == 0) & (F.col("n") >= attempts))
    until = F.col("end") + F.make_dt_interval(mins=F.lit(minutes))
    return locked.select(user, F.col("start").alias("first_failure"), F.col("n").alias("failures"), until.alias("locked_until"))


# -- status changes ---------------------------------------------------------------------------

TERMINAL = ["CONFIRMED", "FAILED"]


class _Follower(StatefulProcessor):
    """Last status of one key and the time of its first row; a timer removes both when ``forget`` has passed since the last row's batch."""

    def __init__(self, hold: int, forget: int):
        self.hold, self.forget = hold, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "status string, first long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, first, done = self.seen.get() if self.seen.exists() else (None, None, False)
        newest = 0
        for row in sorted(rows, key=lambda r: (r.micros, r.tie)):
            first, newest = row.micros if first is None else first, row.micros
            done = done or row.micros - first > self.hold
            if not done and row.status != last:
                yield Row(key=key[0], at=row.micros, status=row.status)
                last, done = row.status, row.status in TERMINAL
        self.seen.update((last, first, done))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((newest + self.forget) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def status_changes(
    updates: DataFrame, key: str, ts: str, status: str, seconds: int = 60, late: str = "10 minutes", tie: str = "event_id", forget_seconds: int = 30 * 86400
) -> DataFrame:
    """(key, at, status): changes of each key until a terminal status or ``seconds`` after its first row.

    A key is remembered, also when it is done, until the watermark is ``forget_seconds`` (not less than ``seconds``) past its last row; after that it
    counts as new. ``tie`` orders rows of one time.
    """
    keyed_state(updates.sparkSession)
    rows = updates.withWatermark(ts, late).select(
        F.col(key).alias("key"), F.col(ts), F.unix_micros(F.col(ts)).alias("micros"), F.col(tie).alias("tie"), F.col(status).alias("status")
    )
    schema = T.StructType([rows.schema["key"], T.StructField("at", T.LongType()), T.StructField("status", T.StringType())])
    follower = _Follower(seconds * 1_000_000, max(seconds, forget_seconds) * 1_000_000)
    out = rows.groupBy("key").transformWithState(follower, schema, "append", "eventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


def status_changes_table(updates: DataFrame, key: str, ts: str, tie: str, status: str, seconds: int = 60) -> DataFrame:
    """The same changes from a table."""
    terminal = F.when(F.col(status).isin(TERMINAL), F.struct(ts, tie))
    ends = updates.groupBy(key).agg(F.min(ts).alias("__first"), F.min(terminal).alias("__end"))
    rows = ordered.with_previous(updates, [key], [ts, tie], F.to_date(ts), [status]).join(ends, key)
    changed = F.col(f"prev_{status}").isNull() | (F.col(f"prev_{status}") != F.col(status))
    open_ = F.col("__end").isNull() | (F.struct(ts, tie) <= F.col("__end"))
    in_time = F.col(ts) <= F.col("__first") + F.make_dt_interval(secs=F.lit(seconds))
    return rows.filter(changed & open_ & in_time).select(key, F.col(ts).alias("at"), F.col(status).alias("status"))


# -- attestations and contract events -----------------------------------------------------------

def attestation_monitor(pending: DataFrame, updates: DataFrame, key: str, ts: str, minutes: int = 10, late: str = "10 minutes") -> DataFrame:
    """Pending records with their terminal status within the time limit, null where none arrives.

    ``pending`` has (key, ts), ``updates`` (key, updated_at, status). Both sides are dropped from
    the state once the watermark has passed the limit.
    """
    waiting = pending.withWatermark(ts, late).alias("p")
    done = updates.filter(F.col("status").isin(TERMINAL)).withWatermark("updated_at", late).alias("u")
    on = (
        (F.col(f"p.{key}") == F.col(f"u.{key}")) & (F.col("u.updated_at") >= F.col(f"p.{ts}"))
        & (F.col("u.updated_at") <= F.col(f"p.{ts}") + F.expr(f"INTERVAL {minutes} MINUTES"))
    )
    return waiting.join(done, on, "left_outer").select(
        F.col(f"p.{key}").alias(key), F.col(f"p.{ts}").alias(ts), F.col("u.updated_at").alias("updated_at"), F.col("u.status").alias("status")
    )


def attestation_table(pending: DataFrame, updates: DataFrame, key: str, ts: str, minutes: int = 10) -> DataFrame:
    """`attestation_monitor` over whole tables: every pending record comes out, also the latest ones."""
    done = updates.filter(F.col("status").isin(TERMINAL)).alias("u")
    at, until = F.col("u.updated_at"), F.col(f"p.{ts}") + F.make_dt_interval(mins=F.lit(minutes))
    on = (F.col(f"p.{key}") == F.col(f"u.{key}")) & (at >= F.col(f"p.{ts}")) & (at <= until)
    return pending.alias("p").join(done, on, "left").select(F.col(f"p.{key}"), F.col(f"p.{ts}"), at, F.col("u.status"))


# Contract events that are followed.
CONTRACT_EVENTS = [
    "SubmissionMinted", "SubmissionUpdated", "SubmissionVerified", "RoleGranted", "RoleRevoked", "Paused", "Unpaused",
]


def contract_tail(events: DataFrame, names: list[str] | None = None, late: str = "1 hour") -> DataFrame:
    """Named contract events, each transaction once."""
    named = events.filter(F.col("eventType").isin(names or CONTRACT_EVENTS))
    return named.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["transactionHash"])
