"""Keyed state with timers: line spans folded as observations come in, and numbers
reported only when they are new. Both hold a key's rows until the watermark has passed
them and then take them in order of time, so the result does not depend on batches,
on the order of arrival within the watermark, or on restarts.

The state store must be RocksDB's (`with_state_store`), which holds state on disk; a key's
rows are read in one task, so keys must be as fine as a line or a number, not a tenant."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.operators.health import MAX_GAP_MINUTES

#: Fixed value: how long an observation of a line may be late.
LATE = "10 minutes"
#: Rows are taken at the next full FLUSH after them, so a key has one timer a FLUSH at most.
FLUSH_MS = 60_000
SPANS = "line string, no long, state string, reason string, started_us long, last_us long, closed boolean"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _due(us: int) -> int:
    """The timer (ms) by which a row of that time has been passed by the watermark."""
    return -(-us // (FLUSH_MS * 1000)) * FLUSH_MS


class _Held(StatefulProcessor):
    """Rows wait in a list until the watermark passes their `us`; then `take` folds them.

    A subclass names the waiting rows' columns, `us` first, and the state's schema."""

    waiting: str
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.waiting)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) else x  # noqa: E731  (a column of longs with nulls comes as doubles)
        new = [tuple(map(whole, r)) for b in rows for r in b[self.columns].itertuples(index=False, name=None)]
        if new:
            self.rows.appendList(new)
            held = set(self.handle.listTimers())
            for at in sorted({_due(int(r[0])) for r in new}):
                if at not in held:
                    self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.rows.get())
        ripe = sorted((r for r in held if r[0] <= passed), key=lambda r: tuple((x is not None, x) for x in r))  # nulls first
        if ripe:
            self.rows.clear()
            rest = [r for r in held if r[0] > passed]
            if rest:
                self.rows.appendList([tuple(r) for r in rest])
        out = self.take(key, ripe, passed)
        if out:
            yield pd.DataFrame(out, columns=self.told)

    def take(self, key, ripe: list, passed: int) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class SpanFold(_Held):
    """One line's observations as spans, by the rule of health.fold_spans."""

    waiting = "us long, state string, since_us long, reason string"
    columns = ["us", "state", "since_us", "reason"]
    told = ["line", "no", "state", "reason", "started_us", "last_us", "closed"]

    def __init__(self, max_gap_minutes: int, keep_days: int):
        self.gap, self.keep = max_gap_minutes * 60_000_000, keep_days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.span = handle.getValueState("span", "no long, state string, reason string, started_us long, last_us long")

    def take(self, key, ripe: list, passed: int) -> list[tuple]:
        line, out = key[0], []
        span = self.span.get() if self.span.exists() else None
        no, state, reason, started, last = span or (0, None, None, None, None)
        if not ripe:
            if span and last + self.keep <= passed:  # nothing for so long: the line's state goes
                self.span.clear()
                return [(line, no, state, reason, started, last, True)]
            return []
        for us, now, since, why in ripe:
            ended = (since is not None and since > last if now == "logged_out" else us - last > self.gap) if no else True
            if no and now == state and not ended:
                last = us
                reason = why if state == "connected" else why if why is not None else reason
                continue
            start = since if since is not None and since <= us else us
            if no:
                start = max(start, last)
                meets = start > last and (state == "logged_out" or start - last <= self.gap)
                out.append((line, no, state, reason, started, start if meets else last, True))
            no, state, reason, started, last = no + 1, now, why, start, us
        self.span.update((no, state, reason, started, last))
        self.handle.registerTimer(_due(last + self.keep))
        return [*out, (line, no, state, reason, started, last, False)]


def folded_spans(observations: DataFrame, max_gap_minutes: int = MAX_GAP_MINUTES, late: str = LATE, keep_days: int = 30) -> DataFrame:
    """A stream of spans (line, no, state, reason, started_at, last_seen_at, closed) of a
    stream of observations (line, state, reason, since, seen_at). An open span is told again
    whenever it grows; `newest_spans` keeps the last word of each.

    Observations later than the watermark are dropped. A line that shows nothing for
    keep_days gives up its state; one that comes back begins anew, at its stated start.
    """
    us = lambda c: F.unix_micros(F.col(c))
    rows = observations.withWatermark("seen_at", late).where("line is not null and seen_at is not null")
    rows = rows.select("line", "seen_at", us("seen_at").alias("us"), "state", us("since").alias("since_us"), "reason")
    out = rows.groupBy("line").transformWithStateInPandas(statefulProcessor=SpanFold(max_gap_minutes, keep_days), outputStructType=SPANS, outputMode="Update", timeMode="EventTime")
    at = lambda c: F.timestamp_micros(F.col(c))
    return out.select("line", "no", "state", "reason", at("started_us").alias("started_at"), at("last_us").alias("last_seen_at"), "closed")


def newest_spans(told: DataFrame) -> DataFrame:
    """The last word of each span (line, state, reason, started_at, last_seen_at, closed)."""
    last = F.max_by(F.struct("state", "reason", "last_seen_at", "closed"), F.struct("last_seen_at", "closed", "batch")) if "batch" in told.columns else F.max_by(F.struct("state", "reason", "last_seen_at", "closed"), F.struct("last_seen_at", "closed"))
    return told.groupBy("line", "no", "started_at").agg(last.alias("s")).select("line", "s.state", "s.reason", "started_at", "s.last_seen_at", "s.closed")


# -- numbers given -----------------------------------------------------------------

#: What a number's first row makes of it.
BEFORE_WATCH, DETECTED = "before_watch", "detected"
GIVEN = "org_id string, brand_id string, phone string, status string, artifact_id string, contact_id string, given_us long"


class FirstLook(_Held):
    """One number of a brand: its first row in time decides, later ones tell nothing."""

    waiting = "us long, order_key string, artifact_id string, contact_id string, history boolean"
    columns = ["us", "order_key", "artifact_id", "contact_id", "history"]
    told = ["org_id", "brand_id", "phone", "status", "artifact_id", "contact_id", "given_us"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getValueState("known", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.known.exists():
            for _ in rows:  # a number that is known holds no further rows
                pass
            return iter(())
        return super().handleInputRows(key, rows, timerValues)

    def take(self, key, ripe: list, passed: int) -> list[tuple]:
        if not ripe or self.known.exists():
            self.rows.clear()
            return []
        us, _, artifact, contact, history = ripe[0]
        self.known.update((us,))
        self.rows.clear()
        return [(*key, BEFORE_WATCH if history else DETECTED, artifact, contact, us)]


def _given(contacts: DataFrame) -> DataFrame:
    """When a row was first looked at: at its artifact's first load, or later by itself."""
    at: Column = F.greatest("at", "loaded_at")
    # of one time history goes first, then the smaller contact
    order = F.concat(F.when(F.col("at") <= F.col("loaded_at"), "0").otherwise("1"), F.coalesce(F.col("contact_id").cast("string"), F.lit("")))
    return contacts.where("phone is not null and at is not null and loaded_at is not null").select(
        *[F.col(c).cast("string").alias(c) for c in ("org_id", "brand_id", "phone", "artifact_id", "contact_id")],
        at.alias("looked_at"), order.alias("order_key"), (F.col("at") <= F.col("loaded_at")).alias("history"),
    )


def given_numbers(contacts: DataFrame, late: str = LATE) -> DataFrame:
    """A stream with one row a number of a brand (org_id, brand_id, phone, status,
    artifact_id, contact_id, given_at): `before_watch` if its first row was in an artifact's
    first load, else `detected`, and nothing for all its later rows.

    contacts: org_id, brand_id, artifact_id, contact_id, phone, at (when the row came in) and
    loaded_at (when its artifact's first load was over; rows without it are not looked at,
    their source states them again once it is). A number's state is one time and stays, for
    a number must never be reported twice.
    """
    rows = _given(contacts).withColumn("us", F.unix_micros("looked_at")).withWatermark("looked_at", late)
    out = rows.groupBy("org_id", "brand_id", "phone").transformWithStateInPandas(statefulProcessor=FirstLook(), outputStructType=GIVEN, outputMode="Append", timeMode="EventTime")
    return out.select("org_id", "brand_id", "phone", "status", "artifact_id", "contact_id", F.timestamp_micros("given_us").alias("given_at"))


def given_so_far(contacts: DataFrame) -> DataFrame:
    """The same of a table at rest, as one aggregation."""
    first = F.min(F.struct("looked_at", "order_key", "artifact_id", "contact_id", "history")).alias("f")
    rows = _given(contacts).groupBy("org_id", "brand_id", "phone").agg(first)
    return rows.select("org_id", "brand_id", "phone", F.when(F.col("f.history"), BEFORE_WATCH).otherwise(DETECTED).alias("status"), "f.artifact_id", "f.contact_id", F.col("f.looked_at").alias("given_at"))
