"""Messages and timelines: latest and previous messages, answers after an ask, removal of
transactional copies, merged timelines with keyset pages, sessions, thread ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order. For n = 1 and large groups prefer
    newest_by(), which sends one row a task and key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def newest_by(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest `order` columns (nulls lowest), by max_by of
    the whole row: a partial aggregate, so a hot key sends one row per task."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, *[F.col(f"r.{c}").alias(c) for c in rest])


def previous_message(messages: DataFrame, by: str, at: str, key: str, text: str = "text") -> DataFrame:
    """Each message with the text of the same person's latest one strictly before it.

    An as-of join without a join: among equal times the least key is not "before", so the
    value comes from the last row of the last earlier time, by a range frame that ends
    just before the current time. An undated message has none and is nobody's.
    """
    w = Window.partitionBy(by).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    dated = F.col(at).isNotNull()
    last = F.when(dated, F.max(F.when(dated, F.struct(F.col(at), F.col(key), F.col(text)))).over(w))
    return messages.withColumns({"previous_text": last[text], "previous_at": last[at]})


def sent_after(asks: DataFrame, sent: DataFrame) -> DataFrame:
    """For each ask (ask_id, address, after): the first and last message to the address
    strictly after it, their number (0 for none). Equi-join on the address with the date
    as residual; asks are a caller's list, so they are the small side."""
    hit = asks.join(sent.select("address", "occurred_at", "message_id"), "address").where("occurred_at > after")
    got = hit.groupBy("ask_id").agg(
        F.min(F.struct("occurred_at", "message_id")).alias("first"), F.max(F.struct("occurred_at", "message_id")).alias("last"), F.count("*").alias("n")
    )
    return asks.join(got, "ask_id", "left").select("ask_id", "address", F.col("first.message_id").alias("first_id"), F.col("last.message_id").alias("last_id"), F.coalesce("n", F.lit(0)).alias("n"))


def without_near_in_time(left: DataFrame, right: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Rows of left with no row of right of the same keys within `seconds` (inclusive).

    A band anti-join as an equi-join: right is bucketed by the band's width and stands in
    its own and both neighbouring buckets, so a hot key spreads over its times.
    """
    us, width = 1_000_000 * seconds, seconds or 1
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = F.floor(second(at) / F.lit(1_000_000 * width))
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], second(at).alias("__us"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__lb") == F.col("__b"), F.abs(F.col("__lus") - F.col("__us")) <= us]
    return left.withColumns({"__lb": bucket, "__lus": second(at)}).join(r, on, "left_anti").drop("__lb", "__lus")


def timeline(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources in one table with their name; absent columns are nulls."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def keyset_page(items: DataFrame, after: tuple | None, limit: int, at: str = "occurred_at", key: str = "item_key") -> DataFrame:
    """The page after a cursor (time or None, key) of a timeline: newest first, undated
    last, ties by key. The cursor is a filter that reaches the scan; the sort is a top-n."""
    if after is not None:
        t, k = after
        if t is None:
            items = items.where(F.col(at).isNull() & (F.col(key) > F.lit(k)))
        else:
            items = items.where(F.col(at).isNull() | (F.col(at) < F.lit(t)) | ((F.col(at) == F.lit(t)) & (F.col(key) > F.lit(k))))
    return items.orderBy(F.col(at).desc_nulls_last(), F.col(key)).limit(limit)


def feed_page(feed: DataFrame, since: int, limit: int) -> DataFrame:
    """limit + 1 rows after a cursor: one more than asked for says that there are more."""
    return feed.where(F.col("feed_seq") > since).orderBy("feed_seq").limit(limit + 1)


def sessions(calls: DataFrame, by: str, at: str, key: str, gap_seconds: int = 1800) -> DataFrame:
    """Each call with session_id, the key of its session's first call. A gap of more than
    gap_seconds starts a new one; exactly that much does not."""
    w = Window.partitionBy(by).orderBy(at, key)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    new = F.coalesce((us(F.col(at)) - us(F.lag(at).over(w))) > gap_seconds * 1_000_000, F.lit(True))
    c = calls.withColumn("__new", F.when(new, F.col(key)))
    return c.withColumn("session_id", F.last("__new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def session_summary(df: DataFrame, by: str, at: str) -> DataFrame:
    return df.groupBy(by, "session_id").agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count("*").alias("calls"))


def thread_ends(messages: DataFrame, by: str, order: list[str], first: int, last: int) -> DataFrame:
    """The first and the last messages of each thread, none twice."""
    up = Window.partitionBy(by).orderBy(*order)
    down = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    return messages.withColumns({"__a": F.row_number().over(up), "__b": F.row_number().over(down)}).where((F.col("__a") <= first) | (F.col("__b") <= last)).drop("__a", "__b")


def conversation_summary(messages: DataFrame, by: str, order: str, own: Column) -> DataFrame:
    """Counts in and out, first and last position, the newest message's id, per conversation."""
    return messages.groupBy(by).agg(
        F.count("*").alias("messages"),
        F.count_if(own).alias("outbound"),
        F.count_if(~own).alias("inbound"),
        F.min(order).alias("first_turn"),
        F.max(order).alias("last_turn"),
        F.max_by("role", order).alias("last_role"),
    )


def without_own(df: DataFrame, own_addresses: DataFrame, own_domains: DataFrame, address: str = "address") -> DataFrame:
    """Rows whose address is neither ours nor at a domain of ours."""
    d = F.lower(F.substring_index(F.col(address), "@", -1))
    a = own_addresses.select(F.lower("address").alias("__a")).distinct()
    o = own_domains.select(F.lower("domain").alias("__d")).distinct()
    return df.join(a, F.lower(F.col(address)) == F.col("__a"), "left_anti").join(o, d == F.col("__d"), "left_anti")
