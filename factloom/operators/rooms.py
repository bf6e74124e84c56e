"""Messages that rewrite or quote others, bookings that replace others, and numbers that are
still to be looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a quote, and days after which a number that was not found is asked for again.
QUOTE_MAX, RETRY_DAYS = 300, 30


def fold_edits(messages: DataFrame) -> DataFrame:
    """Messages (room, event_id, sender, at, body, edits, quotes) with every edit folded into
    the message it rewrites: the original keeps its place, sender and quote and has the
    words of its sender's last edit (by at, then event_id). An edit by someone else, or
    of a message that is not there, stays as it is. Rows without an event_id stay."""
    edits = messages.where("edits is not null and event_id is not null")
    originals = messages.where("event_id is not null").select("room", F.col("event_id").alias("edits"), F.col("sender").alias("__by"))
    met = edits.join(originals.distinct(), ["room", "edits"]).where(F.col("sender").eqNullSafe(F.col("__by")))
    last = met.groupBy("room", F.col("edits").alias("event_id")).agg(F.max_by("body", F.struct("at", F.col("event_id"))).alias("__new"), F.lit(True).alias("__edited"))
    folded = met.select("room", "event_id").distinct().withColumn("__gone", F.lit(True))
    rows = messages.join(folded, ["room", "event_id"], "left").where("__gone is null").join(last, ["room", "event_id"], "left")
    return rows.select(*[F.when(F.col("__edited"), F.col("__new")).otherwise(F.col("body")).alias("body") if c == "body" else F.col(c) for c in messages.columns])


def with_quotes(messages: DataFrame, own: Column) -> DataFrame:
    """Messages with `quote`: id, direction, at and first QUOTE_MAX characters of what they
    quote; of a message that is not there the id alone. own: whether a sender is ours."""
    told = F.struct(F.when(own, "outbound").otherwise("inbound").alias("direction"), F.col("at"), F.when(F.trim("body") != "", F.substring("body", 1, QUOTE_MAX)).alias("text"))
    target = messages.where("event_id is not null").groupBy("room", F.col("event_id").alias("quotes")).agg(F.min(told).alias("__q"))
    rows = messages.join(target, ["room", "quotes"], "left")
    quote = F.when(F.col("quotes").isNotNull(), F.struct(F.col("quotes").alias("event_id"), F.col("__q.direction"), F.col("__q.at"), F.col("__q.text")))
    return rows.withColumn("quote", quote).select(*messages.columns, "quote")


def rebooked(bookings: DataFrame) -> DataFrame:
    """Bookings (person_id, event_id, booked_at, status) with `replaced_by`: the first booking
    of the person that stands and was made no earlier than this cancelled one; null for
    those that stand, that no other follows, or of unknown date."""
    w = Window.partitionBy("person_id").orderBy(F.unix_micros(F.col("booked_at").cast("timestamp"))).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    stands = ~F.col("status").eqNullSafe("cancelled") & F.col("booked_at").isNotNull()
    following = F.min(F.when(stands, F.struct("booked_at", "event_id"))).over(w)
    rows = bookings.withColumn("__next", following)
    return rows.withColumn("replaced_by", F.when((F.col("status") == "cancelled") & F.col("booked_at").isNotNull(), F.col("__next.event_id"))).drop("__next")


def meetings(bookings: DataFrame) -> DataFrame:
    """The bookings that are meetings: those not replaced, with `rescheduled_from`, the ids of
    those they replace in order of booking."""
    told = rebooked(bookings)
    came = told.where("replaced_by is not null").groupBy("person_id", F.col("replaced_by").alias("event_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("booked_at", "event_id"))), lambda x: x["event_id"]).alias("rescheduled_from"))
    return told.where("replaced_by is null").drop("replaced_by").join(came, ["person_id", "event_id"], "left")


def numbers_to_ask(known: list[DataFrame], mirrored: DataFrame, lookups: DataFrame, now: Column, retry_days: int = RETRY_DAYS) -> DataFrame:
    """(phone): international numbers that any of the tables (phone) states, that no chat
    contact has, and that were never looked up or not found over retry_days ago."""
    rows = known[0].select("phone")
    for df in known[1:]:
        rows = rows.unionByName(df.select("phone"))
    asked = lookups.where((F.col("outcome") == "found") | (F.col("looked_up_at") > now - F.make_dt_interval(F.lit(retry_days)))).select("phone")
    rows = rows.where(F.col("phone").rlike("^\\+[0-9]{8,15}$")).distinct()
    return rows.join(mirrored.select("phone").unionByName(asked).distinct(), "phone", "left_anti")
