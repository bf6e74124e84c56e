"""Mirrors of outside systems: records kept by content hash, visits and persons from raw
page events, payments, and feeds whose newest version holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.facts import upsert_new
from factloom.operators.messages import newest_by


def bronze(records: DataFrame, stored: DataFrame | None, key: list[str]) -> DataFrame:
    """Records (key columns, payload text) that are new or changed, with their content
    hash; a record mirrored again unchanged is not written."""
    hashed = records.withColumn("content_hash", F.sha2("payload", 256))
    return hashed if stored is None else upsert_new(hashed, stored, key)


def visits(events: DataFrame, session: str, person: str, at: str, url: str, path: str, most_paths: int = 20) -> DataFrame:
    """One visit per (session, person): first and last time, landing url, distinct paths
    (at most `most_paths` are kept, that is the column's length), pageviews."""
    return events.groupBy(session, person).agg(
        F.min(at).alias("started_at"),
        F.max(at).alias("ended_at"),
        F.min_by(url, F.struct(at, url)).alias("landing_url"),
        F.slice(F.sort_array(F.collect_set(path)), 1, most_paths).alias("paths"),
        F.count("*").alias("pageviews"),
    ).withColumn("visit_id", F.concat_ws(":", session, person))


def machine_visit(flags: list[Column], newsletter_bounce: Column) -> Column:
    """A visit made by a machine: one of the flags, or a newsletter link opened once for no time."""
    out = F.coalesce(newsletter_bounce, F.lit(False))
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def custom_events(events: DataFrame, name: str) -> DataFrame:
    return events.where(~F.startswith(F.col(name), F.lit("$")))


def touched_since(events: DataFrame, person: str, at: str, since: Column) -> DataFrame:
    """Persons with an event at or after a time; the filter reaches the scan."""
    return events.where(F.col(at) >= since).select(person).distinct()


def after_key(df: DataFrame, keys: list[str], last: tuple | None, limit: int) -> DataFrame:
    """The page after the last key of a total order."""
    if last is not None:
        df = df.where(F.struct(*keys) > F.struct(*map(F.lit, last)))
    return df.orderBy(*keys).limit(limit)


def newest_versions(feed: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest version of each record."""
    return newest_by(feed, key, [version])


def message_people(messages: DataFrame, key: str, roles: list[str]) -> DataFrame:
    """(key, role, address): a row per participant of a message, from array columns."""
    all_ = F.flatten(F.array(*[F.transform(F.coalesce(F.col(r), F.array().cast("array<string>")), lambda a, r=r: F.struct(F.lit(r).alias("role"), F.lower(a).alias("address"))) for r in roles]))
    return messages.select(key, F.inline(all_)).distinct()


def seconds(c: Column) -> Column:
    """A time from unix seconds, null for anything else."""
    return F.timestamp_seconds(c.try_cast("double"))


def subscription_amount(items: Column) -> Column:
    """Sum of unit amount times quantity of the items; null if a unit amount is null or
    there are no items."""
    total = F.aggregate(items, F.lit(0).cast("long"), lambda a, i: a + i["unit_amount"] * F.coalesce(i["quantity"], F.lit(1)))
    return F.when(F.size(items) > 0, total)


def net_paid(charges: DataFrame, customer: str = "customer") -> DataFrame:
    """(customer, paid): net of refunds by currency, as a map; one aggregation by
    (customer, currency), then one by customer."""
    net = F.sum(F.col("amount_minor") - F.coalesce("amount_refunded", F.lit(0))).alias("net")
    per = charges.where("status = 'succeeded'").groupBy(customer, "currency").agg(net)
    return per.groupBy(customer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("currency", "net")))).alias("paid"))


def signups(users: DataFrame, memberships: DataFrame, staff: Column) -> DataFrame:
    """Users who signed up by themselves: not our staff, and in no organisation at all or
    in one that they made, whose maker is unknown, or which our staff made and they
    joined first of all outsiders, an unknown date last and ties by the membership's id.
    users: (user_id, email); memberships: (org, user_id, joined_at, org_created_by, and
    membership_id where known, else the user's id decides)."""
    outside = users.where(~staff).select("user_id")
    ours = users.where(staff).select(F.col("user_id").alias("org_created_by"), F.lit(True).alias("by_staff"))
    tie = "membership_id" if "membership_id" in memberships.columns else "user_id"
    order = F.struct(F.col("joined_at").isNull().alias("undated"), F.col("joined_at"), F.col(tie).alias("tie"))
    first = memberships.join(outside, "user_id").groupBy("org").agg(F.min_by("user_id", order).alias("first_user"))
    m = memberships.join(first, "org", "left").join(ours, "org_created_by", "left")
    maker = F.col("org_created_by")
    own = maker.isNull() | (maker == F.col("user_id")) | (F.coalesce("by_staff", F.lit(False)) & F.coalesce(F.col("first_user") == F.col("user_id"), F.lit(False)))
    mine = m.groupBy("user_id").agg(F.max(own).alias("__own"))
    return users.where(~staff).join(mine, "user_id", "left").where(F.coalesce("__own", F.lit(True))).drop("__own")
