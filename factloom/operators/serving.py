"""Segments and serving: named clauses over people, pools without the suppressed, serving
batches that suppress every address of whom they serve, and their statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.normalize import EMAIL
from factloom.operators.outcomes import SCOPE, payment_stands, without_booking_forms

Clauses = list[tuple[str, Column]]


def fits(clauses: Clauses) -> Column:
    """Whether every clause holds; an unknown clause does not."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for _, c in clauses], F.lit(True))


def failed_codes(clauses: Clauses) -> Column:
    """The codes of the clauses that do not hold, in their order: the same list that
    fits() uses explains a pool."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in clauses]), lambda x: x.isNotNull())


def sendable(contacts: DataFrame) -> DataFrame:
    """Contacts with a well-formed address who neither unsubscribed nor denied consent."""
    c = F.col
    return contacts.where(c("primary_email").rlike(EMAIL) & ~F.coalesce(c("unsubscribed"), F.lit(False)) & ~c("consent_status").eqNullSafe("denied"))


def reached(people: DataFrame, facts: DataFrame, types: list[str], negate: bool = False, calendars: DataFrame | None = None) -> DataFrame:
    """People of a brand with (or without) a live fact of one of the types that counts: a
    payment must stand, and a calendar's own booking form is no form. People and facts
    meet within their organisation and brand."""
    f = facts.where(F.col("live") & F.col("owner_person_key").isNotNull() & F.col("type").isin(*types)).where(payment_stands())
    f = without_booking_forms(f, calendars) if calendars is not None else f
    f = f.select(*SCOPE, F.col("owner_person_key").alias("person_key")).distinct()
    return people.join(f, [*SCOPE, "person_key"], "left_anti" if negate else "left_semi")


def with_deal(people: DataFrame, deals: DataFrame, stages: list[str], status: str | None = None) -> DataFrame:
    """People one of whose deals is in one of the stages and, the same deal, has the
    status; names are compared without case and outer space."""
    fold = lambda c: F.lower(F.trim(c))
    d = deals.where(fold(F.col("stage")).isin(*[s.strip().lower() for s in stages]))
    d = d.where(fold(F.col("status")) == status.strip().lower()) if status else d
    return people.join(d.select("person_key").distinct(), "person_key", "left_semi")


def tagged(tags: Column, any_of: list[str]) -> Column:
    return F.exists(tags, lambda t: F.lower(F.trim(t)).isin(*[x.strip().lower() for x in any_of]))


def pool(candidates: DataFrame, suppressed: DataFrame, key: str = "email") -> DataFrame:
    """Candidates whose address was never served."""
    return candidates.join(suppressed.select(key).distinct(), key, "left_anti")


def serve(candidates: DataFrame, suppressed: DataFrame, limit: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the batch, the suppressions to append): the oldest people none of whose addresses
    is suppressed; all addresses of whom is served are suppressed. candidates:
    (person_id, emails, ...). One writer runs at a time; a rerun over the same tables
    gives the same batch."""
    every = candidates.select("person_id", F.explode("emails").alias("email"))
    held = every.join(suppressed.select("email").distinct(), "email", "left_semi").select("person_id").distinct()
    batch = candidates.join(held, "person_id", "left_anti").orderBy(*order).limit(limit)
    return batch, batch.select(F.explode("emails").alias("email")).distinct()


def hand_out(candidates: DataFrame, given: DataFrame, asker: str, limit: int, order: list[str]) -> DataFrame:
    """Rows the asker was not given before, by key email:<address> or row:<id>; nothing
    is suppressed by handing out."""
    key = F.coalesce(F.concat(F.lit("email:"), F.lower("email")), F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    had = given.where(F.col("asker") == asker).select("key").distinct()
    return candidates.withColumn("key", key).join(had, "key", "left_anti").orderBy(*order).limit(limit)


def offered_again(rows: DataFrame, lookups: DataFrame, key: str, now: Column, days: int) -> DataFrame:
    """Rows never looked up, or last looked up longer ago than the given days."""
    recent = lookups.groupBy(key).agg(F.max("looked_up_at").alias("t")).where(F.col("t") > now - F.expr(f"interval {days} days"))
    return rows.join(recent.select(key), key, "left_anti")


def serve_stats(candidates: DataFrame, suppressed: DataFrame, by: list[str], key: str = "email") -> DataFrame:
    """total, served and remaining people of each group (one row for no group)."""
    s = suppressed.select(key).distinct().withColumn("__s", F.lit(True))
    c = candidates.join(s, key, "left")
    return c.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("__s").alias("served"), F.count_if(F.col("__s").isNull()).alias("remaining"))


def last_row_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows without a key all stay."""
    rest = [c for c in rows.columns if c != key]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(rows.columns).unionByName(rows.where(F.col(key).isNull()))


def search(people: DataFrame, needle: str, columns: list[str], arrays: list[str]) -> DataFrame:
    """People one of whose columns or array items contains the needle, in any case, with
    `matched`: the names of the columns that do."""
    n = F.lower(F.lit(needle))
    hit = {c: F.coalesce(F.contains(F.lower(F.col(c)), n), F.lit(False)) for c in columns}
    hit |= {a: F.coalesce(F.exists(a, lambda x: F.contains(F.lower(x), n)), F.lit(False)) for a in arrays}
    return people.where(reduce(lambda a, b: a | b, hit.values())).withColumn("matched", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in hit.items()])))
