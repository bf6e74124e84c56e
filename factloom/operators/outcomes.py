"""Funnel outcomes: who reached which step, when, by which source, and who of them was
contacted by us.

Facts have org_id, brand_id, owner_person_key, type, source, occurred_at, live and a
payload struct (amount_minor, amount_refunded, status, refunded, form_id). Every
function keeps org_id and brand_id as grouping keys, so a table partitioned by them
is pruned by the caller's filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ["org_id", "brand_id"]

#: Which step a fact type states.
STEP_OF = {
    "website_visit": "website_visit",
    "signup": "signup",
    "form_submitted": "form_submission",
    "meeting_booked": "meeting_booked",
    "meeting_attended": "meeting_attended",
    "sale": "sale",
    "payment": "sale",
}
#: Fact types that make somebody a paying client.
PAYING = ("sale", "payment", "client")


def payment_stands(f: str = "") -> Column:
    """A payment counts if it succeeded and more came in than went back; without an
    amount, unless it is flagged as refunded. Other facts count."""
    p = F.col(f"{f}payload")
    net = p["amount_minor"] - F.coalesce(p["amount_refunded"], F.lit(0))
    paid = (p["status"] == "succeeded") & F.when(p["amount_minor"].isNotNull(), net > 0).otherwise(~F.coalesce(p["refunded"], F.lit(False)))
    return F.when(F.col(f"{f}type") != "payment", F.lit(True)).otherwise(F.coalesce(paid, F.lit(False)))


def without_booking_forms(facts: DataFrame, calendars: DataFrame) -> DataFrame:
    """Facts without submissions of a calendar's own booking form. Only form facts that
    name a form meet the calendars; the others pass by the join."""
    named = (F.col("type") == "form_submitted") & F.col("payload.form_id").isNotNull()
    forms = calendars.where("form_id is not null").select(*SCOPE, F.col("form_id").alias("__form")).distinct()
    kept = facts.where(named).withColumn("__form", F.col("payload.form_id")).join(forms, [*SCOPE, "__form"], "left_anti").select(facts.columns)
    return facts.where(~F.coalesce(named, F.lit(False))).unionByName(kept)


def step_of(c: Column) -> Column:
    """The step of a fact type; null for types that state none."""
    return F.create_map(*[F.lit(x) for kv in STEP_OF.items() for x in kv])[c]


def evidence(facts: DataFrame, calendars: DataFrame | None = None) -> DataFrame:
    """(scope, step, person_key, source, occurred_at) of the live, owned facts that count."""
    f = facts.where(F.col("live") & F.col("owner_person_key").isNotNull() & F.col("type").isin(*STEP_OF)).where(payment_stands())
    f = without_booking_forms(f, calendars) if calendars is not None else f
    return f.select(*SCOPE, step_of(F.col("type")).alias("step"), F.col("owner_person_key").alias("person_key"), "source", "occurred_at")


def person_of_address(addresses: DataFrame, people: DataFrame) -> DataFrame:
    """Each (scope, step, address) with the person who holds `email:<address>`, or that
    key itself where nobody does. Identity keys are exploded once and hash-joined."""
    held = people.select(*SCOPE, F.col("person_key").alias("__person"), F.explode("identity_keys").alias("__key"))
    return (
        addresses.withColumn("__key", F.concat(F.lit("email:"), F.lower("address")))
        .join(held, [*SCOPE, "__key"], "left")
        .withColumn("person_key", F.coalesce("__person", "__key"))
        .drop("__person", "__key")
    )


def campaign_reach(addresses: DataFrame, people: DataFrame, source: str = "campaign") -> DataFrame:
    """Evidence rows (undated) for the addresses that campaigns brought to a step."""
    return person_of_address(addresses, people).select(*SCOPE, "step", "person_key", F.lit(source).alias("source"), F.lit(None).cast("timestamp").alias("occurred_at"))


def outcome_counts(e: DataFrame, contacted: DataFrame) -> DataFrame:
    """(scope, kind, step, source, month, people, contacted): totals, months (null:
    undated) and sources of each step.

    Evidence is folded once to (step, person, source); totals and months come from its
    roll-up to (step, person), sources from itself, so people of several sources count
    once in a total and once in each source.
    """
    once = e.groupBy(*SCOPE, "step", "person_key", "source").agg(F.min("occurred_at").alias("first_at"))
    c = contacted.select(*SCOPE, "step", "person_key").distinct().withColumn("__ours", F.lit(True))
    reach = once.groupBy(*SCOPE, "step", "person_key").agg(F.min("first_at").alias("reach_at"))
    reach = reach.join(c, [*SCOPE, "step", "person_key"], "left").select(
        *SCOPE, "step", F.date_format("reach_at", "yyyy-MM").alias("month"), F.coalesce("__ours", F.lit(False)).alias("ours")
    )
    figures = [F.count("*").alias("people"), F.count_if("ours").alias("contacted")]
    none = F.lit(None).cast("string")
    months = reach.groupBy(*SCOPE, "step", "month").agg(*figures)
    totals = months.groupBy(*SCOPE, "step").agg(F.sum("people").alias("people"), F.sum("contacted").alias("contacted"))
    sources = once.groupBy(*SCOPE, "step", "source").agg(F.count("*").alias("people")).withColumn("contacted", F.lit(0).cast("long"))
    shape = lambda df, kind, **named: df.select(
        *SCOPE, F.lit(kind).alias("kind"), "step", named.get("source", none).alias("source"), named.get("month", none).alias("month"), "people", "contacted"
    )
    return (
        shape(totals, "total")
        .unionByName(shape(months, "month", month=F.col("month")))
        .unionByName(shape(sources, "source", source=F.col("source")))
    )


def fill_months(months: DataFrame, by: list[str], now: Column | None = None) -> DataFrame:
    """Rows (by, month yyyy-MM, people, contacted) on one axis from the first month to
    the last (or now's, if later), empty months as zeros, with running totals.

    The axis is a sequence made from one aggregate row, crossed with the distinct `by`
    values (steps), never with people.
    """
    m = months.where("month is not null")
    last = F.max("month") if now is None else F.greatest(F.max("month"), F.date_format(now, "yyyy-MM"))
    span = m.agg(F.min("month").alias("a"), last.alias("b")).where("a is not null")
    axis = span.select(F.explode(F.expr("sequence(to_date(a, 'yyyy-MM'), to_date(b, 'yyyy-MM'), interval 1 month)")).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    full = months.select(*by).distinct().join(F.broadcast(axis), F.lit(True), "cross").join(m, [*by, "month"], "left")
    w = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = full.select(*by, "month", zero("people").alias("people"), zero("contacted").alias("contacted"))
    return full.withColumns({"cumulative_people": F.sum("people").over(w), "cumulative_contacted": F.sum("contacted").over(w)})


def outcome_people(e: DataFrame, contacted: DataFrame, people: DataFrame) -> DataFrame:
    """One row per (step, person): reach_at, sources ordered by first date (undated
    last), whether contacted, the display name (null for somebody without a person
    row), and the type-independent latest date."""
    once = e.groupBy(*SCOPE, "step", "person_key", "source").agg(F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
    per = once.groupBy(*SCOPE, "step", "person_key").agg(
        F.min("first_at").alias("reach_at"),
        F.max("last_at").alias("latest_at"),
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("first_at").isNull().alias("n"), "first_at", "source"))), lambda x: x["source"]).alias("sources"),
    )
    c = contacted.select(*SCOPE, "step", "person_key").distinct().withColumn("contacted", F.lit(True))
    names = people.select(*SCOPE, "person_key", "display_name")
    return per.join(c, [*SCOPE, "step", "person_key"], "left").join(names, [*SCOPE, "person_key"], "left").withColumn("contacted", F.coalesce("contacted", F.lit(False)))


def paged(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a total order; the whole count is a separate aggregate (total()), so
    paging past the end still has it."""
    return df.orderBy(*order).offset(offset).limit(limit)


def staff_owners(people: DataFrame, domain: str, addresses: list[str]) -> DataFrame:
    """(scope, owner_person_key) of people with one of our addresses, plus-tags ignored."""
    from factloom.functions.normalize import without_plus

    e = people.select(*SCOPE, F.col("person_key").alias("owner_person_key"), F.explode("emails").alias("email"))
    return e.where(F.lower("email").endswith(f"@{domain}") | without_plus(F.col("email")).isin(*addresses)).select(*SCOPE, "owner_person_key").distinct()


def paying_clients(facts: DataFrame, staff: DataFrame) -> DataFrame:
    """(scope, owner_person_key, client_since): earliest dated paying fact, null if all
    are undated; our own people are nobody's clients."""
    f = facts.where(F.col("live") & F.col("owner_person_key").isNotNull() & F.col("type").isin(*PAYING)).where(payment_stands())
    return f.groupBy(*SCOPE, "owner_person_key").agg(F.min("occurred_at").alias("client_since")).join(staff, [*SCOPE, "owner_person_key"], "left_anti")


def satisfied_messages(messages: DataFrame, verdicts: DataFrame, clients: DataFrame, floor: float = 0.75) -> DataFrame:
    """Messages of paying clients, at or after they became one, that were judged
    positive with at least `floor` on the very text (hash) they hold now."""
    v = verdicts.where((F.col("verdict") == "positive") & (F.col("confidence") >= floor)).select(*SCOPE, "message_key", "text_hash")
    m = messages.withColumn("text_hash", F.md5("text")).join(v, [*SCOPE, "message_key", "text_hash"], "left_semi")
    c = clients.select(*SCOPE, "owner_person_key", "client_since")
    return m.join(c, [*SCOPE, "owner_person_key"]).where("client_since is null or occurred_at is null or occurred_at >= client_since")


def fingerprint(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row that changes with the rows: count, newest time, and an order-free digest
    (the xor and sum of row hashes), so nothing is concatenated whole."""
    h = F.xxhash64(key, at)
    return df.agg(F.count("*").alias("n"), F.max(at).alias("newest"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).select(
        "n", "newest", F.md5(F.concat_ws("|", F.col("n").cast("string"), F.col("x").cast("string"), F.col("s").cast("string"))).alias("digest")
    )
