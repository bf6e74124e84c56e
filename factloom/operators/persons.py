"""A person's state by precedence of their sources, who opted out, what a brand's segments
could name, and roll-ups of presences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a subscription that lives, and of deals, the one that decides first.
LIVE_SUBSCRIPTION = ("active", "trialing", "past_due", "unpaid")
DEALS = ("won", "open", "lost", "abandoned")


def payment_state(statuses: Column, paid: Column, refunded: Column) -> Column:
    """The state of a person's payment records: all subscription statuses, charges that
    stand and charges that went back; null where they state nothing."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for s in LIVE_SUBSCRIPTION:
        out = out.when(F.array_contains(statuses, s), f"subscription_{s}")
    return out.when(paid > 0, "paid").when(refunded > 0, "refunded").when(F.array_contains(statuses, "canceled"), "subscription_canceled")


def person_states(people: DataFrame, leads: DataFrame, lead_states: DataFrame, payments: DataFrame, deals: DataFrame, chats: DataFrame, mails: DataFrame, states_known: bool = True) -> DataFrame:
    """(person_id, state, state_source): the first of lead verdict, payments, deals, chat,
    cold mail, else in_conversation.

    people: person_id, human_id; leads: person_id, place, lead_id, failed (an address that could
    not be asked about makes the state unavailable); lead_states: lead_id or human_id, state; where they
    could not be read, whoever has a lead or a human is unavailable; payments: person_id,
    subscription_statuses, paid_charges, refunded_charges; deals: person_id, status;
    chats: person_id, status, last_at (the newest conversation decides); mails: person_id,
    replied, clicked. Each source is one aggregate a person before it joins.
    """
    by = "person_id"
    by_lead = leads.where("lead_id is not null").join(lead_states.where("lead_id is not null").select("lead_id", F.col("state").alias("s")), "lead_id").groupBy(by).agg(F.min_by("s", "place").alias("lead_state"))
    asked = leads.groupBy(by).agg(F.max(F.coalesce("failed", F.lit(False))).alias("lead_failed"), F.count("lead_id").alias("n_leads"))
    by_human = lead_states.where("human_id is not null").groupBy("human_id").agg(F.min("state").alias("human_state"))
    paid = payments.groupBy(by).agg(F.flatten(F.collect_set(F.coalesce("subscription_statuses", F.array().cast("array<string>")))).alias("statuses"), F.sum("paid_charges").alias("paid"), F.sum("refunded_charges").alias("refunded"))
    paid = paid.select(by, payment_state(F.col("statuses"), F.col("paid"), F.col("refunded")).alias("payment_state"))
    rank = F.array_position(F.array(*map(F.lit, DEALS)), F.col("status"))
    dealt = deals.where(F.col("status").isin(*DEALS)).groupBy(by).agg(F.min_by(F.concat(F.lit("deal_"), "status"), rank).alias("deal_state"))
    chat = chats.where("status is not null").groupBy(by).agg(F.max_by("status", F.struct("last_at", "status")).alias("chat_state"))
    mail = mails.groupBy(by).agg(F.max(F.coalesce("replied", F.lit(False))).alias("replied"), F.max(F.coalesce("clicked", F.lit(False))).alias("clicked"))
    rows = people.select(by, "human_id").join(by_human, "human_id", "left")
    for df in (by_lead, asked, paid, dealt, chat, mail):
        rows = rows.join(df, by, "left")
    c = F.col
    unknown = F.coalesce("lead_failed", F.lit(False))
    if not states_known:
        unknown = unknown | (F.coalesce("n_leads", F.lit(0)) > 0) | c("human_id").isNotNull()
    verdict = F.coalesce("lead_state", "human_state") if states_known else F.lit(None).cast("string")
    mailed = F.when(c("replied"), "replied").when(c("clicked"), "clicked")
    state = F.when(unknown, "unavailable").otherwise(F.coalesce(verdict, "payment_state", "deal_state", "chat_state", mailed, F.lit("in_conversation")))
    source = (
        F.when(unknown | verdict.isNotNull(), "lead_service").when(c("payment_state").isNotNull(), "stripe").when(c("deal_state").isNotNull(), "gohighlevel").when(c("chat_state").isNotNull(), "matrix").when(mailed.isNotNull(), "instantly").otherwise("none")
    )
    return rows.select(by, state.alias("state"), source.alias("state_source"))


def opted_out(people: DataFrame, contacts: DataFrame, negate: bool = False) -> DataFrame:
    """People of a brand one of whose presences is a contact that unsubscribed (or the others).

    people: org_id, brand_id, presences (array of source, source_ref); contacts: org_id,
    brand_id, id, unsubscribed."""
    scope = ["org_id", "brand_id"]
    gone = contacts.where("unsubscribed").select(*scope, F.col("id").cast("string").alias("ref")).distinct()
    refs = people.select(*scope, "person_id", F.explode("presences.source_ref").alias("ref"))
    who = refs.join(gone, [*scope, "ref"], "left_semi").select(*scope, "person_id").distinct()
    return people.join(who, [*scope, "person_id"], "left_anti" if negate else "left_semi")


def presence_rollups(presences: DataFrame) -> DataFrame:
    """(person_id, sources, first_at, last_at, messages, inbound, outbound, names) of presences:
    the span and counts over all of them, a count unknown everywhere staying null, and the name of
    the presence last active."""
    return presences.groupBy("person_id").agg(
        F.array_sort(F.collect_set("source")).alias("sources"),  # of a fixed set
        F.min("first_activity_at").alias("first_at"),
        F.max("last_activity_at").alias("last_at"),
        *[F.sum(f"{n}_count").alias(n) for n in ("message", "inbound", "outbound")],
        F.max_by("display_name", F.when(F.trim("display_name") != "", F.struct(F.coalesce("last_activity_at", F.lit("1970-01-01").cast("timestamp")), "display_name"))).alias("name"),
    )


def segment_catalogue(people: DataFrame, deals: DataFrame, tags: DataFrame, steps: DataFrame, pool: DataFrame, served: DataFrame) -> DataFrame:
    """(kind, pipeline, name, status, people, in_pool): every deal stage, tag and step that a
    segment can name, how many people hold it, and how many of these a serve could hand out.

    people: person_id, emails; deals: person_id, pipeline, stage, status; tags: person_id, tag,
    one row each; steps: person_id, step; pool: person_id of who passes the base clauses
    and is no client; served: email. Tags fold case and outer space and show their first
    spelling; the pool is decided once a person, then joins each part.
    """
    handed = people.select("person_id", F.explode("emails").alias("email")).join(served.select("email").distinct(), "email", "left_semi").select("person_id").distinct()
    free = pool.select("person_id").distinct().join(handed, "person_id", "left_anti").withColumn("free", F.lit(True))
    null = F.lit(None).cast("string")
    t = tags.where(F.trim("tag") != "")
    key = F.lower(F.trim("tag"))
    spelled = t.groupBy(key.alias("key")).agg(F.min(F.trim("tag")).alias("shown"))
    parts = (
        deals.select("person_id", F.lit("deal_stage").alias("kind"), "pipeline", F.col("stage").alias("name"), "status"),
        t.withColumn("key", key).join(spelled, "key").select("person_id", F.lit("tag").alias("kind"), null.alias("pipeline"), F.col("shown").alias("name"), null.alias("status")),
        steps.select("person_id", F.lit("step").alias("kind"), null.alias("pipeline"), F.col("step").alias("name"), null.alias("status")),
    )
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(people.select("person_id"), "person_id", "left_semi").distinct()
    rows = rows.join(free, "person_id", "left")
    return rows.groupBy("kind", "pipeline", "name", "status").agg(F.count("*").alias("people"), F.count("free").alias("in_pool"))
