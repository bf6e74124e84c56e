"""Funnel events from a CRM's history and appointments, the reach of each step with what
it implies, and the passage of people from one step to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The steps that prove an earlier one.
IMPLIED_BY = {
    "form_submitted": [],
    "meeting_booked": ["meeting_attended", "meeting_not_held", "sale"],
    "meeting_attended": ["sale"],
    "meeting_not_held": [],
    "sale": [],
    "deal_lost": [],
}
#: Fixed value: seconds between a card's creation and its first stage that still make one event.
CREATION_SLACK = 5


def stage_entries(history: DataFrame, by: list[str], observed: str, changed: str, tie: str) -> DataFrame:
    """History rows with the value and name before them and whether they are the first:
    rows of one card in the order they were observed, undated changes first."""
    w = Window.partitionBy(*by).orderBy(F.col(observed), F.col(changed).asc_nulls_first(), F.col(tie))
    return history.withColumns(
        {
            "previous_value": F.lag("value").over(w),
            "previous_name": F.lag("stage_name").over(w),
            "is_first": F.lag(tie).over(w).isNull(),
        }
    )


def is_creation(first: Column, changed: Column, created: Column) -> Column:
    """A card that began in its stage: no stage before, dated within the slack of its creation."""
    apart = F.abs(F.unix_micros(changed.cast("timestamp")) - F.unix_micros(created.cast("timestamp")))
    return first & F.coalesce(apart <= CREATION_SLACK * 1_000_000, F.lit(False))


def stage_events(entries: DataFrame, cards: DataFrame, meanings: DataFrame, floor: float = 0.5) -> DataFrame:
    """Entries into a stage that means a step, where the stage before did not mean it, each
    with `step`, occurred_at, confidence, entered_at_creation and the columns it came with. Meanings under the floor, and 'none', mean nothing. A
    meaning holds for a stage under the name (and of the connection) it was judged by,
    where meanings tell these. A card created
    in a late stage is undated evidence; creation dates only a booked meeting."""
    also = [c for c in ("stage_name", "connection") if c in meanings.columns]
    was = {"stage_name": "previous_name", "connection": "connection"}
    m = meanings.where(F.col("confidence") >= floor)
    mine = m.select(F.col("stage_id").alias("value"), "meaning", "confidence", *also)
    before = m.select(F.col("stage_id").alias("previous_value"), F.col("meaning").alias("previous_meaning"), *[F.col(c).alias(was[c]) for c in also])
    made = cards.select("card_id", F.col("created_at").alias("__created"))
    e = (
        entries.join(F.broadcast(mine.where("meaning <> 'none'")), ["value", *also])
        .join(F.broadcast(before), ["previous_value", *[was[c] for c in also]], "left")
        .join(made, "card_id", "left")
        .where(~F.col("meaning").eqNullSafe(F.col("previous_meaning")))
    )
    began = is_creation(F.col("is_first"), F.col("changed_at"), F.col("__created"))
    at = F.when(began & (F.col("meaning") != "meeting_booked"), F.lit(None)).otherwise(F.col("changed_at"))
    kept = [c for c in entries.columns if c not in ("occurred_at", "step")]
    return e.select(*kept, F.col("meaning").alias("step"), at.alias("occurred_at"), "confidence", F.coalesce(began, F.lit(False)).alias("entered_at_creation"), F.col("__created").alias("card_created_at"))


def first_entries(events: DataFrame) -> DataFrame:
    """(card_id, step, occurred_at): the earliest entry of a card into a step, undated last."""
    return events.groupBy("card_id", "step").agg(F.min("occurred_at").alias("occurred_at"))


#: Statuses of a meeting that has an outcome, and origins that are a form.
NOT_HELD, FORM_ORIGINS = ("noshow", "cancelled"), ("form", "survey")
#: The columns of every branch of the funnel's evidence.
EVIDENCE = {
    "ext": "string", "step": "string", "occurred_at": "timestamp", "date_basis": "string", "source": "string", "source_id": "string", "calendar_name": "string", "appointment_status": "string", "starts_at": "timestamp",
    "pipeline_name": "string", "stage_name": "string", "observed_at": "timestamp", "meaning_confidence": "double", "form_id": "string", "form_name": "string", "attribution_medium": "string", "entered_at_creation": "boolean", "opportunity_created_at": "timestamp",
}


def _branch(df: DataFrame, **told: Column) -> DataFrame:
    return df.select("org_id", "brand_id", *[told.get(n, F.lit(None)).cast(t).alias(n) for n, t in EVIDENCE.items()])


def appointment_evidence(a: DataFrame) -> DataFrame:
    """A booked meeting of every valid appointment, dated by its booking, and its outcome, if
    it has one, dated by its start: one pass, two rows."""
    c = F.col
    same = {"calendar_name": c("calendar_name"), "appointment_status": c("status"), "starts_at": c("starts_at"), "ext": c("contact"), "source": F.lit("appointment"), "source_id": c("external_id")}
    outcome = F.when(c("status") == "showed", "meeting_attended").when(c("status").isin(*NOT_HELD), "meeting_not_held")
    both = F.array(F.when(~c("status").eqNullSafe("invalid"), F.struct(F.lit("meeting_booked").alias("step"), c("booked_at").alias("at"), F.lit("booked_at").alias("basis"))), F.when(outcome.isNotNull(), F.struct(outcome.alias("step"), c("starts_at").alias("at"), F.lit("scheduled_start").alias("basis"))))
    rows = a.withColumn("__e", F.explode(both)).where("__e is not null")
    return _branch(rows, **same, step=c("__e.step"), occurred_at=c("__e.at"), date_basis=c("__e.basis"))


def stage_evidence(events: DataFrame) -> DataFrame:
    """stage_events whose entries tell contact, card_id, pipeline_name, stage_name, observed_at."""
    c = F.col
    return _branch(
        events, ext=c("contact"), step=c("step"), occurred_at=c("occurred_at"), date_basis=F.lit("stage_entered_at"), source=F.lit("stage_entry"), source_id=c("card_id"), pipeline_name=c("pipeline_name"), stage_name=c("stage_name"),
        observed_at=c("observed_at"), meaning_confidence=c("confidence"), entered_at_creation=c("entered_at_creation"), opportunity_created_at=c("card_created_at"),
    )


def status_evidence(history: DataFrame) -> DataFrame:
    """A sale or a lost deal for every status that says so; history: contact, card_id, value,
    changed_at, pipeline_name, stage_name, observed_at."""
    c = F.col
    won = c("value") == "won"
    return _branch(
        history.where(c("value").isin("won", "lost")), ext=c("contact"), step=F.when(won, "sale").otherwise("deal_lost"), occurred_at=c("changed_at"), date_basis=F.lit("status_changed_at"),
        source=F.when(won, "won_status").otherwise("lost_status"), source_id=c("card_id"), pipeline_name=c("pipeline_name"), stage_name=c("stage_name"), observed_at=c("observed_at"),
    )


def form_evidence(forms: DataFrame) -> DataFrame:
    c = F.col
    return _branch(forms, ext=c("contact"), step=F.lit("form_submitted"), occurred_at=c("submitted_at"), date_basis=F.lit("submitted_at"), source=F.lit("form_submission"), source_id=c("external_id"), form_id=c("form_id"), form_name=c("form_name"))


def origin_evidence(contacts: DataFrame, mediums: tuple[str, ...] = FORM_ORIGINS) -> DataFrame:
    """Contacts that a form brought, dated by their creation."""
    c = F.col
    return _branch(contacts.where(c("origin_medium").isin(*mediums)), ext=c("external_id"), step=F.lit("form_submitted"), occurred_at=c("created_at"), date_basis=F.lit("contact_created_at"), source=F.lit("form_origin"), source_id=c("external_id"), attribution_medium=c("origin_medium"))


def funnel_evidence(contacts: DataFrame, *branches: DataFrame) -> DataFrame:
    """Every row of the branches with its contact (org_id, brand_id, external_id, contact_id)
    of the same organisation and brand; rows of a contact that is not mirrored are none.
    One union before one join."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    c = contacts.select("org_id", "brand_id", F.col("external_id").alias("ext"), "contact_id")
    return out.join(c, ["org_id", "brand_id", "ext"])


#: From which confidence a verdict on a label counts, and the steps each says.
LABEL_FLOOR = 0.5
STEPS_OF_VERDICT = {"client": ("client",), "former_client": ("client", "former_client"), "disqualified": ("disqualified",)}


def label_evidence(entries: DataFrame, tagged: DataFrame, verdicts: DataFrame, floor: float = LABEL_FLOOR) -> DataFrame:
    """(contact, step, occurred_at, source, source_id, label, confidence): what the name of a
    stage or of a contact's tag was judged to say.

    entries: stage_entries with contact, connection, card_id, value, stage_name, their
    previous ones, is_first, changed_at, card_created_at; tagged: contact, connection, tags;
    verdicts: connection, kind (stage, tag), label_ref, label, verdict, confidence. A step
    that the stage before says as well is no news; who becomes a client with the card's
    creation did so undated; a tag is undated. Tags are compared without case and outer space.
    """
    c = F.col
    steps = F.create_map(*[x for k, v in STEPS_OF_VERDICT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    v = verdicts.where((c("confidence") >= floor) & c("verdict").isin(*STEPS_OF_VERDICT)).withColumn("steps", steps[c("verdict")])
    stage = v.where("kind = 'stage'")
    now = stage.select("connection", c("label_ref").alias("value"), c("label").alias("stage_name"), "steps", "confidence")
    was = stage.select("connection", c("label_ref").alias("previous_value"), c("label").alias("previous_name"), c("steps").alias("said"))
    e = entries.join(now, ["connection", "value", "stage_name"]).join(was, ["connection", "previous_value", "previous_name"], "left")
    e = e.withColumn("step", F.explode(F.array_except("steps", F.coalesce("said", F.array().cast("array<string>")))))
    began = is_creation(c("is_first"), c("changed_at"), c("card_created_at"))
    at = F.when(F.coalesce(began, F.lit(False)) & c("step").isin("client", "former_client"), None).otherwise(c("changed_at")).cast("timestamp")
    stages = e.select("contact", "step", at.alias("occurred_at"), F.lit("stage_label").alias("source"), c("card_id").cast("string").alias("source_id"), c("stage_name").alias("label"), "confidence")
    t = tagged.select("contact", "connection", F.explode(F.array_distinct(F.transform("tags", lambda x: F.lower(F.trim(x))))).alias("label"))
    t = t.join(v.where("kind = 'tag' and label_ref = ''").select("connection", "label", "steps", "confidence"), ["connection", "label"])
    return stages.unionByName(t.select("contact", F.explode("steps").alias("step"), F.lit(None).cast("timestamp").alias("occurred_at"), F.lit("contact_tag").alias("source"), c("contact").cast("string").alias("source_id"), "label", "confidence"))


def union_evidence(*parts: DataFrame) -> DataFrame:
    """Evidence of different kinds in one table, absent columns as nulls."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def reach_tally(rows: DataFrame, contact: str = "contact_id") -> DataFrame:
    """(step, contacts, contacts_at_or_beyond) for every known step.

    A row proves its step and those it implies; contacts are folded per step before
    they are counted, so nothing larger than (contact, step) is shuffled. Rows with an
    unknown step raise, as they would be lost in silence.
    """
    proves: dict[str, list[str]] = {s: [s] for s in IMPLIED_BY}
    for earlier, later in IMPLIED_BY.items():
        for s in later:
            proves[s].append(earlier)
    known = F.create_map(*[x for s, all_ in proves.items() for x in (F.lit(s), F.array(*map(F.lit, all_)))])
    told = F.coalesce(known[F.col("step")], F.raise_error(F.concat(F.lit("funnel reach: unknown step "), F.coalesce("step", F.lit("null")))).cast("array<string>"))
    one = rows.select(contact, "step", F.explode(told).alias("proved"))
    one = one.groupBy(contact, "proved").agg(F.max(F.col("step") == F.col("proved")).alias("direct"))
    got = one.groupBy(F.col("proved").alias("step")).agg(F.count_if("direct").alias("contacts"), F.count("*").alias("contacts_at_or_beyond"))
    steps = rows.sparkSession.createDataFrame([(s,) for s in IMPLIED_BY], "step string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return steps.join(got, "step", "left").select("step", zero("contacts"), zero("contacts_at_or_beyond"))


def leg_population(events: DataFrame, served: DataFrame, people: DataFrame) -> DataFrame:
    """(pk, from_at, contacted, automated, not_business, group_only) of everybody with a
    `from` event: the earliest date (null if none is dated); flags are false for somebody
    without a person row."""
    flags = ["automated", "not_business", "group_only"]
    who = events.where("end_ = 'from'").groupBy("pk").agg(F.min("occurred_at").alias("from_at"))
    s = served.select("pk").distinct().withColumn("contacted", F.lit(True))
    p = people.select("pk", *flags)
    got = who.join(s, "pk", "left").join(p, "pk", "left")
    return got.withColumns({c: F.coalesce(c, F.lit(False)) for c in ["contacted", *flags]})


def leg_excluded(tagged: DataFrame) -> DataFrame:
    """One row: who is left out, each person by the first reason that holds."""
    reasons, before, out = ["contacted", "automated", "not_business", "group_only"], F.lit(False), []
    for r in reasons:
        out.append(F.count_if(F.col(r) & ~before).alias(r))
        before = before | F.col(r)
    return tagged.agg(*out)


def leg_arrivals(events: DataFrame, population: DataFrame) -> DataFrame:
    """(pk, from_at, reached, to_at): the population with its `to` events. A
    `to` counts on or after the UTC day of `from`, or if either is undated. One equi-join;
    a person's events are folded before it."""
    day = lambda c: F.to_date(c)
    pop = population.where("not (contacted or automated or not_business or group_only)").select("pk", "from_at")
    to = events.where("end_ = 'to'").select("pk", "occurred_at").join(pop, "pk")
    counts = F.col("occurred_at").isNull() | F.col("from_at").isNull() | (day("occurred_at") >= day("from_at"))
    folded = to.withColumn("counts", counts).groupBy("pk").agg(
        F.max("counts").alias("reached"), F.min(F.when(F.col("counts"), F.col("occurred_at"))).alias("to_at")
    )
    return pop.join(folded, "pk", "left")


def leg_days(arrivals: DataFrame) -> DataFrame:
    """(kind, day, people): people by the day of `from`, of `to`, and of `from` among
    those who reached `to`; null is undated; kind `to_before` counts who only has earlier
    ones. Each person gives at most three rows of one aggregation."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    got = F.coalesce("reached", F.lit(False))
    kinds = F.array(
        F.struct(F.lit("from").alias("kind"), text("from_at").alias("day"), F.lit(True).alias("on")),
        F.struct(F.lit("to").alias("kind"), text("to_at").alias("day"), got.alias("on")),
        F.struct(F.lit("cohort").alias("kind"), text("from_at").alias("day"), got.alias("on")),
        F.struct(F.lit("to_before").alias("kind"), F.lit(None).cast("string").alias("day"), (F.col("reached") == F.lit(False)).alias("on")),
    )
    return arrivals.select(F.inline(F.filter(kinds, lambda k: k["on"]))).groupBy("kind", "day").agg(F.count("*").alias("people"))


def with_null_bucket(df: DataFrame, by: str) -> DataFrame:
    """Counts by bucket, always with a null bucket, commonest first and null last among
    ties (ordering is the caller's: bucket_order)."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    missing = df.sparkSession.range(1).select(F.lit(None).cast(df.schema[by].dataType).alias(by), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(missing).groupBy(by).agg(F.sum("n").alias("n"))


def bucket_order(by: str) -> list[Column]:
    return [F.desc("n"), F.col(by).asc_nulls_last()]


def stage_tree(pipelines: DataFrame, cards: DataFrame) -> DataFrame:
    """(pipeline_id, stage_id, stage_name, position, cards, amount): every stage of every
    pipeline with the count and the exact two-decimal sum of its cards; cards in a stage
    the pipeline does not have stand under `unknown`, cards of no known pipeline under a
    null pipeline (`ungrouped`)."""
    stages = pipelines.select("pipeline_id", F.posexplode("stages").alias("position", "s")).select("pipeline_id", "position", F.col("s.id").alias("stage_id"), F.col("s.name").alias("stage_name"))
    sums = cards.groupBy("pipeline_id", "stage_id").agg(F.count("*").alias("cards"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount"))
    known = pipelines.select("pipeline_id").distinct().withColumn("__known", F.lit(True))
    placed = stages.join(sums, ["pipeline_id", "stage_id"], "left").withColumns({"cards": F.coalesce("cards", F.lit(0)), "amount": F.coalesce("amount", F.lit(0).cast("decimal(28,2)"))})
    rest = sums.join(stages, ["pipeline_id", "stage_id"], "left_anti").join(F.broadcast(known), "pipeline_id", "left")
    rest = rest.groupBy(F.when(F.col("__known"), F.col("pipeline_id")).alias("pipeline_id")).agg(F.sum("cards").alias("cards"), F.sum("amount").alias("amount"))
    rest = rest.withColumns({"stage_id": F.lit(None).cast("string"), "position": F.lit(None).cast("int"), "stage_name": F.when(F.col("pipeline_id").isNull(), "ungrouped").otherwise("unknown")})
    return placed.unionByName(rest.select(placed.columns))
