"""Fact families, and candidates built from them by configuration: every builder is a row of
expressions over one mirrored table, and all builders make one union with one layout."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import canonical


@dataclass(frozen=True)
class Family:
    """source; whether a fact goes with its record (snapshot), whether it is stated once
    and never corrected (immutable)."""

    source: str
    snapshot: bool
    immutable: bool = False


#: The families of facts.
FAMILIES = {
    "ghl_contact": Family("gohighlevel", True),
    "ghl_funnel": Family("gohighlevel", True),
    "ghl_history": Family("gohighlevel", False),
    "matrix_message": Family("matrix", False),
    "matrix_membership": Family("matrix", False),
    "gmail_message": Family("gmail", False),
    "mailbox_message": Family("sending_mailbox", False),
    "posthog_person": Family("posthog", True),
    "posthog_visit": Family("posthog", True),
    "posthog_event": Family("posthog", True),
    "stripe_money": Family("stripe", True),
    "stripe_subscription": Family("stripe", False),
    "clerk_user": Family("clerk", True),
    "csv_contact": Family("csv", False, True),
    "crm_connection_tag": Family("crm", True),
    "crm_organization": Family("crm", True),
    "crm_relation": Family("crm", True),
    "calendar_meeting": Family("google_calendar", True),
    "billing_credit": Family("billing", False, True),
    "newsletter_send": Family("transactional", False, True),
    "web_chat_message": Family("copilot", False, True),
}
#: Families that nothing states any more.
RETIRED = ("platform_signup",)


@dataclass(frozen=True)
class Builder:
    """How a table's rows become candidates. `key` and `presence` are templates with columns
    in braces (a null reads `null`, a time as text to the millisecond); the others are
    SQL expressions over the table's columns."""

    table: str
    family: str
    type: str
    key: str
    ref: str
    at: str
    basis: str
    contact: str = "null"
    row: str = "null"
    presence: str | None = None
    keys: str = "array()"
    standalone: str = "false"
    payload: dict[str, str] = field(default_factory=dict)
    #: Payload members that are left out where they are null.
    absent: frozenset[str] = frozenset()
    where: str = "true"
    machine: str = "false"
    unattributed: str = "false"
    #: Columns that the templates need beside the table's own.
    derived: dict[str, str] = field(default_factory=dict)


_EMAIL = "array(concat('email:', {0}))"
_FUNNEL = {"via": "source", "calendarName": "calendar_name", "startsAt": "starts_at", "pipelineName": "pipeline_name", "stageName": "stage_name", "observedAt": "observed_at", "meaningConfidence": "meaning_confidence", "formId": "form_id", "formName": "form_name", "attributionMedium": "attribution_medium"}
#: Natural keys, dating rules and payloads, one row a kind of record.
BUILDERS = (
    Builder("crm_contacts", "ghl_contact", "'added_to_crm'", "gohighlevel|contact|{external_id}", "external_id", "source_created_at", "'created_at'", "external_id", "id", "gohighlevel:{external_id}", where="external_id is not null",
            payload={"origin": "coalesce(origin_medium, lead_source)", "originMedium": "origin_medium", "leadSource": "lead_source", "contactType": "contact_type"}),
    Builder("funnel_events", "ghl_funnel", "step", "gohighlevel|appointment|{source_id}|{half}", "source_id", "occurred_at", "date_basis", "external_contact_id", "contact_id", "gohighlevel:{external_contact_id}", where="source = 'appointment'", derived={"half": "case when step = 'meeting_booked' then 'booked' else 'outcome' end"},
            payload={**_FUNNEL, "appointmentStatus": "case when step <> 'meeting_booked' then appointment_status end", "reason": "case when step = 'meeting_not_held' then coalesce(appointment_status, stage_name) end"}, absent=frozenset(["reason"])),
    Builder("funnel_events", "ghl_funnel", "step", "gohighlevel|stage_entry|{source_id}|{pipeline_name}|{stage_name}|{occurred_at}", "source_id", "occurred_at", "date_basis", "external_contact_id", "contact_id", "gohighlevel:{external_contact_id}", where="source = 'stage_entry'",
            payload={**_FUNNEL, "appointmentStatus": "case when step <> 'meeting_booked' then appointment_status end", "enteredAtCreation": "case when entered_at_creation then true end", "opportunityCreatedAt": "case when entered_at_creation then opportunity_created_at end"}, absent=frozenset(["enteredAtCreation", "opportunityCreatedAt"])),
    Builder("funnel_events", "ghl_funnel", "step", "gohighlevel|status|{source_id}|{step}|{occurred_at}", "source_id", "occurred_at", "date_basis", "external_contact_id", "contact_id", "gohighlevel:{external_contact_id}", where="source in ('won_status', 'lost_status')",
            payload={**_FUNNEL, "appointmentStatus": "appointment_status"}),
    Builder("funnel_events", "ghl_funnel", "step", "gohighlevel|{source}|{source_id}", "source_id", "occurred_at", "date_basis", "external_contact_id", "contact_id", "gohighlevel:{external_contact_id}", where="source not in ('appointment', 'stage_entry', 'won_status', 'lost_status')",
            payload={**_FUNNEL, "appointmentStatus": "appointment_status"}),
    Builder("label_events", "ghl_funnel", "step", "gohighlevel|stage_label|{source_id}|{pipeline_name}|{stage_name}|{occurred_at}|{step}", "source_id", "occurred_at", "date_basis", "external_contact_id", "contact_id", "gohighlevel:{external_contact_id}", where="source = 'stage_label'",
            payload={"via": "source", "pipelineName": "pipeline_name", "stageName": "stage_name", "tag": "tag", "verdictConfidence": "confidence", "observedAt": "observed_at"}),
    Builder("label_events", "ghl_funnel", "step", "gohighlevel|contact_tag|{source_id}|{tag}|{step}", "source_id", "occurred_at", "date_basis", "external_contact_id", "contact_id", "gohighlevel:{external_contact_id}", where="source <> 'stage_label'",
            payload={"via": "source", "pipelineName": "pipeline_name", "stageName": "stage_name", "tag": "tag", "verdictConfidence": "confidence", "observedAt": "observed_at"}),
    Builder("deal_history", "ghl_history", "'deal_status_changed'", "gohighlevel|history|{opportunity_id}|{kind}|{value}|{changed_at}", "opportunity_id", "changed_at", "case when kind = 'stage' then 'stage_entered_at' else 'status_changed_at' end", "external_contact_id", "contact_id", "gohighlevel:{external_contact_id}",
            payload={"change": "kind", "pipelineName": "pipeline_name", "stageName": "stage_name", "stageId": "case when kind = 'stage' then value end", "status": "case when kind = 'status' then value end", "observedAt": "observed_at"}),
    Builder("chat_messages", "matrix_message", "case when own_sent then 'message_out' else 'message_in' end", "matrix|{event_id}", "event_id", "sent_at", "'sent_at'", "channel_handle", "contact_id", "matrix:{channel_handle}",
            payload={"channel": "channel", "threadId": "room_id", "text": "text", "msgtype": "msgtype"}),
    Builder("group_members", "matrix_membership", "'group_member'", "matrix|member|{room_id}|{member}", "concat(room_id, '|', member)", "joined_at", "'joined_at'", "member", "contact_id", "matrix:{member}",
            payload={"channel": "channel", "threadId": "room_id", "groupName": "group_name", "membership": "membership"}),
    Builder("group_messages", "matrix_message", "'group_message'", "matrix|{event_id}", "event_id", "sent_at", "'sent_at'", "case when contact_id is not null then sender end", "contact_id", "matrix:{sender}", unattributed="contact_id is null",
            payload={"channel": "channel", "threadId": "room_id", "groupName": "group_name", "text": "text", "msgtype": "msgtype", "direction": "'inbound'"}),
    Builder("mails", "gmail_message", "case when direction = 'inbound' then 'message_in' else 'message_out' end", "gmail|{address}|{message_key}", "message_key", "sent_at", "'sent_at'", presence="gmail:{address}", keys=_EMAIL.format("address"), where="direction in ('inbound', 'outbound')",
            payload={"channel": "'email'", "threadId": "thread_id", "subject": "subject", "text": "text", "textClean": "text_clean", "from": "sender", "to": "coalesce(recipients, cast(array() as array<string>))"}),
    Builder("mailbox_messages", "mailbox_message", "case when direction = 'out' then 'message_out' when role = 'sender' then 'message_in' else 'message_copied' end", "sending_mailbox|{address}|{id}", "id", "occurred_at", "case when direction = 'out' then 'sent_at' else 'received_at' end", presence="sending_mailbox:{address}", keys=_EMAIL.format("address"), where="not sequence_lead",
            payload={"channel": "'email'", "mailboxMessageId": "id", "mailbox": "mailbox", "kind": "kind", "role": "role", "messageId": "message_id", "threadKey": "thread_key", "subject": "subject", "text": "text", "from": "from_address"}),
    Builder("visitors", "posthog_person", "'signup'", "posthog|signup|{external_id}", "external_id", "source_created_at", "'person_created_at'", "external_id", "id", "posthog:{external_id}", where="external_id is not null and not coalesce(phone_only, false) and not coalesce(not_signup, false)"),
    Builder("visits", "posthog_visit", "'website_visit'", "posthog|visit|{external_id}", "external_id", "occurred_at", "'visit_started_at'", "person_id", "contact_id", "posthog:{person_id}", machine="coalesce(machine, false)",
            payload={"sessionId": "session_id", "pageviews": "pageviews", "firstUrl": "url", "entryPath": "name", "endedAt": "ended_at", "referrer": "referrer"}),
    Builder("product_events", "posthog_event", "'product_event'", "posthog|event|{external_id}", "external_id", "occurred_at", "'event_timestamp'", "person_id", "contact_id", "posthog:{person_id}", machine="coalesce(machine, false)", where="session_id is not null",
            payload={"event": "name", "text": "text", "properties": "properties", "sessionId": "session_id", "path": "path", "url": "url"}),
    Builder("auth_users", "clerk_user", "'signup'", "clerk|signup|{external_id}", "external_id", "source_created_at", "'user_created_at'", "external_id", "id", "clerk:{external_id}", where="external_id is not null and coalesce(signed_up, true)"),
    Builder("payments", "stripe_money", "kind", "stripe|{kind}|{external_id}", "external_id", "occurred_at", "'created'", "customer_id", "contact_id", "stripe:{customer_id}", where="kind = 'payment' and customer_id is not null",
            payload={"amountMinor": "amount_minor", "currency": "currency", "status": "status", "description": "description", "refunded": "coalesce(refunded, false)", "amountRefunded": "amount_refunded"}),
    Builder("payments", "stripe_money", "kind", "stripe|{kind}|{external_id}", "external_id", "occurred_at", "'created'", "customer_id", "contact_id", "stripe:{customer_id}", where="kind = 'refund' and customer_id is not null",
            payload={"amountMinor": "amount_minor", "currency": "currency", "status": "status", "charge": "charge", "reason": "reason"}),
    Builder("payments", "stripe_subscription", "'subscription_changed'", "stripe|subscription|{external_id}|{status}", "external_id",
            "case when status = 'canceled' then canceled_at when status = 'incomplete_expired' then ended_at when status in ('active', 'trialing', 'incomplete') then occurred_at end",
            "case when status = 'canceled' then 'canceled_at' when status = 'incomplete_expired' then 'ended_at' when status in ('active', 'trialing', 'incomplete') then 'start_date' else 'status_changed_at' end",
            "customer_id", "contact_id", "stripe:{customer_id}", where="kind = 'subscription' and customer_id is not null",
            payload={"status": "status", "amountMinor": "amount_minor", "currency": "currency", "interval": "interval", "cancelAtPeriodEnd": "coalesce(cancel_at_period_end, false)"}),
    Builder("uploads", "csv_contact", "'added_to_crm'", "csv|{stated}", "coalesce(email, source_row_id, concat('phone:', phone))", "uploaded_at", "'uploaded_at'", row="id", keys="filter(array(concat('email:', email), concat('phone:', phone)), k -> k is not null)", standalone="true", where="coalesce(email, phone) is not null", derived={"stated": "case when email is not null then concat('email:', email) else concat('row:', coalesce(source_row_id, concat('phone:', phone))) end"},
            payload={"origin": "'csv_import'", "uploadId": "upload_id", "filename": "filename"}),
    Builder("person_tags", "crm_connection_tag", "'connection_tag'", "crm|connection_tag|{person_id}|{tag}", "person_id", "null", "'none'", keys="identity_keys", where="person_id is not null",
            payload={"tag": "tag", "userIds": "array_sort(user_ids)", "brandId": "brand_id"}),
    Builder("person_organisations", "crm_organization", "'organization_link'", "crm|organization_link|{person_id}|{company}", "person_id", "null", "'none'", keys="identity_keys", where="person_id is not null",
            payload={"companyId": "company", "domain": "domain", "tags": "array_sort(tags)"}),
    Builder("person_relations", "crm_relation", "'relation'", "crm|relation|{relation_key}", "person_id", "null", "'none'", keys="identity_keys", where="person_id is not null",
            payload={"relationKey": "relation_key", "capacity": "capacity", "companyId": "company", "domain": "domain", "tags": "tags"}),
    Builder("credit_events", "billing_credit", "kind", "billing|{event_id}|{email}", "event_id", "at", "date_basis", keys=_EMAIL.format("email"), where="email is not null",
            payload={"accountOrgId": "credit_org_id", "accountName": "org_label", "episodeId": "episode_id", "billingEventId": "event_id"}),
    Builder("newsletters", "newsletter_send", "'message_out'", "transactional|newsletter|{id}", "id", "sent_at", "'sent_at'", keys=_EMAIL.format("recipient"),
            payload={"channel": "'email'", "kind": "'newsletter'", "newsletter": "named_struct('releaseId', release_id, 'listSlug', list_slug)", "subject": "subject", "text": "subject", "from": "from_address", "to": "array(recipient)"}),
    Builder("web_chats", "web_chat_message", "case when role = 'user' then 'message_in' else 'message_out' end", "copilot|web|{message_id}", "message_id", "sent_at", "'sent_at'", presence="copilot:{email}", keys=_EMAIL.format("email"),
            payload={"channel": "channel", "text": "text", "direction": "case when role = 'user' then 'inbound' else 'outbound' end", "conversationId": "session_id", "visitorId": "visitor_id"}),
)


def _filled(template: str, df: DataFrame) -> Column:
    """A template's text for a row."""
    parts = []
    for text, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
        if text:
            parts.append(F.lit(text))
        if name:
            kind = df.schema[name].dataType.typeName()
            at = F.concat(F.date_format(F.to_utc_timestamp(F.col(name), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
            parts.append(F.coalesce(at if kind == "timestamp" else F.col(name).cast("string"), F.lit("null")))
    return F.concat(*parts)


def built(df: DataFrame, b: Builder) -> DataFrame:
    """The candidates of one builder: natural_key, family, type, source, source_ref,
    source_contact_id, crm_contact_id, occurred_at, date_basis, payload (canonical JSON),
    content_hash, presence, keys, standalone, machine, unattributed."""
    rows = df.where(b.where).withColumns({n: F.expr(e) for n, e in b.derived.items()})
    payload = F.struct(*[F.expr(e).alias(n) for n, e in b.payload.items()]) if b.payload else F.struct(F.lit(None).cast("string").alias("none"))
    rows = rows.withColumn("__payload", payload)
    kind = rows.schema["__payload"].dataType
    text = canonical.canonical_json(F.col("__payload"), kind, b.absent if b.payload else frozenset(["none"]))
    out = rows.select(
        _filled(b.key, rows).alias("natural_key"),
        F.lit(b.family).alias("family"),
        F.expr(b.type).alias("type"),
        F.lit(FAMILIES[b.family].source).alias("source"),
        F.expr(b.ref).cast("string").alias("source_ref"),
        F.expr(b.contact).cast("string").alias("source_contact_id"),
        F.expr(b.row).cast("string").alias("crm_contact_id"),
        F.expr(b.at).cast("timestamp").alias("occurred_at"),
        F.expr(b.basis).alias("date_basis"),
        text.alias("payload"),
        (_filled(b.presence, rows) if b.presence else F.lit(None).cast("string")).alias("presence"),
        F.expr(b.keys).cast("array<string>").alias("keys"),
        F.expr(b.standalone).alias("standalone"),
        F.expr(b.machine).alias("machine"),
        F.expr(b.unattributed).alias("unattributed"),
    )
    return out.withColumn("content_hash", canonical.hash_of(F.col("type"), F.col("occurred_at"), F.col("date_basis"), F.col("source_contact_id"), F.col("payload")))


def candidates(tables: dict[str, DataFrame], builders: tuple[Builder, ...] = BUILDERS) -> DataFrame:
    """The candidates of all tables that are there, one union. A natural key that is stated
    twice (a message of a group and of a thread) is kept once: of the builder named first."""
    parts = [built(tables[b.table], b).withColumn("__at", F.lit(i)) for i, b in enumerate(builders) if b.table in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rest = [c for c in out.columns if c not in ("natural_key", "__at")]
    first = out.groupBy("natural_key").agg(F.min_by(F.struct(*rest), F.struct("__at", "content_hash")).alias("r"))
    return first.select("natural_key", "r.*")


def changes(cands: DataFrame, live: DataFrame, connected: list[str], machines: DataFrame, sessionless: DataFrame, mirrored: DataFrame, registry_gone: DataFrame, contacts: DataFrame, humans: DataFrame, auth_states_signups: bool = False) -> DataFrame:
    """(natural_key, change, reason, crm_contact_id, human_id, content_hash, owner): what an
    emission does with each candidate and each live fact.

    change: new, corrected (the old fact goes, reason vendor_record_changed), unchanged, held
    (nobody is the subject), machine, unattributed (the last two take a live fact with
    them), withdrawn, restated (the fact goes and is stated anew with another contact row
    or human) or kept. reason: why a live fact goes, else null.

    cands have `owner` (the person their subject resolves to, or null); live: natural_key,
    family, source, source_ref, content_hash, source_contact_id, crm_contact_id, human_id,
    owner. machines, sessionless, mirrored and registry_gone: source_ref of visits and
    events that are a machine's, of events without a session, of records that a connected
    payment account still mirrors, and of registry statements whose person no longer
    holds them. contacts: source, source_contact_id, crm_contact_id, the rows that are there now.
    humans: owner, human_id. One full outer join by key; the sets join by their keys.
    """
    f = F.col
    c = cands.select("natural_key", *[f(x).alias(f"c_{x}") for x in ("family", "content_hash", "owner", "machine", "unattributed", "crm_contact_id")])
    names = ("family", "source", "source_ref", "content_hash", "source_contact_id", "crm_contact_id", "human_id", "owner")
    old = live.select("natural_key", *[f(x).alias(f"l_{x}") for x in names])
    rows = c.join(old, "natural_key", "full_outer")
    for df, name in ((machines, "m"), (sessionless, "s"), (mirrored, "p"), (registry_gone, "r")):
        rows = rows.join(df.select(f("source_ref").alias("l_source_ref")).distinct().withColumn(f"is_{name}", F.lit(True)), "l_source_ref", "left")
    said, lives = f("c_family").isNotNull(), f("l_family").isNotNull()
    flagged = lambda names: f("l_family").isin(*[n for n, x in FAMILIES.items() if getattr(x, names)])
    immutable = f("c_family").isin(*[n for n, x in FAMILIES.items() if x.immutable])
    stays = lives & (immutable | (f("l_content_hash") == f("c_content_hash")))
    of_source = lambda s: f("l_family").isin(*[n for n, x in FAMILIES.items() if x.source == s])
    source_of = F.create_map(*[F.lit(x) for n, v in FAMILIES.items() for x in (n, v.source)])[f("l_family")]
    gone = flagged("snapshot") & source_of.isin(*connected) & (~of_source("crm") | f("is_r").isNotNull()) & (~of_source("stripe") | f("is_p").isNotNull())
    absent = (
        F.when((f("l_family") == "posthog_event") & f("is_s").isNotNull(), "sessionless_event")
        .when(f("l_family").isin("posthog_visit", "posthog_event") & f("is_m").isNotNull(), "machine_visit")
        .when(F.lit(auth_states_signups) & (f("l_family") == "posthog_person"), "signup_stated_by_auth_provider")
        .when(f("l_family") == "newsletter_send", "not_this_brand")
        .when(f("l_family").isin(*RETIRED), "source_retired")
        .when(F.coalesce(gone, F.lit(False)), "vendor_record_gone")
    )
    change = (
        F.when(said & f("c_machine"), "machine")
        .when(said & f("c_unattributed"), "unattributed")
        .when(said & stays, "unchanged")
        .when(said & f("c_owner").isNull(), "held")
        .when(said & lives, "corrected")
        .when(said, "new")
        .when(absent.isNotNull(), "withdrawn")
        .otherwise("kept")
    )
    rows = rows.withColumn("change", change)
    reason = F.when(~lives, None).when(f("change") == "machine", "machine_visit").when(f("change") == "unattributed", "subject_changed").when(f("change") == "corrected", "vendor_record_changed").when(f("change") == "withdrawn", absent)
    rows = rows.withColumn("reason", reason)
    # what stays is stated anew where its contact row was minted anew, or its human is known now
    now = contacts.groupBy(f("source").alias("l_source"), f("source_contact_id").alias("l_source_contact_id")).agg(F.array_sort(F.collect_set("crm_contact_id")).alias("rows_now"))
    rows = rows.join(now, ["l_source", "l_source_contact_id"], "left").join(humans.select(f("owner").alias("l_owner"), f("human_id").alias("human_now")), "l_owner", "left")
    untouched = lives & f("reason").isNull()
    minted = untouched & f("l_crm_contact_id").isNotNull() & f("rows_now").isNotNull() & ~F.array_contains("rows_now", f("l_crm_contact_id"))
    human = untouched & ~F.coalesce(minted, F.lit(False)) & f("human_now").isNotNull() & ~f("human_now").eqNullSafe(f("l_human_id"))
    row_now = F.when(F.array_contains("rows_now", f("c_crm_contact_id")), f("c_crm_contact_id")).otherwise(F.element_at("rows_now", 1))
    again = F.coalesce(minted, F.lit(False)) | F.coalesce(human, F.lit(False))
    return rows.select(
        "natural_key",
        F.when(again, "restated").otherwise(f("change")).alias("change"),
        F.when(F.coalesce(minted, F.lit(False)), "crm_contact_reminted").when(again, "human_identified").otherwise(f("reason")).alias("reason"),
        F.when(F.coalesce(minted, F.lit(False)), row_now).when(f("change").isin("new", "corrected"), f("c_crm_contact_id")).otherwise(F.coalesce("l_crm_contact_id", "c_crm_contact_id")).alias("crm_contact_id"),
        F.when(F.coalesce(human, F.lit(False)), f("human_now")).otherwise(f("l_human_id")).alias("human_id"),
        F.when(f("change").isin("new", "corrected"), f("c_content_hash")).otherwise(F.coalesce("l_content_hash", "c_content_hash")).alias("content_hash"),
        F.coalesce("l_owner", "c_owner").alias("owner"),
    )


#: The order in which an emission writes.
ORDER = {"meta": 0, "move": 1, "withdrawn": 2, "stated": 3}


def feed_rows(changed: DataFrame, meta: DataFrame, moves: DataFrame) -> DataFrame:
    """(ord, key, reason, content_hash) of an emission in the order of ORDER: people merged
    or split (type, person_key), moved facts (fact_id), facts that go, and facts that are
    stated. Number them with facts.sequenced."""
    row = lambda df, kind, key, reason, hashed: df.select(F.lit(ORDER[kind]).alias("ord"), key.cast("string").alias("key"), reason.alias("reason"), hashed.cast("string").alias("content_hash"))
    none = F.lit(None).cast("string")
    goes = changed.where("reason is not null")
    stated = changed.where("change in ('new', 'corrected', 'restated')")
    return (
        row(meta, "meta", F.col("person_key"), F.col("type"), none)
        .unionByName(row(moves, "move", F.col("fact_id"), none, none))
        .unionByName(row(goes, "withdrawn", F.col("natural_key"), F.col("reason"), none))
        .unionByName(row(stated, "stated", F.col("natural_key"), none, F.col("content_hash")))
    )
