"""Every builder on a row of its table, and the emission's reasons and order."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from factloom.operators import families, facts

AT = dt.datetime(2026, 9, 1, 2, 3, 4, 5_600)
ISO = "2026-09-01T02:03:04.005Z"
FUNNEL = "step string, source string, source_id string, external_contact_id string, contact_id string, occurred_at timestamp, date_basis string, calendar_name string, starts_at timestamp, pipeline_name string, stage_name string, observed_at timestamp, meaning_confidence double, form_id string, form_name string, attribution_medium string, appointment_status string, entered_at_creation boolean, opportunity_created_at timestamp"
TABLES = {
    "crm_contacts": ("external_id string, id string, source_created_at timestamp, origin_medium string, lead_source string, contact_type string", [("x1", "r1", AT, None, "ads", None), (None, "r2", AT, None, None, None)]),
    "funnel_events": (FUNNEL, [
        ("meeting_booked", "appointment", "a1", "x1", "r1", AT, "created_at", "Cal", AT, None, None, None, None, None, None, None, "confirmed", None, None),
        ("meeting_not_held", "appointment", "a1", "x1", "r1", AT, "scheduled", "Cal", AT, None, None, None, None, None, None, None, "noshow", None, None),
        ("sale", "stage_entry", "d1", "x1", "r1", None, "none", None, None, "P", "Won", AT, 0.9, None, None, None, None, True, AT),
        ("deal_lost", "lost_status", "d1", "x1", "r1", AT, "status_changed_at", None, None, None, None, None, None, None, None, None, None, None, None),
        ("form_submitted", "form", "f1", "x1", "r1", AT, "created_at", None, None, None, None, None, None, "7", "Form", None, None, None, None),
    ]),
    "label_events": ("step string, source string, source_id string, external_contact_id string, contact_id string, occurred_at timestamp, date_basis string, pipeline_name string, stage_name string, tag string, confidence double, observed_at timestamp", [("client", "stage_label", "d1", "x1", "r1", AT, "stage", "P", "S", None, 0.8, AT), ("disqualified", "contact_tag", "x1", "x1", "r1", None, "none", None, None, "no", 0.7, None)]),
    "deal_history": ("opportunity_id string, kind string, value string, changed_at timestamp, external_contact_id string, contact_id string, pipeline_name string, stage_name string, observed_at timestamp", [("d1", "status", "open", None, "x1", "r1", "P", "S", AT)]),
    "chat_messages": ("event_id string, own_sent boolean, sent_at timestamp, channel_handle string, contact_id string, channel string, room_id string, text string, msgtype string", [("$e1", False, AT, "h1", "r3", "whatsapp", "!r", "hi", "m.text")]),
    "group_members": ("room_id string, member string, joined_at timestamp, contact_id string, channel string, group_name string, membership string", [("!g", "@m", AT, "r3", "whatsapp", "G", "join")]),
    "group_messages": ("event_id string, sender string, sent_at timestamp, contact_id string, channel string, room_id string, group_name string, text string, msgtype string", [("$e2", "@own", AT, None, "whatsapp", "!g", "G", "hello", "m.text"), ("$e1", "@m", AT, "r3", "whatsapp", "!g", "G", "again", "m.text")]),
    "mails": ("address string, message_key string, direction string, sent_at timestamp, thread_id string, subject string, text string, text_clean string, sender string, recipients array<string>", [("a@x", "k", "inbound", AT, "t", "s", "b", None, "a@x", None), ("a@x", "k2", "draft", AT, "t", "s", "b", None, "a@x", None)]),
    "mailbox_messages": ("id string, address string, direction string, role string, occurred_at timestamp, sequence_lead boolean, mailbox string, kind string, message_id string, thread_key string, subject string, text string, from_address string", [("m1", "a@x", "in", "cc", AT, False, "b@us", "reply", "<1>", "t", "s", "b", "c@x"), ("m2", "a@x", "in", "sender", AT, True, "b@us", "reply", "<1>", "t", "s", "b", "c@x")]),
    "visitors": ("external_id string, id string, source_created_at timestamp, phone_only boolean, not_signup boolean", [("v1", "r4", AT, None, None), ("v2", "r5", AT, True, None)]),
    "visits": ("external_id string, occurred_at timestamp, person_id string, contact_id string, session_id string, pageviews int, url string, name string, ended_at timestamp, referrer string, machine boolean", [("w1", AT, "v1", "r4", "s", 3, None, "/", None, None, True)]),
    "product_events": ("external_id string, occurred_at timestamp, person_id string, contact_id string, name string, text string, properties map<string,string>, session_id string, path string, url string, machine boolean", [("p1", AT, "v1", "r4", "Step", "Step", {"b": "1", "a": "2"}, "s", "/", None, None), ("p2", AT, "v1", "r4", "Step", "Step", None, None, "/", None, None)]),
    "auth_users": ("external_id string, id string, source_created_at timestamp, signed_up boolean", [("u1", "r6", AT, None), ("u2", "r7", AT, False)]),
    "payments": ("kind string, external_id string, customer_id string, contact_id string, occurred_at timestamp, amount_minor long, currency string, status string, description string, refunded boolean, amount_refunded long, charge string, reason string, canceled_at timestamp, ended_at timestamp, interval string, cancel_at_period_end boolean", [("payment", "ch", "cus", "r8", AT, 5, "eur", "succeeded", None, None, None, None, None, None, None, None, None), ("refund", "re", "cus", "r8", AT, 5, "eur", "succeeded", None, None, None, "ch", None, None, None, None, None), ("subscription", "su", "cus", "r8", AT, 5, "eur", "canceled", None, None, None, None, None, None, None, "month", None)]),
    "uploads": ("id string, email string, phone string, source_row_id string, uploaded_at timestamp, upload_id string, filename string", [("r9", None, "+33", "17", AT, "up", "f.csv"), ("r10", "q@x", None, "18", AT, "up", "f.csv"), ("r11", None, None, "19", AT, "up", "f.csv")]),
    "person_tags": ("person_id string, identity_keys array<string>, tag string, user_ids array<string>, brand_id string", [("P", ["k"], "professional_to_brand", ["z", "a"], "B")]),
    "person_organisations": ("person_id string, identity_keys array<string>, company string, domain string, tags array<string>", [("P", ["k"], "C", "c.io", ["b", "a"])]),
    "person_relations": ("person_id string, identity_keys array<string>, relation_key string, capacity string, company string, domain string, tags array<string>", [("P", ["k"], "rel:P:pro", "professional", None, None, [])]),
    "credit_events": ("event_id string, kind string, email string, at timestamp, date_basis string, credit_org_id string, org_label string, episode_id string", [("e9", "credit_ran_out", "m@x", AT, "recorded_at", "o", None, "ep")]),
    "newsletters": ("id string, recipient string, sent_at timestamp, release_id string, list_slug string, subject string, from_address string", [("n1", "m@x", AT, "rel", "list", "S", "us@x")]),
    "web_chats": ("message_id string, role string, sent_at timestamp, email string, channel string, text string, session_id string, visitor_id string", [("c1", "user", AT, "m@x", "web", "hi", "s1", None)]),
}
KEYS = {
    "gohighlevel|contact|x1", "gohighlevel|appointment|a1|booked", "gohighlevel|appointment|a1|outcome", "gohighlevel|stage_entry|d1|P|Won|null", f"gohighlevel|status|d1|deal_lost|{ISO}", "gohighlevel|form|f1",
    f"gohighlevel|stage_label|d1|P|S|{ISO}|client", "gohighlevel|contact_tag|x1|no|disqualified", "gohighlevel|history|d1|status|open|null", "matrix|$e1", "matrix|$e2", "matrix|member|!g|@m", "gmail|a@x|k", "sending_mailbox|a@x|m1",
    "posthog|signup|v1", "posthog|visit|w1", "posthog|event|p1", "clerk|signup|u1", "stripe|payment|ch", "stripe|refund|re", "stripe|subscription|su|canceled", "csv|row:17", "csv|email:q@x", "crm|connection_tag|P|professional_to_brand",
    "crm|organization_link|P|C", "crm|relation|rel:P:pro", "billing|e9|m@x", "transactional|newsletter|n1", "copilot|web|c1",
}


def test_every_family_is_built(spark):
    tables = {n: spark.createDataFrame(rows, ddl) for n, (ddl, rows) in TABLES.items()}
    got = {r.natural_key: r for r in families.candidates(tables).collect()}
    assert set(got) == KEYS
    assert {r.family for r in got.values()} == set(families.FAMILIES) - {"calendar_meeting"}  # stated by its own matcher
    assert all(r.source == families.FAMILIES[r.family].source for r in got.values())
    assert {k for k, r in got.items() if r.machine} == {"posthog|visit|w1"} and {k for k, r in got.items() if r.unattributed} == {"matrix|$e2"}
    assert got["matrix|$e1"].type == "message_in"  # stated by a thread and a group: the first builder's
    assert got["sending_mailbox|a@x|m1"].type == "message_copied" and got["stripe|subscription|su|canceled"].occurred_at is None
    assert got["gohighlevel|appointment|a1|outcome"].payload.endswith('"reason":"noshow","stageName":null,"startsAt":"' + ISO + '","via":"appointment"}')
    assert '"enteredAtCreation":true' in got["gohighlevel|stage_entry|d1|P|Won|null"].payload and "enteredAtCreation" not in got["gohighlevel|form|f1"].payload
    assert got["posthog|event|p1"].payload == '{"event":"Step","path":"/","properties":{"a":"2","b":"1"},"sessionId":"s","text":"Step","url":null}'
    assert got["csv|row:17"].standalone and got["csv|row:17"].keys == ["phone:+33"] and got["gmail|a@x|k"].keys == ["email:a@x"]
    assert got["clerk|signup|u1"].content_hash == hashlib.sha256(f'["signup","{ISO}","user_created_at","u1",{{}}]'.encode()).hexdigest()
    assert got["transactional|newsletter|n1"].payload.startswith('{"channel":"email","from":"us@x","kind":"newsletter","newsletter":{"listSlug":"list","releaseId":"rel"},')


def test_an_emission_is_written_in_order(spark):
    changed = spark.createDataFrame([("k1", "corrected", "vendor_record_changed", "h2"), ("k2", "new", None, "h3"), ("k3", "unchanged", None, "h4"), ("k4", "restated", "human_identified", "h5"), ("k5", "withdrawn", "source_retired", "h6"), ("k6", "held", None, None)], "natural_key string, change string, reason string, content_hash string")
    meta = spark.createDataFrame([("person_merged", "p9")], "type string, person_key string")
    rows = families.feed_rows(changed, meta, spark.createDataFrame([(77,)], "fact_id long"))
    got = [(r.feed_seq, r.ord, r.key, r.reason, r.content_hash) for r in facts.sequenced(rows, ["ord", "key"], 100).orderBy("feed_seq").collect()]
    assert got == [(101, 0, "p9", "person_merged", None), (102, 1, "77", None, None), (103, 2, "k1", "vendor_record_changed", None), (104, 2, "k4", "human_identified", None), (105, 2, "k5", "source_retired", None), (106, 3, "k1", None, "h2"), (107, 3, "k2", None, "h3"), (108, 3, "k4", None, "h5")]
    assert rows.where(F.col("ord") == 3).count() == 3
