"""State by precedence, opting out and roll-ups on small inputs with known answers."""

from __future__ import annotations

import datetime as dt

from factloom.operators import persons


def test_states_follow_their_order(spark):
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    people = make([(p, f"h{p}" if p in "ab" else None) for p in "abcdefghij"], "person_id string, human_id string")
    leads = make([("a", 1, "l1", False), ("a", 2, "l2", None), ("c", 1, "l3", True), ("d", 1, "l9", False)], "person_id string, place int, lead_id string, failed boolean")
    states = make([("l2", None, "interested"), ("l1", None, "contacted"), (None, "hb", "meeting")], "lead_id string, human_id string, state string")
    payments = make([("a", ["active"], 1, 0), ("d", ["canceled"], 0, 0), ("d", ["past_due", "canceled"], 0, 1), ("e", None, 0, 2), ("e", ["canceled"], 0, 0), ("f", [], 0, 0)], "person_id string, subscription_statuses array<string>, paid_charges int, refunded_charges int")
    deals = make([("e", "won"), ("f", "lost"), ("f", "open"), ("g", None), ("g", "odd")], "person_id string, status string")
    t = lambda d: dt.datetime(2026, 1, d)
    chats = make([("f", "x", t(1)), ("g", "old", t(1)), ("g", "new", t(2)), ("h", None, t(3))], "person_id string, status string, last_at timestamp")
    mails = make([("h", False, True), ("h", None, None), ("i", True, True)], "person_id string, replied boolean, clicked boolean")
    got = {r.person_id: (r.state, r.state_source) for r in persons.person_states(people, leads, states, payments, deals, chats, mails).collect()}
    assert got == {
        "a": ("contacted", "lead_service"), "b": ("meeting", "lead_service"), "c": ("unavailable", "lead_service"), "d": ("subscription_past_due", "stripe"), "e": ("refunded", "stripe"),
        "f": ("deal_open", "gohighlevel"), "g": ("new", "matrix"), "h": ("clicked", "instantly"), "i": ("replied", "instantly"), "j": ("in_conversation", "none"),
    }
    blind = {r.person_id: r.state for r in persons.person_states(people, leads, states, payments, deals, chats, mails, states_known=False).collect()}
    assert [blind[p] for p in "abcde"] == ["unavailable"] * 4 + ["refunded"]


def test_opting_out_and_rollups(spark):
    people = spark.createDataFrame([("o", "b", "p", [("crm", "1"), ("web", "2")]), ("o", "b", "q", [("crm", "3")]), ("o", "x", "r", [("crm", "1")]), ("o", "b", "s", None)], "org_id string, brand_id string, person_id string, presences array<struct<source:string,source_ref:string>>")
    contacts = spark.createDataFrame([("o", "b", 2, True), ("o", "b", 1, False), ("o", "b", 3, None)], "org_id string, brand_id string, id int, unsubscribed boolean")
    assert [r.person_id for r in persons.opted_out(people, contacts).collect()] == ["p"]
    assert sorted(r.person_id for r in persons.opted_out(people, contacts, negate=True).collect()) == ["q", "r", "s"]
    t = lambda d: dt.datetime(2026, 1, d)
    rows = [("p", "crm", "Ann", t(2), t(3), 4, None, 1), ("p", "web", " ", t(1), t(9), 2, None, None), ("p", "crm", "Anna", None, t(5), None, None, None), ("q", "web", None, None, None, None, None, None)]
    pr = spark.createDataFrame(rows, "person_id string, source string, display_name string, first_activity_at timestamp, last_activity_at timestamp, message_count int, inbound_count int, outbound_count int")
    got = {r.person_id: (r.sources, r.first_at, r.last_at, r.message, r.inbound, r.outbound, r.name) for r in persons.presence_rollups(pr).collect()}
    assert got == {"p": (["crm", "web"], t(1), t(9), 6, None, 1, "Anna"), "q": (["web"], None, None, None, None, None, None)}
