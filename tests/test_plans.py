"""Every registered query of the plans against its SQL, and fixtures with known answers."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import normalize as N
from factloom.operators import facts, funnel, health, identity, messages, outcomes, serving
from factloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rel = duck.sql(catalog.oracle_sql()[name])
    got, want = told(df.columns, df.collect()), told(rel.columns, rel.fetchall())
    assert got == want
    assert got[1] or name == "name_pairs"  # no nation has 2 to 5 suppliers in this table


def test_line_days(spark):
    assert catalog.queries()["line_days"](spark, SF).count() > 0
    t = lambda h, m=0, d=1: dt.datetime(2026, 9, d, h, m)
    rows = [("a", "connected", None, None, t(1)), ("a", "connected", None, None, t(1, 10)), ("a", "connected", None, None, t(2)), ("a", "logged_out", "bye", t(2, 5), t(2, 6)), ("a", "logged_out", None, None, t(5)), ("a", "connected", None, t(6), t(6)), ("a", "connected", None, None, t(6, 15))]
    obs = spark.createDataFrame(rows, "line string, state string, reason string, since timestamp, seen_at timestamp")
    spans = sorted((r.started_at, r.last_seen_at, r.state) for r in health.fold_spans(obs).collect())
    assert spans == [(t(1), t(1, 10), "connected"), (t(2), t(2, 5), "connected"), (t(2, 5), t(6), "logged_out"), (t(6), t(6, 15), "connected")]
    days = health.line_days(health.fold_spans(obs), F.lit("2026-09-02 02:00:00").cast("timestamp")).orderBy("day").collect()
    assert [(r.status, r.connected_minutes, r.down_minutes, r.unknown_minutes) for r in days] == [("down", 30, 235, 1175), ("unknown", 0, 0, 120)]


def test_rules_that_the_tables_do_not_reach(spark):
    rows = [("p", 1, None, "u"), ("p", 2, dt.datetime(2026, 1, 1), "v"), ("p", 3, dt.datetime(2026, 1, 2), "w"), ("p", 4, None, "x")]
    m = spark.createDataFrame(rows, "person string, id int, at timestamp, text string")
    assert {r.id: r.previous_text for r in messages.previous_message(m, "person", "at", "id").collect()} == {1: None, 2: None, 3: "v", 4: None}
    c = spark.createDataFrame([("a", "s", "2"), ("b", "s", "2")], "natural_key string, source string, content_hash string")
    live = spark.createDataFrame([("a", "s", "1", "once"), ("b", "s", "1", "snapshot")], "natural_key string, source string, content_hash string, family string")
    assert {r.natural_key: r.change for r in facts.diff(c, live, ["s"], ("once",)).collect()} == {"a": "unchanged", "b": "corrected"}
    e = spark.createDataFrame([(1, "x", "New", None, None, False), (1, "x", "Old", None, None, False), (2, "n", "None", None, None, False)], "card_id int, value string, stage_name string, previous_value string, previous_name string, is_first boolean").withColumn("changed_at", F.lit("2026-01-01").cast("date"))
    cards = spark.createDataFrame([(1,), (2,)], "card_id int").withColumn("created_at", F.lit("2025-01-01").cast("date"))
    told = spark.createDataFrame([("x", "Old", "sale", 0.9), ("n", "None", "none", 0.9)], "stage_id string, stage_name string, meaning string, confidence double")
    assert [(r.card_id, r.step) for r in funnel.stage_events(e, cards, told).collect()] == [(1, "sale")]


def test_every_entry_of_a_stage_is_kept(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    h = spark.createDataFrame([(1, "a", "New", t(1), t(1), 1), (1, "b", "Won", t(2), t(2), 2), (1, "a", "New", t(3), t(3), 3), (1, "b", "Won", t(4), t(4), 4)], "card_id int, value string, stage_name string, changed_at timestamp, observed_at timestamp, id int")
    cards = spark.createDataFrame([(1, t(1))], "card_id int, created_at timestamp")
    told = spark.createDataFrame([("b", "sale", 0.9), ("a", "meeting_attended", 0.9)], "stage_id string, meaning string, confidence double")
    events = funnel.stage_events(funnel.stage_entries(h, ["card_id"], "observed_at", "changed_at", "id"), cards, told)
    assert sorted((r.id, r.step, r.occurred_at, r.entered_at_creation) for r in events.collect()) == [(1, "meeting_attended", None, True), (2, "sale", t(2), False), (3, "meeting_attended", t(3), False), (4, "sale", t(4), False)]
    assert {(r.step, r.occurred_at) for r in funnel.first_entries(events).collect()} == {("meeting_attended", t(3)), ("sale", t(2))}


def test_reached_counts_what_stands(spark):
    schema = "org_id string, brand_id string, owner_person_key string, type string, live boolean, payload struct<amount_minor:long,amount_refunded:long,status:string,refunded:boolean,form_id:string>"
    pay = lambda *x: (*x, None)
    rows = [("o", "b", "paid", "payment", True, pay(5, 0, "succeeded", False)), ("o", "b", "failed", "payment", True, pay(5, 0, "failed", False)), ("o", "b", "back", "payment", True, pay(5, 5, "succeeded", False)), ("o", "x", "other", "payment", True, pay(5, 0, "succeeded", False)), ("o", "b", "booked", "form_submitted", True, (None, None, None, None, "cal")), ("o", "b", "form", "form_submitted", True, (None, None, None, None, "f")), ("o", "b", "old", "payment", False, pay(5, 0, "succeeded", False))]
    f = spark.createDataFrame(rows, schema)
    people = spark.createDataFrame([("o", "b", k) for k in ("paid", "failed", "back", "other", "booked", "form", "old")], "org_id string, brand_id string, person_key string")
    calendars = spark.createDataFrame([("o", "b", "cal")], "org_id string, brand_id string, form_id string")
    got = lambda **k: sorted(r.person_key for r in serving.reached(people, f, ["payment", "form_submitted"], **k).collect())
    assert got(calendars=calendars) == ["form", "paid"] and got() == ["booked", "form", "paid"]
    assert got(negate=True, calendars=calendars) == ["back", "booked", "failed", "old", "other"]


def test_aliases_of_any_length(spark):
    pairs = [(f"p{i:02}", f"p{i + 1:02}") for i in range(37)] + [("x", "p05"), ("y", "y")]
    got = {r.old_id: r.id for r in identity.resolved_aliases(spark.createDataFrame(pairs, "old_id string, new_id string")).collect()}
    assert got == {f"p{i:02}": "p37" for i in range(37)} | {"x": "p37"}
    with pytest.raises(RuntimeError, match="circle"):
        identity.resolved_aliases(spark.createDataFrame([("a", "b"), ("b", "a")], "old_id string, new_id string"), max_rounds=4)


def test_normal_forms(spark):
    def one(f, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]

    assert one(N.identity_email, "  Alice@Example.COM ", "a.lice@gmail.com", "x", None) == ["alice@example.com", "a.lice@gmail.com", None, None]
    assert one(N.identity_phone, "+33 6 12 34 56 78", "0033612345678", "06 12 34 56 78", "+123") == ["+33612345678", "+33612345678", None, None]
    assert one(N.contact_phone, "+1 (415) 555-0000", "-", None) == ["+14155550000", None, None]
    assert one(N.domain, "https://www.NTT.com:8080/x?y", "x@ntt.com", "ntt", None) == ["ntt.com", "ntt.com", None, None]
    assert one(N.profile_url, "fr.linkedin.com/in/Ann-B/?x=1", "https://www.linkedin.com/company/Acme/", "example.com/in/x") == ["https://www.linkedin.com/in/ann-b", "https://www.linkedin.com/company/acme", None]
    assert one(N.twin_name, "  José   GARCÍA ", "Ann", "Ann (WA)", "visitor from x") == ["jose garcia", None, None, None]
    assert one(lambda c: N.split_name(c)[1], "Bob Van  Jones", "Bob") == ["Van Jones", None]


def test_month_spine(spark):
    rows = spark.createDataFrame([("2025-11", 3, 1), ("2026-02", 2, 0)], "month string, people long, contacted long").withColumn("step", F.lit("s"))
    got = outcomes.fill_months(rows, ["step"], F.lit("2026-10-27").cast("timestamp")).orderBy("month").collect()
    assert [r.cumulative_people for r in got] == [3, 3, 3] + [5] * 9
    assert outcomes.fill_months(rows.limit(0), ["step"]).collect() == []


def test_reach_closure(spark):
    rows = spark.createDataFrame([("won", "sale"), ("showed", "meeting_attended"), ("noshow", "meeting_not_held"), ("booked", "meeting_booked"), ("lost", "deal_lost"), ("form", "form_submitted")], "contact_id string, step string")
    got = {r.step: (r.contacts, r.contacts_at_or_beyond) for r in funnel.reach_tally(rows).collect()}
    assert got == {"meeting_booked": (1, 4), "meeting_attended": (1, 2), "sale": (1, 1), "meeting_not_held": (1, 1), "deal_lost": (1, 1), "form_submitted": (1, 1)}
    with pytest.raises(Exception, match="unknown step"):
        funnel.reach_tally(rows.withColumn("step", F.lit("odd"))).collect()


def test_people_from_keys(spark):
    schema = "source string, source_ref string, emails array<string>, phones array<string>, handle string"
    rows = [("mail", "1", ["Ann@x.io"], [], None), ("crm", "2", ["ann@x.io"], ["+33612345678"], None), ("chat", "3", [], ["0033612345678"], None), ("chat", "a", [], [], "h1"), ("chat", "b", [], [], "h1"), ("crm", "9", [], [], None)]
    ev = spark.createDataFrame([(["ann@x.io", "ann@y.io"], []), (["nobody@x.io", "no@x.io"], [])], "emails array<string>, phones array<string>")
    got = {r.person_key: (sorted(r.identity_keys), r.presences) for r in identity.cluster_people(spark.createDataFrame(rows, schema), ev).collect()}
    assert got == {
        "email:ann@x.io": (["email:ann@x.io", "email:ann@y.io", "phone:+33612345678"], 3),
        "chat:a": (["chat:a", "chat:b"], 2),
        "crm:9": (["crm:9"], 1),
    }


def test_second_addresses_of_one_number_tie_nobody(spark, tmp_path):
    """Events beyond a million: signups of different users end in one number."""
    rows = [(i + 1_000_000 * j, 10 * j + i % 3, "signup" if i % 2 == 0 else "view") for i in range(8) for j in range(3)] + [(2_000_006, 0, "signup")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df, rel = catalog.queries()["people_clusters"](spark, str(tmp_path)), con.sql(catalog.oracle_sql()["people_clusters"])
    got = told(df.columns, df.collect())
    assert got == told(rel.columns, rel.fetchall()) and len(got[1]) == 9
