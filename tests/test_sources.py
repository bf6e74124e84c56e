"""Uploads, mirrors and streams on small inputs with known answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from factloom.sources import mirrors, uploads
from factloom.streaming import feeds


def test_upload_to_silver(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿Email,Full Name,Phone,Unsubscribed,Marketing Consent,Note,Note\n Bob@X.io ,Bob Van Jones,"+1 (415) 555-0000",TRUE,no,"two\nlines",b\n\n,,,,yes,,\nc@x.io\n', encoding="utf-8")
    headers, rows = uploads.read_upload(spark, str(path))
    assert headers == ["Email", "Full Name", "Phone", "Unsubscribed", "Marketing Consent", "Note", "Note_2"]
    mapping = uploads.typed_columns(headers)
    assert [mapping[h] for h in headers] == ["email", "full_name", "phone", "other", "other", "other", "other"]
    got = uploads.silver_contacts(rows, headers, mapping).orderBy("source_row_id").collect()
    assert len(got) == 3
    b = got[0]
    assert (b.primary_email, b.first_name, b.last_name, b.phone_e164) == ("bob@x.io", "Bob", "Van Jones", "+14155550000")
    assert (b.consent_status, b.unsubscribed, b.raw_attributes["Note"]) == ("denied", True, "two\nlines")
    assert (got[1].primary_email, got[1].consent_status, got[1].unsubscribed) == (None, "granted", False)
    assert (got[2].primary_email, got[2].consent_status) == ("c@x.io", "unknown")
    samples = {r.header: r.samples for r in uploads.column_profiles(rows, headers).collect()}
    assert samples["Email"] == ["Bob@X.io", "c@x.io"] and samples["Phone"] == ["+1 (415) 555-0000"]


def test_mirrors(spark):
    r = spark.createDataFrame([(1, "a"), (2, "b")], "id int, payload string")
    stored = mirrors.bronze(r, None, ["id"])
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id int, payload string")
    assert sorted(x.id for x in mirrors.bronze(new, stored, ["id"]).collect()) == [2, 3]
    c = spark.createDataFrame([("a", "eur", 100, 40, "succeeded"), ("a", "eur", 5, None, "succeeded"), ("a", "usd", 9, 0, "failed")], "customer string, currency string, amount_minor long, amount_refunded long, status string")
    assert [x.paid for x in mirrors.net_paid(c).collect()] == [{"eur": 65}]
    users = spark.createDataFrame([("s", "s@us"), ("a", "a@x"), ("b", "b@x"), *[(x, f"{x}@x") for x in "cdef"]], "user_id string, email string")
    members = spark.createDataFrame([("o", "s", 1, "s"), ("o", "a", 2, "s"), ("o", "b", 3, "s"), ("p", "a", 1, None), ("p", "d", 2, None), ("q", "a", 1, "e"), ("q", "e", 2, "e"), ("q", "f", 3, "e")], "org string, user_id string, joined_at int, org_created_by string")
    assert sorted(x.user_id for x in mirrors.signups(users, members, F.col("email").endswith("@us")).collect()) == ["a", "c", "d", "e"]
    # an undated member comes last, and of one date the smaller membership is the first
    dated = spark.createDataFrame([("o", "a", None, "s", "m1"), ("o", "b", 2, "s", "m2"), ("p", "c", 1, "s", "m9"), ("p", "d", 1, "s", "m3"), ("q", "e", None, "s", "m5"), ("q", "f", None, "s", "m4")], "org string, user_id string, joined_at int, org_created_by string, membership_id string")
    assert sorted(x.user_id for x in mirrors.signups(users, dated, F.col("email").endswith("@us")).collect()) == ["b", "d", "f"]


def test_stream_sessions_and_appends(spark, tmp_path):
    t = lambda h, m: dt.datetime(2026, 1, 1, h, m)
    rows = [("a", 1, t(1, 0)), ("a", 2, t(1, 30)), ("a", 2, t(1, 30)), ("a", 3, t(2, 1)), ("b", 4, t(1, 0))]
    schema = "channel string, id int, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = feeds.deduplicated(feeds.file_stream(spark, str(tmp_path / "in"), schema), ["id"], "ts")
    for _ in range(2):  # the second run finds nothing new
        feeds.append_once(stream, str(tmp_path / "out"), str(tmp_path / "cp")).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    s = feeds.sessions(feeds.file_stream(spark, str(tmp_path / "in"), schema), "channel", "ts")
    q = s.writeStream.format("memory").queryName("sessions_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.channel, r.calls) for r in spark.table("sessions_out").collect())
    assert got == [("a", 1), ("a", 3), ("b", 1)]
