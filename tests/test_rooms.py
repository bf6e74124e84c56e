"""Edits, quotes, bookings and numbers on small inputs with known answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from factloom.operators import rooms


def test_edits_quotes_and_bookings(spark):
    t = lambda n: dt.datetime(2026, 1, 1, n)
    schema = "room string, event_id string, sender string, at timestamp, body string, edits string, quotes string"
    rows = [("r", "a", "x", t(1), "hi", None, None), ("r", "b", "us", t(2), "yes", None, "a"), ("r", "c", "x", t(3), "hello", "a", None), ("r", "d", "x", t(4), "hello!", "a", None), ("r", "e", "us", t(5), "not mine", "a", None), ("r", "f", "x", t(6), "lost", "zz", "gone"), ("q", "a", "x", t(1), "other room", None, None), ("r", None, "x", t(7), "no id", "a", None), ("r", "g", "us", t(8), None, None, "b")]
    m = spark.createDataFrame(rows, schema)
    folded = {(r.room, r.event_id): r.body for r in rooms.fold_edits(m).collect()}
    assert folded == {("r", "a"): "hello!", ("r", "b"): "yes", ("r", "e"): "not mine", ("r", "f"): "lost", ("q", "a"): "other room", ("r", None): "no id", ("r", "g"): None}
    q = {r.event_id: r.quote and (r.quote.event_id, r.quote.direction, r.quote.at, r.quote.text) for r in rooms.with_quotes(rooms.fold_edits(m.where("room = 'r'")), F.col("sender") == "us").collect()}
    assert q["b"] == ("a", "inbound", t(1), "hello!") and q["f"] == ("gone", None, None, None) and q["g"] == ("b", "outbound", t(2), "yes") and q["a"] is None

    b = spark.createDataFrame([("p", 1, t(1), "cancelled"), ("p", 2, t(2), "cancelled"), ("p", 3, t(3), "confirmed"), ("p", 4, t(4), "cancelled"), ("p", 5, None, "cancelled"), ("p", 6, None, None), ("q", 7, t(1), "cancelled"), ("q", 9, t(1), "confirmed"), ("q", 8, t(1), None)], "person_id string, event_id int, booked_at timestamp, status string")
    got = {r.event_id: r.rescheduled_from for r in rooms.meetings(b).collect()}
    assert got == {3: [1, 2], 4: None, 5: None, 6: None, 8: [7], 9: None}


def test_numbers_to_ask(spark):
    one = lambda *x: spark.createDataFrame([(p,) for p in x], "phone string")
    now = F.lit("2026-09-01").cast("timestamp")
    looked = spark.createDataFrame([("+33000001", "found", dt.datetime(2020, 1, 1)), ("+33000002", "not_found", dt.datetime(2026, 8, 20)), ("+33000003", "not_found", dt.datetime(2026, 7, 1))], "phone string, outcome string, looked_up_at timestamp")
    got = rooms.numbers_to_ask([one("+33000001", "+33000002", None, "0033"), one("+33000003", "+33000004", "+33000004"), one("+33000005", "+1")], one("+33000005"), looked, now)
    assert sorted(r.phone for r in got.collect()) == ["+33000003", "+33000004"]
