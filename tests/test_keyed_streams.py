"""Streams with keyed state: in any order of arrival and over restarts they end in what
the batch operators give."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import health
from factloom.streaming import feeds, keyed

T0 = dt.datetime(2026, 9, 1)
OBS = "line string, state string, reason string, since timestamp, seen_at timestamp"
CONTACTS = "org_id string, brand_id string, artifact_id string, contact_id string, phone string, at timestamp, loaded_at timestamp"


def minute(n):
    return T0 + dt.timedelta(minutes=n)


@pytest.fixture()
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    yield keyed.with_state_store(spark)
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def observations(seed=4, n=160):
    rng = random.Random(seed)
    rows, at = [], {}
    for _ in range(n):
        line = rng.choice("abc")
        at[line] = at.get(line, 0) + rng.choice([0, 3, 5, 9, 15, 16, 40])
        state = rng.choice(["connected", "connected", "logged_out", "reconnecting"])
        since = rng.choice([None, None, at[line] - rng.randint(-3, 30)])
        rows.append((line, state, rng.choice([None, "x", "y"]), None if since is None else minute(since), minute(at[line])))
    return rows


def in_batches(rows, at, jitter, parts, seed=1):
    """The rows in order of arrival: each late by less than the watermark, in `parts` files."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[at] + dt.timedelta(minutes=rng.uniform(0, jitter)))
    size = -(-len(late) // parts)
    return [late[i : i + size] for i in range(0, len(late), size)]


def run(spark, made, schema, batches, folder, restart_after=None):
    """Feed the batches one file each; after `restart_after` of them the query ends and
    another one begins from its checkpoint. Returns what was written."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if restart_after is not None and (n == restart_after or n == len(batches) - 1):
            stream = made(feeds.file_stream(spark, f"{folder}/in", schema, 1))
            feeds.append_once(stream, f"{folder}/out", f"{folder}/cp").outputMode("append" if made is keyed.given_numbers else "update").start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_spans_of_a_stream_are_those_of_a_table(spark, store, tmp_path):
    rows = observations()
    end = max(r[4] for r in rows) + dt.timedelta(hours=2)
    batches = in_batches(rows, 4, 8, 5) + [[("end", "connected", None, None, end)], [("end", "connected", None, None, end + dt.timedelta(hours=1))]]
    told = run(spark, keyed.folded_spans, OBS, batches, tmp_path, restart_after=2)
    got = keyed.newest_spans(told).where("line <> 'end'").select("line", "state", "reason", "started_at", "last_seen_at")
    want = health.fold_spans(spark.createDataFrame(rows, OBS))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    assert want.count() > 40
    open_ones = keyed.newest_spans(told).where("not closed and line <> 'end'").groupBy("line").count().collect()
    assert sorted(map(tuple, open_ones)) == [("a", 1), ("b", 1), ("c", 1)]


def test_state_of_a_silent_line_goes(spark, store, tmp_path):
    month = [[("a", "connected", "r", None, minute(0)), ("b", "logged_out", None, None, minute(1))], [("c", "connected", None, None, minute(60 * 24 * 40))], [("c", "connected", None, None, minute(60 * 24 * 40 + 30))]]
    told = run(spark, keyed.folded_spans, OBS, month, tmp_path, restart_after=0)
    closed = {(r.line, r.closed) for r in keyed.newest_spans(told).collect()}
    assert closed == {("a", True), ("b", True), ("c", False)}
    left = spark.read.format("statestore").option("stateVarName", "span").load(f"{tmp_path}/cp")
    assert [r.line for r in left.select("key.line").collect()] == ["c"]


def test_numbers_are_told_once_and_history_never(spark, store, tmp_path):
    loaded = minute(100)
    rows = [
        ("o", "b", "crm", "1", "+1", minute(5), loaded),  # first load
        ("o", "b", "crm", "2", "+2", minute(100), loaded),
        ("o", "b", "crm", "3", "+3", minute(130), loaded),  # news
        ("o", "b", "web", "4", "+1", minute(150), minute(10)),  # known by then
        ("o", "b", "web", "5", "+3", minute(140), minute(10)),
        ("o", "x", "web", "6", "+1", minute(150), minute(10)),  # another brand
        ("o", "b", "new", "7", "+9", minute(160), None),  # still loading
        ("o", "b", "crm", "8", None, minute(160), loaded),
        ("o", "b", "web", "9", "+4", minute(131), minute(10)),
        ("o", "b", "crm", "0", "+4", minute(131), loaded),  # same time: the smaller contact
    ]
    far = [[("o", "z", "end", str(k), f"+{k}", minute(400 + 100 * k), minute(1))] for k in range(2)]
    batches = in_batches(rows, 5, 9, 4, seed=2) + far
    got = run(spark, keyed.given_numbers, CONTACTS, batches, tmp_path, restart_after=1)
    table = spark.createDataFrame(rows, CONTACTS)
    want = keyed.given_so_far(table)
    told = sorted(map(tuple, got.where("brand_id <> 'z'").select(*want.columns).collect()))
    assert told == sorted(map(tuple, want.collect()))
    assert {(r[1], r[2], r[3], r[5]) for r in told} == {("b", "+1", "before_watch", "1"), ("b", "+2", "before_watch", "2"), ("b", "+3", "detected", "3"), ("x", "+1", "detected", "6"), ("b", "+4", "detected", "0")}
    # a row later than the watermark, and the same number again, tell nothing more
    again = run(spark, keyed.given_numbers, CONTACTS, [[("o", "b", "web", "0", "+2", minute(3), minute(1))], [("o", "z", "end", "9", "+77", minute(2000), minute(1))], [("o", "z", "end", "9", "+78", minute(3000), minute(1))]], tmp_path, restart_after=0)
    assert again.where("brand_id <> 'z'").count() == len(told)
    assert again.select(F.col("phone")).where("phone = '+77'").count() == 1
