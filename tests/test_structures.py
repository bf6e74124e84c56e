"""Statements, runs, pages and canonical texts on small inputs with known answers."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import canonical
from factloom.operators import runs, statements

CORRECTIONS = "correction_id int, stated_at int, person_id string, kind string, tag string, company string, domain string, point string, undone_at int, domain_kind string"
POINTS = "person_id string, point string, tags array<string>, evidence array<struct<company:string,domain:string>>, judged array<struct<company:string,domain:string>>"
TO_BRAND, NOT_BRAND, TO_USER, NOT_USER = "professional_to_brand", "professional_not_to_brand", "personal_to_user", "personal_not_to_user"


def said(n, person, kind, tag=None, company=None, point=None, undone=None):
    return (n, n, person, kind, tag, company, company and f"{company}.io", point, undone, None)


def corrected(spark, points, stated):
    got = statements.corrected_points(spark.createDataFrame(points, POINTS), spark.createDataFrame(stated, CORRECTIONS))
    return got, {r.point: (list(r.tags), r.capacity, [(c.company, c.basis) for c in r.companies]) for r in got.collect()}


def test_statements_outrank_and_are_undone(spark):
    e, j = [("c1", "c1.io")], [("c2", "c2.io")]
    points = [("p", "a", [TO_BRAND], e, j), ("p", "b", [TO_BRAND, TO_USER], None, j), ("p", "x", [], None, None), ("q", "c", [NOT_USER], e, None), ("r", "d", None, None, None), (None, "n", [TO_BRAND], None, None)]
    _, none = corrected(spark, points, [])
    assert none == {"a": ([TO_BRAND], "professional", [("c1", "evidence")]), "b": ([TO_USER, TO_BRAND], "professional", [("c2", "judged")]), "x": ([], None, []), "c": ([NOT_USER], "personal", []), "d": ([], None, []), "n": ([TO_BRAND], "professional", [])}
    # the opposite goes; a statement that names a point is for it alone; an undone one is as if never made
    _, got = corrected(spark, points, [said(1, "p", "tag_add", NOT_BRAND, point="a"), said(2, "p", "tag_add", TO_BRAND, point="x"), said(3, "p", "tag_remove", TO_BRAND, undone=9), said(4, "q", "tag_add", TO_BRAND)])
    assert got["a"] == ([NOT_BRAND], "professional", [("c1", "evidence")])
    assert got["b"] == none["b"] and got["x"] == ([TO_BRAND], "professional", []) and got["c"] == ([NOT_USER, TO_BRAND], "professional", [("c1", "evidence")])
    # the later statement wins, whichever it is
    for order, want in (((1, 2), NOT_BRAND), ((2, 1), TO_BRAND)):
        a, b = (said(order[0], "p", "tag_add", TO_BRAND), said(order[1], "p", "tag_add", NOT_BRAND))
        assert corrected(spark, points, [a, b])[1]["a"][0] == [want]
    # companies: an addition without a point reaches points of unknown company only, a removal all
    stated = [said(1, "p", "tag_add", TO_BRAND, point="x"), said(2, "p", "organization_add", company="c9"), said(3, "p", "organization_add", company="c8", point="a"), said(4, "p", "organization_remove", company="c2"), said(5, "p", "organization_add", company="c8", point="a")]
    df, got = corrected(spark, points, stated)
    assert [got[k][2] for k in "abx"] == [[("c1", "evidence"), ("c8", "user")], [], [("c9", "user")]]
    rel = {r.relation_key: (r.capacity, r.company, r.domain, list(r.tags), r.points) for r in statements.relations(df).collect()}
    assert rel["rel:p:org:c8"] == ("professional", "c8", "c8.io", [TO_BRAND], 1) and rel["rel:p:pro"] == ("professional", None, None, [TO_USER, TO_BRAND], 1)
    assert rel["rel:q:personal"] == ("personal", None, None, [NOT_USER], 1) and not [k for k in rel if k.startswith("rel:r")]


def test_tags_of_scores_and_domains(spark):
    schema = ", ".join(f"{t} double" for t in statements.TAGS)
    rows = spark.createDataFrame([(0.5, 0.1, 0.9, 0.0), (0.2, 0.4, 0.4, 0.1), (None, None, 0.1, None), (None, None, None, None)], schema).select(F.struct(*statements.TAGS).alias("s"))
    assert [list(r.t) for r in rows.select(statements.tags_of_scores(F.col("s")).alias("t")).collect()] == [[TO_USER, TO_BRAND], [NOT_USER], [TO_BRAND], []]
    judged = spark.createDataFrame([("a.io", "organization", 0.9, "A"), ("b.io", "organization", 0.4, "B"), ("m.io", "organization", 0.8, "M"), ("z.io", "mailbox_provider", 0.9, None)], "domain string, kind string, confidence double, company string")
    stated = [(1, 1, None, "domain_kind", None, None, "m.io", None, None, "mailbox_provider"), (2, 2, None, "domain_kind", None, "Z", "z.io", None, None, "organization"), (3, 3, None, "domain_kind", None, None, "a.io", None, 5, "mailbox_provider"), (4, 4, None, "domain_kind", None, "N", "new.io", None, None, "organization")]
    v = statements.domain_verdicts(judged, spark.createDataFrame(stated, CORRECTIONS))
    assert {r.domain: (r.kind, r.confidence, r.company) for r in v.collect()} == {"a.io": ("organization", 0.9, "A"), "b.io": ("organization", 0.4, "B"), "m.io": ("mailbox_provider", 1.0, None), "z.io": ("organization", 1.0, "Z"), "new.io": ("organization", 1.0, "N")}
    p = spark.createDataFrame([("p", [TO_BRAND, TO_USER], "email", "x@a.io", "a.io"), ("p", [NOT_BRAND], "site", "a.io", "a.io"), ("p", [TO_USER], "email", "x@z.io", "z.io"), ("q", [TO_BRAND], "email", "x@b.io", "b.io"), ("q", [TO_BRAND], "email", "y@m.io", "m.io")], "person_id string, tags array<string>, evidence_kind string, value string, domain string")
    assert [tuple(r) for r in statements.organisations(p, v).collect()] == [("p", "A", "a.io", [TO_BRAND, NOT_BRAND], 2)]


def greedy(sizes, max_runs, max_rows):
    out, batch, n_runs, n_rows = [], 0, 0, 0
    for n in sizes:
        if n_runs and (n_runs + 1 > max_runs or n_rows + n > max_rows):
            batch, n_runs, n_rows = batch + 1, 0, 0
        out.append(batch)
        n_runs, n_rows = n_runs + 1, n_rows + n
    return out


@pytest.mark.parametrize("max_runs, max_rows, most, n", [(4, 20, 12, 130), (5, 9, 25, 60), (3, 100, 4, 41), (500, 1000, 4, 30)])
def test_batches_are_those_of_the_sequential_rule(spark, monkeypatch, max_runs, max_rows, most, n):
    monkeypatch.setattr(runs, "WIDTH", 3)
    rng = random.Random(n)
    sizes = [rng.randint(1, most) for _ in range(n)]
    rows = [(f"r{i}", i, k) for i, s in enumerate(sizes) for k in range(s)] + [(None, 3, 3)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "run string, a int, b int")
    got = runs.batches(df, "run", ["a", "b"], max_runs, max_rows, block=5)
    assert got.count() == len(rows) - 1
    assert {(r.run, r.batch) for r in got.collect()} == {(f"r{i}", b) for i, b in enumerate(greedy(sizes, max_runs, max_rows))}
    assert runs.batches(df.limit(0), "run", ["a", "b"], max_runs, max_rows).collect() == []


def test_pages_hold_whole_contacts(spark):
    rng = random.Random(1)
    rows = [(f"c{rng.randrange(40):02}", i) for i in range(300)] + [(None, 999)]
    e = spark.createDataFrame(rows, "contact_id string, event int").repartition(5)
    contacts = sorted({c for c, _ in rows if c})
    seen = []
    for offset in range(0, len(contacts) + 7, 7):
        page = runs.contact_page(e, 7, offset).collect()
        mine = contacts[offset : offset + 7]
        assert sorted(r.event for r in page) == sorted(i for c, i in rows if c in mine)
        seen += [r.event for r in page]
    assert sorted(seen) == sorted(i for c, i in rows if c)
    assert {(r.contact_id, r.page) for r in runs.contact_pages(e, 7).collect()} == {(c, i // 7) for i, c in enumerate(contacts)}


def test_canonical_texts(spark):
    schema = "b struct<z:double,`10`:long,`9`:string,a:array<struct<y:int,x:string>>>, A map<string,double>, t timestamp, e string, n string, u boolean"
    at = dt.datetime(2026, 10, 24, 1, 2, 3, 45_678)
    row = ((1.0, 7, 'q"\\\n\x01\x7f/é', [(1, None), None]), {"b": 1e21, "é": 1e-7, "10": 100.0, "2": -0.5, "02": 123456789012345680000.0, "4294967295": 0.000001, "ﬁ": 2.0, "😀": 3.0}, at, "", None, True)
    df = spark.createDataFrame([row], schema).select(F.struct("*").alias("r"))
    text = df.select(canonical.canonical_json(F.col("r"), df.schema["r"].dataType, frozenset(["n"])).alias("t")).first().t
    assert text == (
        '{"A":{"2":-0.5,"10":100,"02":123456789012345680000,"4294967295":0.000001,"b":1e+21,"é":1e-7,"😀":3,"ﬁ":2},'
        '"b":{"9":"q\\"\\\\\\n\\u0001\x7f/é","10":7,"a":[{"x":null,"y":1},null],"z":1},"e":"","t":"2026-10-24T01:02:03.045Z","u":true}'
    )
    numbers = [0.0, -0.0, 3e-310, 1.7976931348623157e308, 0.1, 1e20, 123.456, 1e-6, 9.999e-7, 12345678.9, -1e7, 1.5e300, float("nan"), float("inf"), None, 2.0**53, 1234567.0, 0.00123]
    want = ["0", "0", "3e-310", "1.7976931348623157e+308", "0.1", "100000000000000000000", "123.456", "0.000001", "9.999e-7", "12345678.9", "-10000000", "1.5e+300", "null", "null", "null", "9007199254740992", "1234567", "0.00123"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = [r.t for r in rows.select("i", canonical.canonical_json(F.col("x"), rows.schema["x"].dataType).alias("t")).orderBy("i").collect()]
    assert got == want
    f = spark.createDataFrame([("payment", at, None, "c1", (5, "x")), (None, None, "day", None, None)], "type string, at timestamp, basis string, contact string, payload struct<b:int,a:string>")
    h = [r.h for r in f.select(canonical.content_hash(F.col("type"), F.col("at"), F.col("basis"), F.col("contact"), F.col("payload"), f.schema["payload"].dataType).alias("h")).collect()]
    assert h == [hashlib.sha256(x.encode()).hexdigest() for x in ('["payment","2026-10-24T01:02:03.045Z",null,"c1",{"a":"x","b":5}]', '[null,null,"day",null,null]')]
