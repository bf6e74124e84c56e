"""Registered queries over statements, relations, runs, pages, canonical texts and keys that
come late, with their SQL. The tables are made from the test tables by rule."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import canonical
from factloom.operators import families, funnel, ownership, persons, rooms, runs, statements
from factloom.plans.registry import query
from factloom.plans.views import table
from factloom.session import shared_dir
from factloom.sources import stores
from factloom.streaming import keyed

#: Places of the event types, in order of their names.
_TYPES = ("click", "error", "purchase", "signup", "view")


def _picked(names: tuple, at: str):
    return F.element_at(F.array(*map(F.lit, names)), F.expr(f"cast({at} as int)") + 1)


def points(spark: SparkSession, sf: str) -> DataFrame:
    """A user's kinds of events as contact points, with tags and companies by rule."""
    p = table(spark, sf, "events").select("user_id", "event_type").distinct()
    p = p.withColumn("i", F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type")) - 1).withColumn("k", F.expr("(user_id + i) % 6"))
    one = F.when(F.col("k") < 4, F.array(_picked(statements.TAGS, "k % 4")))
    two = F.array(F.lit(statements.TAGS[0]), F.lit(statements.TAGS[2]))
    company = lambda n: F.array(F.struct(F.concat(F.lit("c"), F.expr(f"user_id % {n}")).alias("company"), F.concat(F.lit("c"), F.expr(f"user_id % {n}"), F.lit(".io")).alias("domain")))
    return p.select(
        F.concat(F.lit("p"), "user_id").alias("person_id"),
        F.concat("event_type", F.lit(":"), "user_id").alias("point"),
        F.coalesce(one, F.when(F.col("k") == 5, two)).alias("tags"),
        F.when(F.expr("user_id % 3 = 0 and i in (2, 3)"), company(7)).alias("evidence"),
        F.when(F.expr("user_id % 4 = 1"), company(5)).alias("judged"),
    )


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a statement of its user; every fifth one undone."""
    e = table(spark, sf, "events")
    kind = _picked(("tag_add", "tag_remove", "organization_add", "organization_remove"), "event_id % 4")
    tagged = F.expr("event_id % 4 < 2")
    company = F.concat(F.lit("c"), F.expr("event_id div 4 % 7"))
    return e.select(
        F.col("event_id").alias("correction_id"),
        F.col("ts").alias("stated_at"),
        F.concat(F.lit("p"), "user_id").alias("person_id"),
        kind.alias("kind"),
        F.when(tagged, _picked(statements.TAGS, "event_id div 4 % 4")).alias("tag"),
        F.when(~tagged, company).alias("company"),
        F.when(~tagged, F.concat(company, F.lit(".io"))).alias("domain"),
        F.when(F.expr("event_id % 3 <> 0"), F.concat("event_type", F.lit(":"), "user_id")).alias("point"),
        F.when(F.expr("event_id % 5 = 0"), F.col("ts")).alias("undone_at"),
    )


_TAG_LIST = "['personal_to_user', 'personal_not_to_user', 'professional_to_brand', 'professional_not_to_brand']"
#: Statements replayed one by one.
_POINTS = f"""p AS (
  SELECT 'p' || user_id AS person_id, event_type || ':' || user_id AS point, user_id,
    list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS i FROM (SELECT DISTINCT user_id, event_type FROM events)
), first AS (
  SELECT person_id, point,
    CASE WHEN (user_id + i) % 6 < 4 THEN [{_TAG_LIST}[CAST((user_id + i) % 6 AS INT) + 1]] WHEN (user_id + i) % 6 = 5 THEN ['personal_to_user', 'professional_to_brand'] ELSE [] END AS tags,
    CASE WHEN user_id % 3 = 0 AND i IN (2, 3) THEN ['c' || (user_id % 7) || '/evidence'] WHEN user_id % 4 = 1 THEN ['c' || (user_id % 5) || '/judged'] ELSE [] END AS companies FROM p
), s AS (
  SELECT 'p' || user_id AS person_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id % 4 AS kind,
    CASE WHEN event_id % 4 < 2 THEN {_TAG_LIST}[CAST(event_id // 4 % 4 AS INT) + 1] END AS tag,
    CASE WHEN event_id % 4 < 2 THEN {_TAG_LIST}[CAST(xor(event_id // 4 % 4, 1) AS INT) + 1] END AS other,
    CASE WHEN event_id % 4 >= 2 THEN 'c' || (event_id // 4 % 7) END AS company,
    CASE WHEN event_id % 3 <> 0 THEN event_type || ':' || user_id END AS point FROM events WHERE event_id % 5 <> 0
), t AS (
  SELECT person_id, point, CAST(0 AS BIGINT) AS n, tags FROM first
  UNION ALL
  SELECT t.person_id, t.point, s.n, CASE WHEN s.tag IS NULL OR (s.point IS NOT NULL AND s.point <> t.point) THEN t.tags
    WHEN s.kind = 1 THEN list_filter(t.tags, lambda x: x <> s.tag)
    ELSE list_append(list_filter(t.tags, lambda x: x <> s.tag AND x <> s.other), s.tag) END
  FROM t JOIN s ON s.person_id = t.person_id AND s.n = t.n + 1
), tagged AS (
  SELECT person_id, point, list_filter({_TAG_LIST}, lambda x: list_contains(tags, x)) AS tags FROM (SELECT person_id, point, arg_max(tags, n) AS tags FROM t GROUP BY 1, 2)
), able AS (
  SELECT *, CASE WHEN list_contains(tags, 'professional_to_brand') THEN 'professional' WHEN list_contains(tags, 'personal_to_user') OR list_contains(tags, 'personal_not_to_user') THEN 'personal'
    WHEN list_contains(tags, 'professional_not_to_brand') THEN 'professional' END AS capacity FROM tagged
), c AS (
  SELECT person_id, point, CAST(0 AS BIGINT) AS n, companies FROM first JOIN able USING (person_id, point) WHERE capacity = 'professional'
  UNION ALL
  SELECT c.person_id, c.point, s.n, CASE WHEN s.company IS NULL OR (s.point IS NOT NULL AND s.point <> c.point) THEN c.companies
    WHEN s.kind = 3 THEN list_filter(c.companies, lambda x: NOT starts_with(x, s.company || '/'))
    WHEN (s.point IS NOT NULL OR len(c.companies) = 0) AND len(list_filter(c.companies, lambda x: starts_with(x, s.company || '/'))) = 0 THEN list_append(c.companies, s.company || '/user')
    ELSE c.companies END
  FROM c JOIN s ON s.person_id = c.person_id AND s.n = c.n + 1
), pts AS (
  SELECT able.*, coalesce(k.companies, []) AS companies FROM able LEFT JOIN (SELECT person_id, point, arg_max(companies, n) AS companies FROM c GROUP BY 1, 2) k USING (person_id, point)
)"""


@query(f"""WITH RECURSIVE {_POINTS} SELECT person_id, point, array_to_string(tags, ',') AS tags, capacity, array_to_string(companies, ',') AS companies FROM pts""")
def corrected_points(spark: SparkSession, sf: str) -> DataFrame:
    got = statements.corrected_points(points(spark, sf), corrections(spark, sf))
    told = F.transform("companies", lambda c: F.concat_ws("/", c["company"], c["basis"]))
    return got.select("person_id", "point", F.array_join("tags", ",").alias("tags"), "capacity", F.array_join(told, ",").alias("companies"))


@query(f"""WITH RECURSIVE {_POINTS}, r AS (
  SELECT person_id, point, tags, capacity, unnest(CASE WHEN capacity = 'professional' AND len(companies) > 0 THEN list_transform(companies, lambda x: split_part(x, '/', 1)) ELSE [NULL] END) AS company FROM pts WHERE capacity IS NOT NULL
), k AS (
  SELECT 'rel:' || person_id || ':' || CASE WHEN capacity = 'personal' THEN 'personal' WHEN company IS NOT NULL THEN 'org:' || company ELSE 'pro' END AS relation_key, capacity, company, point, tags FROM r
)
SELECT relation_key, capacity, company, count(DISTINCT point) AS points, array_to_string(list_filter({_TAG_LIST}, lambda x: list_contains(flatten(list(tags)), x)), ',') AS tags FROM k GROUP BY 1, 2, 3""")
def person_relations(spark: SparkSession, sf: str) -> DataFrame:
    got = statements.relations(statements.corrected_points(points(spark, sf), corrections(spark, sf)))
    return got.select("relation_key", "capacity", "company", "points", F.array_join("tags", ",").alias("tags"))


@query("""WITH pr AS (
  SELECT o_custkey, o_orderkey, 't' || (o_orderkey % 97) AS thread, CASE WHEN o_orderkey % 4 = 0 THEN 'm' || (o_orderkey % 31) END AS posts, CASE WHEN o_orderkey % 2 = 0 THEN 'g' || (o_orderkey % 53) END AS grp,
    CASE o_orderstatus WHEN 'F' THEN 'stripe' WHEN 'O' THEN 'gmail' ELSE 'matrix' END AS source, o_orderkey % 3 = 0 AS empty FROM orders
), v AS (SELECT 't' || i AS item, i % 5 AS k FROM range(97) t(i) WHERE i % 3 <> 0 UNION ALL SELECT 'm' || i, i % 5 FROM range(31) t(i) WHERE i % 2 = 0 UNION ALL SELECT 'g' || i, i % 5 FROM range(53) t(i)
), e AS (
  SELECT o_custkey, o_orderkey, t.k AS tk, m.k AS mk, g.k AS gk, source = 'stripe' AND NOT empty AS tool FROM pr LEFT JOIN v t ON t.item = thread LEFT JOIN v m ON m.item = posts LEFT JOIN v g ON g.item = grp
), n AS (
  SELECT o_custkey, o_orderkey, unnest([tk, coalesce(mk, CASE gk WHEN 0 THEN 1 ELSE gk END), CASE WHEN tool THEN 2 END]) AS k FROM e
)
SELECT o_custkey, 'o' || o_orderkey AS point,
  concat_ws(',', CASE WHEN bool_or(k = 0 OR (k = 4 AND false)) THEN 'personal_to_user' END, CASE WHEN bool_or(k = 1) THEN 'personal_not_to_user' END, CASE WHEN bool_or(k = 2) THEN 'professional_to_brand' END, CASE WHEN bool_or(k = 3) THEN 'professional_not_to_brand' END) AS tags
FROM n GROUP BY o_custkey, o_orderkey""")
def presence_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a presence of its customer; k of an item is its tag's place, 4 judged without a tag."""
    o = table(spark, sf, "orders")
    presences = o.select(
        F.col("o_custkey").alias("person_id"),
        F.concat(F.lit("o"), "o_orderkey").alias("point"),
        F.concat(F.lit("t"), F.expr("o_orderkey % 97")).alias("thread"),
        F.when(F.expr("o_orderkey % 4 = 0"), F.concat(F.lit("m"), F.expr("o_orderkey % 31"))).alias("posts"),
        F.when(F.expr("o_orderkey % 2 = 0"), F.concat(F.lit("g"), F.expr("o_orderkey % 53"))).alias("group_id"),
        F.when(F.col("o_orderstatus") == "F", "stripe").when(F.col("o_orderstatus") == "O", "gmail").otherwise("matrix").alias("source"),
        F.expr("o_orderkey % 3 = 0").alias("empty_customer"),
    )
    tags = F.when(F.col("i") % 5 < 4, F.array(_picked(statements.TAGS, "i % 5 % 4"))).otherwise(F.array().cast("array<string>")).alias("tags")
    items = [spark.range(n).select(F.concat(F.lit(c), F.col("id")).alias("item"), F.col("id").alias("i")).where(kept).select("item", tags) for c, n, kept in (("t", 97, "i % 3 <> 0"), ("m", 31, "i % 2 = 0"), ("g", 53, "true"))]
    got = statements.presence_tags(presences, items[0].unionByName(items[1]).unionByName(items[2]))
    return got.select(F.col("person_id").alias("o_custkey"), "point", F.array_join("tags", ",").alias("tags"))


@query("""WITH RECURSIVE m AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT o_custkey AS a, o_custkey * 7 % 1500 + 1 AS b FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey % 3 <> 0) WHERE a <> b),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), r AS (SELECT DISTINCT a AS c, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.c)
SELECT c_custkey, coalesce(min(root), c_custkey) AS merged_into FROM customer LEFT JOIN r ON r.c = c_custkey GROUP BY c_custkey""")
def stated_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth order states that two customers are one; every third of these is undone."""
    o = table(spark, sf, "orders").where("o_orderkey % 50 = 0")
    merges = o.select(F.col("o_custkey").alias("a"), F.expr("o_custkey * 7 % 1500 + 1").alias("b"), F.when(F.expr("o_orderkey % 3 = 0"), F.col("o_orderdate")).alias("undone_at"))
    return statements.merged_people(table(spark, sf, "customer").select("c_custkey"), merges, "c_custkey")


@query("""WITH RECURSIVE g AS (SELECT l_orderkey || '-' || (l_linenumber % 2) AS run, min(l_orderkey) AS k, min(l_linenumber % 2) AS h, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT run, n, row_number() OVER (ORDER BY k, h) - 1 AS place, CAST(sum(n) OVER (ORDER BY k, h) AS BIGINT) AS upto FROM g),
nx AS (SELECT place, place + least(500, count(*) OVER (ORDER BY upto RANGE BETWEEN CURRENT ROW AND (1000 - n) FOLLOWING)) AS after FROM r),
s AS (SELECT CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS place UNION ALL SELECT batch + 1, after FROM s JOIN nx USING (place))
SELECT run, max(batch) OVER (ORDER BY place) AS batch, n AS rows FROM r LEFT JOIN s USING (place)""")
def run_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Half orders as runs: batches of at most 500 runs and 1,000 rows."""
    rows = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", F.expr("l_linenumber % 2")).alias("run"), "l_orderkey", F.expr("l_linenumber % 2").alias("half"))
    return runs.batches(rows, "run", ["l_orderkey", "half"]).groupBy("run", "batch").agg(F.count("*").alias("rows"))


@query("""SELECT event_id, user_id, (dense_rank() OVER (ORDER BY user_id) - 1) // 25 AS page FROM events WHERE user_id IS NOT NULL""")
def contact_pages(spark: SparkSession, sf: str) -> DataFrame:
    return runs.contact_pages(table(spark, sf, "events"), 25, "user_id").select("event_id", "user_id", "page")


@query("""WITH t AS (SELECT event_id, '{"2":' || user_id || ',"10":' || event_id || ',"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z","tags":["' || event_type || '",null],"value":' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || '}' AS text FROM events)
SELECT event_id, text, sha256(text) AS hash FROM t""")
def canonical_payloads(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    e = e.select("event_id", F.struct(F.col("value"), F.col("event_id").alias("10"), F.col("ts").cast("timestamp").alias("at"), F.array("event_type", F.lit(None).cast("string")).alias("tags"), F.col("user_id").alias("2"), F.lit(None).cast("string").alias("gone")).alias("payload"))
    text = canonical.canonical_json(F.col("payload"), e.schema["payload"].dataType, frozenset(["gone"]))
    return e.select("event_id", text.alias("text")).withColumn("hash", F.sha2("text", 256))


# --- kept between runs ------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""WITH p AS (SELECT c_custkey, ['email:c' || c_custkey || '@x.io', 'phone:+' || (c_custkey % 400), 'uid:' || c_custkey] AS keys FROM customer),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'stripe' ELSE 'web' END AS source,
  list_filter(list_distinct([CASE WHEN o_orderkey % 2 = 0 THEN 'email:c' || o_custkey || '@x.io' END, CASE WHEN o_orderkey % 5 = 0 THEN 'phone:+' || (o_orderkey % 400) END, CASE WHEN o_orderkey % 7 = 0 THEN 'uid:' || o_custkey END]), lambda x: x IS NOT NULL) AS keys, o_custkey FROM orders),
m AS (SELECT c_custkey, source, o_orderkey, pk.k FROM (SELECT c_custkey, unnest(keys) AS k FROM p) pk JOIN (SELECT o_orderkey, source, o_custkey, unnest(keys) AS k FROM r) rk ON pk.k = rk.k WHERE NOT (rk.o_custkey = pk.c_custkey AND o_orderkey % 11 = 0))
SELECT 'p' || c_custkey AS person_id, source, CAST(o_orderkey AS VARCHAR) AS record_id, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM m GROUP BY c_custkey, source, o_orderkey""")
def late_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as mirrored records in a key index on disk, written in two runs; customers as
    people, who hold every eleventh of their own orders already."""
    o = table(spark, sf, "orders")
    source = F.when(F.expr("o_orderkey % 3 = 0"), "stripe").otherwise("web")
    some = lambda when, what: F.when(F.expr(when), F.array(what)).otherwise(F.array().cast("array<string>"))
    records = o.select(
        source.alias("source"),
        F.col("o_orderkey").cast("string").alias("record_id"),
        some("o_orderkey % 2 = 0", F.concat(F.lit("C"), "o_custkey", F.lit("@X.io"))).alias("emails"),
        some("o_orderkey % 5 = 0", F.concat(F.lit("+"), F.expr("o_orderkey % 400"))).alias("phones"),
        some("o_orderkey % 7 = 0", F.col("o_custkey").cast("string")).alias("user_ids"),
    )
    folder = _folder(spark, "late-joins")
    stores.append_keys(records.where("record_id % 2 = 0"), folder, 1)
    stores.append_keys(records.where("record_id % 2 <> 0"), folder, 2)
    held = o.where("o_orderkey % 11 = 0").groupBy("o_custkey").agg(F.collect_list(F.concat_ws("|", source, "o_orderkey")).alias("presences"))
    people = table(spark, sf, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("p"), "c_custkey").alias("person_id"),
        F.array(F.concat(F.lit("email:c"), "c_custkey", F.lit("@x.io")), F.concat(F.lit("phone:+"), F.expr("c_custkey % 400")), F.concat(F.lit("uid:"), "c_custkey")).alias("identity_keys"),
        "presences",
    )
    got = stores.late_joins(spark, people, folder)
    return got.select("person_id", "source", "record_id", F.array_join("keys", ",").alias("keys"))


@query("""WITH m AS (SELECT conv_id, 'k' || turn || ':' || (conv_id % 18) AS message_key, 'a' || (conv_id % 6) AS address, turn, role, coalesce(text, '') AS text FROM conversations),
d AS (SELECT address, message_key, conv_id, turn, role, text, row_number() OVER (PARTITION BY address, message_key ORDER BY CAST(conv_id AS VARCHAR), turn, role, text) AS n FROM m)
SELECT CAST(conv_id AS VARCHAR) AS unit, address, message_key, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS run, length(text) AS n_chars FROM d WHERE n = 1 AND address NOT IN ('a4')""")
def message_store(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as units, read in two runs: in the second every third one has moved and
    those of address a4 are wanted no more."""
    folder = _folder(spark, "messages")
    c = table(spark, sf, "conversations").select(F.lit("chat").alias("source"), F.col("conv_id").cast("string").alias("unit"), F.concat(F.lit("a"), F.expr("conv_id % 6")).alias("address"), F.concat(F.lit("k"), "turn", F.lit(":"), F.expr("conv_id % 18")).alias("message_key"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"), "conv_id")
    at = lambda h: F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * h))

    def read(due: DataFrame) -> DataFrame:
        rows = c.join(due.select("source", "unit"), ["source", "unit"], "left_semi")
        return rows.select("source", "unit", F.lit(False).alias("failed"), "message_key", F.timestamp_seconds(F.col("turn")).alias("at"), F.lit("in").alias("direction"), F.col("role").alias("subject"), F.col("text").alias("body"))

    units = c.select("source", "unit", "address", "conv_id").distinct()
    stores.refresh_messages(spark, folder, units.select("source", "unit", "address", at(0).alias("activity_at")), read, at(1))
    moved = units.where("address <> 'a4'").select("source", "unit", "address", F.when(F.expr("conv_id % 3 = 0"), at(2)).otherwise(at(0)).alias("activity_at"))
    stores.refresh_messages(spark, folder, moved, read, at(3))
    return stores.stored_messages(spark, folder).select("unit", "address", "message_key", F.col("run").cast("int").alias("run"), F.length("body").cast("long").alias("n_chars"))


def _owners(spark: SparkSession, sf: str, now: bool) -> DataFrame:
    """Users as people; now every tenth one's number has gone to the next user, and every
    sixteenth is one with the user before."""
    u = table(spark, sf, "events").select("user_id").distinct()
    number = F.expr("case when user_id % 10 = 3 then user_id - 1 else user_id end") if now else F.col("user_id")
    who = F.expr("case when user_id % 16 = 5 then user_id - 1 else user_id end") if now else F.col("user_id")
    rows = u.select(who.alias("u"), F.concat(F.lit("email:"), "user_id").alias("a"), F.concat(F.lit("phone:"), number).alias("b"), F.concat(F.lit("web:"), "user_id").alias("p"))
    both = rows.groupBy("u").agg(F.collect_list(F.struct("a", "b")).alias("k"), F.collect_list("p").alias("presences"))
    person = F.concat(F.lit("email:"), "u").alias("person_key")
    return both.select(person, F.array_distinct(F.flatten(F.transform("k", lambda x: F.array(x["a"], x["b"])))).alias("identity_keys"), "presences")


@query("""WITH f AS (SELECT event_id, user_id, 'email:' || CASE WHEN event_id % 3 <> 0 AND event_id % 4 = 0 AND user_id - 1 IN (SELECT user_id FROM events) THEN user_id - 1 ELSE user_id END AS owner, CASE WHEN event_id % 3 = 0 THEN 'web:' || user_id END AS presence, ['phone:' || (CASE WHEN event_id % 4 = 0 THEN user_id - 1 ELSE user_id END), 'email:' || user_id] AS keys FROM events),
u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 10 = 3 THEN user_id - 1 ELSE user_id END AS num, CASE WHEN user_id % 16 = 5 THEN user_id - 1 ELSE user_id END AS who FROM events),
k AS (SELECT key, min('email:' || who) AS p FROM (SELECT 'email:' || user_id AS key, who FROM u UNION ALL SELECT 'phone:' || num, who FROM u) GROUP BY 1),
pr AS (SELECT 'web:' || user_id AS presence, min('email:' || who) AS p FROM u GROUP BY 1),
o AS (SELECT f.*, coalesce(pr.p, k1.p, k2.p, owner) AS moved_to FROM f LEFT JOIN pr USING (presence) LEFT JOIN k k1 ON k1.key = keys[1] LEFT JOIN k k2 ON k2.key = keys[2])
SELECT owner, moved_to, presence, array_to_string(keys, ',') AS keys, count(*) AS facts FROM o WHERE owner <> moved_to AND event_id % 9 <> 0 GROUP BY 1, 2, 3, 4""")
def ownership_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Events as facts of who held their presence or first key before, every ninth one
    taken back; some name the number of the user before."""
    e = table(spark, sf, "events")
    e = e.join(e.select((F.col("user_id") + 1).alias("user_id"), F.lit(True).alias("follows")).distinct(), "user_id", "left")
    user = F.expr("case when event_id % 4 = 0 then user_id - 1 else user_id end")
    owner = F.expr("case when event_id % 3 <> 0 and event_id % 4 = 0 and follows then user_id - 1 else user_id end")
    facts = e.select("event_id", F.col("event_id").alias("fact_id"), F.concat(F.lit("email:"), owner).alias("owner"), F.when(F.expr("event_id % 3 = 0"), F.concat(F.lit("web:"), "user_id")).alias("presence"), F.array(F.concat(F.lit("phone:"), user), F.concat(F.lit("email:"), "user_id")).alias("keys"), F.lit(False).alias("standalone"))
    groups = ownership.fact_groups(facts.where("event_id % 2 = 0"))
    groups = ownership.updated_groups(groups, facts.where("event_id % 2 <> 0"), facts.where("event_id % 9 = 0"))
    moved = ownership.moves(groups, _owners(spark, sf, False), _owners(spark, sf, True))
    return moved.join(groups.select("subject", "owner", "presence", "keys"), ["subject", "owner"]).groupBy("owner", "moved_to", "presence", F.array_join("keys", ",").alias("keys")).agg(F.sum("facts").alias("facts"))


# --- candidates and emissions ----------------------------------------------------------


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(epoch_us({0}) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z'"


@query(f"""WITH e AS (SELECT *, {_ISO.format("ts")} AS iso, CAST(floor(value * 100) AS BIGINT) AS minor, ['active', 'canceled', 'trialing', 'past_due', 'incomplete_expired'][CAST(event_id % 5 AS INT) + 1] AS sub FROM events),
f AS (
  SELECT 'posthog|visit|' || event_id AS natural_key, 'posthog_visit' AS family, 'website_visit' AS type, iso AS told_at, 'visit_started_at' AS date_basis, CAST(user_id AS VARCHAR) AS contact,
    '{{"endedAt":null,"entryPath":"/p","firstUrl":null,"pageviews":' || (event_id % 9) || ',"referrer":null,"sessionId":"s' || user_id || '"}}' AS payload, event_id % 10 = 0 AS machine FROM e WHERE event_type = 'view'
  UNION ALL SELECT 'clerk|signup|u' || event_id, 'clerk_user', 'signup', iso, 'user_created_at', 'u' || event_id, '{{}}', false FROM e WHERE event_type = 'signup' AND event_id % 6 <> 0
  UNION ALL SELECT 'stripe|payment|' || event_id, 'stripe_money', 'payment', iso, 'created', 'cus' || user_id, '{{"amountMinor":' || minor || ',"amountRefunded":null,"currency":"eur","description":null,"refunded":' || (event_id % 8 = 0) || ',"status":"succeeded"}}', false FROM e WHERE event_type = 'purchase' AND event_id % 4 < 2
  UNION ALL SELECT 'stripe|refund|' || event_id, 'stripe_money', 'refund', iso, 'created', 'cus' || user_id, '{{"amountMinor":' || minor || ',"charge":null,"currency":"eur","reason":null,"status":"succeeded"}}', false FROM e WHERE event_type = 'purchase' AND event_id % 4 = 2
  UNION ALL SELECT 'stripe|subscription|' || event_id || '|' || sub, 'stripe_subscription', 'subscription_changed', CASE WHEN sub = 'canceled' OR sub IN ('active', 'trialing') THEN iso END,
    CASE sub WHEN 'canceled' THEN 'canceled_at' WHEN 'incomplete_expired' THEN 'ended_at' WHEN 'past_due' THEN 'status_changed_at' ELSE 'start_date' END, 'cus' || user_id,
    '{{"amountMinor":' || minor || ',"cancelAtPeriodEnd":false,"currency":"eur","interval":"month","status":"' || sub || '"}}', false FROM e WHERE event_type = 'purchase' AND event_id % 4 = 3
  UNION ALL SELECT 'billing|' || event_id || '|u' || user_id || '@x.io', 'billing_credit', 'credit_ran_out', iso, 'recorded_at', NULL, '{{"accountName":null,"accountOrgId":"o","billingEventId":' || event_id || ',"episodeId":' || (event_id % 7) || '}}', false FROM e WHERE event_type = 'error')
SELECT natural_key, family, type, told_at, date_basis, payload, machine, sha256('["' || type || '",' || coalesce('"' || told_at || '"', 'null') || ',"' || date_basis || '",' || coalesce('"' || contact || '"', 'null') || ',' || payload || ']') AS content_hash FROM f""")
def candidate_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as records of five mirrored sources."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    row = F.concat(F.lit("r"), "user_id").alias("contact_id")
    visits = e.where("event_type = 'view'").select(F.col("event_id").alias("external_id"), F.col("ts").alias("occurred_at"), F.col("user_id").alias("person_id"), row, F.concat(F.lit("s"), "user_id").alias("session_id"), F.expr("event_id % 9").alias("pageviews"), null("string", "url"), F.lit("/p").alias("name"), null("timestamp", "ended_at"), null("string", "referrer"), F.expr("event_id % 10 = 0").alias("machine"))
    users = e.where("event_type = 'signup'").select(F.concat(F.lit("u"), "event_id").alias("external_id"), F.col("event_id").alias("id"), F.col("ts").alias("source_created_at"), F.expr("event_id % 6 <> 0").alias("signed_up"))
    kind = F.when(F.expr("event_id % 4 < 2"), "payment").when(F.expr("event_id % 4 = 2"), "refund").otherwise("subscription")
    status = F.when(kind == "subscription", _picked(("active", "canceled", "trialing", "past_due", "incomplete_expired"), "event_id % 5")).otherwise("succeeded")
    payments = e.where("event_type = 'purchase'").select(
        kind.alias("kind"), F.col("event_id").alias("external_id"), F.concat(F.lit("cus"), "user_id").alias("customer_id"), row, F.col("ts").alias("occurred_at"), F.floor(F.col("value") * 100).cast("long").alias("amount_minor"), F.lit("eur").alias("currency"), status.alias("status"),
        null("string", "description"), F.expr("event_id % 8 = 0").alias("refunded"), null("long", "amount_refunded"), null("string", "charge"), null("string", "reason"), F.col("ts").alias("canceled_at"), null("timestamp", "ended_at"), F.lit("month").alias("interval"), F.lit(False).alias("cancel_at_period_end"),
    )
    credit = e.where("event_type = 'error'").select("event_id", F.concat(F.lit("u"), "user_id", F.lit("@x.io")).alias("email"), F.col("ts").alias("at"), F.lit("recorded_at").alias("date_basis"), F.lit("credit_ran_out").alias("kind"), F.lit("o").alias("credit_org_id"), null("string", "org_label"), F.expr("event_id % 7").alias("episode_id"))
    got = families.candidates({"visits": visits, "auth_users": users, "payments": payments, "credit_events": credit})
    at = F.concat(F.date_format(F.to_utc_timestamp("occurred_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return got.select("natural_key", "family", "type", at.alias("told_at"), "date_basis", "payload", "machine", "content_hash")


@query("""WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'posthog_visit' WHEN 'click' THEN 'posthog_event' WHEN 'purchase' THEN 'stripe_money' WHEN 'signup' THEN 'csv_contact' ELSE ['crm_relation', 'newsletter_send', 'platform_signup'][CAST(event_id % 3 AS INT) + 1] END AS family FROM events),
c AS (SELECT event_id, family, user_id, event_id % 4 = 0 AS fresh, event_id % 13 <> 0 AS owned, family = 'posthog_visit' AND event_id % 11 = 0 AS machine, family = 'posthog_event' AND event_id % 17 = 0 AS nobody FROM e WHERE event_id % 7 <> 0 AND family <> 'platform_signup'),
l AS (SELECT event_id, family, user_id, 'row' || (user_id % 50) || CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS row, CASE WHEN user_id % 3 = 0 THEN 'h' || user_id END AS human FROM e WHERE event_id % 5 <> 0),
j AS (SELECT coalesce(c.event_id, l.event_id) AS event_id, coalesce(c.user_id, l.user_id) AS user_id, c.event_id IS NOT NULL AS said, l.event_id IS NOT NULL AS lives, coalesce(c.family, l.family) AS family, c.fresh, c.owned, c.machine, c.nobody, l.row, l.human FROM c FULL JOIN l USING (event_id)),
k AS (SELECT *, CASE WHEN said AND machine THEN 'machine' WHEN said AND nobody THEN 'unattributed' WHEN said AND lives AND (family IN ('csv_contact', 'newsletter_send') OR NOT fresh) THEN 'unchanged' WHEN said AND NOT owned THEN 'held' WHEN said AND lives THEN 'corrected' WHEN said THEN 'new' END AS change,
  CASE WHEN said THEN NULL WHEN family = 'posthog_event' AND event_id % 8 = 0 THEN 'sessionless_event' WHEN family IN ('posthog_visit', 'posthog_event') AND event_id % 9 = 0 THEN 'machine_visit' WHEN family = 'newsletter_send' THEN 'not_this_brand' WHEN family = 'platform_signup' THEN 'source_retired'
    WHEN family IN ('posthog_visit', 'posthog_event') OR (family = 'stripe_money' AND event_id % 2 = 0) OR (family = 'crm_relation' AND event_id % 4 = 0) THEN 'vendor_record_gone' END AS absent FROM j),
r AS (SELECT *, coalesce(change, CASE WHEN absent IS NOT NULL THEN 'withdrawn' ELSE 'kept' END) AS done, CASE WHEN NOT lives THEN NULL WHEN change = 'machine' THEN 'machine_visit' WHEN change = 'unattributed' THEN 'subject_changed' WHEN change = 'corrected' THEN 'vendor_record_changed' ELSE absent END AS why FROM k),
s AS (SELECT *, lives AND why IS NULL AND family IN ('posthog_visit', 'posthog_event', 'stripe_money') AND user_id % 2 = 1 AS minted, lives AND why IS NULL AND user_id % 3 < 2 AND human IS DISTINCT FROM 'h' || user_id AS known FROM r)
SELECT 'k' || event_id AS natural_key, CASE WHEN minted OR known THEN 'restated' ELSE done END AS change, CASE WHEN minted THEN 'crm_contact_reminted' WHEN known THEN 'human_identified' ELSE why END AS reason,
  CASE WHEN minted OR done IN ('new', 'corrected') OR NOT lives THEN 'row' || (user_id % 50) || 'a' ELSE row END AS crm_contact_id, CASE WHEN known AND NOT minted THEN 'h' || user_id ELSE human END AS human_id FROM s""")
def fact_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as candidates and as live facts, by rule, so that every change and reason
    comes up."""
    e = table(spark, sf, "events")
    family = F.when(F.col("event_type") == "view", "posthog_visit").when(F.col("event_type") == "click", "posthog_event").when(F.col("event_type") == "purchase", "stripe_money").when(F.col("event_type") == "signup", "csv_contact").otherwise(_picked(("crm_relation", "newsletter_send", "platform_signup"), "event_id % 3"))
    e = e.select("event_id", "user_id", family.alias("family"), F.concat(F.lit("k"), "event_id").alias("natural_key"), F.col("event_id").cast("string").alias("source_ref"), F.concat(F.lit("o"), "user_id").alias("owner"))
    row = F.concat(F.lit("row"), F.expr("user_id % 50"), F.lit("a"))
    cands = e.where("event_id % 7 <> 0 and family <> 'platform_signup'").select("natural_key", "family", F.when(F.expr("event_id % 4 = 0"), "new").otherwise("old").alias("content_hash"), F.when(F.expr("event_id % 13 <> 0"), F.col("owner")).alias("owner"), F.expr("family = 'posthog_visit' and event_id % 11 = 0").alias("machine"), F.expr("family = 'posthog_event' and event_id % 17 = 0").alias("unattributed"), row.alias("crm_contact_id"))
    source = F.create_map(*[F.lit(x) for n, v in families.FAMILIES.items() for x in (n, v.source)])
    live = e.where("event_id % 5 <> 0").select("natural_key", "family", source[F.col("family")].alias("source"), "source_ref", F.lit("old").alias("content_hash"), F.concat(F.lit("c"), "user_id").alias("source_contact_id"), F.concat(F.lit("row"), F.expr("user_id % 50"), F.when(F.expr("user_id % 2 = 0"), "a").otherwise("b")).alias("crm_contact_id"), F.when(F.expr("user_id % 3 = 0"), F.concat(F.lit("h"), "user_id")).alias("human_id"), "owner")
    refs = lambda when: e.where(when).select("source_ref")
    users = e.select("user_id", "owner").distinct()
    contacts = users.select(F.explode(F.array(F.lit("posthog"), F.lit("stripe"))).alias("source"), F.concat(F.lit("c"), "user_id").alias("source_contact_id"), row.alias("crm_contact_id"))
    humans = users.where("user_id % 3 < 2").select("owner", F.concat(F.lit("h"), "user_id").alias("human_id"))
    got = families.changes(cands, live, ["posthog", "stripe", "crm"], refs("event_id % 9 = 0"), refs("event_id % 8 = 0"), refs("event_id % 2 = 0"), refs("event_id % 4 = 0"), contacts, humans)
    return got.select("natural_key", "change", "reason", "crm_contact_id", "human_id")


# --- the funnel's evidence --------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, o_custkey, 'b' || (o_custkey % 2) AS brand_id, o_orderstatus, o_orderdate, lag(o_orderstatus) OVER w AS previous, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS changed_at, min(o_orderdate) OVER (PARTITION BY o_custkey) AS created FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END NULLS FIRST, o_orderkey)),
a AS (SELECT *, ['showed', 'noshow', 'cancelled', 'invalid', 'confirmed', NULL][CAST(l_partkey % 6 AS INT) + 1] AS status, 'c' || (l_suppkey % 40) AS ext, 'b' || (l_suppkey % 2) AS brand_id FROM lineitem),
ev AS (
  SELECT brand_id, ext, 'meeting_booked' AS step, l_shipdate AS t, 'booked_at' AS basis, 'appointment' AS source, l_orderkey || '-' || l_linenumber AS source_id FROM a WHERE status IS DISTINCT FROM 'invalid'
  UNION ALL SELECT brand_id, ext, CASE status WHEN 'showed' THEN 'meeting_attended' ELSE 'meeting_not_held' END, l_shipdate + INTERVAL 3 DAY, 'scheduled_start', 'appointment', l_orderkey || '-' || l_linenumber FROM a WHERE status IN ('showed', 'noshow', 'cancelled')
  UNION ALL SELECT brand_id, 'c' || o_custkey, CASE o_orderstatus WHEN 'F' THEN 'sale' ELSE 'meeting_booked' END, CASE WHEN previous IS NULL AND changed_at = created AND o_orderstatus = 'F' THEN NULL ELSE changed_at END, 'stage_entered_at', 'stage_entry', '' || o_custkey FROM o WHERE o_orderstatus IN ('F', 'O') AND previous IS DISTINCT FROM o_orderstatus
  UNION ALL SELECT brand_id, 'c' || o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'sale' ELSE 'deal_lost' END, changed_at, 'status_changed_at', CASE WHEN o_orderkey % 3 = 0 THEN 'won_status' ELSE 'lost_status' END, '' || o_custkey FROM o WHERE o_orderkey % 3 < 2
  UNION ALL SELECT 'b' || (user_id % 2), 'c' || user_id, 'form_submitted', ts, 'submitted_at', 'form_submission', '' || event_id FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'b' || (c_custkey % 2), 'c' || c_custkey, 'form_submitted', NULL, 'contact_created_at', 'form_origin', 'c' || c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT brand_id, ext AS contact, source, basis, step, count(*) AS entries, count(DISTINCT source_id) AS ids, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_at, count(t) AS dated
FROM ev JOIN customer ON 'c' || c_custkey = ext AND 'b' || (c_custkey % 2) = brand_id AND c_custkey % 10 <> 7 GROUP BY 1, 2, 3, 4, 5""")
def funnel_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """All six branches over two brands: line items as appointments, orders as stages and
    statuses of their customer's card, clicks as forms, customers as contacts, nine of ten
    of them mirrored."""
    brand = lambda c: F.concat(F.lit("b"), F.expr(f"{c} % 2")).alias("brand_id")
    org, null = F.lit("org").alias("org_id"), lambda n: F.lit(None).cast("string").alias(n)
    status = F.element_at(F.array(F.lit("showed"), F.lit("noshow"), F.lit("cancelled"), F.lit("invalid"), F.lit("confirmed"), F.lit(None)), F.expr("cast(l_partkey % 6 as int)") + 1)
    a = table(spark, sf, "lineitem").select(org, brand("l_suppkey"), F.concat(F.lit("c"), F.expr("l_suppkey % 40")).alias("contact"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_id"), F.lit("Cal").alias("calendar_name"), status.alias("status"), F.col("l_shipdate").alias("booked_at"), (F.col("l_shipdate") + F.expr("interval 3 days")).alias("starts_at"))
    o = table(spark, sf, "orders").select(org, brand("o_custkey"), F.concat(F.lit("c"), "o_custkey").alias("contact"), F.col("o_custkey").alias("card_id"), "o_orderkey", F.col("o_orderstatus").alias("value"), F.concat(F.lit("stage "), "o_orderstatus").alias("stage_name"), null("pipeline_name"), F.when(F.expr("o_orderkey % 9 <> 0"), F.col("o_orderdate")).alias("changed_at"), F.col("o_orderdate").alias("observed_at"))
    meanings = spark.createDataFrame([("F", "sale", 0.9), ("O", "meeting_booked", 0.5), ("P", "none", 0.8)], "stage_id string, meaning string, confidence double")
    cards = o.groupBy("card_id").agg(F.min("observed_at").alias("created_at"))
    entries = funnel.stage_entries(o, ["card_id"], "observed_at", "changed_at", "o_orderkey")
    history = o.withColumn("value", F.when(F.expr("o_orderkey % 3 = 0"), "won").when(F.expr("o_orderkey % 3 = 1"), "lost").otherwise("open"))
    forms = table(spark, sf, "events").where("event_type = 'click'").select(org, brand("user_id"), F.concat(F.lit("c"), "user_id").alias("contact"), F.col("ts").alias("submitted_at"), F.col("event_id").alias("external_id"), null("form_id"), null("form_name"))
    c = table(spark, sf, "customer").select(org, brand("c_custkey"), F.concat(F.lit("c"), "c_custkey").alias("external_id"), F.col("c_custkey").alias("contact_id"), F.when(F.col("c_mktsegment") == "BUILDING", "form").when(F.col("c_mktsegment") == "MACHINERY", "survey").otherwise("chat").alias("origin_medium"), F.lit(None).cast("timestamp").alias("created_at"))
    got = funnel.funnel_evidence(
        c.where("contact_id % 10 <> 7"), funnel.appointment_evidence(a), funnel.stage_evidence(funnel.stage_events(entries, cards, meanings)), funnel.status_evidence(history), funnel.form_evidence(forms), funnel.origin_evidence(c)
    )
    first = F.date_format(F.min("occurred_at"), "yyyy-MM-dd HH:mm:ss").alias("first_at")
    return got.groupBy("brand_id", F.col("ext").alias("contact"), "source", F.col("date_basis").alias("basis"), "step").agg(F.count("*").alias("entries"), F.count_distinct("source_id").alias("ids"), first, F.count("occurred_at").alias("dated"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, 'n' || (o_custkey % 2) AS con, o_orderstatus AS v, o_orderdate AS t, lag(o_orderstatus) OVER w AS p, row_number() OVER w = 1 AS first, min(o_orderdate) OVER (PARTITION BY o_custkey) AS created FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
v(con, ref, verdict, steps, conf) AS (VALUES ('n0', 'F', 'former_client', ['client', 'former_client'], 0.9), ('n0', 'O', 'client', ['client'], 0.5), ('n1', 'F', 'client', ['client'], 0.4), ('n1', 'P', 'disqualified', ['disqualified'], 0.7), ('n1', 'O', 'former_client', ['client', 'former_client'], 0.8)),
e AS (SELECT o.*, unnest(list_filter(v.steps, lambda x: NOT list_contains(coalesce(w.steps, []), x))) AS step, v.conf FROM o JOIN v ON v.con = o.con AND v.ref = o.v AND v.conf >= 0.5 LEFT JOIN v w ON w.con = o.con AND w.ref = o.p AND w.conf >= 0.5)
SELECT o_custkey AS contact, step, strftime(CASE WHEN first AND t = created AND step <> 'disqualified' THEN NULL ELSE t END, '%Y-%m-%d') AS occurred_on, 'stage_label' AS source, 'stage ' || v AS label, CAST(conf AS DOUBLE) AS confidence, o_orderkey AS id FROM e
UNION ALL SELECT c_custkey, s, NULL, 'contact_tag', lower(c_mktsegment), 0.6, c_custkey FROM customer, unnest(['client', 'former_client']) t(s) WHERE c_mktsegment = 'FURNITURE' AND c_custkey % 2 = 0""")
def label_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as stages of their customer's card, segments as contacts' tags, two connections."""
    con = lambda c: F.concat(F.lit("n"), F.expr(f"{c} % 2")).alias("connection")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("contact"), F.col("o_custkey").alias("customer"), con("o_custkey"), F.col("o_orderstatus").alias("value"), F.concat(F.lit("stage "), "o_orderstatus").alias("stage_name"), F.col("o_orderdate").alias("changed_at"))
    entries = funnel.stage_entries(o, ["customer"], "changed_at", "changed_at", "o_orderkey").withColumn("card_id", F.col("o_orderkey"))
    entries = entries.join(o.groupBy("customer").agg(F.min("changed_at").alias("card_created_at")), "customer")
    said = [("n0", "F", "former_client", 0.9), ("n0", "O", "client", 0.5), ("n1", "F", "client", 0.4), ("n1", "P", "disqualified", 0.7), ("n1", "O", "former_client", 0.8)]
    verdicts = [(c, "stage", r, f"stage {r}", v, p) for c, r, v, p in said] + [("n0", "tag", "", "furniture", "former_client", 0.6), ("n1", "tag", "", "furniture", "client", 0.1), ("n0", "tag", "x", "building", "client", 0.9)]
    v = spark.createDataFrame(verdicts, "connection string, kind string, label_ref string, label string, verdict string, confidence double")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("contact"), con("c_custkey"), F.array(F.concat(F.lit("  "), "c_mktsegment"), F.lower("c_mktsegment")).alias("tags"))
    got = funnel.label_evidence(entries, c, v)
    return got.select("contact", "step", F.date_format("occurred_at", "yyyy-MM-dd").alias("occurred_on"), "source", "label", "confidence", F.col("source_id").cast("long").alias("id"))


# --- people ---------------------------------------------------------------------------------


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'h' || c_custkey END AS human FROM customer),
l AS (SELECT o_custkey, o_orderkey, 'l' || o_orderkey AS lead_id, o_orderkey % 997 = 3 AS failed FROM orders WHERE o_orderkey % 20 = 3),
bl AS (SELECT o_custkey, arg_min(['contacted', 'interested', 'meeting'][CAST(o_orderkey % 3 AS INT) + 1], o_orderkey) AS s FROM l WHERE o_orderkey % 3 < 3 AND o_orderkey % 7 = 0 GROUP BY 1),
lf AS (SELECT o_custkey, bool_or(failed) AS failed FROM l GROUP BY 1),
pay AS (SELECT o_custkey, list(CASE o_orderkey % 8 WHEN 0 THEN 'unpaid' WHEN 1 THEN 'canceled' ELSE 'none' END) AS st, sum(CASE WHEN o_orderkey % 6 = 1 THEN 1 ELSE 0 END) AS paid, sum(CASE WHEN o_orderkey % 6 = 5 THEN 1 ELSE 0 END) AS back FROM orders WHERE o_orderkey % 25 IN (1, 8) GROUP BY 1),
dl AS (SELECT o_custkey, min(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 4 END) AS r FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 15 = 4 GROUP BY 1),
ch AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS s FROM orders WHERE o_orderkey % 6 = 2 GROUP BY 1),
ml AS (SELECT o_custkey, bool_or(o_orderkey % 4 = 0) AS replied, bool_or(o_orderkey % 4 = 1) AS clicked FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1),
x AS (SELECT c_custkey, coalesce(lf.failed, false) AS unknown, coalesce(bl.s, CASE WHEN human IS NOT NULL AND c_custkey % 2 = 0 THEN 'human_state' END) AS verdict,
  CASE WHEN list_contains(st, 'unpaid') THEN 'subscription_unpaid' WHEN paid > 0 THEN 'paid' WHEN back > 0 THEN 'refunded' WHEN list_contains(st, 'canceled') THEN 'subscription_canceled' END AS pay,
  CASE r WHEN 3 THEN 'deal_lost' WHEN 4 THEN 'deal_abandoned' END AS deal, ch.s AS chat, CASE WHEN replied THEN 'replied' WHEN clicked THEN 'clicked' END AS mail
  FROM p LEFT JOIN lf ON lf.o_custkey = c_custkey LEFT JOIN bl ON bl.o_custkey = c_custkey LEFT JOIN pay ON pay.o_custkey = c_custkey LEFT JOIN dl ON dl.o_custkey = c_custkey LEFT JOIN ch ON ch.o_custkey = c_custkey LEFT JOIN ml ON ml.o_custkey = c_custkey)
SELECT c_custkey, CASE WHEN unknown THEN 'unavailable' ELSE coalesce(verdict, pay, deal, chat, mail, 'in_conversation') END AS state,
  CASE WHEN unknown OR verdict IS NOT NULL THEN 'lead_service' WHEN pay IS NOT NULL THEN 'stripe' WHEN deal IS NOT NULL THEN 'gohighlevel' WHEN chat IS NOT NULL THEN 'matrix' WHEN mail IS NOT NULL THEN 'instantly' ELSE 'none' END AS state_source FROM x""")
def person_states(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as people, parts of their orders as leads, payments, deals, chats and mails."""
    who = F.col("o_custkey").alias("person_id")
    o = table(spark, sf, "orders")
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.when(F.expr("c_custkey % 9 = 0"), F.concat(F.lit("h"), "c_custkey")).alias("human_id"))
    lead = F.concat(F.lit("l"), "o_orderkey").alias("lead_id")
    leads = o.where("o_orderkey % 20 = 3").select(who, F.col("o_orderkey").alias("place"), lead, F.expr("o_orderkey % 997 = 3").alias("failed"))
    none = F.lit(None).cast("string")
    states = o.where("o_orderkey % 7 = 0").select(lead, none.alias("human_id"), _picked(("contacted", "interested", "meeting"), "o_orderkey % 3").alias("state"))
    states = states.unionByName(people.where("person_id % 2 = 0 and human_id is not null").select(none.alias("lead_id"), "human_id", F.lit("human_state").alias("state")))
    status = F.when(F.expr("o_orderkey % 8 = 0"), "unpaid").when(F.expr("o_orderkey % 8 = 1"), "canceled").otherwise("none")
    payments = o.where("o_orderkey % 25 in (1, 8)").select(who, F.array(status).alias("subscription_statuses"), F.expr("int(o_orderkey % 6 = 1)").alias("paid_charges"), F.expr("int(o_orderkey % 6 = 5)").alias("refunded_charges"))
    deals = o.where("o_orderkey % 15 = 4").select(who, F.when(F.col("o_orderstatus") == "F", "lost").when(F.col("o_orderstatus") == "O", "abandoned").alias("status"))
    chats = o.where("o_orderkey % 6 = 2").select(who, F.col("o_orderpriority").alias("status"), F.col("o_orderdate").alias("last_at"))
    mails = o.where("o_orderkey % 5 = 0").select(who, F.expr("o_orderkey % 4 = 0").alias("replied"), F.expr("o_orderkey % 4 = 1").alias("clicked"))
    return persons.person_states(people, leads, states, payments, deals, chats, mails).withColumnRenamed("person_id", "c_custkey")


@query("""WITH p AS (SELECT c_custkey, c_custkey % 7 <> 0 AND c_custkey % 10 <> 3 AS free FROM customer WHERE c_custkey % 4 <> 0),
r AS (SELECT DISTINCT o_custkey AS c, 'deal_stage' AS kind, 'P' || (o_orderkey % 2) AS pipeline, o_orderstatus AS name, lower(o_orderpriority) AS status FROM orders
  UNION SELECT c_custkey, 'tag', NULL, (SELECT min(CASE WHEN x.c_custkey % 2 = 0 THEN x.c_mktsegment ELSE lower(x.c_mktsegment) END) FROM customer x WHERE x.c_mktsegment = customer.c_mktsegment), NULL FROM customer
  UNION SELECT user_id, 'step', NULL, event_type, NULL FROM events)
SELECT kind, pipeline, name, status, count(*) AS people, count(*) FILTER (WHERE free) AS in_pool FROM r JOIN p ON c_custkey = c GROUP BY 1, 2, 3, 4""")
def segment_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    mail = F.concat(F.lit("c"), "c_custkey", F.lit("@x.io"))
    people = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("person_id"), F.array(mail).alias("emails"))
    deals = table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), F.concat(F.lit("P"), F.expr("o_orderkey % 2")).alias("pipeline"), F.col("o_orderstatus").alias("stage"), F.lower("o_orderpriority").alias("status"))
    tag = F.when(F.expr("c_custkey % 2 = 0"), F.concat(F.lit(" "), "c_mktsegment")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" ")))
    tags = c.select(F.col("c_custkey").alias("person_id"), tag.alias("tag"))
    steps = table(spark, sf, "events").select(F.col("user_id").alias("person_id"), F.col("event_type").alias("step"))
    served = c.where("c_custkey % 10 = 3").select(mail.alias("email"))
    return persons.segment_catalogue(people, deals, tags, steps, people.where("person_id % 7 <> 0"), served)


@query("""WITH c AS (SELECT 'b' || (user_id % 2) AS brand_id, '+' || (user_id % 37) AS phone, 'a' || (event_id % 5) AS artifact_id, CAST(event_id AS VARCHAR) AS contact_id, ts, CASE event_id % 5 WHEN 4 THEN NULL ELSE TIMESTAMP '2024-01-02' + INTERVAL 1 DAY * (event_id % 5) END AS loaded_at FROM events),
g AS (SELECT *, greatest(ts, loaded_at) AS looked_at, ts <= loaded_at AS history FROM c WHERE loaded_at IS NOT NULL)
SELECT brand_id, phone, CASE WHEN arg_min(history, k) THEN 'before_watch' ELSE 'detected' END AS status, arg_min(artifact_id, k) AS artifact_id, arg_min(contact_id, k) AS contact_id, strftime(min(looked_at), '%Y-%m-%d %H:%M:%S') AS given_at
FROM (SELECT *, (looked_at, CASE WHEN history THEN '0' ELSE '1' END || contact_id, artifact_id) AS k FROM g) GROUP BY 1, 2""")
def given_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as contacts of five artifacts, one of them still on its first load; the stream
    of streaming.keyed ends in the same rows."""
    e = table(spark, sf, "events")
    loaded = F.when(F.expr("event_id % 5 <> 4"), F.expr("timestamp '2024-01-02' + make_dt_interval(cast(event_id % 5 as int))"))
    c = e.select(F.lit("o").alias("org_id"), F.concat(F.lit("b"), F.expr("user_id % 2")).alias("brand_id"), F.concat(F.lit("+"), F.expr("user_id % 37")).alias("phone"), F.concat(F.lit("a"), F.expr("event_id % 5")).alias("artifact_id"), F.col("event_id").alias("contact_id"), F.col("ts").cast("timestamp").alias("at"), loaded.alias("loaded_at"))
    return keyed.given_so_far(c).select("brand_id", "phone", "status", "artifact_id", "contact_id", F.date_format("given_at", "yyyy-MM-dd HH:mm:ss").alias("given_at"))


# --- rooms ------------------------------------------------------------------------------


@query("""WITH m AS (SELECT event_id, user_id AS room, CASE WHEN event_id % 3 = 0 THEN 'us' ELSE 'them' END AS sender, ts, event_type || event_id AS body,
  CASE WHEN event_id % 5 = 1 THEN lag(event_id) OVER w END AS edits, CASE WHEN event_id % 4 = 2 THEN lag(event_id, 2) OVER w WHEN event_id % 44 = 3 THEN -event_id END AS quotes FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT m.*, o.event_id AS target FROM m JOIN m o ON o.room = m.room AND o.event_id = m.edits AND o.sender = m.sender),
l AS (SELECT room, target AS event_id, arg_max(body, (ts, event_id)) AS body FROM e GROUP BY 1, 2),
f AS (SELECT m.room, m.event_id, m.sender, m.ts, coalesce(l.body, m.body) AS body, m.quotes FROM m LEFT JOIN l USING (room, event_id) WHERE (m.room, m.event_id) NOT IN (SELECT (room, event_id) FROM e))
SELECT f.event_id, f.body, f.quotes AS quoted_id, CASE WHEN q.event_id IS NOT NULL THEN CASE WHEN q.sender = 'us' THEN 'outbound' ELSE 'inbound' END END AS quoted_direction, substr(q.body, 1, 300) AS quoted_text FROM f LEFT JOIN f q ON q.room = f.room AND q.event_id = f.quotes""")
def folded_messages(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as a room's messages; some rewrite the one before, some quote."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    m = table(spark, sf, "events").select(
        F.col("user_id").alias("room"), "event_id", F.when(F.expr("event_id % 3 = 0"), "us").otherwise("them").alias("sender"), F.col("ts").alias("at"), F.concat("event_type", "event_id").alias("body"),
        F.when(F.expr("event_id % 5 = 1"), F.lag("event_id").over(w)).alias("edits"),
        F.when(F.expr("event_id % 4 = 2"), F.lag("event_id", 2).over(w)).when(F.expr("event_id % 44 = 3"), -F.col("event_id")).alias("quotes"),
    )
    got = rooms.with_quotes(rooms.fold_edits(m), F.col("sender") == "us")
    return got.select("event_id", "body", F.col("quote.event_id").alias("quoted_id"), F.col("quote.direction").alias("quoted_direction"), F.col("quote.text").alias("quoted_text"))


@query("""WITH b AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS t, CASE o_orderstatus WHEN 'F' THEN 'cancelled' ELSE 'confirmed' END AS status FROM orders),
n AS (SELECT b.*, CASE WHEN status = 'cancelled' AND t IS NOT NULL THEN (SELECT arg_min(x.o_orderkey, (x.t, x.o_orderkey)) FROM b x WHERE x.o_custkey = b.o_custkey AND x.status <> 'cancelled' AND x.t >= b.t) END AS after FROM b),
c AS (SELECT after AS o_orderkey, o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY t, o_orderkey) AS came FROM n WHERE after IS NOT NULL GROUP BY 1, 2)
SELECT n.o_orderkey, n.o_custkey, status, came AS rescheduled_from FROM n LEFT JOIN c USING (o_orderkey, o_custkey) WHERE after IS NULL""")
def booked_meetings(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("event_id"), F.when(F.expr("o_orderkey % 17 <> 0"), F.col("o_orderdate")).alias("booked_at"), F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("confirmed").alias("status"))
    got = rooms.meetings(b)
    return got.select(F.col("event_id").alias("o_orderkey"), F.col("person_id").alias("o_custkey"), "status", F.array_join("rescheduled_from", ",").alias("rescheduled_from"))


@query("""WITH k AS (SELECT '+' || (10000000 + o_custkey * 3) AS phone FROM orders UNION SELECT '+' || (c_custkey * 200) FROM customer UNION SELECT '+' || (10000000 + user_id * 9) FROM events)
SELECT phone FROM k WHERE regexp_matches(phone, '^\\+[0-9]{8,15}$') AND phone NOT IN (SELECT '+' || (10000000 + user_id * 3) FROM events WHERE event_type = 'click' AND event_id % 3 = 0)
AND phone NOT IN (SELECT '+' || (10000000 + c_custkey * 3) FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_custkey % 2 = 0 AND c_custkey % 60 < 30))""")
def numbers_to_ask(spark: SparkSession, sf: str) -> DataFrame:
    phone = lambda e: F.concat(F.lit("+"), F.expr(e)).alias("phone")
    e, c = table(spark, sf, "events"), table(spark, sf, "customer")
    known = [table(spark, sf, "orders").select(phone("10000000 + o_custkey * 3")), c.select(phone("c_custkey * 200")), e.select(phone("10000000 + user_id * 9"))]
    mirrored = e.where("event_type = 'click' and event_id % 3 = 0").select(phone("10000000 + user_id * 3"))
    now = F.lit("2026-09-01").cast("timestamp")
    lookups = c.where("c_mktsegment = 'BUILDING' or c_custkey % 2 = 0").select(phone("10000000 + c_custkey * 3"), F.when(F.col("c_mktsegment") == "BUILDING", "found").otherwise("not_found").alias("outcome"), (now - F.expr("make_dt_interval(cast(c_custkey % 60 as int))")).alias("looked_up_at"))
    return rooms.numbers_to_ask(known, mirrored, lookups, now)
