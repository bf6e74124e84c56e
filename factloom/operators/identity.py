"""Who is who: identity keys of records, people as connected components of shared keys,
their keys and stable ids, and what is attached to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.normalize import identity_email, identity_phone, trimmed
from factloom.operators.graph import connected_components


def keys_of(emails: Column, phones: Column, user_ids: Column, keys: Column, fallback: Column | None = None) -> Column:
    """The distinct keys a record states; the fallback where it states none."""
    known = lambda c: F.filter(c, lambda x: x.isNotNull() & (x != ""))
    none = F.array().cast("array<string>")
    arr = lambda c: F.coalesce(c, none)
    stated = F.array_distinct(
        F.concat(
            known(F.transform(arr(emails), lambda e: F.concat(F.lit("email:"), identity_email(e)))),
            known(F.transform(arr(phones), lambda p: F.concat(F.lit("phone:"), identity_phone(p)))),
            known(F.transform(arr(user_ids), lambda u: F.concat(F.lit("uid:"), F.nullif(trimmed(u), F.lit(""))))),
            known(arr(keys)),
        )
    )
    return F.when(F.size(stated) > 0, stated).otherwise(F.filter(F.array(fallback), lambda x: x.isNotNull()) if fallback is not None else none)


def key_rank(key: Column) -> Column:
    return F.when(key.startswith("email:"), 0).when(key.startswith("phone:"), 1).otherwise(2)


def person_key(key: Column) -> Column:
    """Aggregate: the smallest address, else the smallest number, else the smallest key."""
    return F.min(F.struct(key_rank(key).alias("r"), key.alias("k")))["k"]


def cluster_people(presences: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(person_key, identity_keys, emails, phones, sources) of the people that presences
    (source, source_ref, emails, phones, user_ids, keys[, handle]) and evidence (emails,
    phones, keys) make up.

    Every record ties its first key to its others, a shared handle ties the first keys
    of its presences; components of that graph are people. Keys that only evidence
    states join a person but make none.
    """
    from factloom.session import cut

    none = F.array().cast("array<string>")
    col = lambda df, c: F.col(c) if c in df.columns else none
    p = presences.select(
        "source",
        keys_of(F.col("emails"), F.col("phones"), col(presences, "user_ids"), col(presences, "keys"), F.concat_ws(":", "source", "source_ref")).alias("ks"),
        (F.col("handle") if "handle" in presences.columns else F.lit(None).cast("string")).alias("handle"),
    )
    # records that state the same are one row from here on: keys are normalised once
    p = cut(p.groupBy("source", "ks", "handle").agg(F.count("*").alias("n")))
    star = lambda df: df.select(F.element_at("ks", 1).alias("a"), F.explode("ks").alias("b"))
    edges = star(p)
    shared = p.where("handle is not null").select(F.concat(F.lit("handle:"), "handle").alias("a"), F.element_at("ks", 1).alias("b"))
    edges = edges.unionByName(shared)
    stated = edges.select("b").distinct()
    if evidence is not None:
        e = evidence.select(keys_of(F.col("emails"), F.col("phones"), none, col(evidence, "keys")).alias("ks")).where(F.size("ks") > 0)
        edges = edges.unionByName(star(e))
    tied = connected_components(edges)
    all_keys = edges.select(F.col("b").alias("node")).distinct()
    rooted = all_keys.join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    present = rooted.join(stated, F.col("node") == F.col("b"), "left_semi").select("root").distinct()
    people = rooted.join(present, "root", "left_semi").groupBy("root").agg(
        person_key(F.col("node")).alias("person_key"), F.sort_array(F.collect_set("node")).alias("identity_keys")
    )
    per = p.select("source", F.element_at("ks", 1).alias("node"), "n").join(rooted, "node").groupBy("root").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.sum("n").alias("presences"))
    cutoff = lambda prefix: F.transform(F.filter("identity_keys", lambda k: k.startswith(prefix)), lambda k: F.substring(k, len(prefix) + 1, 1000))
    return people.join(per, "root", "left").select("person_key", "identity_keys", cutoff("email:").alias("emails"), cutoff("phone:").alias("phones"), "sources", "presences")


def name_pairs(people: DataFrame, name: str, key: str, most: int = 5) -> DataFrame:
    """Pairs (a < b) of people of one name, for names that 2 to `most` people have; a
    commoner name proves nothing. Larger groups are dropped by their count before the
    join, so none becomes all its pairs."""
    p = people.where(F.col(name).isNotNull()).select(name, key)
    few = p.groupBy(name).agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select(name)
    p = p.join(few, name, "left_semi")
    b = p.select(F.col(name).alias("__n"), F.col(key).alias("b"))
    return p.join(b, (F.col(name) == F.col("__n")) & (F.col(key) < F.col("b"))).select(name, F.col(key).alias("a"), "b")


def candidates_by_tokens(attendees: DataFrame, people: DataFrame, most: int = 12) -> DataFrame:
    """(attendee, person, score): people who share words with an attendee, most first,
    ties to the smaller person; `most` is the report's length. Both sides are (id,
    tokens array); the join is on the token, counted before it is ranked."""
    a = attendees.select("attendee", F.explode(F.array_distinct("tokens")).alias("t"))
    p = people.select("person", F.explode(F.array_distinct("tokens")).alias("t"))
    score = a.join(p, "t").groupBy("attendee", "person").agg(F.count("*").alias("score"))
    w = Window.partitionBy("attendee").orderBy(F.desc("score"), "person")
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, from_key, to_keys): a person whose keys now belong to several is a split,
    to exactly one other a merge. before / after: (person_key, key)."""
    to = before.select(F.col("person_key").alias("from_key"), "key").join(after.select(F.col("person_key").alias("to_key"), "key"), "key")
    got = to.groupBy("from_key").agg(F.sort_array(F.collect_set("to_key")).alias("to_keys"))
    kind = F.when(F.size("to_keys") >= 2, "split").when(F.element_at("to_keys", 1) != F.col("from_key"), "merge")
    return got.withColumn("kind", kind).where("kind is not null").select("kind", "from_key", "to_keys")


def stable_ids(people: DataFrame, known: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(person_key, person_id, is_new): ids carried over by shared keys.

    people: (person_key, key); known: (person_id, minted_at, key). Pairs are ranked by
    shared keys, then older id, then id, then person; a pair that is first both for its
    person and its id is taken, and the rest ranked again without them. That is the
    greedy order, in as many rounds as there are contested chains.
    """
    from factloom.session import cut

    shared = cut(people.join(known, "key").groupBy("person_key", "person_id", "minted_at").agg(F.count("*").alias("n")))
    order = [F.desc("n"), "minted_at", "person_id", "person_key"]
    taken = None
    for _ in range(max_rounds):
        ranked = shared.withColumns(
            {"a": F.row_number().over(Window.partitionBy("person_key").orderBy(*order)), "b": F.row_number().over(Window.partitionBy("person_id").orderBy(*order))}
        )
        now = cut(ranked.where("a = 1 and b = 1").select("person_key", "person_id"))
        if now.isEmpty():
            break
        taken = now if taken is None else taken.unionByName(now)
        shared = cut(shared.join(now.select("person_key"), "person_key", "left_anti").join(now.select("person_id"), "person_id", "left_anti"))
    else:
        raise RuntimeError(f"ids not settled after {max_rounds} rounds")
    everyone = people.select("person_key").distinct()
    if taken is None:
        return everyone.select("person_key", F.sha2("person_key", 256).alias("person_id"), F.lit(True).alias("is_new"))
    got = everyone.join(taken, "person_key", "left")
    return got.select("person_key", F.coalesce("person_id", F.sha2("person_key", 256)).alias("person_id"), F.col("person_id").isNull().alias("is_new"))


def resolved_aliases(aliases: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(old_id, id): retired ids followed to the last one. A round follows every chain twice
    as far as the one before, so chains of any length take few; a circle raises."""
    from factloom.session import cut

    at = cut(aliases.where("old_id <> new_id").select("old_id", F.col("new_id").alias("id")).distinct())
    for _ in range(max_rounds):
        step = at.select(F.col("old_id").alias("__o"), F.col("id").alias("__n"))
        now = cut(at.join(step, F.col("id") == F.col("__o"), "left").select("old_id", F.coalesce("__n", "id").alias("id"), F.col("__n").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("old_id", "id")
        at = now.select("old_id", "id")
    raise RuntimeError(f"aliases not settled after {max_rounds} rounds: some run in a circle")
