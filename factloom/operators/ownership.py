"""Who owns the feed's facts, kept from run to run: facts are grouped by owner and subject
once, groups are brought up to date by what was added and taken, and only the subjects that a
changed person may own are resolved again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.facts import owner_of_subject

GROUP = ["owner", "subject", "presence", "keys", "standalone"]


def people_digests(people: DataFrame) -> DataFrame:
    """(person_key, digest) of people (person_key, identity_keys, presences), whatever the
    order of their keys: what picks an owner, and nothing else."""
    sorted_ = [F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), "\x02") for c in ("identity_keys", "presences")]
    return people.select("person_key", F.sha2(F.concat_ws("\x01", "person_key", *sorted_), 256).alias("digest"))


def index_mark(digests: DataFrame) -> tuple[int, int, int]:
    """One mark of all digests, whatever their order; while it stays, no fact moves."""
    h = F.xxhash64("person_key", "digest")
    row = digests.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(h, F.lit(2**31 - 1))), F.lit(0)).alias("s")).first()
    return row["n"], row["x"], row["s"]


def fact_groups(facts: DataFrame) -> DataFrame:
    """(owner, subject, presence, keys, standalone, facts, digest) of facts (fact_id, owner,
    presence, keys, standalone). The digest is an exclusive or over the ids' hashes: a
    fact is added and taken by the same step, and order tells nothing."""
    keys = F.coalesce("keys", F.array().cast("array<string>"))  # in the order stated: the first that is held decides
    f = facts.select("fact_id", "owner", "presence", keys.alias("keys"), F.coalesce("standalone", F.lit(False)).alias("standalone"))
    subject = F.sha2(F.concat_ws("\x01", F.coalesce("presence", F.lit("\x00")), F.array_join("keys", "\x02"), F.col("standalone").cast("string")), 256)
    return f.withColumn("subject", subject).groupBy(*GROUP).agg(F.count("*").alias("facts"), F.bit_xor(F.xxhash64("fact_id")).alias("digest"))


def updated_groups(stored: DataFrame, added: DataFrame, taken: DataFrame) -> DataFrame:
    """The groups after facts were added and others taken: only these are read, with the
    groups kept so far. A group without facts is gone."""
    plus = fact_groups(added)
    minus = fact_groups(taken).withColumn("facts", -F.col("facts"))
    names = [*GROUP, "facts", "digest"]
    rows = stored.select(names).unionByName(plus.select(names)).unionByName(minus.select(names))
    return rows.groupBy(*GROUP).agg(F.sum("facts").alias("facts"), F.bit_xor("digest").alias("digest")).where("facts > 0")


def touched_names(before: DataFrame, now: DataFrame) -> DataFrame:
    """(name, kind) of keys and presences of people who changed, came or went: of both
    their old and their new state, for a key that left a person may now be another's."""
    old, new = people_digests(before), people_digests(now)
    same = old.join(new, ["person_key", "digest"], "left_semi").select("person_key")
    out = None
    for people in (before, now):
        p = people.join(same, "person_key", "left_anti")
        for column, kind in (("identity_keys", "key"), ("presences", "presence")):
            one = p.select(F.explode(column).alias("name"), F.lit(kind).alias("kind"))
            out = one if out is None else out.unionByName(one)
    return out.distinct()


def moves(groups: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """(owner, subject, moved_to, facts) of groups whose subject another person owns now.

    Only subjects with a key or presence of a changed person are resolved again. A subject
    that nobody holds keeps its owner."""
    names = touched_names(before, now)
    subjects = groups.select("subject", "presence", "keys").dropDuplicates(["subject"])
    by_key = subjects.select("subject", F.explode("keys").alias("name")).join(names.where("kind = 'key'"), "name", "left_semi").select("subject")
    by_presence = subjects.withColumnRenamed("presence", "name").join(names.where("kind = 'presence'"), "name", "left_semi").select("subject")
    due = subjects.join(by_key.unionByName(by_presence).distinct(), "subject", "left_semi")
    presence_owner = now.select(F.explode("presences").alias("presence"), "person_key").groupBy("presence").agg(F.min("person_key").alias("person_key"))
    key_owner = now.select(F.explode("identity_keys").alias("key"), "person_key").groupBy("key").agg(F.min("person_key").alias("person_key"))
    owners = owner_of_subject(due, presence_owner, key_owner).where("owner <> subject").withColumnRenamed("owner", "moved_to")
    return groups.join(owners, "subject").where("owner <> moved_to").select("owner", "subject", "moved_to", "facts")


def ownership_events(moved: DataFrame, groups: DataFrame) -> DataFrame:
    """(type, person_key, parts) of moves: a person whose facts all went to one other was
    merged into it; one whose facts are now of several, itself perhaps among them, was split."""
    all_ = groups.groupBy("owner").agg(F.sum("facts").alias("all_facts"))
    told = moved.groupBy("owner").agg(F.sum("facts").alias("gone"), F.collect_set("moved_to").alias("to")).join(all_, "owner")
    parts = F.when(F.col("gone") < F.col("all_facts"), F.array_append("to", F.col("owner"))).otherwise(F.col("to"))
    return told.select(F.when(F.size(parts) == 1, "person_merged").otherwise("person_split").alias("type"), F.col("owner").alias("person_key"), F.array_sort(parts).alias("parts"))
