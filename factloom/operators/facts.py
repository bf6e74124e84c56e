"""The fact feed: candidates against the live facts, what is new, corrected or withdrawn,
in one order with a monotone sequence; and append-only history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Families whose facts are withdrawn when their source no longer states them.
SNAPSHOT = "snapshot"


def first_wins(candidates: DataFrame, priority: list[str]) -> DataFrame:
    """One candidate per natural key: of the source named first in `priority`."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("source")), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    rest = [c for c in candidates.columns if c != "natural_key"]
    return candidates.groupBy("natural_key").agg(F.min_by(F.struct(*rest), F.struct(rank, F.col("content_hash"))).alias("r")).select("natural_key", *[F.col(f"r.{c}").alias(c) for c in rest])


def diff(candidates: DataFrame, live: DataFrame, connected: list[str], immutable: tuple[str, ...] = ()) -> DataFrame:
    """(natural_key, change, source, content_hash, old_hash): new, unchanged, corrected,
    withdrawn or kept.

    A fact that no candidate states is withdrawn only if its family is a snapshot and
    its source is connected; otherwise it is kept. A fact of an immutable family is
    unchanged whatever is stated of it later. One full outer join on the key.
    """
    c = candidates.select("natural_key", F.col("source").alias("c_source"), F.col("content_hash").alias("c_hash"))
    f = live.select("natural_key", F.col("source").alias("f_source"), F.col("content_hash").alias("f_hash"), F.col("family").alias("f_family"))
    gone = (F.col("f_family") == SNAPSHOT) & F.col("f_source").isin(*connected)
    change = (
        F.when(F.col("f_hash").isNull(), "new")
        .when(F.col("c_hash").isNull(), F.when(gone, "withdrawn").otherwise("kept"))
        .when((F.col("c_hash") == F.col("f_hash")) | F.col("f_family").isin(*immutable), "unchanged")
        .otherwise("corrected")
    )
    return c.join(f, "natural_key", "full_outer").select("natural_key", change.alias("change"), F.coalesce("c_source", "f_source").alias("source"), F.col("c_hash").alias("content_hash"), F.col("f_hash").alias("old_hash"))


def writes(changes: DataFrame) -> DataFrame:
    """The feed rows of a diff: withdrawals (of gone and corrected facts), then new ones
    (of new and corrected), as (ord, natural_key, withdrawn, content_hash)."""
    old = changes.where("change in ('withdrawn', 'corrected')").select(F.lit(0).alias("ord"), "natural_key", F.lit(True).alias("withdrawn"), F.col("old_hash").alias("content_hash"))
    new = changes.where("change in ('new', 'corrected')").select(F.lit(1).alias("ord"), "natural_key", F.lit(False).alias("withdrawn"), "content_hash")
    return old.unionByName(new)


def sequenced(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """feed_seq from start + 1, without a hole, in the given total order, and without a
    single task: rows are range-partitioned and sorted, partitions are counted, and
    each row adds its place to the count of the partitions before (one number per
    partition goes through the driver)."""
    from factloom.session import cut

    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__id"), 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], start
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__p long, __o long"))
    return placed.join(table, part == F.col("__p")).withColumn("feed_seq", F.col("__o") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).drop("__id", "__p", "__o")


def changed_history(observed: DataFrame, history: DataFrame, key: list[str], value: str, changed_at: str, seq: str) -> DataFrame:
    """The observations to append: those whose value or vendor date differs, null-safe,
    from the latest history row of their key, or that have none."""
    latest = history.groupBy(*key).agg(F.max_by(F.struct(F.col(value).alias("__v"), F.col(changed_at).alias("__c")), seq).alias("l"))
    same = F.col("l.__v").eqNullSafe(F.col(value)) & F.col("l.__c").eqNullSafe(F.col(changed_at))
    return observed.join(latest, key, "left").where(F.col("l").isNull() | ~same).select(observed.columns)


def owner_of_subject(subjects: DataFrame, presence_owner: DataFrame, key_owner: DataFrame) -> DataFrame:
    """(subject, owner): the person of the subject's presence, else of its first held
    key (by place), else itself. subjects: (subject, presence, keys)."""
    by_key = subjects.select("subject", F.posexplode("keys").alias("pos", "key")).join(key_owner, "key").groupBy("subject").agg(F.min_by("person_key", "pos").alias("__k"))
    p = presence_owner.select("presence", F.col("person_key").alias("__p"))
    return subjects.join(p, "presence", "left").join(by_key, "subject", "left").select("subject", F.coalesce("__p", "__k", "subject").alias("owner"))


def upsert_new(incoming: DataFrame, stored: DataFrame, key: list[str], hashed: str = "content_hash") -> DataFrame:
    """The records to write: those not stored with this very content."""
    return incoming.join(stored.select(*key, hashed).distinct(), [*key, hashed], "left_anti")


def marker(*tables: tuple[DataFrame, str]) -> DataFrame:
    """One row per table (newest time, rows): a change of any says that inputs changed."""
    out = None
    for i, (df, at) in enumerate(tables):
        one = df.agg(F.max(F.col(at).cast("string")).alias("newest"), F.count("*").alias("n")).withColumn("source", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out

