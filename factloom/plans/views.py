"""The engine's tables made from the test tables: each view has the columns the operators
expect, with undated rows, refunds and retired rows put in by rule, and the same rule
as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as facts: every seventh user is undated, every fifth purchase failed, every
    fourth is refunded whole, every thirteenth states no amount, every eleventh event is
    retired."""
    e = table(spark, sf_dir, "events")
    c = F.col
    amount = F.when(c("event_id") % 13 != 0, F.floor(c("value") * 100).cast("long"))
    types = {"view": "website_visit", "signup": "signup", "purchase": "payment", "click": "form_submitted"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[c("event_type")], c("event_type"))
    who = F.concat(F.lit("email:u"), c("user_id"), F.lit("@example.com"))
    return e.select(
        F.lit("org").alias("org_id"),
        F.lit("brand").alias("brand_id"),
        who.alias("person_key"),
        F.when(c("event_id") % 17 != 0, who).alias("owner_person_key"),
        kind.alias("type"),
        F.when(c("event_id") % 3 == 0, "crm").otherwise("web").alias("source"),
        F.when(c("user_id") % 7 != 0, c("ts")).alias("occurred_at"),
        (c("event_id") % 11 != 0).alias("live"),
        F.struct(
            amount.alias("amount_minor"),
            F.when(c("event_id") % 4 == 0, amount).alias("amount_refunded"),
            F.when(c("event_id") % 5 == 0, "failed").otherwise("succeeded").alias("status"),
            (c("event_id") % 2 == 0).alias("refunded"),
            F.when(c("event_id") % 6 != 0, F.concat(F.lit("f"), (c("event_id") % 5).cast("string"))).alias("form_id"),
        ).alias("payload"),
        "event_id",
    )


FACTS = """facts AS (
  SELECT 'email:u' || user_id || '@example.com' AS person_key,
         CASE WHEN event_id % 17 <> 0 THEN 'email:u' || user_id || '@example.com' END AS owner_person_key,
         CASE event_type WHEN 'view' THEN 'website_visit' WHEN 'purchase' THEN 'payment' WHEN 'click' THEN 'form_submitted' ELSE event_type END AS type,
         CASE WHEN event_id % 3 = 0 THEN 'crm' ELSE 'web' END AS source,
         CASE WHEN user_id % 7 <> 0 THEN ts END AS occurred_at,
         event_id % 11 <> 0 AS live,
         CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 100) AS BIGINT) END AS amount_minor,
         event_id % 4 = 0 AS back, event_id % 5 = 0 AS failed, event_id % 2 = 0 AS refunded,
         CASE WHEN event_id % 6 <> 0 THEN 'f' || (event_id % 5) END AS form_id, event_id
  FROM events),
evidence AS (
  SELECT CASE type WHEN 'form_submitted' THEN 'form_submission' WHEN 'payment' THEN 'sale' ELSE type END AS step,
         owner_person_key AS person_key, source, occurred_at
  FROM facts
  WHERE live AND owner_person_key IS NOT NULL AND type IN ('website_visit', 'signup', 'form_submitted', 'payment')
    AND (type <> 'payment' OR (NOT failed AND CASE WHEN amount_minor IS NOT NULL THEN amount_minor - CASE WHEN back THEN amount_minor ELSE 0 END > 0 ELSE NOT refunded END))
    AND NOT (type = 'form_submitted' AND form_id IS NOT NULL AND form_id IN ('f1', 'f3')))"""


def calendars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("org", "brand", "f1"), ("org", "brand", "f3"), ("org", "brand", None), ("org", "other", "f2")], "org_id string, brand_id string, form_id string")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three users have a person row."""
    who = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 3 <> 0")
    key = F.concat(F.lit("email:u"), F.col("user_id"), F.lit("@example.com"))
    return who.select(
        F.lit("org").alias("org_id"),
        F.lit("brand").alias("brand_id"),
        key.alias("person_key"),
        F.array(key, F.concat(F.lit("uid:"), F.col("user_id"))).alias("identity_keys"),
        F.array(F.substring(key, 7, 100)).alias("emails"),
        F.concat(F.lit("User "), F.col("user_id")).alias("display_name"),
        (F.col("user_id") % 5 == 0).alias("automated"),
        (F.col("user_id") % 5 == 1).alias("not_business"),
        (F.col("user_id") % 11 == 2).alias("group_only"),
    )


def contacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second user was contacted for the sale and the visit."""
    who = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 2 = 0")
    return who.select(
        F.lit("org").alias("org_id"),
        F.lit("brand").alias("brand_id"),
        F.explode(F.array(F.lit("sale"), F.lit("website_visit"))).alias("step"),
        F.concat(F.lit("email:u"), F.col("user_id"), F.lit("@example.com")).alias("person_key"),
    )


CONTACTED = """contacted AS (SELECT DISTINCT s.step, 'email:u' || user_id || '@example.com' AS person_key FROM events, (VALUES ('sale'), ('website_visit')) s(step) WHERE user_id % 2 = 0)"""
