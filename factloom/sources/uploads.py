"""Uploaded CSV files: bronze rows, column profiles and types, silver contacts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import normalize as N

#: The field a column name states; the first rule that matches holds.
HEADER_RULES = (
    ("email", r"e[-_ ]?mail"),
    ("phone", r"\b(phone|mobile|cell|tel(?:ephone)?|whats[-_ ]?app|msisdn)\b"),
    ("first_name", r"\b(first[-_ ]?name|given[-_ ]?name|forename|fname|pr[eé]nom)\b"),
    ("last_name", r"\b(last[-_ ]?name|surname|family[-_ ]?name|lname|nom)\b"),
    ("full_name", r"(full[-_ ]?name|contact[-_ ]?name|customer[-_ ]?name|^\s*name\s*$)"),
    ("linkedin_url", r"linked[-_ ]?in"),
    ("company_domain", r"\b(website|web[-_ ]?site|domain|company[-_ ]?url|site)\b"),
    ("company_name", r"\b(company|organi[sz]ation|employer|account[-_ ]?name|soci[eé]t[eé]|entreprise)\b"),
    ("job_title", r"\b(job[-_ ]?title|title|position|role|poste|fonction)\b"),
)
#: Consent and opt-out columns by name, and what their values mean.
TRUTHY = r"(?i)^(true|1|yes|y|on|granted|subscribed|opt.?in)$"
FALSY = r"(?i)^(false|0|no|n|off|denied|unsubscribed|opt.?out)$"
UNSUBSCRIBE = r"(?i)unsub|opt.?out|do.?not.?(mail|email|contact)|blacklist|suppress"
CONSENT = r"(?i)consent|gdpr|opt.?in|permission|marketing.?consent"
#: Fields whose columns are also kept verbatim.
ALSO_RAW = ("company_name", "company_domain", "job_title", "linkedin_url")


def unique_headers(names: list[str]) -> list[str]:
    """Trimmed; blank ones are `column`; repeats become name_2, name_3."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        name = (raw or "").strip() or "column"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def read_upload(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(headers, rows) of one CSV file: rows are (row_number, payload map of header to
    trimmed text). Quoted line breaks, ragged rows and a byte-order mark are allowed,
    empty lines skipped. The header is read from the first record alone."""
    first = spark.read.option("multiLine", True).option("header", False).csv(path).limit(1).first()
    if first is None:
        return [], spark.createDataFrame([], "row_number long, payload map<string,string>")
    headers = unique_headers([(x or "").removeprefix("﻿") for x in first])
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    rows = spark.read.schema(schema).option("multiLine", True).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)
    rows = rows.withColumn("row_number", F.monotonically_increasing_id())
    entries = [x for i, h in enumerate(headers) for x in (F.lit(h), N.trimmed(F.col(f"c{i}")))]
    rows = rows.where(F.coalesce(*[F.nullif(N.trimmed(F.col(f"c{i}")), F.lit("")) for i in range(len(headers))]).isNotNull())
    return headers, rows.select("row_number", F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()).alias("payload"))


def column_profiles(rows: DataFrame, headers: list[str]) -> DataFrame:
    """(header, samples): the first five non-empty values of each column, in row order.
    min_by on bounded lists: each task keeps five a column, no column is gathered."""
    cells = rows.select("row_number", F.explode("payload").alias("header", "value")).where(N.trimmed(F.col("value")) != "")
    from pyspark.sql import Window

    w = Window.partitionBy("header").orderBy("row_number")
    five = cells.withColumn("n", F.row_number().over(w)).where("n <= 5")
    got = five.groupBy("header").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("samples"))
    every = rows.sparkSession.createDataFrame([(h,) for h in headers], "header string")
    return every.join(got, "header", "left").select("header", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def typed_columns(headers: list[str]) -> dict[str, str]:
    """The field each header states; `other` if none."""
    return {h: next((f for f, rule in HEADER_RULES if re.search(rule, h, re.I)), "other") for h in headers}


def _first(headers: list[str], mapping: dict[str, str], field: str) -> Column:
    held = [F.nullif(N.trimmed(F.col("payload")[h]), F.lit("")) for h in headers if mapping.get(h) == field]
    return F.coalesce(*held) if held else F.lit(None).cast("string")


def silver_contacts(rows: DataFrame, headers: list[str], mapping: dict[str, str]) -> DataFrame:
    """One contact per row: the first non-empty column of each field, names split or
    joined, consent by column names, everything else kept verbatim."""
    full, first, last = (_first(headers, mapping, f) for f in ("full_name", "first_name", "last_name"))
    split_first, split_rest = N.split_name(full)
    bare = full.isNotNull() & first.isNull() & last.isNull()
    entries = F.map_entries("payload")
    told = F.filter(entries, lambda e: N.trimmed(e["value"]) != "")
    value = lambda e: N.trimmed(e["value"])
    off = F.exists(told, lambda e: e["key"].rlike(UNSUBSCRIBE) & (value(e).rlike(TRUTHY) | (value(e).rlike(FALSY) & e["key"].rlike("(?i)subscrib"))))
    said = F.filter(told, lambda e: e["key"].rlike(CONSENT) & (value(e).rlike(TRUTHY) | value(e).rlike(FALSY)))
    consent = F.when(F.size(said) == 0, "unknown").when(value(F.get(said, F.lit(0))).rlike(TRUTHY), "granted").otherwise("denied")
    raw = [h for h in headers if mapping.get(h, "other") == "other" or mapping.get(h) in ALSO_RAW]
    return rows.select(
        N.contact_email(_first(headers, mapping, "email")).alias("primary_email"),
        N.contact_phone(_first(headers, mapping, "phone")).alias("phone_e164"),
        F.coalesce(full, F.nullif(F.concat_ws(" ", first, last), F.lit(""))).alias("full_name"),
        F.when(bare, split_first).otherwise(first).alias("first_name"),
        F.when(bare, split_rest).otherwise(last).alias("last_name"),
        _first(headers, mapping, "company_name").alias("company_name"),
        N.domain(_first(headers, mapping, "company_domain")).alias("company_domain"),
        _first(headers, mapping, "job_title").alias("job_title"),
        N.profile_url(_first(headers, mapping, "linkedin_url")).alias("linkedin_url"),
        F.map_filter("payload", lambda k, v: k.isin(*raw) if raw else F.lit(False)).alias("raw_attributes"),
        consent.alias("consent_status"),
        off.alias("unsubscribed"),
        F.col("row_number").alias("source_row_id"),
    )
