"""Normal forms of addresses, numbers, domains, names and keys, as column expressions.

There are two rules for addresses and two for numbers: identity keys are strict,
contact fields only tidy. All functions give null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
DOMAIN = r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"

#: Words of a title or name that say nothing about who is meant.
STOP_WORDS = (
    "call meeting meet with and the for between intro introduction demo discovery "
    "chat sync catch up zoom google teams invitation invite updated event session "
    "consultation consult strategy onboarding follow followup via from your you our "
    "minute minutes min mins hour appel rdv rendez vous avec info contact hello "
    "team sales admin office booking scheduled calendly"
).split()


def trimmed(c: Column) -> Column:
    """Without leading and trailing white space of any kind (trim() strips spaces only)."""
    return F.regexp_replace(c, r"^[\s ﻿ - 　]+|[\s ﻿ - 　]+$", "")


def clean_text(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def identity_email(c: Column) -> Column:
    """Trimmed and lower-cased; null unless it has the form of an address. Dots stay."""
    v = F.lower(trimmed(c))
    return F.when(v.rlike(EMAIL), v)


def contact_email(c: Column) -> Column:
    """Trimmed and lower-cased; null only where nothing is left."""
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def identity_phone(c: Column) -> Column:
    """+digits, for numbers written internationally (+ or 00) with 8 to 15 digits."""
    v = trimmed(c)
    digits = F.regexp_replace(F.regexp_replace(v, r"^(\+|00)", ""), r"\D", "")
    return F.when(v.rlike(r"^(\+|00)") & F.length(digits).between(8, 15), F.concat(F.lit("+"), digits))


def contact_phone(c: Column) -> Column:
    """Digits and plus signs as they stand."""
    v = F.regexp_replace(c, r"[^\d+]", "")
    return F.when(~v.isin("", "+"), v)


def domain(c: Column) -> Column:
    """A bare lower-case host from a domain, a URL or an address."""
    v = F.lower(trimmed(c))
    v = F.when(v.contains("@") & ~v.contains("/"), F.regexp_extract(v, r"([^@]*)$", 1)).otherwise(v)
    v = F.regexp_replace(v, r"^[a-z][a-z0-9+.\-]*://", "")
    v = F.regexp_extract(v, r"^([^/?#]*)", 1)
    for part in (r":\d+$", r"^www\.", r"\.$"):
        v = F.regexp_replace(v, part, "")
    return F.when(v.rlike(DOMAIN), v)


def email_domain(c: Column) -> Column:
    """What follows the last @, if something precedes it."""
    return F.when(F.instr(c, "@") > 1, F.substring_index(c, "@", -1))


def profile_url(c: Column, site: str = "linkedin.com") -> Column:
    """A profile link in one spelling: https://www.<site>/in/<slug>; any other page of
    the site keeps its path, lower-cased. Null where it is no link to the site."""
    v = clean_text(c)
    v = F.when(v.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), v).otherwise(F.concat(F.lit("https://"), v))
    host = F.lower(F.regexp_extract(v, r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(v, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(p, r"\+", "%2B")), p)))
    first = F.get(parts, F.lit(0))
    tail = F.when((first == "in") & (F.size(parts) > 1), F.concat(F.lit("in/"), F.get(parts, F.lit(1)))).otherwise(F.array_join(parts, "/"))
    ours = (host == site) | host.endswith(f".{site}")
    return F.when(ours & (F.size(parts) > 0), F.concat(F.lit(f"https://www.{site}/"), tail))


def folded(c: Column) -> Column:
    """Lower-cased, accents of Latin letters dropped. A table of letters stands for full
    Unicode decomposition, so the expression stays in generated code."""
    marked = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
    plain_ = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
    return F.translate(F.regexp_replace(F.lower(c), r"\p{M}+", ""), marked, plain_)


def twin_name(c: Column) -> Column:
    """A full name of two words or more, folded; null for anything that is no person's
    name: digits, an address, brackets, a domain, an anonymous visitor."""
    v = F.trim(F.regexp_replace(folded(c), r"\s+", " "))
    odd = v.rlike(r"[@0-9()\[\]]|\.\w") | v.startswith("visitor from ") | (v == "")
    return F.when(~odd & v.contains(" "), v)


def name_tokens(c: Column) -> Column:
    """Distinct folded words of three letters or more that are not stop words."""
    words = F.filter(F.split(folded(c), r"[^a-z]+"), lambda w: F.length(w) >= 3)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS)))


def split_name(c: Column) -> tuple[Column, Column]:
    """(first word, the rest or null)."""
    v = clean_text(c)
    return F.nullif(F.regexp_extract(v, r"^(\S+)", 1), F.lit("")), F.nullif(F.regexp_replace(F.regexp_extract(v, r"^\S+\s+(.*)$", 1), r"\s+", " "), F.lit(""))


def like_escaped(c: Column) -> Column:
    r"""\, % and _ made literal for LIKE."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def phone_digits(c: Column) -> Column:
    """The digits of a search text that is only a number: four at least, and nothing
    but digits and the punctuation of numbers."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(c.rlike(r"^[\d\s+().\-/]+$") & (F.length(digits) >= 4), digits)


def without_plus(email: Column) -> Column:
    """local+tag@host as local@host, lower-cased."""
    v = F.lower(email)
    return F.concat(F.regexp_replace(F.substring_index(v, "@", 1), r"[+].*$", ""), F.lit("@"), F.split_part(v, F.lit("@"), F.lit(2)))


def message_key(direction: Column, occurred_at: Column, sender: Column, recipient: Column) -> Column:
    """The identity of a message seen through several stores."""
    return F.concat_ws("|", direction, F.coalesce(occurred_at.cast("string"), F.lit("")), F.coalesce(sender, F.lit("")), F.coalesce(recipient, F.lit("")))


def either_timestamp(c: Column) -> Column:
    """A time from seconds, milliseconds (over 1e11) or ISO text; null otherwise."""
    n = c.try_cast("double")
    seconds = F.when(F.abs(n) > 1e11, n / 1000).otherwise(n)
    return F.coalesce(F.when(n.isNotNull(), F.timestamp_seconds(seconds)), F.try_to_timestamp(c.cast("string")))


def content_hash(*cols: Column) -> Column:
    """SHA-256 of the columns' JSON; give them in name order for a canonical form."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)
