"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into cells of source, language and topic. A share KEEP of all
tokens is to be spread so that each margin has its target weight, and raking finds
the cell weights: margin after margin, every cell is scaled by target over current
weight of its margin's value, but never beyond the tokens it has. A document is
then kept with probability weight over tokens of its cell, decided by a hash of its
id, so a run can be repeated and joined with others.

A margin's target is given as a power of its values' tokens (1: as they are, 0: all
alike), which lifts rare values over a source that holds a third of all rows.

The topic column, where the table has one, is a topic model's output; else it is
the first word's bucket of TOPICS.

Everything is built-in column functions. Documents are read by column: per-document
sums first, one row a cell after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.tables import hinted
from factloom.session import cut

KEEP = 0.8
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
SWEEPS = 8
TOPICS = 8
#: Cells up to which raking runs in one task, without a shuffle for each margin.
ONE_TASK = 100_000
MARGINS = tuple(POWERS)
WORD = r"[^\x20\x09-\x0D]+"


def hashed(x: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, digits), 16, 10).cast("long")


def topic(text: Column) -> Column:
    first = F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), WORD, 0)
    return F.when(first == "", 0).otherwise(hashed(first, 8) % TOPICS).cast("int")


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def chance(id_: Column) -> Column:
    """A number from 0 to under 1 that depends on the id alone."""
    return hashed(F.coalesce(id_.cast("string"), F.lit("")), 13) / F.lit(float(1 << 52))


def margins(docs: DataFrame) -> list[Column]:
    """source, lang and topic of a document; a null source, language or told topic is '(none)'."""
    label = lambda c: F.coalesce(docs[c].cast("string"), F.lit("(none)")).alias(c)
    told = label("topic") if "topic" in docs.columns else topic(docs["text"].cast("string")).alias("topic")
    return [label("source"), label("lang"), told]


def raked(cells: DataFrame, keep: float = KEEP, powers: dict = POWERS, sweeps: int = SWEEPS) -> DataFrame:
    """cells (the margins, t tokens) with w, the calibrated weight, at most t."""
    for c, power in powers.items():
        mine = F.sum("t").over(Window.partitionBy(c))
        cells = cells.withColumn(f"m_{c}", F.pow(mine.cast("double"), F.lit(power))).withColumn(f"r_{c}", F.row_number().over(Window.partitionBy(c).orderBy(*powers)))
    one = Window.partitionBy(F.lit(1))
    total = F.sum("t").over(one).cast("double") * keep
    goals = [(total * F.col(f"m_{c}") / F.sum(F.when(F.col(f"r_{c}") == 1, F.col(f"m_{c}"))).over(one)).alias(f"goal_{c}") for c in powers]
    cells = cells.select(*powers, "t", *goals, (F.col("t") * F.lit(float(keep))).alias("w"))
    for i in range(sweeps):
        for c in powers:
            now = F.sum("w").over(Window.partitionBy(c))
            cells = cells.withColumn("w", F.when(now > 0, F.least(F.col("t").cast("double"), F.col("w") * F.col(f"goal_{c}") / now)).otherwise(F.lit(0.0)))
        if i % 4 == 3:
            cells = cut(cells)
    return cells.select(*powers, "t", "w")


def probabilities(base: DataFrame, keep: float = KEEP, powers: dict = POWERS) -> DataFrame:
    """The margins with each cell's probability, from rows (margins, n_tokens).

    A cell without tokens has probability 1: nothing of it weighs."""
    cells = cut(base.groupBy(*powers).agg(F.sum("n_tokens").alias("t")))
    some = cells.where("t > 0")
    if cells.limit(ONE_TASK + 1).count() <= ONE_TASK:
        some = some.coalesce(1)
    p = raked(some, keep, powers).select(*powers, F.round(F.col("w") / F.col("t"), 9).alias("probability"))
    return cells.join(p, list(powers), "left").select(*powers, F.coalesce("probability", F.lit(1.0)).alias("probability"))


def mixed(docs: DataFrame, keep: float = KEEP, id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, sampled per row of docs.

    A null text has no tokens and topic 0; a document without tokens has its cell's
    probability. Rows with one id are sampled together, a null id as the empty one.
    An empty table gives no rows. Columns other than id, text, source and lang are
    not read.
    """
    base = cut(docs.select(docs[id_col].cast("long").alias("doc_id"), *margins(docs), tokens(docs["text"].cast("string")).alias("n_tokens")))
    p = hinted(cut(probabilities(base)))
    return base.join(p, list(MARGINS)).select("doc_id", *MARGINS, "n_tokens", "probability", (chance(F.col("doc_id")) < F.col("probability")).alias("sampled"))


def sampled(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The sampled rows of docs with all their columns, whatever these are called.

    A null source or language is a margin of its own, a null or empty text has no tokens
    and topic 0; rows with one id, repeated ones too, are sampled together, a null id
    as the empty one. An empty table gives no rows.
    """
    base = cut(docs.select(*margins(docs), tokens(docs["text"].cast("string")).alias("n_tokens")).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens")))
    p = hinted(cut(probabilities(base, keep)))
    rows = docs.select(*margins(docs), chance(docs["doc_id"]).alias("drawn"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    drawn = rows.join(p, list(MARGINS)).where("drawn < probability")
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def oracle_sql(keep: float = KEEP, powers: dict = POWERS, sweeps: int = SWEEPS, documents: str = "documents") -> tuple[str, str]:
    """(WITH clause, name of the table with doc_id, margins, n_tokens, probability,
    sampled) for DuckDB."""
    key = ", ".join(powers)
    ctes = [
        f"""mix_base AS (SELECT *, coalesce(source, '(none)') AS mix_source, coalesce(lang, '(none)') AS mix_lang,
  regexp_extract(lower(coalesce(text, '')), '{WORD}') AS mix_first, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM {documents})""",
        f"""mix_docs AS (SELECT * EXCLUDE (source, lang), mix_source AS source, mix_lang AS lang,
  CASE WHEN mix_first = '' THEN 0 ELSE (('0x' || substr(md5(mix_first), 1, 8))::BIGINT % {TOPICS})::INTEGER END AS topic FROM mix_base)""",
        f"mix_cells AS (SELECT {key}, sum(n_tokens)::DOUBLE AS t FROM mix_docs GROUP BY {key})",
        "mix_all AS (SELECT sum(t) AS total FROM mix_cells)",
    ]
    for c, power in powers.items():
        ctes.append(f"mix_m_{c} AS (SELECT {c}, pow(sum(t), {power}) AS m FROM mix_cells WHERE t > 0 GROUP BY {c})")
        ctes.append(f"mix_g_{c} AS (SELECT {c}, (SELECT total FROM mix_all) * {keep} * m / (SELECT sum(m) FROM mix_m_{c}) AS goal FROM mix_m_{c})")
    ctes.append(f"mix_w_0 AS (SELECT c.*, {', '.join(f'g_{c}.goal AS goal_{c}' for c in powers)}, c.t * {keep} AS w FROM mix_cells c " + " ".join(f"JOIN mix_g_{c} g_{c} USING ({c})" for c in powers) + " WHERE t > 0)")
    n = 0
    for _ in range(sweeps):
        for c in powers:
            ctes.append(f"mix_w_{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {c}) > 0 THEN least(t, w * goal_{c} / sum(w) OVER (PARTITION BY {c})) ELSE 0 END AS w) FROM mix_w_{n})")
            n += 1
    ctes.append(f"""mix_out AS (SELECT d.*, coalesce(p.probability, 1.0) AS probability,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)}) < coalesce(p.probability, 1.0) AS sampled
  FROM mix_docs d LEFT JOIN (SELECT {key}, round(w / t, 9) AS probability FROM mix_w_{n}) p USING ({key}))""")
    return ",\n".join(ctes), "mix_out"


def query_sql() -> str:
    ctes, name = oracle_sql()
    return f"WITH {ctes}\nSELECT doc_id, source, lang, topic, n_tokens, probability, sampled FROM {name}"
