"""Places in a total order without a single task: numbering, pages of whole contacts, and
batches that never split a run.

`numbered` range-partitions, sorts and counts; only one count a partition goes through the
driver. Batches are greedy in the order of runs, so where one begins depends on all before.
But a block of runs, entered at one of its first places, is left at one of the next block's:
each block tells that as a table of at most MAX_RUNS places (its next-boundary function),
tables are composed in groups of WIDTH, level by level, and the true entries come
down the same way. No task sees more than a block or WIDTH tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.facts import sequenced

#: Runs and rows of a batch at most.
MAX_RUNS, MAX_ROWS = 500, 1000
#: Runs of a block (several times MAX_RUNS), and tables composed at once.
BLOCK, WIDTH = 50_000, 256


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place (from 0) in the given total order."""
    return sequenced(rows, order, -1).withColumnRenamed("feed_seq", name)


def contact_page(events: DataFrame, limit: int, offset: int, contact: str = "contact_id") -> DataFrame:
    """All events of the contacts at places offset .. offset + limit - 1 in order of their
    id, with `place`: pages are disjoint, none splits a contact, and all contacts are
    on one. Rows without a contact are on none."""
    at = numbered(events.select(contact).where(F.col(contact).isNotNull()).distinct(), [contact])
    page = at.where((F.col("place") >= offset) & (F.col("place") < offset + limit))
    return events.join(F.broadcast(page) if limit <= 10_000 else page, contact)


def contact_pages(events: DataFrame, size: int, contact: str = "contact_id") -> DataFrame:
    """All events with the page of their contact, from 0: what paging to the end reads."""
    at = numbered(events.select(contact).where(F.col(contact).isNotNull()).distinct(), [contact])
    return events.join(at.select(contact, F.expr(f"place div {size}").alias("page")), contact)


def _next(sizes: np.ndarray, max_runs: int, max_rows: int) -> np.ndarray:
    """Of each run the place of the batch after the one that begins with it: as many runs
    as fit, at least itself."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    i = np.arange(len(sizes))
    by_rows = np.searchsorted(upto, upto[:-1] + max_rows, "right") - 1
    return np.maximum(i + 1, np.minimum(by_rows, i + max_runs))


def _table(sizes: np.ndarray, own: int, max_runs: int, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's function: for each of its first max_runs places, where a batch that begins
    there leads behind the block, and how many batches begin in the block."""
    to = _next(sizes, max_runs, max_rows)
    leave, begun = np.zeros(own, np.int64), np.zeros(own, np.int64)
    for i in range(own - 1, -1, -1):
        t = int(to[i])
        leave[i], begun[i] = (t - own, 1) if t >= own else (leave[t], begun[t] + 1)
    return leave[:max_runs], begun[:max_runs]


def _through(tables: list, place: int) -> tuple[list[tuple[int, int]], int, int]:
    """Where blocks in order are entered and how many batches began before each, from a
    place in the first; then the place behind the last and the batches begun in all."""
    seen, count = [], 0
    for leave, begun, own in tables:
        seen.append((place, count))
        if place < own:  # else a batch of the block before goes on past this one
            place, count = int(leave[place]), count + int(begun[place])
        else:
            place -= own
    return seen, place, count


def _entries(tables: DataFrame) -> DataFrame:
    """(block, entry, before) of tables (block, leave, begun, own): where each is entered and
    how many batches begin before it."""
    spark = tables.sparkSession
    out = "block long, entry long, before long"
    unpack = lambda b: [(np.array(x), np.array(y), int(n)) for x, y, n in zip(b["leave"], b["begun"], b["own"])]
    blocks = tables.agg(F.max("block")).first()[0]
    if blocks is None:
        return spark.createDataFrame([], out)
    if blocks < WIDTH:
        held = tables.orderBy("block").toPandas()  # at most WIDTH tables
        seen = _through(unpack(held), 0)[0]
        return spark.createDataFrame([(int(b), p, c) for b, (p, c) in zip(held["block"], seen)], out)

    def compose(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("block")
        held = unpack(b)
        ends = [_through(held, p)[1:] for p in range(len(held[0][0]))]
        return pd.DataFrame({"block": [int(b["block"].iloc[0]) // WIDTH], "leave": [[e[0] for e in ends]], "begun": [[e[1] for e in ends]], "own": [int(b["own"].sum())]})

    def down(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("block")
        seen = _through(unpack(b), int(b["entry"].iloc[0]))[0]
        return pd.DataFrame({"block": b["block"], "entry": [p for p, _ in seen], "before": [int(b["before"].iloc[0]) + c for _, c in seen]})

    group = F.expr(f"block div {WIDTH}").alias("g")
    above = _entries(tables.groupBy(group).applyInPandas(compose, tables.schema))
    met = tables.withColumn("g", group).join(above.withColumnRenamed("block", "g"), "g")
    return met.groupBy("g").applyInPandas(down, out)


def batches(rows: DataFrame, run: str, order: list[str], max_runs: int = MAX_RUNS, max_rows: int = MAX_ROWS, block: int = BLOCK) -> DataFrame:
    """rows with `batch` (from 0): runs in the order of their first rows, as many to a batch
    as max_runs and max_rows allow; a run larger than max_rows is a batch alone.

    order must be total; rows without a run are left out.
    """
    from factloom.session import cut

    block = max(block, max_runs)
    first = F.min(F.struct(*order)).alias("__first")
    sizes = rows.where(F.col(run).isNotNull()).groupBy(run).agg(first, F.count("*").alias("n"))
    placed = cut(numbered(sizes.select(run, "n", *[F.col(f"__first.{c}").alias(f"__o{i}") for i, c in enumerate(order)]), [f"__o{i}" for i in range(len(order))]).select(run, "n", "place"))
    at = placed.withColumn("block", F.expr(f"place div {block}"))
    # a block also sees the first runs of the next one, as far as its last batch can reach
    reach = at.where((F.col("place") % block < max_runs) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    seen = at.unionByName(reach)

    def table(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("place")
        no = int(b["block"].iloc[0])
        own = int((b["place"] < (no + 1) * block).sum())
        leave, begun = _table(b["n"].to_numpy(), own, max_runs, max_rows)
        return pd.DataFrame({"block": [no], "leave": [leave], "begun": [begun], "own": [own]})

    entries = _entries(cut(seen.groupBy("block").applyInPandas(table, "block long, leave array<long>, begun array<long>, own long")))

    def mark(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("place")
        no, entry, before = int(b["block"].iloc[0]), int(b["entry"].iloc[0]), int(b["before"].iloc[0])
        own = int((b["place"] < (no + 1) * block).sum())
        to, begins, i = _next(b["n"].to_numpy(), max_runs, max_rows), np.zeros(len(b), np.int64), entry
        while i < own:
            begins[i] = 1
            i = int(to[i])
        return pd.DataFrame({run: b[run], "batch": before + np.cumsum(begins) - 1}).iloc[:own]

    kind = placed.schema[run].dataType.simpleString()
    told = seen.join(entries, "block").groupBy("block").applyInPandas(mark, f"`{run}` {kind}, batch long")
    return rows.join(told, run)
