"""Connected components by alternating large-star and small-star rounds.

Both rounds are grouped minima and equi-joins, so no task ever holds a whole
component: a hub's edges are aggregated map-side first and its join side can be
split by adaptive execution. The number of rounds grows with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"),
    ).first()
    return row["n"], row["x"]


#: Edges of a partition at most where there are few: rounds over few edges need few tasks.
SHARE = 50_000


def _gathered(edges: DataFrame, n: int) -> DataFrame:
    return edges.coalesce(max(8, -(-n // SHARE)))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node on an edge; root is the component's smallest node.

    Rows with a null end and loops tie nothing and are ignored. Nodes without an
    edge do not appear. An empty edge table gives an empty result.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = cut(e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = _mark(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        # large star: every neighbour above u hangs on u's smallest neighbour (or u)
        few = lambda df, n=before[0]: _gathered(df, n)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = few(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct()
        # small star: u and its lower neighbours hang on the smallest of them
        large = few(large)
        low = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
        ).distinct()
        e = cut(few(small))
        after = _mark(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = after
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
