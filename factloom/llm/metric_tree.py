"""Exact top-k inner products by best-first search of an M-tree kept as Spark rows.

Vectors become integers, floor(256 * x). With M2 the largest squared length, the
point x' = (x, sqrt(M2 - |x|^2)) turns the largest inner product with q into the
smallest Euclidean distance from (q, 0), a metric, as |q' - x'|^2 = |q|^2 + M2 - 2 q.x.

The tree has an upper level, leaves and pages. Routing objects are a bounded sample
(ROUTING). Every vector goes to its nearest routing object; a leaf keeps its
covering radius and the distance to its upper node, and its vectors, sorted by
their distance to the routing object, lie in pages of PAGE vectors, one row each.

A query first visits the nearest leaves that hold k vectors, which bounds its k-th
score; then, nearest first in bound, every leaf whose covering ball can still beat
it. Upper nodes and leaves are ruled out by covering radii, leaves also by parent
distances before their own distance is computed, and in a page only the vectors
whose stored parent distance lies within the bound are compared. Scores are exact
integers; the bounds have slack for rounding, so ties at the bound are kept.

Vectors and visits meet in an equi-join of pages and blocks of queries on the leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import cut

#: Routing objects at most, and the vectors that a leaf should have about.
ROUTING, LEAF = 4096, 512
#: Visits that a task holds at once.
VISITS = 20_000
#: Vectors of a page, and queries of a block that visits it.
PAGE, BLOCK = 2048, 1024
SLACK = 1e-6


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (longs): floor(256 x). Rows whose id or vector is null, or that hold
    a null or non-finite component, are left out."""
    x = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("x"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(whole).select("vec_id", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v"))


def matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.float64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def routing_sample(data: DataFrame, n: int, most: int) -> list:
    """Of about four vectors to each of `most` buckets the least in each. They are told by
    hash and folded in the tasks: an ordered limit sends `most` rows of every partition to
    the driver."""
    bucket = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(most))
    for share in (max(1, n // (4 * most)), 1):
        some = data.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(share)) == 0).groupBy(bucket.alias("bucket")).agg(F.min("v").alias("v"))
        found = [r.v for r in some.select("v").collect()]
        if found:  # none, where few rows are repeated often
            break
    return found


class Space:
    """Distances of lifted points and of queries."""

    def __init__(self, dim: int, m2: float, exact: bool):
        self.dim, self.m2, self.exact = dim, m2, exact

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.c_[v, np.sqrt(np.maximum(0, self.m2 - (v * v).sum(1)))]

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.sqrt(np.maximum(0, d))

    def query(self, q: np.ndarray) -> np.ndarray:
        return np.c_[q, np.zeros(len(q))]

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a score lies, with slack; all of space for no score."""
        d = np.sqrt(np.maximum(0, (q * q).sum(1) + self.m2 - 2 * score))
        return np.where(np.isneginf(score), np.inf, d + SLACK * (1 + np.sqrt(self.m2)))

    def scores(self, vecs: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact:  # every sum stays below 2^53
            return (vecs @ q).astype(np.int64)
        return vecs.astype(np.int64) @ q.astype(np.int64)


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by
    `every` its k highest integer inner products among all other rows, ties to the
    smaller vec_id; all others, if fewer than k.

    Invalid rows (see quantised) take no part. Shorter vectors count as padded with
    zeros. Rows with the query's own id are not its candidates; if a query's id
    repeats, the least vector is the query. Scores must fit 64 bits, else ValueError.
    An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    data = quantised(vectors, id_col, vec_col)
    wide = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    told = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.expr("array_max(transform(v, c -> abs(cast(c as double))))")).alias("top"), F.max(wide).alias("m2"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not told["n"] or not told["queries"]:
        return spark.createDataFrame([], schema)
    dim, top = told["dim"] or 0, told["top"] or 0.0
    if dim * top * top >= 2**62:
        raise ValueError("inner products do not fit 64 bits")
    space = Space(dim, told["m2"], dim * top * top < 2**52)
    n_routing = int(min(ROUTING, max(1, -(-told["n"] // LEAF))))

    # routing objects: distinct vectors; the upper level is a prefix of them
    distinct = np.unique(matrix(routing_sample(data, told["n"], n_routing), dim), axis=0)
    routing = space.lift(distinct[np.random.default_rng(0).permutation(len(distinct))])
    upper = routing[: max(1, round(len(routing) ** 0.5))]
    to_upper = space.between(routing, upper)
    parent = to_upper.argmin(1)
    parent_far = to_upper[np.arange(len(routing)), parent]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = matrix(b["v"].tolist(), dim)
            for at in range(0, len(v), 4096):
                d = space.between(space.lift(v[at : at + 4096]), routing)
                leaf = d.argmin(1)
                yield pd.DataFrame({"leaf": leaf.astype("int32"), "far": d[np.arange(len(d)), leaf], "vec_id": b["vec_id"].to_numpy()[at : at + 4096], "v": [x.tobytes() for x in v[at : at + 4096]]})

    placed = cut(data.mapInPandas(assign, "leaf int, far double, vec_id long, v binary"))
    stats = placed.groupBy("leaf").agg(F.max("far").alias("radius"), F.count("*").alias("n")).toPandas()  # at most ROUTING rows
    radius, size = np.full(len(routing), -np.inf), np.zeros(len(routing), np.int64)
    radius[stats["leaf"]], size[stats["leaf"]] = stats["radius"], stats["n"]
    covering = np.full(len(upper), -np.inf)
    np.maximum.at(covering, parent, parent_far + radius)
    slack = SLACK * (1 + np.sqrt(space.m2))

    def paged(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["far", "vec_id"])
        return pd.DataFrame({"leaf": [b["leaf"].iloc[0]], "ids": [b["vec_id"].to_numpy(np.int64).tobytes()], "fars": [b["far"].to_numpy(np.float64).tobytes()], "vecs": [b"".join(b["v"])]})

    parts = F.array(*[F.lit(int(-(-max(1, s) // PAGE))) for s in size])
    pages = cut(placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.element_at(parts, F.col("leaf") + 1)).cast("int")).groupBy("leaf", "part").applyInPandas(paged, "leaf int, ids binary, fars binary, vecs binary"))
    queries = cut(data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = int(-(-told["queries"] // BLOCK))

    def visits(first: bool):
        """Leaves that each query visits: the nearest ones with k vectors, or every
        other one that may hold a score as high as its k-th so far."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                q = matrix(b["v"].tolist(), dim)
                lifted = space.query(q)
                score = np.full(len(q), -np.inf) if first else b["kth"].fillna(-np.inf).to_numpy(np.float64)
                reach = space.reach(q, score)
                rows, columns = [], ["leaf", "query_id", "q", "far", "reach"]
                to_top = space.between(lifted, upper)
                for i in range(len(q)):
                    far = np.full(len(routing), np.inf)
                    up = np.flatnonzero(to_top[i] - covering <= reach[i] + slack)
                    under = np.flatnonzero(np.isin(parent, up) & (size > 0))
                    # by the stored parent distance alone
                    under = under[np.abs(to_top[i][parent[under]] - parent_far[under]) - radius[under] <= reach[i] + slack]
                    far[under] = space.between(lifted[i : i + 1], routing[under])[0]
                    if not first:
                        seen = set(b["seen"].iloc[i])
                        use = [x for x in np.flatnonzero(far - radius <= reach[i] + slack) if x not in seen]
                    else:
                        order = under[np.argsort(far[under])]
                        use = order[: int(np.searchsorted(np.cumsum(size[order]), k + 1)) + 1]
                    for x in use:
                        rows.append((int(x), int(b["vec_id"].iloc[i]), q[i].tobytes(), far[x], reach[i]))
                    if len(rows) >= VISITS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

        return run

    def together(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"leaf": [b["leaf"].iloc[0]], "q_ids": [b["query_id"].to_numpy(np.int64).tobytes()], "qs": [b"".join(b["q"])], "q_fars": [b["far"].to_numpy(np.float64).tobytes()], "reaches": [b["reach"].to_numpy(np.float64).tobytes()]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, fars = np.frombuffer(r.ids, np.int64), np.frombuffer(r.fars)
                vecs = np.frombuffer(r.vecs).reshape(len(ids), dim)
                q_ids, qs = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.qs).reshape(-1, dim)
                found = []
                for q_id, q, far, reach in zip(q_ids, qs, np.frombuffer(r.q_fars), np.frombuffer(r.reaches)):
                    lo = np.searchsorted(fars, far - reach - slack, "left")
                    hi = np.searchsorted(fars, far + reach + slack, "right")
                    s, who = space.scores(vecs[lo:hi], q), ids[lo:hi]
                    own = who == q_id
                    if own.any():
                        s, who = s[~own], who[~own]
                    if len(s) > 4 * k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        high = s >= least
                        s, who = s[high], who[high]
                    best = np.lexsort((who, -s))[:k]
                    found.append((np.full(len(best), q_id), who[best], s[best]))
                if found:
                    a, c, d = map(np.concatenate, zip(*found))
                    yield pd.DataFrame({"query_id": a, "vec_id": c, "score": d, "leaf": r.leaf})

    def scanned(found: DataFrame) -> DataFrame:
        block = found.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        asked = block.groupBy("leaf", "block").applyInPandas(together, "leaf int, q_ids binary, qs binary, q_fars binary, reaches binary")
        return pages.join(asked, "leaf").mapInPandas(scan, "query_id long, vec_id long, score long, leaf int")

    visit = "leaf int, query_id long, q binary, far double, reach double"
    some = queries.repartition(max(1, min(200, told["queries"] // 64 + 1)))
    first_visits = cut(some.mapInPandas(visits(True), visit))
    first = cut(scanned(first_visits))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(w)).where(f"rank = {k}").select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    seen = first_visits.groupBy(F.col("query_id").alias("vec_id")).agg(F.collect_set("leaf").alias("seen"))
    more = queries.join(seen, "vec_id").join(kth, "vec_id", "left").repartition(max(1, min(200, told["queries"] // 64 + 1)))
    second = scanned(more.mapInPandas(visits(False), visit))
    every_one = first.unionByName(second)
    return every_one.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


#: The same by comparing each query with every row.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM ranked WHERE n <= 5
"""
