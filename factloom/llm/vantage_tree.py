"""Hard negatives by a vantage-point tree over norm-augmented vectors.

Vectors become integers, floor(256 * x). With M2 the largest squared length, the point
x' = (x, sqrt(M2 - |x|^2)) lies at a distance from (q, 0) that falls as the inner product
with q grows, so a window of scores is an annulus of distances around the anchor.

The tree's nodes (vantage points and median radii) come from a bounded sample; every
vector walks down it to a leaf, one distance a level, and each leaf keeps the least and
largest distance of its vectors to every vantage point above it. A leaf's vectors,
sorted by their distance to the last of these, lie in pages of PAGE vectors, one Spark
row each, so that a leaf of equal vectors is many pages.

An anchor and a window form a search: it goes through the leaves that meet its annulus,
nearest first, in rounds of FIRST, then FANOUT times as many leaves; after a round its
k-th score so far shrinks the annulus from outside, and it ends where the next leaf lies
outside. Within a page only vectors whose stored distance lies within the bounds are
scored. First the k nearest rows of the anchor's own label are sought without a window
(positives), then each positive's window among rows of other labels.

Scores are exact integers; bounds have slack for rounding, so ties at a bound are kept.

Edge cases: rows whose id, label or vector is null, or that hold a null or non-finite
component, take no part; shorter vectors count as padded with zeros; rows of the anchor's
own id are not its candidates, and if an anchor's id repeats, its least vector, then
its least label, is the anchor; repeated candidates count one by one; ties go to the
smaller id; a positive of negative score has an empty window; scores that do not fit 55
bits raise ValueError; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.metric_tree import SLACK, Space, matrix
from factloom.session import cut

#: Vectors a leaf should have, leaves at most, and sampled vectors a leaf.
LEAF, LEAVES, SAMPLED = 512, 4096, 16
#: Vectors of a page, and anchors of a block that visits it.
PAGE, BLOCK = 2048, 512
#: Leaves of a search's first round, and how many times as many the next one has.
FIRST, FANOUT = 4, 4
FOUND = "anchor_id long, slot int, vec_id long, score long"


def labelled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label (long), v (longs) of the rows that take part."""
    x = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"), vectors[vec_col].cast("array<double>").alias("x"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = x.where("vec_id is not null and label is not null and x is not null").where(whole)
    return x.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v"))


@dataclass
class Tree:
    """Vantage points, radii, the inner and outer child of each node (leaf n is -1 - n),
    and the nodes above each leaf, root first (-1: no more)."""

    points: np.ndarray
    radius: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    above: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.above)

    @property
    def depth(self) -> int:
        return self.above.shape[1]

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each point, and its distances to the vantage points on its way (NaN: no more)."""
        at, way = np.zeros(len(x), np.int64), np.full((len(x), self.depth), np.nan)
        for level in range(self.depth):
            live = np.flatnonzero(at >= 0)
            if not len(live):
                break
            d = np.sqrt(((x[live] - self.points[at[live]]) ** 2).sum(1))
            way[live, level] = d
            at[live] = np.where(d <= self.radius[at[live]], self.inner[at[live]], self.outer[at[live]])
        return -1 - at, way


def build(sample: np.ndarray, a_leaf: int, seed: int = 0) -> Tree:
    """The tree of a sample: median splits around the point, of a few, whose distances
    spread most, down to a_leaf points; the root is always split."""
    rng = np.random.default_rng(seed)
    points, radius, sides, above = [], [], [], []

    def split(rows: np.ndarray, over: list[int]) -> int:
        tried = rng.choice(rows, min(8, len(rows)), replace=False)
        some = sample[rng.choice(rows, min(256, len(rows)), replace=False)]
        spread = [np.var(np.sqrt(((some - sample[t]) ** 2).sum(1))) for t in tried]
        best = sample[tried[int(np.argmax(spread))]]
        d = np.sqrt(((sample[rows] - best) ** 2).sum(1))
        r = float(np.median(d))
        if d.max() <= r:  # more than half lie equally far
            r = float(d[d < r].max()) if (d < r).any() else r
        near, far = rows[d <= r], rows[d > r]
        if over and (not len(near) or not len(far)):
            above.append(over)
            return -len(above)
        n = len(points)
        points.append(best)
        radius.append(r)
        sides.append([0, 0])
        for side, part in enumerate((near, far)):
            if len(part) > a_leaf:
                sides[n][side] = split(part, [*over, n])
            else:
                above.append([*over, n])
                sides[n][side] = -len(above)
        return n

    split(np.arange(len(sample)), [])
    depth = max(map(len, above))
    told = np.array([a + [-1] * (depth - len(a)) for a in above])
    return Tree(np.array(points), np.array(radius), np.array(sides)[:, 0], np.array(sides)[:, 1], told)


@dataclass
class Index:
    """The tree with what its leaves hold: sizes, and distances to the nodes above."""

    tree: Tree
    space: Space
    size: np.ndarray
    least: np.ndarray
    most: np.ndarray
    dim: int
    kind: str

    @property
    def slack(self) -> float:
        return SLACK * (1 + np.sqrt(self.space.m2))

    def distance(self, q: np.ndarray, score) -> np.ndarray:
        """Where a score lies from the anchor q; infinitely far for the score -inf, at 0 for inf."""
        return np.sqrt(np.maximum(0, (q * q).sum() + self.space.m2 - 2 * np.asarray(score, np.float64)))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each leaf: least and largest possible distance of its vectors, and the
        anchor's distance to its last vantage point."""
        d = self.space.between(self.space.query(q[None]), self.tree.points)[0]
        to, real = d[self.tree.above], self.tree.above >= 0
        low = np.where(real, np.maximum(to - self.most, self.least - to), 0).max(1)
        high = np.where(real, to + self.most, np.inf).min(1)
        last = self.tree.above[np.arange(self.tree.leaves), real.sum(1) - 1]
        return np.maximum(low, 0), high, d[last]


def indexed(data: DataFrame) -> tuple[Index, DataFrame] | None:
    """(the index, its pages: leaf, ids, labels, fars, vecs) of labelled rows; None if there are none."""
    wide = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    told = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.expr("array_max(transform(v, c -> abs(cast(c as double))))")).alias("top"), F.max(wide).alias("m2")).first()
    if not told["n"]:
        return None
    dim, top = told["dim"] or 0, told["top"] or 0.0
    if dim * top * top >= 2**55:
        raise ValueError("inner products do not fit 55 bits")
    space = Space(dim, told["m2"], dim * top * top < 2**52)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
    leaves = int(min(LEAVES, max(1, -(-told["n"] // LEAF))))
    sample = data.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(leaves * SAMPLED).toPandas()  # at most LEAVES * SAMPLED vectors
    tree = build(space.lift(np.unique(matrix(sample["v"].tolist(), dim), axis=0)), SAMPLED)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.iloc[at : at + 4096]
                v = matrix(part["v"].tolist(), dim)
                leaf, way = tree.walk(space.lift(v))
                last = way[np.arange(len(v)), (~np.isnan(way)).sum(1) - 1] if len(v) else np.zeros(0)
                yield pd.DataFrame({"leaf": leaf.astype("int32"), "far": last, "way": [w[~np.isnan(w)] for w in way], "vec_id": part["vec_id"].to_numpy(), "label": part["label"].to_numpy(), "v": [x.tobytes() for x in v.astype(kind)]})

    placed = cut(data.mapInPandas(place, "leaf int, far double, way array<double>, vec_id long, label long, v binary"))
    ends = [f(F.get("way", F.lit(k))).alias(f"{n}{k}") for k in range(tree.depth) for f, n in ((F.min, "a"), (F.max, "b"))]
    stats = placed.groupBy("leaf").agg(F.count("*").alias("n"), *ends).toPandas()  # at most LEAVES rows
    size = np.zeros(tree.leaves, np.int64)
    least, most = np.zeros((tree.leaves, tree.depth)), np.zeros((tree.leaves, tree.depth))
    size[stats["leaf"]] = stats["n"]
    for k in range(tree.depth):
        least[stats["leaf"], k], most[stats["leaf"], k] = stats[f"a{k}"].fillna(0), stats[f"b{k}"].fillna(0)

    def paged(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["far", "vec_id"])
        return pd.DataFrame({"leaf": [b["leaf"].iloc[0]], "ids": [b["vec_id"].to_numpy(np.int64).tobytes()], "labels": [b["label"].to_numpy(np.int64).tobytes()], "fars": [b["far"].to_numpy(np.float64).tobytes()], "vecs": [b"".join(b["v"])]})

    parts = F.array(*[F.lit(int(max(1, -(-s // PAGE)))) for s in size])
    dealt = placed.drop("way").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.element_at(parts, F.col("leaf") + 1)).cast("int"))
    pages = cut(dealt.groupBy("leaf", "part").applyInPandas(paged, "leaf int, ids binary, labels binary, fars binary, vecs binary"))
    return Index(tree, space, size, least, most, dim, kind), pages


def nearest(index: Index, pages: DataFrame, searches: DataFrame, k: int) -> DataFrame:
    """anchor_id, slot, vec_id, score, rank: the k highest scores of each search.

    searches: anchor_id, slot, v (binary), label, same (whether rows of the label or
    all others are sought), low and high (whole scores, null: no end), one row a search."""
    spark = searches.sparkSession
    keys = ["anchor_id", "slot"]
    tree, size, slack = index.tree, index.size, index.slack
    few = max(1, min(200, searches.count() // 64 + 1))

    def visits(width: int):
        """The next `width` leaves of each search, of those that can still better it."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            anchor, told = None, None
            for b in batches:
                out = []
                for r in b.itertuples(index=False):
                    q = np.frombuffer(r.v, index.kind).astype(np.float64)
                    if anchor != (r.anchor_id, r.v):
                        anchor, told = (r.anchor_id, r.v), index.bounds(q)
                    low, high, far = told
                    inner = 0.0 if pd.isna(r.high) else float(index.distance(q, r.high))
                    outer = np.inf if pd.isna(r.low) else float(index.distance(q, r.low))
                    open_to = np.flatnonzero((size > 0) & (low <= outer + slack) & (high >= inner - slack))
                    open_to = open_to[np.lexsort((open_to, np.maximum(low[open_to], inner)))]
                    outer = outer if pd.isna(r.kth) else min(outer, float(index.distance(q, r.kth)))
                    for x in open_to[r.visited : r.visited + width].tolist():
                        if low[x] > outer + slack:
                            break  # the order is by this bound, so the rest is out as well
                        out.append((x, r.anchor_id, r.slot, r.v, r.label, r.same, r.low, r.high, far[x], inner, outer))
                yield pd.DataFrame(out, columns=["leaf", "anchor_id", "slot", "v", "label", "same", "low", "high", "far", "inner", "outer"]).astype({"low": "Int64", "high": "Int64"})

        return run

    def together(b: pd.DataFrame) -> pd.DataFrame:
        n = lambda c, t: [b[c].to_numpy(t).tobytes()]
        ends = {c: [b[c].fillna(none).to_numpy(np.int64).tobytes()] for c, none in (("low", -(2**62)), ("high", 2**62))}
        return pd.DataFrame({"leaf": [b["leaf"].iloc[0]], "q_ids": n("anchor_id", np.int64), "slots": n("slot", np.int32), "q_labels": n("label", np.int64), "same": n("same", np.bool_), **ends, "q_fars": n("far", np.float64), "inners": n("inner", np.float64), "outers": n("outer", np.float64), "qs": [b"".join(b["v"])]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, labels, fars = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), np.frombuffer(r.fars)
                vecs = np.frombuffer(r.vecs, index.kind).reshape(len(ids), index.dim).astype(np.float64)
                q_ids, slots, q_labels, same = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.slots, np.int32), np.frombuffer(r.q_labels, np.int64), np.frombuffer(r.same, np.bool_)
                lows, highs = np.frombuffer(r.low, np.int64), np.frombuffer(r.high, np.int64)
                q_fars, inners, outers = (np.frombuffer(x) for x in (r.q_fars, r.inners, r.outers))
                qs = np.frombuffer(r.qs, index.kind).reshape(len(q_ids), index.dim).astype(np.float64)
                one, of = np.unique(q_ids, return_inverse=True)
                first = np.zeros(len(one), np.int64)
                first[of[::-1]] = np.arange(len(q_ids))[::-1]
                from_ = np.searchsorted(fars, np.maximum(q_fars - outers, inners - q_fars) - slack, "left")
                to = np.searchsorted(fars, q_fars + outers + slack, "right")
                found = []
                for a, at in enumerate(first.tolist()):
                    mine = np.flatnonzero(of == a)
                    lo, hi = int(from_[mine].min()), int(to[mine].max())
                    if lo >= hi:
                        continue
                    scores, who, label = index.space.scores(vecs[lo:hi], qs[at]), ids[lo:hi], labels[lo:hi]
                    own = (label == q_labels[at]) & (who != one[a])
                    others = (label != q_labels[at]) & (who != one[a])
                    for i in mine.tolist():
                        fit = np.flatnonzero((own if same[i] else others) & (scores >= lows[i]) & (scores <= highs[i]))
                        if len(fit) > 4 * k:
                            s = scores[fit]
                            fit = fit[s >= np.partition(s, len(s) - k)[len(s) - k]]
                        best = fit[np.lexsort((who[fit], -scores[fit]))[:k]]
                        found.append((np.full(len(best), one[a]), np.full(len(best), slots[i], np.int32), who[best], scores[best]))
                if found:
                    a, s, w, x = map(np.concatenate, zip(*found))
                    yield pd.DataFrame({"anchor_id": a, "slot": s, "vec_id": w, "score": x})

    visit = "leaf int, anchor_id long, slot int, v binary, label long, same boolean, low long, high long, far double, inner double, outer double"
    asked_as = "leaf int, q_ids binary, slots binary, q_labels binary, same binary, low binary, high binary, q_fars binary, inners binary, outers binary, qs binary"
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    top = spark.createDataFrame([], FOUND + ", rank int")
    open_ = searches.withColumn("visited", F.lit(0)).withColumn("kth", F.lit(None).cast("long"))
    blocks = int(max(1, -(-searches.select("anchor_id").distinct().count() // BLOCK)))
    width = FIRST
    while True:
        now = cut(open_.repartition(few, "anchor_id").sortWithinPartitions("anchor_id").mapInPandas(visits(width), visit))
        if now.isEmpty():
            return top
        block = now.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))
        asked = block.groupBy("leaf", "block").applyInPandas(together, asked_as)
        met = pages.join(asked, "leaf").mapInPandas(scan, FOUND)
        top = cut(top.drop("rank").unionByName(met).withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}"))
        kth = top.where(f"rank = {k}").select(*keys, F.col("score").alias("kth"))
        open_ = open_.drop("kth").join(now.select(*keys).distinct(), keys, "left_semi").join(kth, keys, "left").withColumn("visited", F.col("visited") + width)
        open_ = cut(open_)
        width *= FANOUT


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score,
    positive_rank: for each row whose id is divisible by `every`, each of its first
    `positives` rows of the same label, and the first `negatives` rows of other labels with
    share/100 * positive_score <= negative_score <= positive_score."""
    spark = vectors.sparkSession
    data = labelled(vectors, id_col, vec_col, label_col)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"
    held = indexed(data)
    if held is None:
        return spark.createDataFrame([], schema)
    index, pages = held

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = matrix(b["v"].tolist(), index.dim).astype(index.kind)
            yield pd.DataFrame({"anchor_id": b["vec_id"], "label": b["label"], "v": [x.tobytes() for x in v]})

    least = data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("a")).select("vec_id", "a.v", "a.label")
    anchors = cut(least.mapInPandas(packed, "anchor_id long, label long, v binary"))
    none = F.lit(None).cast("long")
    own = nearest(index, pages, anchors.withColumns({"slot": F.lit(0), "same": F.lit(True), "low": none, "high": none}), positives)
    own = cut(own.select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    spared = f"positive_score * {100 - share}"
    low = F.expr(f"positive_score - ({spared} - pmod({spared}, 100)) div 100")  # the least whole score of the window
    windows = anchors.join(own, "anchor_id").select("anchor_id", "slot", "v", "label", F.lit(False).alias("same"), low.alias("low"), F.col("positive_score").alias("high")).where("low <= high")
    hard = nearest(index, pages, cut(windows), negatives)
    return own.join(hard, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("slot").alias("positive_rank"))


#: The query by comparing each anchor with every row.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS own, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negative AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS n
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.own AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, n::INTEGER AS rank, negative_id, positive_score, negative_score FROM negative WHERE n <= 5
"""
