"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's bits are cut into segments; the counts of set bits per segment
embed it as a point, and the Manhattan distance of two points is a lower bound of
their Hamming distance. Points are joined on the grid of that embedding and each
candidate is verified on the whole fingerprints.

For a Hamming radius of 3 the dimensions form two halves. Of two fingerprints
within 3 bits one half is at Manhattan distance 1 or less, so each point stands
in the cell of each of its halves and also probes the cells one step up in one
dimension (a step down is the other point's step up). The join is exact.

Cells are joined as sorted runs inside a task, and a run gives a spanning forest
of its links, at most one row per member, so a large group of copies never turns
into all its pairs. Runs over RUN members are not held: they go to a second pass
that deals them out in blocks, each pair of blocks its own run. Fingerprints are
made distinct before the join and components are found over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.tables import hinted, portions
from factloom.operators.graph import connected_components
from factloom.session import cut

RADIUS = 3
SEED = 42
#: Members of a cell that one task compares directly.
RUN = 30_000
#: Members of a run up to which all its pairs are compared in one vectorised pass.
SMALL = 128


def shingle_hashes(text: str | None, k: int) -> bytes:
    """XXH64 of each k-word shingle (big-endian, joined): A-Z lowered, words between
    ASCII white space, repeats included; fewer than k words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return b""
    if len(words) < k:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    return b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(words[i:] for i in range(k)))), repeat(SEED)))


def majority(bits: np.ndarray) -> np.ndarray:
    """Columns of a 0/1 matrix (uint8) that are 1 in over half the rows."""
    n = len(bits)
    whole = n // 255 * 255
    total = bits[whole:].sum(0, dtype=np.int64)
    for at in range(0, whole, 255 * 4096):
        part = bits[at : min(whole, at + 255 * 4096)]
        total += part.reshape(-1, 255, part.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return 2 * total > n


def fingerprint(text: str | None, k: int) -> int:
    """64 bits as a signed number; zero without words."""
    return majority_bits(shingle_hashes(text, k))


def majority_bits(raw: bytes) -> int:
    """The fingerprint of joined shingle hashes."""
    if not raw:
        return 0
    step, total, n = 8 * 1_000_000, np.zeros(64, np.int64), len(raw) // 8
    if n <= 1_000_000:
        on = majority(np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64))
    else:  # a very long text: in parts
        for at in range(0, len(raw), step):
            total += np.unpackbits(np.frombuffer(raw[at : at + step], np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        on = 2 * total > n
    return int.from_bytes(np.packbits(on).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, k) for part in portions(batch, 1) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- the grid ---------------------------------------------------------------


def half_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, role, which fingerprint) of 64-bit fingerprints: 32 segments of two
    bits, two halves of 16 counts; role 0 stands in the cell, role 1 probes it."""
    bits = np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
    counts = bits.reshape(-1, 32, 2).sum(2, dtype=np.int64)
    weight = np.int64(1) << np.arange(0, 32, 2, dtype=np.int64)
    cells, roles, whose = [], [], []
    every = np.arange(len(fps))
    for half in (0, 1):
        c = counts[:, 16 * half : 16 * half + 16]
        home = c @ weight | np.int64(half) << 32
        i, dim = np.nonzero(c < 2)
        cells += [home, home[i] + weight[dim]]
        roles += [np.zeros(len(fps), np.int8), np.ones(len(i), np.int8)]
        whose += [every, i]
    return np.concatenate(cells), np.concatenate(roles), np.concatenate(whose)


def near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Rows of two uint64 matrices within `most` differing bits."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32) <= most


def small_run_links(start: np.ndarray, size: np.ndarray, homes: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many short runs: every home against all members after it."""
    first = np.repeat(start, homes) + _within(homes)
    partners = np.repeat(start + size, homes) - first - 1
    left, right = [], []
    ends = np.cumsum(partners)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")))
        n = partners[at:to]
        i = np.repeat(first[at:to], n)
        j = i + 1 + _within(n)
        ok = near(fp[i], fp[j], most)
        left.append(i[ok])
        right.append(j[ok])
        at = to
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _within(n: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def large_run_links(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one run, found breadth first: a member is
    compared with the members not reached yet only."""
    rest, left, right = np.arange(len(fp)), [], []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = near(fp[rest], fp[x], most)
            if hit.any():
                found = rest[hit]
                left.append(np.full(len(found), x))
                right.append(found)
                todo += found.tolist()
                rest = rest[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def stars(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its component) for the members that have a smaller one."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    who = np.flatnonzero(label != np.arange(n))
    return who, label[who]


def link_runs(most: int, words: int, limit: int = RUN):
    """mapInArrow function over rows (cell, part, role, id, fp binary) sorted by the
    first three: rows (a, b, cell, fp): ids in one component, or, with a null b,
    the members of a run over `limit`, to be dealt out in blocks."""

    def out(a, b, cell=None, fp=None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(n, pa.int64()), pa.array(cell, pa.int64()) if cell is not None else pa.nulls(n, pa.int64()), pa.array(fp, pa.binary()) if fp is not None else pa.nulls(n, pa.binary())],
            names=["a", "b", "cell", "fp"],
        )

    def runs(cell, part, role, ids, fp):
        """Links of complete runs, as (a, b) ids."""
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[starts, len(cell)])
        homes = np.add.reduceat((role == 0).astype(np.int64), starts)
        use = (homes > 0) & (size > 1)
        small = use & (size <= SMALL)
        i, j = small_run_links(starts[small], size[small], homes[small], fp, most)
        found = [stars(i, j, len(cell))] if len(i) else []
        for s, n in zip(starts[use & ~small], size[use & ~small]):
            i, j = large_run_links(fp[s : s + n], most)
            if len(i):
                a, b = stars(i, j, n)
                found.append((a + s, b + s))
        if not found:
            return None
        pairs = np.concatenate([np.stack([ids[a], ids[b]], 1) for a, b in found])
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return np.unique(pairs, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        over = None  # the (cell, part) of a run over the limit that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, role, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            flat = batch.column(4)
            fp = np.frombuffer(b"".join(flat.to_pylist()), np.uint64).reshape(-1, words)
            now = (cell, part, role, ids, fp)
            if over is not None:
                n = int(np.searchsorted((cell != over[0]) | (part != over[1]), True))
                n = len(cell) if not ((cell != over[0]) | (part != over[1])).any() else n
                if n:
                    yield out(ids[:n], None, cell[:n], [x.tobytes() for x in fp[:n]])
                    now = tuple(x[n:] for x in now)
                if not len(now[0]):
                    continue
                over = None
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            cell, part = now[0], now[1]
            last = int(np.flatnonzero((cell != cell[-1]) | (part != part[-1]))[-1]) + 1 if ((cell != cell[-1]) | (part != part[-1])).any() else 0
            if last:
                pairs = runs(*(x[:last] for x in now))
                if pairs is not None:
                    yield out(pairs[:, 0], pairs[:, 1])
            held = tuple(x[last:] for x in now)
            if len(held[0]) > limit:
                over = (held[0][0], held[1][0])
                yield out(held[3], None, held[0], [x.tobytes() for x in held[4]])
                held = None
        if held is not None and len(held[0]):
            pairs = runs(*held)
            if pairs is not None:
                yield out(pairs[:, 0], pairs[:, 1])

    return run


LINKS = "a long, b long, cell long, fp binary"


def grid_links(points: DataFrame, most: int, words: int, limit: int = RUN) -> DataFrame:
    """(a, b): ids tied by links within `most` bits, from rows (cell, part, role, id,
    fp). A spanning forest of each cell, not all its pairs."""

    def swept(rows: DataFrame, bound: int) -> DataFrame:
        return rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "role").mapInArrow(link_runs(most, words, bound), LINKS)

    first = cut(swept(points.select("cell", "part", "role", "id", "fp"), limit))
    over = first.where("b is null")
    links = first.where("b is not null").select("a", "b")
    if over.isEmpty():
        return links
    # runs too long for one task: members by hash into blocks of half the limit, and a run for each pair of blocks
    counts = over.groupBy("cell").agg(F.count("*").alias("n"))
    dealt = over.join(counts, "cell").select(
        "cell", F.col("a").alias("id"), "fp", F.ceil(F.col("n") / F.lit(limit // 3)).cast("int").alias("nb")
    ).withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = dealt.select("cell", (low * F.col("nb") + high).cast("int").alias("part"), F.lit(0).cast("byte").alias("role"), "id", "fp")
    return links.unionByName(cut(swept(rows, 1 << 60)).where("b is not null").select("a", "b"))


def near_components(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row: fingerprints of
    k-word shingles, linked at RADIUS or fewer differing bits; component_id is the
    smallest doc_id reachable.

    A null or empty text has fingerprint zero and is linked like any other. Equal
    rows stay apart and share a component. A row with a null doc_id keeps it and
    takes no part in the smallest id (null if all of a component's are null). An
    empty table gives no rows. Other columns are not read.
    """
    base = cut(fingerprints(docs, k, id_col, text_col))
    distinct = cut(base.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    tied = connected_components(fingerprint_links(distinct))
    rooted = distinct.join(tied.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return base.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): fingerprints (fp, each once) tied by links at RADIUS or fewer differing bits."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 20_000):
                some = fps[at : at + 20_000]
                if len(some):
                    cell, role, i = half_cells(some)
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(i), [None, pa.py_buffer(np.ascontiguousarray(some[i]).tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.zeros(len(i), np.int32)), pa.array(role), pa.array(some[i]), raw], names=["cell", "part", "role", "id", "fp"])

    points = distinct.select("fp").mapInArrow(cells, "cell long, part int, role byte, id long, fp binary")
    return grid_links(points, RADIUS, 1)


# --- near copies at a shingle similarity ------------------------------------

K, SIMILAR = 5, 0.8
#: Rows of three longs at most (about 40 MB) that are sent to the tasks that read texts or keys.
SENT = 1_000_000
#: Segments of the hash space in which a set's members are counted.
SEGMENTS = 256
#: Documents whose shingles are counted to put common ones last, and the common ones kept.
SAMPLE, COMMON = 4000, 200_000


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return _distinct(shingle_hashes(text, k))


def _distinct(raw: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(raw, ">u8").astype(np.int64))


def set_id(s: np.ndarray) -> int:
    """A hash of the whole set; equal sets have equal ids."""
    return int.from_bytes(xxhash.xxh64_digest(s.tobytes(), SEED), "big", signed=True)


def segment_counts(s: np.ndarray) -> bytes:
    """Members of the set in each segment of the hash space, 255 at most. The Manhattan
    distance of two sets' counts is a lower bound of their symmetric difference."""
    return np.minimum(np.bincount(s.view(np.uint64) >> np.uint64(56), minlength=SEGMENTS), 255).astype(np.uint8).tobytes()


def least_shared(n: int, similar: float) -> int:
    """Members that a set of n shares at least with any set at this similarity."""
    return int(np.ceil(similar * n - 1e-9))


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles seen in three or more of some documents, commonest last. They decide
    the order of members alone; any order gives the same groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = [shingle_set(t, k) for t in batch.column(0).slice(at, 200).to_pylist()]
                key, n = np.unique(np.concatenate(some), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    some = docs.select("text").sample(min(1.0, SAMPLE / max(1, docs.count())), seed=SEED)
    told = some.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 3")
    return told.orderBy(F.desc("n"), "key").limit(COMMON).toPandas()["key"].to_numpy(np.int64)[::-1]


def near_groups(docs: DataFrame, k: int = K, similar: float = SIMILAR, limit: int = SENT, carried: bool = False) -> DataFrame:
    """doc_id, component_id per row: documents whose sets of k-word shingles have a
    Jaccard similarity of `similar` or more, and groups of these.

    First the texts' SimHash fingerprints are linked on the segment-popcount grid, and
    what a link ties is verified on the whole sets: fingerprints within RADIUS bits find
    copies with few changes. At a similarity of 0.8 they may differ in ten bits or more,
    so candidates among what is not tied yet are completed: sets of this similarity share
    so many members that, in any one order of all shingles, they share one of the first
    n - least_shared(n) + 1 of each. The order puts common shingles last. A candidate whose segment counts differ
    by more than two sets of this similarity can is refused; each other pair that ties
    two documents is verified on their whole sets. So that a crowd of near copies does not become all its
    pairs, holders of a shingle are first compared with its least and its greatest holder,
    and other pairs only if they are in no common group by then. Up to `limit` keys are
    broadcast. carried: with text_hash (xxhash64 of the text). Edge cases are those of
    near_components.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("text_hash", F.xxhash64("text"))
    common = common_shingles(d, k)
    order = np.argsort(common)
    sent = d.sparkSession.sparkContext.broadcast((common[order], order + 1))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, n, fps, counts, keys = [], [], [], [], []
                for t in (t for part in portions(batch.slice(at, 500), 1) for t in part.column(1).to_pylist()):
                    raw = shingle_hashes(t, k)
                    s = _distinct(raw)
                    ids.append(set_id(s))
                    n.append(len(s))
                    fps.append(majority_bits(raw))
                    counts.append(segment_counts(s))
                    first = len(s) - least_shared(len(s), similar) + 1
                    if len(known) and len(s):
                        i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        s = s[np.argsort(np.where(known[i] == s, rank[i], 0), kind="stable")]
                    keys.append(s[:first])
                offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), batch.column(2).slice(at, 500), pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(fps, pa.int64()), pa.array(counts, pa.binary()), lists], names=["doc_id", "text_hash", "id", "n", "fp", "counts", "keys"])

    base = cut(d.mapInArrow(prints, "doc_id long, text_hash long, id long, n int, fp long, counts binary, keys array<long>"))
    by_print = _linked_prints(base)
    links = _similar_sets(by_print, base, d, k, similar)
    tied = cut(connected_components(links))
    # one row of each set: the others of sets that come again are told by their place
    placed = base.select("id", "n", "keys", F.monotonically_increasing_id().alias("row"))
    again = placed.groupBy("id").agg(F.min("row").alias("first"), F.count("*").alias("times")).where("times > 1").select("id", "first")
    once = placed.join(hinted(cut(again), limit), "id", "left").where("first is null or row = first")
    rows = once.select("id", "n", F.explode("keys").alias("key"))
    # a key's holders meet in one shuffle: its least and greatest are told by a window beside them
    key = Window.partitionBy("key")
    held = rows.select("key", "id", "n", F.min("id").over(key).alias("low"), F.max("id").over(key).alias("high"))
    held = cut(held.where("low < high"))
    star = held.select("id", F.explode(F.array("low", "high")).alias("end")).where("id <> end").select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct()
    of = lambda e: hinted(tied.select(F.col("node").alias(e), F.col("root").alias(f"root_{e}")), limit)
    apart = F.col("root_a").isNull() | F.col("root_b").isNull() | (F.col("root_a") != F.col("root_b"))
    star = cut(star.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).select("a", "b").join(by_print, ["a", "b"], "left_anti"))
    links = links.unionByName(_similar_sets(star, base, d, k, similar))
    group = connected_components(links)
    rooted = held.join(hinted(group.select(F.col("node").alias("id"), "root")), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    rooted = cut(rooted.join(hinted(cut(several)), "key"))
    x, y = rooted.alias("x"), rooted.alias("y")
    fits = F.least("x.n", "y.n") >= similar * F.greatest("x.n", "y.n") - 1e-9
    rest = x.join(y, "key").where((F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & fits)
    rest = cut(rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(star.unionByName(by_print), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        group = connected_components(links.unionByName(_similar_sets(rest, base, d, k, similar)))
    distinct = base.groupBy("id").agg(F.min("doc_id").alias("least_id"))
    rooted = cut(distinct.join(group.select(F.col("node").alias("id"), "root"), "id", "left").select("id", "least_id", F.coalesce("root", "id").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.join(ids, "root").select("id", "component_id")
    return base.join(classes, "id").select("doc_id", *(["text_hash"] if carried else []), "component_id")


def _linked_prints(base: DataFrame) -> DataFrame:
    """(a, b of set ids, a < b) tied by SimHash: sets of one fingerprint by its least set, and
    the least sets of linked fingerprints."""
    sets = cut(base.select("id", "fp").distinct())
    least = cut(sets.groupBy("fp").agg(F.min("id").alias("low")))
    same = sets.join(least, "fp").select(F.col("id").alias("x"), F.col("low").alias("y"))
    of = lambda e: least.select(F.col("fp").alias(e), F.col("low").alias(f"low_{e}"))
    near_ = fingerprint_links(least).join(of("a"), "a").join(of("b"), "b").select(F.col("low_a").alias("x"), F.col("low_b").alias("y"))
    return cut(same.unionByName(near_).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _similar_sets(pairs: DataFrame, base: DataFrame, docs: DataFrame, k: int, similar: float) -> DataFrame:
    """Of the pairs (a, b of set ids) those whose whole sets have the similarity. Sets
    are made again from the documents of these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                sets = [shingle_set(t, k) for t in batch.column(0).slice(at, 200).to_pylist()]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                # half of each hash: two of a pair's shingles are taken for one in 2^32 cases
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), lists], names=["id", "members"])

    def may_be_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                n = some.column(2).to_numpy().astype(np.int64) + some.column(3).to_numpy()
                x, y = (np.frombuffer(b"".join(some.column(i).to_pylist()), np.uint8).reshape(-1, SEGMENTS).astype(np.int16) for i in (4, 5))
                far = np.abs(x - y).sum(1, dtype=np.int64)
                # sets that share s of n members in all differ in n - 2 s, and s is similar / (1 + similar) n at least
                ok = far <= n * (1 - similar) / (1 + similar) + 1e-6
                yield some.filter(pa.array(ok)).select([0, 1, 2, 3])

    sizes = base.select("id", "n", "counts").dropDuplicates(["id"])
    of = lambda e: sizes.select(F.col("id").alias(e), F.col("n").alias(f"n_{e}"), F.col("counts").alias(f"c_{e}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "c_a", "c_b")
    sized = sized.where(F.least("n_a", "n_b") >= similar * F.greatest("n_a", "n_b") - 1e-9)
    sized = cut(sized.mapInArrow(may_be_near, "a long, b long, n_a int, n_b int"))
    ends = hinted(cut(sized.select(F.explode(F.array("a", "b")).alias("id")).distinct()), SENT)
    at = hinted(cut(base.join(ends, "id").groupBy("id").agg(F.min("doc_id").alias("__at")).select("__at").distinct()), SENT)
    there = docs.join(at, docs["doc_id"].eqNullSafe(at["__at"]), "left_semi").select("text")
    sets = cut(there.mapInArrow(run, "id long, members array<int>").join(ends, "id", "left_semi").dropDuplicates(["id"]))
    both = sized.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.where(common >= similar * (F.col("n_a") + F.col("n_b") - common) - 1e-9).select("a", "b"))


def without_near_copies(docs: DataFrame, k: int = K, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs with the least doc_id of their group, all their columns.

    Rows that share a doc_id stay or go by their own texts: a row goes if its group has a
    lesser doc_id, or a row of the same doc_id and text comes before it. Rows with a null doc_id all stay.
    """
    groups = near_groups(docs, k, similar, carried=True)
    gone = groups.where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.max(F.col("doc_id") > F.col("component_id")).alias("gone"), F.count("*").alias("n"))
    gone = hinted(cut(gone.where("gone or n > 1").select(F.struct("*").alias("told"))))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    of = F.col("doc").getField
    same = (of("doc_id").cast("long") == F.col("told.doc_id")) & (F.xxhash64(of("text").cast("string")) == F.col("told.text_hash"))
    both = rows.join(gone, same, "left")
    alone = both.where("told is null")
    again = both.where("told is not null and not told.gone").groupBy("told.doc_id", "told.text_hash").agg(F.first("doc").alias("doc")).select("doc")
    return alone.select("doc").unionByName(again).select(*[of(c).alias(c) for c in docs.columns])
