"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is 0 (toxic), 1 (poor) or 2 (good). With one
weight vector w shared by all grades and ordered thresholds t0 < t1,
P(grade <= j) = sigmoid(t_j - w.x). The expected grade and the tail probability
P(grade >= 2) come from it, and documents whose tail probability reaches KEEP are
selected.

x are hashed features of the whole text: each distinct word (letters, lowered)
and its first 4, 5 and 6 letters, present or not, and how large a share of the words has a shape (capitals, small
letters, digits, signs), in tenths, with four shares of the text (words like the one
before, distinct words, the commonest word, words of letters only).

Weights are fitted on at most SAMPLE labelled documents, those whose ids hash
lowest, with the features of their whole texts; a feature in fewer than MIN_DOCS
of them, or spread alike over the grades, carries no weight. Every document of the table is scored.
"""

from __future__ import annotations

import functools
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import portions

DIM = 1 << 18
SAMPLE = 12_000
MIN_DOCS = 4
SIGMA, LIFT = 5.0, 3.0
KEEP = 0.5
STEPS, RATE, RIDGE = 300, 0.2, 1e-4
#: Words held between texts of a worker, about 250 bytes each: 25 MB at most.
MEMORY = 100_000
#: Entries of the sample's features that are counted at once.
PART = 1_000_000

LETTERS = re.compile(r"[^\W\d_]+")
_shapes = (
    (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"),
    (re.compile(r"[^\W\d_X]+"), "x"),
    (re.compile(r"\d+"), "9"),
    (re.compile(r"([^\w\s])\1+"), r"\1\1"),
)
#: What is held of a word: its features (-1 for none) and the hash of its shape.
HELD = np.dtype([("f", "<i4", 4), ("shape", "<u8")])
_PACKED = struct.Struct("<4iQ")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_hash = xxhash.xxh64_intdigest
_memory: dict[str, bytes] = {}


def _shape(word: str) -> str:
    """The kinds of signs of a word's first 40, a run of a kind as one."""
    shape = word[:40]
    for find, put in _shapes:
        shape = find.sub(put, shape)
    return shape


def _features(word: str) -> bytes:
    """HELD of the word: features of it and its beginnings, hash of its shape. Small letters
    with or without a capital and one mark after them, which nearly all words are,
    need no expression."""
    body, mark = (word, "") if word[-1].isalnum() else (word[:-1], word[-1])
    if len(word) <= 40 and body.isalpha():
        w = body.lower()
        shape = "x" + mark if body.islower() else "Xx" + mark if body[1:].islower() and _CAPITAL.match(body) else _shape(word)
    else:
        core = LETTERS.search(word)
        w, shape = core.group().lower() if core else "", _shape(word)
    n = len(w)
    return _PACKED.pack(
        _hash("w " + w) % DIM if n else -1,
        _hash("p " + w[:4]) % DIM if n >= 4 else -1,
        _hash("p " + w[:5]) % DIM if n >= 5 else -1,
        _hash("p " + w[:6]) % DIM if n >= 6 else -1,
        _shape_hash(shape),
    )


@functools.lru_cache(1 << 12)
def _shape_hash(shape: str) -> int:
    return _hash("s " + shape)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct features of a text; none for an empty one."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32)
    counts = Counter(words)
    if len(_memory) > MEMORY:
        _memory.clear()
    raw = []
    for w in counts:
        got = _memory.get(w)
        if got is None:
            got = _features(w)
            if len(w) < 100:
                _memory[w] = got
        raw.append(got)
    held = np.frombuffer(b"".join(raw), HELD)
    n = len(words)
    each = np.fromiter(counts.values(), np.int64, len(counts))
    signs = {
        "again": sum(map(str.__eq__, words, words[1:])) / n,
        "kinds": len(counts) / n,
        "most": int(each.max()) / n,
        "plain": sum(map(str.isalpha, words)) / n,
    }
    long = min(9, int(np.log2(n)))
    told = [xxhash.xxh64_intdigest(f"r {name} {int(10 * x)} {long if name in ('kinds', 'most') else 0}") % DIM for name, x in signs.items()]
    shapes, of = np.unique(held["shape"], return_inverse=True)
    share = 1 + 10 * np.bincount(of, each).astype(np.int64) // n
    with np.errstate(over="ignore"):
        shaped = (shapes + np.uint64(0x9E3779B97F4A7C15) * share.astype(np.uint64)) % np.uint64(DIM)
    found = np.unique(np.concatenate([held["f"].ravel(), shaped.astype(np.int32), np.array(told, np.int32)]))
    return found[found >= 0]


def telling(idx: np.ndarray, grade: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Features whose share of documents differs between grades beyond chance: the
    difference of a grade's share and the others' is SIGMA standard errors or more,
    and one is LIFT times the other."""
    seen = np.zeros((3, DIM))
    for at in range(0, len(idx), PART):  # bincount makes wide copies: in parts
        part, of = idx[at : at + PART], grade[at : at + PART]
        for g in range(3):
            seen[g] += np.bincount(part[of == g], minlength=DIM)
    out = np.zeros(DIM, bool)
    for g in range(3):
        n, m = docs[g], docs.sum() - docs[g]
        if n and m:
            a, b = seen[g], seen.sum(0) - seen[g]
            p = (a + b) / (n + m)
            apart = np.abs(a / n - b / m) >= SIGMA * np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12) + 1e-12
            x, y = (a + 0.5) / (n + 1), (b + 0.5) / (m + 1)
            out |= apart & (np.maximum(x / y, y / x) >= LIFT)
    return out & (seen.sum(0) >= min(MIN_DOCS, docs.sum()))


def fit(idx: np.ndarray, size: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, the two thresholds) by Adam on the whole sample: the features of all
    its documents one after the other (int32), how many each has, and its grade.

    A sample without two grades gives zero weights and thresholds that select all."""
    w, n = np.zeros(DIM), len(grades)
    if len(set(grades.tolist())) < 2:
        return w, np.array([-20.0, -10.0])
    live = telling(idx, np.repeat(grades.astype(np.int8), size), np.bincount(grades, minlength=3))[idx]
    doc = np.repeat(np.arange(n, dtype=np.int32), size)[live]
    used, at = np.unique(idx[live], return_inverse=True)
    at = at.astype(np.int32)
    u, t0, gap = np.zeros(len(used)), -1.0, np.log(1.0)
    x = np.r_[u, t0, gap]
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for step in range(1, STEPS + 1):
        u, t0, t1 = x[:-2], x[-2], x[-2] + np.exp(x[-1])
        z = np.bincount(doc, u[at], n)
        c0, c1 = _sigmoid(t0 - z), _sigmoid(t1 - z)
        p = np.select([grades == 0, grades == 1], [c0, c1 - c0], 1 - c1)
        p = np.maximum(p, 1e-9)
        d0, d1 = c0 * (1 - c0), c1 * (1 - c1)
        g0 = np.select([grades == 0, grades == 1], [d0, -d0], 0.0) / p
        g1 = np.select([grades == 1, grades == 2], [d1, -d1], 0.0) / p
        # the loss is -log p: raising z lowers both cumulative probabilities
        gz = g0 + g1
        grad = np.r_[np.bincount(at, gz[doc], len(used)) / n + RIDGE * u, -(g0 + g1).mean(), -(g1 * np.exp(x[-1])).mean()]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w[used] = x[:-2]
    return w, np.array([x[-2], x[-2] + np.exp(x[-1])])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    grade = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    told = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long"), grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    some = F.broadcast(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 0):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([features(t).tobytes() for t in part.column(0).to_pylist()], pa.binary())], names=["grade", "f"])

    rows = docs.join(some, "doc_id").select("text", "grade").mapInArrow(run, "grade int, f binary").toArrow()
    order = np.argsort([xxhash.xxh64_intdigest(f.as_buffer()) for f in rows["f"]], kind="stable")  # the same sum whatever the order of rows
    rows = rows.take(pa.array(order)).combine_chunks()
    if not len(rows):
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    told, held = rows["f"].chunk(0), rows["grade"].to_numpy().astype(np.int64)
    ends = np.frombuffer(told.buffers()[1], np.int32, len(rows) + 1, 4 * told.offset).astype(np.int64)
    idx = np.frombuffer(told.buffers()[2], np.int32, int(ends[-1] - ends[0]) // 4, int(ends[0]))
    return fit(idx, np.diff(ends) // 4, held)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail_probability P(grade >= 2) per row.

    A null or empty text has no features and the score of the thresholds alone.
    Labels with a null id or quality are passed over, a null toxic counts as 0, an id
    labelled more than once has its lowest grade. Without labels of two grades all
    documents are selected. An empty table gives no rows. Other columns are not read.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    w, t = learn(d, labels, sample)
    schema = "doc_id long, expected_grade double, tail_probability double"
    return d.mapInArrow(_scores(w, t, 0, 1, lambda b, e, p: ([b.column(0), pa.array(e), pa.array(p)], ["doc_id", "expected_grade", "tail_probability"])), schema)


def _scores(w: np.ndarray, t: np.ndarray, id_at: int, text_at: int, make):
    w = w.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([w[features(text)].sum(dtype=np.float64) for part in portions(batch, text_at) for text in part.column(text_at).to_pylist()])
            c0, c1 = _sigmoid(t[0] - z), _sigmoid(t[1] - z)
            yield pa.RecordBatch.from_arrays(*make(batch, np.round((1 - c0) + (1 - c1), 9), np.round(1 - c1, 9)))

    return run


def selected(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all their columns, whose tail probability is keep or more."""
    w, t = learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, sample)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = []
            next(_scores(w, t, 0, at, lambda b, e, p: tails.append(p) or ([pa.array(p)], ["p"]))(iter([batch])))
            yield batch.filter(pa.array(tails[0] >= keep)).select(names)

    return docs.mapInArrow(run, docs.schema)
