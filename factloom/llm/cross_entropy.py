"""LM scoring by cross-entropy difference.

Two models of equal make, the target's from documents labelled good, the background's
from all documents, share one vocabulary, every word of the corpus, and give every token
a loss; a document's score is the mean of target loss minus background loss. Low scores
read like the target.

Tokens are words between ASCII white space, A-Z lowered. A model mixes word counts with a
spelling model, by as much as it has seen new words (Witten-Bell): p(w) = (c(w) + T s(w)) /
(N + T) with N tokens and T kinds of words. s is a byte bigram model of the kinds, each word
after and before a space, interpolated in the same way with single bytes and those with one
added to every count. So a word the target never has costs its spelling.

The models are matched: the background's counts are those expected in as many tokens, drawn
from it at random, as the target has; nothing is drawn.

The vocabulary and its counts are a table that grows with the corpus and is joined with the
words of each document. Words that are a FREQUENT-th of all tokens or more, at most FREQUENT,
are sent to the tasks and added up there, so the join has no such hot key, and each
document's words are counted before they are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import hinted, portions
from factloom.session import cut

#: Words sent to every task at most, each of LONGEST bytes at most (about 10 MB).
FREQUENT, LONGEST = 50_000, 64
#: Kinds of words, and bytes of text, after which a task passes on its counts.
KINDS, HELD = 200_000, 32_000_000
BYTES = 256


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), target, background: counts over the whole texts of docs (text, is_target)."""

    def told(every: Counter, good: Counter) -> pa.RecordBatch:
        kinds = list(every)
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.binary()), pa.array([good[w] for w in kinds], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["word", "target", "background"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, good, held = Counter(), Counter(), 0
        for batch in batches:
            for part in portions(batch, 0):
                for text, is_target in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    some = words(text)
                    every.update(some)
                    if is_target:
                        good.update(some)
                    held += len(text or "")
                    if len(every) > KINDS or held > HELD:
                        yield told(every, good)
                        every, good, held = Counter(), Counter(), 0
        yield told(every, good)

    part = docs.select("text", "is_target").mapInArrow(run, "word binary, target long, background long")
    return part.groupBy("word").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def spelled(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, byte bigrams of their words one after the other, where each word's begin)."""
    for part in portions(batch, 0):
        some = part.column(0).to_pylist()
        b = np.frombuffer(b" " + b"".join(w + b" " for w in some), np.uint8).astype(np.int64)
        n = np.fromiter(map(len, some), np.int64, len(some)) + 1
        yield part, b[:-1] * BYTES + b[1:], np.cumsum(n) - n


def spelling_counts(table: DataFrame) -> np.ndarray:
    """Byte bigrams (2, 65,536) of the kinds of words with a count in each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BYTES * BYTES), np.int64)
        for batch in batches:
            for part, grams, first in spelled(batch):
                n = np.diff(np.r_[first, len(grams)])
                for i in (0, 1):
                    seen = np.repeat(part.column(1 + i).to_numpy() > 0, n)
                    total[i] += np.bincount(grams[seen], minlength=BYTES * BYTES)
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["gram", "t", "b"])

    rows = table.mapInArrow(run, "gram long, t long, b long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toPandas()  # at most 65,536 rows
    out = np.zeros((2, BYTES * BYTES), np.int64)
    out[0, rows["gram"]], out[1, rows["gram"]] = rows["t"], rows["b"]
    return out


def spelling_bits(counts: np.ndarray) -> np.ndarray:
    """-log2 p of each bigram's last byte, from bigram counts."""
    c = counts.reshape(BYTES, BYTES).astype(np.float64)
    one = c.sum(0)
    p = (one + 1) / (one.sum() + BYTES)
    n, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
    return -np.log2(np.where(n > 0, (c + kinds * p) / np.maximum(n + kinds, 1), p)).reshape(-1)


def word_losses(table: DataFrame) -> tuple[DataFrame, int]:
    """(word, target_loss, background_loss, background) of each word, in bits, from
    word_counts, and the number of tokens."""
    t, b, kinds = table.agg(F.sum("target"), F.sum("background"), F.count_if(F.col("target") > 0)).first()
    t, b = t or 0, b or 0
    share = t / b if t else 1.0  # without a target there is nothing to match
    # kinds of words expected among the tokens drawn
    drawn = table.agg(F.sum(1 - F.pow(F.lit(1 - share), F.col("background")))).first()[0] or 0.0
    sizes = ((1.0, float(t), float(kinds)), (share, float(b) * share, float(drawn)))
    sent = table.sparkSession.sparkContext.broadcast([spelling_bits(c) for c in spelling_counts(table)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, grams, first in spelled(batch) if batch.num_rows else ():
                losses = []
                for i, (scale, n, new) in enumerate(sizes):
                    bits = np.add.reduceat(sent.value[i][grams], first)
                    if n + new:
                        with np.errstate(divide="ignore"):
                            seen, unseen = np.log2(part.column(1 + i).to_numpy() * scale), np.log2(new) - bits
                        bits = np.log2(n + new) - np.logaddexp2(seen, unseen)
                    losses.append(pa.array(bits))
                yield pa.RecordBatch.from_arrays([part.column(0), *losses, part.column(2)], names=["word", "target_loss", "background_loss", "background"])

    return cut(table.mapInArrow(run, "word binary, target_loss double, background_loss double, background long")), b


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (bits a token), difference per
    row of docs; the target are rows labelled quality 1 and toxic 0.

    A null or empty text has no tokens and zero losses. Labels that are null, or of
    other documents, are passed over; an id labelled more than once counts as target
    if one label makes it so. A null id is never labelled. Without labels the target
    model is uniform over bytes. Equal rows are counted and scored one by one; an empty
    table gives no rows. Other columns are not read. Losses are rounded to nine decimals.
    docs should come from a file or table: a task run again must find the same rows.
    """
    good = hinted(labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct().withColumn("is_target", F.lit(True)))
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    table, n_tokens = word_losses(cut(word_counts(d.join(good, "doc_id", "left"))))
    often = table.where((F.col("background") * frequent >= n_tokens) & (F.octet_length("word") <= LONGEST))
    # at most `frequent` rows: their shares add up to one
    sent = d.sparkSession.sparkContext.broadcast({bytes(r.word): (r.target_loss, r.background_loss) for r in often.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value

        def rows(part: pa.RecordBatch) -> pa.RecordBatch:
            row, ids, word, n, t, b = [], [], [], [], [], []
            for i, doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                total = at = ab = 0
                for w, times in Counter(words(text)).items():
                    total += times
                    loss = known.get(w)
                    if loss is None:
                        row.append(i), ids.append(None), word.append(w), n.append(times), t.append(0.0), b.append(0.0)
                    else:
                        at += times * loss[0]
                        ab += times * loss[1]
                # the document's own row: a key that no word has
                row.append(i), ids.append(doc_id), word.append(b" %d" % i), n.append(total), t.append(at), b.append(ab)
            return pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(ids, pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int64()), pa.array(t, pa.float64()), pa.array(b, pa.float64())],
                names=["row", "doc_id", "word", "n", "t", "b"],
            )

        for batch in batches:
            for part in portions(batch, 2):
                yield rows(part)

    numbered = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    told = numbered.mapInArrow(run, "row long, doc_id long, word binary, n long, t double, b double")
    losses = hinted(table.where((F.col("background") * frequent < n_tokens) | (F.octet_length("word") > LONGEST)).select("word", "target_loss", "background_loss"))
    own = F.col("target_loss").isNull()
    sums = (
        told.join(losses, "word", "left")
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("n_tokens"),
            F.sum(F.when(own, F.col("t")).otherwise(F.col("n") * F.col("target_loss"))).alias("t"),
            F.sum(F.when(own, F.col("b")).otherwise(F.col("n") * F.col("background_loss"))).alias("b"),
        )
    )
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")).otherwise(0.0)
    return sums.select(
        "doc_id",
        "n_tokens",
        F.round(mean("t"), 9).alias("target_loss"),
        F.round(mean("b"), 9).alias("background_loss"),
        F.round(mean("t") - mean("b"), 9).alias("difference"),
    )
