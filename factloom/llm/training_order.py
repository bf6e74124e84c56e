"""Token-ID output in training order.

Documents are tokenised and cut into sequences of up to SEQUENCE ids (the end id
closes a document). The N sequences get numbers 0 .. N-1, and a keyed Feistel
network permutes the numbers: it works on the next power of four and, where an
output lies at N or beyond, is applied again (cycle walking) until it lies below N.
So every sequence has a slot of its own, and slots can be computed either way
without a table.

Slots are dealt out in ranges of SHARD, one file each, whose records have a fixed
stride: slot s lies in shard s // SHARD at byte (s % SHARD) * stride. A record is
doc_id (int64), start, length (int32) and SEQUENCE ids (uint16, padded with PAD). A
reader can start at any slot, and a shard is written under another name and then
renamed, so a task that runs again leaves whole files.

Two passes tokenise: the first counts each partition's sequences, from which numbers
follow; the second carries the ids, unpadded, through one shuffle by ranges of shards
(known beforehand, so nothing is sampled). A copy of the ids on disk would cost more
than tokenising again. The shards are listed in a table beside them, and the rows
returned are decoded from the files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.array_bpe import byte_tokenizer, ragged, within
from factloom.llm.tables import portions
from factloom.session import shared_dir

SEQUENCE = 256
SHARD = 4096
PAD = 0xFFFF
ROUNDS = 6
HEAD = np.dtype([("doc_id", "<i8"), ("start", "<i4"), ("length", "<i4")])
#: Closes a document; free in the vocabulary.
END = 50256


class Feistel:
    """A permutation of 0 .. n-1 under a key; numbers as numpy arrays."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, -(-(max(n, 2) - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "big")) for i in range(ROUNDS)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> np.uint64(self.half), x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            a, b = (b ^ self._mix(a, key), a) if back else (b, a ^ self._mix(b, key))
        return a << np.uint64(self.half) | b

    def _walk(self, numbers, back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = self._once(np.asarray(numbers, np.uint64), back)
            while (out := x >= self.n).any():
                x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slot(self, numbers) -> np.ndarray:
        return self._walk(numbers, False)

    def number(self, slots) -> np.ndarray:
        return self._walk(slots, True)


def record(sequence: int = SEQUENCE) -> np.dtype:
    """A null doc_id is 0, with -1 - start for the start."""
    return np.dtype([*HEAD.descr, ("ids", "<u2", (sequence,))])


def stride(sequence: int = SEQUENCE) -> int:
    return record(sequence).itemsize


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shard_name(folder: str, shard: int) -> str:
    return f"{folder.rstrip('/')}/shard-{shard:08d}.bin"


def _records(folder: str, shard: int, at: int, n: int, sequence: int) -> np.ndarray:
    system, path = _open(shard_name(folder, shard))
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_at(n * stride(sequence), at * stride(sequence)), record(sequence))


def _head(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which doc_ids are null, starts) of records."""
    none = r["start"] < 0
    return none, np.where(none, -1 - r["start"], r["start"])


def read_slots(folder: str, first: int, count: int, sequence: int = SEQUENCE, per_shard: int = SHARD) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """(doc_id, start, length, ids) of count slots from the first on; only the byte
    ranges that hold them are read."""
    slot, last = first, first + count
    while slot < last:
        shard, at = divmod(slot, per_shard)
        some = _records(folder, shard, at, min(last - slot, per_shard - at), sequence)
        for r, none, start in zip(some, *_head(some)):
            yield None if none else int(r["doc_id"]), int(start), int(r["length"]), r["ids"][: r["length"]]
        slot += len(some)


def materialise(
    docs: DataFrame,
    vocabulary: str,
    folder: str,
    key: int = 1,
    sequence: int = SEQUENCE,
    per_shard: int = SHARD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Writes the shards, and returns one row per sequence as they hold it: slot, shard,
    doc_id, start, length, ids_crc32 (of the ids as uint16). All is written when this
    returns; actions on the rows only read. vocabulary: path of a byte-level tokenizers
    file; special strings in texts are ordinary text.

    A null or empty text is one sequence of the end id; a null doc_id stays null.
    Equal rows have sequences of their own. An empty table writes nothing and
    gives no rows. Numbers follow the partitions of docs, which must read the same
    rows each time, as files do: a partition whose count differs in the second pass
    raises an error. Other columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = "slot long, shard long, doc_id long, start int, length int, ids_crc32 long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, n = byte_tokenizer(vocabulary, special=False), 0
        for batch in batches:
            for part in portions(batch, 1):
                # with the end id
                n += int((-(-(tok.counts([t or "" for t in part.column(1).to_pylist()]) + 1) // sequence)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

    told = d.mapInArrow(count, "part int, n long").toArrow()  # two numbers a partition
    counts = np.zeros(max([-1, *told["part"].to_pylist()]) + 1, np.int64)
    counts[told["part"]] = told["n"]
    total = int(counts.sum())
    if not total:
        return spark.createDataFrame([], out)
    sent = spark.sparkContext.broadcast(np.r_[0, np.cumsum(counts)])
    order = Feistel(total, key)
    n_shards = -(-total // per_shard)
    tasks = int(min(n_shards, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = byte_tokenizer(vocabulary, special=False)
        at, end = sent.value[TaskContext.get().partitionId() :][:2]
        for batch in batches:
            for part in portions(batch, 1):
                each = tok.encode([t or "" for t in part.column(1).to_pylist()])
                size = np.fromiter(map(len, each), np.int64, len(each)) + 1
                flat = np.full(int(size.sum()), END, "<u2")
                ends = np.cumsum(size)
                flat[np.delete(np.arange(len(flat)), ends - 1)] = np.concatenate(each)
                pieces = -(-size // sequence)
                starts = within(pieces) * sequence
                first = np.repeat(ends - size, pieces) + starts
                slots = order.slot(np.arange(at, at + len(first)))
                at += len(first)
                ids = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((2 * np.r_[first, len(flat)]).astype("<i4")), pa.py_buffer(flat)])
                shards = slots // per_shard
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array((shards * tasks // n_shards).astype(np.int32)), part.column(0).take(pa.array(np.repeat(np.arange(len(each)), pieces))), pa.array(starts.astype(np.int32)), ids],
                    names=["slot", "task", "doc_id", "start", "ids"],
                )
        if at != end:
            raise RuntimeError("the input changed between the two passes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by slot; a task has whole shards."""
        held = np.zeros(0, record(sequence))
        shard, done, full = -1, [], []

        def put() -> None:
            if shard >= 0:
                system, path = _open(shard_name(folder, shard))
                part = f"{path}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(part) as f:
                    f.write(memoryview(held.view(np.uint8)))
                system.move(part, path)
                done.append(shard)
                full.append(len(held))

        for batch in batches:
            slots = batch.column(0).to_numpy()
            rows = np.zeros(len(slots), record(sequence))
            rows["ids"] = PAD
            ids = batch.column(4)
            at = np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1, 4 * ids.offset) // 2
            n = np.diff(at)
            rows["ids"][np.repeat(np.arange(len(n)), n), within(n)] = np.frombuffer(ids.buffers()[2], "<u2")[ragged(at[:-1], n)]
            none = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            start = batch.column(3).to_numpy()
            rows["doc_id"], rows["length"] = batch.column(2).fill_null(0).to_numpy(), n
            rows["start"] = np.where(none, -1 - start, start)
            lo = 0
            while lo < len(slots):
                if slots[lo] // per_shard != shard:
                    put()
                    shard, held = int(slots[lo] // per_shard), held[:0]
                hi = int(np.searchsorted(slots, (shard + 1) * per_shard))
                if (slots[lo:hi] != shard * per_shard + len(held) + np.arange(hi - lo)).any():
                    raise RuntimeError(f"a slot of shard {shard} is not where its stride puts it")
                held = np.concatenate([held, rows[lo:hi]])
                lo = hi
        put()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array(full, pa.int32())], names=["shard", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = _records(folder, shard, 0, n, sequence)
                none, start = _head(r)
                crcs = [zlib.crc32(ids[:k]) for ids, k in zip(r["ids"], r["length"].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard * per_shard + np.arange(n)), pa.array(np.full(n, shard)), pa.array(r["doc_id"].copy(), mask=none), pa.array(start.astype(np.int32)), pa.array(r["length"].copy()), pa.array(crcs, pa.int64())],
                    names=[f.split()[0] for f in out.split(", ")],
                )

    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    dealt = d.mapInArrow(cut_up, "slot long, task int, doc_id long, start int, ids binary")
    dealt.repartitionById(tasks, "task").sortWithinPartitions("slot").select("slot", "task", "doc_id", "start", "ids").mapInArrow(write, "shard long, n int").write.parquet(f"{folder}/shards")
    shards = spark.read.schema("shard long, n int").parquet(f"{folder}/shards")
    return shards.repartition(tasks, "shard").mapInArrow(read, out)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
