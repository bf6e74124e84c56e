"""Packing: sum-of-squares online bin packing of token sequences into windows.

Every partition packs the documents it reads, so nothing is shuffled and the
packing scales with the scan. A document longer than a window fills whole
windows of its own; the remainder, of s ids, is placed by the sum-of-squares
rule: of all fill levels h with a half-filled window (and of a new window) it
takes the one after which the sum over levels of N(h)^2 is smallest, N(h) being
the number of windows filled to h. N is a level array of window + 1 counters, so
a placement is one vectorised pass over it.

At the end of a partition, or when OPEN windows are open, these are poured
together: pieces of the emptiest are cut to fill the fullest, which leaves one
open window at most. At the end that one is cut at powers of two, at which a
sequence needs no padding.

Edge cases: a null or empty text has only the end id; a null doc_id is kept as
null; equal rows are packed one by one; an empty table gives no rows. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from factloom.llm.array_bpe import word_tokenizer
from factloom.llm.tables import portions

#: Pre-tokens a worker holds between batches, 25 MB: the pipeline's other stages share its memory.
MEMORY = 150_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = 2
WINDOW = 4096
#: Open windows at which a partition pours them together, to bound its memory
#: (lengths over half a window can leave every window open).
OPEN = 2048


class Packer:
    """Places lengths; gives (item, start, length, sequence, offset) pieces.

    add() may return pieces of windows that are complete; finish() the rest.
    """

    def __init__(self, window: int):
        self.window, self.sequences = window, 0
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)  # level -> windows, each a list of pieces

    @property
    def waiting(self) -> int:
        return int(self.counts.sum())

    def _close(self, pieces: list) -> list[tuple]:
        out, at = [], 0
        for item, start, length in pieces:
            out.append((item, start, length, self.sequences, at))
            at += length
        self.sequences += 1
        return out

    def level(self, s: int) -> int:
        """The level to put s ids on: the change of the sum of squares is
        2 (N(h + s) - N(h)) + 2, without the first term where the window closes
        and without the second for a new window."""
        n, room = self.counts, self.window - s
        gain = 2 * (n[s : s + room + 1] - n[: room + 1]) + 2
        gain[0] = 2 * n[s] + 1
        gain[room] = 1 - 2 * n[room] if room else 0
        taken = n[: room + 1] > 0
        taken[0] = True
        gain[~taken] = np.iinfo(np.int64).max
        return int(room - np.argmin(gain[::-1]))  # of equals the fullest

    def add(self, item, n: int) -> list[tuple]:
        out, start = [], 0
        while n - start >= self.window:
            out += self._close([(item, start, self.window)])
            start += self.window
        s = n - start
        if not s:
            return out
        h = self.level(s)
        pieces = []
        if h:
            pieces = self.open[h].pop()
            self.counts[h] -= 1
        pieces.append((item, start, s))
        if h + s == self.window:
            return out + self._close(pieces)
        self.open[h + s].append(pieces)
        self.counts[h + s] += 1
        return out

    def pour(self) -> list[tuple]:
        """Cuts pieces of the emptiest open windows to fill the fullest; at most one
        window stays open."""
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open.clear()
        self.counts[:] = 0
        out, i, j, spare = [], 0, len(windows), []
        while i < j:
            pieces = windows[i]
            i += 1
            room = self.window - sum(p[2] for p in pieces)
            while room:
                if not spare:
                    if i == j:
                        break
                    j -= 1
                    spare = windows[j]
                item, start, length = spare.pop()
                take = min(length, room)
                pieces.append((item, start, take))
                room -= take
                if take < length:
                    spare.append((item, start + take, length - take))
            if room:
                spare = pieces
            else:
                out += self._close(pieces)
        if spare:
            level = sum(p[2] for p in spare)
            self.open[level].append(spare)
            self.counts[level] = 1
        return out

    def finish(self) -> list[tuple]:
        out = self.pour()
        left = [p for windows in self.open.values() for w in windows for p in w]
        self.open.clear()
        self.counts[:] = 0
        total = sum(p[2] for p in left)
        while total:
            size = need = 1 << (total.bit_length() - 1)
            pieces = []
            while need:
                item, start, length = left.pop()
                take = min(length, need)
                pieces.append((item, start, take))
                need -= take
                if take < length:
                    left.append((item, start + take, length - take))
            out += self._close(pieces)
            total -= size
        return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most
    `window` ids. vocabulary: path of a tokenizers file; an id is 4 bytes.
    sequence_id is unique over all partitions and the same if a task runs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(vocabulary)
        tok.memory = MEMORY
        encode = tok.encode
        packer, end = Packer(window), np.array([end_id], "<u4")
        base = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}  # number of the document -> id, ids, where these start, all, not yet out
        rows: list[tuple] = []
        key = 0

        def put(pieces) -> None:
            for k, start, length, seq, at in pieces:
                entry = held[k]
                doc, ids, first, n, left = entry
                crc = zlib.crc32(ids[start - first : start - first + length])
                rows.append((doc, start, length, crc, n, base + seq, at))
                entry[4] = left - length
                if not entry[4]:
                    del held[k]

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            for part in portions(batch, 1):
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.concatenate([ids, end], dtype="<u4", casting="unsafe")
                    n = len(ids)
                    held[key] = [doc, ids, 0, n, n]
                    put(packer.add(key, n))
                    if key in held:  # only what waits in an open window stays
                        waits = held[key][4]
                        held[key][1:3] = [ids[n - waits :].copy(), n - waits]
                    if packer.waiting > OPEN:
                        put(packer.pour())
                    key += 1
                yield flush()
        put(packer.finish())
        yield flush()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, PIECES)
