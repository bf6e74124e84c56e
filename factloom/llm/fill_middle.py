"""Fill-in-the-middle transformation as one numpy kernel over Arrow's UTF-8 buffers.

All texts of a portion are one byte array. A byte-class table tells letters,
other first bytes of a code point and the rest; a token (a run of ASCII letters, or
one other code point) starts where a byte is no continuation and not a letter after
a letter of the same document. The cumulative sum of the starts, less what stood
before the document, counts its tokens, and one searchsorted over that sum finds the
cuts of all rows together.

The draws come from the SHA-256 of the seed and the decimal document id, so a row's
form and cuts depend on nothing else: neither on partitions nor on other rows.

Edge cases: a null text is an empty one, which stays plain; a null id draws as the
empty string does; repeated rows and texts are transformed one by one, each by its
id; a text of any length is cut whole (a portion holds one such text alone, at about
ten bytes of memory a byte of text); a text that holds a sentinel stays plain, so the
sentinels of an output are never the text's own; an empty table gives no rows. Only
the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import portions

SEED = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 documents those that are rearranged, and of 100 of them those with the suffix first.
RATE, SPM_RATE = 90, 20
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

#: Byte classes: a continuation byte, an ASCII letter, any other first byte.
_REST, _LETTER, _OTHER = 0, 1, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _REST
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _LETTER


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, where each begins and the last ends)."""
    t = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(t.buffers()[1], np.int64, len(t) + 1, 8 * t.offset)
    held = t.buffers()[2]
    data = np.frombuffer(held, np.uint8, int(ends[-1] - ends[0]), int(ends[0])) if held is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _texts(parts: list, sizes: np.ndarray) -> pa.Array:
    """An array of texts from their slices, in order, and their sizes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))]).cast(pa.string())


def _sentinels(data: np.ndarray, letters: bytes) -> np.ndarray:
    """Where one of the sentinels with these letters begins."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[:-2] == ord("<"))
    return at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], np.frombuffer(letters, np.uint8))]


def cut(texts: pa.Array, first: np.ndarray, second: np.ndarray, moved: np.ndarray, suffix_first: np.ndarray) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of all rows: `first` and `second`
    are the draws of the two cuts, `moved` tells which rows are rearranged at all."""
    data, ends = _bytes(texts)
    start, end = ends[:-1], ends[1:]
    kind = _CLASS[data]
    begins = kind != _REST
    begins[1:] &= (kind[1:] != _LETTER) | (kind[:-1] != _LETTER)
    begins[start[end > start]] = True
    tokens = np.cumsum(begins, dtype=np.int32 if len(data) < 2**31 else np.int64)
    upto = np.concatenate([[0], tokens[ends[1:] - 1]]) if len(data) else np.zeros(len(ends), np.int64)
    upto[ends == 0] = 0
    n = np.diff(upto).astype(np.int64)

    a, b = first % (n + 1), second % (n + 1)
    cuts = [np.searchsorted(tokens, (upto[:-1] + u + 1).astype(tokens.dtype)) for u in (np.minimum(a, b), np.maximum(a, b))]
    one, two = (np.clip(c, start, end) for c in cuts)

    own = _sentinels(data, b"PSM")
    doc = np.searchsorted(ends, own, "right") - 1
    holds = np.zeros(len(n), bool)
    holds[doc[own + 3 <= ends[doc + 1]]] = True
    plain = ~moved | holds | (n == 0)
    form = np.where(plain, PLAIN, np.where(suffix_first, SPM, PSM)).astype(object)

    whole, parts = memoryview(np.ascontiguousarray(data)), []
    for f, s, i, j, e in zip(form, start, one, two, end):
        if f == PLAIN:
            parts.append(whole[s:e])
        elif f == PSM:
            parts += [PREFIX, whole[s:i], SUFFIX, whole[j:e], MIDDLE, whole[i:j]]
        else:
            parts += [SUFFIX, whole[j:e], PREFIX, whole[s:i], MIDDLE, whole[i:j]]
    sizes = end - start + np.where(plain, 0, len(PREFIX + SUFFIX + MIDDLE))

    edges = np.stack([start, one, two], 1).ravel()  # code points of prefix, middle and suffix
    points = np.add.reduceat(np.append(kind != _REST, False), edges, dtype=np.int64)
    points[edges == np.concatenate([edges[1:], [len(data)]])] = 0  # reduceat gives an empty span its first byte
    prefix, middle = points[0::3], points[1::3]
    return n, form, pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), _texts(parts, sizes)


def restore(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that outputs of these forms were made of."""
    data, ends = _bytes(outputs)
    whole, parts = memoryview(np.ascontiguousarray(data)), []
    form = np.array(forms.to_pylist(), object)
    start = ends[:-1]
    found = {letter: np.append(_sentinels(data, letter), len(data)) for letter in (b"P", b"S", b"M")}
    nth = lambda letter, at: found[letter][np.searchsorted(found[letter], np.minimum(at, len(data)))]
    inner = np.where(form == SPM, nth(b"P", start + 3), nth(b"S", start + 3))  # the second sentinel
    last = nth(b"M", inner + 3)
    for f, s, i, m, e in zip(form, start, inner, last, ends[1:]):
        if f == PLAIN:
            parts.append(whole[s:e])
        elif f == PSM:
            parts += [whole[s + 3 : i], whole[m + 3 : e], whole[i + 3 : m]]
        else:
            parts += [whole[i + 3 : m], whole[m + 3 : e], whole[s + 3 : i]]
    return _texts(parts, ends[1:] - start - np.where(form == PLAIN, 0, 9))


def draws(doc_id, seed: int = SEED) -> list:
    """The four 32-bit numbers of a document: groups of its hash's hex digits."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(told, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code
    points; null if plain) and output, the text to train on, per row of docs."""
    h = draws(docs[id_col].cast("long"), seed)
    given = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        h[0].alias("first"),
        h[1].alias("second"),
        (h[2] % 100 < rate).alias("moved"),
        (h[3] % 100 < spm_rate).alias("suffix_first"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                drawn = [part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
                n, form, prefix, middle, output = cut(part.column(1), *drawn)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(form, pa.string()), prefix, middle, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return given.mapInArrow(run, OUTPUT)


def restored(rows: DataFrame) -> DataFrame:
    """The rows of transformed with one more column, restored: the text that output
    and form alone give back."""
    names = rows.columns
    at, form = names.index("output"), names.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, at):
                back = restore(part.column(at), part.column(form))
                yield pa.RecordBatch.from_arrays([*part.columns, back], names=[*names, "restored"])

    return rows.mapInArrow(run, OUTPUT + ", restored string")


def digests(rows: DataFrame) -> DataFrame:
    """The rows of transformed with SHA-256 sums in place of the texts."""
    return restored(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The same from a list of each text's tokens.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, t, w, len(w) AS n,
    least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS lo, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(w[1:lo], '') AS prefix, array_to_string(w[lo + 1:hi], '') AS middle, array_to_string(w[hi + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
