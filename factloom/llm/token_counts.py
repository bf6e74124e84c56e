"""Token counts of a byte-level BPE by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one ragged numpy array of symbols; in each
round every pre-token takes the lowest rank among its neighbouring pairs and merges
that pair wherever it stands in it, all pre-tokens at once (array_bpe). What survives
is counted.

Edge cases: a null text counts as empty (no bytes, no tokens); a null doc_id
stays null; rows are counted one by one, repeated or not; a pre-token of any
length is merged whole; an empty table gives no rows. Columns other than the id
and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.array_bpe import byte_tokenizer
from factloom.llm.tables import portions

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
LIMIT = 1024


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) per row of docs.
    vocabulary: path of a tokenizers file; its special strings in texts are one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = byte_tokenizer(vocabulary)
        for batch in batches:
            for part in portions(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = tok.counts(texts)
                sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, COUNTS)
