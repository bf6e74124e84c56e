"""Reading the pipeline's tables, batches of bounded size, and sizes that decide how a
join is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a few numbers a row) may be sent to every executor.
BROADCAST_ROWS = 100_000
#: Bytes of text that a task turns into Python objects at once (a longer text alone).
PORTION = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; else as it is, so that
    the join shuffles and adaptive execution splits its hot keys."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def portions(batch: pa.RecordBatch, column: int, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (or lists of numbers) have about `size` bytes."""
    texts = batch.column(column)
    length = pc.list_value_length(texts) if pa.types.is_list(texts.type) else pc.binary_length(texts)
    ends = np.cumsum(np.nan_to_num(length.to_numpy(zero_copy_only=False)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to
