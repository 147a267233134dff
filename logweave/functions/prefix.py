"""Running sums within an input split, as it is read: no row is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T


def with_running_sum(df: DataFrame, unit: list[str], size: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``size`` over the rows before in the same unit.

    The rows of a unit must lie one after the other in a task, as the lines of an input split do.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    return df.mapInArrow(_sums(unit, size, name), schema)


def _sums(unit: list[str], size: str, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in unit]
            sizes = np.asarray(batch.column(size)).astype(np.int64)
            before = np.cumsum(sizes) - sizes
            new = np.ones(len(sizes), bool)  # where another unit begins
            new[0] = [k[0] for k in keys] != last
            new[1:] = np.any([np.asarray(pc.not_equal(k[1:], k[:-1])) for k in keys], axis=0)
            begin = np.maximum.accumulate(np.where(new, np.arange(len(sizes)), -1))
            sums = before - np.where(begin < 0, -at, before[begin])
            at, last = int(sums[-1] + sizes[-1]), [k[-1] for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=[*batch.schema.names, name])

    return run
