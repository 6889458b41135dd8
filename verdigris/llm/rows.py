"""Whole rows through Arrow, whatever their columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def rows_where(docs: DataFrame, good: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose texts are good, columns as given."""
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(good(batch.column(at))))

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
