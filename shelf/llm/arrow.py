"""Row functions over one column, run in Arrow batches of bounded size."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, as a batch of long texts would else take 10,000 of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def released() -> None:
    """Give back what a task's function held: workers live on, and what one operator caches must not stay beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def _arrays(batch: pa.ListArray) -> Iterator[np.ndarray | None]:
    """The rows of a list column of numbers, as views of its values."""
    values, bounds, there = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy(), batch.is_valid().to_numpy(zero_copy_only=False)
    return (values[a:b] if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], there))


def row_udf(make: Callable[[], Callable[[Any], tuple]], schema: str, binary: bool = False, numbers: bool = False) -> Callable[..., Column]:
    """A column function: ``make()`` runs once per task and returns a function from a value to a struct's fields.

    ``make`` is pickled to the executors, so it should be a partial of a module's function with
    small arguments; what it builds goes when the task ends. With ``binary`` a string arrives as its UTF-8 bytes, with ``numbers`` an array of
    numbers as one of numpy. Null arrives as None.
    """
    fields = StructType.fromDDL(schema)
    kind = to_arrow_type(fields)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        try:
            for batch in batches:
                values = _arrays(batch) if numbers else (v.as_py() for v in (batch.cast(pa.binary()) if binary else batch))
                yield pa.array([apply(v) for v in values], type=kind)
        finally:
            apply = None
            released()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, fields)


def batch_udf(make: Callable[[], Callable[[list], list[tuple]]], schema: str) -> Callable[..., Column]:
    """As ``row_udf`` for strings as UTF-8 bytes, but the function takes all values of a batch and returns their rows."""
    fields = StructType.fromDDL(schema)
    kind = to_arrow_type(fields)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        try:
            for batch in batches:
                yield pa.array(apply(batch.cast(pa.binary()).to_pylist()), type=kind)
        finally:
            apply = None
            released()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, fields)
