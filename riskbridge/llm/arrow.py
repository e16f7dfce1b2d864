"""Texts as Arrow hands them over: one run of UTF-8 bytes and the places where each text starts."""

from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


T = TypeVar("T")
_KEPT: dict[Hashable, object] = {}


def kept(owner: Hashable, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task, for one owner at a time: another one's goes, as workers outlive a stage."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = make()
    return _KEPT[owner]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts; the bytes aren't copied."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return whole[first : offsets[-1] if len(offsets) else 0], offsets - first


def per_batch(df: DataFrame, text: str, f: Callable[[pa.Array], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Adds the columns that f makes of each batch's texts; the other columns pass through. schema: of the added ones."""
    kept = [c for c in df.columns if c != text]
    out = StructType([df.schema[c] for c in kept] + StructType.fromDDL(schema).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = f(part.column(part.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + list(made.values()), names=[*kept, *made])

    return df.mapInArrow(run, out)
