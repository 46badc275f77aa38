"""Arrow helpers shared by the operators of this subpackage.

Every operator reads the columns it names and ignores the others, so extra
columns, also ones named like an output column, never get in its way.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_BYTES = 4 << 20


def col(name: str):
    """A column by its exact name, also one with dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_prefix(columns: list[str], start: str = "__") -> str:
    """A beginning of names that none of ``columns`` has."""
    while any(c.lower().startswith(start.lower()) for c in columns):
        start += "_"
    return start


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: Spark looks the columns of
    ``mapInArrow`` up by name, where a dot means a field."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def placed(schema: T.StructType) -> T.StructType:
    """``schema`` with the names of ``by_place``."""
    return T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``max_bytes`` of ``column``;
    a longer text is a run of its own."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    ends = np.cumsum(sizes.astype(np.int64) + 64)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string array; null counts as empty."""
    b = pc.fill_null(arr, "").cast(pa.large_binary())
    offsets = np.frombuffer(b.buffers()[1], dtype=np.int64)[b.offset:b.offset + len(b) + 1]
    raw = b.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def map_texts(df: DataFrame, column: str, fields: list[T.StructField],
              fn: Callable[[pa.Array], list], max_bytes: int = BATCH_BYTES,
              keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all if None) with those of ``fields``
    added, or put in place of columns of the same name. ``fn`` gets the texts of
    some rows (Arrow strings, with nulls) and returns one Arrow array or list for
    each field."""
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    source = [col(f.name) for f in kept]
    at = next((i for i, f in enumerate(kept) if f.name == column and f.dataType == T.StringType()), len(kept))
    if at == len(kept):
        source.append(col(column).cast("string"))
    schema = T.StructType(kept + list(fields))
    target = to_arrow_schema(placed(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, f"c{at}", max_bytes):
                arrays = part.columns[:len(kept)] + list(fn(part.column(at)))
                yield pa.RecordBatch.from_arrays(
                    [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type)
                     for x, f in zip(arrays, target, strict=True)], schema=target)

    return by_place(df.select(*source)).mapInArrow(run, placed(schema)).toDF(*schema.names)


def rows_to(df: DataFrame, column: str, schema: str | T.StructType,
            fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
            max_bytes: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` over runs of rows balanced by the bytes of ``column``."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, column, max_bytes):
                yield from fn(part)

    return df.mapInArrow(run, schema)


def vocabulary(name: str) -> str:
    """The place of a vocabulary file: an absolute path as it is, else the name
    of a file of ``public_tokenizers`` as installed where this runs."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
