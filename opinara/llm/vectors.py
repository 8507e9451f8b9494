"""Integer vectors: the common first step of the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.session import small_batches

#: Components are held within this bound, so that products and squared distances of 2,048 components are exact 64-bit integers.
LIMIT = 1 << 25


def integer_vectors(df: DataFrame, vector: Column, scale: int, dims: int | None = None, **beside: Column) -> DataFrame:
    """The columns ``beside`` and ``v``: floor(scale * x) of each component x, taken as a double, as array<int>.

    Rows with a null vector, a null or non-finite component or (with ``dims``) another number of components go.  Values
    beyond ``LIMIT`` become ``LIMIT``, with their sign."""
    small_batches(df.sparkSession)
    rows = df.select(*[c.alias(k) for k, c in beside.items()], vector.cast("array<double>").alias("v")).where("v is not null")
    if dims is not None:
        rows = rows.where(F.size("v") == dims)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            keep = np.bincount(row[~np.isfinite(x)], minlength=len(sizes)) == 0
            with np.errstate(over="ignore"):
                ints = np.clip(np.floor(scale * x[keep[row]]), -LIMIT, LIMIT).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*[c.filter(mask) for c in b.columns[:-1]], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ints))], names=b.schema.names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(floors, f"{kinds}, v array<int>")


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """The lists of an Arrow array as an int64 matrix; shorter ones end in zeros, as a component that is not there adds
    nothing to a product."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), width or 0)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - first[row]] = flat
    return out
