"""Groups of a sorted partition, streamed through ``mapInArrow`` without a Spark group per call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opinara.llm.textkit import release

#: Bytes of groups after which freed memory goes back to the system.
RELEASE = 16 << 20


def contiguous_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal values in the first ``n_keys`` integer columns, which must be sorted."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(keys[lo].tolist())
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], function: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Deals ``df`` out by ``keys``, sorts, and applies ``function`` to each group."""
    rows = df.select(*keys, *[c for c in df.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for group in contiguous_groups(batches, n):
            out = function(group)
            if out is not None and out.num_rows:
                yield out
            seen += group.nbytes
            if seen > RELEASE:
                seen = 0
                release()
        release()

    return rows.mapInArrow(run, schema)
