"""Stated query sets in blocks: one block at a time is broadcast and meets all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(rows: DataFrame, key: str, most_rows: int, size: str | None = None, most_size: int = 0) -> Iterator[pa.Table]:
    """Rows in ascending order of ``key`` (unique, not null), at most ``most_rows`` at a time.

    With a ``size`` column a block ends before its sizes exceed ``most_size``, but has one row at least. So what
    is brought to the driver and broadcast is bounded, whatever the number of rows.
    """
    last = None
    while True:
        left = rows if last is None else rows.where(F.col(key) > F.lit(last))
        page = left.orderBy(key).limit(most_rows)
        if size:
            sizes = page.select(key, size).toArrow().sort_by(key)
            fits = pc.sum(pc.less_equal(pc.cumulative_sum(sizes[size].cast(pa.int64())), most_size)).as_py() or 0
            page = left.orderBy(key).limit(max(1, fits))
        block = page.toArrow().combine_chunks().sort_by(key)
        if not block.num_rows:
            return
        yield block
        last = block[key][-1].as_py()
