"""All-against-all comparison of two vector tables as matrix products, without forming pairs as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a side that is shared with all tasks, numbers of a tile, and pairs that a worker compares at once.
SHARED_VALUES = 2_000_000
TILE_VALUES = 2_000_000
PAIRS = 2_000_000
_BATCH = 2_048
#: Results of one part that are put together at once.
_MERGED = 16


def dense(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def unit_rows(column: pd.Series) -> np.ndarray:
    m = dense(column)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def compared(part: pd.DataFrame, block: pd.DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], Any], merge: Callable[[list], Any] | None = None,
             finish: Callable[[pd.DataFrame, Any], pd.DataFrame] | None = None, pairs: int = PAIRS, merged: int = _MERGED) -> Iterator[pd.DataFrame]:
    """Results of fn for rows of `part` and of `block` that make `pairs` pairs at most; see `meet`."""
    width = max(1, pairs // _BATCH)
    for start in range(0, len(part), _BATCH):
        rows, found = part.iloc[start:start + _BATCH], []
        for i in range(0, len(block), width):
            done = fn(rows, block.iloc[i:i + width])
            if not merge:
                yield done
                continue
            found.append(done)
            if len(found) == merged:
                found = [merge(found)]
        if found:
            whole = found[0] if len(found) == 1 else merge(found)
            yield finish(rows, whole) if finish else whole


def meet(left: DataFrame, right: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], Any], schema: str, vec: str = "vec",
         merge: Callable[[list], Any] | None = None, at: str | None = None, finish: Callable[[pd.DataFrame, Any], pd.DataFrame] | None = None, whole: bool = False) -> DataFrame:
    """fn(part of left, block of right) for parts and blocks that together cover every combination.

    A part and a block make `PAIRS` pairs at most, whatever the sizes of the sides. `merge` puts together
    what one part found in several blocks, which `finish` (if given) turns into rows. `at` is a column of left with places from 0 on: rows are then
    dealt in that order, so that neighbours meet a block together. With `whole`, fn gets a batch or tile and all rows of
    the other side's at once, bounds its own work and yields one table or more.

    When the right side holds at most `SHARED_VALUES` numbers (counted first) it is shared with all tasks
    and the left side streams past it with no shuffle. Beyond that both sides are cut into tiles of
    bounded size, each by the length of its own vectors, and every pair of tiles is one group, so neither
    side is ever gathered whole. A right side without rows gives no rows.
    """
    how = fn, merge, finish, PAIRS, _MERGED

    def each(part: pd.DataFrame, block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return fn(part, block) if whole else compared(part, block, *how)

    dim, n = right.select(F.max(F.size(vec)), F.count(F.lit(1))).first()
    if not n:
        return left.sparkSession.createDataFrame([], schema)

    if int(n) * max(1, int(dim)) <= SHARED_VALUES:
        shared = left.sparkSession.sparkContext.broadcast(right.toPandas())

        def stream(batches):
            for b in batches:
                yield from each(b, shared.value)

        # With a stated number, small parts aren't put together again: the work is in the pairs.
        parts = 2 * left.sparkSession.sparkContext.defaultParallelism
        dealt = left.repartitionByRange(parts, at).sortWithinPartitions(at) if at else left
        return dealt.mapInPandas(stream, schema)

    left_dim, left_n = left.select(F.max(F.size(vec)), F.count(F.lit(1))).first()
    right_tiles = -(-int(n) // max(1, TILE_VALUES // max(1, int(dim))))
    left_tiles = max(1, -(-int(left_n) // max(1, TILE_VALUES // max(1, int(left_dim or 1)))))

    def tiled(df: DataFrame, number: Column, own: str, other: str, others: int) -> DataFrame:
        return df.withColumn(own, number).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def hashed(tiles: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")

    a = tiled(left, F.floor(F.col(at) * left_tiles / int(left_n)).cast("int") if at else hashed(left_tiles), "_i", "_j", right_tiles)
    # Columns of its own: a table that meets itself has each of them once only, which Spark refuses as ambiguous.
    b = tiled(right.select(*[F.col(c).alias(c) for c in right.columns]), hashed(right_tiles), "_j", "_i", left_tiles)
    empty = [f.strip().split(" ")[0].strip("`") for f in schema.split(",")]

    def tile(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if part.empty or block.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in empty})
        return pd.concat(list(each(part.sort_values(at) if at else part, block)), ignore_index=True)

    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(tile, schema)
