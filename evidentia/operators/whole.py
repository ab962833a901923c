"""Pairs of ids that are returned whole: made tile by tile in the tasks that return them, so that none is shuffled or written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.scratch import ship

#: Ids of a tile on its sides, where a pair is returned for each cell; pairs of a batch.
WIDE, BATCH = 1_024, 1 << 18


def sides(batches: Iterator[pa.RecordBatch]) -> list[pa.Table]:
    """The rows of ``_side`` 0, 1 and 2 apart."""
    held: list[list] = [[], [], []]
    for batch in batches:
        side, none = batch.column("_side").to_numpy(), batch.slice(0, 0)
        for k, part in enumerate(held):
            part.append(batch.filter(pa.array(side == k)) if (side == k).any() else none)
    return [pa.Table.from_batches(part).combine_chunks() for part in held]


def column(table: pa.Table, name: str) -> pa.Array:
    return pc.cast(table.column(name), table.schema.field(name).type).combine_chunks() if table.num_rows else pa.array([], table.schema.field(name).type)


def places(values: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each value, -1 for those that are none."""
    return pc.index_in(values, among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def dealt(tiles: DataFrame, n: int) -> DataFrame:
    """Rows by their tile ``_x, _y``, over tasks for ``n`` tiles."""
    parts = max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, -(-n // 4)))
    return tiles.repartition(parts, "_x", "_y").groupBy("_x", "_y")


def _valued(names: list[str]):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, known = sides(batches)
        own = key[0].as_py() == key[1].as_py()
        u, v = column(left, "a"), column(left if own else right, "a")
        if not len(u) or not len(v):
            return
        ids = u if own else pa.concat_arrays([u, v])
        ids = ids.take(pc.sort_indices(ids))
        p, q = places(u, ids), places(v, ids)
        at = np.full((2, len(ids)), -1, np.int64)  # of each id, its place on either side
        at[0, p], at[1, q] = np.arange(len(p)), np.arange(len(q))
        x, y = (places(column(known, c), ids) for c in "ab")
        turned = (at[0, x] < 0) | (at[1, y] < 0)
        value = np.zeros((len(p), len(q)), np.int64)
        value[at[0, np.where(turned, y, x)], at[1, np.where(turned, x, y)]] = column(known, "v").to_numpy(zero_copy_only=False)
        strip = max(1, BATCH // len(q))
        for i in range(0, len(p), strip):
            one, other = np.broadcast_arrays(p[i : i + strip, None], q[None, :])
            made = [np.minimum(one, other).ravel(), np.maximum(one, other).ravel(), value[i : i + strip].ravel()]
            if own:
                made = [m[(one < other).ravel()] for m in made]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(made[0])), ids.take(pa.array(made[1])), pa.array(made[2])], names)

    return run


def valued_pairs(ids: DataFrame, known: DataFrame, x: str, y: str, value: str, wide: int = WIDE) -> DataFrame:
    """All pairs ``x, y, value`` of the distinct ``ids``, x < y: with the values of ``known``, or 0.

    Two ids meet in the tile of their blocks; the known pairs, sparse or not, are dealt to it, and it returns all of its own.
    """
    ship(ids.sparkSession)
    c, kind = ids.columns[0], ids.schema[0].dataType.simpleString()
    n = max(1, -(-ids.count() // wide))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    tile = lambda a, b: (F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y"))
    none = F.lit(None)
    each = ids.select(c, block(c).alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_o"))
    each = each.select(*tile("_k", "_o"), (F.col("_k") > F.col("_o")).cast("int").alias("_side"), F.col(c).alias("a"), none.cast(kind).alias("b"), none.cast("long").alias("v"))
    held = known.select(*tile(block(x), block(y)), F.lit(2).alias("_side"), F.col(x).alias("a"), F.col(y).alias("b"), F.col(value).cast("long").alias("v"))
    return dealt(each.unionAll(held), n * (n + 1) // 2).applyInArrow(_valued([x, y, value]), f"`{x}` {kind}, `{y}` {kind}, `{value}` long")
