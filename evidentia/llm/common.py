"""Helpers shared by the operators: shared scratch tables and two-level prefix sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.scratch import discard, materialize, ship  # noqa: F401

#: ASCII white space between words, as a character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

def unit(key: Column) -> Column:
    """A 62-bit non-negative hash, for shuffled orders."""
    return F.shiftrightunsigned(F.xxhash64(key), 2)


#: Above any value of unit().
UNIT = 1 << 62


def bucket_of(u: Column, n: Column | int) -> Column:
    """The bucket 0..n-1 of a unit() hash, rising with it."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.least((F.shiftright(u, 31) * n / F.lit(float(1 << 31))).cast("int"), n.cast("int") - 1)


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, out: str, total: str | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the rows before this one within ``keys``, in the order (bucket, *order).

    A window sees one bucket only; the sums of whole buckets, one row each, carry the rest. So a key with
    a third of all rows is spread over its buckets. ``bucket`` must rise with ``order``; keys are not null.
    """
    by = [*keys, bucket]
    sums = df.groupBy(*by).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    if total:
        sums = sums.withColumn(total, F.sum("_sum").over(W.partitionBy(*keys)))
    here = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.join(sums.drop("_sum"), by).withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(here), F.lit(0))).drop("_base")


#: Bits of a broadcast filter: 16 a key, from 128 KB to 128 MB. Beyond, it lets more pass; what passes is joined exactly.
LEAST_BITS, MOST_BITS = 20, 30
_ROW = 1 << 12


def slots(keys, bits: int):
    """Filter places of NumPy int64 keys, spread by a multiplication."""
    import numpy as np

    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


#: Keys that a task gathers before it sends their places on.
_GATHERED = 1 << 20


def _marks(bits: int):
    """Per block of places, the 16-bit offsets of a task's keys in it: as much as there are keys, whatever the bits."""
    import numpy as np
    import pyarrow as pa

    def sent(held):
        at = np.unique(slots(np.concatenate(held), bits))
        blocks, first = np.unique(at // (8 * _ROW), return_index=True)
        offsets = np.append(first, len(at)).astype(np.int32) * 2
        data = (at % (8 * _ROW)).astype("<u2").tobytes()
        marks = pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), marks], ["block", "marks"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).drop_null().to_numpy())
            n += len(held[-1])
            if n >= _GATHERED:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    return run


def _either(key, table):
    import numpy as np
    import pyarrow as pa

    out = np.zeros(8 * _ROW, bool)
    for x in table.column("marks").to_pylist():
        out[np.frombuffer(x, "<u2")] = True
    return pa.table({"block": table.column("block").slice(0, 1), "marks": pa.array([np.packbits(out).tobytes()], pa.binary())})


def key_filter(keys: DataFrame, n: int):
    """A broadcast of a bit set that holds every long of the one column of ``keys`` (``n`` rows); and its bits."""
    import numpy as np

    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    seen = np.zeros(1 << (bits - 3), np.uint8)
    schema = "block int, marks binary"
    for r in keys.mapInArrow(_marks(bits), schema).groupBy("block").applyInArrow(_either, schema).collect():
        seen[r["block"] * _ROW : (r["block"] + 1) * _ROW] = np.frombuffer(r["marks"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(seen), bits


def passes(seen, bits: int, keys):
    """Which NumPy keys a filter holds, a few others among them."""
    at = slots(keys, bits)
    return ((seen[at >> 3] >> (7 - (at & 7)).astype("uint8")) & 1).astype(bool)


#: Bytes that a worker's function takes up at a time, about; a row is never split.
SLICE = 1 << 21


def slices(batches) -> Iterator:
    """The rows of Arrow batches, in order, in batches of about ``SLICE`` bytes."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE // max(SLICE, batch.nbytes))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def release() -> None:
    """Gives memory that a worker has freed back to the system. Workers outlive their tasks, and what they keep is the executor's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def sliced(run):
    """``run``, a function of mapInArrow, on slices: its lists and results are those of a slice, not of a whole batch."""

    @wraps(run)
    def bounded(batches):
        yield from run(slices(batches))
        release()

    return bounded
