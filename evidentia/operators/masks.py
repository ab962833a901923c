"""Pairs of ids by the members they have in common, counted 64 members at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.scratch import materialize

#: Rows of the smaller side that may be broadcast: some 50 bytes each.
MOST_BROADCAST = 1_000_000
#: Joined rows of a task, on average, and rows of either side that meet in one cell of the grid.
PER_TASK, CELL = 4_000_000, 2_000
#: Members that one task numbers, on average.
NUMBERED = 16_384


def tasks(df: DataFrame, work: int) -> int:
    """Tasks for so many joined rows. Inputs are small next to what they make, so their bytes cannot say."""
    return min(100_000, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(work) // PER_TASK)))


def products(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Per key of both sides: rows of each and their product."""
    n = left.groupBy(*on).agg(F.count("*").alias("_na")).join(right.groupBy(*on).agg(F.count("*").alias("_nb")), on)
    return n.withColumn("_w", F.col("_na") * F.col("_nb"))


def grid_join(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """An inner join on ``on`` whose hot keys are split: left by ``a``, right by ``b``, into cells of a grid."""
    n = materialize(products(left, right, on).select(*on, F.ceil(F.col("_na") / CELL).alias("_ca"), F.ceil(F.col("_nb") / CELL).alias("_cb"), "_w"), "cells")
    parts = tasks(left, n.agg(F.sum("_w")).first()[0] or 0)
    of = lambda c, k: F.pmod(F.xxhash64(c), F.col(k))
    all_of = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    keys = [*on, "_x", "_y"]
    x = left.join(n, on).withColumn("_x", of(a, "_ca")).withColumn("_y", all_of("_cb")).drop("_ca", "_cb", "_w").repartition(parts, *keys)
    y = right.join(n, on).withColumn("_y", of(b, "_cb")).withColumn("_x", all_of("_ca")).drop("_ca", "_cb", "_w").repartition(parts, *keys)
    return x.join(y, keys).drop("_x", "_y")


def numbers(members: DataFrame, by: list[str], n: int, within: list[str] = ()) -> DataFrame:
    """``by`` of the ``n`` members with ``block`` and ``bit``: 64 members share a block, and no two of the same ``within`` a bit."""
    at = F.row_number().over(W.partitionBy(*within, "_w").orderBy(*by)) - 1
    out = members.withColumn("_w", F.pmod(F.xxhash64(*by), F.lit(-(-n // NUMBERED) or 1))).withColumn("_n", at)
    return out.select(*by, (F.shiftleft("_w", 32) + F.shiftright("_n", 6)).alias("block"), (F.col("_n") % 64).cast("int").alias("bit"))


def common(left: DataFrame, right: DataFrame, members: list[str], a: str, b: str, keys: list[str] = ()) -> tuple[DataFrame, str | None, int]:
    """Rows ``*keys, a, b, t`` whose sums over t count the members that both have; the id they are dealt by, and tasks.

    ``left`` has distinct ``*members, a``, ``right`` distinct ``*members, b``; ``keys`` are some of the members. Ids meet
    at the member itself or, where that makes fewer rows, at blocks of 64 members as bit masks. The smaller side is
    broadcast when it is counted to be small, so that nothing is shuffled after the join; beyond, a grid join splits hot
    keys.
    """
    keys = list(keys)
    met = materialize(products(left, right, members), "members")
    n, na, nb, work = met.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("_na", "_nb", "_w")]).first()
    on, x, y, t = members, left, right, F.lit(1).cast("long")
    if work > PER_TASK // 4:
        numbered = numbers(met.select(*members), members, n, keys)
        none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
        bits = left.join(numbered, members).select(*keys, "block", a, none(right, b), "bit").unionAll(right.join(numbered, members).select(*keys, "block", none(left, a), b, "bit"))
        bits = materialize(bits.groupBy(*keys, "block", a, b).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("_m")), "masks")
        dense = bits.groupBy(*keys, "block").agg(F.count(a).alias("x"), F.count(b).alias("y"))
        ma, mb, fewer = dense.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("x"), F.col("y"), F.col("x") * F.col("y"))]).first()
        if fewer < work:
            on, work, na, nb = [*keys, "block"], fewer, ma, mb
            x = bits.filter(F.col(a).isNotNull()).select(*on, a, "_m")
            y = bits.filter(F.col(b).isNotNull()).select(*on, b, F.col("_m").alias("_k"))
            t = F.bit_count(F.col("_m").bitwiseAND(F.col("_k"))).cast("long")
    parts, by = tasks(left, work), None
    if min(na, nb) <= MOST_BROADCAST:
        by = b if na <= nb else a
        x, y = (F.broadcast(x), y.repartition(parts, b)) if na <= nb else (x.repartition(parts, a), F.broadcast(y))  # at most MOST_BROADCAST rows
        pairs = x.join(y, on)
    else:
        pairs = grid_join(x, y, on, a, b)
    return pairs.withColumn("t", t).filter("t > 0").select(*keys, a, b, "t"), by, parts


def ordered_pairs(ids: DataFrame, column: str, x: str, y: str) -> DataFrame:
    """All pairs of ids with x < y: quadratic by its nature, made cell by cell with an equi join."""
    one = F.lit(0).alias("_one")
    return grid_join(ids.select(F.col(column).alias(x), one), ids.select(F.col(column).alias(y), one), ["_one"], x, y).filter(F.col(x) < F.col(y)).select(x, y)
