"""Ordered analytics: accumulation curves, cumulative degrees, adjusted p-values, ranks, top rows.

Records are aggregated to distinct values first, and running sums are taken range by range (see scratch.running), so
no task holds a whole distribution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.scratch import materialize, running


def accumulation_curve(df: DataFrame, value: str, measures: list[str], tie: str | list[str], greater: bool = True, min_samples: int = 200) -> DataFrame:
    """Along falling (or rising) thresholds: rows, measured rows and sums on their side, ties included.

    The first threshold, the most extreme value, takes the first ``min_samples`` rows, in the order of the value and
    ``tie``, or all if there are fewer; thresholds within those emit nothing. Null values are left out, null measures
    count as not measured. Columns: ``value, n_pairs`` and per measure ``sum_{m}, non_na_pairs_{m}``.
    """
    tie = [tie] if isinstance(tie, str) else list(tie)
    rows = materialize(df.filter(F.col(value).isNotNull()).select(F.col(value).alias("value"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)], *[F.col(m).alias(f"_m{i}") for i, m in enumerate(measures)]), "curve")
    sums = [F.count("*").alias("n")]
    for i in range(len(measures)):
        sums += [F.sum(f"_m{i}").alias(f"s{i}"), F.count(f"_m{i}").alias(f"k{i}")]
    ties = lambda v: rows.filter(F.col("value") == F.lit(v))
    return accumulated(rows.groupBy("value").agg(*sums), measures, ties, len(tie), greater, min_samples)


def accumulated(counts: DataFrame, measures: list[str], ties: Callable[[object], DataFrame], n_ties: int, greater: bool = True, min_samples: int = 200) -> DataFrame:
    """The curve from ``value, n, s0, k0, ..``: rows, sums and measured rows of every value. ``ties`` gives the rows of one
    value, ``_t0.., _m0..``, for the first threshold."""
    side = F.desc("value") if greater else F.asc("value")
    sums = [F.count("*").alias("n")]
    for i in range(len(measures)):
        sums += [F.sum(f"_m{i}").alias(f"s{i}"), F.count(f"_m{i}").alias(f"k{i}")]
    names = ["n", *[f"{c}{i}" for i in range(len(measures)) for c in "sk"]]
    run = materialize(running(counts, [], [side], {c: ("sum", F.col(c)) for c in names}), "curve")
    shown = ["value", F.col("n").alias("n_pairs")]
    for i, m in enumerate(measures):
        shown += [F.col(f"s{i}").alias(f"sum_{m}"), F.col(f"k{i}").alias(f"non_na_pairs_{m}")]
    first = run.orderBy("n").first()
    if first is None or first["n"] >= min_samples:
        return run.select(*shown)
    # the first rows: whole values, and as many of the next value as are missing
    whole = run.filter(F.col("n") <= min_samples).orderBy(F.desc("n")).first()
    cut = run.filter(F.col("n") > min_samples).orderBy("n").first()
    taken = run.filter(F.col("n") == whole["n"]).drop("value")
    if cut is not None and whole["n"] < min_samples:
        part = ties(cut["value"]).orderBy(*[f"_t{i}" for i in range(n_ties)]).limit(min_samples - whole["n"])
        taken = taken.unionByName(part.agg(*sums))
    taken = taken.agg(*[F.sum(c).alias(c) for c in names]).withColumn("value", F.lit(first["value"]))
    rest = run.filter(F.col("n") > min_samples)
    return taken.select("value", *names).unionByName(rest.select("value", *names)).select(*shown)


def weighted_accumulation(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Weight at or above, and at or below, every distinct value."""
    by = df.groupBy(F.col(value).alias("value")).agg(F.sum(weight).alias("w"))
    up = running(by, [], [F.desc("value")], {"at_least": ("sum", F.col("w"))})
    return running(up, [], [F.asc("value")], {"at_most": ("sum", F.col("w"))}).drop("w")


def reverse_cumulative(df: DataFrame, key: str, level: str) -> DataFrame:
    """Per key and level 1..highest: how many rows have that level or more; missing levels are filled in."""
    most = df.agg(F.max(level)).alias("m")
    n = df.groupBy(key, level).agg(F.count("*").alias("n"))
    grid = df.select(key).distinct().crossJoin(F.broadcast(most.toDF("m"))).select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("m").cast("long"))).alias(level))  # one row
    full = grid.join(n, [key, level], "left").fillna(0, ["n"])
    return full.select(key, level, F.sum("n").over(W.partitionBy(key).orderBy(F.desc(level))).alias("n_at_least"))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, by its expansion beyond the first 32."""
    sums = [0.0]
    for i in range(1, 33):
        sums.append(sums[-1] + 1 / i)
    x = n.cast("double")
    euler = 0.57721566490153286
    far = F.log(x) + euler + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n <= 32, F.element_at(F.array(*[F.lit(s) for s in sums]), n.cast("int") + 1)).otherwise(far)


def adjust(df: DataFrame, p: str, by: list[str] = (), dependent: bool = False, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg, or with ``dependent`` Benjamini-Yekutieli, q-values within ``by``. Null p stay null.

    Tests with equal p share a q-value, so ranks are taken over distinct p and their counts.
    """
    keys = list(by)
    named = [F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]
    groups = [f"_g{i}" for i in range(len(keys))]
    n = df.filter(F.col(p).isNotNull()).groupBy(*named, F.col(p).alias("_p0")).agg(F.count("*").alias("_n"))
    n = running(n, groups, [F.asc("_p0")], {"_rank": ("sum", F.col("_n"))})
    alls = n.groupBy(*[F.col(g).alias(f"_h{g}") for g in groups]).agg(F.max("_rank").alias("_m"))
    if groups:
        same = F.col(groups[0]).eqNullSafe(F.col(f"_h{groups[0]}"))
        for g in groups[1:]:
            same = same & F.col(g).eqNullSafe(F.col(f"_h{g}"))
        n = n.join(alls, same)
    else:
        n = n.crossJoin(F.broadcast(alls))  # one row
    raw = F.col("_p0") * F.col("_m") / F.col("_rank") * (harmonic(F.col("_m")) if dependent else F.lit(1.0))
    q = running(n.select(*groups, "_p0", raw.alias("_raw")), groups, [F.desc("_p0")], {"_q0": ("min", F.col("_raw"))})
    cond = F.col(p) == F.col("_p0")
    for k, g in zip(keys, groups, strict=True):
        cond = cond & F.col(k).eqNullSafe(F.col(g))
    return df.join(q.select(*groups, "_p0", F.least(F.lit(1.0), "_q0").alias(out)), cond, "left").drop("_p0", *groups)


def average_rank(df: DataFrame, value: str, by: list[str] = (), out: str = "rank") -> DataFrame:
    """Ranks from 1, ties their mean, from the counts of distinct values. Null values and keys have no rank and go."""
    keys = list(by)
    n = df.dropna(subset=[*keys, value]).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = running(n, keys, [F.asc(value)], {"_upto": ("sum", F.col("_n"))})
    return df.join(upto.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out)), [*keys, value])


def top_n(df: DataFrame, n: int, order: list, by: list[str] = (), ties: bool = False) -> DataFrame:
    """The first rows within ``by``; Spark cuts each task's rows to them before the shuffle."""
    rank = F.rank() if ties else F.row_number()
    return df.withColumn("_r", rank.over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def top_fraction(df: DataFrame, fraction: float, column: str, by: list[str] = (), descending: bool = False) -> DataFrame:
    """Rows whose rank within ``by`` (ties the lowest) is within a share of the rows."""
    keys = list(by)
    n = df.dropna(subset=[*keys, column]).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    run = running(n, keys, [F.desc(column) if descending else F.asc(column)], {"_upto": ("sum", F.col("_n"))})
    alls = run.groupBy(*keys).agg(F.max("_upto").alias("_m"))
    run = run.join(alls, keys) if keys else run.crossJoin(F.broadcast(alls))  # one row
    return df.join(run.filter(F.col("_upto") - F.col("_n") + 1 <= F.col("_m") * fraction).select(*keys, column), [*keys, column], "left_semi")


def numbered(df: DataFrame, order: str | list[str], size: int | None = None, out: str = "id") -> DataFrame:
    """Ids from 1 in an order without ties, or batch numbers from 0 of ``size`` rows."""
    order = [order] if isinstance(order, str) else list(order)
    rows = running(df, [], [F.asc(c) for c in order], {"_at": ("sum", F.lit(1).cast("long"))})
    at = F.col("_at")
    return rows.withColumn(out, (at if size is None else F.floor((at - 1) / size)).cast("long")).drop("_at")


def complete_crosstab(df: DataFrame, row: str, column: str, rows: list[str], columns: list[str]) -> DataFrame:
    """Counts of all listed combinations, zeros included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(r, c) for r in rows for c in columns], f"{row} string, {column} string")
    return grid.join(df.groupBy(row, column).agg(F.count("*").alias("n")), [row, column], "left").fillna(0, ["n"])


def share_of_max(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Adds ``{c}_normalised``: each value over the largest within ``by``."""
    keys = list(by)
    tops = df.groupBy(*keys).agg(*[F.max(c).alias(f"_top_{c}") for c in columns])
    both = df.join(tops, keys) if keys else df.crossJoin(F.broadcast(tops))  # one row
    return both.withColumns({f"{c}_normalised": F.try_divide(F.col(c).cast("double"), F.col(f"_top_{c}")) for c in columns}).drop(*[f"_top_{c}" for c in columns])


def wide_deltas(df: DataFrame, key: list[str], label: str, value: str, labels: list[str], base: str) -> DataFrame:
    """One row per key with a column per label and ``delta_{label}`` to ``base``; keys whose deltas are all 0 or unknown go."""
    wide = df.groupBy(*key).pivot(label, labels).agg(F.avg(value))
    others = [x for x in labels if x != base]
    wide = wide.withColumns({f"delta_{x}": F.col(x) - F.col(base) for x in others})
    moved = F.lit(False)
    for x in others:
        moved = moved | F.coalesce(F.col(f"delta_{x}") != 0, F.lit(False))
    return wide.filter(moved)
