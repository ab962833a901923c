"""Tests, intervals, resampling and correlations as aggregates. Randomness is a hash of the row's key and a seed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.special import normal_tail, t_quantile
from evidentia.operators.masks import tasks
from evidentia.operators.windows import adjust, average_rank, numbered
from evidentia.scratch import materialize, running, ship

#: Rows of per-node counts that may be broadcast.
MOST_NODES = 500_000


def hash_unit(*keys: Column) -> Column:
    """A uniform number in [0, 1) that the keys decide, the same in SQL: the first 13 hexadecimal digits of an MD5."""
    text = F.concat_ws("_", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


#: A prime below 2**31: products of two residues fit 64 bits.
PRIME = 2**31 - 1


def draw(*keys: Column) -> Column:
    """A uniform number in [0, 1) from whole numbers of 0 and more, for many replicates: arithmetic alone, as in SQL."""
    x = F.lit(20_011).cast("long")
    for k in keys:
        x = (x * 16_807 + k.cast("long") % PRIME * 48_271 + 1) % PRIME
        x = (x * (x + 69_621)) % PRIME
    return (x * (x + 40_692)) % PRIME / float(PRIME)


def draw_sql(source: str, keys: list[str], out: str = "u") -> str:
    """The rows of the SQL query ``source`` with the same draw, step by step."""
    q = f"SELECT *, 20011::BIGINT AS _x FROM ({source})"
    for k in keys:
        q = f"SELECT * REPLACE ((_x * 16807 + ({k})::BIGINT % {PRIME} * 48271 + 1) % {PRIME} AS _x) FROM ({q})"
        q = f"SELECT * REPLACE ((_x * (_x + 69621)) % {PRIME} AS _x) FROM ({q})"
    return f"SELECT * EXCLUDE (_x), ((_x * (_x + 40692)) % {PRIME})::DOUBLE / {float(PRIME)}::DOUBLE AS {out} FROM ({q})"


def rank_sum_auc(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks."""
    r = average_rank(df, score, by)
    g = r.groupBy(*by).agg(F.sum(F.when(F.col(label) == 1, F.col("rank"))).alias("s"), F.sum((F.col(label) == 1).cast("long")).alias("n_pos"), F.sum((F.col(label) == 0).cast("long")).alias("n_neg"))
    return g.withColumn("auc", (F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))).drop("s")


def mann_whitney(df: DataFrame, value: str, flag: str, by: list[str] = ()) -> DataFrame:
    """U of the flagged rows, two-sided p and per cent difference of means.

    Normal approximation with ties and continuity; exact when a side has eight rows or fewer and nothing is tied.
    """
    ship(df.sparkSession)
    r = average_rank(df.filter(F.col(value).isNotNull() & F.col(flag).isNotNull()), value, by)
    ties = r.groupBy(*by, value).agg(F.count("*").alias("t"), F.sum(F.when(F.col(flag), F.col("rank"))).alias("r"), F.sum(F.col(flag).cast("long")).alias("k"), F.sum(F.when(F.col(flag), F.col(value))).alias("s"), F.sum(F.when(~F.col(flag), F.col(value))).alias("s2"))
    t = F.col("t").cast("double")
    g = ties.groupBy(*by).agg(F.sum("r").alias("rank_sum"), F.sum("k").alias("n1"), (F.sum("t") - F.sum("k")).alias("n2"), F.sum(t * t * t - t).alias("ties"), F.sum("s").alias("s1"), F.sum("s2").alias("s2"))
    g = g.withColumn("u", F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2)
    m1, m2 = F.col("s1") / F.col("n1"), F.col("s2") / F.col("n2")
    g = g.withColumn("mean_difference_pct", F.try_divide(m1 - m2, F.abs(m2)) * 100)

    @F.pandas_udf("double")
    def p(u: pd.Series, n1: pd.Series, n2: pd.Series, tied: pd.Series) -> pd.Series:
        return pd.Series([u_test_p(*row) for row in zip(u, n1, n2, tied, strict=True)])

    return g.withColumn("p_value", p("u", "n1", "n2", "ties")).drop("rank_sum", "s1", "s2", "ties")


def u_test_p(u: float, n1: int, n2: int, tied: float) -> float:
    n1, n2 = sorted((int(n1), int(n2)))
    if not n1:
        return float("nan")
    big = max(u, n1 * n2 - u)
    if n1 <= 8 and not tied:
        # counts of U by its generating function, whose factors are as many as the smaller sample
        ways = np.zeros(n1 * n2 + 1)
        ways[0] = 1
        for i in range(1, n1 + 1):
            k = n2 + i
            ways[k:] -= ways[:-k].copy() if k <= n1 * n2 else 0
            for s in range(i):
                ways[s::i] = np.cumsum(ways[s::i])
        return float(min(1.0, 2 * ways[int(big) :].sum() / ways.sum()))
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - tied / (n * (n - 1))))
    return min(1.0, 2 * normal_tail((big - n1 * n2 / 2 - 0.5) / sd)) if sd else 1.0


def against_first(df: DataFrame, value: str, level: str, levels: list) -> DataFrame:
    """Mann-Whitney tests of the first level against each other one: ``other`` and what mann_whitney gives."""
    first, others = levels[0], levels[1:]
    zero = df.filter(F.col(level) == first).withColumn("other", F.explode(F.array(*[F.lit(x) for x in others])))
    rows = zero.unionByName(df.filter(F.col(level).isin(others)).withColumn("other", F.col(level)))
    return mann_whitney(rows.withColumn("_f", F.col(level) == first), value, "_f", ["other"])


def spearman(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Rank and linear correlation within ``by`` over rows where both are known."""
    keys = list(by)
    df = materialize(df.dropna(subset=[x, y]), "pairs")
    r = average_rank(average_rank(df, x, keys, out="_rx"), y, keys, out="_ry")
    return r.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("spearman"), F.corr(x, y).alias("pearson"), F.count("*").alias("n"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``x, y, spearman`` for every ordered pair of columns, unknown values as 0."""
    df = materialize(df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]), "matrix")
    for c in columns:
        df = average_rank(df, c, out=f"_r_{c}")
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(f"_r_{a}", f"_r_{b}").alias("spearman")) for a in columns for b in columns if a < b]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def wasserstein(df: DataFrame, x: str, y: str) -> DataFrame:
    """L1 distance of the two columns' distribution functions."""
    both = df.select(F.explode(F.array(F.struct(F.col(x).cast("double").alias("v"), F.lit(1).alias("k")), F.struct(F.col(y).cast("double").alias("v"), F.lit(-1).alias("k")))).alias("e")).select("e.*")
    by = both.groupBy("v").agg(F.sum("k").alias("k"), F.count("*").alias("c"))
    by = running(by, [], [F.asc("v")], {"_f": ("sum", F.col("k"))})
    by = running(by, [], [F.desc("v")], {"_next": ("min", F.col("v"))}, inclusive=False)
    area = F.abs(F.col("_f")) * (F.col("_next") - F.col("v"))
    return by.agg((F.coalesce(F.sum(area), F.lit(0.0)) / (F.sum("c") / 2)).alias("wasserstein"))


def group_interval(df: DataFrame, value: str, by: list[str], level: float = 0.975) -> DataFrame:
    """Mean, standard error and t interval per group."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def t(n: pd.Series) -> pd.Series:
        few = {k: float(t_quantile(level, np.array([k - 1.0]))[0]) if k > 1 else float("nan") for k in n.unique()}
        return n.map(few)

    g = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    return g.withColumn("_t", t("n")).select(*by, "mean", "n", "se", (F.col("mean") - F.col("_t") * F.col("se")).alias("lo"), (F.col("mean") + F.col("_t") * F.col("se")).alias("hi"))


def _draws(ids: DataFrame, n: int, replicates: int, seed: int) -> DataFrame:
    """``rep, at``: n draws with replacement from ``ids`` (``at``, from 1 to n) for each replicate, over tasks of some millions."""
    dealt = ids.repartition(tasks(ids, n * replicates), "at")
    draws = dealt.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return draws.select("rep", (F.floor(draw(F.col("at"), F.col("rep"), F.lit(seed)) * n) + 1).cast("long").alias("at"))


def _drawn_nodes(nodes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``rep, at, w``: how often each of the n nodes, numbered from 1, comes up in n draws with replacement.

    Replicate 0 is the sample itself. Draws are spread over tasks by node and replicate, and counted before any join.
    """
    ids = nodes.select("at")
    drawn = _draws(ids, nodes.count(), replicates, seed).groupBy("rep", "at").agg(F.count("*").alias("w"))
    return drawn.unionByName(ids.select(F.lit(0).alias("rep"), "at", F.lit(1).cast("long").alias("w")))


def node_bootstrap(edges: DataFrame, a: str, b: str, flag: str | list[str], label: str, replicates: int = 5_000, seed: int = 1) -> DataFrame:
    """Odds ratio of a flag's rate among positive and among negative edges, with an interval over resampled nodes.

    Nodes are drawn with replacement, as many as there are. Each edge counts at both ends. Per ``flag`` column:
    ``variable, rate_pos, rate_neg, odds_ratio, lo, hi, p_value, q_value``: p is twice the smaller tail, one replicate at
    least; q is adjusted over the variables of the call.
    """
    flags = [flag] if isinstance(flag, str) else list(flag)
    ends = edges.select(F.explode(F.array(a, b)).alias("node"), (F.col(label) == 1).cast("long").alias("_l"), *[F.col(f).cast("long").alias(f"_f{i}") for i, f in enumerate(flags)])
    sums = [F.sum("_l").alias("np"), F.sum(1 - F.col("_l")).alias("nn")]
    for i in range(len(flags)):
        sums += [F.sum(F.col("_l") * F.col(f"_f{i}")).alias(f"p{i}"), F.sum((1 - F.col("_l")) * F.col(f"_f{i}")).alias(f"n{i}")]
    nodes = materialize(numbered(ends.groupBy("node").agg(*sums), "node", out="at"), "nodes")
    counts = [c for c in nodes.columns if c not in ("node", "at")]
    n = nodes.count()
    nodes_at = F.broadcast(nodes.select("at", *counts)) if n <= MOST_NODES else nodes.select("at", *counts).hint("merge")
    # a draw is joined where it is made and summed by its replicate at once: whole numbers, whose sums are exact in any order
    reps = _draws(nodes.select("at"), n, replicates, seed).join(nodes_at, "at").groupBy("rep").agg(*[F.sum(c).alias(c) for c in counts])
    reps = reps.unionByName(nodes.select(F.lit(0).alias("rep"), *counts).groupBy("rep").agg(*[F.sum(c).alias(c) for c in counts]))
    reps = materialize(reps.select("rep", *[F.col(c).cast("double").alias(c) for c in counts]), "replicates")
    rate = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n)).otherwise(0.0)
    odds = lambda r: F.greatest(r / F.greatest(1 - r, F.lit(1e-10)), F.lit(1e-10))
    each = F.array(*[F.struct(F.lit(f).alias("variable"), rate(f"p{i}", "np").alias("rp"), rate(f"n{i}", "nn").alias("rn")) for i, f in enumerate(flags)])
    v = reps.select("rep", F.explode(each).alias("e")).select("rep", "e.*").withColumn("v", F.log(odds(F.col("rp"))) - F.log(odds(F.col("rn"))))
    boot, own = F.when(F.col("rep") > 0, F.col("v")), lambda c: F.max(F.when(F.col("rep") == 0, F.col(c)))
    tails = [F.sum(F.when(F.col("rep") > 0, x.cast("long"))) for x in (F.col("v") < 0, F.col("v") > 0)]
    p = F.greatest(F.lit(1 / replicates), F.least(F.lit(1.0), 2 * F.least(*tails) / replicates))
    out = v.groupBy("variable").agg(own("rp").alias("rate_pos"), own("rn").alias("rate_neg"), F.exp(own("v")).alias("odds_ratio"), F.exp(F.percentile(boot, F.lit(0.025))).alias("lo"), F.exp(F.percentile(boot, F.lit(0.975))).alias("hi"), p.alias("p_value"))
    return adjust(out, "p_value", out="q_value")


def weighted_difference_bootstrap(edges: DataFrame, a: str, b: str, value: str, label: str, replicates: int = 2_000, seed: int = 1) -> DataFrame:
    """Difference of the mean value of positive and negative edges, with an interval over resampled nodes.

    In a replicate an edge weighs the product of how often its two ends were drawn; edges are joined by both ends.
    """
    known = edges.dropna(subset=[a, b, value, label])
    nodes = materialize(numbered(known.select(F.explode(F.array(a, b)).alias("node")).distinct(), "node", out="at"), "nodes")
    rows = known.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(value).cast("double").alias("_v"), (F.col(label) == 1).alias("_l"))
    for c in ("a", "b"):
        rows = rows.join(nodes.select(F.col("node").alias(f"_{c}"), F.col("at").alias(f"_{c}t")), f"_{c}")
    rows = materialize(rows.groupBy("_at", "_bt", "_l").agg(F.sum("_v").alias("_v"), F.count("*").alias("_n")), "edges")
    drawn = materialize(_drawn_nodes(nodes, replicates, seed), "drawn")
    side = lambda c: drawn.select(F.col("rep").alias("rep"), F.col("at").alias(f"_{c}t"), F.col("w").alias(f"_w{c}"))
    reps = rows.join(side("a"), "_at").join(side("b"), ["rep", "_bt"]).withColumn("_w", F.col("_wa") * F.col("_wb"))
    part = lambda on, c: F.sum(F.when(on, F.col("_w") * F.col(c)))
    mean = lambda on: part(on, "_v") / part(on, "_n")
    diff = reps.groupBy("rep").agg((mean(F.col("_l")) - mean(~F.col("_l"))).alias("d"))
    boot = F.when(F.col("rep") > 0, F.col("d"))
    return diff.agg(F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("difference"), F.percentile(boot, F.lit(0.025)).alias("lo"), F.percentile(boot, F.lit(0.975)).alias("hi"), F.count(boot).alias("replicates"))


def subsample_interval(df: DataFrame, key: str, group: str, value: str, replicates: int = 100_000, fraction: float = 0.8, seed: int = 1) -> DataFrame:
    """Percentile interval of the grouped mean over subsamples without replacement; a row is in by a draw of its key."""
    reps = df.select(key, group, value).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    inside = reps.filter(draw(F.col(key), F.col("rep"), F.lit(seed)) < fraction)
    means = inside.groupBy(group, "rep").agg(F.avg(value).alias("m"))
    return means.groupBy(group).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.count("*").alias("replicates"))


def extreme_mean_test(df: DataFrame, key: str, order: str, value: str, naive: str, top: int = 50, share: float = 0.9, permutations: int = 1_000_000, seed: int = 1) -> DataFrame:
    """Is the mean value of the top rows by ``order`` extreme against subsamples of the top rows by ``naive``?

    ``mean_value, naive_mean, p_value``: the share of subsamples (round(share * top) rows each, without replacement) that lie
    farther from their mean than the tested one. Ties go to the smaller key. Only ``top`` rows are carried on.
    """
    tested = df.orderBy(F.desc(order), key).limit(top).agg(F.avg(value).alias("mean_value"))
    base = df.orderBy(F.desc(naive), key).limit(top).select(key, F.col(value).cast("double").alias("_v"))
    held = base.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), "_v"))).alias("h"))  # ``top`` rows
    reps = df.sparkSession.range(1, permutations + 1).withColumnRenamed("id", "rep").crossJoin(F.broadcast(held))  # one row
    keep = F.round(F.lit(share) * F.size("h")).cast("int")
    shuffled = F.sort_array(F.transform("h", lambda x: F.struct(draw(x["k"], F.col("rep"), F.lit(seed)).alias("u"), x["k"].alias("k"), x["_v"].alias("v"))))
    mean = F.aggregate(F.slice(shuffled, F.lit(1), keep), F.lit(0.0), lambda a, x: a + x["v"]) / keep
    means = materialize(reps.select(mean.alias("m")), "means")
    centre = means.agg(F.avg("m").alias("naive_mean"))
    both = tested.crossJoin(F.broadcast(centre))  # one row each
    far = means.crossJoin(F.broadcast(both)).agg(F.max("mean_value").alias("mean_value"), F.max("naive_mean").alias("naive_mean"), F.avg((F.abs(F.col("m") - F.col("naive_mean")) > F.abs(F.col("mean_value") - F.col("naive_mean"))).cast("double")).alias("p_value"))
    return far


def over_representation(terms: DataFrame, chosen: DataFrame, universe: DataFrame, key: str, term: str) -> DataFrame:
    """Per term: members chosen and in all, the one-sided hypergeometric p, and q over the terms."""
    from evidentia.functions.special import fisher

    rows = terms.select(key, term).dropna().distinct().join(universe.select(key).distinct(), key, "left_semi")
    inside = rows.join(chosen.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    t = inside.groupBy(term).agg(F.count("_in").alias("n_chosen"), F.count("*").alias("n_term"))
    sizes = universe.select(key).distinct().join(chosen.select(key).distinct().withColumn("_in", F.lit(1)), key, "left").agg(F.count("_in").alias("_c"), F.count("*").alias("_u"))
    t = t.crossJoin(F.broadcast(sizes))  # one row
    t = t.withColumns({"_b": F.col("_c") - F.col("n_chosen"), "_t": F.col("n_term") - F.col("n_chosen"), "_d": F.col("_u") - F.col("_c") - F.col("n_term") + F.col("n_chosen")})
    return adjust(fisher(t, "n_chosen", "_b", "_t", "_d", "greater").drop("_b", "_t", "_d", "_c", "_u", "odds_ratio"), "p_value", out="q_value")


def mixture(df: DataFrame, weight: str, mean: str, sd: str, by: list[str]) -> DataFrame:
    """Mean and variance of a mixture of components weighted by tests; components without a mean count for nothing."""
    w = F.when(F.col(mean).isNotNull(), F.col(weight))
    m1 = F.sum(w * F.col(mean)) / F.sum(w)
    m2 = F.sum(w * (F.col(sd) * F.col(sd) + F.col(mean) * F.col(mean))) / F.sum(w)
    return df.groupBy(*by).agg(m1.alias("mix_mean"), (m2 - m1 * m1).alias("mix_var"))


def mixture_of(columns: list[str], mean: str = "mean_{}", sd: str = "sd_{}", weight: str = "n_tested_{}") -> dict[str, Column]:
    """``mixture_mean, mixture_var`` over components in columns, weighted by tests; unknown components count for nothing
    but their tests stay in the total."""
    w = {c: F.coalesce(F.col(weight.format(c)), F.lit(0)).cast("double") for c in columns}
    total = sum(w.values(), F.lit(0.0))
    m = sum((F.coalesce(F.col(mean.format(c)) * w[c] / F.nullif(total, F.lit(0.0)), F.lit(0.0)) for c in columns), F.lit(0.0))
    term = lambda c: F.coalesce((F.col(sd.format(c)) * F.col(sd.format(c)) + (F.col(mean.format(c)) - m) * (F.col(mean.format(c)) - m)) * w[c] / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    return {"mixture_mean": m, "mixture_var": sum((term(c) for c in columns), F.lit(0.0))}
