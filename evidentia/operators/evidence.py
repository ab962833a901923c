"""From detection records to scored pairs: roles, search space, counts, posteriors, edges.

All functions take and return DataFrames and name their columns by keyword; ids may be of any type that compares.
Rows with a null key are no evidence and are dropped where a key is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.operators import masks as M
from evidentia.operators.whole import valued_pairs
from evidentia.scratch import materialize


def normalise_roles(df: DataFrame, id_a: str, id_b: str, bait_a: Column, bait_b: Column, carry: list[str] = ()) -> DataFrame:
    """Rows with exactly one bait, as ``bait, prey`` and carried columns, without nulls and repeats."""
    one = F.coalesce(bait_a, F.lit(False)) != F.coalesce(bait_b, F.lit(False))
    out = df.filter(one).select(F.when(bait_a, F.col(id_a)).otherwise(F.col(id_b)).alias("bait"), F.when(bait_a, F.col(id_b)).otherwise(F.col(id_a)).alias("prey"), *carry)
    return out.dropna().distinct()


def join_dim_twice(df: DataFrame, dim: DataFrame, key: str, roles: tuple[str, str] = ("bait", "prey"), how: str = "inner") -> DataFrame:
    """A dimension joined for both roles; its other columns get the role as suffix. Spark broadcasts it when small."""
    for role in roles:
        named = dim.select(F.col(key).alias(role), *[F.col(c).alias(f"{c}_{role}") for c in dim.columns if c != key])
        df = df.join(named, role, how)
    return df


def evidence(ev: DataFrame, group: list[str], bait: str = "bait", prey: str = "prey") -> DataFrame:
    """Distinct rows without nulls, written once: give it to the functions below in place of ``ev`` to share them."""
    if getattr(ev, "_evidence", None) == (*group, bait, prey):
        return ev
    out = materialize(ev.select(*group, bait, prey).dropna().distinct(), "evidence")
    out._evidence = (*group, bait, prey)
    return out


def search_space(ev: DataFrame, group: list[str], bait: str = "bait", prey: str = "prey", allow_self: bool = False) -> DataFrame:
    """Every (bait, prey) that a group tested, with ``n_observed`` 0 or 1: baits times preys within the group.

    A large group is split into cells. Never materialise the product: aggregate_pairs and search_sizes count it.
    """
    seen = evidence(ev, group, bait, prey)
    tested = M.grid_join(seen.select(*group, bait).distinct(), seen.select(*group, prey).distinct(), group, bait, prey)
    if not allow_self:
        tested = tested.filter(F.col(bait) != F.col(prey))
    seen = seen.withColumn("n_observed", F.lit(1).cast("long"))
    return tested.join(seen, [*group, bait, prey], "left").withColumn("n_observed", F.coalesce("n_observed", F.lit(0).cast("long")))


def search_sizes(ev: DataFrame, group: list[str], bait: str = "bait", prey: str = "prey", allow_self: bool = False) -> DataFrame:
    """Per group ``baits, preys, tests, observed``: the size of its search space by arithmetic, without the product."""
    rows = evidence(ev, group, bait, prey)
    end = lambda c, x, y: F.struct(F.col(c).alias("id"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    ends = rows.select(*group, F.explode(F.array(end(bait, 1, 0), end(prey, 0, 1))).alias("e")).select(*group, "e.*")
    ids = ends.groupBy(*group, "id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    sizes = ids.groupBy(*group).agg(F.sum("x").alias("baits"), F.sum("y").alias("preys"), F.sum(F.col("x") * F.col("y")).alias("_self"))
    counted = F.lit(True) if allow_self else F.col(bait) != F.col(prey)
    seen = rows.groupBy(*group).agg(F.sum(counted.cast("long")).alias("observed"))
    tests = F.col("baits") * F.col("preys") - (F.lit(0) if allow_self else F.col("_self"))
    return sizes.join(seen, group).select(*group, "baits", "preys", tests.alias("tests"), "observed").filter("tests > 0")


def pair_totals(ev: DataFrame, group: list[str], by: list[str] = (), allow_self: bool = False) -> DataFrame:
    """``n_tested, n_observed`` over all pairs, or by keys of the group: what the prior needs, without the pair table."""
    return search_sizes(ev, group, allow_self=allow_self).groupBy(*by).agg(F.sum("tests").alias("n_tested"), F.sum("observed").alias("n_observed"))


def aggregate_pairs(ev: DataFrame, group: list[str], keys: list[str] = ("bait", "prey"), allow_self: bool = False) -> DataFrame:
    """``n_tested, n_observed`` per pair and further keys that are part of the group.

    Tests are the groups that a bait and a prey have in common, counted by bit masks; observations are summed apart
    and united with them, dealt by the same id where the join left the tests so.
    """
    keys = list(keys)
    extra = [k for k in keys if k not in ("bait", "prey")]
    rows = evidence(ev, group)
    tested, by, parts = M.common(rows.select(*group, "bait").distinct(), rows.select(*group, "prey").distinct(), list(group), "bait", "prey", extra)
    if not allow_self:
        tested, rows = tested.filter("bait <> prey"), rows.filter("bait <> prey")
    seen = rows.select(*keys, F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("o"))
    seen = seen.repartition(parts, by) if by else seen
    both = tested.select(*keys, "t", F.lit(0).cast("long").alias("o")).unionAll(seen)
    return both.groupBy(*keys).agg(F.sum("t").alias("n_tested"), F.sum("o").alias("n_observed"))


def pair_sources(ev: DataFrame, source: list[str]) -> DataFrame:
    """The sorted, joined list of sources that observed each pair."""
    return ev.groupBy("bait", "prey").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("_", *source))), ";").alias("sources"))


def tested_sources(ev: DataFrame, group: list[str], pairs: DataFrame, out: str = "sources") -> DataFrame:
    """Adds to ``pairs`` the sorted list, joined by semicolons, of the groups that tested them, observed or not.

    Only the pairs asked for are met: pairs take the groups of their bait, and keep those that have the prey too.
    """
    rows = evidence(ev, group)
    both = pairs.select("bait", "prey").join(rows.select(*group, "bait").distinct(), "bait")
    both = both.join(rows.select(*group, "prey").distinct(), [*group, "prey"], "left_semi")
    named = both.groupBy("bait", "prey").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("_", *group))), ";").alias(out))
    return pairs.join(named, ["bait", "prey"], "left")


def collapse_undirected(pairs: DataFrame, extra: list[str] = (), sources: str | None = None, first: str | None = None) -> DataFrame:
    """Both directions of a pair as one: ``a <= b``, sums, and the pair's id.

    The lists in ``sources`` are united, sorted and without repeats; of ``first`` the smallest value stays.
    """
    aggs = [F.sum("n_tested").alias("n_tested"), F.sum("n_observed").alias("n_observed")]
    if sources:
        aggs.append(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split(sources, ";"))))), ";").alias(sources))
    if first:
        aggs.append(F.min(first).alias(first))
    out = pairs.filter("bait <> prey").groupBy(F.least("bait", "prey").alias("a"), F.greatest("bait", "prey").alias("b"), *extra).agg(*aggs)
    return out.withColumn("pair_id", F.concat_ws("_", "a", "b"))


def posterior(pairs: DataFrame, pseudo_n: float = 1.0, prior_keys: list[str] = (), totals: DataFrame | None = None) -> DataFrame:
    """Beta-binomial shrinkage: ``alpha_post, beta_post, p``. The prior is the pooled rate, of all rows or by key.

    ``totals`` (see pair_totals) gives the rate without a second evaluation of the pairs.
    """
    by = list(prior_keys)
    totals = pairs if totals is None else totals
    rate = totals.groupBy(*by).agg((F.sum("n_observed") / F.sum("n_tested") * pseudo_n).alias("_a0"))
    with_prior = pairs.join(rate, by) if by else pairs.crossJoin(F.broadcast(rate))  # one row
    out = with_prior.withColumn("alpha_post", F.col("_a0") + F.col("n_observed")).withColumn("beta_post", pseudo_n - F.col("_a0") + F.col("n_tested") - F.col("n_observed"))
    return out.withColumn("p", F.col("alpha_post") / (pseudo_n + F.col("n_tested"))).drop("_a0")


def mean_ratio_prior(pairs: DataFrame, min_tested: int = 1, pseudo_n: float = 1.0, count: str | None = None) -> DataFrame:
    """One row ``prior_alpha, prior_beta``: the mean of pair rates over pairs tested more than ``min_tested`` times.
    A row stands for as many pairs as its ``count`` says."""
    n = F.col(count) if count else F.lit(1)
    few = pairs.filter(F.col("n_tested") > min_tested).agg((F.try_divide(F.sum(F.col("n_observed") / F.col("n_tested") * n), F.sum(n)) * pseudo_n).alias("prior_alpha"))
    return few.withColumn("prior_beta", pseudo_n - F.col("prior_alpha"))


def cutoffs(pairs: DataFrame, prior: DataFrame, high: float = 0.6, min_observations: int = 1) -> DataFrame:
    """``call`` positive above ``high``, negative below what ``min_observations`` missed tests leave of the prior; else dropped."""
    a, b = F.col("prior_alpha"), F.col("prior_beta")
    p = pairs.crossJoin(F.broadcast(prior)).withColumn("p", (a + F.col("n_observed")) / (a + b + F.col("n_tested")))  # one row
    call = F.when(F.col("p") > high, "positive").when(F.col("p") < a / (a + b + min_observations), "negative")
    return p.withColumn("call", call).filter("call is not null").drop("prior_alpha", "prior_beta")


def drop_single_pair_groups(ev: DataFrame, group: list[str]) -> DataFrame:
    """Without the groups that are left with one row after self pairs and repeats have gone."""
    rows = ev.filter("bait <> prey").select("bait", "prey", *group).distinct()
    return rows.join(rows.groupBy(*group).count().filter("count > 1").select(*group), group, "left_semi")


def keep_repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once."""
    return df.join(df.groupBy(*keys).count().filter("count > 1").select(*keys), keys, "left_semi")


def keep_single_valued(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of the groups that have exactly one distinct value."""
    return df.join(df.groupBy(*keys).agg(F.count_distinct(value).alias("_n")).filter("_n = 1").select(*keys), keys, "left_semi")


def select_edges(pod: DataFrame, positive: float, tested: int, score: str = "p") -> DataFrame:
    """``sign`` 1 for scores that reach the limit, 0 for pairs tested often and never observed; the rest goes."""
    sign = F.when(F.col(score) >= positive, 1).when((F.col("n_tested") >= tested) & (F.col("n_observed") == 0), 0)
    return pod.withColumn("sign", sign).filter("sign is not null")


def threshold_grid(pod: DataFrame, positives: list, tested: list[int], score: str = "p") -> DataFrame:
    """Edges under every pair of limits; the limit "all" takes whatever was observed."""
    grid = F.explode(F.array(*[F.struct(F.lit(str(p)).alias("pos_limit"), F.lit(t).alias("neg_limit")) for p in positives for t in tested]))
    rows = pod.withColumn("_g", grid).select(*pod.columns, "_g.*")
    high = F.when(F.col("pos_limit") == "all", F.col("n_observed") >= 1).otherwise(F.col(score) >= F.col("pos_limit").try_cast("double"))
    sign = F.when(high, 1).when((F.col("n_tested") >= F.col("neg_limit")) & (F.col("n_observed") == 0), 0)
    return rows.withColumn("sign", sign).filter("sign is not null")


def outer_fold(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer joins on the keys; what a frame has not is 0."""
    return reduce(lambda a, b: a.join(b, keys, "full"), frames).fillna(0)


def endpoint_degrees(pairs: DataFrame, a: str = "bait", b: str = "prey", positive: Column | None = None, negative: Column | None = None) -> DataFrame:
    """Per endpoint ``sum_tests, deg_pos, deg_neg, deg_tested``; each pair counts at both ends."""
    positive = F.col("n_observed") > 0 if positive is None else positive
    negative = F.col("n_observed") == 0 if negative is None else negative
    flagged = pairs.select("n_tested", positive.cast("long").alias("_p"), negative.cast("long").alias("_n"), F.explode(F.array(a, b)).alias("id"))
    return flagged.groupBy("id").agg(F.sum("n_tested").alias("sum_tests"), F.sum("_p").alias("deg_pos"), F.sum("_n").alias("deg_neg"), F.count("*").alias("deg_tested"))


def bin_fixed(df: DataFrame, column: str, low: float, high: float, out: str) -> DataFrame:
    """low up to ``low``, high above ``high``."""
    return df.withColumn(out, F.when(F.col(column) <= low, "low").when(F.col(column) > high, "high").otherwise("mid"))


def bin_quantiles(df: DataFrame, columns: dict[str, str], q: float = 0.25) -> DataFrame:
    """Per column, in the column it names: strictly above the upper quantile of all is high, strictly below the lower
    quantile of non-zero values low. All cuts are one aggregate; the table, read twice, is written once."""
    df = materialize(df, "binned")
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.percentile(c, F.lit(1 - q)).alias(f"_hi{i}"), F.percentile(F.when(F.col(c) != 0, F.col(c)), F.lit(q)).alias(f"_lo{i}")]
    both = df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row
    bins = [F.when(F.col(c) > F.col(f"_hi{i}"), "high").when(F.col(c) < F.col(f"_lo{i}"), "low").otherwise("mid").alias(out) for i, (c, out) in enumerate(columns.items())]
    return both.select(*df.columns, *bins)


def hub_status(df: DataFrame, positive: str = "pos_bin", negative: str = "neg_bin") -> DataFrame:
    inter = (F.col(positive) == "high") & (F.col(negative) == "low")
    non = (F.col(positive) == "low") & (F.col(negative) == "high")
    return df.withColumn("hub", F.when(inter, "interaction").when(non, "non_interaction").otherwise("none"))


def members(ev: DataFrame, key: str, member: str) -> DataFrame:
    """Distinct rows of both without nulls, written once: give it to shared_members in place of ``ev``."""
    if getattr(ev, "_members", None) == (key, member):
        return ev
    out = materialize(ev.select(key, member).dropna().distinct(), "members")
    out._members = (key, member)
    return out


def shared_members(ev: DataFrame, key: str, member: str, zeros: bool = True) -> DataFrame:
    """Members that two keys share, for pairs of keys in order; with ``zeros`` for all of them, as many as there are."""
    rows = members(ev, key, member)
    sizes = rows.groupBy(member).agg(F.count("*").alias("n"))
    most, work = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()
    if most <= M.CELL and rows.count() > M.MOST_BROADCAST:
        # neighbouring members tend to have the same keys: in ranges, most of their pairs are summed before the shuffle
        held = rows.repartitionByRange(M.tasks(rows, work // 4), member).groupBy(member).agg(F.array_sort(F.collect_list(key)).alias("_l"))
        each = held.select("_l", F.posexplode("_l").alias("_i", "x")).select("x", F.explode(F.expr("slice(_l, _i + 2, size(_l))")).alias("y"))
        met = each.groupBy("x", "y").agg(F.count("*").alias("n_shared"))
    else:
        x, y = rows.select(F.col(key).alias("x"), member), rows.select(F.col(key).alias("y"), member)
        met, _, _ = M.common(x, y, [member], "x", "y")
        met = met.filter("x < y").groupBy("x", "y").agg(F.sum("t").alias("n_shared"))
    if not zeros:
        return met
    return valued_pairs(rows.select(key).distinct(), met, "x", "y", "n_shared")


def entropy_share(ev: DataFrame, group: list[str], key: str, over: str) -> DataFrame:
    """Per key: counts normalised within the group, summed by ``over``; their entropy (nats) and largest share."""
    n = ev.groupBy(*group, over, key).agg(F.count("*").alias("n"))
    sizes = ev.dropna(subset=list(group)).groupBy(*group).agg(F.count("*").alias("_all"))
    n = n.join(sizes, group).withColumn("share", F.col("n") / F.col("_all"))
    s = n.groupBy(key, over).agg(F.sum("share").alias("s"))
    s = s.withColumn("p", F.col("s") / F.sum("s").over(W.partitionBy(key)))
    return s.groupBy(key).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.max("p").alias("max_share"))


def prey_weighted_prior(pairs: DataFrame, strength: float = 1 / 3, totals: DataFrame | None = None) -> DataFrame:
    """Per prey, the mean of pair rates shrunk to the pooled one, weighted by the bait's share of the prey's tests.

    The weights' sum divides out of the mean, so no window is needed; ``totals`` gives the pooled rate.
    """
    pool = (pairs if totals is None else totals).agg((F.sum("n_observed") / F.sum("n_tested")).alias("_r"))
    p = (F.col("n_observed") + strength * F.col("_r")) / (F.col("n_tested") + strength)
    sums = pairs.crossJoin(F.broadcast(pool)).groupBy("prey").agg(F.sum(F.col("n_tested") * p).alias("_s"), F.sum("n_tested").alias("n_tested"))  # one row
    return sums.select("prey", (F.col("_s") / F.col("n_tested")).alias("weighted_p"), "n_tested")


def cell_prey_prior(pairs: DataFrame, cell: str = "cvcl", strength: float = 1 / 3) -> DataFrame:
    """Per prey and cell line: ``prey_p``, the mean over baits of the cell line's rate, weighted by its tests there.

    A bait's rate in a cell line is drawn towards its own counts pooled over all cell lines, ``strength`` of which are
    the prior. Also ``n_tested, n_observed`` there and ``total_tested, total_observed`` of the prey's baits.
    """
    own = pairs.groupBy("bait", "prey").agg(F.sum("n_tested").alias("_t"), F.sum("n_observed").alias("_o"))
    both = pairs.join(own, ["bait", "prey"])
    alpha, beta = strength * F.col("_o") + F.col("n_observed"), strength * (F.col("_t") - F.col("_o")) + F.col("n_tested") - F.col("n_observed")
    sums = both.groupBy("prey", cell).agg(F.sum(F.col("n_tested") * alpha / (alpha + beta)).alias("_s"), F.sum("n_tested").alias("n_tested"), F.sum("n_observed").alias("n_observed"))
    whole = own.groupBy("prey").agg(F.sum("_t").alias("total_tested"), F.sum("_o").alias("total_observed"))
    return sums.join(whole, "prey").select("prey", cell, (F.col("_s") / F.col("n_tested")).alias("prey_p"), "n_tested", "n_observed", "total_tested", "total_observed")


def untested_corrected_degree(pod: DataFrame, n_preys: int | Column, a: str = "bait", totals: DataFrame | None = None) -> DataFrame:
    """Expected degree: the sum of p over tested partners and the prior for those never tested."""
    prior = (pod if totals is None else totals).agg((F.sum("n_observed") / F.sum("n_tested")).alias("_prior"))
    d = pod.groupBy(a).agg(F.sum("p").alias("_p"), F.count("*").alias("n_partners"))
    rest = F.greatest(F.lit(0), n_preys - F.col("n_partners"))
    return d.crossJoin(F.broadcast(prior)).select(a, "n_partners", (F.col("_p") + rest * F.col("_prior")).alias("expected_degree"))  # one row


def bounded_degrees(pod: DataFrame, n_baits: int | Column, n_preys: int | Column, prior: dict[str, Column]) -> DataFrame:
    """Per id and role, ``degree_{k}`` for each of mean, lo and hi in ``prior``: the sum of that column over its tested
    partners and the prior's value for each partner never tested. An id without a role has that role's prior alone."""
    ends = pod.select(*prior, F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("id")) for r in ("bait", "prey")])).alias("e"))
    sums = ends.select(*prior, "e.*").groupBy("role", "id").agg(F.count("*").alias("n_pairs"), *[F.sum(k).alias(k) for k in prior])
    return degrees_with_rest(sums, n_baits, n_preys, prior)


def degrees_with_rest(sums: DataFrame, n_baits: int | Column, n_preys: int | Column, prior: dict[str, Column]) -> DataFrame:
    """bounded_degrees from ``role, id, n_pairs`` and the sums of the columns in ``prior``."""
    out = sums.select("id").distinct()
    for role, n in (("bait", n_preys), ("prey", n_baits)):
        own = sums.filter(F.col("role") == role).select("id", F.col("n_pairs").alias("_n"), *[F.col(k).alias(f"_{k}") for k in prior])
        n = n if isinstance(n, Column) else F.lit(n)
        rest = F.greatest(F.lit(0), n - F.coalesce("_n", F.lit(0)))
        out = out.join(own, "id", "left").withColumns({f"{k}_{role}": F.coalesce(F.col(f"_{k}"), F.lit(0.0)) + rest * v for k, v in prior.items()}).drop("_n", *[f"_{k}" for k in prior])
    return out
