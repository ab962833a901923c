"""Sums over all pairs from classes of ids, against the pair table; queries that need no pair table make none."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import special
from evidentia.operators import detection as D
from evidentia.operators import evidence as E
from evidentia.operators import masks as M
from evidentia.operators import stats as S
from evidentia.operators import tiles as T
from evidentia.plans import analyses, catalog, exchange  # noqa: F401  they register their queries

SF = "/root/testdata/sf0.001"
COUNTED = "weight_distribution bound_histogram bin_crosstab bin_max average_rank wasserstein_degree bounded_degrees accumulation_curve accumulation_means class_rates cell_calls flagged_contingency".split()


@pytest.fixture(scope="module")
def found(spark):
    """Evidence with ids in both roles, self pairs, ids of equal groups and a key."""
    rng = random.Random(5)
    rows = [(rng.randrange(70), "uv"[rng.random() < 0.3], rng.randrange(12), rng.randrange(30)) for _ in range(900)]
    rows += [(g, c, b + 100, p + 100) for g, c, b, p in rows]
    return E.evidence(spark.createDataFrame(rows, "study int, cell string, bait long, prey long"), ["study", "cell"])


@pytest.mark.parametrize("most", [T.MOST_GROUPS, 3])
def test_equal_the_pair_table(found, monkeypatch, most):
    monkeypatch.setattr(T, "MOST_GROUPS", most)
    group, got = ["study", "cell"], lambda d: sorted(map(tuple, d.collect()))
    for keys in ([], ["cell"]):
        pairs = E.aggregate_pairs(found, group, [*keys, "bait", "prey"]).localCheckpoint()
        by = [*keys, "n_tested", "n_observed"]
        m = found.select("prey").distinct().filter("prey % 2 = 0").withColumn("x", F.col("prey") * 3)
        right = pairs.join(m, "prey", "left").groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x"))
        assert got(T.pair_counts(found, group, keys, m).select(right.columns)) == got(right)
        ends = pairs.select(*keys, "n_tested", "n_observed", F.lit("bait").alias("role"), F.col("bait").alias("id")).unionAll(pairs.select(*keys, "n_tested", "n_observed", F.lit("prey"), "prey"))
        right = ends.groupBy(*keys, "role", "id").agg(F.count("*").alias("n_pairs"), F.sum("n_tested").alias("t"), F.sum(F.col("n_observed") * F.col("n_tested")).alias("ot"))
        assert got(T.pair_sums(found, group, {"t": lambda t, o: t, "ot": lambda t, o: o * t}, keys=keys).select(right.columns)) == got(right)


def test_flagged_totals(found, spark):
    listed = found.filter("bait < 4").select("bait", "prey").unionAll(spark.createDataFrame([(5, 7), (5, 5), (5, 999)], "bait long, prey long"))
    pairs = E.aggregate_pairs(found, ["study", "cell"])
    flagged = pairs.join(listed.distinct().withColumn("y", F.lit(True)), ["bait", "prey"], "left").groupBy(F.coalesce("y", F.lit(False)).alias("f"))
    right = sorted(map(tuple, flagged.agg(F.sum("n_tested"), F.sum("n_observed")).collect()))
    assert sorted(map(tuple, T.flagged_totals(found, ["study", "cell"], listed, "f").collect())) == right


@pytest.mark.parametrize("name", COUNTED)
def test_make_no_pair_table(spark, monkeypatch, name):
    def made(*args, **kwargs):
        raise AssertionError("a pair table")

    monkeypatch.setattr(E, "aggregate_pairs", made)
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["bait_tests", "detection_model"])
def test_make_no_grid(spark, monkeypatch, name):
    def made(*args, **kwargs):
        raise AssertionError("a grid of baits by genes")

    monkeypatch.setattr(D, "grid_join", made)
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_bounds_are_made_of_counts(spark, monkeypatch):
    """Not of pairs, which would be written several times."""
    seen, bounds = [], special.with_bounds
    monkeypatch.setattr(special, "with_bounds", lambda df, by, **k: seen.append(df.columns) or bounds(df, by, **k))
    assert catalog.QUERIES["cell_bounds_mass"](spark, SF).count() > 0
    assert len(seen) == 1 and not {"bait", "prey"} & set(seen[0])


def test_signs_make_no_pairs_that_share_nothing(spark, monkeypatch):
    """Blocks of baits without preys in common: most pairs share none, and both limits are 0."""
    rows = [(b, 100 * (b // 4) + p) for b in range(40) for p in range(5) if (b + p) % 3]
    e = spark.createDataFrame(rows, "bait long, prey long")
    full = E.shared_members(e, "bait", "prey").filter("n_shared > 0")
    right = sorted((r["x"], r["y"], 1) for r in full.collect())

    def made(*args):
        raise AssertionError("all pairs of baits")

    monkeypatch.setattr(M, "ordered_pairs", made)
    assert sorted(map(tuple, catalog.shared_signs(e).collect())) == right
    monkeypatch.setattr(M, "MOST_BROADCAST", 0)  # as for large tables: lists of ranges
    assert sorted(map(tuple, catalog.shared_signs(e).collect())) == right


@pytest.mark.parametrize("most", [T.MOST_GROUPS, 3])
def test_selected_edges(found, monkeypatch, most):
    """Limits by which signs of pairs never observed are of either kind, of one or of none."""
    monkeypatch.setattr(T, "MOST_GROUPS", most)
    group = ["study", "cell"]
    pod = E.posterior(E.aggregate_pairs(found, group)).localCheckpoint()
    for positive, tested, wide in ((0.02, 3, 8_192), (0.02, 3, 5), (0.3, 12, 8_192), (0.9, 99, 8_192)):
        right = sorted(map(tuple, E.select_edges(pod, positive, tested).select("bait", "prey", "sign").collect()))
        assert sorted(map(tuple, T.selected_edges(found, group, positive, tested, wide).collect())) == right


def test_edges_make_no_pair_table(spark, monkeypatch):
    def made(*args, **kwargs):
        raise AssertionError("a pair table")

    monkeypatch.setattr(E, "aggregate_pairs", made)
    assert catalog.QUERIES["hci_hcni_edges"](spark, SF).count() > 0


@pytest.mark.parametrize(("changed", "turned"), [({}, False), ({"MOST_BROADCAST": 0}, True), ({"MOST_WORDS": 0}, False)])
def test_valued_pairs(found, monkeypatch, changed, turned):
    """All pairs with values by their counts, in several blocks of baits or of preys."""
    for k, v in changed.items():
        monkeypatch.setattr(T, k, v)
    group, by = ["study", "cell"], ["cell", "n_tested", "n_observed"]
    ends = ["prey", "bait"] if turned else ["bait", "prey"]
    rows = found.select(*group, *[F.col(c).alias(k) for c, k in zip(("bait", "prey"), ends, strict=True)])
    more = rows.filter("study < 9").select(*group, *[F.explode(F.sequence(F.lit(0), F.lit(90 * (k == ends[0])), F.lit(3))).alias("_n") if k == ends[0] else F.col(k) for k in ("bait", "prey")])
    rows = E.evidence(rows.unionByName(more.withColumnRenamed("_n", ends[0]).withColumn(ends[0], F.col(ends[0]).cast("long") + 200)), group)
    right = E.aggregate_pairs(rows, group, ["cell", "bait", "prey"])
    right = sorted((*r, r["n_tested"] * 7 + r["n_observed"]) for r in right.select("cell", "bait", "prey", "n_tested", "n_observed").collect())
    p = T.Profile(rows, group, ["cell"])
    values = T.counts_met(p).withColumn("v", F.col("n_tested") * 7 + F.col("n_observed"))
    got = T.valued_pairs(p, values, True).select("cell", "bait", "prey", "n_tested", "n_observed", "v").collect()
    assert len(got) == len(right) > 1_000 and sorted(map(tuple, got)) == right


def test_masses_are_looked_up_where_pairs_are_made(spark, monkeypatch):
    def made(*args, **kwargs):
        raise AssertionError("a pair table")

    monkeypatch.setattr(E, "aggregate_pairs", made)
    assert catalog.QUERIES["cell_bounds_mass"](spark, SF).count() > 0


def test_observed_pairs_are_shuffled_once(found, monkeypatch):
    """With masks of preys too many to broadcast; those of baits are."""
    p = T.Profile(found, ["study", "cell"], ["cell"])
    right = sorted(map(tuple, p.observed().collect()))
    monkeypatch.setattr(T.Profile, "_small", lambda self, role: role == "bait")
    spark = found.sparkSession
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = p.observed()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # pairs, masks
        assert sorted(map(tuple, p.observed().collect())) == right
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_lines_are_shuffled_twice_for_cell_lines(spark):
    """Dealt by order, then as evidence; with studies by number, the sums by prey and cell line need no further shuffle."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for numbers in (False, True):
            lines = catalog.ev_cell(spark, SF, *[True] * numbers)._jdf.queryExecution().executedPlan().toString().split("\n")
            at = next(i for i, x in enumerate(lines) if "l_suppkey" in x and "FileScan" in x)
            above, depth = [], lines[at].index("FileScan")
            for x in reversed(lines[:at]):  # the operators on the way up
                here = len(x) - len(x.lstrip(" :+-"))
                if x.strip() and here < depth:
                    above.append(x)
                    depth = here
            assert sum("Exchange hashpartitioning" in x for x in above) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_draws_are_summed_where_they_are_made(spark, monkeypatch):
    """By replicate, whole: not counted by replicate and node, which are nearly as many as draws."""
    edges = [(a, b, (a * b) % 3 == 1, int((a + 2 * b) % 5 < 3)) for a in range(9) for b in range(a)]
    g = spark.createDataFrame(edges, "a long, b long, x boolean, y int")
    nodes, n = S.numbered(g.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", out="at"), 9
    at = {r["at"]: r["node"] for r in nodes.collect()}
    made = S._drawn_nodes(nodes, 60, 1).collect()
    ends = [(v, x, y) for a, b, x, y in edges for v in (a, b)]
    rates = {}
    for rep in range(61):
        w = {at[r["at"]]: r["w"] for r in made if r["rep"] == rep}
        assert sum(w.values()) == n
        rates[rep] = [sum(w.get(v, 0) * x for v, x, y in ends if y == s) / max(1, sum(w.get(v, 0) for v, x, y in ends if y == s)) for s in (1, 0)]

    def counted(*args):
        raise AssertionError("draws counted by replicate and node")

    monkeypatch.setattr(S, "_drawn_nodes", counted)
    seen, own = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: (seen.append(own(df, name)), seen[-1])[1])
    for most in (S.MOST_NODES, 0):
        monkeypatch.setattr(S, "MOST_NODES", most)
        out = S.node_bootstrap(g, "a", "b", "x", "y", replicates=60).collect()
        assert (out[0]["rate_pos"], out[0]["rate_neg"]) == pytest.approx(rates[0])
        reps = {r["rep"]: [r["p0"] / max(1, r["np"]), r["n0"] / max(1, r["nn"])] for r in next(d for d in reversed(seen) if "rep" in d.columns).collect()}
        assert reps == {k: pytest.approx(v) for k, v in rates.items()}


def test_signs_write_their_members_once(spark, monkeypatch):
    seen, own = [], E.materialize
    monkeypatch.setattr(E, "materialize", lambda df, name: seen.append(name) or own(df, name))
    monkeypatch.setattr(catalog, "materialize", lambda df, name: seen.append(name) or own(df, name))
    assert catalog.QUERIES["signed_edges"](spark, SF).count() > 0
    assert seen.count("members") == 1
