"""Special functions against sums and integrals taken by brute force."""

import math

import numpy as np

from evidentia.functions import special
from evidentia.operators import graph
from evidentia.operators import stats


def test_beta_cdf_by_integration():
    for a, b, x in [(0.3, 4.7, 0.02), (2.0, 3.0, 0.4), (8.1, 1.9, 0.9)]:
        # u = v ** (1 / a) takes the pole at 0 away
        n, top = 1_000_000, x**a
        v = (np.arange(n) + 0.5) * top / n
        mass = ((1 - v ** (1 / a)) ** (b - 1)).mean() * top / a * math.gamma(a + b) / math.gamma(a) / math.gamma(b)
        assert abs(special.beta_cdf(np.array([x]), np.array([a]), np.array([b]))[0] - mass) < 1e-6


def test_beta_quantile_inverts():
    a, b = np.array([0.2, 1.5, 30.0]), np.array([5.0, 2.5, 7.0])
    for prob in (0.025, 0.5, 0.975):
        assert np.allclose(special.beta_cdf(special.beta_quantile(prob, a, b), a, b), prob, atol=1e-6)


def test_fisher_by_enumeration():
    a, b, c, d = 3, 7, 9, 2
    n, row, col = a + b + c + d, a + b, a + c
    mass = {k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col) for k in range(max(0, col - (n - row)), min(row, col) + 1)}
    assert math.isclose(special.fisher_p(a, b, c, d), sum(p for p in mass.values() if p <= mass[a] * (1 + 1e-7)), rel_tol=1e-9)


def test_degree_constrained_is_largest():
    from itertools import combinations

    pairs = [(1, 2), (1, 3), (2, 3), (3, 2), (3, 4)]
    out, into = {1: 1, 2: 1, 3: 1}, {2: 1, 3: 1, 4: 1}
    fits = lambda s: all(sum(p[0] == v for p in s) <= c for v, c in out.items()) and all(sum(p[1] == v for p in s) <= c for v, c in into.items())
    best = max(len(s) for k in range(6) for s in combinations(pairs, k) if fits(s))
    took = [pairs[i] for i in graph.degree_constrained(pairs, out, into)]
    assert fits(took) and len(took) == best


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "s double, y int")
    auc = [v for v in stats.rank_sum_auc(df, "s", "y").first() if isinstance(v, float)]
    assert 0.875 in auc
