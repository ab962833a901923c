"""Pruning to the fixpoint and balance of degrees."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from evidentia.operators import graph


def test_long_chains_are_pruned_to_the_fixpoint(spark):
    ring = [(1000, 1001, 1), (1001, 1002, 0), (1002, 1003, 1), (1003, 1000, 0)]
    chain = [(i, i + 1 if i < 52 else 1000, i % 2) for i in range(53)]
    left = graph.exclusive_prune(spark.createDataFrame(ring + chain, "src long, dst long, sign int").coalesce(1)).select("src", "dst", "sign").collect()
    assert sorted(map(tuple, left)) == sorted(ring)


def network(seed, n=40):
    rng = np.random.default_rng(seed)
    p = np.arange(1, n + 1) ** -0.7
    edges = {tuple(sorted(rng.choice(n, 2, replace=False, p=p / p.sum()).tolist())): int(rng.random() < 0.5) for _ in range(300)}
    rows = [("x", u, v, s) for (u, v), s in edges.items()] + [("x", 900 + i, 950 + i, i % 2) for i in range(4)]
    return pd.DataFrame(rows, columns=["network_id", "src", "dst", "sign"])


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("min_flow", [0.6, 0.95])
def test_balanced_nodes_have_both_signs(directed, min_flow):
    for seed in range(8):
        got = graph._balance(min_flow, directed)(network(seed)).query('sign >= 0')
        pos, neg = got[got.sign == 1], got[got.sign == 0]
        assert len(pos) and len(neg)
        if directed:
            assert set(pos.src) == set(neg.src) and set(pos.dst) == set(neg.dst)
        else:
            assert {*pos.src, *pos.dst} == {*neg.src, *neg.dst}


def test_undirected_flow_counts_both_ends():
    pairs = [(1, 2), (2, 3), (3, 1), (1, 4), (4, 5)]
    caps = {1: 2, 2: 1, 3: 1, 4: 1}
    assert graph.degree_constrained_undirected(pairs[:4], caps, 9) in ([1, 3], [0, 2], [0, 3], [2, 3])
    net = network(1)
    pos, neg = (list(zip(g.src, g.dst, strict=True)) for g in (net[net.sign == 1], net[net.sign == 0]))
    caps = Counter(v for e in pos for v in e)
    inside = [e for e in neg if e[0] in caps and e[1] in caps]
    took = Counter(v for i in graph.degree_constrained_undirected(inside, caps, len(pos)) for v in inside[i])
    assert took and all(took[v] <= caps[v] for v in took)


def test_balance_goes_on_past_fifty_rounds(monkeypatch):
    # flows that leave out one edge each time: the negatives must still be those chosen against the last positives
    monkeypatch.setattr(graph, "degree_constrained", lambda pairs, out, into: list(range(min(len(pairs), sum(out.values())) - (sum(out.values()) > 5))))
    rows = [("x", i % 3, i, s) for i in range(200) for s in (0, 1)]
    got = graph._balance(1.0, True)(pd.DataFrame(rows, columns=["network_id", "src", "dst", "sign"])).query("sign >= 0")
    assert (got.sign == 1).sum() == (got.sign == 0).sum() <= 5


def test_limit_on_positive_edges():
    for seed in range(3):
        net = network(seed).assign(most=60)
        got = graph._balance(0.9, True)(net)
        assert 0 < (got.sign == 1).sum() <= 60


def sound(spark, got, original, directed):
    a = graph.audit_networks(got, original, directed).collect()
    assert a and all((r["foreign"], r["of_both_signs"], r["one_sided"]) == (0, 0, 0) for r in a)


@pytest.mark.parametrize("directed", [True, False])
def test_rounds_keep_within_degrees_and_cannot_be_extended(spark, directed):
    net = network(2)
    df = spark.createDataFrame(net)
    pos, neg = (df.filter(df.sign == s).select("network_id", "src", "dst") for s in (1, 0))
    took = {(r["src"], r["dst"]) for r in graph._within_by_rounds(neg, pos, directed, 1).collect()}
    p, n = (set(zip(g.src, g.dst, strict=True)) for g in (net[net.sign == 1], net[net.sign == 0]))
    ends = lambda e: [(0, e[0]), (int(directed), e[1])]
    room = Counter(x for e in p for x in ends(e))
    room.subtract(x for e in took for x in ends(e))
    assert took <= n and min(room.values()) >= 0
    assert not [e for e in n - took if all(room[x] > 0 for x in ends(e))]
    if directed:
        sound(spark, graph.balance_degrees(df, most_edges=0), df, True)


def test_pruning_reports_what_it_excludes(spark):
    rows = [(1, 2, 1), (1, 2, 0), (2, 3, 1), (3, 1, 0), (4, 5, 1)]
    df = spark.createDataFrame(rows, "src long, dst long, sign int")
    edges, gone = graph.prune(df, directed=True)
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 0), (1, 2, 1)]
    assert {r[0] for r in gone.collect()} == {1, 2, 3, 4, 5}
    _, gone = graph.prune(df, directed=False)
    assert {r[0] for r in gone.collect()} == set()


def test_equalised_networks_are_alike(spark):
    nets = pd.concat([network(i, 30 + 10 * i).assign(network_id=str(i)) for i in range(3)])
    df = spark.createDataFrame(nets)
    got = graph.equalise(df)
    n = [r["count"] for r in got.filter("sign = 1").groupBy("network_id").count().collect()]
    assert len(n) == 3 and max(n) <= 1.05 * min(n)
    sound(spark, got, df, True)


def test_random_negatives_meet_the_degrees(spark):
    pos = sorted({(int(u), int(v)) for u, v in np.random.default_rng(4).integers(0, 60, (150, 2)) if u < v})
    got = [tuple(r) for r in graph.random_negatives(spark.createDataFrame(pos, "src long, dst long")).collect()]
    assert len(set(got)) == len(got) and not set(got) & set(pos) and all(u < v for u, v in got)
    want, have = Counter(v for e in pos for v in e), Counter(v for e in got for v in e)
    assert all(have[v] <= want[v] for v in have) and len(got) >= 0.9 * len(pos)


def test_worst_nodes_by_brute_force(spark):
    rows = [(1, 2, 1), (2, 3, 0), (3, 1, 1), (1, 3, 0), (4, 1, 1), (4, 2, 0), (5, 4, 1), (5, 1, 1), (2, 4, 0)]
    got = [r["node"] for r in graph.worst_nodes(spark.createDataFrame(rows, "src long, dst long, sign int"), 0.5).orderBy("at").collect()]
    alive, gone = {1, 2, 3, 4, 5}, []
    while True:
        kept = sum(s for u, v, s in rows if u in alive and v in alive)
        inside = sum(s for u, v, s in rows if u in gone and v in gone)
        if not kept or kept <= 0.5 * (kept + inside):
            break

        def score(x):
            total = 0
            for k in (0, 1):
                p, n = (sum(1 for e in rows if e[k] == x and e[2] == s and e[0] in alive and e[1] in alive) for s in (1, 0))
                total += 0 if p + n == 0 else 100_000 if not min(p, n) else abs(p - n) / min(p, n)
            return total

        worst = min(alive, key=lambda x: (-score(x), x))
        alive.discard(worst)
        gone.append(worst)
    assert got == gone


def test_redundant_sequences(spark):
    seqs = spark.createDataFrame([(1, "ABCDEFGHIJKLMNOP"), (2, "ABCDEFGHIJKLMNO"), (3, "ABCDEFGHIJKLMN"), (4, "ZYXWVUTSRQ"), (5, "")], "id long, seq string")
    links = graph.similar_sequences(seqs)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(1, 2), (1, 3), (2, 3)}
    lengths = seqs.selectExpr("id", "length(seq) as length")
    assert sorted(r["id"] for r in graph.redundant(links, lengths).collect()) == [2, 3]


def test_validation_split_does_not_leak(spark):
    rng = np.random.default_rng(6)
    rows = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2)) if a < b})
    df = spark.createDataFrame([(a, b, int(rng.random() < 0.5)) for a, b in rows], "src long, dst long, sign int")
    split = graph.validation_split(df, directed=False, iterations=4).cache()
    assert graph.audit_split(split).count() == 0 and split.join(df, ["src", "dst", "sign"], "left_anti").count() == 0
    assert {r["split"] for r in split.collect()} == {"validation", "test"}
