"""Flows on arrays, against those on objects."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from evidentia.operators import flows, graph


def network(seed, n, wide, high):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, wide + 1)
    return pd.DataFrame({"src": rng.integers(0, high, n) * 7, "dst": 5 + rng.choice(wide, n, p=p / p.sum()), "sign": (rng.random(n) < 0.4).astype(int)}).drop_duplicates(["src", "dst"])


def test_as_large_as_a_maximum_flow():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        e = np.unique(rng.integers(0, (8, 12), (rng.integers(1, 50), 2)), axis=0).astype(np.int32)
        caps = rng.integers(0, 4, 8), rng.integers(0, 3, 12)
        best = graph.degree_constrained([tuple(x) for x in e.tolist()], *[dict(enumerate(c.tolist())) for c in caps])
        taken = flows.largest(e[:, 0], e[:, 1], *caps)
        assert taken.sum() == len(best)
        assert all((np.bincount(e[taken, i], minlength=len(c)) <= c).all() for i, c in enumerate(caps))


def test_scaled_negatives_in_any_order(spark):
    for seed, wide, high in ((1, 30, 20), (2, 20, 90)):
        net = network(seed, 600, wide, high)
        pos, neg = (list(zip(g.src, g.dst, strict=True)) for g in (net[net.sign == 1], net[net.sign == 0]))
        out, into = ({e[i] for e in pos} & {e[i] for e in neg} for i in (0, 1))
        pos, neg = ([e for e in x if e[0] in out and e[1] in into] for x in (pos, neg))
        po, pi = graph._degrees(pos, True)
        df = spark.createDataFrame(net, "src long, dst long, sign int")
        got = graph.scaled_negatives(df.repartition(5)).collect()
        assert got == graph.scaled_negatives(df.orderBy("dst")).collect() and [r["scale"] for r in got] == [1.0, 1.5, 2.0]
        for r in got:
            best = graph.degree_constrained(neg, *[{v: round(d * r["scale"]) for v, d in x.items()} for x in (po, pi)])
            assert (r["n_pos"], r["n_neg"]) == (len(pos), len(best))
        assert got[0]["divergence_out"] == got[0]["divergence_in"] == len(pos) - got[0]["n_neg"]
    assert graph.scaled_negatives(df.limit(0)).collect() == []


def test_edges_are_no_objects():
    net = network(3, 400_000, 3_000, 1_000)
    batches = pa.Table.from_pandas(net, preserve_index=False).to_batches(max_chunksize=10_000)
    tracemalloc.start()
    rows = list(flows.scaled(iter(batches), [1.0, 2.0]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 2 and most < 150 * len(net)
