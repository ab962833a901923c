"""Pairs that are returned whole are made where they are returned."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import evidence as E
from evidentia.operators import masks as M
from evidentia.operators import whole

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("wide", [1_024, 4])
def test_pairs_with_values_or_none(spark, kind, wide):
    rng = random.Random(3)
    ids = [rng.randrange(-500, 500) for _ in range(40)]
    rows = spark.createDataFrame([(i,) for i in set(ids)], "id long").select(F.col("id").cast(kind))
    all_ = sorted(r[0] for r in rows.collect())
    pairs = {(x, y): 0 for x in all_ for y in all_ if x < y}
    known = {p: k + 1 for k, p in enumerate(rng.sample(sorted(pairs), 90))}
    df = spark.createDataFrame([(*p, k) for p, k in known.items()], f"x {kind}, y {kind}, n long")
    got = [tuple(r) for r in whole.valued_pairs(rows, df, "x", "y", "n", wide).collect()]
    assert len(got) == len(pairs) and {(x, y): n for x, y, n in got} == pairs | known
    assert whole.valued_pairs(rows.limit(1), df.limit(0), "x", "y", "n").collect() == whole.valued_pairs(rows.limit(0), df.limit(0), "x", "y", "n").collect() == []


def test_shared_members_makes_no_grid_of_keys(spark, monkeypatch):
    def made(*args, **kwargs):
        raise AssertionError("a grid of pairs, joined to the shared ones by a shuffle of all")

    monkeypatch.setattr(M, "ordered_pairs", made)
    rows = [(b, m) for b in range(30) for m in range(9) if (b * m) % 7 == 1]
    got = E.shared_members(spark.createDataFrame(rows, "bait long, prey long"), "bait", "prey").collect()
    of = {b: {m for k, m in rows if k == b} for b, _ in rows}
    assert sorted(map(tuple, got)) == sorted((x, y, len(of[x] & of[y])) for x in of for y in of if x < y)
