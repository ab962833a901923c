"""Tests of baits against detectable preys by cell line, and a Bayesian model of detection given abundance."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.masks import grid_join
from evidentia.scratch import materialize, ship


def bait_tests(ev: DataFrame, genes: DataFrame, gene: str = "gene", cell: str = "cvcl", study: list[str] = ("study", "method"), min_tested: int = 3) -> DataFrame:
    """``bait, prey, n_observed, n_tested, cell`` for every detectable gene and every cell line of a bait with more than
    ``min_tested`` studies in all: studies that saw the pair there, or 0, of the bait's studies there."""
    tests, rows = _baits(ev, cell, study, min_tested)
    tests = tests.withColumn("_one", F.lit(0))
    every = grid_join(tests, genes.select(F.col(gene).alias("prey")).distinct().withColumn("_one", F.lit(0)), ["_one"], "bait", "prey").drop("_one")
    seen = rows.groupBy("bait", "prey", cell).agg(F.count_distinct("_s").alias("n_observed"))
    return every.join(seen, ["bait", "prey", cell], "left").fillna(0, ["n_observed"]).select("bait", "prey", "n_observed", "n_tested", cell)


def _baits(ev: DataFrame, cell: str, study: list[str], min_tested: int) -> tuple[DataFrame, DataFrame]:
    rows = ev.filter("bait <> prey").select("bait", "prey", cell, F.concat_ws("-", *study).alias("_s")).distinct()
    tests = rows.groupBy("bait", cell).agg(F.count_distinct("_s").alias("n_tested"))
    keep = tests.groupBy("bait").agg(F.sum("n_tested").alias("_n")).filter(F.col("_n") > min_tested).select("bait")
    return tests.join(keep, "bait", "left_semi"), rows


def grid_parts(ev: DataFrame, genes: DataFrame, gene: str = "gene", cell: str = "cvcl", study: list[str] = ("study", "method"), min_tested: int = 3) -> tuple[DataFrame, DataFrame]:
    """What bait_tests multiplies out: ``bait, cell, n_tested``, each of which stands for every gene, and the observed part of
    the grid, ``bait, prey, cell, n_observed, n_tested``."""
    tests, rows = _baits(materialize(ev, "evidence"), cell, study, min_tested)
    tests = materialize(tests, "baits")
    seen = rows.groupBy("bait", "prey", cell).agg(F.count_distinct("_s").alias("n_observed"))
    return tests, seen.join(genes.select(F.col(gene).alias("prey")).distinct(), "prey", "left_semi").join(tests, ["bait", cell])


def wide_tests(tests: DataFrame, cells: list[str], cell: str = "cvcl") -> DataFrame:
    """One row per pair with ``n_tested_{c}`` and ``n_observed_{c}`` per cell line, 0 where there are none."""
    wide = tests.groupBy("bait", "prey").pivot(cell, cells).agg(F.avg("n_tested").cast("long").alias("t"), F.avg("n_observed").cast("long").alias("o")).fillna(0)
    return wide.select("bait", "prey", *[F.col(f"{c}_t").alias(f"n_tested_{c}") for c in cells], *[F.col(f"{c}_o").alias(f"n_observed_{c}") for c in cells])


def unique_tests(wide: DataFrame) -> DataFrame:
    """The distinct rows of a prey and its counts, whatever the bait: a model is fitted once for each."""
    return wide.drop("bait").distinct()


def divergent(models: DataFrame, first: int = 7) -> DataFrame:
    """The first columns of the models that diverged."""
    return models.filter("n_divergences > 0").select(*models.columns[:first])


def pair_models(wide: DataFrame, models: DataFrame, most: int = 10) -> DataFrame:
    """Pairs with the model of their prey and counts: joined on all columns of counts, whatever cell lines there are."""
    keys = ["prey", *[c for c in wide.columns if c.startswith(("n_tested_", "n_observed_"))]]
    return wide.join(models.filter(F.col("n_divergences") < most), keys).filter("bait <> prey")


def _sampled(draws: int, tune: int, seed: int):
    """Random-walk Metropolis for a logit of detection: intercept ~ N(0, 1.5), slope on abundance ~ N(0, 1)."""

    def run(frames):
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                n, k, x = (np.array(v, float) for v in (row.tested, row.observed, row.abundance))
                rng = np.random.default_rng([seed, zlib.crc32(str(row.key).encode())])

                def log_post(b, n=n, k=k, x=x):
                    eta = b[0] + b[1] * x
                    return float((k * eta - n * np.logaddexp(0, eta)).sum() - b[0] ** 2 / 4.5 - b[1] ** 2 / 2)

                b, now, step, kept, taken = np.zeros(2), None, 1.0, [], 0
                now = log_post(b)
                for i in range(tune + draws):
                    new = b + rng.normal(size=2) * step
                    there = log_post(new)
                    if np.log(rng.random()) < there - now:
                        b, now, taken = new, there, taken + 1
                    if i < tune and i % 50 == 49:
                        step, taken = step * (1.3 if taken > 15 else 0.75), 0
                    if i >= tune:
                        kept.append(b[0])
                kept = np.sort(kept)
                width = int(np.ceil(0.95 * len(kept)))
                at = int(np.argmin(kept[width - 1 :] - kept[: len(kept) - width + 1]))
                out.append((row.key, kept.mean(), kept.std(ddof=1), kept[at], kept[at + width - 1]))
            yield pd.DataFrame(out, columns=["key", "mean", "sd", "low", "high"])

    return run


def detection_model(rows: DataFrame, draws: int = 4_000, tune: int = 1_000, seed: int = 1) -> DataFrame:
    """``key, mean, sd, low, high`` of the intercept (log-odds of detection at mean abundance) of each key, with the
    shortest interval that holds 95 %, from ``key, tested, observed, abundance`` arrays over cell lines.

    One chain of a random walk, seeded by key, in place of a gradient sampler: an approximation of the same kind of model.
    """
    ship(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    # few bytes, long work: left to their size, all keys would be one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("key", "tested", "observed", "abundance").repartition(parts, "key").mapInPandas(_sampled(draws, tune, seed), f"key {kind}, mean double, sd double, low double, high double")
