"""Pair features, classifiers and their evaluation, on Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.stats import hash_unit, rank_sum_auc


def pair_features(edges: DataFrame, vectors: DataFrame, key: str, vector: str, symmetrise: bool = False, a: str = "src", b: str = "dst") -> DataFrame:
    """Edges with the two ends' vectors end to end; undirected ones in both orders."""
    if symmetrise:
        rest = [c for c in edges.columns if c not in (a, b)]
        edges = edges.withColumn("flipped", F.lit(False)).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b), *rest, F.lit(True).alias("flipped")))
    left = vectors.select(F.col(key).alias(a), F.col(vector).alias("_va"))
    right = vectors.select(F.col(key).alias(b), F.col(vector).alias("_vb"))
    return edges.join(left, a).join(right, b).withColumn("features", F.concat("_va", "_vb")).drop("_va", "_vb")


def train_classifier(rows: DataFrame, label: str, kind: str = "forest", seed: int = 1, **params):
    """A forest or boosted trees over the ``features`` array. Boosted trees stand in for another library's; results differ."""
    data = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    make = {"forest": lambda: RandomForestClassifier(seed=seed, **({"numTrees": 100} | params)), "boosted": lambda: GBTClassifier(seed=seed, **({"maxIter": 100} | params))}
    return make[kind]().fit(data)


def scored(model, rows: DataFrame) -> DataFrame:
    data = rows.withColumn("_raw", F.col("features")).withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
    return model.transform(data).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "features").withColumnRenamed("_raw", "features")


def search(rows: DataFrame, label: str, grid: list[dict], kind: str = "forest", seed: int = 1):
    """The parameters with the least log-loss on a hashed validation fifth; the model is fitted again on all rows."""
    marked = rows.withColumn("_u", hash_unit(F.xxhash64("features"), F.lit(seed)))
    best = (float("inf"), {})
    for params in grid:
        model = train_classifier(marked.filter("_u >= 0.2"), label, kind, seed, **params)
        p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
        loss = scored(model, marked.filter("_u < 0.2")).agg(F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]
        best = min(best, (loss if loss is not None else float("inf"), params), key=lambda x: x[0])
    return train_classifier(rows, label, kind, seed, **best[1]), best[1]


def evaluate(rows: DataFrame, label: str, score: str, key: str, seed: int = 1) -> DataFrame:
    """AUC and accuracies at 0.5; negatives are cut to about the positives' number, by hash, when there are more."""
    n = rows.agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) == 0).cast("long")).alias("_n"))
    some = rows.crossJoin(F.broadcast(n)).filter((F.col(label) == 1) | (hash_unit(F.col(key), F.lit(seed)) * F.col("_n") < F.col("_p")))  # one row
    hit = some.agg(F.avg(F.when(F.col(label) == 1, (F.col(score) >= 0.5).cast("double"))).alias("accuracy_pos"), F.avg(F.when(F.col(label) == 0, (F.col(score) < 0.5).cast("double"))).alias("accuracy_neg"))
    return rank_sum_auc(some, score, label).crossJoin(hit)  # one row each


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def collate(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """Metrics of several models as one table, each tagged by its model."""
    out = None
    for name, df in frames:
        df = df.withColumn("model", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def log_odds_fit(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """``term, estimate`` of a binomial generalised linear model. It has no random effects, so it does not stand for a mixed
    model: resample nodes (stats.node_bootstrap) for intervals."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    data = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features]))
    model = GeneralizedLinearRegression(family="binomial", labelCol="_y", featuresCol="_x", maxIter=50, tol=1e-10).fit(data)
    found = [("intercept", float(model.intercept)), *[(c, float(x)) for c, x in zip(features, model.coefficients, strict=True)]]
    return rows.sparkSession.createDataFrame(found, "term string, estimate double")
