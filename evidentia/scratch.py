"""Shared scratch tables, worker code and running aggregates over ranges."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_roots: dict[str, str] = {}
_shipped: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, removed when it ends.

    The folder is set here only in local mode: a cluster must name one that all executors share.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            base = "/tmp/checkpoints"
        _roots[app] = f"{base.rstrip('/')}/evidentia-{app}"
        jvm, conf, root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _roots[app]

        def clean() -> None:
            try:
                path = jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(conf).delete(path, True)
            except Exception:  # the JVM may be gone already
                pass

        atexit.register(clean)
    return _roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a Parquet table to the shared scratch folder and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top, made = Path(__file__).resolve().parent, tempfile.mkdtemp()
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        with tempfile.TemporaryDirectory() as d:
            shutil.copytree(top, f"{d}/{top.name}", ignore=shutil.ignore_patterns("__pycache__"))
            spark.sparkContext.addPyFile(shutil.make_archive(f"{made}/{top.name}", "zip", d))


_COMBINE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}


def running(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Adds running aggregates within ``keys`` in the given order: ``{name: ("sum" | "min" | "max", column)}``.

    Rows are dealt into ranges of (keys, order), written once; a window sees one range, and one row per key and range
    carries the rest. So neither a single key nor a missing one is one task. Equal rows in the order are taken one by
    one, in any order; null keys are a key. Sums start at 0, the others at null.
    """
    d = df.withColumns({f"_v{i}": c for i, (_, c) in enumerate(values.values())})
    d = materialize(d.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    fold = [getattr(F, how) for how, _ in values.values()]
    per = d.groupBy(*keys, "_p").agg(*[f(f"_v{i}").alias(f"_s{i}") for i, f in enumerate(fold)])
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_p").alias("_q"), *[f(f"_s{i}").over(before).alias(f"_b{i}") for i, f in enumerate(fold)])
    same = F.col("_p") == F.col("_q")
    for j, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    here = W.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = d.join(per, same)
    made = [_COMBINE[how](F.col(f"_b{i}"), fold[i](f"_v{i}").over(here)).alias(name) for i, (name, (how, _)) in enumerate(values.items())]
    return out.select(*[c for c in df.columns if c not in values], *made)
