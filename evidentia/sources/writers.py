"""Writers; every one is a single distributed write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "").csv(path)


def parquet(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """One folder per value of ``by``; rows are clustered first, so a value has few files."""
    df = df.repartition(*by) if by else df
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def fasta(df: DataFrame, path: str, key: str = "id", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), key, F.lit("\n"), seq)).write.mode("overwrite").text(path)


def metis(edges: DataFrame, path: str, a: str = "a", b: str = "b", weight: str = "weight") -> int:
    """Adjacency lines of nodes 1..n, each edge at both ends, below a header of nodes, edges and the weight flag. Returns n."""
    both = edges.select(F.col(a).alias("v"), F.col(b).alias("w"), weight).unionByName(edges.select(F.col(b).alias("v"), F.col(a).alias("w"), weight))
    n, m = both.agg(F.max("v")).first()[0], edges.count()
    lines = both.groupBy("v").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w", weight))), lambda x: F.concat_ws(" ", x["w"].cast("string"), x[weight].cast("string"))), " ").alias("line"))
    alls = df_range(edges, n).join(lines, "v", "left").select("v", F.coalesce("line", F.lit("")).alias("line"))
    head = edges.sparkSession.createDataFrame([(0, f"{n} {m} 1")], "v long, line string")
    # the part files, in the order of their names, make one document
    alls.unionByName(head).repartitionByRange("v").sortWithinPartitions("v").select("line").write.mode("overwrite").text(path)
    return n


def df_range(like: DataFrame, n: int) -> DataFrame:
    return like.sparkSession.range(1, n + 1).withColumnRenamed("id", "v")


def graphml(edges: DataFrame, path: str, a: str = "a", b: str = "b") -> None:
    """One document over the part files in their order: a head, node and edge elements a line each, and the end."""
    spark = edges.sparkSession
    nodes = edges.select(F.explode(F.array(a, b)).alias("v")).distinct().select(F.lit(1).alias("o"), F.format_string('<node id="%s"/>', F.col("v").cast("string")).alias("line"))
    lines = edges.select(F.lit(2).alias("o"), F.format_string('<edge source="%s" target="%s"/>', F.col(a).cast("string"), F.col(b).cast("string")).alias("line"))
    ends = spark.createDataFrame([(0, '<graphml><graph edgedefault="undirected">'), (3, "</graph></graphml>")], "o int, line string")
    ends.unionByName(nodes).unionByName(lines).repartitionByRange("o", "line").sortWithinPartitions("o", "line").select("line").write.mode("overwrite").text(path)


def matrix(cells: DataFrame, index: DataFrame, path: str, **about) -> None:
    """A matrix as Parquet cells, its index as a table, and ``key, value`` of what it is."""
    parquet(cells, f"{path}/cells")
    tsv(index, f"{path}/index")
    tsv(cells.sparkSession.createDataFrame([(k, str(v)) for k, v in about.items()], "key string, value string").coalesce(1), f"{path}/about")


def text(df: DataFrame, path: str, line: str = "line") -> None:
    df.select(line).write.mode("overwrite").text(path)


def report(df: DataFrame, path: str) -> None:
    """``key: value`` lines of a one-row frame."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in df.columns]))
    df.select(pairs.alias("p")).select(F.concat_ws(": ", "p.k", "p.v")).coalesce(1).write.mode("overwrite").text(path)
