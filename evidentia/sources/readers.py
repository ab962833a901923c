"""Readers of the exchange formats of pair evidence. Schemas are declared; ids are strings; blanks are null.

Reading is lazy and distributed; compressed files are read whole by one task each, so split large ones first. Services
and downloads are not called: their snapshots are files for these readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def tsv(spark: SparkSession, path, schema, header: bool = True, sep: str = "\t", comment: str | None = None) -> DataFrame:
    """Delimited text by schema (a StructType, a DDL string, or names of string columns); ``sep`` may be a space."""
    schema = strings(schema) if isinstance(schema, list) else schema
    read = spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", "")
    return (read.option("comment", comment) if comment else read).csv(path)


def parquet(spark: SparkSession, path, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Columns and filter reach the scan."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where else df
    return df.select(*columns) if columns else df


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


MITAB = ["id_a", "id_b", "alt_a", "alt_b", "alias_a", "alias_b", "method", "author", "publication", "taxon_a", "taxon_b", "type", "source", "interaction", "score", "expansion", "bio_a", "bio_b", "role_a", "role_b"]


def mitab(spark: SparkSession, path, taxon: str = "9606", header: bool = True) -> DataFrame:
    """Tab-delimited molecular interactions with one bait, both of a taxon: ``bait, prey, study, method``."""
    from evidentia.operators.evidence import normalise_roles

    df = tsv(spark, path, MITAB, header).filter(F.col("taxon_a").contains(taxon) & F.col("taxon_b").contains(taxon))
    ids = df.select(_first(F.col("id_a"), r"uniprotkb:([A-Z0-9-]+)").alias("a"), _first(F.col("id_b"), r"uniprotkb:([A-Z0-9-]+)").alias("b"), _first(F.col("publication"), r"pubmed:(\d+)").alias("study"), F.translate(_first(F.col("method"), r"(MI:\d+)"), ":", "-").alias("method"), "role_a", "role_b")
    return normalise_roles(ids, "a", "b", F.col("role_a").contains("bait"), F.col("role_b").contains("bait"), ["study", "method"])


def id_mapping(spark: SparkSession, path, kinds: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """Three-column mapping ``id, kind, value`` of the named kinds, held to wanted ids."""
    df = tsv(spark, path, ["id", "kind", "value"], header=False).filter(F.col("kind").isin(kinds))
    return df.join(wanted.select("id").distinct(), "id", "left_semi") if wanted is not None else df


def id_lookup(spark: SparkSession, path, wanted: DataFrame | None = None) -> DataFrame:
    """``id, gene_id, gene_name`` of a three-column mapping: the last GeneID and the first Gene_Name of an id, in the
    order of lines; lines of another width are left out."""
    p = F.split("value", "\t")
    rows = numbered_lines(spark, path, "line").filter(F.size(p) == 3).select("line", p[0].alias("id"), p[1].alias("kind"), p[2].alias("value"))
    rows = rows.join(wanted.select("id").distinct(), "id", "left_semi") if wanted is not None else rows
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    return rows.groupBy("id").agg(F.max_by(of("GeneID", "value"), of("GeneID", "line")).alias("gene_id"), F.min_by(of("Gene_Name", "value"), of("Gene_Name", "line")).alias("gene_name"))


def gene_synonyms(spark: SparkSession, path) -> DataFrame:
    """``name, gene_id``: symbols, and synonyms split at bars; a symbol beats a synonym, then the smaller id."""
    from pyspark.sql import Window as W

    df = tsv(spark, path, ["taxon", "gene_id", "symbol", "locus", "synonyms"], header=False, comment="#")
    names = df.select("gene_id", F.struct(F.lit(0).alias("rank"), F.col("symbol").alias("name")).alias("n")).unionByName(df.filter("synonyms <> '-'").select("gene_id", F.explode(F.split("synonyms", r"\|")).alias("x")).select("gene_id", F.struct(F.lit(1).alias("rank"), F.col("x").alias("name")).alias("n")))
    best = W.partitionBy("n.name").orderBy("n.rank", F.col("gene_id").cast("long"))
    return names.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(F.col("n.name").alias("name"), "gene_id")


#: Fixed value: the grammar of accessions.
ACCESSION = r"^[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}$|^[OPQ][0-9][A-Z0-9]{3}[0-9]$"


def secondary_accessions(spark: SparkSession, path) -> DataFrame:
    """Lines of exactly two accessions: ``secondary, primary``."""
    parts = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 2)
    return df.select(F.col("p")[0].alias("secondary"), F.col("p")[1].alias("primary")).filter(F.col("secondary").rlike(ACCESSION) & F.col("primary").rlike(ACCESSION))


def fasta(spark: SparkSession, path, id_pattern: str = r"^[^|]*\|([^|]+)\|") -> DataFrame:
    """``id, header, seq``: records between > marks; the id is the pattern's group, or the first word."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r")).filter(F.trim("r") != "")
    parts = records.select(F.substring_index("r", "\n", 1).alias("header"), F.regexp_replace(F.expr("substring(r, length(substring_index(r, '\n', 1)) + 1)"), r"\s", "").alias("seq"))
    return parts.select(F.coalesce(_first(F.col("header"), id_pattern), F.substring_index("header", " ", 1)).alias("id"), "header", "seq")


def fasta_ids(spark: SparkSession, path) -> DataFrame:
    """Distinct ids of header lines, without the sequences."""
    lines = spark.read.text(path).filter(F.col("value").startswith(">"))
    return lines.select(F.get(F.split("value", r"\|"), F.lit(1)).alias("id")).dropna().distinct()


def records(spark: SparkSession, path, codes: list[str], end: str = "//\n", join: str = "<->") -> DataFrame:
    """Multi-line records with two-letter line codes: a column per code, repeats joined."""
    lines = F.split("value", "\n")
    df = spark.read.text(path, lineSep=end).filter(F.trim("value") != "").select(lines.alias("l"))
    of = lambda code: F.nullif(F.array_join(F.transform(F.filter("l", lambda x: x.startswith(f"{code} ")), lambda x: F.trim(F.substring(x, 3, 1 << 20))), join), F.lit(""))
    return df.select(*[of(c).alias(c) for c in codes])


def clusters(spark: SparkSession, path) -> DataFrame:
    """Members of sequence clusters that are not their representative: ``id, identity``."""
    rows = spark.read.text(path)
    out = rows.select(F.nullif(F.regexp_extract("value", r">([^.]+)\.\.\. at ([0-9.]+)%", 1), F.lit("")).alias("id"), F.regexp_extract("value", r">([^.]+)\.\.\. at ([0-9.]+)%", 2).alias("identity"))
    return out.dropna(subset=["id"]).withColumn("identity", F.col("identity").try_cast("double"))


def listed(df: DataFrame, column: str, sep: str = ";", keep: Column | None = None) -> DataFrame:
    """A list column to rows: trimmed, blanks dropped, after an optional filter on reliability."""
    df = df.filter(keep) if keep is not None else df
    return df.withColumn(column, F.explode(F.split(column, sep))).withColumn(column, F.trim(column)).filter(F.col(column) != "")


def numbered_lines(spark: SparkSession, path, out: str = "node_id") -> DataFrame:
    """Lines with their number from 1, for files whose line number is an id; several files follow each other by path.

    Numbers run within the blocks that a scan reads, and a row per block carries the rest.
    """
    from pyspark.sql import Window as W

    at = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m")]
    lines = spark.read.text(path).select("value", *at)
    blocks = lines.groupBy("_f", "_s").agg(F.min("_m").alias("_least"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_f", "_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("_f").alias("_g"), F.col("_s").alias("_t"), (before - F.col("_least") + 1).alias("_shift"))
    return lines.join(blocks, (F.col("_f") == F.col("_g")) & (F.col("_s") == F.col("_t"))).select((F.col("_m") + F.col("_shift")).alias(out), "value")


def key_values(spark: SparkSession, path, pattern: str = r"([^/]+)\.[a-z]+$") -> DataFrame:
    """``key: value`` files as rows, with the model's name from the path."""
    df = spark.read.text(path).withColumn("model", F.regexp_extract(F.input_file_name(), pattern, 1))
    return df.select("model", F.trim(F.substring_index("value", ":", 1)).alias("key"), F.trim(F.expr("substring(value, length(substring_index(value, ':', 1)) + 2)")).try_cast("double").alias("value")).filter("key <> ''")


def vectors(spark: SparkSession, path, sep: str = "\t") -> DataFrame:
    """Lines of numbers with the id last: ``id, vector``."""
    parts = F.split("value", sep)
    return spark.read.text(path).select(F.element_at(parts, -1).alias("id"), F.slice(parts, 1, F.size(parts) - 1).cast("array<float>").alias("vector"))


def tagged(spark: SparkSession, paths, schema, pattern: str, tag: str = "dataset", **how) -> DataFrame:
    """Many files as one frame, each row tagged by its file's name."""
    return tsv(spark, paths, schema, **how).withColumn(tag, F.regexp_extract(F.input_file_name(), pattern, 1))


def json_lines(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def displayed_isoforms(spark: SparkSession, path) -> DataFrame:
    """``id, isoform``: the displayed isoform of each entry of a saved service answer, one JSON entry a line."""
    entry = "primaryAccession string, comments array<struct<commentType: string, isoforms: array<struct<isoformIds: array<string>, isoformSequenceStatus: string>>>>"
    products = F.filter("comments", lambda c: c["commentType"] == "ALTERNATIVE PRODUCTS")
    shown = F.filter(F.get(products, F.lit(0))["isoforms"], lambda i: i["isoformSequenceStatus"] == "Displayed")
    return spark.read.schema(entry).json(path).select(F.col("primaryAccession").alias("id"), F.get(F.get(shown, F.lit(0))["isoformIds"], F.lit(0)).alias("isoform")).dropna()


def disorder(spark: SparkSession, path) -> DataFrame:
    """``id, disorder_fraction`` of a saved service answer, one JSON entry a line; entries without a value are left out."""
    entry = "acc string, `prediction-disorder-mobidb_lite` struct<content_fraction: double>"
    return spark.read.schema(entry).json(path).select(F.col("acc").alias("id"), F.col("`prediction-disorder-mobidb_lite`.content_fraction").alias("disorder_fraction")).dropna()


ANNOTATION = {"Entry": "uniprot_id", "Length": "length", "Transmembrane": "ft_transmem", "Subcellular location [CC]": "cc_subcellular_location", "EC number": "ec", "Signal peptide": "ft_signal", "Catalytic activity": "cc_catalytic_activity", "Region": "ft_region", "PubMed ID": "lit_pubmed_id"}


def annotation_dump(spark: SparkSession, path) -> DataFrame:
    """A saved annotation table under the names that the operators use."""
    return tsv(spark, path, list(ANNOTATION)).withColumnsRenamed(ANNOTATION).withColumn("length", F.col("length").try_cast("int"))


def similarity_hits(spark: SparkSession, path) -> DataFrame:
    """All-against-all hits ``line, qgene, sgene, evalue, bitscore``; the target is the first word of its title."""
    p = F.split("value", "\t")
    return numbered_lines(spark, path, "line").filter(F.size(p) >= 4).select("line", p[0].alias("qgene"), F.substring_index(p[1], " ", 1).alias("sgene"), p[2].try_cast("double").alias("evalue"), p[3].try_cast("double").alias("bitscore"))


def curated_studies(spark: SparkSession, path) -> DataFrame:
    """``study, cvcl`` of a curated table; blank cells are unknown and go."""
    return tsv(spark, path, ["pubmed_id", "size", "cl_id", "Comment", "Intact?"]).select(F.col("pubmed_id").alias("study"), F.nullif(F.trim("cl_id"), F.lit("")).alias("cvcl")).dropna()


def npy_matrix(spark: SparkSession, path) -> DataFrame:
    """``i, j, r`` of the cells of a saved square matrix (.npy), NaN cells left out. The file is one row and one task: save a
    large one as Parquet cells in the first place."""
    import numpy as np
    import pandas as pd

    def cells(frames):
        import io

        for f in frames:
            for raw in f["content"]:
                m = np.load(io.BytesIO(raw), allow_pickle=False)
                for i in range(len(m)):
                    j = np.flatnonzero(~np.isnan(m[i]))
                    yield pd.DataFrame({"i": np.full(len(j), i), "j": j, "r": m[i][j].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "i long, j long, r double")
