"""Annotations of ids: set overlaps, fallbacks with their source, derived features, cell lines, audits of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_overlap(pairs: DataFrame, sets: DataFrame, key: str, column: str, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``common`` and ``jaccard`` (null when both sets are empty) of the two ends' sets; pairs without a set go."""
    x, y = sets.select(F.col(key).alias(a), F.col(column).alias("_x")), sets.select(F.col(key).alias(b), F.col(column).alias("_y"))
    j = pairs.join(x, a).join(y, b)
    i, u = F.size(F.array_intersect("_x", "_y")), F.size(F.array_union("_x", "_y"))
    return j.withColumn("common", i.cast("long")).withColumn("jaccard", F.try_divide(i, u)).drop("_x", "_y")


def term_frequency(sets: DataFrame, column: str, least: float = 0.0) -> DataFrame:
    """``term, n, frequency`` over the rows, above a least frequency."""
    n = sets.agg(F.count("*").alias("all"))
    t = sets.select(F.explode(F.array_distinct(column)).alias("term")).groupBy("term").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n))  # one row
    return t.withColumn("frequency", F.col("n") / F.col("all")).filter(F.col("frequency") > least).select("term", "n", "frequency")


def overlap_bits(pairs: DataFrame, sets: DataFrame, key: str, column: str, terms: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """The same for up to 63 listed terms as bit masks: ``common, together`` by bit counts; ids without a set have none."""
    place = F.aggregate(F.array_distinct(F.col(column)), F.lit(0).cast("long"), lambda acc, t: acc.bitwiseOR(F.coalesce(*[F.when(t == x, F.lit(1 << i).cast("long")) for i, x in enumerate(terms)], F.lit(0).cast("long"))))
    bits = sets.select(F.col(key).alias("_id"), place.alias("_m"))
    for side, c in (("_ma", a), ("_mb", b)):
        pairs = pairs.join(bits.select(F.col("_id").alias(c), F.col("_m").alias(side)), c, "left")
    x, y = (F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("_ma", "_mb"))
    return pairs.withColumn("common", F.bit_count(x.bitwiseAND(y)).cast("long")).withColumn("together", F.bit_count(x.bitwiseOR(y)).cast("long")).drop("_ma", "_mb")


def with_fallback(ids: DataFrame, key: str, value: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """``value`` of the first source that knows an id, and which: ``{value}_source``, "none" where none does.

    Each source is ``key, value`` with one row per id.
    """
    out, names = ids, []
    for i, (name, df) in enumerate(sources):
        out = out.join(df.select(key, F.col(value).alias(f"_v{i}")).filter(F.col(f"_v{i}").isNotNull()), key, "left")
        names.append(F.when(F.col(f"_v{i}").isNotNull(), name))
    cols = [f"_v{i}" for i in range(len(sources))]
    return out.withColumn(value, F.coalesce(*cols)).withColumn(f"{value}_source", F.coalesce(*names, F.lit("none"))).drop(*cols)


def blank(c: Column) -> Column:
    """Null, empty or white space."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def region_fraction(regions: Column, length: Column) -> Column:
    """Share of residues in regions noted as disordered, 1 at most; null without a region or length."""
    at = lambda k: F.regexp_extract_all(regions, F.lit(r'REGION (\d+)\.\.(\d+); /note="Disordered"'), F.lit(k))
    spans = F.zip_with(at(1), at(2), lambda x, y: y.cast("long") - x.cast("long") + 1)
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, n: acc + n)
    return F.when((covered > 0) & (length > 0), F.least(covered / length, F.lit(1.0)))


def derived_features(df: DataFrame) -> DataFrame:
    """Adds ``enzyme, narrow_substrate_enzyme, membrane, secreted`` from the annotation columns of a protein.

    A narrow one has a single EC number, complete to its fourth part, and a single catalytic activity.
    """
    ec = F.filter(F.transform(F.split(F.coalesce("ec", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.split(F.get(ec, F.lit(0)), r"\.")
    activities = F.coalesce(F.regexp_count("cc_catalytic_activity", F.lit("CATALYTIC ACTIVITY:")), F.lit(0))
    narrow = (F.size(ec) == 1) & (F.size(parts) == 4) & (F.coalesce(F.get(parts, F.lit(3)), F.lit("-")) != "-") & (activities == 1)
    secreted = ~blank(F.col("ft_signal")) | F.coalesce(F.col("cc_subcellular_location").contains("Secreted"), F.lit(False))
    return df.withColumns({"enzyme": ~blank(F.col("ec")), "narrow_substrate_enzyme": F.coalesce(narrow, F.lit(False)), "membrane": ~blank(F.col("ft_transmem")), "secreted": secreted})


def list_size(c: Column, sep: str = ";") -> Column:
    """Distinct entries of a list in a string; null has none."""
    return F.size(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")))


def prefer(df: DataFrame, first: str, second: str, out: str) -> DataFrame:
    """``out`` is the first column where known, else the second; rows that neither knows go. NaN is unknown."""
    known = lambda c: F.when(~F.isnan(c), F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)
    return df.withColumn(out, F.coalesce(known(first), known(second))).filter(F.col(out).isNotNull())


def with_cell_lines(ev: DataFrame, tagged: DataFrame, curated: DataFrame, dropped: list[str] = (), study: str = "study", cell: str = "cvcl") -> DataFrame:
    """Evidence with its study's cell line: the curated one, or that of studies tagged with exactly one; others go.

    ``dropped`` studies are left out (they come from a source of their own, see as_source).
    """
    from evidentia.operators.evidence import keep_single_valued

    kept = ev.filter(~F.col(study).isin(list(dropped))) if dropped else ev
    single = keep_single_valued(tagged, [study], cell).select(study, F.col(cell).alias("_tagged")).distinct()
    manual = curated.select(study, F.col(cell).alias("_manual")).dropna().distinct()
    both = kept.join(single, study, "left").join(manual, study, "left")
    return prefer(both, "_manual", "_tagged", cell).drop("_manual", "_tagged")


def as_source(df: DataFrame, **literals: str) -> DataFrame:
    """The rows of one source with its constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in literals.items()})


def several_ids(df: DataFrame, name: str, ident: str) -> DataFrame:
    """Per name with more than one id: ids, ids that are isoforms (with a dash), rows, and sums of tests and observations."""
    g = df.groupBy(name).agg(F.count_distinct(ident).alias("n_ids"), F.count_distinct(F.when(F.col(ident).contains("-"), F.col(ident))).alias("n_isoforms"), F.count("*").alias("n_pairs"), F.sum("n_observed").alias("n_observed"), F.sum("n_tested").alias("n_tested"))
    return g.filter("n_ids > 1")


def flagged_by(df: DataFrame, flag: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``df`` with whether its keys are among those of ``flag``."""
    marked = flag.select(*keys).distinct().withColumn(out, F.lit(True))
    return df.join(marked, keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def symmetrised(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in both orders, once each."""
    return df.select(a, b).unionByName(df.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()


def zero_crossing_kept(df: DataFrame, category: str, lo: str, hi: str) -> DataFrame:
    """All rows of the categories in which some row's interval leaves out 0."""
    clear = df.filter(~((F.col(lo) < 0) & (F.col(hi) > 0))).select(category).distinct()
    return df.join(clear, category, "left_semi")


def extreme_odds(df: DataFrame, cutoff: float, odds: str = "odds_ratio", q: str = "q_value", level: float = 0.05) -> DataFrame:
    """Significant rows whose odds ratio is below 1/cutoff or above cutoff; infinite ones stay."""
    return df.filter((F.col(q) < level) & ((F.col(odds) < 1 / cutoff) | (F.col(odds) > cutoff)))


def columns_like(df: DataFrame, kind: str | None = None, containing: str | None = None, suffix: str | None = None) -> list[str]:
    """Names of columns by type, substring or suffix."""
    return [c for c, t in df.dtypes if (kind is None or t == kind) and (containing is None or containing in c) and (suffix is None or c.endswith(suffix))]
