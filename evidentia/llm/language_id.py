"""Language identification by Bayesian fusion of text, markup, address and host evidence.

Text: log-likelihoods of byte trigrams under a model per language, counted over all rows with a declared language.
Markup: how often a declaration goes with each language of the text, a small confusion table. Host: the share of each
language among the other rows of the host, drawn towards that of its address suffix, and this towards that of all
rows; the tables are grouped aggregates of text posteriors.

Defined cases: null, empty and letterless texts have no text evidence and are rejected; a null declaration, suffix or
host adds no evidence of its kind (the prior one level up holds); repeated rows are scored alike; other columns pass
under their own names; whole texts of any length are read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import wordhash
from evidentia.llm.common import materialize, ship, sliced

LANGUAGES = ("de", "en", "es", "fr")
BITS = 14
#: Bytes whose trigrams are taken at a time.
SEGMENT = 1 << 18
#: Trigrams that count as independent evidence at most, for neighbouring ones repeat each other.
MOST_EVIDENCE = 60.0
#: Rows that a prior of the level above weighs as much as.
STRENGTH = 10.0
#: Rows of a host table that may be broadcast (some 100 bytes each).
MOST_HOSTS = 100_000

_LETTERS = wordhash.LOWER.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def _trigrams(data: np.ndarray) -> np.ndarray:
    d = _LETTERS[data].astype(np.uint32)
    key = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    return (key * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def trigram_sums(text: bytes, weights: np.ndarray) -> np.ndarray:
    """The sum of the weight rows of all trigrams of a text; runs of blanks weigh nothing."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    total = np.zeros(weights.shape[1])
    for lo in range(0, len(data) - 2, SEGMENT):
        at = _trigrams(data[lo : lo + SEGMENT + 2])
        total += weights[at].sum(axis=0, dtype=np.float64) if len(at) < 2048 else np.bincount(at, minlength=1 << BITS) @ weights
    return total


_BLANK = int(_trigrams(np.full(3, 32, np.uint8))[0])


def _counted(languages: tuple[str, ...]):
    def run(batches):
        from pyspark import TaskContext

        counts = np.zeros((len(languages), 1 << BITS), np.int64)
        for batch in batches:
            declared = batch.column(1).to_pylist()
            for text, d in zip(wordhash.encoded(batch.column(0)), declared, strict=True):
                if d in languages and text:
                    data = np.frombuffer(b" " + text + b" ", np.uint8)
                    for lo in range(0, len(data) - 2, SEGMENT):
                        at = _trigrams(data[lo : lo + SEGMENT + 2])
                        counts[languages.index(d)] += np.bincount(at, minlength=1 << BITS)
        part = TaskContext.get().partitionId() % 256
        n = len(languages)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], ["language", "part", "n"])

    return sliced(run)


def _added(key, table):
    total = sum(np.frombuffer(x, np.int64) for x in table.column("n").to_pylist())
    return pa.table({"language": table.column("language").slice(0, 1), "part": table.column("part").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})


def train(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log-probabilities of trigrams, a row each, per language; ``rows`` has ``text, markup``. Counts are added in two steps."""
    schema = "language int, part int, n binary"
    ship(rows.sparkSession)
    parts = rows.select("text", "markup").mapInArrow(_counted(languages), schema).groupBy("language", "part").applyInArrow(_added, schema)
    counts = np.zeros((len(languages), 1 << BITS))
    for r in parts.groupBy("language").applyInArrow(_added, schema).collect():  # a fixed size per language
        counts[r["language"]] = np.frombuffer(r["n"], np.int64)
    counts[:, _BLANK] = 0
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
    weights = np.log(share).T
    weights[_BLANK] = 0
    return weights


def _scored(model):
    def run(batches):
        weights = model.value
        marked = np.hstack([weights, (np.arange(len(weights)) != _BLANK)[:, None].astype(float)])
        for batch in batches:
            names = batch.schema.names
            found = [_posterior(t, marked) for t in wordhash.encoded(batch.column(names.index("text")))]
            made = [pa.array([f[0] for f in found], pa.list_(pa.float64())), pa.array([f[1] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "p_text", "n_text"])

    return sliced(run)


def _posterior(text: bytes, marked: np.ndarray) -> tuple[list[float], int]:
    """Posterior of each language by the text alone, and the number of trigrams with a letter (the last weight)."""
    total = trigram_sums(text, marked)
    n, ll = total[-1], total[:-1]
    scaled = ll * (min(n, MOST_EVIDENCE) / n) if n else np.zeros(len(ll))
    p = np.exp(scaled - scaled.max())
    return (p / p.sum()).tolist(), int(round(n))


def score(rows: DataFrame, model, carry_text: bool = False) -> DataFrame:
    """Adds ``p_text`` (per language) and ``n_text`` to rows with ``text, markup, suffix, host`` and any others."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(_scored(model), f"{schema}, p_text array<double>, n_text long")
    return out if carry_text else out.drop("text")


class Evidence:
    """The grouped tables: languages of all rows, per suffix, per host, and per declaration."""

    def __init__(self, scored: DataFrame, languages: tuple[str, ...] = LANGUAGES):
        self.languages = languages
        k = range(len(languages))
        usable = scored.filter("n_text > 0")
        sums = [F.sum(F.col("p_text")[i]).alias(f"c{i}") for i in k]
        total = usable.agg(*sums).first()
        whole = np.array([x or 0.0 for x in total]) + 1.0
        self.all = (whole / whole.sum()).tolist()
        declared = F.when(F.col("markup").isin(*languages), F.col("markup"))
        table = {r["d"]: [r[f"c{i}"] for i in k] for r in usable.groupBy(declared.alias("d")).agg(*sums).collect() if r["d"]}  # a row per language
        # P(declaration | language), one row's worth of smoothing
        seen = np.array([table.get(d, [0.0] * len(languages)) for d in languages]) + 1.0 / len(languages)
        self.says = {d: (seen[i] / seen.sum(axis=0)).tolist() for i, d in enumerate(languages)}
        hosts = usable.filter("host is not null").groupBy("suffix", "host").agg(*sums).withColumn("h", F.array(*[f"c{i}" for i in k])).select("suffix", "host", "h")
        self.hosts = materialize(hosts, "hosts")
        suffixes = usable.filter("suffix is not null").groupBy("suffix").agg(*sums).withColumn("s", F.array(*[f"c{i}" for i in k])).select("suffix", "s")
        self.suffixes = materialize(suffixes, "suffixes")
        self.small = self.hosts.count() <= MOST_HOSTS and self.suffixes.count() <= MOST_HOSTS

    def fuse(self, scored: DataFrame, min_posterior: float = 0.6) -> DataFrame:
        """Adds ``language, posterior, prior`` (of that language at its host) and ``kept``."""
        hint = (lambda d: F.broadcast(d)) if self.small else (lambda d: d.hint("merge"))
        hosts = self.hosts.select(F.col("suffix").alias("_s"), F.col("host").alias("_h"), F.col("h"))
        out = scored.join(hint(hosts), F.col("suffix").eqNullSafe(F.col("_s")) & (F.col("host") == F.col("_h")), "left").drop("_s", "_h")
        out = out.join(hint(self.suffixes.withColumnRenamed("suffix", "_s")), F.col("suffix") == F.col("_s"), "left").drop("_s")
        languages = self.languages
        lift = F.array(*[F.lit(x) for x in self.all])

        def drawn(counts: Column, towards: Column) -> Column:
            """Shares of the other rows' counts (this row's own evidence is taken out), drawn towards a prior."""
            rest = F.transform(counts, lambda c, i: F.greatest(c - F.when(F.col("n_text") > 0, F.get("p_text", i)).otherwise(0.0), F.lit(0.0)))
            total = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
            return F.coalesce(F.transform(rest, lambda c, i: (c + STRENGTH * F.get(towards, i)) / (total + STRENGTH)), towards)

        out = out.withColumn("_p1", drawn(F.col("s"), lift)).withColumn("_p2", drawn(F.col("h"), F.col("_p1")))
        flat = F.array(*[F.lit(1.0)] * len(languages))
        says = flat
        for d, row in self.says.items():
            says = F.when(F.col("markup") == d, F.array(*[F.lit(x) for x in row])).otherwise(says)
        out = out.withColumn("_m", F.coalesce(says, flat))
        joint = F.transform("p_text", lambda p, i: p * F.get("_p2", i) * F.get("_m", i))
        out = out.withColumn("_j", joint).withColumn("_z", F.aggregate("_j", F.lit(0.0), lambda a, x: a + x))
        best = F.array_position("_j", F.array_max("_j")).cast("int")
        out = out.withColumn("_b", best)
        post = F.round(F.array_max("_j") / F.col("_z"), 6)
        named = F.element_at(F.array(*[F.lit(x) for x in languages]), F.col("_b"))
        heard = F.col("n_text") > 0
        out = out.withColumn("language", F.when(heard, named)).withColumn("posterior", F.when(heard, post).otherwise(0.0)).withColumn("prior", F.round(F.element_at("_p2", F.col("_b")), 6))
        return out.withColumn("kept", heard & (F.col("posterior") >= min_posterior)).drop("_p1", "_p2", "_m", "_j", "_z", "_b", "h", "s")


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents declare their language in ``lang`` and come from the host ``source``.

    The suffix is the last label of a source with dots; of one without, the letters it begins with, so numbered sources of
    one family share a prior.
    """
    name = F.lower("source")
    suffix = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(F.regexp_extract(name, r"^[^0-9]*", 0))
    return docs.withColumn("markup", F.lower(F.substring_index("lang", "-", 1))).withColumn("suffix", F.nullif(suffix, F.lit(""))).withColumn("host", F.col("source"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages declare theirs in the html tag; the suffix is the last label of the host."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([a-zA-Z]+)", 1)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    return pages.select("page_id", bare.alias("text"), declared.alias("markup"), F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"))


def identify(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES, min_posterior: float = 0.6) -> DataFrame:
    """Rows with ``text, markup, suffix, host`` get ``language, posterior, prior, kept``; ``text`` is left out."""
    model = rows.sparkSession.sparkContext.broadcast(train(rows, languages))
    scored = materialize(score(rows, model), "scored")
    return Evidence(scored, languages).fuse(scored, min_posterior)


def accepted(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, min_posterior: float = 0.6) -> DataFrame:
    """The documents whose language is known; the columns of ``docs``. Texts are scored twice rather than shuffled."""
    plain = from_documents(docs).select("text", "markup", "suffix", "host")
    model = docs.sparkSession.sparkContext.broadcast(train(plain, languages))
    evidence = Evidence(materialize(score(plain, model), "scored"), languages)
    rows = from_documents(docs.withColumn("_row", F.struct(*[c for c in docs.columns if c != "text"]))).select("_row", "text", "markup", "suffix", "host")
    kept = evidence.fuse(score(rows, model, carry_text=True), min_posterior).filter("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(from_documents(docs).select("doc_id", "text", "markup", "suffix", "host"))
    return out.select("doc_id", F.col("markup").alias("declared"), "suffix", "host", "language", "posterior", "prior", "n_text", "kept")


def language_id_pages(spark, sf_dir: str) -> DataFrame:
    out = identify(from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select("page_id", F.col("markup").alias("declared"), "suffix", "host", "language", "posterior", "prior", "n_text", "kept")
