"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Nulls, empty and white-space texts: no words, so every count is 0 and the base rule fails. Repeated rows
give repeated results; other columns, clashing names included, are not carried unless asked for with ``carry``.
An empty table gives an empty result. Whole texts of any length are measured within their own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import SPACE, SPACE_CHARS

# Common words of the four languages.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be by this from or an at "
    "le la les de des du et en un une que qui est dans pour par sur au avec "
    "der die das und zu den von mit sich des auf für ist im nicht ein eine als auch "
    "el los las del que y por con para una su se no al lo como más o"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A ratio must lie in [low, high]; None is open. ``value`` is SQL over the measures."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.25),
    Rule("stop_words_per_word", "n_stop + 1 / n_words", 0.02, None),  # one more, so that short texts pass
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullets / n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipses / n_lines", None, 0.3),
    Rule("exclamations_per_word", "n_exclaims / n_words", None, 0.5),
)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows that occur twice or more in the array, the first one included.

    Window hashes decide that nothing repeats, which equal windows cannot escape; the count itself compares the words.
    """
    last = F.size(words) - width
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    windows = F.sort_array(F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, width)).alias("w"), i.alias("at"))))

    def starts(found: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(found, i)["w"] == F.get(found, j)["w"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), last), lambda i: same(i, i + 1) | same(i, i - 1))
        return F.sort_array(F.transform(twice, lambda i: F.get(found, i)["at"]))

    def covered(found: Column) -> Column:
        gaps = F.transform(found, lambda x, i: F.least(F.coalesce(F.get(found, i + 1) - x, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  binds a value, so that it is computed once
    distinct = once(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(last < 0, 0).when(distinct, 0).otherwise(once(once(windows, starts), covered)).cast("long")


def measure(docs: DataFrame, text: str = "text", carry: list[str] = ("doc_id",)) -> DataFrame:
    """The counts that rules are written in, one row per input row."""
    body = F.coalesce(F.col(text), F.lit(""))
    keep = [F.col(c) for c in carry]
    split = docs.select(*keep, body.alias("_t"), F.filter(F.split(body, f"[{SPACE}]+"), lambda w: w != "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.trim(F.translate(x, SPACE_CHARS, " " * len(SPACE_CHARS))) != "")
    split = split.withColumn("_l", lines)
    only = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    return split.select(
        *carry,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        only(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        only("!").cast("long").alias("n_exclaims"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_l", lambda x: F.ltrim(x).substr(1, 1).isin("-", "•", "·"))).cast("long").alias("n_bullets"),
        F.size(F.filter("_l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipses"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """Per rule, a boolean that is true when the row passes; undefined ratios pass."""
    out = {}
    for r in rules:
        value, ok = F.expr(f"try_divide({', '.join(r.value.split(' / '))})"), F.lit(True)
        if r.low is not None:
            ok = ok & (value >= r.low)
        if r.high is not None:
            ok = ok & (value <= r.high)
        out[r.name] = F.coalesce(ok, F.lit(True))
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 10, max_repeat_percent: int = 20, text: str = "text", carry: list[str] = ("doc_id",)) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and the names of failed rules for every row."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    passes = compile_rules(rules)
    out = measure(docs, text, carry).withColumn("base_failed", failed)
    names = F.filter(F.array(*[F.when(~ok, F.lit(n)) for n, ok in passes.items()]), lambda x: x.isNotNull())
    out = out.withColumn("failed_rules", F.array_join(names, ","))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(k) AS n FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS k FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, t, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop, length(t) - length(replace(t, '!', '')) AS n_exclaims, len(ls) AS n_lines,
  len(list_filter(ls, lambda x: ltrim(x)[1] IN ('-', '•', '·'))) AS n_bullets,
  len(list_filter(ls, lambda x: suffix(rtrim(x), '...') OR suffix(rtrim(x), '…'))) AS n_ellipses
  FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, array_to_string(list_filter([
  CASE WHEN n_words > 0 AND NOT (word_chars / n_words BETWEEN 2.0 AND 14.0) THEN 'mean_word_length' END,
  CASE WHEN n_words > 0 AND n_symbols / n_words > 0.25 THEN 'symbols_per_word' END,
  CASE WHEN n_words > 0 AND (n_stop + 1) / n_words < 0.02 THEN 'stop_words_per_word' END,
  CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'duplicate_lines' END,
  CASE WHEN n_lines > 0 AND n_bullets / n_lines > 0.9 THEN 'bullet_lines' END,
  CASE WHEN n_lines > 0 AND n_ellipses / n_lines > 0.3 THEN 'ellipsis_lines' END,
  CASE WHEN n_words > 0 AND n_exclaims / n_words > 0.5 THEN 'exclamations_per_word' END], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM b
"""
