"""Preference formatting: the common turns of two conversations once, as prompt, and what follows as two completions.

Conversations with the same first turn are paired, first with second, third with fourth, in hashed order of their
ids; every conversation is in one row. The prompt is their longest common prefix of turns (equal role and text). A
conversation left over is a `single`: its last turn is the completion. Conversations without a difference are a
`tie` with empty completions. Only DataFrame functions are used.

Completions carry the spans, in characters, of what an assistant says; the rest of them, and the prompt, is masked.
Marks of the template inside a text are broken up, so no text can end its turn.

Defined cases: turns are ordered by number, then role, then text, nulls first, so repeated rows are repeated turns;
null roles are `unknown` and null texts empty when written; a turn with a null id is a conversation of its own, and these
are paired after those with ids; other columns are ignored; texts of any length are kept whole; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bucket_of, materialize, running

#: Conversations of one opening that one task ranks, on average.
BUCKET = 5_000
_SPANS = "array<struct<start:int,end:int>>"


def written(turn: Column) -> tuple[Column, Column]:
    """The head of a turn and its text."""
    head = F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))
    return head, F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |"))


END = "\n<|end|>\n"


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(*written(t), F.lit(END))), "")


def spans(turns: Column, role: str = "assistant") -> Column:
    """(start, end) of every text of ``role`` in the rendered turns."""

    def add(acc: Column, t: Column) -> Column:
        head, text = written(t)
        start = acc["at"] + F.length(head)
        stop = start + F.length(text)
        own = F.when(t["role"] == role, F.array(F.struct(start.alias("start"), stop.alias("end")))).otherwise(F.array().cast(_SPANS))
        return F.struct((stop + len(END)).alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")), add)["spans"]


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share from the start."""
    n = F.least(F.size(a), F.size(b))
    same = lambda i: F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"])
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~same(i))
    return F.when(n < 1, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)), n))


def conversations(turns: DataFrame) -> DataFrame:
    """``conv, conv_id, turns``: a conversation's turns in order, and a key of its own. Written once.

    A conversation is one row of the output, so it must fit one; turns without an id are never gathered.
    """
    turn = F.struct("turn", "role", "text")
    known = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    alone = turns.filter("conv_id is null").select("conv_id", F.array(turn).alias("turns"))
    return materialize(known.unionByName(alone).withColumn("conv", F.monotonically_increasing_id()), "conversations")


def pair_by_opening(convs: DataFrame) -> DataFrame:
    """``chosen, rejected, paired``: keys of conversations with equal first turns, two by two.

    A very common opening is ranked in buckets, so no task sees all its conversations.
    """
    first = F.get("turns", F.lit(0))
    u = F.conv(F.substring(F.md5(F.col("conv_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    slim = convs.select("conv", "conv_id", F.sha2(F.to_json(F.struct(first["role"].alias("role"), first["text"].alias("text"))), 256).alias("o"), F.coalesce(u, F.shiftrightunsigned(F.xxhash64("conv"), 4)).alias("_u"))
    slim = materialize(slim, "openings")
    sizes = slim.groupBy("o").agg(F.count("*").alias("_m"))
    buckets = F.ceil(F.col("_m") / BUCKET)
    late = F.when(F.col("conv_id").isNull(), buckets.cast("int")).otherwise(0)
    ranked = slim.join(sizes, "o").withColumn("_b", bucket_of(F.col("_u") * 4, buckets) + late)
    ranked = running(ranked, ["o"], "_b", [F.col("_u"), F.col("conv_id"), F.col("conv")], F.lit(1), "_r")
    side = lambda k: F.max(F.when(F.col("_r") % 2 == k, F.col("conv")))
    pairs = ranked.groupBy("o", F.expr("_r div 2").alias("_pair")).agg(side(0).alias("chosen"), side(1).alias("rejected"))
    return pairs.select("chosen", "rejected", F.col("rejected").isNotNull().alias("paired"))


def format_preferences(convs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Conversations and their pairs to prompts and masked completions."""
    a = convs.select(F.col("conv").alias("_a"), F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c"))
    b = convs.select(F.col("conv").alias("_b"), F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r"))
    both = pairs.join(a, F.col("chosen") == F.col("_a")).join(b, F.col("rejected") == F.col("_b"), "left")
    shared = F.when(F.col("paired"), common_turns(F.col("c"), F.col("r"))).otherwise(F.greatest(F.size("c") - 1, F.lit(0)))
    both = both.withColumn("prompt_turns", shared)
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    both = both.drop("chosen", "rejected").withColumn("_c", rest("c")).withColumn("_r", F.when(F.col("paired"), rest("r")))
    kind = F.when(~F.col("paired"), "single").when((F.size("_c") == 0) & (F.size("_r") == 0), "tie").otherwise("pair")
    return both.select(
        "chosen_id",
        "rejected_id",
        kind.alias("kind"),
        "prompt_turns",
        render(F.slice("c", 1, F.col("prompt_turns"))).alias("prompt"),
        render(F.col("_c")).alias("chosen"),
        F.when(F.col("paired"), render(F.col("_r"))).alias("rejected"),
        spans(F.col("_c")).alias("chosen_spans"),
        F.when(F.col("paired"), spans(F.col("_r"))).alias("rejected_spans"),
    )


def op6_preferences(spark, sf_dir: str) -> DataFrame:
    convs = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = format_preferences(convs, pair_by_opening(convs))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.withColumn("chosen_spans", told("chosen_spans")).withColumn("rejected_spans", told("rejected_spans"))


ORACLE = r"""
WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts,
  ('0x' || substr(md5(conv_id::VARCHAR), 1, 15))::BIGINT AS u FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT NULL, [{'role': role, 'text': text}], NULL FROM conversations WHERE conv_id IS NULL),
k AS (SELECT conv_id, ts, ts[1] AS o, row_number() OVER (PARTITION BY ts[1] ORDER BY u NULLS LAST, conv_id) - 1 AS r FROM c),
p AS (SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.ts AS ca, b.ts AS cb, b.o IS NOT NULL AS paired
  FROM k a LEFT JOIN k b ON a.o IS NOT DISTINCT FROM b.o AND b.r = a.r + 1 WHERE a.r % 2 = 0),
n AS (SELECT *, (CASE WHEN paired THEN coalesce(list_filter(range(0, least(len(ca), len(cb))), lambda i: ca[i + 1] IS DISTINCT FROM cb[i + 1])[1], least(len(ca), len(cb)))
  ELSE greatest(len(ca) - 1, 0) END)::INT AS prompt_turns FROM p),
x AS (SELECT *, list_transform(ca, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10)) AS ha, list_transform(ca, lambda t: replace(coalesce(t.text, ''), '<|', '< |')) AS ta,
  list_transform(cb, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10)) AS hb, list_transform(cb, lambda t: replace(coalesce(t.text, ''), '<|', '< |')) AS tb FROM n),
y AS (SELECT *, list_transform(range(1, len(ca) + 1), lambda i: ha[i] || ta[i] || chr(10) || '<|end|>' || chr(10)) AS wa,
  list_transform(range(1, len(cb) + 1), lambda i: hb[i] || tb[i] || chr(10) || '<|end|>' || chr(10)) AS wb FROM x),
z AS (SELECT *, list_filter(range(prompt_turns + 1, len(ca) + 1), lambda i: ca[i].role = 'assistant') AS ia, list_filter(range(prompt_turns + 1, len(cb) + 1), lambda i: cb[i].role = 'assistant') AS ib FROM y),
s AS (SELECT *, list_transform(ia, lambda i: length(array_to_string(wa[prompt_turns + 1:i - 1], '')) + length(ha[i])) AS sa, list_transform(ib, lambda i: length(array_to_string(wb[prompt_turns + 1:i - 1], '')) + length(hb[i])) AS sb FROM z)
SELECT chosen_id, rejected_id, CASE WHEN NOT paired THEN 'single' WHEN len(ca) = prompt_turns AND len(cb) = prompt_turns THEN 'tie' ELSE 'pair' END AS kind, prompt_turns,
  coalesce(array_to_string(wa[1:prompt_turns], ''), '') AS prompt, coalesce(array_to_string(wa[prompt_turns + 1:], ''), '') AS chosen,
  CASE WHEN paired THEN coalesce(array_to_string(wb[prompt_turns + 1:], ''), '') END AS rejected,
  coalesce(array_to_string(list_transform(range(1, len(ia) + 1), lambda j: sa[j]::VARCHAR || '-' || (sa[j] + length(ta[ia[j]]))::VARCHAR), ','), '') AS chosen_spans,
  CASE WHEN paired THEN coalesce(array_to_string(list_transform(range(1, len(ib) + 1), lambda j: sb[j]::VARCHAR || '-' || (sb[j] + length(tb[ib[j]]))::VARCHAR), ','), '') END AS rejected_spans
FROM s
"""
