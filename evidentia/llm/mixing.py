"""Mixing sources to target weights by a low-discrepancy source schedule.

Every source is a stream: its documents in hashed order, laid end to end by words, and once more behind
that. The stream is cut into equal-token blocks. Van der Corput points, mapped through the cumulative slot
counts of the sources, say which source each slot of the mix draws from; slots are ranked per source, and
the r-th slot takes the r-th block. A document begins in the mix at the slot of the block in which it begins, and the
mixed documents come in the order of their slots. Only DataFrame functions are used.

Defined cases: null text has size 0; a null source is a source of its own, last in order; null, repeated and
equal ids are ordered by a hash of id and text, and each row is mixed by itself; an empty table, or one without words,
gives every row taken 0. Other columns are ignored, so their names cannot clash. A document larger than a
block is spread over several blocks; one without words stands once, anywhere in the order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.llm.common import WORD, bucket_of, discard, materialize, running

#: Points of a source that one task writes out.
POINTS = 1 << 16
#: Slots of a schedule at most; blocks grow beyond.
MOST_SLOTS = 1 << 30


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: ``source, sid`` (order by code point, null last), ``source_size, target``, materialized.

    The share of all sizes is dealt by weight; a target above its cap stops there and the excess is dealt anew,
    until none is above. Each round is one aggregate over the sources.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    s = materialize(s.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "sources")
    s = running(s, [], "_p", [order], F.lit(1), "sid").drop("_p").withColumn("sid", F.col("sid").cast("long"))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = materialize(s.withColumn("_w", cycle).withColumn("_cap", F.col("source_size") * cap), "weights")
    total = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, left, weight = -1.0, total, 0.0
    while True:  # as many rounds as there are layers of capped sources
        below = F.col("_cap") <= F.col("_w") * level
        capped, weight = s.agg(F.sum(F.when(below, F.col("_cap")).otherwise(0.0)), F.sum(F.when(below, 0.0).otherwise(F.col("_w")))).first()
        left = total - (capped or 0.0)
        if not weight or (new := left / weight) <= level:
            break
        level = new
    share_of = F.col("_w") * F.lit(left) / F.lit(weight or 1.0)
    return s.withColumn("target", F.when(F.col("_cap") <= F.col("_w") * level, F.col("_cap")).otherwise(share_of)).drop("_w", "_cap")


def schedule(targets: DataFrame, block: int = 1024) -> tuple[DataFrame, int]:
    """The slots of the mix: ``sid, slot`` (place in the mix), ``rank`` (from 0 within the source); and the block size.

    2**m points k have the van der Corput values v = reversed bits of k. Source s owns the values from N_s to
    N_(s+1), scaled to 2**m, where N counts the slots that sources before it need; so it owns at least as
    many points as it needs, and its first ones by k, evenly spread, become its slots.
    """
    words_of = F.floor(F.col("target") + 0.5).cast("long")
    all_words = targets.agg(F.sum(words_of)).first()[0] or 0
    block = max(block, math.ceil(all_words / (MOST_SLOTS // 2)))
    need = targets.select("sid", F.ceil(words_of / block).cast("long").alias("need")).filter("need > 0")
    need = need.withColumn("_b", F.shiftright("sid", 12))
    need = running(need, [], "_b", [F.col("sid")], F.col("need"), "first").drop("_b")
    total = need.agg(F.sum("need")).first()[0] or 0
    m = max(1, (max(total, 1) - 1).bit_length())
    up = lambda c: F.expr(f"cast(ceil(cast({c} as decimal(19,0)) * {1 << m} / {max(total, 1)}) as bigint)")
    own = need.withColumn("_lo", up("first")).withColumn("_hi", up("(first + need)"))
    part = own.withColumn("_part", F.explode(F.sequence(F.expr(f"_lo div {POINTS}"), F.expr(f"(_hi - 1) div {POINTS}"))))
    part = part.repartition("sid", "_part") if total > POINTS else part
    v = part.withColumn("_v", F.explode(F.sequence(F.greatest("_lo", F.col("_part") * POINTS), F.least(F.col("_hi"), (F.col("_part") + 1) * POINTS) - 1)))
    k = F.conv(F.reverse(F.lpad(F.bin("_v"), m, "0")), 2, 10).cast("long")
    points = v.select("sid", "need", k.alias("slot")).withColumn("_b", F.shiftright("slot", max(0, m - max(1, (total // 5000).bit_length()))))
    ranked = running(points, ["sid"], "_b", [F.col("slot")], F.lit(1), "rank")
    return ranked.filter("rank < need").select("sid", "slot", F.col("rank").cast("long").alias("rank")), block


#: Slots of one output partition of the mixed documents, on average.
SLOTS = 50_000


def _drawn(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float, block: int, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in their source's stream, and their pieces: ``_row, slot, words, begins``."""
    body = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    key = F.concat_ws("_", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), body)
    base = docs.select("doc_id", "source", words(F.col(text)).alias("size"), F.xxhash64(text).alias("_th"), F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long").alias("_u"))
    base = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    targets = materialize(source_targets(base, weights, share, cap), "targets")
    slots, block = schedule(targets, block)
    placed = base.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    placed = placed.withColumn("_b", bucket_of(F.col("_u") * 4, max(1, base.count() // 20000)))
    placed = running(placed, ["sid"], "_b", [F.col("_u"), F.col("doc_id"), F.col("size"), F.col("_row")], F.col("size"), "_at").drop("_b")
    placed = materialize(placed.drop("_u"), "placed")
    quota = F.floor(F.col("target") + 0.5).cast("long")
    passes = placed.filter("size > 0").select("_row", "sid", "size", F.explode(F.array(F.col("_at"), F.col("_at") + F.col("source_size"))).alias("_lo"), quota.alias("_q"))
    passes = passes.filter("_lo < _q").withColumn("_hi", F.least(F.col("_lo") + F.col("size"), F.col("_q")))
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.expr(f"_lo div {block}"), F.expr(f"(_hi - 1) div {block}"))))
    in_block = F.least(F.col("_hi"), (F.col("rank") + 1) * block) - F.greatest(F.col("_lo"), F.col("rank") * block)
    begins = F.expr(f"_lo div {block}") == F.col("rank")
    return placed, pieces.join(slots.hint("merge"), ["sid", "rank"]).select("_row", "slot", in_block.alias("words"), begins.alias("begins"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 1024, text: str = "text") -> DataFrame:
    """Per row: ``doc_id, source, size, source_size, target, taken, copies`` and ``first_slot``, the slot it first appears in.

    ``taken`` counts the words of its blocks' overlaps; ``copies`` is how often the document begins in the mix
    (once for a document without words).
    """
    placed, pieces = _drawn(docs, weights, share, cap, block, text)
    drawn = pieces.groupBy("_row").agg(F.sum("words").alias("taken"), F.sum(F.col("begins").cast("int")).alias("copies"), F.min("slot").alias("first_slot"))
    out = placed.join(drawn.hint("merge"), "_row", "left").withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.coalesce("copies", F.lit(0))).cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "copies", "first_slot")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 1024) -> DataFrame:
    """The documents of the mix in the order of the slots where they begin, as often as they do; the columns of ``docs``.

    Rows meet their slots by id, source, size and a hash of the text; if some agree in all, they are numbered on both
    sides. Partitions are runs of slots, which hold equal numbers of words.
    """
    placed, pieces = _drawn(docs, weights, share, cap, block, "text")
    begun = pieces.filter("begins").select("_row", "slot")
    told = placed.select("_row", "doc_id", "source", "size", "_th").join(begun.hint("merge"), "_row", "left").filter("slot is not null or size = 0")
    told = materialize(told, "begun")
    last = (told.agg(F.max("slot")).first()[0] or 0) + 1
    names = ["doc_id", "source", "size", "_th"]
    mine = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_d"), F.col("source").alias("_s"), words(F.col("text")).alias("_n"), F.xxhash64("text").alias("_h"))
    alike = placed.groupBy(*names).agg(F.count("*").alias("k")).filter("k > 1")
    if alike.head(1):
        order = placed.select("_row", F.row_number().over(W.partitionBy(*names).orderBy("_row")).alias("_i"))
        told, names = told.join(order, "_row"), [*names, "_i"]
        mine = mine.withColumn("_i0", F.row_number().over(W.partitionBy("_d", "_s", "_n", "_h").orderBy("_h")))
    told = told.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], "slot")
    same = F.lit(True)
    for i, c in enumerate(["_d", "_s", "_n", "_h", "_i0"][: len(names)]):
        same = F.col(c).eqNullSafe(F.col(f"_k{i}")) if i == 0 else same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = mine.join(told, same).select("_doc", F.coalesce("slot", F.pmod("_h", F.lit(last))).alias("_slot"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-last // SLOTS))
    out = out.repartitionById(parts, F.expr(f"cast(cast(_slot as double) * {parts} / {last} as int)")).sortWithinPartitions("_slot", F.xxhash64("_doc.doc_id"))
    return out.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '_' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][sid % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
k AS (SELECT rest, ws FROM r WHERE rest / ws < cap / w ORDER BY cap / w, sid LIMIT 1),
t AS (SELECT sid, source, source_size, CASE WHEN cap <= w * (SELECT rest / ws FROM k) THEN cap ELSE w * (SELECT rest FROM k) / (SELECT ws FROM k) END AS target FROM r),
n AS (SELECT sid, ((floor(target + 0.5)::BIGINT + 1023) // 1024)::BIGINT AS need FROM t),
f AS (SELECT sid, need, (coalesce(sum(need) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first, (sum(need) OVER ())::BIGINT AS total FROM n WHERE need > 0),
m AS (SELECT *, length(bin((total - 1)::UBIGINT))::BIGINT AS m FROM f),
v AS (SELECT sid, need, m, unnest(range((first * (1 << m) + total - 1) // total, ((first + need) * (1 << m) + total - 1) // total)) AS v FROM m),
c AS (SELECT sid, need, list_sum(list_transform(range(m), lambda i: ((v >> i) & 1) << (m - 1 - i)))::BIGINT AS slot FROM v),
o AS (SELECT sid, need, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM c),
p AS (SELECT d.r, d.doc_id, t.sid, size, source_size, target, floor(target + 0.5)::BIGINT AS q,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size, d.r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
z AS (SELECT r, sid, unnest([a, a + source_size]) AS lo, size, q FROM p WHERE size > 0),
y AS (SELECT r, sid, unnest(range(lo // 1024, (least(lo + size, q) - 1) // 1024 + 1)) AS rank FROM z WHERE lo < q),
x AS (SELECT y.r, min(slot)::BIGINT AS first_slot FROM y JOIN o ON o.sid = y.sid AND o.rank = y.rank AND o.rank < o.need GROUP BY y.r)
SELECT doc_id, size, source_size, target, (greatest(0, least(q, a + size) - a) + greatest(0, least(q, a + source_size + size) - a - source_size))::BIGINT AS taken, first_slot FROM p LEFT JOIN x USING (r)
"""
