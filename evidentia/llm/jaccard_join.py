"""Near-duplicate groups by an exact n-gram Jaccard join over a token-group matrix.

Documents with equal shingle sets are one class. Similar classes are put into groups (equal smallest shingle,
then whatever links to the group's leaders). The matrix stores, for every group, the union of its members'
index tokens with the sizes that have them. A class overlaps a group at a token; the tokens it has left from
there bound its overlap with any member, and only groups whose bound qualifies are opened, member by member.
Pairs inside one group need no test, as its members reach each other already.

Tokens are ordered rarest first, by a count sketch over all documents, then by hash. Of two linked classes with
|d| <= |q| the first |q| - ceil(0.8 |q|) + 1 tokens of q and |d| - ceil(2 t / (1 + t) |d|) + 1 of d share one; so
the search is exact for any order, and a passage that many documents share comes last and opens nothing.

Words are hashed by BLAKE2b, so none can be made to collide cheaply; shingles are compared by 64 bits over their words'
hashes, and sets of a class by 128 bits: classes whose second half differs are told apart.

Defined cases: null, empty and white-space texts have no shingles, link with nothing and are their own component;
null ids never name a component unless all its ids are null; repeated rows are kept and reported alike; other
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import wordhash
from evidentia.llm.common import WORD, discard, key_filter, materialize, passes, ship, sliced
from evidentia.llm.graph import components

#: The sketch has as many counters as this to 2**MOST_BITS: 16 MB of one-byte levels at most are broadcast, and a task
#: holds 32 MB of counts, each full at 65,535, which is more than common enough to come last.
LEAST_BITS, MOST_BITS = 20, 24
_FULL = (1 << 16) - 1
#: Counters in one row of a partial sketch.
ROW = 2048
TOKEN_BITS = 56
_NO_ID = (1 << 63) - 1
#: Salt of the second half of a set's key.
_SECOND = 0xD6E8FEB86659FD93


def _sets(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index of a text and the sorted distinct shingle hashes of it; texts without words are left out."""
    for first, held in wordhash.batches(texts):
        doc, h = wordhash.strong(held)
        at, sh = wordhash.shingles(doc, h, len(held), width)
        if not len(at):
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], at))))
        for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
            own = np.sort(sh[a:b])
            yield first + int(at[a]), own[np.concatenate(([True], own[1:] != own[:-1]))]


def _set_key(own: np.ndarray, salt: int = 0x9E3779B97F4A7C15) -> int:
    """A signed 64-bit key of a set of hashes."""
    place = np.arange(1, len(own) + 1, dtype=wordhash.U) * wordhash.U(salt)
    return int(wordhash.mix(np.array([wordhash.mix(own ^ place).sum(dtype=wordhash.U) + wordhash.U(len(own))], wordhash.U))[0].astype(np.int64))


def _sketch(bits: int, width: int):
    def run(batches):
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for _, held in wordhash.batches(wordhash.encoded(batch.column(0))):
                doc, h = wordhash.strong(held)
                _, sh = wordhash.shingles(doc, h, len(held), width)
                at, n = np.unique((sh >> wordhash.U(64 - bits)).astype(np.int64), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, _FULL)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % 256
        rows = counts.reshape(-1, ROW)
        used = np.flatnonzero(rows.any(axis=1))
        for lo in range(0, len(used), 256):
            some = used[lo : lo + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([part] * len(some), pa.int32()), pa.array([rows[i].astype("<u4").tobytes() for i in some], pa.binary())], ["block", "part", "n"])

    return sliced(run)


def _add(key: str):
    def run(key_values, table):
        total = np.zeros(ROW, np.uint64)
        for x in table.column("n").to_pylist():
            total += np.frombuffer(x, np.uint32)
        total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32).tobytes()
        names = [f.name for f in table.schema]
        first = {c: table.column(c)[0].as_py() for c in names if c != "n"}
        return pa.table({**{c: pa.array([v], table.schema.field(c).type) for c, v in first.items()}, "n": pa.array([total], pa.binary())})

    return run


def _levels(key_values, table):
    counts = np.frombuffer(table.column("n")[0].as_py(), np.uint32)
    level = np.minimum(2 * np.log2(counts + 1.0), 255).astype(np.uint8).tobytes()
    return pa.table({"block": table.column("block"), "n": pa.array([level], pa.binary())})


def rarity(texts: DataFrame, bits: int, width: int) -> np.ndarray:
    """Per counter, the logarithm of how many shingles of all documents fall to it. Partial sketches are added in two steps."""
    part = texts.mapInArrow(_sketch(bits, width), "block int, part int, n binary")
    part = part.groupBy("block", "part").applyInArrow(_add("part"), "block int, part int, n binary")
    one = part.groupBy("block").applyInArrow(_add("block"), "block int, part int, n binary").groupBy("block").applyInArrow(_levels, "block int, n binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in one.collect():  # 2**bits bytes, at most 64 MB
        out[r["block"] * ROW : (r["block"] + 1) * ROW] = np.frombuffer(r["n"], np.uint8)
    return out


def _tokens(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens of a set in the common order: level above, hash below."""
    bits = len(levels).bit_length() - 1
    level = levels[(own >> wordhash.U(64 - bits)).astype(np.int64)].astype(wordhash.U)
    tok = (level << wordhash.U(TOKEN_BITS)) | (own >> wordhash.U(64 - TOKEN_BITS))
    return np.sort(tok)


def probe_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signature(own: np.ndarray) -> bytes:
    """Parities of a set's hashes over about as many bits as it has members, 64 at least."""
    bits = max(64, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own & wordhash.U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """No two sets with these signatures differ in fewer members; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _plausible(percent: int):
    def run(batches):
        for batch in batches:
            m, n, x, y = (batch.column(c).to_pylist() for c in ("m", "n", "x", "y"))
            most = [s - 2 * -(-percent * s // (100 + percent)) for s in map(sum, zip(m, n, strict=True))]
            hit = [least_difference(p, q) <= d for p, q, d in zip(x, y, most, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(hit, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return sliced(run)


def _prefixes(levels, width: int, percent: int):
    def run(batches):
        table = levels.value
        for batch in batches:
            ids = batch.column(0)
            n, key, chk, low, common, sig, toks = ([None] * len(ids) for _ in range(7))
            for i, own in _sets(wordhash.encoded(batch.column(1)), width):
                t = _tokens(own, table)
                n[i], key[i], low[i] = len(own), _set_key(own), int(own[0].astype(np.int64))
                chk[i] = _set_key(own, _SECOND)
                sig[i] = signature(own)
                t = t[: probe_length(len(own), percent)]
                common[i] = int(16 * (t >> wordhash.U(TOKEN_BITS)).mean())
                toks[i] = t.astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array([x or 0 for x in n], pa.int64()), pa.array(key, pa.int64()), pa.array(chk, pa.int64()), pa.array(low, pa.int64()), pa.array(common, pa.int32()), pa.array(sig, pa.binary()), pa.array(toks, pa.list_(pa.int64())), batch.column(2)], ["doc_id", "n", "cls", "chk", "low", "common", "sig", "toks", "th"])

    return sliced(run)


def _marked(marks, bits: int):
    """One row for each token that the filter holds."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            of = np.repeat(np.arange(len(lists)), sizes)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = passes(marks.value, bits, flat)
            rows = pa.array(of[hit])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), pa.array(pos[hit].astype(np.int32)), pa.array(flat[hit])], ["cls", "n", "common", "pos", "token"])

    return sliced(run)


def _full_sets(wanted, bits: int, width: int):
    def run(batches):
        for batch in batches:
            ids = np.array([_NO_ID if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            hit = np.flatnonzero(passes(wanted.value, bits, ids))
            cls, chk, sets = [], [], []
            for _, own in _sets(wordhash.encoded(batch.column(1).take(pa.array(hit))), width):
                cls.append(_set_key(own))
                chk.append(_set_key(own, _SECOND))
                sets.append(own.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(chk, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cls", "chk", "s"])

    return sliced(run)


def told_apart(df: DataFrame, clash: DataFrame | None) -> DataFrame:
    """``df`` with ``cls, chk``: classes listed in ``clash``, of several sets, are renamed by both halves of the key."""
    if clash is None:
        return df
    marked = df.join(clash.select("cls", F.lit(True).alias("_several")), "cls", "left")
    return marked.withColumn("cls", F.when(F.col("_several"), F.xxhash64("cls", "chk")).otherwise(F.col("cls"))).select(*df.columns)


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, clash: DataFrame | None = None) -> DataFrame:
    """The pairs ``a, b`` of classes that really link, materialized.

    Signatures bound how much two sets differ and leave few pairs. The full sets of those are made anew from one text
    of each class; a filter of the texts' ids keeps others from being cut into shingles, and no text is shuffled.
    """
    sized = classes.select("cls", "n", "sig")
    sides = pairs.select("a", "b").join(sized.select(F.col("cls").alias("a"), F.col("n").alias("m"), F.col("sig").alias("x")), "a")
    sides = sides.join(sized.select(F.col("cls").alias("b"), "n", F.col("sig").alias("y")), "b")
    pairs = materialize(sides.select("a", "b", "m", "n", "x", "y").mapInArrow(_plausible(percent), "a long, b long"), "plausible")
    ids = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    need = materialize(ids.join(classes.select("cls", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id")), "cls"), "wanted")
    wanted, bits = key_filter(need.select("id"), need.count())
    sets = docs.select("doc_id", "text").mapInArrow(_full_sets(wanted, bits, width), "cls long, chk long, s array<long>")
    sets = told_apart(sets, clash).join(need.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    i = F.size(F.array_intersect("sa", "sb"))
    return materialize(both.filter(100 * i >= percent * (F.size("sa") + F.size("sb") - i)).select("a", "b"), "links")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("cls", "d").alias("a"), F.greatest("cls", "d").alias("b")).distinct()


def _in_groups(df: DataFrame, groups: DataFrame, cls: str, name: str) -> DataFrame:
    """Adds the group of a class; one without links is its own."""
    return df.join(groups.select(F.col("v").alias(cls), F.col("c").alias("_c")), cls, "left").withColumn(name, F.coalesce("_c", cls)).drop("_c")


def grouped(docs: DataFrame, percent: int = 80, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, n, cls`` (the class, null without shingles), and classes ``cls, doc_id, rows, c`` (the group)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    bits = min(MOST_BITS, max(LEAST_BITS, (2 * docs.count()).bit_length()))
    levels = spark.sparkContext.broadcast(rarity(docs.select("text"), bits, width))
    found = docs.mapInArrow(_prefixes(levels, width, percent), "doc_id long, n long, cls long, chk long, low long, common int, sig binary, toks array<long>, th long")
    prefixes = materialize(found, "prefixes")
    firsts = [F.first(c).alias(c) for c in ("n", "low", "common", "sig")]
    by_class = lambda df: materialize(df.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.min("chk").alias("chk"), F.max("chk").alias("_chk"), *firsts), "classes")
    classes, clash = by_class(prefixes), None
    if classes.filter("chk <> _chk").head(1):  # sets of equal 64-bit keys: some dozens among 10**10 documents
        clash = materialize(classes.filter("chk <> _chk").select("cls"), "clash")
        prefixes = materialize(told_apart(prefixes, clash), "prefixes")
        classes = by_class(prefixes)
    some = prefixes.filter("n > 0")

    # the matrix: only tokens of two classes or more can open anything
    shared = some.select("cls", F.explode("toks").alias("token")).groupBy("token").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("token")
    shared = materialize(shared, "shared")
    marks, mark_bits = key_filter(shared, shared.count())
    kept = some.select("cls", "n", "common", "toks").mapInArrow(_marked(marks, mark_bits), "cls long, n long, common int, pos int, token long")
    probe = kept.join(shared, "token").groupBy("token", "cls").agg(F.first("n").alias("n"), F.first("pos").alias("pos"), F.first("common").alias("common"))
    probe = materialize(probe, "probe")
    found = materialize(prefixes.select("doc_id", "n", "cls", "th"), "sets")
    discard(prefixes, shared)

    # groups: classes link to leaders, the most typical of those with the same smallest shingle, or with a shared token
    order = F.xxhash64("cls")
    lead = classes.groupBy("low").agg(F.max(F.struct("common", order.alias("h"), "cls", "n")).alias("x"), F.max(F.struct(order.alias("h"), "cls", "n")).alias("y"), F.count("*").alias("m")).filter("m > 1")
    lead = lead.select("low", F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"{k}.cls").alias("cls"), F.col(f"{k}.n").alias("n")) for k in "xy"]))).alias("l"))
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    alike = classes.join(lead, "low").filter((F.col("cls") != F.col("l.cls")) & fits(F.col("n"), F.col("l.n"))).select("cls", F.col("l.cls").alias("d"))
    top = probe.groupBy("token").agg(F.max(F.struct("common", order.alias("h"), F.col("cls").alias("d"), F.col("n").alias("m"))).alias("l"))
    near = probe.join(top, "token").filter((F.col("cls") != F.col("l.d")) & fits(F.col("n"), F.col("l.m")))
    near = near.groupBy("cls").agg(F.min(F.struct("pos", F.col("l.d").alias("d"))).alias("x"), F.max("l").alias("y"))
    near = near.select("cls", F.explode(F.array("x.d", "y.d")).alias("d"))
    links = verify(materialize(_ordered(alike.unionByName(near)), "pairs"), docs, classes, width, percent, clash)
    groups = components(links)

    probe_table, probe = probe, _in_groups(probe.drop("common"), groups, "cls", "g")
    index = probe.filter(F.col("pos") < F.col("n") - F.expr(f"(2 * {percent} * n + {99 + percent}) div {100 + percent}") + 1)
    matrix = index.groupBy("token", F.col("g").alias("h")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    needed = lambda a, b: F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")  # noqa: E731  the overlap that links sizes a and b
    smallest = f"greatest(least, ({percent} * n + 99) div 100)"
    bound = (F.least(F.col("n") - F.col("pos"), "rest") >= needed("n", smallest)) & (F.col("least") <= F.col("n")) & (100 * F.col("most") >= percent * F.col("n"))
    # a pair that shares a token and may link meets the bound of the partner's group at that very token: no other is opened
    asks = probe.join(matrix, "token").filter((F.col("g") != F.col("h")) & bound).select("token", "h", F.col("cls").alias("a"), "n", "pos")
    inside = index.select("token", F.col("g").alias("h"), F.col("cls").alias("b"), F.col("n").alias("m"), F.col("pos").alias("p"))
    near = (F.col("m") <= F.col("n")) & (100 * F.col("m") >= percent * F.col("n")) & (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("p")) >= needed("n", "m"))
    more = asks.join(inside, ["token", "h"]).filter(near & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = materialize(more, "candidates")
    discard(probe_table)
    if more.head(1):
        groups = components(links.unionByName(verify(more, docs, classes, width, percent, clash)))

    return found, _in_groups(classes, groups, "cls", "c").select("cls", "doc_id", "rows", "c")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``, and ``class_size``, the rows with an equal set."""
    found, named = grouped(docs, percent, width)
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "c").select("cls", "component_id", "rows")
    out = found.select("doc_id", "n", "cls").join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("rows", F.lit(1)).alias("class_size"))


def deduplicate(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs`` with one document left of each group: that of the smallest id, then text hash; one row of it.

    Rows without shingles all stay. An id that stands for several texts keeps only the one chosen here.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    found, named = grouped(docs, percent, width)
    best = found.filter("n > 0").join(named.select("cls", "c"), "cls").groupBy("c").agg(F.min(F.struct(key.alias("id"), "th")).alias("k"))
    stays = best.select(F.col("k.id").alias("_k"), F.col("k.th").alias("_t"))
    wordy = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # the row as one struct: no name of the documents can clash with these
    kept = docs.filter(wordy).select(F.struct(*docs.columns).alias("_row"), key.alias("_id"), F.xxhash64("text").alias("_h"))
    kept = kept.join(stays, (F.col("_id") == F.col("_k")) & (F.col("_h") == F.col("_t"))).dropDuplicates(["_id", "_h"])
    return kept.select("_row.*").unionByName(docs.filter(~wordy))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "class_size")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
t AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * i >= 80 * (len(x.g) + len(y.g) - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id, (CASE WHEN len(g) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY list_sort(g)) END)::BIGINT AS class_size FROM s JOIN m ON m.doc_id = s.doc_id
"""
