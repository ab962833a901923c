"""Sums over all tested pairs without the pair table.

Ids with the same groups are one class: they were tested together with the same partners, equally often. Classes meet in
dense tiles, whose common groups a matrix product counts, as if no pair had been observed; the pairs that were observed,
as many as the evidence has, and ids met with themselves are set right afterwards. What is summed is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.operators import evidence as E
from evidentia.operators import masks as M
from evidentia.operators import whole
from evidentia.scratch import materialize, ship

#: Groups (of one key) whose bits a class holds; beyond, pairs are counted one by one.
MOST_GROUPS = 4_096
#: Classes of a tile on its sides, tiles that are aimed at, and cells that are counted at once.
WIDE, TALL, AIM, CELLS = 8_192, 4_096, 32, 1 << 22
#: Bytes of a side that may be broadcast.
MOST_BROADCAST = 64 << 20
#: Words of masks that one compiled expression compares; with more, the pair table is made by joins and sums.
MOST_WORDS = 16
_OTHER = {"bait": "prey", "prey": "bait"}


def _counted(words: int, lut: np.ndarray | None, values: int):
    """Sums per class of side 0 (``lut``: values of a pair by its tests) or, over the classes' ``values``, per number of tests."""
    k = 64 * words + 1

    def run(key, table):
        masks = np.stack([table.column(f"m{i}").to_numpy() for i in range(words)], 1)
        bits = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1).astype(np.float32)
        side, weight = table.column("_side").to_numpy(), table.column("w").to_numpy().astype(float)
        a, b, w = bits[side == 0], bits[side == 1].T.copy(), weight[side == 1]
        even = len(w) and (w == w[0]).all()
        v = np.stack([table.column(f"v{i}").to_numpy().astype(float)[side == 0] for i in range(values)], 1) if values else None
        strip, out = max(1, CELLS // max(1, len(w))), []
        total = np.zeros((values, k))
        for i in range(0, len(a), strip) if len(w) else ():
            at = (a[i : i + strip] @ b).astype(np.intp)
            n = len(at)
            at += (np.arange(n) * k)[:, None]
            held = np.bincount(at.ravel(), None if even else np.broadcast_to(w, at.shape).ravel(), n * k).reshape(n, k) * (w[0] if even else 1.0)
            if lut is None:
                total += v[i : i + strip].T @ held
            else:
                out.append(held @ lut)
        keys = [pa.array([x.as_py()] * (k if lut is None else len(a)), x.type) for x in key[:-2]]
        names = table.schema.names[: len(keys)]
        if lut is None:
            return pa.Table.from_arrays([*keys, pa.array(np.arange(k)), *map(pa.array, total)], [*names, "n_tested", *[f"v{i}" for i in range(values)]])
        made = np.concatenate(out) if out else np.zeros((len(a), lut.shape[1]))
        cls = table.column("cls").filter(pa.array(side == 0))
        return pa.Table.from_arrays([*keys, cls, *[pa.array(np.ascontiguousarray(c)) for c in made.T]], [*names, "cls", *[f"s{i}" for i in range(lut.shape[1])]])

    return run


class Profile:
    """The tested and observed pairs of evidence by ``keys``, part of the group."""

    def __init__(self, ev: DataFrame, group: list[str], keys: list[str] = ()):
        self.group, self.keys = list(group), list(keys)
        self.rows = E.evidence(ev, group)
        members = materialize(self.rows.select(*group).distinct(), "groups")
        n, most = members.groupBy(*self.keys).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        self.dense = self.whole = most <= MOST_GROUPS
        if not self.dense:
            return
        ship(ev.sparkSession)
        self.words = -(-most // 64) or 1
        self.whole = self.words <= MOST_WORDS
        self._seen = None
        self.masks = [f"m{i}" for i in range(self.words)]
        at = F.row_number().over(W.partitionBy(*self.keys).orderBy(*group)) - 1
        numbered = members.withColumn("_n", at)
        held = self.rows.join(F.broadcast(numbered) if n <= 100_000 else numbered, group)
        bit = F.expr("shiftleft(1L, _n % 64)")
        each = [F.bit_or(F.when(F.floor(F.col("_n") / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(self.words)]
        self.ids = {role: materialize(held.groupBy(*self.keys, F.col(role).alias("id")).agg(*each), "ids") for role in _OTHER}

    def classes(self, role: str, measures: dict[str, Column] | None = None, of: DataFrame | None = None) -> DataFrame:
        """``*keys, masks, cls, w``, and sums ``v0..`` of the measures over the ids of a class."""
        ids = self.ids[role] if of is None else self.ids[role].join(of.withColumnRenamed(role, "id"), "id", "left")
        values = [F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate((measures or {}).values())]
        return materialize(ids.groupBy(*self.keys, *self.masks).agg(F.min("id").alias("cls"), F.count("*").alias("w"), *values), "classes")

    def met(self, a: DataFrame, b: DataFrame, lut: np.ndarray | None, values: int) -> DataFrame:
        """Tiles of classes ``a`` by classes ``b``; see _counted."""
        na, nb = a.count(), b.count()
        size = lambda n, other: WIDE if n <= other else max(256, min(TALL, -(-n // AIM)))
        x, y = (max(1, -(-n // size(n, o))) for n, o in ((na, nb), (nb, na)))
        block = lambda n: F.pmod(F.xxhash64("cls"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        shown = lambda d, side, v: d.select(*self.keys, "_x", "_y", F.lit(side).alias("_side"), "cls", "w", *self.masks, *[v(i).alias(f"v{i}") for i in range(values)])
        left = shown(a.withColumn("_x", block(x)).withColumn("_y", every(y)), 0, lambda i: F.col(f"v{i}"))
        right = shown(b.withColumn("_y", block(y)).withColumn("_x", every(x)), 1, lambda i: F.lit(0.0))
        spark = a.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(10_000, x * y))
        by = [*self.keys, "_x", "_y"]
        kinds = "".join(f"`{k}` {a.schema[k].dataType.simpleString()}, " for k in self.keys)
        made = f"n_tested long, {', '.join(f'v{i} double' for i in range(values))}" if lut is None else f"cls {a.schema['cls'].dataType.simpleString()}, {', '.join(f's{i} double' for i in range(lut.shape[1]))}"
        return left.unionAll(right).repartition(parts, *by).groupBy(*by).applyInArrow(_counted(self.words, lut, values), kinds + made)

    def _small(self, role: str) -> bool:
        return self.ids[role].count() * 8 * (self.words + 4) <= MOST_BROADCAST

    def tested(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (``*keys, bait, prey`` and others) that were tested, with ``n_tested``."""
        for role, c in (("prey", "k"), ("bait", "m")):
            ids = self.ids[role].select(*self.keys, F.col("id").alias(role), *[F.col(m).alias(f"_{c}{i}") for i, m in enumerate(self.masks)])
            pairs = pairs.join(F.broadcast(ids) if self._small(role) else ids.repartition(*self.keys, role), [*self.keys, role])
        t = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"_m{i}").bitwiseAND(F.col(f"_k{i}"))) for i in range(self.words)]).cast("long")
        return pairs.withColumn("n_tested", t).drop(*[f"_{c}{i}" for c in "mk" for i in range(self.words)]).filter("n_tested > 0")

    def observed(self) -> DataFrame:
        """``*keys, bait, prey, n_observed, n_tested`` of the pairs that were observed."""
        # dealt as the masks of preys are, which are joined next: pairs are shuffled once
        seen = self.rows.filter("bait <> prey").select(*self.keys, "bait", "prey").repartition(*self.keys, "prey").groupBy(*self.keys, "bait", "prey").agg(F.count("*").alias("n_observed"))
        return self.tested(seen)

    def seen(self) -> DataFrame:
        """observed(), written once."""
        if self._seen is None:
            self._seen = materialize(self.observed(), "seen")
        return self._seen

    def selves(self) -> DataFrame:
        """``*keys, bait, prey, n_tested`` of ids that would meet themselves."""
        return self.tested(self.ids["bait"].select(*self.keys, F.col("id").alias("bait"), F.col("id").alias("prey")).join(self.ids["prey"].select(*self.keys, F.col("id").alias("prey")), [*self.keys, "prey"], "left_semi"))


def _corrections(p: Profile) -> DataFrame:
    """Pairs of which n_tested stands in the tiles with no observation: ``o`` null for those that are none."""
    kept = [*p.keys, "bait", "prey", F.col("n_tested").alias("t")]
    return p.observed().select(*kept, F.col("n_observed").alias("o")).unionAll(p.selves().select(*kept, F.lit(None).cast("long").alias("o")))


def pair_sums(ev: DataFrame, group: list[str], sums: dict[str, Callable[[Column, Column], Column]], roles: list[str] = ("bait", "prey"), keys: list[str] = ()) -> DataFrame:
    """``*keys, role, id, n_pairs`` and, per name, the sum over the id's tested partners of a function of tests and observations."""
    keys, p = list(keys), Profile(ev, group, keys)
    spark, none = ev.sparkSession, F.lit(0).cast("long")
    sums = {"n_pairs": lambda t, o: F.lit(1).cast("long"), **sums}
    if not p.dense:
        pairs = E.aggregate_pairs(p.rows, group, [*keys, "bait", "prey"])
        ends = pairs.select(*keys, "n_tested", "n_observed", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("id")) for r in roles])).alias("e")).select("*", "e.*")
        return ends.groupBy(*keys, "role", "id").agg(*[F.sum(f(F.col("n_tested"), F.col("n_observed"))).alias(k) for k, f in sums.items()])
    of = spark.range(1, 64 * p.words + 1).select("id", *[f(F.col("id"), none).alias(k) for k, f in sums.items()])
    kinds = {k: of.schema[k].dataType for k in sums}
    lut = np.zeros((64 * p.words + 1, len(sums)))
    for r in of.collect():  # MOST_GROUPS rows at most
        lut[r["id"]] = [float(x) for x in r[1:]]
    classes = {r: p.classes(r) for r in _OTHER}
    base = []
    for r in roles:
        made = p.met(classes[r], classes[_OTHER[r]], lut, 0).groupBy(*keys, "cls").agg(*[F.sum(f"s{i}").alias(k) for i, k in enumerate(sums)])
        named = p.ids[r].join(classes[r].select(*keys, *p.masks, "cls"), [*keys, *p.masks]).join(made, [*keys, "cls"])
        base.append(named.select(*keys, F.lit(r).alias("role"), "id", *sums))
    ends = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("id")) for r in roles]))
    t, o = F.col("t"), F.col("o")
    moved = _corrections(p).select(*keys, "t", "o", ends.alias("e")).select("*", "e.*").groupBy(*keys, "role", "id")
    moved = moved.agg(*[F.sum(F.when(o.isNull(), -f(t, none)).otherwise(f(t, o) - f(t, none)).cast("double")).alias(k) for k, f in sums.items()])
    out = reduce(DataFrame.unionAll, [*base, moved]).groupBy(*keys, "role", "id").agg(*[F.sum(k).cast(kinds[k]).alias(k) for k in sums])
    return out.filter("n_pairs > 0")


def pair_counts(ev: DataFrame, group: list[str], keys: list[str] = (), measures: DataFrame | None = None, profile: Profile | None = None) -> DataFrame:
    """``*keys, n_tested, n_observed, n``: pairs by their counts. ``measures`` has a row per prey; its other columns, whole
    numbers, are summed over the pairs."""
    keys, p = list(keys), profile or Profile(ev, group, list(keys))
    names = [] if measures is None else [c for c in measures.columns if c != "prey"]
    if not p.dense:
        pairs = E.aggregate_pairs(p.rows, group, [*keys, "bait", "prey"])
        pairs = pairs if measures is None else pairs.join(measures, "prey", "left")
        return pairs.groupBy(*keys, "n_tested", "n_observed").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    prey, bait = p.classes("prey", {"n": F.lit(1), **{c: F.col(c) for c in names}}, measures), p.classes("bait")
    made = p.met(prey, bait, None, 1 + len(names)).filter("n_tested > 0")
    base = made.select(*keys, "n_tested", F.lit(0).cast("long").alias("n_observed"), *[F.col(f"v{i}").cast("long").alias(c) for i, c in enumerate(["n", *names])])
    change = _corrections(p) if measures is None else _corrections(p).join(measures, "prey", "left")
    here, there = [F.lit(1).cast("long"), *[F.coalesce(c, F.lit(0)).cast("long") for c in names]], ["n", *names]
    row = lambda o, s: F.struct(o.alias("n_observed"), *[(c * s).alias(k) for c, k in zip(here, there, strict=True)])
    moves = F.explode(F.array(row(F.lit(0).cast("long"), -1), row(F.coalesce("o", F.lit(0).cast("long")), F.when(F.col("o").isNull(), 0).otherwise(1))))
    moved = change.select(*keys, F.col("t").alias("n_tested"), moves.alias("e")).select(*keys, "n_tested", "e.*")
    out = base.unionAll(moved.select(*base.columns)).groupBy(*keys, "n_tested", "n_observed").agg(*[F.sum(c).alias(c) for c in there])
    return out.filter("n > 0")


def counts_met(p: Profile) -> DataFrame:
    """``*keys, n_tested, n_observed`` that pairs have, each once, and some that no pair has: never observed, for any number of tests."""
    by = [*p.keys, "n_tested", "n_observed"]
    if not p.whole:
        return pair_counts(p.rows, p.group, p.keys, profile=p).select(*by)
    every = p.rows.select(*p.keys).distinct().select(*p.keys, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(64 * p.words).cast("long"))).alias("n_tested"), F.lit(0).cast("long").alias("n_observed"))
    return every.unionAll(p.seen().select(*by).distinct())


def valued_pairs(p: Profile, values: DataFrame, few: bool) -> DataFrame:
    """``*keys, bait, prey, n_tested, n_observed`` of all tested pairs, and what ``values`` has for their keys and counts; ``few``
    of those may be broadcast.

    Pairs are made in the tasks that return them. The ids of one role are broadcast, 64 of a block; those of the other go
    through the blocks of their keys, and a mask per block tells the ids that they were observed with. Values of pairs never
    observed are taken from a list by the number of tests.
    """
    keys, by = p.keys, [*p.keys, "n_tested", "n_observed"]
    names, looked = [c for c in values.columns if c not in by], F.broadcast(values) if few else values.hint("merge")
    if not p.whole:
        return E.aggregate_pairs(p.rows, p.group, [*keys, "bait", "prey"]).join(looked, by).select(*keys, "bait", "prey", "n_tested", "n_observed", *names)
    n = {role: p.ids[role].count() for role in _OTHER}
    held = min(n, key=n.get)
    other, small = _OTHER[held], p._small(held)
    cast = lambda d: F.broadcast(d) if small else d
    numbered = M.numbers(p.ids[held].select(*keys, "id"), [*keys, "id"], n[held], keys).join(p.ids[held], [*keys, "id"])
    numbered = materialize(numbered, "numbered")
    blocks = materialize(numbered.select(*keys, "block").distinct().withColumn("_at", F.monotonically_increasing_id()), "blocks")
    numbered = numbered.join(blocks, [*keys, "block"]).select(*keys, "_at", F.col("id").alias(held), "bit", *[F.col(m).alias(f"_h{i}") for i, m in enumerate(p.masks)])
    numbered = materialize(numbered, "numbered")
    work = M.products(numbered, p.ids[other], keys).agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    parts, on = M.tasks(values, work), [*keys, other]
    known = p.seen().select(*keys, "bait", "prey").join(cast(numbered.select(*keys, held, "_at", "bit")), [*keys, held]).repartition(parts, *on)
    known = known.groupBy(*on, "_at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("_m")).groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_m"))).alias("_seen"))
    listed = values.filter("n_observed = 0").groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(F.struct("n_tested", c))).alias(c) for c in names])
    by_tests = lambda c: F.expr(f"transform(sequence(0L, {64 * p.words}L), t -> `{c}`[t])")
    listed = listed.select(*keys, *[by_tests(c).alias(f"_{c}") for c in names])
    listed = materialize(blocks.groupBy(*keys).agg(F.collect_list("_at").alias("_every")).join(listed, keys), "listed")
    rows = p.ids[other].withColumnRenamed("id", other).repartition(parts, *on).join(known, on, "left").join(F.broadcast(listed), keys)  # a row per key
    rows = rows.select("*", F.explode("_every").alias("_at")).withColumn("_m", F.coalesce(F.col("_seen")[F.col("_at")], F.lit(0).cast("long"))).drop("_every", "_seen")
    tests = reduce(lambda x, y: x + y, [F.bit_count(F.col(m).bitwiseAND(F.col(f"_h{i}"))) for i, m in enumerate(p.masks)])
    free = (F.expr("shiftright(_m, bit)").bitwiseAND(F.lit(1).cast("long")) == 0) & (F.col("bait") != F.col("prey"))
    rows = rows.join(cast(numbered.drop(*keys)), "_at").withColumn("n_tested", tests).filter(free & (F.col("n_tested") > 0))
    rows = rows.select(*keys, "bait", "prey", F.col("n_tested").cast("long").alias("n_tested"), F.lit(0).cast("long").alias("n_observed"), *[F.get(f"_{c}", F.col("n_tested")).alias(c) for c in names])
    return rows.unionAll(p.seen().join(looked, by).select(*rows.columns))


def pairs_at(p: Profile, at: list[tuple[int, int]]) -> DataFrame:
    """The pairs ``bait, prey`` with one of the given counts of tests and observations."""
    few = lambda d: d.filter(reduce(lambda x, y: x | y, [(F.col("n_tested") == t) & (F.col("n_observed") == o) for t, o in at])).select("bait", "prey")
    return few(p.observed() if p.dense and all(o for _, o in at) else E.aggregate_pairs(p.rows, p.group))


def _selected(words: int, signs: np.ndarray):
    """Pairs of a tile that were not observed and whose number of tests has a sign, -1 where it has none."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, seen = whole.sides(batches)
        if not left.num_rows or not right.num_rows:
            return
        bits = []
        for t in (left, right):
            masks = np.stack([whole.column(t, f"m{i}").to_numpy(zero_copy_only=False) for i in range(words)], 1)
            bits.append(np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1).astype(np.float32))
        a, b = bits[0], bits[1].T.copy()
        u, v = whole.column(left, "a"), whole.column(right, "a")
        n = len(v)
        p, q = whole.places(whole.column(seen, "a"), u), whole.places(whole.column(seen, "b"), v)
        self = whole.places(u, v)
        p, q = np.concatenate((p, np.flatnonzero(self >= 0))), np.concatenate((q, self[self >= 0]))
        out = np.sort((p * n + q)[(p >= 0) & (q >= 0)])
        strip = max(1, CELLS // 4 // n)
        for i in range(0, len(u), strip):
            sign = signs[(a[i : i + strip] @ b).astype(np.uint16)].ravel()
            lo, hi = np.searchsorted(out, (i * n, (i + strip) * n))
            sign[out[lo:hi] - i * n] = -1
            at = np.flatnonzero(sign >= 0)
            if len(at):
                yield pa.RecordBatch.from_arrays([u.take(pa.array(at // n + i)), v.take(pa.array(at % n)), pa.array(sign[at].astype(np.int32))], ["bait", "prey", "sign"])

    return run


def selected_edges(ev: DataFrame, group: list[str], positive: float, tested: int, wide: int = WIDE) -> DataFrame:
    """``bait, prey, sign`` as evidence.select_edges gives for the posteriors of all pairs.

    Observed pairs, as many as the evidence has, are scored one by one. The sign of the others is a matter of their number of
    tests alone: ids with too few groups for any sign go, the rest meet in tiles that return the pairs with a sign only.
    """
    rows = E.evidence(ev, group)
    p, rate = Profile(rows, group), materialize(E.pair_totals(rows, group), "rate")
    signed = lambda pairs: E.select_edges(E.posterior(pairs, totals=rate), positive, tested)
    if not p.dense:
        return signed(E.aggregate_pairs(rows, group)).select("bait", "prey", "sign")
    spark, signs = ev.sparkSession, np.full(64 * p.words + 1, -1, np.int8)
    for r in signed(spark.range(1, len(signs)).select(F.col("id").alias("n_tested"), F.lit(0).cast("long").alias("n_observed"))).collect():
        signs[r["n_tested"]] = r["sign"]  # MOST_GROUPS rows at most
    seen = materialize(p.observed().select("bait", "prey", "n_tested", "n_observed"), "seen")
    found = signed(seen).select("bait", "prey", "sign")
    if (signs < 0).all():
        return found
    least = int(np.flatnonzero(signs >= 0)[0])
    count = reduce(lambda x, y: x + y, [F.bit_count(m) for m in p.masks])
    ids = {role: p.ids[role].filter(count >= least) for role in _OTHER}
    nb, np_ = (ids[role].count() for role in ("bait", "prey"))
    if not nb or not np_:
        return found
    # few ids: some tiles all the same
    x = max(1, -(-nb // wide))
    y = max(1, -(-np_ // wide), min(AIM, nb * np_ // CELLS, np_))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = {role: ids[role].schema["id"].dataType.simpleString() for role in _OTHER}
    none = lambda kind: F.lit(None).cast(kind)
    left = ids["bait"].select(block("id", x).alias("_x"), every(y).alias("_y"), F.lit(0).alias("_side"), F.col("id").alias("a"), none(kinds["prey"]).alias("b"), *p.masks)
    right = ids["prey"].select(every(x).alias("_x"), block("id", y).alias("_y"), F.lit(1).alias("_side"), F.col("id").alias("a"), none(kinds["prey"]).alias("b"), *p.masks)
    known = seen.filter(F.col("n_tested") >= least).select(block("bait", x).alias("_x"), block("prey", y).alias("_y"), F.lit(2).alias("_side"), F.col("bait").alias("a"), F.col("prey").alias("b"), *[none("long").alias(m) for m in p.masks])
    made = whole.dealt(left.unionAll(right).unionAll(known), 4 * x * y).applyInArrow(_selected(p.words, signs), f"bait {kinds['bait']}, prey {kinds['prey']}, sign int")
    return found.unionAll(made)


def endpoint_degrees(ev: DataFrame, group: list[str]) -> DataFrame:
    """As evidence.endpoint_degrees gives for all pairs: ``id, sum_tests, deg_pos, deg_neg, deg_tested``."""
    s = pair_sums(ev, group, {"sum_tests": lambda t, o: t, "deg_pos": lambda t, o: (o > 0).cast("long")})
    d = s.groupBy("id").agg(F.sum("sum_tests").alias("sum_tests"), F.sum("deg_pos").alias("deg_pos"), F.sum("n_pairs").alias("deg_tested"))
    return d.select("id", "sum_tests", "deg_pos", (F.col("deg_tested") - F.col("deg_pos")).alias("deg_neg"), "deg_tested")


def flagged_totals(ev: DataFrame, group: list[str], listed: DataFrame, out: str) -> DataFrame:
    """``out, n_tested, n_observed``: counts of the tested pairs in ``listed`` (``bait, prey``) against all others, which are the
    rest of the totals."""
    listed, p = listed.select("bait", "prey").dropna().distinct(), Profile(ev, group)
    if not p.dense:
        held = E.aggregate_pairs(p.rows, group).join(listed, ["bait", "prey"], "left_semi")
    else:
        seen = p.rows.groupBy("bait", "prey").agg(F.count("*").alias("n_observed"))
        held = p.tested(listed.filter("bait <> prey")).join(seen, ["bait", "prey"], "left").fillna(0, ["n_observed"])
    here = materialize(held.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tested", "n_observed")]), "listed")
    rest = E.pair_totals(p.rows, group).crossJoin(here.select(F.col("n_tested").alias("_t"), F.col("n_observed").alias("_o")))  # one row each
    rest = rest.select(F.lit(False).alias(out), (F.col("n_tested") - F.col("_t")).alias("n_tested"), (F.col("n_observed") - F.col("_o")).alias("n_observed"))
    return here.select(F.lit(True).alias(out), "n_tested", "n_observed").unionAll(rest).filter("n_tested > 0")
