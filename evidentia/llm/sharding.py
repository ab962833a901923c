"""Sharding by balanced label propagation over groups of equal texts.

Linked documents (equal texts; null counts as empty) are nodes of one clique each, so a group's state is how
many of its members each shard holds: at most one row per group and shard, never a pair of documents. In each
round the members outside one shard of a group ask to move there, where as many or more of their neighbours are.
Moves are granted along paths that end at a free quota and along circles of shards, whose sizes stay; every move
cuts fewer links, and rounds go on until no move is left. Documents without links fill what is left, so the law
`rows` holds: shard sizes differ by one at most. Only DataFrame functions are used.

Defined cases: null text has size 1 and CRC 0; null, repeated and equal ids are separate rows; a group larger
than a shard fills as many shards as it needs, or more where others lie whole in their way; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.llm.common import bucket_of, discard, materialize, running, unit

#: Rows that one window task orders at most, on average.
BUCKET = 20_000


def _buckets(n: int) -> int:
    return max(1, n // BUCKET)


def granted(wishes: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """Of the members that ask to go from one shard to another, how many may: along circles, and paths to free room."""
    left, free, out = {k: n for k, n in wishes.items() if n > 0}, list(free), {}

    def walk(begin: int, goal) -> list[tuple[int, int]]:
        came, queue = {}, [begin]
        for s in queue:
            for t in (t for a, t in left if a == s):
                if goal(t):
                    path = [(s, t)]
                    while path[0][0] != begin:
                        path.insert(0, (came[path[0][0]], path[0][0]))
                    return path
                if t not in came and t != begin:
                    came[t] = s
                    queue.append(t)
        return []

    for begin in range(len(free)):
        for goal in (lambda t: free[t] > 0, lambda t: t == begin):  # noqa: B023
            while path := walk(begin, goal):
                end = path[-1][1]
                n = min(left[k] for k in path)
                if end != begin:
                    n = min(n, free[end])
                    free[end] -= n
                    free[begin] += n
                for k in path:
                    out[k] = out.get(k, 0) + n
                    left[k] -= n
                    if not left[k]:
                        del left[k]
    return out


def circle(options: dict[tuple[int, int], dict[bytes, int]], free: list[int]) -> list[tuple[bytes, int, int, int]]:
    """One circle of shards, or path to free room, of moves ``(g, shard, to, n)`` of different groups; empty if there is none."""

    def seek(begin: int, s: int, path: list) -> list:
        for t in (t for a, t in options if a == s and t not in {x[2] for x in path}):
            g = next((g for g in options[s, t] if g not in {x[0] for x in path}), None)
            if g is None:
                continue
            step = [*path, (g, s, t, options[s, t][g])]
            if free[t] > 0 or t == begin:
                n = min([x[3] for x in step] + ([free[t]] if t != begin else []))
                return [(g, a, b, n) for g, a, b, _ in step]
            if t not in dead and (found := seek(begin, t, step)):
                return found
        dead.add(s)
        return []

    for begin in range(len(free)):
        dead: set[int] = set()
        if found := seek(begin, begin, []):
            return found
    return []


def _options(state: DataFrame, salt: int) -> dict[tuple[int, int], dict[bytes, int]]:
    """Per pair of shards, some groups with members in the first and as many or more in the second: 512 at most."""
    other = state.select("g", F.col("shard").alias("to"), F.col("n").alias("_m"))
    may = state.join(other, "g").filter((F.col("to") != F.col("shard")) & (F.col("_m") >= F.col("n")))
    one = F.struct("g", "n")
    some = may.groupBy("shard", "to", F.pmod(F.xxhash64("g", F.lit(salt)), F.lit(256)).alias("_b")).agg(F.min(one).alias("x"), F.max(one).alias("y"))
    out: dict[tuple[int, int], dict[bytes, int]] = {}
    for r in some.collect():
        for g in (r["x"], r["y"]):
            out.setdefault((r["shard"], r["to"]), {})[bytes(g["g"])] = g["n"]
    return out


def propagate(groups: DataFrame, room: list[int], rounds: int | None = None) -> DataFrame:
    """``g, size`` to ``g, shard, n``: members of each group per shard.

    Starts from an even deal of all members over the shards and stops when no move is left, or after ``rounds``.
    ``room`` is what each shard may hold; as many rows as pairs of shards are read back per round. Where the groups'
    best shards are full, other shards are tried, and at last a single circle is sought on the driver.
    """
    shards = len(room)
    spark = groups.sparkSession
    n = groups.count()
    dealt = groups.withColumn("_u", unit(F.col("g"))).withColumn("_b", bucket_of(F.col("_u"), _buckets(n)))
    dealt = running(dealt, [], "_b", [F.col("_u"), F.col("g")], F.col("size"), "_at")
    dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    upto = lambda c: F.floor((c + F.lit(shards - 1) - F.col("shard")) / shards)  # noqa: E731  places below c that fall to the shard
    dealt = dealt.withColumn("n", (upto(F.col("_at") + F.col("size")) - upto(F.col("_at"))).cast("long")).filter("n > 0")
    state = materialize(dealt.select("g", "shard", "n"), "state")
    rule, at, circles = 0, 0, []
    while rounds is None or at < rounds:
        at += 1
        load = {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("n")).collect()}
        free = [room[s] - load.get(s, 0) for s in range(shards)]
        frees = spark.createDataFrame([(s, f) for s, f in enumerate(free) if f > 0] or [(-1, 0)], "shard int, free long")
        # the group's best shard with room, its best shard, or any
        turn = F.xxhash64("g", "shard", F.lit(at if rule else 0))
        rank = F.struct(turn, "n") if rule == 2 else F.struct("n", turn)
        to = F.struct(rank.alias("rank"), "n", "shard")
        to = F.max(F.when(F.col("free").isNotNull(), to) if rule == 0 else to).over(W.partitionBy("g"))
        tried = state.join(F.broadcast(frees), "shard", "left").withColumn("to", to)  # one row per shard
        asks = (F.col("n") <= F.col("to.n")) if rule == 2 else (rank < F.col("to.rank"))
        tried = tried.filter(F.col("to").isNotNull() & asks & (F.col("shard") != F.col("to.shard")))
        wish = materialize(tried.select("g", "shard", "n", F.col("to.shard").alias("to")), "wishes")
        wishes = {(r[0], r[1]): r[2] for r in wish.groupBy("shard", "to").agg(F.sum("n")).collect()}
        quota = spark.createDataFrame([(*k, n) for k, n in granted(wishes, free).items()] or [(-1, -1, 0)], "shard int, to int, quota long")
        grant = wish.withColumn("_u", unit(F.col("g"))).withColumn("_b", bucket_of(F.col("_u"), _buckets(n)))
        grant = running(grant, ["shard", "to"], "_b", [F.col("_u"), F.col("g")], F.col("n"), "_before").join(F.broadcast(quota), ["shard", "to"])
        grant = grant.withColumn("moved", F.least("n", F.col("quota") - F.col("_before"))).filter("moved > 0")
        moves = materialize(grant.select("g", "shard", "to", "moved"), "moves")
        discard(wish)
        if not moves.head(1):
            if rule == 0:
                circles = circle(_options(state, at), free)
                if not circles:
                    discard(moves)
                    break
            if rule < 2:
                discard(moves)
                rule += 1
                continue
            discard(moves)
            moves = materialize(spark.createDataFrame(circles, "g binary, shard int, to int, moved long"), "moves")
            rule = 0
        elif rule:
            rule = 0
        out = moves.select("g", "shard", (-F.col("moved")).alias("n"))
        into = moves.select("g", F.col("to").alias("shard"), F.col("moved").alias("n"))
        new = state.unionByName(out).unionByName(into).groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
        old, state = state, materialize(new, "state")
        discard(old, moves)
    return state


def cut_edges(state: DataFrame) -> DataFrame:
    """Pairs of linked documents that lie in different shards, by arithmetic on the counts."""
    per = state.groupBy("g").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    return per.agg(F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("sq")) / 2), F.lit(0.0)).cast("long").alias("cut_edges"))


def shard(docs: DataFrame, shards: int = 16, rounds: int | None = None, text: str = "text") -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, shard, slot`` (from 0, without gaps, within the shard)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("g"))
    base = base.withColumn("_row", F.monotonically_increasing_id()).withColumn("_u", unit(F.struct("doc_id", "_row")))
    base = materialize(base, "rows")
    rows = base.count()
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    groups = materialize(base.groupBy("g").agg(F.count("*").alias("size")).filter("size > 1"), "groups")
    state = propagate(groups, room, rounds)
    # places of a group's members, in order of shard: member r goes to the first shard whose end lies above r
    ends = W.partitionBy("g").orderBy("shard")
    plan = state.withColumn("end", F.sum("n").over(ends)).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends"), F.sum("n").alias("members"))
    joined = base.join(plan, "g", "left")
    load = {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("n")).collect()}
    fill, at = [], 0
    for s in range(shards):
        at += room[s] - load.get(s, 0)
        fill.append((at, s))
    loose = F.array(*[F.struct(F.lit(e).cast("long").alias("end"), F.lit(s).alias("shard")) for e, s in fill])
    # documents without links are one group of their own, spread over buckets like any large group
    joined = joined.withColumn("_linked", F.col("ends").isNotNull()).withColumn("ends", F.coalesce("ends", loose))
    own = F.when(F.col("_linked"), F.col("g")).otherwise(F.lit(b"").cast("binary"))
    joined = joined.withColumn("g", own).withColumn("_b", bucket_of(F.col("_u"), F.ceil(F.coalesce("members", F.lit(rows)) / BUCKET)))
    placed = running(joined, ["g"], "_b", [F.col("_u"), F.col("_row")], F.lit(1), "_r")
    placed = placed.withColumn("shard", F.get(F.filter("ends", lambda e: e["end"] > F.col("_r")), F.lit(0))["shard"].cast("int"))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "_u", "_row", bucket_of(F.col("_u"), _buckets(rows)).alias("_b"))
    placed = materialize(placed, "placed")
    out = running(placed, ["shard"], "_b", [F.col("_u"), F.col("_row")], F.lit(1), "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
