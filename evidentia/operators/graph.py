"""Signed edge sets: pruning to common nodes, complements, degree balance, splits and similarity."""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import flows
from evidentia.operators.masks import ordered_pairs
from evidentia.operators.stats import hash_unit
from evidentia.scratch import discard, materialize, running, ship

#: Edges of a network that one task may hold and balance by maximum flows.
MOST_EDGES = 2_000_000


def _ends(edges: DataFrame, a: str, b: str, directed: bool, *carry: str) -> DataFrame:
    """Both ends of each edge as ``role, node``; undirected ends have one role."""
    end = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("node"))
    return edges.select(F.explode(F.array(end(0, a), end(int(directed), b))).alias("e"), *carry).select("e.*", *carry)


def prune(edges: DataFrame, a: str = "src", b: str = "dst", sign: str = "sign", directed: bool = False, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges whose both ends have edges of both signs, to the fixpoint, or after ``rounds``; and the excluded ``node``.

    Directed ends are counted by role, and excluded is what was exclusive to one sign in some round; undirected,
    excluded is what had both signs at first and was lost. Every round is written to the scratch folder.
    """
    edges, at, lost = materialize(edges, "edges"), 0, []
    signs = lambda e: _ends(e, a, b, directed, sign).groupBy("role", "node").agg((F.min(sign) == F.max(sign)).alias("one"))
    first = materialize(signs(edges).filter(~F.col("one")).select("node").distinct(), "common")
    while rounds is None or at < rounds:
        at += 1
        one = materialize(signs(edges).filter("one").select("role", "node"), "exclusive")
        if not one.head(1):
            break
        lost.append(one.select("node"))
        old = edges
        for role, c in ((0, a), (int(directed), b)):
            edges = edges.join(one.filter(F.col("role") == role).select(F.col("node").alias(c)), c, "left_anti")
        edges = materialize(edges.select(*old.columns), "edges")
        discard(old)
    if not directed:
        return edges, first.join(_ends(edges, a, b, False).select("node").distinct(), "node", "left_anti")
    gone = first.limit(0)
    for x in lost:
        gone = gone.unionByName(x)
    return edges, gone.distinct()


def exclusive_prune(edges: DataFrame, a: str = "src", b: str = "dst", sign: str = "sign", directed: bool = False, rounds: int | None = None) -> DataFrame:
    """The edges that prune keeps."""
    return prune(edges, a, b, sign, directed, rounds)[0]


def complement_edges(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Undirected pairs of nodes without an edge, in order. The result itself is quadratic in the nodes."""
    nodes = materialize(edges.select(F.explode(F.array(a, b)).alias("v")).distinct(), "nodes")
    known = edges.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()
    return ordered_pairs(nodes, "v", a, b).join(known, [a, b], "left_anti")


def _exchanges(met: DataFrame, known: DataFrame, chosen: DataFrame, hashed) -> DataFrame:
    """Stubs ``x, y`` that cannot be joined, each with a chosen pair ``old`` to give up for ``first`` and ``second``.

    Every chosen pair is offered to one pair of stubs by its hash, and of those that make two new pairs the smallest
    hash is taken. No new pair is an edge, a loop, chosen already or made twice.
    """
    n = met.count()
    if not n:
        return chosen.select("x", "y", *[F.struct("x", "y").alias(c) for c in ("old", "first", "second")]).limit(0)
    stubs = running(met.select("p", F.col("x").alias("u"), F.col("y").alias("v")), [], [F.asc("p")], {"q": ("sum", F.lit(1).cast("long"))})
    offers = chosen.select(F.struct("x", "y").alias("old"), hashed.alias("h"), (F.pmod(hashed, F.lit(n)) + 1).alias("q"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    made = offers.join(stubs, "q").withColumn("first", pair("u", "old.x")).withColumn("second", pair("v", "old.y"))
    made = made.filter("first.x <> first.y and second.x <> second.y and first <> second")
    for c in ("first", "second"):
        taken = known.unionByName(chosen).select(F.struct("x", "y").alias(c))
        made = made.join(taken, c, "left_anti")
    best = materialize(made.groupBy("q").agg(F.min(F.struct("h", "u", "v", "old", "first", "second")).alias("b")).select("q", "b.*"), "offers")
    new = best.select("q", F.explode(F.array("first", "second")).alias("e"))
    late = new.join(new.groupBy("e").agg(F.min("q").alias("owner")), "e").filter("q <> owner").select("q").distinct()
    return best.join(late, "q", "left_anti").select(F.col("u").alias("x"), F.col("v").alias("y"), "old", "first", "second")


def random_negatives(edges: DataFrame, a: str = "src", b: str = "dst", seed: int = 1) -> DataFrame:
    """Undirected pairs without an edge, in which no node exceeds its degree in ``edges``, and nearly all reach it.

    Every node puts as many stubs as it lacks edges into a hashed order and neighbours are paired; pairs that are edges,
    loops or repeats fall apart again. Where none holds, chosen pairs are exchanged for two new ones each. Rounds go on
    until nothing is lacking or three add nothing. So the complement is never made; a maximum flow over it could still
    place the few stubs that are left.
    """
    known = materialize(edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).filter("x <> y").distinct(), "known")
    left = materialize(known.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count("*").alias("d")), "lacking")
    chosen, at, idle = known.limit(0), 0, 0
    while idle < 3 and left.head(1):
        at += 1
        stubs = left.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("d"))))
        order = running(stubs.select("v", F.xxhash64("v", "k", F.lit(seed), F.lit(at)).alias("u")), [], [F.asc("u"), F.asc("v")], {"n": ("sum", F.lit(1).cast("long"))})
        met = order.groupBy(F.shiftright(F.col("n") - 1, 1).alias("p")).agg(F.min("v").alias("x"), F.max("v").alias("y"), F.count("*").alias("c"))
        new = met.filter("c = 2 and x <> y").select("x", "y").distinct().join(known, ["x", "y"], "left_anti")
        met, new = met.filter("c = 2"), materialize(new.join(chosen, ["x", "y"], "left_anti"), "pairs")
        if new.head(1):
            placed, chosen = new, materialize(chosen.unionByName(new), "chosen")
        else:
            placed = materialize(_exchanges(met, known, chosen, F.xxhash64("x", "y", F.lit(seed), F.lit(at))), "exchanges")
            if not placed.head(1):
                idle += 1
                continue
            pairs = lambda *names: placed.select(F.explode(F.array(*names)).alias("e")).select("e.*")
            chosen = materialize(chosen.join(pairs("old"), ["x", "y"], "left_anti").unionByName(pairs("first", "second")), "chosen")
        idle = 0
        used = placed.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count("*").alias("m"))
        left = materialize(left.join(used, "v", "left").select("v", (F.col("d") - F.coalesce("m", F.lit(0))).alias("d")).filter("d > 0"), "lacking")
    return chosen.select(F.col("x").alias(a), F.col("y").alias(b))


def degree_divergence(edges: DataFrame, a: str = "src", b: str = "dst", sign: str = "sign") -> DataFrame:
    """Per node, positive and negative degree and their distance."""
    d = _ends(edges, a, b, False, sign).groupBy("node").agg(F.sum((F.col(sign) == 1).cast("long")).alias("deg_pos"), F.sum((F.col(sign) == 0).cast("long")).alias("deg_neg"))
    return d.withColumn("divergence", F.abs(F.col("deg_pos") - F.col("deg_neg")))


class Flow:
    """Maximum flow by level graphs and blocking paths."""

    def __init__(self):
        self.to, self.room, self.out = [], [], defaultdict(list)

    def add(self, u, v, room: int) -> int:
        for x, y, r in ((u, v, room), (v, u, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, source, sink) -> int:
        total = 0
        while True:
            level, queue = {source: 0}, deque([source])
            while queue:
                u = queue.popleft()
                for e in self.out[u]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[u] + 1
                        queue.append(self.to[e])
            if sink not in level:
                return total
            at = dict.fromkeys(level, 0)
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    total += push
                    path, u = [], source
                    continue
                while at[u] < len(self.out[u]):
                    e = self.out[u][at[u]]
                    if self.room[e] and level.get(self.to[e], -1) == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(self.out[u]):
                    path.append(self.out[u][at[u]])
                    u = self.to[path[-1]]
                elif path:
                    u = self.to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def degree_constrained(pairs: list[tuple], caps_out: dict, caps_in: dict) -> list[int]:
    """Indices of a largest set of edges in which no node exceeds its capacity, by role."""
    f = Flow()
    for v, c in caps_out.items():
        f.add("s", ("o", v), c)
    for v, c in caps_in.items():
        f.add(("i", v), "t", c)
    mine = [f.add(("o", u), ("i", v), 1) for u, v in pairs]
    f.run("s", "t")
    return [i for i, e in enumerate(mine) if not f.room[e]]


def degree_constrained_undirected(pairs: list[tuple], caps: dict, most: int) -> list[int]:
    """Indices of ``most`` edges or fewer in which no node exceeds its capacity, counted at both ends.

    Every edge is an arc each way; an edge that the flow takes both ways stays, and of those it takes one way as many as
    fit, those whose ends have the largest share of their capacity left first.
    """
    f = Flow()
    for v, c in caps.items():
        f.add("s", ("o", v), c)
        f.add(("i", v), "t", c)
    mine = [(f.add(("o", u), ("i", v), 1), f.add(("o", v), ("i", u), 1)) for u, v in pairs]
    f.run("s", "t")
    taken = [(not f.room[x]) + (not f.room[y]) for x, y in mine]
    chosen, left = [i for i, k in enumerate(taken) if k == 2], dict(caps)
    for i in chosen:
        for v in pairs[i]:
            left[v] -= 1
    score = lambda i: sum(left[v] / caps[v] for v in pairs[i])
    heap = [(-score(i), i) for i, k in enumerate(taken) if k == 1]
    heapq.heapify(heap)
    while heap and len(chosen) < most:
        old, i = heapq.heappop(heap)
        u, v = pairs[i]
        if left[u] < 1 + (u == v) or left[v] < 1:
            continue
        if -score(i) > old:  # its ends have been used since
            heapq.heappush(heap, (-score(i), i))
            continue
        chosen.append(i)
        left[u] -= 1
        left[v] -= 1
    return sorted(chosen)


def _common(pos: list[tuple], neg: list[tuple], directed: bool) -> tuple[list[tuple], list[tuple], set]:
    """Edges whose ends both signs have, to the fixpoint, and the excluded nodes; directed ends are counted by role."""
    nodes = lambda edges: ({u for u, _ in edges}, {v for _, v in edges}) if directed else ({v for e in edges for v in e},) * 2
    first, gone = None, set()
    while True:
        (po, pi), (no, ni) = nodes(pos), nodes(neg)
        first = po & no if first is None else first
        gone |= (po ^ no) | (pi ^ ni)
        n = len(pos) + len(neg)
        pos, neg = ([(u, v) for u, v in edges if u in po & no and v in pi & ni] for edges in (pos, neg))
        if len(pos) + len(neg) == n:
            return pos, neg, gone if directed else first - (po & no)


def _degrees(edges: list[tuple], directed: bool) -> tuple[dict, dict]:
    out, into = defaultdict(int), defaultdict(int)
    for u, v in edges:
        out[u] += 1
        (into if directed else out)[v] += 1
    return out, into


def _balance(min_flow: float, directed: bool, seed: int = 1):
    """Positive and negative edges of one network cut to nearly equal degrees: maximum flows in turn.

    The negatives are cut to what the positives' degrees hold, then these to theirs, until a flow reaches ``min_flow`` of
    its target and the positives are within ``most``. While they are not, and a flow is nearly full, some 30 % of the
    overshoot is taken off the next flow's capacities, at random by seed and network.
    """

    def within(edges: list[tuple], other: list[tuple], cut: int, rng) -> list[tuple]:
        out, into = _degrees(other, directed)
        edges = [e for e in edges if e[0] in out and e[1] in (into if directed else out)]
        for _ in range(cut):  # an arc of the flow loses one unit: an end's capacity, or an edge
            k = int(rng.integers(len(out) + len(into) + len(edges)))
            if k < len(out) + len(into):
                side, key = (out, list(out)[k]) if k < len(out) else (into, list(into)[k - len(out)])
                side[key] = max(0, side[key] - 1)
            elif edges:
                edges[k - len(out) - len(into)] = edges[-1]
                edges.pop()
            if not edges:
                break
        edges = sorted(edges)
        if directed:
            return [edges[i] for i in degree_constrained(edges, out, into)]
        return [edges[i] for i in degree_constrained_undirected(edges, out, len(other))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf.network_id.iloc[0]
        most = pdf.most.iloc[0] if "most" in pdf and pd.notna(pdf.most.iloc[0]) else None
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
        pdf = pdf.sort_values(["src", "dst"]).reset_index(drop=True)
        sets = [list(zip(g.src, g.dst, strict=True)) for g in (pdf[pdf.sign == 1], pdf[pdf.sign == 0])]
        share, at, cut = 0.0, 0, 0
        while share < min_flow or (most is not None and len(sets[0]) > most):
            target = sets[at % 2]
            took = within(sets[(at + 1) % 2], target, cut, rng)
            share = len(took) / len(target) if target else 1.0
            sets[(at + 1) % 2] = took
            over = len(sets[0]) - most if most is not None else 0
            cut = int(over * 0.3) + 1 if over > 0 and share >= 0.99 else 0
            at += 1
        pos, neg, gone = _common(*sets, directed)
        rows = [(name, u, v, 1) for u, v in pos] + [(name, u, v, 0) for u, v in neg] + [(name, v, v, -1) for v in sorted(gone)]
        return pd.DataFrame(rows, columns=["network_id", "src", "dst", "sign"])

    return run


def _within_by_rounds(edges: DataFrame, other: DataFrame, directed: bool, seed: int) -> DataFrame:
    """Edges of any networks in which no node exceeds its degree in ``other``: chosen in rounds by hashed order.

    An edge stays when it is among the first of both its ends that still have room; full ends lose their other edges. So
    the choice cannot be extended, though a maximum flow may find a larger one.
    """
    net = ["network_id"]
    room = materialize(_ends(other, "src", "dst", directed, *net).groupBy(*net, "role", "node").agg(F.count("*").alias("room")), "room")
    left = materialize(edges.select(*net, "src", "dst").distinct(), "left")
    chosen = left.limit(0)
    while True:
        for role, c in ((0, "src"), (int(directed), "dst")):
            mine = room.filter((F.col("role") == role) & (F.col("room") > 0)).select(*net, F.col("node").alias(c), F.col("room").alias(f"_r{c}"))
            left = left.join(mine, [*net, c])
        left = materialize(left.withColumn("_u", F.xxhash64("src", "dst", F.lit(seed))), "left")
        if not left.head(1):
            return chosen
        ends = _ends(left, "src", "dst", directed, *net, "_u", "src", "dst", "_rsrc", "_rdst")
        place = running(ends, [*net, "role", "node"], [F.asc("_u"), F.asc("src"), F.asc("dst")], {"_at": ("sum", F.lit(1).cast("long"))})
        own = F.when(F.col("role") == 0 if directed else F.col("node") == F.col("src"), F.col("_rsrc")).otherwise(F.col("_rdst"))
        fits = F.col("_at") <= own
        took = materialize(place.groupBy(*net, "src", "dst").agg(F.min(fits.cast("int")).alias("ok")).filter("ok = 1").select(*net, "src", "dst"), "took")
        used = _ends(took, "src", "dst", directed, *net).groupBy(*net, "role", "node").agg(F.count("*").alias("m"))
        room = materialize(room.join(used, [*net, "role", "node"], "left").select(*net, "role", "node", (F.col("room") - F.coalesce("m", F.lit(0))).alias("room")), "room")
        chosen = materialize(chosen.unionByName(took), "chosen")
        left = left.select(*net, "src", "dst").join(took, [*net, "src", "dst"], "left_anti")


def _balance_by_rounds(edges: DataFrame, min_flow: float, directed: bool, seed: int) -> DataFrame:
    sets = [edges.filter(F.col("sign") == s).select("network_id", "src", "dst") for s in (1, 0)]
    at, low = 0, True
    while low:
        target = sets[at % 2]
        sets[(at + 1) % 2] = _within_by_rounds(sets[(at + 1) % 2], target, directed, seed)
        n = target.groupBy("network_id").agg(F.count("*").alias("n")).join(sets[(at + 1) % 2].groupBy("network_id").agg(F.count("*").alias("m")), "network_id", "left")
        low = bool(n.filter(F.coalesce("m", F.lit(0)) < min_flow * F.col("n")).head(1))
        at += 1
    both = sets[0].withColumn("sign", F.lit(1)).unionByName(sets[1].withColumn("sign", F.lit(0)))
    # prune within networks: nodes are told apart by their network
    own = lambda c: F.struct("network_id", F.col(c).alias("v")).alias(c)
    left = exclusive_prune(both.select("network_id", own("src"), own("dst"), "sign"), directed=directed)
    return left.select("network_id", F.col("src.v").alias("src"), F.col("dst.v").alias("dst"), "sign")


def balance_degrees(edges: DataFrame, min_flow: float = 0.95, directed: bool = True, seed: int = 1, most_edges: int = MOST_EDGES, discarded: bool = False) -> DataFrame:
    """Per ``network_id``, positive and negative edges of nearly equal degrees, by role if ``directed``.

    An optional column ``most`` limits a network's positive edges. Nodes that are left with edges of one sign go at
    the end; ``discarded`` returns them too, as loops with sign -1. A network of up to ``most_edges`` is one task, as each
    flow looks at all of it; larger ones are balanced in rounds over all tasks, without a limit.
    """
    ship(edges.sparkSession)
    schema = "network_id string, src long, dst long, sign int"
    most = [F.col("most").cast("double").alias("most")] if "most" in edges.columns else []
    rows = materialize(edges.select(F.col("network_id").cast("string").alias("network_id"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("sign").cast("int").alias("sign"), *most), "networks")
    sizes = rows.groupBy("network_id").agg(F.count("*").alias("n"))
    large = [r[0] for r in sizes.filter(F.col("n") > most_edges).collect()]  # as many as networks of that size
    out = rows.filter(~F.col("network_id").isin(large)).groupBy("network_id").applyInPandas(_balance(min_flow, directed, seed), schema)
    out = out if discarded else out.filter("sign >= 0")
    return out.unionByName(_balance_by_rounds(rows.filter(F.col("network_id").isin(large)), min_flow, directed, seed)) if large else out


def equalise(edges: DataFrame, tolerance: float = 0.05, min_flow: float = 0.95, directed: bool = True, seed: int = 1) -> DataFrame:
    """All networks balanced, and those with more positive edges than the smallest, by the tolerance, balanced again
    under its size as limit, until none has."""
    out = materialize(balance_degrees(edges, min_flow, directed, seed), "balanced")
    while True:
        sizes = {r[0]: r[1] for r in out.filter("sign = 1").groupBy("network_id").agg(F.count("*")).collect()}  # a row per network
        least = min(sizes.values(), default=0)
        over = [k for k, n in sizes.items() if n > (1 + tolerance) * least]
        if not over:
            return out
        again = balance_degrees(out.filter(F.col("network_id").isin(over)).withColumn("most", F.lit(least)), min_flow, directed, seed)
        out = materialize(out.filter(~F.col("network_id").isin(over)).unionByName(again), "balanced")


def permuted(edges: DataFrame, replicates: int, fraction: float = 0.95, min_flow: float = 0.95, directed: bool = True, seed: int = 1) -> DataFrame:
    """Replicates ``network_id`` 1, 2, ... of balanced edges, each with a share of the positive edges left, balanced again."""
    n = edges.agg(F.sum((F.col("sign") == 1).cast("long"))).first()[0] or 0
    reps = edges.withColumn("network_id", F.explode(F.sequence(F.lit(1), F.lit(replicates)).cast("array<string>")))
    return balance_degrees(reps.withColumn("most", F.lit(int(n * fraction))), min_flow, directed, seed)


def scaled_negatives(edges: DataFrame, scales: list[float] = (1.0, 1.5, 2.0)) -> DataFrame:
    """Per scale, the negatives that a flow keeps within the positives' degrees times the scale, and how well they match:
    ``scale, n_pos, n_neg, spearman, divergence_out, divergence_in, score``; the least score is best.

    A flow looks at all of a network: one task holds its edges as numbers, once for all scales (see flows)."""
    ship(edges.sparkSession)
    names, held = ["scale", "n_pos", "n_neg", "spearman", "divergence_out", "divergence_in", "score"], [float(x) for x in scales]
    kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches):
        rows = list(zip(*flows.scaled(batches, held), strict=True))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)

    schema = "scale double, n_pos long, n_neg long, spearman double, divergence_out long, divergence_in long, score double"
    return edges.select("src", "dst", "sign").repartition(1).mapInArrow(run, schema)


def worst_nodes(edges: DataFrame, share: float) -> DataFrame:
    """``node`` taken out, worst first, with its place ``at``: until the positives among the rest are at most ``share`` of
    those among the rest and among the removed together.

    The worst node has the largest sum over roles of |positive - negative| / smaller degree; one sign alone counts most.
    A network is one task, as every step depends on the one before.
    """
    ship(edges.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        around = defaultdict(list)
        deg = defaultdict(lambda: [0, 0, 0, 0])  # out and in degree, by sign
        for u, v, s in zip(pdf.src, pdf.dst, pdf.sign, strict=True):
            around[u].append((v, 0, s))
            around[v].append((u, 1, s))
            deg[u][s] += 1
            deg[v][2 + s] += 1

        def score(v) -> float:
            total = 0.0
            for x, y in (deg[v][:2], deg[v][2:]):
                if x + y:
                    total += abs(x - y) / min(x, y) if min(x, y) else 100_000
            return total

        alive, gone, inside = set(deg), {}, 0
        kept = int((pdf.sign == 1).sum())
        heap = [(-score(v), v) for v in sorted(alive)]
        heapq.heapify(heap)
        while heap and kept and kept > share * (kept + inside):
            old, v = heapq.heappop(heap)
            if v not in alive or -score(v) != old:
                continue
            alive.discard(v)
            gone[v] = len(gone)
            touched = set()
            for w, role, s in around[v]:
                if w in alive:
                    deg[w][2 * (1 - role) + s] -= 1
                    kept -= s
                    touched.add(w)
                elif w in gone and w != v:
                    inside += s
                elif w == v and role == 0:
                    kept, inside = kept - s, inside + s
            for w in sorted(touched):
                heapq.heappush(heap, (-score(w), w))
        return pd.DataFrame({"node": list(gone), "at": list(gone.values())}, columns=["node", "at"])

    return edges.select("src", "dst", "sign").groupBy().applyInPandas(run, "node long, at long")


def node_split(edges: DataFrame, a: str = "src", b: str = "dst", fraction: float = 0.1, seed: int = 1) -> DataFrame:
    """``split`` of each edge: test when both ends are held out by hash, train when none is; mixed edges go, so nothing leaks."""
    held = lambda c: hash_unit(F.col(c), F.lit(seed)) < fraction
    return edges.withColumn("split", F.when(held(a) & held(b), "test").when(~held(a) & ~held(b), "train")).filter("split is not null")


def _induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    for c in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node").alias(c)), c, "left_semi")
    return edges


def validation_split(edges: DataFrame, directed: bool = True, share: float = 0.9, iterations: int = 20, min_flow: float = 0.95, seed: int = 1) -> DataFrame:
    """``src, dst, sign, split``: a balanced validation network, and a test network of about as many positive edges on
    other nodes.

    Nodes are drawn by hash, ``share`` of them at first; from one try to the next the number follows the difference of the
    two sizes. Nodes that pruning or balancing excludes go to the test side, unless the validation network still holds
    them. The closest try is returned; the search ends early when sizes agree or stop moving.
    """
    edges = materialize(edges.select("src", "dst", "sign"), "signed")
    pruned, outside = prune(edges, directed=directed)
    outside = materialize(outside, "outside")
    nodes = materialize(_ends(pruned, "src", "dst", False).select("node").distinct(), "nodes")
    total = nodes.count()
    wanted, best, before, still = round(total * share), None, None, 0
    for at in range(iterations):
        order = running(nodes.select("node", hash_unit(F.col("node"), F.lit(seed), F.lit(at)).alias("u")), [], [F.asc("u"), F.asc("node")], {"n": ("sum", F.lit(1).cast("long"))})
        inside = materialize(order.filter(F.col("n") <= wanted).select("node"), "inside")
        tried = materialize(balance_degrees(_induced(pruned, inside).withColumn("network_id", F.lit("validation")), min_flow, directed, seed, discarded=True), "tried")
        held = tried.filter("sign >= 0").select("src", "dst", "sign")
        own = _ends(held, "src", "dst", False).select("node").distinct()
        free = nodes.join(inside, "node", "left_anti").unionByName(outside).unionByName(tried.filter("sign < 0").select(F.col("src").alias("node"))).distinct()
        rest = _induced(edges, free.join(own, "node", "left_anti"))
        split = materialize(held.withColumn("split", F.lit("validation")).unionByName(rest.select("src", "dst", "sign").withColumn("split", F.lit("test"))), "split")
        n = {r[0]: r[1] for r in split.filter("sign = 1").groupBy("split").count().collect()}
        x, y = n.get("validation", 0), n.get("test", 0)
        if x and (best is None or abs(x - y) < best[0]):
            best = (abs(x - y), split)
        still += before == x - y
        before = x - y
        if x == y or still > 5:
            break
        if x + y:
            wanted = max(0, min(total, round(wanted * (1 - (x - y) / (x + y)))))
    return best[1] if best else edges.limit(0).withColumn("split", F.lit("validation"))


def audit_split(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Nodes that are in more than one split: none, if it is sound."""
    ends = edges.select("split", F.explode(F.array(a, b)).alias("node")).distinct()
    return ends.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1").select("node")


def audit_networks(chosen: DataFrame, original: DataFrame, directed: bool = True) -> DataFrame:
    """Per network: edges that the original has not, edges of both signs, and ends of one sign alone; all 0 when sound."""
    known = original.select("src", "dst", "sign").distinct().withColumn("_known", F.lit(1))
    foreign = chosen.join(known, ["src", "dst", "sign"], "left").groupBy("network_id").agg(F.sum(F.col("_known").isNull().cast("long")).alias("foreign"))
    double = chosen.groupBy("network_id", "src", "dst").agg(F.count_distinct("sign").alias("k")).groupBy("network_id").agg(F.sum((F.col("k") > 1).cast("long")).alias("of_both_signs"))
    ends = _ends(chosen, "src", "dst", directed, "network_id", "sign").groupBy("network_id", "role", "node").agg(F.count_distinct("sign").alias("k"))
    alone = ends.groupBy("network_id").agg(F.sum((F.col("k") < 2).cast("long")).alias("one_sided"))
    return foreign.join(double, "network_id").join(alone, "network_id")


def missing_ends(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Per role: ends of positives that negatives lack, ends in both, and the positive edges that would go for it."""
    out = []
    for role, c in (("bait", "src"), ("prey", "dst")):
        there = neg.select(c).distinct().withColumn("_there", F.lit(1))
        rows = pos.groupBy(c).agg(F.count("*").alias("_n")).join(there, c, "left")
        out.append(rows.agg(F.lit(role).alias("role"), F.sum(F.col("_there").isNull().cast("long")).alias("missing"), F.count("_there").alias("shared"), F.coalesce(F.sum(F.when(F.col("_there").isNull(), F.col("_n"))), F.lit(0)).alias("edges_discarded")))
    return out[0].unionByName(out[1])


def compose(first: DataFrame, second: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """The undirected union of two edge sets, once each."""
    key = lambda d: d.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    return key(first).unionByName(key(second)).distinct()


def similarity_edges(hits: DataFrame, lengths: DataFrame, order: str = "line") -> DataFrame:
    """Hits ``qgene, sgene, bitscore`` as undirected edges: the score per residue of the shorter one, times the mean length.

    Hits of a sequence on itself or without a length go; of both directions the first by ``order`` stays. Rounding is
    half to even.
    """
    mean = lengths.agg(F.bround(F.avg("length")).alias("_mean"))
    n = lambda c, out: lengths.select(F.col("gene").alias(c), F.col("length").alias(out))
    rows = hits.filter(F.col("qgene") != F.col("sgene")).join(n("qgene", "_q"), "qgene").join(n("sgene", "_s"), "sgene").crossJoin(F.broadcast(mean))  # one row
    score = F.bround(F.col("bitscore") / F.least("_q", "_s") * F.col("_mean"))
    best = rows.groupBy(F.least("qgene", "sgene").alias("a"), F.greatest("qgene", "sgene").alias("b")).agg(F.min_by(score, order).alias("weight"))
    return best


def similar_sequences(seqs: DataFrame, identity: float = 0.4, k: int = 3, tables: int = 32, seed: int = 1) -> DataFrame:
    """``a, b, jaccard`` of sequences ``id, seq`` whose sets of k-letter words are alike: candidates by MinHash tables.

    It measures word overlap and not aligned identity, and may miss a pair with the chance (1 - identity) ** tables.
    """
    from pyspark.ml.feature import CountVectorizer, MinHashLSH

    words = seqs.filter(F.length("seq") >= k).withColumn("words", F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substr("seq", i, F.lit(k)))))
    words = materialize(words.select("id", "words"), "words")
    vectors = CountVectorizer(inputCol="words", outputCol="v", binary=True, vocabSize=1 << 22).fit(words).transform(words)
    lsh = MinHashLSH(inputCol="v", outputCol="h", numHashTables=tables, seed=seed).fit(vectors)
    near = lsh.approxSimilarityJoin(vectors, vectors, 1 - identity + 1e-9, "far").filter("datasetA.id < datasetB.id")
    return near.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), (1 - F.col("far")).alias("jaccard")).distinct()


def redundant(links: DataFrame, lengths: DataFrame) -> DataFrame:
    """``id`` that a longer representative (of equal ones the smaller id) is linked with, chosen longest first.

    Rounds: what has no undecided longer neighbour is a representative, and its neighbours go.
    """
    rank = lambda c, out: lengths.select(F.col("id").alias(c), F.struct((-F.col("length")).alias("l"), F.col("id").alias("i")).alias(out))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    down = materialize(both.join(rank("a", "_a"), "a").join(rank("b", "_b"), "b").filter(F.col("_b") < F.col("_a")).select("a", "b"), "down")  # b goes before a
    open_, gone = materialize(down.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "open"), down.select(F.col("a").alias("id")).limit(0)
    while open_.head(1):
        waits = down.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        kept = materialize(open_.join(waits, "id", "left_anti"), "kept")
        lost = materialize(down.join(kept.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct().join(open_, "id", "left_semi"), "lost")
        gone = materialize(gone.unionByName(lost), "gone")
        open_ = materialize(open_.join(kept, "id", "left_anti").join(lost, "id", "left_anti"), "open")
    return gone.distinct()
