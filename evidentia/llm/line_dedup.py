"""Line dedup by content-defined line chunks.

Lines are the text's own; one of more than LONG words is wrapped into pieces of LONG words at most, at places that the
hashes of the words around choose. Every line is hashed, white space inside it included, and rolling hashes run over
each LINES neighbouring line hashes. The smallest of SPAN neighbouring rolling hashes is a boundary, where a chunk of
lines begins. The choice depends on the lines around alone, so a passage that stands in two texts has boundaries in
common, wherever it stands: every passage of more than 50 words has, unless its lines are unusually cut.

Where the lines at a boundary occurred before anywhere (smallest doc_id, then place), the bytes there are compared with
those of the first occurrence, and the match reaches to the left and to the right as far as whole words are equal: from
boundary to boundary inside a repeated passage, and up to REACH words beyond its outermost ones. What is equal, two whole
lines at least, goes, where ``min_words`` or more neighbouring words go together; a match never overlaps its origin.

Only the first occurrence is compared, and repeats without a boundary of their own in common stay: short ones.

Defined cases: null texts stay null; empty texts stay empty; rows of an equal id count as one document, so repeated
rows all keep what the first occurrence keeps; null ids come last and count as one document; other columns, whatever
their names, pass unchanged; texts of any length are taken whole; empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import wordhash
from evidentia.llm.common import key_filter, materialize, passes, ship, sliced

#: Words of a line at most, lines of a rolling hash, neighbouring rolling hashes of which one is a boundary, and words
#: around a boundary that are compared.
LONG, LINES, SPAN, REACH = 6, 2, 6, 48
#: Fewer repeated words in a row stay: headings and short sign-offs repeat by chance.
MIN_WORDS = 8
#: Occurrences of one hash that are compared in one cell, on average.
PER_CELL = 2_000
_NO_ID = (1 << 63) - 1
_GAP, _TORN = re.compile(rb"[ \t-\r]*"), re.compile(rb"[^ \t-\r]*\Z")


def _slide(pick, v: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        v = pick(v[:-have], v[have:])
        have *= 2
    return pick(v[: len(v) - (width - have)], v[width - have :]) if width > have else v


def _smallest(v: np.ndarray, span: int) -> np.ndarray:
    """Which values are the smallest of some ``span`` neighbours."""
    if len(v) < span:
        return np.zeros(len(v), bool)
    rim = np.zeros(span - 1, v.dtype)
    return _slide(np.maximum, np.concatenate((rim, _slide(np.minimum, v, span), rim)), span) == v


def line_starts(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The first word of every line: ``begins`` marks those of own lines, longer ones are wrapped."""
    v = wordhash.mix(h * wordhash._STEPS[1] + np.concatenate(([wordhash.U(0)], h[:-1])) * wordhash._STEPS[2]) | wordhash.U(1)
    v[begins] = 0  # a span that reaches over the beginning of a line chooses nothing else
    return np.flatnonzero(begins | _smallest(v, LONG))


def boundaries(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all texts, in order: the text's index, hash, first and last byte of the lines at each boundary; first and last byte
    of what may match around them."""
    doc, h, s, e, data = wordhash.words(texts, lower=False)
    n = len(h)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if not n:
        return none
    breaks = np.cumsum(data == 10)
    begins = np.concatenate(([True], (breaks[s[1:]] != breaks[e[:-1] - 1]) | (doc[1:] != doc[:-1])))
    first = line_starts(h, begins)
    last = np.append(first[1:], n) - 1
    of = doc[first]
    # a word with the white space before it, but for the first of a line
    sums = np.concatenate(([0], np.cumsum(data, dtype=wordhash.U)))
    gap = np.zeros(n, wordhash.U)
    lo, hi = e[:-1], s[1:]
    gap[1:] = sums[hi] - sums[lo] + (data[lo].astype(wordhash.U) << wordhash.U(24)) + ((hi - lo).astype(wordhash.U) << wordhash.U(32))
    steps = wordhash.powers(wordhash._R, n)
    total = np.zeros(n + 1, wordhash.U)
    np.cumsum((h + gap * wordhash._STEPS[0]) * steps, out=total[1:])
    line = wordhash.mix((total[last + 1] - total[first]) * wordhash.powers(wordhash._RI, n)[first] - gap[first] * wordhash._STEPS[0])
    m = len(first) - LINES + 1
    if m <= 0:
        return none
    v = line[:m].copy()
    for k in range(1, LINES):
        v += line[k : k + m] * wordhash._STEPS[k] + gap[first[k : k + m]] * wordhash._STEPS[k + 1]
    v = wordhash.mix(v)
    top = wordhash.U((1 << 64) - 1)
    whole = of[:m] == of[LINES - 1 :]
    v[~whole] = top
    head = np.searchsorted(of, np.arange(len(texts)))
    runs = np.searchsorted(of, np.arange(len(texts)), "right") - head - LINES + 1
    best = np.zeros(m, wordhash.U)
    if m >= SPAN:  # of each rolling hash, the largest of the minima of the spans that hold it and lie inside a text
        least = _slide(np.minimum, v, SPAN)
        least[of[: len(least)] != of[SPAN + LINES - 2 :]] = 0
        rim = np.zeros(SPAN - 1, wordhash.U)
        best = _slide(np.maximum, np.concatenate((rim, least, rim)), SPAN)
    # a text shorter than a span is one
    few = np.flatnonzero((runs > 0) & (runs < SPAN))
    if len(few):
        own = np.minimum.reduceat(np.append(v, top), np.stack((head[few], head[few] + runs[few]), 1).ravel())[::2]
        smallest = np.zeros(len(texts), wordhash.U)
        smallest[few] = own
        best = np.maximum(best, smallest[of[:m]])
    at = np.flatnonzero((best == v) & whole)
    # of equal hashes that follow each other closely, as in periods, one in half a span stays
    new = np.concatenate(([True], (v[at][1:] != v[at][:-1]) | (of[at][1:] != of[at][:-1])))
    step = (at - at[np.flatnonzero(new)][np.cumsum(new) - 1]) // (SPAN // 2) if len(at) else at
    at = at[new | np.concatenate(([True], step[1:] != step[:-1]))[: len(at)]]
    where = of[at]
    zero = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1][where]
    w, z = first[at], last[at + LINES - 1]
    a = np.maximum(w - REACH, np.searchsorted(doc, where))
    b = np.minimum(z + REACH, np.searchsorted(doc, where, "right") - 1)
    return where, v[at].astype(np.int64), s[w] - zero, e[z] - zero, s[a] - zero, e[b] - zero


@sliced
def _keys(batches):
    for batch in batches:
        ids = np.array([_NO_ID if x is None else x for x in batch.column(0).to_pylist()], np.int64)
        for at, held in wordhash.batches(wordhash.encoded(batch.column(1))):
            where, key, *_ = boundaries(held)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at:][where] if len(where) else np.zeros(0, np.int64))], ["h", "keep"])


def _occurrences(marks, bits: int, common):
    """Occurrences of hashes that may be repeated. Those of the ``common`` hashes (h, keep, cells) are dealt over cells, and
    each cell gets a copy of the origin."""

    def run(batches):
        seen, (hot, keep, cells) = marks.value, common.value
        names, origins = ["h", "cell", "id", "th", "place", "size", "before", "bytes", "first"], {}
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
        for batch in batches:
            ids = [_NO_ID if x is None else x for x in batch.column(0).to_pylist()]
            th, texts = batch.column(1).to_pylist(), wordhash.encoded(batch.column(2))
            for at, held in wordhash.batches(texts):
                where, key, mid, end, a, b = boundaries(held)
                out: list[list] = [[] for _ in names]
                met: set = set()
                hit = np.flatnonzero(passes(seen, bits, key))
                where, key, mid, end, a, b = (x[hit] for x in (where, key, mid, end, a, b))
                # beyond the next boundary that may be repeated, that one's own match goes on
                near = where[1:] == where[:-1]
                a[1:] = np.where(near, np.maximum(a[1:], mid[:-1]), a[1:])
                b[:-1] = np.where(near, np.minimum(b[:-1], end[1:]), b[:-1])
                spot = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
                spot = np.where(hot[spot] == key, spot, -1) if len(hot) else np.full(len(key), -1)
                for w, k, p, q, x, y, c in zip(*(v.tolist() for v in (where, key, mid, end, a, b, spot)), strict=True):
                    first, doc, text = (w, k) not in met, ids[at + w], th[at + w]
                    met.add((w, k))
                    row = (k, 0 if c < 0 else (doc ^ text ^ (p * 0x9E3779B1)) % int(cells[c]), doc, text, p, q - p, held[w][x:p], held[w][p:y], first)
                    if c >= 0 and first and doc == keep[c]:
                        if c not in origins or (p, text) < origins[c][4:2:-1]:
                            origins[c] = row
                        continue
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield made(out)
        for c, row in origins.items():
            for i in range(0, int(cells[c]), 1_000):
                yield made(list(zip(*((row[0], j, *row[2:]) for j in range(i, min(i + 1_000, int(cells[c])))), strict=True)))

    return sliced(run)


def reach(a: bytes, b: bytes, most: int | None = None) -> int:
    """Bytes of the longest common beginning of whole words, ``most`` at most."""
    n = min(len(a), len(b)) if most is None else min(len(a), len(b), most)
    x, y = a[:n], b[:n]
    if x != y:
        n -= ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        x = x[:n]
    if not all(len(t) == n or t[n] in b" \t\n\v\f\r" for t in (a, b)):
        x = x[: _TORN.search(x).start()]
    return len(x.rstrip(b" \t\n\v\f\r"))


@sliced
def _matches(batches):
    """Begin and end, in bytes of the text, of what is equal around a boundary and its first occurrence, which leads the rows of
    its hash and cell."""
    group = origin = None
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for h, cell, doc, th, place, size, before, here, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (h, cell) != group:
                group, origin = (h, cell), (doc, th, place, before, here)
                continue
            doc0, th0, place0, before0, here0 = origin
            if first and doc == doc0:
                continue  # a row of the same id keeps what the first one keeps
            most = place - place0 if (doc, th) == (doc0, th0) else None
            right = reach(here, here0, most)
            if right < size:
                continue  # other lines of the same hash, or lines that overlap their origin
            left = reach(before[::-1], before0[::-1], None if most is None else most - right)
            for column, x in zip(out, (doc, th, place - left, place + right), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "th", "a", "b"])


def _without(min_words: int):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts, gone = batch.column(names.index("_text")), batch.column(names.index("_gone")).to_pylist()
            raw, new, lost = wordhash.encoded(texts), [], []
            for i, text in enumerate(raw):
                words = 0
                if gone[i]:
                    spans: list[list[int]] = []  # begin of the first word, begin of the next word that stays
                    for a, b in sorted((g["a"], g["b"]) for g in gone[i]):
                        b = _GAP.match(text, b).end()
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                    kept, at = [], 0
                    for a, b in spans:
                        if (size := len(text[a:b].split())) >= min_words:
                            words += size
                            kept.append(text[at:a])
                            at = b
                    if words:
                        text = b"".join([*kept, text[at:]])
                        text = text if text.strip() else b""
                new.append(text.decode() if texts[i].is_valid else None)
                lost.append(words)
            yield pa.RecordBatch.from_arrays([batch.column(names.index("_row")), pa.array(new, pa.string()), pa.array(lost, pa.int64())], ["_row", "_text", "_lost"])

    return sliced(run)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``id, th, a, b``: bytes from a to b of the text that stand somewhere earlier too."""
    pairs = docs.select("doc_id", "text").mapInArrow(_keys, "h long, keep long")
    again = pairs.groupBy("h").agg(F.count("*").alias("n"), F.min("keep").alias("keep")).filter("n > 1")
    again = materialize(again.select("h", "keep", F.ceil(F.col("n") / PER_CELL).alias("cells")), "repeated")
    marks, bits = key_filter(again.select("h"), again.count())
    # one in PER_CELL occurrences at most; their occurrences are split, and meet copies of their origin
    common = [c.to_numpy() for c in again.filter("cells > 1").select("h", "keep", "cells").orderBy("h").toArrow().combine_chunks().columns]
    common = docs.sparkSession.sparkContext.broadcast(common)
    schema = "h long, cell int, id long, th long, place int, size int, before binary, bytes binary, first boolean"
    found = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_occurrences(marks, bits, common), schema)
    # the smallest id, and its first place, leads; so occurrences are dealt and sorted once, and written nowhere else
    found = found.repartition("h", "cell").sortWithinPartitions("h", "cell", "id", F.desc("first"), "place", "th")
    return found.mapInArrow(_matches, "id long, th long, a int, b int")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from ``text``, and ``removed_words``."""
    ship(docs.sparkSession)
    gone = repeated_passages(docs.select("doc_id", "text")).groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("_gone"))
    other = F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")
    rows = docs.select(other, F.col("text").alias("_text"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), F.xxhash64("text").alias("_th"))
    rows = rows.join(gone, (F.col("_id") == F.col("id")) & (F.col("_th") == F.col("th")), "left").select("_row", "_text", "_gone")
    kind = docs.select(other).schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(_without(min_words), f"_row {kind}, _text string, _lost long")
    named = [F.col("_text").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.select(*named, F.col("_lost").alias("removed_words"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "removed_words")
