"""Document fingerprints by threshold-scaled sketches.

A fingerprint holds every five-word shingle hash below a fixed fraction of the hash range, so the sketches of two
texts of very unequal length sample the same shingles, and merge by union. Likeness is the Jaccard ratio of two
sketches, containment the share of one found in the other. A text that has shingles but none below the threshold has an
empty sketch; its fingerprint is its smallest hash behind a mark, which only tells equal texts from others: likeness of
two empty sketches is 1 for equal marks and else 0, merging and containment leave it out.

Each document is compared with the one that follows by id, then by a hash of the text. Rows are cut into ranges at
sampled keys, every range also gets the first document of the next one, and each is read in order as a stream; no task
holds a range.

Defined cases: null and empty texts have the empty fingerprint, which is like only the empty one; null ids come
first; equal ids are ordered by a hash of the text and may be dealt to several ranges, and all rows are reported; rows
equal in id and text share a range; a single document follows itself; other columns are ignored; texts of any length are
taken whole; empty tables give no rows. The containment of an empty sketch in another is unknown (null) if the text has
shingles, else 1.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import wordhash
from evidentia.llm.common import ship

#: One shingle in so many is kept, a power of two.
SCALE = 4
#: Bytes of a kept hash in a fingerprint.
WIDTH = 5
_FIRST = -(1 << 63)
#: Rows of a range on average, keys sampled to cut them, and ranges at most: 16 samples a range.
PER_RANGE, SAMPLED, MOST_RANGES = 5_000, 1 << 20, 1 << 16


@dataclass
class Sketch:
    """Sorted kept hashes, and the mark of a text whose shingles all lie above the threshold."""

    kept: np.ndarray
    mark: int | None = None

    def text(self) -> str:
        if self.mark is not None:
            return f"-{self.mark:0{2 * WIDTH}x}"
        return self.kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes().hex()


def parse(fingerprint: str) -> Sketch:
    if fingerprint.startswith("-"):
        return Sketch(np.zeros(0, wordhash.U), int(fingerprint[1:], 16))
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, WIDTH)
    return Sketch(np.pad(raw, ((0, 0), (8 - WIDTH, 0))).reshape(-1).view(">u8").astype(wordhash.U))


def sketches(texts: list[bytes], scale: int = SCALE) -> list[Sketch]:
    top = 64 - (scale.bit_length() - 1)
    out: list[Sketch] = []
    for _, held in wordhash.batches(texts):
        doc, h = wordhash.strong(held)
        at, sh = wordhash.shingles(doc, h, len(held))
        sh = sh >> wordhash.U(top - 8 * WIDTH)  # the kept ones now have WIDTH bytes
        low = sh < wordhash.U(1 << (8 * WIDTH))
        kept, of = sh[low], at[low]
        ends = np.searchsorted(of, np.arange(len(held) + 1))
        alls = np.searchsorted(at, np.arange(len(held) + 1))
        for i in range(len(held)):
            own = np.unique(kept[ends[i] : ends[i + 1]])
            mark = int(sh[alls[i] : alls[i + 1]].min()) & ((1 << (8 * WIDTH)) - 1) if not len(own) and alls[i] < alls[i + 1] else None
            out.append(Sketch(own, mark))
    return out


def likeness(a: Sketch, b: Sketch) -> float:
    if not len(a.kept) and not len(b.kept):
        return float(a.mark == b.mark)
    both = len(np.intersect1d(a.kept, b.kept, assume_unique=True))
    return both / (len(a.kept) + len(b.kept) - both)


def containment(a: Sketch, b: Sketch) -> float | None:
    """The share of a's shingles that b has, by those kept; None where none is."""
    if not len(a.kept):
        return 1.0 if a.mark is None else None
    return len(np.intersect1d(a.kept, b.kept, assume_unique=True)) / len(a.kept)


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of all shingles of both texts."""
    kept = np.union1d(a.kept, b.kept)
    marks = [m for m in (a.mark, b.mark) if m is not None]
    return Sketch(kept, min(marks) if marks and not len(kept) else None)


def edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _places(cut_ids: np.ndarray, cut_hashes: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The last cut (id, hash) at or below each key."""
    lo, hi = np.searchsorted(cut_ids, ids, "left"), np.searchsorted(cut_ids, ids, "right")
    out = hi - 1
    for k in np.unique(ids[lo < hi]):
        rows = np.flatnonzero(ids == k)
        a, b = lo[rows[0]], hi[rows[0]]
        out[rows] = a + np.searchsorted(cut_hashes[a:b], hashes[rows], "right") - 1
    return out


def _dealt(cut_ids: np.ndarray, cut_hashes: np.ndarray):
    """Rows with the range of their key; the first document of each range also goes, as its tail, to the range before."""

    def run(batches):
        for batch in batches:
            k = np.array([_FIRST if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            h = batch.column(2).to_numpy()
            part = _places(cut_ids, cut_hashes, k, h)
            first = np.flatnonzero((cut_ids[part] == k) & (cut_hashes[part] == h))
            rows = np.concatenate((np.arange(len(k)), first))
            where = np.concatenate((part, (part[first] - 1) % len(cut_ids)))
            tail = np.repeat([False, True], [len(k), len(first)])
            took = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(tail), pa.array(k[rows]), pa.array(h[rows]), *took], ["part", "tail", "k", "th", "doc_id", "text"])

    return run


def _compared(batches):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
    held: list[tuple] = []  # at most one row waits for the next
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            some = batch.slice(lo, 500)
            rows = held + list(zip(*(some.column(some.schema.names.index(c)).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True))
            held = rows[-1:]
            texts = [r[3] or "" for r in rows]
            use = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            if not use:
                continue
            new = [edited(texts[i], texts[i + 1]).encode() for i in use]
            marks = sketches([t.encode() for t in texts])
            others = sketches(new)
            out = [
                [rows[i][2] for i in use],
                [len(texts[i]) for i in use],
                [hashlib.sha256(t).hexdigest() for t in new],
                [marks[i].text() for i in use],
                [x.text() for x in others],
                [likeness(marks[i], x) for i, x in zip(use, others, strict=True)],
                [likeness(marks[i], marks[i + 1]) for i in use],
                [containment(marks[i], x) for i, x in zip(use, others, strict=True)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, its likeness to the edited and to the next text, and
    ``in_edited``, its containment in the edited text."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    key = F.struct(F.coalesce("doc_id", F.lit(_FIRST)).alias("k"), "th")
    n, least = docs.agg(F.count("*"), F.min(key)).first()
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    ranges = min(MOST_RANGES, max(1, n // PER_RANGE))
    cuts = {(least["k"], least["th"])}
    if ranges > 1:  # keys that occur, so that the first row of a range is known by its key
        some = docs.select("doc_id", "th").sample(min(1.0, SAMPLED / n), seed=7).select(key.alias("x")).select("x.*").toArrow()
        some = np.array(sorted(zip(some.column("k").to_pylist(), some.column("th").to_pylist(), strict=True))[:: max(1, some.num_rows // ranges)], np.int64).reshape(-1, 2)
        cuts |= {(int(a), int(b)) for a, b in some}
    ids, hashes = np.array(sorted(cuts), np.int64).T
    dealt = docs.mapInArrow(_dealt(ids, hashes), "part int, tail boolean, k long, th long, doc_id long, text string")
    order = dealt.repartition("part").sortWithinPartitions("part", "tail", "k", "th")
    return order.mapInArrow(_compared, schema)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
