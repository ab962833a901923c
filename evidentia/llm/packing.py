"""Best-fit packing of tokenised documents, certified by lower bounds.

Each document is cut into pieces that fit a sequence (only documents that are too long; the first piece takes
the remainder). Pieces of the full length are sequences already. The others are dealt over partitions of bounded
size and packed there by best-fit decreasing; dual-feasible functions of the partition's lengths certify how many
sequences it needs at least. Partitions with a gap, or all while the whole corpus has one, take their unfilled
sequences apart, exchange the pieces and pack again, over fewer and fewer partitions, while sequences are saved.

Defined cases: null and empty texts are one piece with the end token alone; null, repeated and equal ids are packed
row by row; texts of any length are encoded whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import discard, materialize, ship, sliced

#: Pieces that one partition packs, on average.
PER_PARTITION = 20_000
_encoders: dict[str, object] = {}


def encoder(path: str):
    """text -> token ids (NumPy, unsigned 32-bit) by a public vocabulary file, a .json of tokenizers or a .tiktoken.

    Both kinds read special tokens in a text as such. The two files of one vocabulary give equal ids.
    """
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
            _encoders[path] = lambda text: enc.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            _encoders[path] = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    return _encoders[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def _packed_ids(piece: np.ndarray) -> bytes:
    """Two bytes an id, or four where some id needs them."""
    return piece.astype("<u2" if not len(piece) or piece.max() < 1 << 16 else "<u4").tobytes()


@sliced
def _unpacked_ids(batches):
    for batch in batches:
        names = batch.schema.names
        raw, sizes = batch.column(names.index("ids")).to_pylist(), batch.column(names.index("length")).to_numpy()
        ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype(np.int32) for x, n in zip(raw, sizes, strict=True)]
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        columns = [batch.column(i) for i, c in enumerate(names) if c != "ids"]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*(c for c in names if c != "ids"), "ids"])


def _tokenize(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches):
        encode, salt = encoder(path), 0
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    piece, salt = ids[start : start + n], salt + 1
                    for column, x in zip(out, (doc, k, start, n, zlib.crc32(piece.tobytes()), salt, _packed_ids(piece) if with_ids else None), strict=True):
                        column.append(x)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids"]
            n = 7 if with_ids else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], kinds[:n], strict=True)], names[:n])

    return sliced(run)


def tokenize(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, with_ids: bool = True, text: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids_crc32, salt`` and, if asked for, ``ids`` as bytes."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt long" + ", ids binary" * with_ids
    return docs.select("doc_id", text).mapInArrow(_tokenize(path, capacity, end, with_ids), schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The most bins that a dual-feasible function proves necessary; ``counts[x]`` pieces have length x.

    Three families are tried: rounding small pieces to nothing and their complements to a whole bin, rounding
    down to multiples of 1/k, and the first after the second.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 101):
        scaled = x * (k + 1)
        whole = scaled % capacity == 0
        f = np.where(whole, x * k, (scaled // capacity) * capacity)  # in units of 1 / k
        best = max(best, -(-int((counts * f).sum()) // (capacity * k)))
    many, mass = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * x)
    for a in range(1, capacity // 2 + 1):
        large = int(many[capacity - a + 1])
        middle = int(mass[capacity - a] - mass[a - 1])
        best = max(best, -(-(large * capacity + middle) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. Open bins are kept by free space, as bits of one number."""
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            if not free[room - size]:
                mask |= 1 << (room - size)
            free[room - size].append(b)
    return bins, offsets, used


def _pack(capacity: int):
    def run(key, table):
        lengths = table.column("length").to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, lengths, minlength=used)
        names = ["bin", "offset", "fill", "bins", "bound"]
        made = [bins, offsets, fill[bins].astype(np.int64), np.full(len(bins), used), np.full(len(bins), bound)]
        for name, values in zip(names, made, strict=True):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return run


def pack(pieces: DataFrame, capacity: int = 1024, rounds: int | None = None) -> DataFrame:
    """Adds ``sequence_id, offset`` and the certificate ``partition_bins, partition_bound`` to pieces with ``length, salt``.

    Rounds of exchange go on until the number of sequences is certified or a round saves none, or for ``rounds``.
    """
    spread = F.xxhash64(*pieces.columns)
    pieces = pieces.withColumn("_h", spread)
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    one = F.lit(1).cast("long")
    full = full.select(*pieces.columns, "sequence_id", F.lit(0).cast("long").alias("offset"), one.alias("partition_bins"), one.alias("partition_bound"))
    pool, done = pieces.filter(F.col("length") < capacity), [full]
    n, before = pool.count(), None
    lengths = {r[0]: r[1] for r in pool.groupBy("length").count().collect()}  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, c in lengths.items():
        counts[length] = c
    bound, settled = lower_bound(counts, capacity), 0
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", part long, bin long, offset long, fill long, bins long, bound long"
    turn = -1
    while rounds is None or turn + 1 < rounds:
        turn += 1
        parts = max(1, -(-n // PER_PARTITION))
        dealt = pool.select(*pieces.columns).withColumn("part", F.pmod(F.xxhash64("_h", F.lit(turn)), F.lit(parts)))
        tried = materialize(dealt.groupBy("part").applyInArrow(_pack(capacity), schema), "packed")
        used = tried.filter("offset = 0").count()
        tried = tried.withColumn("sequence_id", (F.lit(turn).cast("long") * (1 << 48)) + F.col("part") * (1 << 24) + F.col("bin"))
        if before is not None and used >= before[1]:
            break
        if before is not None:
            done.append(before[2])
            settled += before[3]
        # sequences to take apart: unfilled ones where a gap is, or anywhere while the whole has a gap
        gap = F.col("bins") > F.col("bound") if tried.filter("bins > bound").head(1) else F.lit(True)
        open_ = (F.col("fill") < capacity) & gap
        loose, kept = tried.filter(open_), tried.filter(~open_)
        n_loose, n_kept = (tried.filter(c & (F.col("offset") == 0)).count() for c in (open_, ~open_))
        before = (loose, n_loose, kept, n_kept)
        n = loose.count()
        if settled + used <= bound or not n or parts == 1:
            break
        pool = loose
    done += [before[0], before[2]]
    columns = [*[F.col(c) for c in pieces.columns if c not in ("_h", "salt")], "sequence_id", "offset"]
    out = [d.select(*columns, *(("partition_bins", "partition_bound") if "partition_bins" in d.columns else (F.col("bins").alias("partition_bins"), F.col("bound").alias("partition_bound")))) for d in done]
    packed = out[0]
    for d in out[1:]:
        packed = packed.unionByName(d)
    return packed


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, end: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces of the documents with their places in sequences; ``ids`` are the tokens themselves.

    Pieces are packed by their lengths alone; tokens join their places at the end, by a number of the piece.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = materialize(tokenize(docs, path, capacity, end, with_ids).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    packed = pack(pieces.drop("ids"), capacity)
    if not with_ids:
        return packed.drop("pid")
    # the tokens come last, so no step before moves them
    both = packed.join(pieces.select("pid", "ids").hint("merge"), "pid").drop("pid")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields if f.name != "ids")
    return both.mapInArrow(_unpacked_ids, f"{schema}, ids array<int>")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "partition_bins", "partition_bound")
