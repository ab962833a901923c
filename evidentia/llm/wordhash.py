"""Words and word shingles of many texts at once, as NumPy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time; a longer word is a block of its own.
BLOCK = 1 << 16
_R, _RI = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK) + 1, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= BLOCK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the output."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def batches(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of neighbouring texts of about ``most`` bytes, each with the index of its first."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        if held and n + len(t) > most:
            yield first, held
            first, held, n = i, [], 0
        held.append(t)
        n += len(t)
    if held:
        yield first, held


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of all texts: index of its text, hash, start and end in the joined bytes; and those bytes."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    if lower:
        data = LOWER[data]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    edge = np.diff(np.concatenate(([1], SPACES[data].view(np.int8), [1])))
    s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc = np.searchsorted(begins, s, "right") - 1
    h, i = np.empty(len(s), U), 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK, "right")))
        lo, hi = int(s[i]), int(e[j - 1])
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum((data[lo:hi].astype(U) + U(1)) * powers(_R, hi - lo), out=sums[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        h[i:j] = mix((sums[b] - sums[a]) * powers(_RI, hi - lo)[a] + (b - a).astype(U))
        i = j
    return doc, h, s, e, data


#: Words whose hash a worker remembers.
REMEMBERED = 1 << 16
_LOWER_BYTES = LOWER.tobytes()


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


_known = _Known()


def strong(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Per word of all texts: index of its text and 64 bits of its BLAKE2b hash. No words can be made to collide cheaply."""
    each = [(t.translate(_LOWER_BYTES) if lower else t).split() for t in texts]
    counts = [len(x) for x in each]
    h = np.fromiter(map(_known.__getitem__, chain.from_iterable(each)), U, sum(counts))
    return np.repeat(np.arange(len(texts)), counts), h


_STEPS = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(doc: np.ndarray, h: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Per shingle, text by text: index of its text and hash. Fewer words than ``width`` make one shingle; none make none."""
    counts = np.bincount(doc, minlength=n_docs)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, U)
    m = len(h) - width + 1
    if m > 0:
        acc = np.zeros(m, U)
        for k in range(width):
            acc += h[k : k + m] * _STEPS[k]
        full = doc[:m] == doc[width - 1 :]
        out, at = mix(acc[full]), doc[:m][full]
    else:
        out, at = np.zeros(0, U), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        first = np.searchsorted(doc, few)
        short = []
        for i, c in zip(first, counts[few], strict=True):
            acc = U(c)
            with np.errstate(over="ignore"):
                for k in range(c):
                    acc = acc + h[i + k] * _STEPS[k]
            short.append(acc)
        out, at = np.concatenate([out, mix(np.array(short, U))]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return at, out


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [t if t is not None else b"" for t in column.cast(pa.large_binary()).to_pylist()]
