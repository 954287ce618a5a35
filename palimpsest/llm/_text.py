"""Vectorised text kernels shared by the corpus operators.

Everything here works on a block of documents laid out as one ``uint8`` buffer
plus ``int64`` offsets (the layout Arrow strings already have), so no Python
object is made per word or per byte.

Words and runs of words are hashed by sums of key * value mod 2**64 with an own
random key for each place.  The keys come from a secret that each driver draws
anew (``session.hash_seed``), so no text can be written to collide: two
different words meet with probability 2**-55 at most, whatever they are.  The
older polynomial sums (``prefix``, ``spans_hash``, ``rolling_hash``), whose windows cost two
lookups, serve pieces of at most 80 bytes only; on longer patterned strings
they can collide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from palimpsest.session import hash_seed

U64 = np.uint64
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)
_tables: dict[str | int, np.ndarray] = {}

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
#: For runs of letters: everything below 0x80 but A-Z and a-z separates.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[128:] = NOT_LETTER[65:91] = NOT_LETTER[97:123] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("pw")
    if have is None or len(have) < n:
        size = max(1 << 18, 1 << int(n - 1).bit_length()) if n else 1 << 18
        for name, base in (("pw", _BASE), ("inv", _INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[name] = np.cumprod(table, dtype=np.uint64)
    return _tables["pw"], _tables["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base**position; one longer than the input."""
    pw, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * pw[: len(values)], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for arrays of starts and ends."""
    _, inv = _powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64))


def rolling_hash(pre: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n values (empty if there are fewer)."""
    m = len(pre) - n
    if m <= 0:
        return np.zeros(0, np.uint64)
    _, inv = _powers(len(pre))
    return mix((pre[n:] - pre[:m]) * inv[:m] + U64(n))


def keys(n: int) -> np.ndarray:
    """The first n secret keys, 64 bits each."""
    seed = hash_seed()
    have = _tables.get(seed)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << int(n).bit_length())
        have = _tables[seed] = mix(mix(np.arange(1, size + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed)) ^ U64(seed))
    return have


def byte_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of buf[start:end] of ascending spans that don't overlap, none of them empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(first[-1] + size[-1])) - np.repeat(first, size)
    value = buf[at + np.repeat(start, size)]
    if lower:
        value = LOWER[value]
    product = keys(int(size.max()) + 1)[1:][at]
    product *= value + U64(1)
    return mix(np.add.reduceat(product, first) + keys(1)[0] * size.astype(np.uint64))


def run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n values (none if there are fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    k = keys(n + 1)
    out = np.full(m, int(k[n]) * n & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(n):
        out += h[i : i + m] * k[i]
    return mix(out)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block of documents.

    start, end: byte ranges; offs: word offsets per document; hash: 64 bits per word.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False, hashes: bool = True, separator: np.ndarray = SEPARATOR, word: np.ndarray | None = None, cut: np.ndarray | None = None):
        # word: bytes inside words, if their value alone doesn't tell; cut: bytes that begin a word of their own
        if word is None:
            word = ~separator[buf]
        first = word.copy()
        first[1:] &= ~word[:-1]
        if cut is not None:
            first |= word & cut
        inner = offs[1:-1]
        inner = inner[inner < len(buf)]
        first[inner] = word[inner]
        last = word.copy()
        last[:-1] &= ~word[1:]
        if cut is not None:
            last[:-1] |= word[:-1] & cut[1:]
        if len(inner):
            inner = inner[inner > 0]
            last[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.offs = np.searchsorted(self.start, offs)
        self.offs[-1] = len(self.start)
        if hashes:
            self.hash = byte_spans(buf, self.start, self.end, lower)

    def room(self) -> np.ndarray:
        """For each word, the number of words from it to its document's end."""
        ends = np.repeat(self.offs[1:], np.diff(self.offs))
        return ends - np.arange(len(self.start))


def blocks(ids, texts: pa.Array, target: int = 1 << 20):
    """Cut an Arrow string array into (lo, hi, buf, offs) of about target bytes.

    A longer document makes a block of its own; texts are never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, ob, db = texts.buffers()
    offs = np.frombuffer(ob, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(db, np.uint8) if db is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + target, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo] : offs[hi]], (offs[lo : hi + 1] - offs[lo]).astype(np.int64)
        lo = hi


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership of values in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = len(table) - 1
    return table[at] == values


def covered(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Boolean mask of length n: True where some [start, start+length) covers."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + lengths, n), -1)
    return np.cumsum(delta[:-1]) > 0
