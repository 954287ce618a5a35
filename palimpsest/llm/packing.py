"""Hierarchical multi-length packing of tokenised documents.

A document is routed by its length to the smallest of several context tiers
that holds it; what exceeds the longest tier is cut off as full sequences of
that tier first.  Tiers are packed from long to short, first fit by decreasing
length; gaps of long windows are filled with whole documents of shorter tiers,
then with one cut piece, so each window is full.  What is left at the end of a
chunk is cut by powers of two, so nothing needs padding.  Sequences are dealt to
step groups of nearly equal token counts, longest first.

The unit of packing is a chunk of about 4 MB of text (see ``_chunks``): memory
does not grow with the corpus, and at most ``log2(max_len)`` short sequences end
a chunk.  Tokenising costs most, so each distinct pre-token is encoded once per
worker, as far as a cache of bounded size holds it.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm import _chunks as C
from palimpsest.llm import _text as T

TIERS = (256, 512, 1024, 2048, 4096)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
CACHE_WORDS = 400_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_PUNCT[39] = False  # an apostrophe may begin a contraction, which is one pre-token
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Token ids of documents, equal to those of tokenizers with add_special_tokens=False.

    Pre-tokens never span white space, and a run of letters and a run of ASCII
    punctuation never share one, so texts are cut there and each distinct cut is
    encoded once.  Texts with the marker of a special token are encoded whole.
    """

    _held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.special = sorted(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.begin = self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode_one(self, raw: bytes) -> list[int]:
        word = raw.decode("utf-8", "replace").lower()
        if _PLAIN.fullmatch(word):
            return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.table))]
        return self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids

    def block(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, id offsets)."""
        raw = buf.tobytes()
        odd = [d for d in range(len(offs) - 1) if any(s in raw[offs[d] : offs[d + 1]] for s in self.special)] if any(s in raw for s in self.special) else []
        letter, punct = _LETTER[buf], _PUNCT[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = (letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:])
        w = T.Words(buf, offs, hashes=False)
        inside = np.flatnonzero(cut)
        start = np.sort(np.concatenate([w.start, inside]))
        end = np.sort(np.concatenate([w.end, inside]))
        h = T.byte_spans(buf, start, end, lower=True)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(~T.in_sorted(distinct, self.hash))
        if len(new):
            if len(self.hash) + len(new) > CACHE_WORDS:
                self.forget()
                new = np.arange(len(distinct))
            got = [self.encode_one(raw[a:b]) for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            count = np.array([len(g) for g in got], np.int64)
            begin = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, np.array([i for g in got for i in g], np.uint32)])
            every = np.concatenate([self.hash, distinct[new]])
            order = np.argsort(every)
            self.hash = every[order]
            self.begin = np.concatenate([self.begin, begin])[order]
            self.count = np.concatenate([self.count, count])[order]
        at = np.searchsorted(self.hash, distinct)[back]
        count, begin = self.count[at], self.begin[at]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        by_doc = np.searchsorted(start, offs)
        by_doc[-1] = len(start)
        id_offs = np.concatenate([[0], ends])[by_doc]
        if odd:
            parts = [ids[id_offs[d] : id_offs[d + 1]] for d in range(len(offs) - 1)]
            for d in odd:
                parts[d] = np.array(self.tokenizer.encode(raw[offs[d] : offs[d + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts).astype(np.uint32)
            id_offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, id_offs


def pack_lengths(lengths: list[int], tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, [(document, start, length), ...]) that hold every token once.

    Each sequence is exactly as long as its tier, or, at the end, a power of two.
    """
    top = tiers[-1]
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    tier_docs: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= top:
            out.append((top, [(d, at, top)]))
            at += top
        if n > at:
            tier_docs[tiers[bisect.bisect_left(tiers, n - at)]].append((n - at, d, at))
    pools = {t: sorted(v) for t, v in tier_docs.items()}  # ascending length; equal lengths by document

    def fill(seq: list, gap: int, below: int) -> int:
        """Whole documents of tiers up to ``below``, the longest that fits first."""
        for t in reversed(tiers[: below + 1]):
            pool = pools[t]
            while gap and pool:
                k = bisect.bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if k < 0:
                    break
                n, d, at = pool.pop(k)
                seq.append((d, at, n))
                gap -= n
        return gap

    for k in range(len(tiers) - 1, -1, -1):
        size, pool = tiers[k], pools[tiers[k]]
        while pool:
            n, d, at = pool.pop()
            seq = [(d, at, n)]
            gap = fill(seq, size - n, k)
            # no whole document fits: cut one of the shortest tier that has any
            while gap:
                donor = next((t for t in tiers if pools[t]), None)
                if donor is None:
                    break
                n, d, at = pools[donor].pop()
                take = min(n, gap)
                seq.append((d, at, take))
                gap -= take
                if n > take:
                    rest = n - take
                    bisect.insort(pools[tiers[bisect.bisect_left(tiers, rest)]], (rest, d, at + take))
            if gap:
                out += _by_powers(seq)
            else:
                out.append((size, seq))
    return out


def _by_powers(seq: list[tuple[int, int, int]]):
    """The pieces of a sequence cut into sequences of power-of-two lengths, long to short."""
    left = sum(n for _, _, n in seq)
    seq = list(reversed(seq))
    out = []
    while left:
        size = 1 << (left.bit_length() - 1)
        need, own = size, []
        while need:
            d, at, n = seq.pop()
            take = min(n, need)
            own.append((d, at, take))
            need -= take
            if n > take:
                seq.append((d, at + take, n - take))
        out.append((size, own))
        left -= size
    return out


def step_groups(sizes: list[int], budget: int) -> list[int]:
    """Group of each sequence: groups of nearly equal token sums, longest sequence to the least filled."""
    import heapq

    n = max(1, -(-sum(sizes) // budget))
    heap = [(0, g) for g in range(n)]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        total, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (total + sizes[k], g))
    return out


def pack_chunk(path: str, end_id: int, tiers, step_tokens: int, keep_ids: bool):
    def run(table: pa.Table) -> pa.Table:
        ids, texts = C.unpack(table)
        chunk, enc = table.column("chunk")[0].as_py(), Encoder.of(path)
        docs: list[np.ndarray] = []
        for _, _, buf, offs in T.blocks(ids, texts):
            tokens, at = enc.block(buf, offs)
            docs += [np.append(tokens[at[d] : at[d + 1]], np.uint32(end_id)).astype("<u4") for d in range(len(offs) - 1)]
        sequences = pack_lengths([len(d) for d in docs], tiers)
        groups = step_groups([t for t, _ in sequences], step_tokens)
        rows = []
        for s, (tier, pieces) in enumerate(sequences):
            offset = 0
            for d, at, n in pieces:
                own = docs[d][at : at + n]
                row = (None if ids[d] == C.NULL_ID else int(ids[d]), at, n, zlib.crc32(own.tobytes()), len(docs[d]), (chunk << 32) | s, offset, tier, (chunk << 20) | groups[s])
                rows.append((*row, own.tobytes()) if keep_ids else row)
                offset += n
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) + keep_ids)
        out = {n: pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, cols, strict=False)}
        return pa.table(out | ({"ids": pa.array(cols[-1], pa.binary())} if keep_ids else {}))

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2, tiers=TIERS, step_tokens: int = 65536, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``tiers`` are ascending powers of two, the longest the greatest sequence.
    Every document ends with ``end_id``, so a null or empty text is one token.
    ``keep_ids`` adds each piece's ids as little-endian uint32.  A null id comes
    back as null; rows with the same id are packed one by one; other columns are
    ignored; an empty table gives no pieces.  ``tokenizer_path`` must exist on
    every worker.
    """
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    n_chunks, _ = C.sizes(C.corpus_bytes(docs, text))
    chunks = C.packed(docs, id_col, text, n_chunks)
    return chunks.groupBy("chunk").applyInArrow(pack_chunk(tokenizer_path, end_id, tiers, step_tokens, keep_ids), SCHEMA + (", ids binary" if keep_ids else ""))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All `documents`, tokenised and packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
