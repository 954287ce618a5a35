"""Alignment of two tokenizers over a corpus, by the bytes at which their tokens end.

**Units.**  Both tokenizers cut wherever a single space stands between two
characters that aren't white space: the byte-level one begins a pre-token
there, and no piece of the other one's vocabulary holds its space mark behind another
character (checked when the file is read; otherwise texts are encoded whole).  So a text is cut there, and each
distinct unit is encoded and aligned once per worker, as far as a cache of bounded size
holds it.  Since both tokenizers end a token at the end of a unit, what is shared inside
units is all that is shared.

**Bitsets.**  The units of a block are laid out in one byte sequence.  A packed
bitset per tokenizer marks the bytes at which its tokens end; their AND marks the shared
cuts.  The rank of a cut, by popcounts of the words before it, is the number of tokens
that end up to it, so the ranks of successive cuts are the token ranges of a group.
Links, all pairs of both ranges, are expanded from them.

**Corpus counts.**  A block of documents is one row: its documents' numbers, its distinct id
pairs with how many of its documents hold each, and which document holds which pair how
often.  Only (pair, documents) of each block are shuffled, added up map-side first; a pair's count and
whether it is the highest of its A id go back to the blocks by a join on the pair, one row per block
and pair, so no pair is a hot key beyond one row per block.  Texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import scratch as _scratch
from palimpsest.llm import _chunks as C
from palimpsest.llm import _text as T
from palimpsest.llm.packing import _byte_letters

#: Units in a worker's cache, and the longest one that it keeps.
CACHE_UNITS = 400_000
LONGEST_UNIT = 64
#: Bytes of text in a block.
BLOCK = 4 << 20
MARK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters that every version of Unicode knows, then ASCII signs without the apostrophe of contractions.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@[-`{-~]*)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, A tokens up to each, B tokens up to each): byte offsets at which tokens of both end, by packed bitsets of n + 1 bits."""
    words = n // 64 + 1

    def bitset(ends: np.ndarray) -> np.ndarray:
        mark = np.zeros(words * 64, np.uint8)
        mark[ends] = 1
        return np.packbits(mark, bitorder="little").view(np.uint64)

    a, b = bitset(ends_a), bitset(ends_b)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    word, bit = cuts >> 6, (cuts & 63).astype(np.uint64)
    upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)

    def rank(bits: np.ndarray) -> np.ndarray:
        count = np.bitwise_count(bits).astype(np.int64)
        return (np.cumsum(count) - count)[word] + np.bitwise_count(bits[word] & upto)

    return cuts, rank(a), rank(b)


def products(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all A in [a_lo, a_hi) with all B in [b_lo, b_hi), group by group."""
    n, m = a_hi - a_lo, b_hi - b_lo
    a = np.repeat(C.spread(a_lo, n), np.repeat(m, n))
    b = C.spread(np.repeat(b_lo, n), np.repeat(m, n))
    return a, b


class Aligner:
    """Aligned units of two tokenizer files, remembered."""

    _held: dict[tuple, Aligner] = {}

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letter = {c: b for b, c in _byte_letters().items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) and self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.by_unit = not any(MARK in p.lstrip(MARK) for p in names)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.names = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.forget()

    @classmethod
    def of(cls, *paths: str) -> Aligner:
        if paths not in cls._held:
            cls._held[paths] = cls(*paths)
        return cls._held[paths]

    def forget(self) -> None:
        self.signs: dict[str, list[int]] = {}
        self.known: dict[str, int] = {}
        self.text: list[str] = []  # groups of a unit, as text
        self.tally = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups (-1: bytes differ), links
        self.begin = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def units(self, text: str) -> list[str]:
        """The text's units; each stands for itself behind a space."""
        return _CUT.split(text) if self.by_unit else [text]

    def encoded(self, units: list[str]) -> list[list[int]]:
        """A ids of units behind a space; a run of letters and the signs behind it are two pre-tokens, which the model takes as they are."""
        out: list[list[int]] = [[]] * len(units)
        tokenize, letters, rest = self.a.model.tokenize, self.letters, []
        for k, u in enumerate(units):
            if m := _PLAIN.fullmatch(u):
                ids = [t.id for t in tokenize("Ġ" + m[1].encode().decode("latin-1").translate(letters))]
                out[k] = ids + self.sign(m[2]) if m[2] else ids
            else:
                rest.append(k)
        for k, e in zip(rest, self.a.encode_batch([" " + units[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def sign(self, text: str) -> list[int]:
        if text not in self.signs:
            self.signs[text] = [t.id for t in self.a.model.tokenize(text)]
        return self.signs[text]

    def rejoins(self, ids: list[list[int]], spelled: list[bytes], size: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Which units are the bytes of their tokens."""
        want = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.fromiter(chain.from_iterable(ids), np.int64)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        total = np.append(0, np.cumsum(size[flat]))
        ends = np.cumsum(n)
        ok = total[ends] - total[ends - n] == want
        if ok.all():
            got = np.frombuffer(b"".join([spelled[i] for i in flat.tolist()]), np.uint8)
            other = np.flatnonzero(got != np.frombuffer(b"".join(raw), np.uint8))
            ok[np.searchsorted(np.cumsum(want), other, side="right")] = False
            return ok
        return np.array([b"".join([spelled[i] for i in x]) == r for x, r in zip(ids, raw, strict=True)], bool)

    def learn(self, units: list[str]) -> None:
        """Encode and align units that aren't known."""
        ids_a, ids_b = self.encoded(units), self.b.encode(units, num_threads=1)
        raw = [b" " + u.encode("utf-8", "surrogatepass") for u in units]
        ok = self.rejoins(ids_a, self.a_bytes, self.a_size, raw) & self.rejoins(ids_b, self.b_bytes, self.b_size, raw)
        n_a, n_b = (np.where(ok, np.fromiter(map(len, ids), np.int64, len(units)), 0) for ids in (ids_a, ids_b))
        if not ok.all():
            ids_a, ids_b = ([x if k else [] for x, k in zip(ids, ok.tolist(), strict=True)] for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        tally = np.zeros((len(units), 4), np.int64)
        tally[:, 0], tally[:, 1] = n_a, n_b
        text = [""] * len(units)
        pairs, begin = np.zeros(0, np.int64), np.zeros(len(units), np.int64)
        if len(a):
            ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            _, upto_a, upto_b = shared_cuts(ends_a, ends_b, int(ends_a[-1]))
            a_lo, b_lo = np.append(0, upto_a[:-1]), np.append(0, upto_b[:-1])
            left, right_side = products(a_lo, upto_a, b_lo, upto_b)
            pairs = (a[left] << 32) | b[right_side]
            links = (upto_a - a_lo) * (upto_b - b_lo)
            # a unit's end is a cut
            last = np.searchsorted(upto_a, np.cumsum(n_a)[ok])
            first = np.append(0, last[:-1] + 1)
            ends = np.append(0, np.cumsum(links))
            tally[ok, 2], tally[ok, 3] = last + 1 - first, ends[last + 1] - ends[first]
            begin[ok] = ends[first]
            words_a, words_b = [self.names[i] for i in a.tolist()], [self.names[i] for i in b.tolist()]
            groups = [words_a[i] + "|" + words_b[k] if j == i + 1 and m == k + 1 else ",".join(words_a[i:j]) + "|" + ",".join(words_b[k:m]) for i, j, k, m in zip(a_lo.tolist(), upto_a.tolist(), b_lo.tolist(), upto_b.tolist(), strict=True)]
            for u, i, j in zip(np.flatnonzero(ok).tolist(), first.tolist(), last.tolist(), strict=True):
                text[u] = ";".join(groups[i : j + 1])
        tally[~ok, 2] = -1
        self.known.update(zip(units, range(len(self.text), len(self.text) + len(units)), strict=True))
        self.text += text
        self.tally = np.concatenate([self.tally, tally])
        self.begin = np.concatenate([self.begin, begin + len(self.pairs)])
        self.pairs = np.concatenate([self.pairs, pairs])

    def block(self, texts: list[str]):
        """(tally per document, its groups' hash, pair numbers per document and how often) and the block's distinct pairs."""
        cut = [self.units(t) if t else [] for t in texts]
        new = {u for units in cut for u in units}.difference(self.known)
        if len(self.known) + len(new) > CACHE_UNITS:
            self.forget()
            new = {u for units in cut for u in units}
        # in order, so that a task that runs again does the same
        self.learn(sorted(new))
        known = self.known
        number = [[known[u] for u in units] for units in cut]
        size = np.array([len(x) for x in number], np.int64)
        unit = np.fromiter(chain.from_iterable(number), np.int64)
        doc = np.repeat(np.arange(len(texts)), size)
        tally = np.zeros((len(texts), 4), np.int64)
        np.add.at(tally, doc, self.tally[unit])
        whole = np.bincount(doc, self.tally[unit, 2] < 0, len(texts)) == 0
        tally[~whole] = 0
        digest = [hashlib.sha256(";".join([self.text[k] for k in x]).encode()).hexdigest() if x and w else "" for x, w in zip(number, whole.tolist(), strict=True)]
        keep = whole[doc]
        # each unit of a document once, with its count
        span = len(self.text)
        key, often = np.unique(doc[keep] * span + unit[keep], return_counts=True)
        doc, unit = np.divmod(key, span) if span else (key, key)
        n = self.tally[unit, 3]
        link = self.pairs[C.spread(self.begin[unit], n)]
        distinct, at = np.unique(link, return_inverse=True)
        key = np.repeat(doc, n) * max(1, len(distinct)) + at
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(np.repeat(often, n)[order], head) if len(key) else np.zeros(0, np.int64)
        doc, at = np.divmod(key[head], max(1, len(distinct)))
        # a cache of many long units isn't worth its memory
        if any(len(u) > LONGEST_UNIT for u in new):
            self.forget()
        return tally, digest, distinct, np.bincount(at, minlength=len(distinct)), (np.bincount(doc, minlength=len(texts)), at, times)


TABLE = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("shas", pa.binary()), ("held", pa.binary()), ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64()))])
TABLE_DDL = "block long, docs binary, shas binary, held binary, pairs array<bigint>, n_docs array<bigint>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _aligned(paths):
    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        aligner, task, made = Aligner.of(*paths), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, _, _ in T.blocks(None, batch.column(1), BLOCK):
                ids = batch.column(0).slice(lo, hi - lo)
                tally, digest, pairs, n_docs, held = aligner.block(batch.column(1).slice(lo, hi - lo).to_pylist())
                docs = np.column_stack([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), tally, held[0]]).astype(np.int64)
                row = [(task << 32) | made, z.compress(docs.tobytes()), z.compress("\n".join(digest).encode()), z.compress(held[1].astype(np.int32).tobytes() + held[2].astype(np.int32).tobytes()), pairs.tolist(), n_docs.tolist()]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, TABLE, strict=True)], schema=TABLE)

    return run


def _counted(table: pa.Table, answers: pa.Table) -> pa.Table:
    z = zstandard.ZstdDecompressor()
    names = [x.split()[0] for x in RESULT.split(", ")]
    out = []
    pair, count, best = (answers.column(c).to_numpy() for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    count, best = count[order], best[order]
    for docs, shas, held in zip(*(table.column(c).to_pylist() for c in ("docs", "shas", "held")), strict=True):
        docs = np.frombuffer(z.decompress(docs), np.int64).reshape(-1, 7)
        at, times = np.frombuffer(z.decompress(held), np.int32).reshape(2, -1)
        ends = np.cumsum(docs[:, 6])
        sums = []
        for value in (best, count):
            total = np.append(0, np.cumsum(value[at] * times.astype(np.int64)))
            sums.append(total[ends] - total[ends - docs[:, 6]])
        ids = pa.array(docs[:, 0], pa.int64(), mask=docs[:, 1] == 0)
        out.append(pa.Table.from_arrays([ids, *(pa.array(docs[:, k]) for k in (2, 3, 4, 5)), *(pa.array(s.astype(np.int64)) for s in sums), pa.array(z.decompress(shas).decode().split("\n"), pa.string())], names=names))
    return pa.concat_tables(out)


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens of a space and the text by ``byte_level`` (A), of the text by ``pieces``
    (B, which adds the space).  Texts that are null, empty, or whose tokens' bytes don't join to
    space and text have zeros and '' throughout, and hold no pair.  A pair's count is the number of
    rows that hold it linked; rows that repeat each other count each; ties
    for an A id's highest count are all best.  A null id comes back as null;
    texts of any length are aligned whole; other columns are ignored; an empty table gives
    an empty result.  Both files must exist on every worker.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = _scratch.table(src.mapInArrow(C.settled(_aligned((byte_level, pieces))), TABLE_DDL), "alignment")
    each = blocks.select("block", F.explode(F.arrays_zip("pairs", "n_docs")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.n_docs").alias("n"))
    counts = _scratch.table(each.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    a_id = F.shiftright("pair", 32)
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("highest"))
    told = counts.withColumn("a", a_id).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    answers = each.select(F.col("block").alias("home"), "pair").join(told, "pair")
    return blocks.select("block", "docs", "shas", "held").groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(_counted, RESULT)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level BPE and a piece BPE over all `documents`."""
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
