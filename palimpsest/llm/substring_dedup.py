"""Substring de-duplication by fixed-block anchors, on words.

The reference blocks are the non-overlapping runs of ``block`` words of every
document (word 0, block, 2*block, ...).  Every rolling window of ``block``
words is a probe.  With ``2*block - 1 <= window`` each window of ``window``
words holds a whole reference block of each place it occurs at, so a repeated
window always shows as a probe that meets a reference block elsewhere.

1. Per chunk, distinct probe hashes go to hash buckets, each with two bits: is
   it also a reference block, is it there more than once.  A bucket answers
   with the hashes that meet a block of another place.
2. Hits are extended: the windows around a hit, up to ``window`` words, are
   compared by a 64-bit hash and the
   first place, by (doc_id, start), is kept per window.  Nothing is done per
   pair, so a passage in a third of all documents costs one entry per chunk.
3. Consecutive repeated windows are merged to maximal repeats per document.

Shuffled per word: about 4 bytes for the probe, 10 for windows that do repeat.
Each hash is sent once per chunk, so no bucket grows with a hot passage, and
frames bound what a chunk writes (``_chunks.deal``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from palimpsest.llm import _chunks as C
from palimpsest.llm import _text as T

PROBES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("flags", pa.binary()), ("n", pa.int32())])
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans binary"


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _joined(bucket: int, low: np.ndarray) -> np.ndarray:
    return (np.uint64(bucket) << np.uint64(32)) | low.astype(np.uint64)


def _keys(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return (C.by_bucket(h, n_buckets).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _windows(words: T.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, valid, local start) of every n-word window of a block."""
    h = T.run_hash(words.hash, n)
    room = words.room()[: len(h)]
    local = np.arange(len(words.start)) - np.repeat(words.offs[:-1], np.diff(words.offs))
    return h, room >= n, local[: len(h)]


def _doc_of(words: T.Words, lo: int) -> np.ndarray:
    return np.repeat(np.arange(lo, lo + len(words.offs) - 1), np.diff(words.offs))


def probe_pass(n_buckets: int, block: int):
    def run(table: pa.Table) -> pa.Table:
        ids, texts = C.unpack(table)
        chunk, hs, al = table.column("chunk")[0].as_py(), [], []
        for _, _, buf, offs in T.blocks(ids, texts):
            h, ok, local = _windows(T.Words(buf, offs), block)
            hs.append(h[ok])
            al.append(local[ok] % block == 0)
        h, aligned = np.concatenate(hs), np.concatenate(al)
        key = _keys(h, n_buckets)
        order = np.argsort(key)
        key, aligned = key[order], aligned[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(key))) > 1
        flag = np.logical_or.reduceat(aligned, first) if len(first) else aligned
        key, rows, z = key[first], [], zstandard.ZstdCompressor(level=1)
        for b, s in C.cut_by((key >> np.uint64(32)).astype(np.int64)):
            rows.append((b, chunk, _low(key[s]).tobytes(), C.pack(z, np.packbits(np.stack([flag[s], many[s]]))), s.stop - s.start))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, PROBES.types, strict=True)], schema=PROBES)

    return run


def answer_probes(table: pa.Table) -> pa.Table:
    """Of one bucket: per chunk, the keys that meet a reference block of another place."""
    z = zstandard.ZstdDecompressor()
    keys, chunk, aligned, many = [], [], [], []
    bucket = table.column("bucket")[0].as_py()
    for c, k, f, n in zip(*(table.column(x).to_pylist() for x in ("chunk", "keys", "flags", "n")), strict=True):
        bits = np.unpackbits(np.frombuffer(z.decompress(f), np.uint8), count=2 * n).reshape(2, n).astype(bool) if n else np.zeros((2, 0), bool)
        keys.append(np.frombuffer(k, np.uint32))
        chunk.append(np.full(n, c, np.int32))
        aligned.append(bits[0])
        many.append(bits[1])
    key, chunk, aligned, many = map(np.concatenate, (keys, chunk, aligned, many))
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    count = np.diff(np.append(first, len(k)))
    hit = np.logical_or.reduceat(aligned[order], first) & ((count > 1) | np.logical_or.reduceat(many[order], first))
    hits = order[np.repeat(hit, count)]
    hits = hits[np.lexsort((key[hits], chunk[hits]))]
    out = [(c, bucket, key[hits[s]].tobytes()) for c, s in C.cut_by(chunk[hits])]
    return pa.table({"chunk": pa.array([r[0] for r in out], pa.int32()), "bucket": pa.array([r[1] for r in out], pa.int32()), "keys": pa.array([r[2] for r in out], pa.binary())})


def extend_pass(n_buckets: int, block: int, window: int):
    """Windows around hits: the first document of each, per chunk, to the buckets of the window hash."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, z = [], zstandard.ZstdCompressor(level=1)
        if left.num_rows and right.num_rows:
            hits = np.sort(np.concatenate([_joined(b, np.frombuffer(k, np.uint32)) for b, k in zip(right.column("bucket").to_pylist(), right.column("keys").to_pylist(), strict=True)]))
            ids, texts = C.unpack(left)
            chunk, hs, docs = left.column("chunk")[0].as_py(), [], []
            for lo, _, buf, offs in T.blocks(ids, texts):
                w = T.Words(buf, offs)
                h, ok, _ = _windows(w, block)
                hit = np.zeros(len(w.start) + 1, np.int64)
                hit[1 : len(h) + 1] = T.in_sorted(_keys(h, n_buckets), hits) & ok
                np.cumsum(hit, out=hit)
                big, ok, _ = _windows(w, window)
                at = np.flatnonzero(ok & (hit[np.arange(len(big)) + window - block + 1] > hit[: len(big)]))
                hs.append(big[at])
                docs.append(_doc_of(w, lo)[at])
            h, doc = np.concatenate(hs), np.concatenate(docs)
            order = np.argsort(h, kind="stable")  # documents ascend by id, so the first of equal hashes is the first by id
            h, doc = h[order], doc[order]
            first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            h, doc = h[first], doc[first]
            for b, s in C.cut_by(C.by_bucket(h, n_buckets)):
                own, index = np.unique(doc[s], return_inverse=True)
                rows.append((b, chunk, h[s].tobytes(), C.pack(z, index.astype(np.uint32)), C.pack(z, ids[own])))
        names = ("bucket", "chunk", "h", "index", "ids")
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table({n: pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, (n, c) in enumerate(zip(names, cols, strict=True))})

    return run


def first_places(table: pa.Table) -> pa.Table:
    """Of one bucket: per chunk, the windows that start in a document with a smaller id elsewhere."""
    z = zstandard.ZstdDecompressor()
    hs, chunks, docs = [], [], []
    for c, h, index, ids in zip(*(table.column(x).to_pylist() for x in ("chunk", "h", "index", "ids")), strict=True):
        hs.append(np.frombuffer(h, np.uint64))
        chunks.append(np.full(len(hs[-1]), c, np.int32))
        docs.append(np.frombuffer(z.decompress(ids), np.int64)[np.frombuffer(z.decompress(index), np.uint32)])
    h, chunk, doc = map(np.concatenate, (hs, chunks, docs))
    order = np.argsort(h, kind="stable")
    k = h[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(k))))
    late = order[doc[order] > least]
    late = late[np.lexsort((h[late], chunk[late]))]
    out = [(c, h[late[s]].tobytes()) for c, s in C.cut_by(chunk[late])]
    return pa.table({"chunk": pa.array([r[0] for r in out], pa.int32()), "h": pa.array([r[1] for r in out], pa.binary())})


def remove_pass(window: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
        if left.num_rows:
            late = np.sort(np.concatenate([np.frombuffer(h, np.uint64) for h in right.column("h").to_pylist()])) if right.num_rows else np.zeros(0, np.uint64)
            ids, texts = C.unpack(left)
            kept, where = [], []
            for lo, _, buf, offs in T.blocks(ids, texts):
                h, ok, _ = _windows(w := T.Words(buf, offs), window)
                at = np.flatnonzero(ok)
                kept.append((h[at], _doc_of(w, lo)[at]))
                where.append((lo, at))
            h, doc = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
            order = np.argsort(h, kind="stable")
            k = h[order]
            again = np.zeros(len(h), bool)
            if len(k):
                # a later start of the same document counts, another document only if its id is larger
                head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                lead = np.repeat(order[head], np.diff(np.append(head, len(k))))
                same = np.concatenate([[False], (k[1:] == k[:-1]) & (doc[order][1:] == doc[order][:-1])])
                again[order] = (ids[doc[order]] > ids[doc[lead]]) | same
            again |= T.in_sorted(h, late)
            del kept, order, k
            done = 0
            for (lo, at), (_, hi, buf, offs) in zip(where, T.blocks(ids, texts), strict=True):
                w = T.Words(buf, offs, hashes=False)
                gone = T.covered(at[again[done : done + len(at)]], window, len(w.start))
                done += len(at)
                raw = buf.tobytes()
                for d in range(hi - lo):
                    a, b = int(w.offs[d]), int(w.offs[d + 1])
                    g = gone[a:b]
                    keep = np.flatnonzero(~g) + a
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                    # words kept that follow each other by one space need no cutting
                    text = b" ".join([raw[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                    out["doc_id"].append(None if ids[lo + d] == C.NULL_ID else int(ids[lo + d]))
                    out["n_words"].append(b - a)
                    out["n_removed"].append(int(g.sum()))
                    out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                    out["spans"].append(edges.astype(np.int32).tobytes())
        kinds = {"kept_sha256": pa.string(), "spans": pa.binary()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, block: int = 10) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, spans.

    A word goes if a window of ``window`` words that covers it also starts
    earlier: in a document with a smaller id, or earlier in the same document.
    ``spans`` holds the maximal removed runs as int32 pairs (from, to) of word
    positions.  A null text has no words; documents shorter than the window keep
    all; a null id counts as larger than any other and comes back as null; rows
    with the same id are documents of their own, neither of which is earlier;
    other columns are ignored.  An empty table gives an empty result.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block: 2 * block - 1 <= window")
    n_chunks, n_buckets = C.sizes(C.corpus_bytes(docs, text))
    chunks = C.packed(docs, id_col, text, n_chunks)
    by_chunk = chunks.groupBy("chunk")
    probes, opened = C.deal(by_chunk, probe_pass(n_buckets, block), "bucket int, chunk int, keys binary, flags binary, n int", "chunk", "bucket", n_buckets)
    hits, found = C.deal(probes.groupBy("bucket"), opened(answer_probes), "chunk int, bucket int, keys binary", "bucket", "chunk", n_chunks)
    near, opened = C.deal(by_chunk.cogroup(hits.groupBy("chunk")), found(extend_pass(n_buckets, block, window), True), "bucket int, chunk int, h binary, index binary, ids binary", "chunk", "bucket", n_buckets, True)
    late, found = C.deal(near.groupBy("bucket"), opened(first_places), "chunk int, h binary", "bucket", "chunk", n_chunks)
    return by_chunk.cogroup(late.groupBy("chunk")).applyInArrow(found(remove_pass(window), True), RESULT)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of `documents` that repeat a 20-word window, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
