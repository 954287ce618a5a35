"""Substring de-duplication by enhanced suffix arrays, on bytes.

Suffixes are dealt so that all that share their first ``length`` bytes meet:
a window of ``length`` bytes belongs to the smallest hash of its ``SEED``-byte
substrings (its anchor).  Consecutive windows with one anchor travel as one
piece of text, at most ``length + RUN - 1`` bytes.

1. Per chunk, the distinct anchors go to hash buckets; only those that occur
   in another document come back, so unique text is never shuffled again.
2. Pieces of repeated anchors, once per chunk and content, go to the anchor's
   bucket.  There each anchor's pieces give an enhanced suffix array (sorted
   suffixes and common-prefix lengths).  A stack scan walks its interval tree;
   an interval of at least ``length`` bytes whose members differ in the byte
   on their left, or begin a piece, is a maximal repeat of the piece, with all
   its occurrences.  A member is covered where the interval holds a document
   with a smaller id.
3. Each chunk maps covered parts of pieces back to its documents.

An interval without left diversity is part of the repeat one byte to its left,
which has the same members, so no covered byte is lost; this is why the first
suffix of a piece, whose left neighbour lives in another bucket, always counts
as diverse.  Anchors with one distinct piece need no sorting: the piece is the
repeat, the one left-diverse interval of its copies.  Suffixes are batched by
their first ``length`` bytes.

Hot anchors.  An anchor with very many distinct pieces isn't one bucket's work:
its windows are dealt by the hash of all their ``length`` bytes, once per chunk, and
equal windows are the groups.  Step 1 finds such anchors: the chunks' distinct
pieces add up to more than ``HOT``, and the rarest hash among them, by its leading
zeros, is one of about 2**``HOT_ZEROS``.  Either way gives the same covered bytes.

``repeat_groups`` returns the groups themselves with all their occurrences;
``suffix_dedup`` what they cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _chunks as C
from palimpsest.llm import _text as T
from palimpsest.llm.substring_dedup import _joined, _keys, _low

SEED = 20
RUN = 31
BATCH = 10_000
HOT = 4_000
HOT_ZEROS = 12
PIECES = 2_000
#: Pieces repeat each byte about four times, so buckets hold less of the corpus than elsewhere.
MORE_BUCKETS = 4
BLOCK_BYTES = 1 << 18
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def _sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    size, m = 1, h
    while size * 2 <= n:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (n - size)], m[n - size :]) if n > size else m


class Pieces:
    """Pieces of one block of documents: start, n_windows, anchor, doc."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lo: int, length: int):
        self.pre = T.prefix(T.BYTE_VALUES[buf])
        n = len(buf) - length + 1
        self.start = self.runs = self.doc = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n <= 0:
            return
        least = _sliding_min(T.rolling_hash(self.pre, SEED), length - SEED + 1)[:n]
        lens = np.diff(offs)
        ok = np.zeros(n + 1, bool)
        ok[:n] = True
        for_end = offs[1:-1][lens[:-1] > 0]
        # starts whose window would cross a document's end
        bad = np.zeros(n + 1, np.int32)
        np.add.at(bad, np.clip(for_end - length + 1, 0, n), 1)
        np.add.at(bad, np.clip(for_end, 0, n), -1)
        ok[:n] &= np.cumsum(bad)[:n] == 0
        ok[n] = False
        new = np.concatenate([[True], (least[1:] != least[:-1])])
        new[1:] |= ok[1:n] & ~ok[: n - 1]
        begin = offs[:-1][lens > 0]
        new[begin[begin < n]] = True
        new &= ok[:n]
        head = np.flatnonzero(new)
        # a run ends at the next head or where windows stop being valid
        stop = np.flatnonzero(ok[:n] & ~ok[1:]) + 1
        end = np.minimum(np.append(head[1:], n), stop[np.searchsorted(stop, head, side="right")]) if len(head) else head
        run = end - head
        parts = -(-run // RUN)
        rep = np.repeat(np.arange(len(head)), parts)
        k = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = head[rep] + k * RUN
        self.runs = np.minimum(run[rep] - k * RUN, RUN)
        self.anchor = T.mix(least[head])[rep]  # minima are small: mixed, they spread over the buckets
        self.doc = np.searchsorted(offs, self.start, side="right") - 1 + lo

    def keep(self, mask: np.ndarray) -> None:
        self.start, self.runs, self.anchor, self.doc = self.start[mask], self.runs[mask], self.anchor[mask], self.doc[mask]

    def content(self, length: int) -> np.ndarray:
        return T.spans_hash(self.pre, self.start, self.start + self.runs + length - 1)


def anchor_pass(n_buckets: int, length: int):
    """Rows (bucket, chunk, keys, flags, counts): a chunk's distinct anchors, whether two documents have one, its distinct pieces, and the most leading zeros of their hashes."""

    def run(table: pa.Table) -> pa.Table:
        ids, texts = C.unpack(table)
        chunk, parts = table.column("chunk")[0].as_py(), []
        for lo, _, buf, offs in T.blocks(ids, texts, BLOCK_BYTES):
            p = Pieces(buf, offs, lo, length)
            parts.append((_keys(p.anchor, n_buckets), p.doc, p.content(length)))
        key, doc, content = (np.concatenate([x[i] for x in parts]) for i in range(3))
        order = np.lexsort((content, key))
        key, doc, content = key[order], doc[order], content[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        many = np.maximum.reduceat(doc, first) > np.minimum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        new = np.concatenate([[1], (content[1:] != content[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0)
        count = np.add.reduceat(new.astype(np.uint32), first) if len(first) else np.zeros(0, np.uint32)
        zeros = np.maximum.reduceat(64 - np.frexp(content.astype(np.float64))[1], first) if len(first) else np.zeros(0)
        key, rows, z = key[first], [], zstandard.ZstdCompressor(level=1)
        for b, s in C.cut_by((key >> np.uint64(32)).astype(np.int64)):
            rows.append((b, chunk, _low(key[s]).tobytes(), C.pack(z, np.packbits(many[s])), C.pack(z, np.concatenate([count[s].astype(np.uint32), zeros[s].astype(np.uint32)]))))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table({n: pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, (n, c) in enumerate(zip(("bucket", "chunk", "keys", "flags", "counts"), cols, strict=True))})

    return run


def answer_anchors(limit: int, least_zeros: int):
    """Of one bucket: per chunk, the anchors that another document has too, and which of them are hot."""

    def run(table: pa.Table) -> pa.Table:
        z, zc = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        bucket, keys, chunk, many, counts, zeros = table.column("bucket")[0].as_py(), [], [], [], [], []
        for c, k, f, n in zip(*(table.column(x).to_pylist() for x in ("chunk", "keys", "flags", "counts")), strict=True):
            keys.append(np.frombuffer(k, np.uint32))
            chunk.append(np.full(len(keys[-1]), c, np.int32))
            many.append(np.unpackbits(np.frombuffer(z.decompress(f), np.uint8), count=len(keys[-1])).astype(bool))
            own = np.frombuffer(z.decompress(n), np.uint32).astype(np.int64)
            counts.append(own[: len(own) // 2])
            zeros.append(own[len(own) // 2 :])
        key, chunk, many, counts, zeros = map(np.concatenate, (keys, chunk, many, counts, zeros))
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.append(first, len(k)))
        hot = np.zeros(len(key), bool)
        hot[order] = np.repeat((np.add.reduceat(counts[order], first) > limit) & (np.maximum.reduceat(zeros[order], first) >= least_zeros), count)
        hits = order[np.repeat((count > 1) | np.logical_or.reduceat(many[order], first), count)]
        hits = hits[np.lexsort((key[hits], chunk[hits]))]
        out = [(c, bucket, key[hits[s]].tobytes(), C.pack(zc, np.packbits(hot[hits[s]]))) for c, s in C.cut_by(chunk[hits])]
        return pa.table({"chunk": pa.array([r[0] for r in out], pa.int32()), "bucket": pa.array([r[1] for r in out], pa.int32()), "keys": pa.array([r[2] for r in out], pa.binary()), "hot": pa.array([r[3] for r in out], pa.binary())})

    return run


def _spread(buf: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bytes buf[start:start+n] of all ranges, concatenated."""
    return buf[C.spread(start, n)]


def piece_pass(n_buckets: int, length: int):
    """Pieces of repeated anchors, one per content and chunk, with the smallest id there; of hot anchors the windows' hashes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, z, zd = [], zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        if left.num_rows and right.num_rows:
            hits, hot = [], []
            for b, k, f in zip(*(right.column(x).to_pylist() for x in ("bucket", "keys", "hot")), strict=True):
                hits.append(_joined(b, np.frombuffer(k, np.uint32)))
                hot.append(np.unpackbits(np.frombuffer(zd.decompress(f), np.uint8), count=len(hits[-1])).astype(bool))
            hits, hot = np.concatenate(hits), np.concatenate(hot)
            hot = np.sort(hits[hot])
            hits = np.sort(hits)
            ids, texts = C.unpack(left)
            chunk, got, windows = left.column("chunk")[0].as_py(), [], []
            for lo, _, buf, offs in T.blocks(ids, texts, BLOCK_BYTES):
                p = Pieces(buf, offs, lo, length)
                keys = _keys(p.anchor, n_buckets)
                if len(hot):
                    own = T.in_sorted(keys, hot)
                    at = C.spread(p.start[own], p.runs[own])
                    windows.append((T.spans_hash(p.pre, at, at + length), np.repeat(p.doc[own], p.runs[own]), np.repeat(p.anchor[own], p.runs[own])))
                    keys = keys[~own]
                    p.keep(~own)
                p.keep(T.in_sorted(keys, hits))
                h = p.content(length)
                _, one = np.unique(h, return_index=True)
                n = p.runs[one] + length - 1
                got.append((p.anchor[one], h[one], p.doc[one], n, _spread(buf, p.start[one], n)))
            anchor, h, doc, n, data = (np.concatenate([g[i] for g in got]) for i in range(5))
            at = np.cumsum(n) - n
            order = np.lexsort((doc, h, anchor))
            first = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])]) if len(h) else np.zeros(0, bool)
            order = order[first]
            for b, s in C.cut_by(C.by_bucket(anchor[order], n_buckets)):
                o = order[s]
                own, index = np.unique(doc[o], return_inverse=True)
                rows.append((b, chunk, 0, n[o].astype(np.uint8).tobytes(), C.pack(z, index.astype(np.uint32)), C.pack(z, ids[own]), C.pack(z, _spread(data, at[o], n[o])), b""))
            if windows:
                h, doc, anchor = (np.concatenate([w[i] for w in windows]) for i in range(3))
                order = np.lexsort((doc, h))
                first = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
                # several documents of the chunk: the second one tells
                again = np.zeros(len(h), bool)
                if len(h):
                    head = np.flatnonzero(first)
                    again[order[first]] = np.maximum.reduceat(doc[order], head) > doc[order[first]]
                order = order[first]
                for b, s in C.cut_by(C.by_bucket(h[order], n_buckets)):
                    o = order[s]
                    own, index = np.unique(doc[o], return_inverse=True)
                    rows.append((b, chunk, 1, C.pack(z, np.packbits(again[o])), C.pack(z, index.astype(np.uint32)), C.pack(z, ids[own]), h[o].tobytes(), np.unique(anchor[o]).tobytes()))
        names = ("bucket", "chunk", "hot", "lens", "index", "ids", "text", "anchors")
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        return pa.table({m: pa.array(c, pa.int32() if i < 3 else pa.binary()) for i, (m, c) in enumerate(zip(names, cols, strict=True))})

    return run


def stack_scan(lcp: np.ndarray, length: int):
    """Intervals (common prefix, first, last) of an enhanced suffix array, children before parents.

    lcp[i] is the common prefix of suffixes i-1 and i; only intervals of at
    least ``length`` are visited.
    """
    stack: list[tuple[int, int]] = []
    for i, l in enumerate([*lcp.tolist(), 0]):  # noqa: E741
        left = i - 1
        while stack and stack[-1][0] > l:
            depth, left = stack.pop()
            yield depth, left, i - 1
        if l >= length and (not stack or stack[-1][0] < l):
            stack.append((l, left))


def repeats_of(text: np.ndarray, start: np.ndarray, n: np.ndarray, length: int):
    """Maximal repeat groups among distinct pieces text[start:start+n] of one anchor batch.

    Yields (common prefix, piece indices, offsets) of each left-diverse
    interval, inner intervals before the ones around them.
    """
    width = length + RUN - 1
    runs = n - length + 1
    piece = np.repeat(np.arange(len(n)), runs)
    off = np.arange(len(piece)) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = start[piece] + off
    room = (n[piece] - off).astype(np.int64)
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    key = T.spans_hash(T.prefix(T.BYTE_VALUES[text]), begin, begin + length)
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    count = np.diff(np.append(first, len(k)))
    order = order[np.repeat(count > 1, count)]  # suffixes whose first bytes occur once have no interval
    cuts = [0]
    edges = np.cumsum(count[count > 1])
    while len(edges) and cuts[-1] < edges[-1]:
        cuts.append(int(edges[min(np.searchsorted(edges, cuts[-1] + BATCH, side="left"), len(edges) - 1)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        own = own[np.argsort(room[own], kind="stable")]  # padding equals zero bytes: the shorter suffix goes first
        rows = padded[begin[own].astype(np.int32)[:, None] + np.arange(width, dtype=np.int32)]
        rows[np.arange(width) >= room[own][:, None]] = 0
        rank = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
        own, rows = own[rank], rows[rank]
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width)
        lcp = np.zeros(len(own), np.int64)
        lcp[1:] = np.minimum(common, np.minimum(room[own][1:], room[own][:-1]))
        lefts = np.where(off[own] == 0, -1, text[np.maximum(begin[own] - 1, 0)].astype(np.int64))
        p, o = piece[own], off[own]
        # prefix counts: members that begin a piece, and neighbours with another left byte
        heads = np.concatenate([[0], np.cumsum(lefts < 0)])
        change = np.concatenate([[0, 0], np.cumsum(lefts[1:] != lefts[:-1])])
        for depth, i, j in stack_scan(lcp, length):
            if heads[j + 1] > heads[i] or change[j + 1] > change[i + 1]:
                yield depth, p[i : j + 1], o[i : j + 1]


PARTS = "chunk int, hot int, h binary, off binary, len binary, grp binary"


def _parts(rows: list) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table({m: pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, (m, c) in enumerate(zip(("chunk", "hot", "h", "off", "len", "grp"), cols, strict=True))})


def hot_windows(table: pa.Table, groups: bool) -> list:
    """Rows of one bucket's hot windows: all of a chunk's, and which of them a smaller document has (with groups: two documents)."""
    z, zc = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    hs, chunks, docs, several = [], [], [], []
    for c, again, index, ids, h in zip(*(table.column(x).to_pylist() for x in ("chunk", "lens", "index", "ids", "text")), strict=True):
        hs.append(np.frombuffer(h, np.uint64))
        chunks.append(np.full(len(hs[-1]), c, np.int32))
        docs.append(np.frombuffer(z.decompress(ids), np.int64)[np.frombuffer(z.decompress(index), np.uint32)])
        several.append(np.unpackbits(np.frombuffer(z.decompress(again), np.uint8), count=len(hs[-1])).astype(bool))
    h, chunk, doc, several = map(np.concatenate, (hs, chunks, docs, several))
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    size = np.diff(np.append(first, len(h)))
    low = np.repeat(np.minimum.reduceat(doc[order], first), size)
    if groups:
        told = np.repeat((np.maximum.reduceat(doc[order], first) > np.minimum.reduceat(doc[order], first)) | np.logical_or.reduceat(several[order], first), size)
    else:
        told = doc[order] > low
    late = np.zeros(len(h), bool)
    late[order] = told
    order = np.lexsort((h, chunk))
    anchors = dict(zip(table.column("chunk").to_pylist(), table.column("anchors").to_pylist(), strict=True))
    return [(c, 1, h[order[s]].tobytes(), C.pack(zc, np.packbits(late[order[s]])), anchors[c], b"") for c, s in C.cut_by(chunk[order])]


def scan_bucket(length: int, groups: bool = False):
    """Of one bucket: per chunk, the covered parts of its pieces: content hash, offset, bytes.

    groups: the parts of all members of every group instead, with the hash of the
    group's string.
    """

    def run(table: pa.Table) -> pa.Table:
        C.settle()
        is_hot = table.column("hot").to_numpy() == 1
        rows = hot_windows(table.filter(pa.array(is_hot)), groups) if is_hot.any() else []
        if not is_hot.all():
            rows += cold(table.filter(pa.array(~is_hot)))
        return _parts(rows)

    def cold(table: pa.Table) -> list:
        z = zstandard.ZstdDecompressor()
        lens, chunks, docs, texts = [], [], [], []
        for c, n, index, ids, text in zip(*(table.column(x).to_pylist() for x in ("chunk", "lens", "index", "ids", "text")), strict=True):
            lens.append(np.frombuffer(n, np.uint8).astype(np.int64))
            chunks.append(np.full(len(n), c, np.int32))
            docs.append(np.frombuffer(z.decompress(ids), np.int64)[np.frombuffer(z.decompress(index), np.uint32)])
            texts.append(np.frombuffer(z.decompress(text), np.uint8))
        n, chunk, doc, text = map(np.concatenate, (lens, chunks, docs, texts))
        start = np.cumsum(n) - n
        content = np.zeros(len(n), np.uint64)
        anchor = np.zeros(len(n), np.uint64)
        for a in range(0, len(n), 20_000):  # bounded blocks
            s, m = start[a : a + 20_000], n[a : a + 20_000]
            part = text[s[0] : s[-1] + m[-1]]
            pre, s = T.prefix(T.BYTE_VALUES[part]), s - s[0]
            content[a : a + 20_000] = T.spans_hash(pre, s, s + m)
            h = T.rolling_hash(pre, SEED)
            anchor[a : a + 20_000] = _sliding_min(h, length - SEED + 1)[s]
        # one copy of each content, with its smallest document
        order = np.lexsort((doc, content, anchor))
        first = np.flatnonzero(np.concatenate([[True], (content[order][1:] != content[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])]))
        lead = order[first]
        member_at = np.append(first, len(order))
        group = np.zeros(len(n), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(member_at))
        least = doc[lead]
        if groups:
            # the interval of a content's copies is the whole piece; copies within a chunk are found there
            late = np.arange(len(n))
        else:
            # members of a content with a larger document are covered as a whole
            late = np.flatnonzero(doc > least[group])
        out_p, out_o, out_l, out_g = [late], [np.zeros(len(late), np.uint8)], [n[late].astype(np.uint8)], [content[late]]
        # anchors with several contents: the enhanced suffix array
        a = anchor[lead]
        heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        count = np.diff(np.append(heads, len(a)))
        several = np.flatnonzero(np.repeat(count > 1, count))
        if len(several):
            # all members, by content, smallest document first
            cuts = [0]
            edges = np.cumsum(count[count > 1])
            while cuts[-1] < len(several):
                cuts.append(int(edges[min(np.searchsorted(edges, cuts[-1] + PIECES, side="left"), len(edges) - 1)]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                got_p, got_o, got_l, got_g = [], [], [], []
                own = several[lo:hi]
                m = n[lead[own]]
                part = _spread(text, start[lead[own]], m)
                begin = np.cumsum(m) - m
                pre = T.prefix(T.BYTE_VALUES[part]) if groups else None
                ids = least[own]
                for depth, p, o in repeats_of(part, begin, m, length):
                    if groups:
                        at = begin[p[:1]] + o[:1]
                        got_g.append(np.repeat(T.spans_hash(pre, at, at + depth), len(p)))
                        got_p.append(p + lo)
                        got_o.append(o)
                        got_l.append(np.full(len(p), depth))
                        continue
                    d = ids[p]
                    later = d > d.min()
                    got_p.append(p[later] + lo)
                    got_o.append(o[later])
                    got_l.append(np.full(int(later.sum()), depth))
                if not got_p:
                    continue
                gp, go, gl = np.concatenate(got_p), np.concatenate(got_o), np.concatenate(got_l)
                if groups:
                    gg = np.concatenate(got_g)
                else:
                    # the longest cover per suffix; it holds for every member of the content
                    rank = np.lexsort((-gl, go, gp))
                    top = np.concatenate([[True], (gp[rank][1:] != gp[rank][:-1]) | (go[rank][1:] != go[rank][:-1])]) if len(gp) else np.zeros(0, bool)
                    gp, go, gl = gp[rank][top], go[rank][top], gl[rank][top]
                    gg = np.zeros(len(gp), np.uint64)
                g = several[gp]
                # members covered as a whole need no part; those with the content's smallest document do
                size = member_at[g + 1] - member_at[g]
                rep = np.repeat(np.arange(len(g)), size)
                member = order[C.spread(member_at[g], size)]
                need = np.ones(len(member), bool) if groups else doc[member] == least[g[rep]]
                out_p.append(member[need])
                out_o.append(go[rep][need].astype(np.uint8))
                out_l.append(gl[rep][need].astype(np.uint8))
                out_g.append(gg[rep][need])
        p, o, l, g = map(np.concatenate, (out_p, out_o, out_l, out_g))  # noqa: E741
        if groups:
            # an interval may also be the whole of a piece: once
            rank = np.lexsort((g, l, o, p))
            new = np.concatenate([[True], (np.diff(p[rank]) != 0) | (np.diff(o[rank].astype(np.int64)) != 0) | (np.diff(l[rank].astype(np.int64)) != 0)])
            p, o, l, g = p[rank][new], o[rank][new], l[rank][new], g[rank][new]  # noqa: E741
        rank = np.lexsort((o, content[p], chunk[p]))
        p, o, l, g = p[rank], o[rank], l[rank], g[rank]  # noqa: E741
        zc = zstandard.ZstdCompressor(level=1)
        return [(c, 0, content[p[s]].tobytes(), C.pack(zc, o[s].astype(np.uint8)), C.pack(zc, l[s].astype(np.uint8)), g[s].tobytes() if groups else b"") for c, s in C.cut_by(chunk[p])]

    return run


class Parts:
    """What the buckets told one chunk: parts of pieces by content, sorted, and hot windows with their bit."""

    def __init__(self, table: pa.Table):
        z = zstandard.ZstdDecompressor()
        h, off, size, grp = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        hot, told, anchors = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.uint64)]
        if table.num_rows:
            for kind, a, b, c, d in zip(*(table.column(x).to_pylist() for x in ("hot", "h", "off", "len", "grp")), strict=True):
                if kind:
                    hot.append(np.frombuffer(a, np.uint64))
                    told.append(np.unpackbits(np.frombuffer(z.decompress(b), np.uint8), count=len(hot[-1])).astype(bool))
                    anchors.append(np.frombuffer(c, np.uint64))
                    continue
                h.append(np.frombuffer(a, np.uint64))
                off.append(np.frombuffer(z.decompress(b), np.uint8).astype(np.int64))
                size.append(np.frombuffer(z.decompress(c), np.uint8).astype(np.int64))
                grp.append(np.frombuffer(d, np.uint64))
        h, off, size, grp = map(np.concatenate, (h, off, size, grp))
        order = np.argsort(h, kind="stable")
        self.h, self.off, self.size = h[order], off[order], size[order]
        self.grp = grp[order] if len(grp) else grp
        hot, told = np.concatenate(hot), np.concatenate(told)
        order = np.argsort(hot)
        self.hot, self.told, self.anchors = hot[order], told[order], np.unique(np.concatenate(anchors))

    def of(self, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, part) of every part of the pieces' contents."""
        a, b = np.searchsorted(self.h, content, side="left"), np.searchsorted(self.h, content, side="right")
        return np.repeat(np.arange(len(content)), b - a), C.spread(a, b - a)

    def windows(self, p: Pieces, length: int):
        """(start, document, hot number) of the pieces' hot windows."""
        if not len(self.hot):
            return (np.zeros(0, np.int64),) * 3
        own = T.in_sorted(p.anchor, self.anchors)
        at = C.spread(p.start[own], p.runs[own])
        w = T.spans_hash(p.pre, at, at + length)
        ok = np.flatnonzero(T.in_sorted(w, self.hot))
        return at[ok], np.repeat(p.doc[own], p.runs[own])[ok], np.searchsorted(self.hot, w[ok])


def _after_first(key: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which entries have a larger id than the first one of their key; documents ascend by id."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    again = np.zeros(len(key), bool)
    if len(k):
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        lead = np.repeat(order[head], np.diff(np.append(head, len(k))))
        again[order] = ids[doc[order]] > ids[doc[lead]]
    return again


def cover_pass(length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
        out = {k: [] for k in names}
        if left.num_rows:
            ids, texts = C.unpack(left)
            told = Parts(right)
            # pieces of this chunk with the same content: those after the smallest id are covered as a whole
            blocks, hs, docs, hot = [], [], [], []
            for lo, hi, buf, offs in T.blocks(ids, texts, BLOCK_BYTES):
                p = Pieces(buf, offs, lo, length)
                c = p.content(length)
                at, doc, number = told.windows(p, length)
                blocks.append((lo, hi, p.start, p.runs, len(c), at))
                hs.append(c)
                docs.append(p.doc)
                hot.append((number, doc))
            content, doc = np.concatenate(hs), np.concatenate(docs)
            again = _after_first(content, doc, ids)
            number, doc = (np.concatenate([x[i] for x in hot]) for i in range(2))
            late = told.told[number] | _after_first(number, doc, ids) if len(number) else np.zeros(0, bool)
            done = hot_done = 0
            for (lo, hi, start, runs, m, at), (_, _, buf, offs) in zip(blocks, T.blocks(ids, texts, BLOCK_BYTES), strict=True):
                c, whole = content[done : done + m], again[done : done + m]
                done += m
                gone_windows = at[late[hot_done : hot_done + len(at)]]
                hot_done += len(at)
                rep, part = told.of(c)
                s = np.concatenate([start[whole], start[rep] + told.off[part], gone_windows])
                e = np.concatenate([runs[whole] + length - 1, told.size[part], np.full(len(gone_windows), length)])
                gone = T.covered(s, e, len(buf))
                for d in range(hi - lo):
                    x, y = int(offs[d]), int(offs[d + 1])
                    g = gone[x:y]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                    out["doc_id"].append(None if ids[lo + d] == C.NULL_ID else int(ids[lo + d]))
                    out["n_bytes"].append(y - x)
                    out["n_removed"].append(int(g.sum()))
                    out["n_spans"].append(len(edges) // 2)
                    out["kept_sha256"].append(hashlib.sha256(buf[x:y][~g].tobytes()).hexdigest())
                    out["spans"].append(edges.astype(np.int64).tobytes())
        kinds = {"kept_sha256": pa.string(), "spans": pa.binary()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})

    return run


OCCURRENCES = "grp long, length int, doc_id long, start long"


def place_pass(length: int):
    """Rows (grp, length, doc_id, start): where the groups' members stand in one chunk's documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if left.num_rows:
            ids, texts = C.unpack(left)
            told = Parts(right)
            for lo, _, buf, offs in T.blocks(ids, texts, BLOCK_BYTES):
                p = Pieces(buf, offs, lo, length)
                rep, part = told.of(p.content(length))
                out.append((told.grp[part].view(np.int64), told.size[part], p.doc[rep], p.start[rep] + told.off[part] - offs[p.doc[rep] - lo]))
                at, doc, number = told.windows(p, length)
                ok = told.told[number]
                out.append((told.hot[number[ok]].view(np.int64), np.full(int(ok.sum()), length), doc[ok], at[ok] - offs[doc[ok] - lo]))
            grp, size, doc, start = (np.concatenate([x[i] for x in out]) for i in range(4))
            named = ids[doc]
            return pa.table({"grp": pa.array(grp), "length": pa.array(size.astype(np.int32)), "doc_id": pa.array(named, mask=named == C.NULL_ID), "start": pa.array(start)})
        return pa.table({n: pa.array([], pa.int32() if n == "length" else pa.int64()) for n in ("grp", "length", "doc_id", "start")})

    return run


def _scanned(docs: DataFrame, id_col: str, text: str, length: int, groups: bool):
    """(chunks, parts for each chunk, how their kernel opens them)."""
    if not SEED < length <= 225:
        raise ValueError("length must be from 21 to 225 bytes")
    n_chunks, n_buckets = C.sizes(C.corpus_bytes(docs, text))
    n_buckets *= MORE_BUCKETS
    by_chunk = C.packed(docs, id_col, text, n_chunks).groupBy("chunk")
    anchors, opened = C.deal(by_chunk, anchor_pass(n_buckets, length), "bucket int, chunk int, keys binary, flags binary, counts binary", "chunk", "bucket", n_buckets)
    hits, found = C.deal(anchors.groupBy("bucket"), opened(answer_anchors(HOT, HOT_ZEROS)), "chunk int, bucket int, keys binary, hot binary", "bucket", "chunk", n_chunks)
    pieces, opened = C.deal(by_chunk.cogroup(hits.groupBy("chunk")), found(piece_pass(n_buckets, length), True), "bucket int, chunk int, hot int, lens binary, index binary, ids binary, text binary, anchors binary", "chunk", "bucket", n_buckets, True)
    parts, found = C.deal(pieces.groupBy("bucket"), opened(scan_bucket(length, groups)), PARTS, "bucket", "chunk", n_chunks)
    return by_chunk, parts, found


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """One row per occurrence of every repeat group: grp (a hash of its string), length, doc_id, start (in bytes).

    The groups are the left-diverse intervals of the pieces' suffixes with their
    copies, of at least ``length`` bytes and at most a piece's; a longer repeat is a chain
    of groups.  Pieces whose anchor stands in one document only are in none,
    nor are pieces that occur once.  Of a hot anchor, each repeated window of ``length``
    bytes is a group.  Null and empty texts have no occurrence; null ids come
    back as null; rows with the same id are texts of their own; other
    columns are ignored; an empty table gives no rows.
    """
    by_chunk, parts, found = _scanned(docs, id_col, text, length, True)
    placed = by_chunk.cogroup(parts.groupBy("chunk")).applyInArrow(found(place_pass(length), True), OCCURRENCES)
    # a piece that occurs once is an interval of its own
    counts = placed.groupBy("grp", "length").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return placed.join(counts, ["grp", "length"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes if a string of ``length`` bytes that covers it also starts in a
    document with a smaller id; ``spans`` holds the maximal removed runs as int64
    pairs (from, to).  A null text counts as empty; texts shorter than
    ``length`` keep all; texts of any length are read whole; a null id counts as
    larger than any other and comes back as null; rows with the same id don't
    remove from each other; repeats inside one document stay; other columns are
    ignored.  An empty table gives an empty result.  Strings are told apart by
    64-bit hashes where whole pieces or hot windows are equal, by bytes else.
    """
    by_chunk, parts, found = _scanned(docs, id_col, text, length, False)
    return by_chunk.cogroup(parts.groupBy("chunk")).applyInArrow(found(cover_pass(length), True), RESULT)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of `documents` that repeat 50 bytes of a document with a smaller id, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
