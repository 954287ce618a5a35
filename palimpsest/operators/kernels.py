"""Array kernels: keys, hashes, boundaries and fragments of whole versions, in Arrow batches.

A version travels as one array of tokens; what leaves a kernel are keys, counts
or boundaries, never a row per token.  Each kernel works on all versions of a
batch at once, and its memory is that of the batch.
"""

from __future__ import annotations

try:
    from _md5 import md5  # half the time of OpenSSL's on texts of an n-gram's length
except ImportError:
    from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions.hashing import MASK, NGRAM, WORD_MULTIPLIER, nested_weights

#: Values of lists that a kernel takes at once; one version may hold more.
BATCH_VALUES = 1 << 19
#: Distinct terms whose hash a worker remembers.
CACHE_TERMS = 500_000
_bytes: dict[str, int] = {}


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of size[i] each, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - begin, size)


def lists(col: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(values, offsets from 0) of a list column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offs = col.offsets.to_numpy().astype(np.int64)
    return col.values.slice(int(offs[0]), int(offs[-1] - offs[0])), offs - offs[0]


def to_lists(values, offs: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


class Joined:
    """Tokens of a batch joined by single spaces: raw bytes, and each token's place in them."""

    def __init__(self, col: pa.ListArray):
        values, self.offs = lists(col)
        size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        text = pc.binary_join(to_lists(values, self.offs, pa.string()), " ").cast(pa.large_binary())
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        self.text = text
        self.raw = (text.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        before = np.concatenate([[0], np.cumsum(size + 1)])
        version = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))
        self.start = before[:-1] - before[self.offs[:-1]][version] + at[:-1][version]
        self.end = self.start + size
        self.text_at = at

    def digest(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """MD5 of tokens first[i] to last[i], both included."""
        raw = self.raw
        return [md5(raw[a:b]).digest() for a, b in zip(self.start[first].tolist(), self.end[last].tolist(), strict=True)]


def collection_keys(j: Joined) -> pa.Array:
    """Per version the smallest MD5 of its n-grams, or that of all tokens if there are too few, in hex."""
    out = []
    for i, (a, b) in enumerate(zip(j.offs[:-1].tolist(), j.offs[1:].tolist(), strict=True)):
        if b - a < NGRAM:
            out.append(md5(j.raw[j.text_at[i] : j.text_at[i + 1]]).hexdigest())
        else:
            raw = j.raw
            out.append(min(md5(raw[s:e]).digest() for s, e in zip(j.start[a : b - NGRAM + 1].tolist(), j.end[a + NGRAM - 1 : b].tolist(), strict=True)).hex())
    return pa.array(out, pa.string())


def term_bytes(values: pa.Array) -> np.ndarray:
    """One-byte word hash of each token."""
    if not len(values):
        return np.zeros(0, np.int64)
    coded = values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    if len(_bytes) > CACHE_TERMS:
        _bytes.clear()
    new = [w for w in words if w not in _bytes]
    k = np.array([int.from_bytes(md5(w.encode()).digest()[:4], "big") for w in new], np.uint64)
    mask = np.uint64(MASK)
    k ^= k >> np.uint64(15)
    k = (mask - k + (k << np.uint64(6))) & mask
    k ^= k >> np.uint64(4)
    k = (k * np.uint64(WORD_MULTIPLIER)) & mask
    k ^= k >> np.uint64(16)
    _bytes.update(zip(new, (k >> np.uint64(24)).tolist(), strict=True))
    return np.array([_bytes[w] for w in words], np.int64)[coded.indices.to_numpy()]


def word_ids(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, place of each token's id among them): the distinct 32-bit word ids (``corpus.word_id``), ascending."""
    coded = values.dictionary_encode()
    own = np.frombuffer(b"".join(md5(w.encode()).digest()[:4] for w in coded.dictionary.to_pylist()), ">u4").astype(np.int64)
    ids, place = np.unique(own, return_inverse=True)
    return ids, place[coded.indices.to_numpy()] if len(values) else np.zeros(0, np.int64)


def rolling(b: np.ndarray) -> np.ndarray:
    """The rolling hash of every n-gram of word hashes."""
    m = max(0, len(b) - NGRAM + 1)
    h = np.zeros(m, np.int64)
    for level, row in enumerate(nested_weights()):
        s = np.zeros(m, np.int64)
        for k, c in enumerate(row):
            s += c * b[k : k + m]
        h |= (s & 255) << (8 * level)
    return h


def gram_hashes(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the rolling n-gram hash of each version longer than n."""
    values, offs = lists(col)
    h = rolling(term_bytes(values))
    n = np.diff(offs)
    size = np.where(n > NGRAM, n - NGRAM + 1, 0)
    return h[ranges(offs[:-1], size)], np.concatenate([[0], np.cumsum(size)])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values that follow each other."""
    if len(x) < w:
        return x[:0]
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == w else np.minimum(m[: len(x) - w + 1], m[w - have :])


def winnowed(h: np.ndarray, offs: np.ndarray, lengths: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries, offsets): 0 and the rightmost minimum of each full window of w from position 1 on; none for empty versions."""
    top = (1 << 31) - 1
    least = sliding_min((h << 31) | (top - np.arange(len(h))), w)
    size = np.maximum(np.diff(offs) - w, 0)
    place = top - (least[ranges(offs[:-1] + 1, size)] & top)
    version = np.repeat(np.arange(len(size)), size)
    # places of one version ascend
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (version[1:] != version[:-1])]) if len(place) else np.zeros(0, bool)
    place, version = place[new], version[new]
    place -= offs[:-1][version]
    full = np.flatnonzero(lengths > 0)
    order = np.argsort(np.concatenate([full, version]), kind="stable")
    count = np.bincount(version, minlength=len(lengths)) + (lengths > 0)
    return np.concatenate([np.zeros(len(full), np.int64), place])[order], np.concatenate([[0], np.cumsum(count)])


def bounded(batch: pa.RecordBatch):
    """The batch in slices of at most BATCH_VALUES values in any list column, a row at least."""
    sizes = [np.diff(lists(c)[1]) for c in batch.columns if pa.types.is_list(c.type)]
    if not sizes or not batch.num_rows:
        yield from [batch] * (batch.num_rows > 0)
        return
    ends = np.cumsum(np.max(sizes, axis=0))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + BATCH_VALUES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def whole_groups(batches, most: int):
    """Tables of whole groups of rows (equal first columns, side by side) with up to ``most`` in the column n, a group at least."""
    rest, total = [], 0

    def cut(last: bool):
        nonlocal rest, total
        table = pa.Table.from_batches(rest).combine_chunks()
        code = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0, [True]]))
        before = np.concatenate([[0], np.cumsum(table.column("n").to_numpy().astype(np.int64))])[heads]
        k, stop = 0, len(heads) - 1 - (not last)
        while k < stop:
            to = min(stop, max(k + 1, int(np.searchsorted(before, before[k] + most, side="right")) - 1))
            yield table.slice(int(heads[k]), int(heads[to] - heads[k]))
            k = to
        rest = table.slice(int(heads[k])).to_batches()
        total = int(before[-1] - before[k])

    for batch in batches:
        if batch.num_rows:
            rest.append(batch)
            total += int(pc.sum(batch.column("n")).as_py() or 0)
            if total >= most:
                yield from cut(False)
    if rest:
        yield from cut(True)


def _passed(arrays: DataFrame, keys, body, add: str, columns=("toks",)) -> DataFrame:
    """keys, and what body(column, ...) adds, a list of Arrow arrays; a map over the versions."""
    src = arrays.select(*keys, *columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name in keys)
    names = [*keys, *(f.name for f in StructType.fromDDL(add))]

    def run(batches):
        for batch in batches:
            for part in bounded(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *body(*part.columns[len(keys) :])], names=names)

    return src.mapInArrow(run, f"{kinds}, {add}")


def with_trials(arrays: DataFrame, windows, *keys: str) -> DataFrame:
    """keys, toks, totals, frags: the blocks of each version at every window, and what each window costs it alone.

    frags: array of (w, start, len, size, hash), the last the MD5 of the tokens as bytes; size is how often the version
    holds the fragment, told at its first place only and 0 at all others.
    totals: array of (w, n_apps, n_frags, n_postings).
    """

    def body(toks):
        h, at = gram_hashes(toks)
        j = Joined(toks)
        n = np.diff(j.offs)
        parts, totals = [], []
        for w in windows:
            start, offs = winnowed(h, at, n, w)
            version = np.repeat(np.arange(len(n)), np.diff(offs))
            last = np.append(version[1:] != version[:-1], True) if len(version) else np.zeros(0, bool)
            end = np.append(start[1:], 0)[: len(start)]
            end[last] = n[version[last]]
            base = j.offs[:-1][version]
            digests = j.digest(base + start, base + end - 1)
            size, first = np.zeros(len(start), np.int64), {}
            for i, key in enumerate(zip(version.tolist(), digests, strict=True)):
                size[first.setdefault(key, i)] += 1
            sums = [np.bincount(version, x, len(n)).astype(np.int64) for x in (size, size > 0, (end - start) * (size > 0))]
            totals.append(np.stack([np.full(len(n), w), *sums], 1))
            parts.append((version, np.full(len(start), float(w)), start, end - start, size, digests))
        version, w, start, size, many = (np.concatenate([p[k] for p in parts]) for k in range(5))
        order = np.argsort(version, kind="stable")
        digests = [d for p in parts for d in p[5]]
        ints = [pa.array(x[order].astype(np.int32)) for x in (start, size, many)]
        one = pa.StructArray.from_arrays([pa.array(w[order]), *ints, pa.array([digests[k] for k in order.tolist()], pa.binary())], names=["w", "start", "len", "size", "hash"])
        told = np.stack(totals, 1).reshape(-1, 4)
        cost = pa.StructArray.from_arrays([pa.array(told[:, 0].astype(float)), *(pa.array(told[:, k]) for k in (1, 2, 3))], names=["w", "n_apps", "n_frags", "n_postings"])
        return [toks, to_lists(cost, np.arange(len(n) + 1) * len(totals), None), to_lists(one, np.concatenate([[0], np.cumsum(np.bincount(version, minlength=len(n)))]), None)]

    frags = "frags array<struct<w: double, start: int, len: int, size: int, hash: binary>>"
    return _passed(arrays, keys, body, f"toks array<string>, totals array<struct<w: double, n_apps: long, n_frags: long, n_postings: long>>, {frags}")


def with_collection(arrays: DataFrame, *keys: str) -> DataFrame:
    """keys, text, collection; the text is the tokens joined by single spaces."""

    def body(toks):
        j = Joined(toks)
        return [j.text.cast(pa.large_string()).cast(pa.string()), collection_keys(j)]

    return _passed(arrays, keys, body, "text string, collection string")


def with_grams(arrays: DataFrame, *keys: str) -> DataFrame:
    """keys, len, h: the n-gram hashes of each version by position, none if it isn't longer than n."""

    def body(toks):
        h, at = gram_hashes(toks)
        return [pa.array(np.diff(lists(toks)[1]).astype(np.int32)), to_lists(h, at, pa.int64())]

    return _passed(arrays, keys, body, "len int, h array<long>")


def with_bounds(arrays: DataFrame, windows, *keys: str) -> DataFrame:
    """keys, len, and bounds{w} for each window: the winnowed boundaries."""

    def body(toks):
        h, at = gram_hashes(toks)
        n = np.diff(lists(toks)[1])
        return [pa.array(n.astype(np.int32)), *(to_lists(*winnowed(h, at, n, w), pa.int32()) for w in windows)]

    return _passed(arrays, keys, body, ", ".join(["len int", *(f"bounds{w} array<int>" for w in windows)]))


def with_tree(arrays: DataFrame, windows, *keys: str) -> DataFrame:
    """keys, and starts{k}, ends{k}, ups{k}_{p} for each level k: the blocks of a refining hierarchy, and the index of the block of each coarser level p that holds each.

    Levels are those of windows, fine to coarse; a level also cuts where a coarser one does, so a block's ancestors
    are found by its start alone.
    """
    names = [f"starts{k}" for k in range(len(windows))] + [f"ends{k}" for k in range(len(windows))]
    names += [f"ups{k}_{p}" for k in range(len(windows)) for p in range(k + 1, len(windows))]

    def body(toks):
        h, at = gram_hashes(toks)
        n = np.diff(lists(toks)[1])
        width = int(n.max(initial=0)) + 1
        levels, cut = [], np.zeros(0, np.int64)
        for w in reversed(windows):
            start, offs = winnowed(h, at, n, w)
            # places of all versions, one behind the other
            cut = np.union1d(cut, np.repeat(np.arange(len(n)), np.diff(offs)) * width + start)
            levels.insert(0, cut)
        offs = [np.searchsorted(x, np.arange(len(n) + 1) * width) for x in levels]
        starts = [to_lists((x % width).astype(np.int32), o, pa.int32()) for x, o in zip(levels, offs, strict=True)]
        ends = []
        for x, o in zip(levels, offs, strict=True):
            end = np.append(x[1:], 0)[: len(x)] % width
            filled = o[1:] > o[:-1]
            end[o[1:][filled] - 1] = n[filled]
            ends.append(to_lists(end.astype(np.int32), o, pa.int32()))
        ups = []
        for k, x in enumerate(levels):
            for p in range(k + 1, len(levels)):
                up = np.searchsorted(levels[p], x, side="right") - 1 - offs[p][x // width]
                ups.append(to_lists(up.astype(np.int32), offs[k], pa.int32()))
        return [*starts, *ends, *ups]

    return _passed(arrays, keys, body, ", ".join(f"{c} array<int>" for c in names))


def with_fragments(arrays: DataFrame, windows, *keys: str) -> DataFrame:
    """keys, frags: array of (w, idx, start, end, hash), the blocks between winnowed boundaries and the MD5 of their tokens."""

    def body(toks):
        h, at = gram_hashes(toks)
        j = Joined(toks)
        n = np.diff(j.offs)
        parts = []
        for w in windows:
            start, offs = winnowed(h, at, n, w)
            version = np.repeat(np.arange(len(n)), np.diff(offs))
            end = np.append(start[1:], 0)
            last = np.append(version[1:] != version[:-1], True) if len(version) else np.zeros(0, bool)
            end[: len(start)][last] = n[version[last]]
            end = end[: len(start)]
            base = j.offs[:-1][version]
            parts.append((version, np.full(len(start), float(w)), np.arange(len(start)) - offs[:-1][version], start, end, j.digest(base + start, base + end - 1)))
        version = np.concatenate([p[0] for p in parts])
        order = np.argsort(version, kind="stable")
        digests = [d for p in parts for d in p[5]]
        one = pa.StructArray.from_arrays(
            [pa.array(np.concatenate([p[1] for p in parts])[order]), *(pa.array(np.concatenate([p[k] for p in parts])[order].astype(np.int32)) for k in (2, 3, 4)), pa.array([digests[k].hex() for k in order.tolist()], pa.string())],
            names=["w", "idx", "start", "end", "hash"],
        )
        return [to_lists(one, np.concatenate([[0], np.cumsum(np.bincount(version, minlength=len(n)))]), None)]

    return _passed(arrays, keys, body, "frags array<struct<w: double, idx: int, start: int, end: int, hash: string>>")


def own_counts(grams: DataFrame, *keys: str) -> DataFrame:
    """keys, len, h, freq: how often each n-gram occurs in its own version."""

    def body(n, h):
        values, offs = lists(h)
        x = values.to_numpy()
        version = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        order = np.lexsort((x, version))
        new = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (version[order][1:] != version[order][:-1])]) if len(x) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        freq = np.zeros(len(x), np.int64)
        freq[order] = np.bincount(group)[group] if len(x) else 0
        return [n, h, to_lists(freq, offs, pa.int64())]

    return _passed(grams, keys, body, "len int, h array<long>, freq array<long>", ("len", "h"))


def distinct_counts(grams: DataFrame, *keys: str) -> DataFrame:
    """keys, gram, n: the distinct hashes of each version, ascending, and how often it holds them."""

    def body(h):
        values, offs = lists(h)
        x = values.to_numpy()
        version = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        order = np.lexsort((x, version))
        new = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (version[order][1:] != version[order][:-1])]) if len(x) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        ends = np.concatenate([[0], np.cumsum(np.bincount(version[order][head], minlength=len(offs) - 1))])
        return [to_lists(x[order][head], ends, pa.int64()), to_lists(np.diff(np.append(head, len(x))), ends, pa.int64())]

    return _passed(grams, keys, body, "gram array<long>, n array<long>", ("h",))


def looked_up(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, len, h, freq: of each hash in h the total beside it in the version's ascending list ``gram``."""

    def body(n, h, gram, total):
        (x, offs), (g, ends), (t, _) = lists(h), lists(gram), lists(total)
        x, g, t = x.to_numpy(), g.to_numpy(), t.to_numpy()
        freq = np.zeros(len(x), np.int64)
        for a, b, c, d in zip(offs[:-1].tolist(), offs[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b > a:
                freq[a:b] = t[c:d][np.searchsorted(g[c:d], x[a:b])]
        return [n, h, to_lists(freq, offs, pa.int64())]

    return _passed(rows, keys, body, "len int, h array<long>, freq array<long>", ("len", "h", "gram", "total"))


def with_terms(arrays: DataFrame, *keys: str) -> DataFrame:
    """keys, terms: array of (term, positions), each distinct term of a document once, its positions ascending."""

    def body(toks):
        values, offs = lists(toks)
        coded = values.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64) if len(values) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        order = np.lexsort((code, doc))
        new = np.concatenate([[True], (code[order][1:] != code[order][:-1]) | (doc[order][1:] != doc[order][:-1])]) if len(code) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        pos = (np.arange(len(code)) - offs[:-1][doc])[order] if len(code) else code
        terms = coded.dictionary.take(pa.array(code[order][head])) if len(code) else pa.array([], pa.string())
        one = pa.StructArray.from_arrays([terms, to_lists(pos.astype(np.int32), np.append(head, len(code)), pa.int32())], names=["term", "positions"])
        return [to_lists(one, np.concatenate([[0], np.cumsum(np.bincount(doc[order][head], minlength=len(offs) - 1))]) if len(code) else np.zeros(len(offs), np.int64), None)]

    return _passed(arrays, keys, body, "terms array<struct<term: string, positions: array<int>>>")


def packed_postings(arrays: DataFrame, doc: str, block_docs: int) -> DataFrame:
    """term, block, n_docs, packed: of each slice of documents, its lists; a term and block may come from several slices.

    A posting is one number: the document's place in its block of so many, times 2**32, and the position.
    """
    src = arrays.select(F.col(doc).cast("long").alias("docid"), "toks")

    def run(batches):
        for part in (p for b in batches for p in bounded(b)):
            values, offs = lists(part.column("toks"))
            if not len(values):
                continue
            docs = part.column("docid")
            docid = docs.fill_null(0).to_numpy()
            blocks = pc.if_else(docs.is_null(), pa.scalar(None, pa.int64()), pa.array(docid // block_docs))
            coded, place = values.dictionary_encode(), blocks.dictionary_encode(null_encoding="encode")
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
            code = coded.indices.to_numpy().astype(np.int64)
            group = code * len(place.dictionary) + place.indices.to_numpy()[row]
            order = np.argsort(group, kind="stable")
            new = np.diff(group[order], prepend=-1) != 0
            head, doc_row = np.flatnonzero(new), row[order]
            n_docs = np.add.reduceat((new | (np.diff(doc_row, prepend=-1) != 0)).astype(np.int64), head)
            packed = ((docid % block_docs << 32) - offs[:-1])[row] + np.arange(len(row))
            terms = coded.dictionary.take(pa.array(code[order[head]]))
            yield pa.RecordBatch.from_arrays([terms, blocks.take(pa.array(doc_row[head])), pa.array(n_docs), to_lists(packed[order], np.append(head, len(order)), pa.int64())], names=["term", "block", "n_docs", "packed"])

    return src.mapInArrow(run, "term string, block long, n_docs long, packed array<long>")


def by_document(index: DataFrame) -> DataFrame:
    """docid, words (pos, term): of each slice of an index, what it holds of a document; a document may come from several slices."""
    src = index.select("term", "postings")
    kinds = {f.name: f.dataType for f in src.schema["postings"].dataType.elementType}

    def run(batches):
        for part in (p for b in batches for p in bounded(b)):
            values, offs = lists(part.column("postings"))
            if not len(values):
                continue
            docs = values.field(0).dictionary_encode(null_encoding="encode")
            code = docs.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            head = np.flatnonzero(np.diff(code[order], prepend=-1))
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[order]
            one = pa.StructArray.from_arrays([values.field(1).take(pa.array(order)), part.column("term").take(pa.array(row))], names=["pos", "term"])
            yield pa.RecordBatch.from_arrays([docs.dictionary.take(pa.array(code[order[head]])), to_lists(one, np.append(head, len(order)), None)], names=["docid", "words"])

    return src.mapInArrow(run, f"docid {kinds['docid'].simpleString()}, words array<struct<pos: {kinds['pos'].simpleString()}, term: string>>")


def with_word_lists(arrays: DataFrame, *keys: str) -> DataFrame:
    """keys, terms: array of (wid, positions), each distinct word id of a document once, both ascending."""

    def body(toks):
        values, offs = lists(toks)
        ids, place = word_ids(values)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        group = doc * max(1, len(ids)) + place
        order = np.argsort(group, kind="stable")
        head = np.flatnonzero(np.diff(group[order], prepend=-1))
        pos = (np.arange(len(doc)) - offs[:-1][doc])[order]
        one = pa.StructArray.from_arrays([pa.array(ids[place[order[head]]]), to_lists(pos.astype(np.int32), np.append(head, len(doc)), pa.int32())], names=["wid", "positions"])
        return [to_lists(one, np.concatenate([[0], np.cumsum(np.bincount(doc[order[head]], minlength=len(offs) - 1))]), None)]

    return _passed(arrays, keys, body, "terms array<struct<wid: bigint, positions: array<int>>>")


def with_words(encoded: DataFrame, *keys: str) -> DataFrame:
    """keys, toks: the word ids of nested posting lists (``with_word_lists``) by position; one row holds a whole document."""

    def body(terms):
        values, offs = lists(terms)
        pos, at = lists(values.field(1))
        row = np.repeat(np.arange(len(offs) - 1), np.diff(at[offs]))
        pos = pos.to_numpy().astype(np.int64)
        order = np.argsort(row * (int(pos.max(initial=0)) + 1) + pos, kind="stable")
        return [to_lists(np.repeat(values.field(0).to_numpy(), np.diff(at))[order], at[offs], pa.int64())]

    return _passed(encoded, keys, body, "toks array<bigint>", ("terms",))


def copied_runs(toks: pa.ListArray, reference: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, rstart, vstart, len): the maximal runs of at least n tokens that each version copies from its reference.

    Each n-gram of the version meets the first equal one of the reference; hits on one diagonal that follow each other join.
    """
    (mine, offs), (theirs, at) = lists(toks), lists(reference)
    coded = pa.concat_arrays([mine, theirs]).dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    gram = word
    for k in range(1, n):
        # numbers of what is equal, one token longer each time
        m = max(0, len(word) - k)
        gram = np.unique(gram[:m] * max(1, len(coded.dictionary)) + word[k:], return_inverse=True)[1]
    many = int(gram.max()) + 1 if len(gram) else 1

    def grams(offs, before):
        size = np.maximum(np.diff(offs) - n + 1, 0)
        row = np.repeat(np.arange(len(size)), size)
        place = ranges(offs[:-1], size)
        return row, place - offs[:-1][row], row * many + gram[place + before]

    row, pos, key = grams(offs, 0)
    _, rpos, rkey = grams(at, len(mine))
    known, first = np.unique(rkey, return_index=True)  # places of a reference ascend
    where = np.searchsorted(known, key)
    hit = where < len(known)
    hit[hit] = known[where[hit]] == key[hit]
    row, pos, rpos = row[hit], pos[hit], rpos[first[where[hit]]]
    order = np.lexsort((pos, pos - rpos, row))
    row, pos, rpos = row[order], pos[order], rpos[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (np.diff(pos) != 1) | (np.diff(rpos) != 1)]) if len(pos) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(pos))) + n - 1
    return np.concatenate([[0], np.cumsum(np.bincount(row[heads], minlength=len(offs) - 1))]), rpos[heads], pos[heads], size


def with_copies(pairs: DataFrame, n: int, *keys: str) -> DataFrame:
    """keys, copies: array of (rstart, vstart, len), see copied_runs; pairs: keys, toks, reference."""

    def body(toks, reference):
        at, *cols = copied_runs(toks, reference, n)
        return [to_lists(pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in cols], names=["rstart", "vstart", "len"]), at, None)]

    return _passed(pairs, keys, body, "copies array<struct<rstart: int, vstart: int, len: int>>", ("toks", "reference"))
