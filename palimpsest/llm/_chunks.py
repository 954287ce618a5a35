"""Document chunks: the unit in which repeat detection reads the corpus.

Rows are dealt to chunks by a hash of id and text (repeated rows on from there), about CHUNK_BYTES of text
each, and packed into compressed blobs before the shuffle.  The number of
chunks grows with the corpus, so a chunk's memory does not.  The packed
exchange is the same plan in every pass, so Spark writes it once and reuses it.

Chunks and buckets of hashes both grow with the corpus, so a blob from each chunk
to each bucket would shrink to nothing.  ``deal`` bounds the fan-out: with more
than ``FAN`` receivers, a sender writes one frame per range of sqrt(``FAN``) receivers, and
a relay task takes the frames of as many senders for one range and writes one frame per
receiver.  A frame holds many blobs, however large the corpus is, and a relay at most ``FAN`` of
the blobs that senders have for single receivers, so its memory doesn't grow with the corpus.
"""

from __future__ import annotations

import contextlib
import ctypes
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._text import mix
from palimpsest.session import share_seed

CHUNK_BYTES = 4 << 20
#: Rows that repeat id and text and go to one chunk together.
SAME = 32
BUCKET_BYTES = 6 << 20
NULL_ID = np.iinfo(np.int64).max

PACKED = pa.schema([("chunk", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("lens", pa.binary()), ("text", pa.binary())])


def corpus_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of text in the whole table (one scan, one number)."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0)


def sizes(total: int, chunk_bytes: int = CHUNK_BYTES) -> tuple[int, int]:
    """(number of chunks, number of hash buckets) for so many bytes of text."""
    return max(16, math.ceil(total / chunk_bytes)), max(16, math.ceil(total / BUCKET_BYTES))


def pack(z: zstandard.ZstdCompressor, x) -> bytes:
    return z.compress(x.tobytes() if isinstance(x, np.ndarray) else x)


def repeats(key: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """How often each key came before, in these and in earlier batches; ``seen`` is kept up."""
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    size = np.diff(np.append(head, len(key)))
    own = key[order][head].tolist()
    before = np.array([seen.get(k, 0) for k in own], np.int64)
    seen.update(zip(own, (before + size).tolist(), strict=True))
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(head, size) + np.repeat(before, size)
    return out


def packed(docs: DataFrame, id_col: str, text: str, n_chunks: int, by_id: bool = False) -> DataFrame:
    """Rows (chunk, n, ids, lens, text) hash-partitioned by chunk.

    A null id becomes NULL_ID, a null text the empty text.  by_id: the chunk is
    that of the id alone, so other tables can meet their documents by chunk; rows of a null id,
    whom no table can name, are dealt by their text.

    Rows that repeat id and text would all be of one chunk: those after the first
    in a task are dealt on, ``SAME`` at a time, by their number and the task's.  They
    can't be told from each other, so a task that runs again sends every chunk the same.
    """
    share_seed(docs.sparkSession)
    both = F.xxhash64(F.col(id_col), F.col(text))
    by_own = F.xxhash64(F.col(id_col).cast("long"))
    rows = docs.select(
        (F.when(F.col(id_col).isNotNull(), by_own).otherwise(both) if by_id else both).alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )

    def deal(batches):
        z = zstandard.ZstdCompressor(level=3)
        seen, task = {}, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            chunk = np.mod(key, n_chunks)
            # a null id of op6 isn't repeated by its key alone, but is dealt on alike
            again = repeats(key, seen) if not by_id else np.where(batch.column(1).to_numpy(zero_copy_only=False) == NULL_ID, repeats(key, seen), 0)
            late = np.flatnonzero(again)
            chunk[late] = np.mod(mix(mix(key[late].view(np.uint64)) + (again[late] // SAME + (task << 24)).astype(np.uint64)).view(np.int64), n_chunks)
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order])) + 1
            for part in np.split(order, cuts):
                own = batch.column(2).cast(pa.large_binary()).take(pa.array(part))
                ids = batch.column(1).to_numpy(zero_copy_only=False)[part]
                offs = np.frombuffer(own.buffers()[1], np.int64)[: len(part) + 1]
                data = own.buffers()[2]
                raw = memoryview(data)[offs[0] : offs[-1]] if data is not None else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(chunk[part[0]])], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([pack(z, ids)]), pa.array([pack(z, np.diff(offs))]), pa.array([z.compress(raw)])],
                    schema=PACKED,
                )

    return rows.mapInArrow(settled(deal), "chunk int, n int, ids binary, lens binary, text binary").repartition("chunk")


def settle() -> None:
    """Give freed memory back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settled(run):
    """A map over batches that gives its memory back when its task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            settle()

    return whole


def unpack(table: pa.Table):
    """(ids, large_binary texts) of one chunk, ordered by id, then text."""
    settle()
    z = zstandard.ZstdDecompressor()
    ids, parts = [], []
    for n, i, lens, text in zip(*(table.column(c).to_pylist() for c in ("n", "ids", "lens", "text")), strict=True):
        ids.append(np.frombuffer(z.decompress(i), np.int64))
        offs = np.zeros(n + 1, np.int64)
        np.cumsum(np.frombuffer(z.decompress(lens), np.int64), out=offs[1:])
        raw = z.decompress(text) if offs[-1] else b""
        parts.append(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(raw)]))
    if not ids:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    ids, texts = np.concatenate(ids), pa.concat_arrays(parts)
    # the order of shuffled rows may change when a task runs again: fix it
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], texts[k].as_py())))
    return ids[order], texts.take(pa.array(order))


def by_bucket(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of each 64-bit hash, ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of n[i] each, one after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def cut_by(keys: np.ndarray):
    """(key, slice) of each run of equal values in a sorted array."""
    if len(keys):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(keys[a]), slice(int(a), int(b))


#: Receivers that a task writes to directly.
FAN = 4096
FRAMES = pa.schema([("outer", pa.int32()), ("inner", pa.int32()), ("frame", pa.binary())])


def _frame(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(f).read_all() for f in table.column("frame").to_pylist()])


def _sorted_runs(table: pa.Table, keys: np.ndarray):
    """(key, rows) of each distinct key."""
    order = np.argsort(keys, kind="stable")
    table = table.take(pa.array(order))
    for k, s in cut_by(keys[order]):
        yield k, table.slice(s.start, s.stop - s.start)


def deal(grouped, kernel, schema: str, sender: str, receiver: str, n_receivers: int, two: bool = False):
    """(rows for groupBy(receiver), how their kernel opens them): what ``kernel`` makes of groups.

    The kernel's rows carry the integer column ``receiver``; ``sender`` is the integer
    that groups its input.  two: the input is a cogroup.  The second result
    wraps the kernel that reads the rows: the table itself, or the right one of a cogroup.
    """
    if n_receivers <= FAN:
        return grouped.applyInArrow(kernel, schema), lambda f, two=False: f
    fan = max(2, math.isqrt(FAN))

    def framed(out: pa.Table, own: int) -> pa.Table:
        rows = [(own // fan, k, _frame(t)) for k, t in _sorted_runs(out, out.column(receiver).to_numpy() // fan)] if out.num_rows else []
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, FRAMES, strict=True)], schema=FRAMES)

    def one(table: pa.Table) -> pa.Table:
        return framed(kernel(table), table.column(sender)[0].as_py())

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return framed(kernel(left, right), (left if left.num_rows else right).column(sender)[0].as_py())

    def relay(table: pa.Table) -> pa.Table:
        out = _opened(table)
        rows = [(k, _frame(t)) for k, t in _sorted_runs(out, out.column(receiver).to_numpy())]
        return pa.table({receiver: pa.array([r[0] for r in rows], pa.int32()), "frame": pa.array([r[1] for r in rows], pa.binary())})

    first = grouped.applyInArrow(both if two else one, "outer int, inner int, frame binary")
    rows = first.groupBy("outer", "inner").applyInArrow(relay, f"{receiver} int, frame binary")

    def opening(f, two: bool = False):
        if two:
            return lambda left, right: f(left, _opened(right) if right.num_rows else right)
        return lambda table: f(_opened(table))

    return rows, opening
