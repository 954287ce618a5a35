"""Vector code compression: product codebooks learned by Lloyd rounds over partition-local heaps.

A vector is cut into ``parts`` pieces, each with a codebook of ``entries``.  All
numbers are integers, so sums don't depend on their order and every result is
exact.

**Heap Lloyd.**  A chunk of vectors keeps, per codebook entry, a heap of the
pieces assigned to it, keyed by slack: the lower bound of the distance to any
other entry minus the upper bound of the distance to its own.  When entries
move, an entry's drift grows by its own step plus the greatest step of another
one of its codebook; it is added up over the rounds, and keys are stored with the
drift of their time added.  Only the pieces at the top of a heap whose key
isn't above the entry's drift can have another nearest entry: they are popped,
measured against all entries exactly, and pushed again.  All others aren't
touched.  Keys are fixed-point integers, rounded so that a bound is never too
favourable; a tie has no slack, so it is always measured.

**Rounds.**  A round is one map over the chunks: a table in the shared folder
holds each chunk's vectors, assignments and heaps, the next round reads it and
writes the next one, which cuts the lineage, and the older one is deleted.  A
chunk returns what its moved pieces change in the sums of the entries; these are
added up in Spark, and parts * entries * (1 + piece length) numbers reach
the driver, whatever the table holds.  Nothing is shuffled but these sums and, at the end,
sums per chunk and label.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import scratch as _scratch
from palimpsest.llm import _chunks as C

SCALE = 4096
#: Vectors of a chunk.
CHUNK = 1 << 15
#: Fixed point of slack and drift.
POINT = 1 << 10
SLOT = 1 << 20
#: Numbers up to this size keep squared distances of a vector inside 64 bits.
LIMIT = 1 << 27

STATE = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("data", pa.binary()), ("assign", pa.binary()), ("heaps", pa.binary()), ("sums", pa.list_(pa.int64())), ("scanned", pa.int64())])
STATE_DDL = "chunk long, n int, ids binary, labels binary, data binary, assign binary, heaps binary, sums array<bigint>, scanned long"


def quantised(values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their integers): vectors of ``dim`` finite components, floor(SCALE * x)."""
    size = np.diff(values.offsets.to_numpy()) if not isinstance(values, pa.FixedSizeListArray) else np.full(len(values), values.type.list_size)
    right = (size == dim) & values.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(right)
    flat = values.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    fine = np.isfinite(x).all(axis=1)
    scaled = np.floor(x[fine] * float(SCALE))
    if scaled.size and np.abs(scaled).max() > LIMIT:
        raise ValueError(f"components beyond {LIMIT // SCALE} overflow 64-bit squared distances")
    return rows[fine], scaled.astype(np.int64)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of pieces (n, d) to entries (k, d), exact integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    if 4 * x.shape[1] * most * most < 1 << 53:
        # sums below 2**53: floating point is exact
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(book)), np.int64)
    for e, row in enumerate(book):
        out[:, e] = ((x - row) ** 2).sum(axis=1)
    return out


def nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, slack in fixed point rounded down) of each row of squared distances; ties to the lower entry."""
    best = d.argmin(axis=1)
    at = np.arange(len(d))
    own = d[at, best]
    if d.shape[1] == 1:
        return best, np.full(len(d), (1 << 42) - 1)
    rest = d.copy()
    rest[at, best] = np.iinfo(np.int64).max
    slack = (np.sqrt(rest.min(axis=1).astype(np.float64)) - np.sqrt(own.astype(np.float64))) * POINT
    return best, np.floor(slack).astype(np.int64) - 2


def drift_of(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What a round adds to each entry's drift, rounded up: its own step and the greatest step of another entry."""
    step = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64))
    other = np.zeros(len(step))
    if len(step) > 1:
        order = np.argsort(step)
        other[:] = step[order[-1]]
        other[order[-1]] = step[order[-2]]
    moved = (step + other) * POINT
    return np.where(moved > 0, np.ceil(moved) + 2, 0).astype(np.int64)


class Heaps:
    """Per part and entry, a heap of key * SLOT + piece."""

    def __init__(self, parts: int, entries: int):
        self.heaps: list[list[list[int]]] = [[[] for _ in range(entries)] for _ in range(parts)]

    @classmethod
    def load(cls, raw: bytes, parts: int, entries: int) -> Heaps:
        out = cls(parts, entries)
        head = 8 * parts * entries
        sizes = np.frombuffer(raw[:head], np.int64)
        items = np.frombuffer(raw[head:], np.int64)
        ends = np.cumsum(sizes)
        for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            out.heaps[k // entries][k % entries] = items[a:b].tolist()
        return out

    def dump(self) -> bytes:
        flat = [h for part in self.heaps for h in part]
        return np.array([len(h) for h in flat], np.int64).tobytes() + b"".join(np.array(h, np.int64).tobytes() for h in flat)

    def violated(self, part: int, drift: np.ndarray) -> np.ndarray:
        """Pop the pieces whose slack the drift has used up."""
        out = []
        for heap, used in zip(self.heaps[part], drift.tolist(), strict=True):
            bound = (used + 1) * SLOT
            while heap and heap[0] < bound:
                out.append(heapq.heappop(heap) % SLOT)
        return np.array(out, np.int64)

    def push(self, part: int, pieces: np.ndarray, entry: np.ndarray, slack: np.ndarray, drift: np.ndarray) -> None:
        items = (slack + drift[entry]) * SLOT + pieces
        for e in np.unique(entry).tolist():
            heap, new = self.heaps[part][e], items[entry == e].tolist()
            if len(new) * 4 > len(heap):
                heap += new
                heapq.heapify(heap)
            else:
                for item in new:
                    heapq.heappush(heap, item)


def _load(table_row) -> tuple[np.ndarray, zstandard.ZstdDecompressor]:
    z = zstandard.ZstdDecompressor()
    n = table_row["n"]
    return np.frombuffer(z.decompress(table_row["data"]), np.int32).reshape(n, -1).astype(np.int64), z


def _chunked(dim: int):
    """Input batches to chunks of quantised vectors, without assignments."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        task, made = TaskContext.get().partitionId(), 0
        ids, labels, data, n = [], [], [], 0

        def out():
            nonlocal made, n
            have = np.concatenate([x[0] for x in ids]), np.concatenate([x[1] for x in ids])
            label = np.concatenate([x[0] for x in labels]), np.concatenate([x[1] for x in labels])
            row = {"chunk": (task << 32) | made, "n": n, "ids": z.compress(have[0].tobytes() + have[1].tobytes()), "labels": z.compress(label[0].tobytes() + label[1].tobytes()), "data": z.compress(np.concatenate(data).astype(np.int32).tobytes()), "assign": b"", "heaps": b"", "sums": [], "scanned": 0}
            made, n = made + 1, 0
            ids.clear(), labels.clear(), data.clear()
            return pa.RecordBatch.from_pylist([row], STATE)

        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                rows, x = quantised(part.column(2), dim)
                for col, to in ((part.column(0), ids), (part.column(1), labels)):
                    own = col.take(pa.array(rows))
                    to.append((own.fill_null(0).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False)))
                data.append(x)
                n += len(x)
                if n >= CHUNK:
                    yield out()
        if n:
            yield out()

    return run


def _round(books: np.ndarray, drift: np.ndarray):
    """One round: pieces without slack are measured and moved; first of all, every piece."""
    parts, entries, width = books.shape

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                x, unz = _load(row)
                x = x.reshape(len(x), parts, width)
                sums = np.zeros((parts, entries, 1 + width), np.int64)
                if row["heaps"]:
                    heaps = Heaps.load(unz.decompress(row["heaps"]), parts, entries)
                    assign = np.frombuffer(unz.decompress(row["assign"]), np.int32).reshape(parts, -1).copy()
                else:
                    heaps, assign = Heaps(parts, entries), np.full((parts, len(x)), -1, np.int32)
                scanned = 0
                for p in range(parts):
                    pieces = heaps.violated(p, drift[p]) if row["heaps"] else np.arange(len(x))
                    if not len(pieces):
                        continue
                    scanned += len(pieces)
                    own = x[pieces, p]
                    entry, slack = nearest(distances(own, books[p]))
                    heaps.push(p, pieces, entry, slack, drift[p])
                    was = assign[p, pieces]
                    moved = was != entry
                    change = np.concatenate([np.ones((int(moved.sum()), 1), np.int64), own[moved]], axis=1)
                    np.add.at(sums[p], entry[moved], change)
                    left = was[moved] >= 0
                    np.subtract.at(sums[p], was[moved][left], change[left])
                    assign[p, pieces] = entry
                row |= {"assign": z.compress(assign.tobytes()), "heaps": z.compress(heaps.dump()), "sums": sums.ravel().tolist(), "scanned": scanned}
                yield pa.RecordBatch.from_pylist([row], STATE)

    return run


def _totals(state: DataFrame, shape) -> np.ndarray:
    """Changes of all chunks, added up; as many numbers as ``shape`` says."""
    each = state.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in each.collect():
        out[r["k"]] = r["x"]
    return out.reshape(shape)


def _first_vectors(rows: DataFrame, dim: int, entries: int) -> np.ndarray:
    """The kept vectors with the smallest ids (equal ids: the smaller vector first)."""

    def keep(batches):
        for batch in batches:
            ok, x = quantised(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["id", "x"])

    got = rows.select("id", "vector").mapInArrow(keep, "id long, x array<bigint>").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    return np.array([r["x"] for r in got], np.int64).reshape(len(got), dim)


def _errors(books: np.ndarray):
    """(chunk, label, error): summed squared distances per label of a chunk."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                label, error = _labels(row), _error(row, books)
                keys: dict = {}
                for v, e in zip(label, error.tolist(), strict=True):
                    keys[v] = keys.get(v, 0) + e
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(keys), pa.int64()), pa.array(list(keys), pa.int64()), pa.array(list(keys.values()), pa.int64())], names=["chunk", "label", "error"])

    return run


def _unpacked(raw: bytes, n: int) -> list:
    values, valid = np.frombuffer(raw[: 8 * n], np.int64), np.frombuffer(raw[8 * n :], bool)
    return [v if ok else None for v, ok in zip(values.tolist(), valid.tolist(), strict=True)]


def _labels(row) -> list:
    return _unpacked(zstandard.ZstdDecompressor().decompress(row["labels"]), row["n"])


def _error(row, books: np.ndarray) -> np.ndarray:
    parts, _, width = books.shape
    x, unz = _load(row)
    assign = np.frombuffer(unz.decompress(row["assign"]), np.int32).reshape(parts, -1)
    error = np.zeros(len(x), np.int64)
    for p in range(parts):
        error += ((x[:, p * width : (p + 1) * width] - books[p][assign[p]]) ** 2).sum(axis=1)
    return error


def _coded(books: np.ndarray, digest: str):
    def run(state: pa.Table, totals: pa.Table) -> pa.Table:
        names = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
        out: dict = {n: [] for n in names}
        whole = dict(zip(totals.column("label").to_pylist(), totals.column("total").to_pylist(), strict=True))
        for row in state.to_pylist():
            unz = zstandard.ZstdDecompressor()
            assign = np.frombuffer(unz.decompress(row["assign"]), np.int32).reshape(len(books), -1)
            digits = [f"{e:02x}" for e in range(books.shape[1])]
            out["vec_id"] += _unpacked(unz.decompress(row["ids"]), row["n"])
            out["code"] += ["".join(digits[e] for e in col) for col in assign.T.tolist()]
            out["error"] += _error(row, books).tolist()
            out["label_error"] += [whole[v] for v in _labels(row)]
            out["codebooks_sha256"] += [digest] * row["n"]
        return pa.table({n: pa.array(out[n], pa.string() if n in ("code", "codebooks_sha256") else pa.int64()) for n in names})

    return run


def learn(rows: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> tuple[np.ndarray, DataFrame, list[int]]:
    """(codebooks, state table after the last assignment, pieces measured in each round)."""
    books = _first_vectors(rows, dim, entries)
    entries, width = len(books), dim // parts
    books = np.ascontiguousarray(books.reshape(entries, parts, width).transpose(1, 0, 2))
    drift = np.zeros((parts, entries), np.int64)
    sums = np.zeros((parts, entries, 1 + width), np.int64)
    state = _scratch.table(rows.mapInArrow(C.settled(_chunked(dim)), STATE_DDL), "vectors")
    scanned = []
    for k in range(rounds + 1):
        then = _scratch.table(state.mapInArrow(C.settled(_round(books, drift)), STATE_DDL), "lloyd")
        _scratch.drop(state)
        state = then
        scanned.append(int(state.agg(F.sum("scanned")).first()[0] or 0))
        if k == rounds:
            break
        sums += _totals(state, sums.shape)
        count = sums[:, :, :1]
        new = np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)
        drift = drift + np.stack([drift_of(a, b) for a, b in zip(books, new, strict=True)])
        books = new
    return books, state, scanned


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    A vector that is null, or holds a null or non-finite component, is left out.
    Vectors have the length of the one with the smallest id among those that have
    ``parts`` equal parts; others are left out too, as are empty ones.  With fewer than ``entries``
    vectors a codebook has as many entries as there are.  Rows with
    equal ids get a row each (the smaller vector first, where the first ids make the
    codebook); a null id counts as larger than any other and comes back as null;
    a null label is a label of its own.  Equal vectors have equal codes.  Other
    columns are ignored; an empty table gives an empty result.  Components of 2**15 or more in
    magnitude raise an error, since squared distances could leave 64 bits.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    finite = f"size(vector) > 0 and size(vector) % {parts} = 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    first = rows.where("vector is not null").where(finite).orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector").alias("d")).limit(1).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books, state, _ = learn(rows, first[0]["d"], parts, entries, rounds)
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    each = _scratch.table(state.mapInArrow(C.settled(_errors(books)), "chunk long, label long, error long"), "label-errors")
    totals = each.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("total"))
    # one row per chunk and label: a label of many vectors is no hot key
    back = each.select("chunk", "label").join(totals, F.col("label").eqNullSafe(F.col("of"))).select("chunk", "label", "total")
    done = state.select("chunk", "n", "ids", "labels", "data", "assign").groupBy("chunk").cogroup(back.groupBy("chunk"))
    return done.applyInArrow(_coded(books, digest), "vec_id long, code string, error long, label_error long, codebooks_sha256 string")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Product codes of all `embeddings`: 8 parts, 16 entries, 6 rounds."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds, unrolled."""

    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT q.id, q.p, b.e, list_sum(list_transform(list_zip(q.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d
    FROM pieces q JOIN b{k} b ON q.p = b.p) GROUP BY id, p)"""

    steps = []
    for k in range(rounds + 1):
        steps.append(assigned(k))
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, CASE WHEN n.v IS NULL THEN b.v ELSE n.v END AS v FROM b{k} b LEFT JOIN (
    SELECT p, e, list(CAST(floor(s::DOUBLE / c) AS BIGINT) ORDER BY j) AS v FROM (
      SELECT a.p, a.e, j, sum(q.v[j]) AS s, count(*) AS c FROM a{k} a JOIN pieces q ON a.id = q.id AND a.p = q.p, range(1, len(q.v) + 1) r(j) GROUP BY ALL)
    GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT p, e, v FROM pieces JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM kept) USING (id) WHERE e < {entries}),
{", ".join(steps)},
book AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e)) AS h FROM (SELECT p, e, array_to_string(v, ',') AS x FROM b{rounds})),
coded AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (id), book
"""


OP12_SQL = _sql()
