"""Data sources for the binary file layouts that versioned collections come in.

All numbers are little-endian 32-bit integers, but for 64-bit offsets into posting
files.  Fixed layouts:

* ``corpus_files``: ``numv`` (count, then versions per document), ``word_size`` (count, then tokens
  per version), ``completeFile`` (word ids of all versions, one after the other), and, where ids are
  known, ``url.idx`` (count, then id and number of versions of each document).
* ``posting_files``: ``url.idx`` and a file per document, named by its id: per version
  the number of distinct words, then per word its id, its frequency and its positions.
* ``index_files``: ``postings.idx`` (offset, frequency and id of each word) and ``postings.dat`` (document and position of each posting).
* ``fragment_files``: ``fragments``: id, length, number of applications of each fragment, then version and offset of each application.

    layouts.register(spark)
    spark.read.format("corpus_files").load(folder)
    rows.write.format("index_files").mode("overwrite").save(folder)

A folder holds the files themselves, as other programs leave them, or parts that were
written here: each task writes a part, complete in itself, and the commit
puts the list of parts into ``_parts.json`` by one rename; a reader sees the parts of
the list only, so a failed or repeated task leaves nothing to see, and an overwrite
shows either all old or all new parts.  Parts are read by several tasks each:
tasks take ranges of documents or words, whose place in the files is known from the
side files, which are streamed in pieces of bounded size and never held whole.

Unsigned numbers beyond 2**31 in word ids are read and written as such.  Paths may be
local or any URI that pyarrow.fs knows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from palimpsest.operators.kernels import bounded, lists, ranges, to_lists

PARTS = "_parts.json"
#: Bytes of a side file that are read at a time, and what a reading task is meant to hold.
PIECE = 1 << 22
RANGE_BYTES = 32 << 20
LEXICON = np.dtype([("offset", "<i8"), ("freq", "<i4"), ("wid", "<u4")])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def _exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def _size(fs: pafs.FileSystem, path: str) -> int:
    return fs.get_file_info(path).size


def _numbers(fs: pafs.FileSystem, path: str, kind, start: int = 0, n: int | None = None) -> np.ndarray:
    """n numbers of a file from byte ``start`` on."""
    with fs.open_input_file(path) as f:
        f.seek(start)
        return np.frombuffer(f.read(None if n is None else n * np.dtype(kind).itemsize), kind)


def _pieces(fs: pafs.FileSystem, path: str, kind, start: int):
    """(index of its first number, numbers) of bounded pieces of a file."""
    step = max(1, PIECE // np.dtype(kind).itemsize)
    with fs.open_input_file(path) as f:
        f.seek(start)
        at = 0
        while raw := f.read(step * np.dtype(kind).itemsize):
            x = np.frombuffer(raw, kind)
            yield at, x
            at += len(x)


def parts_of(fs: pafs.FileSystem, folder: str) -> list[str]:
    """The parts of a folder, in order: those of its list, or the folder itself."""
    if _exists(fs, f"{folder}/{PARTS}"):
        with fs.open_input_file(f"{folder}/{PARTS}") as f:
            return [f"{folder}/{p}" for p in json.loads(f.read())]
    return [folder]


@dataclass
class Range(InputPartition):
    """Documents or words [first, last) of a part; what else places them."""

    part: str
    first: int
    last: int
    at: int = 0
    offset: int = 0


@dataclass
class Part(WriterCommitMessage):
    name: str
    order: tuple


class _Layout(DataSource):
    ddl = ""

    def schema(self) -> str:
        return self.ddl

    def reader(self, schema):
        return self.reads(self.options["path"])

    def writer(self, schema, overwrite):
        return self.writes(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self):
        fs, folder = _open(self.path)
        return [r for part in parts_of(fs, folder) for r in self.ranges(fs, part)] or [Range("", 0, 0)]

    def read(self, partition):
        if partition.part:
            fs, _ = _open(self.path)
            yield from self.rows(fs, partition)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator):
        fs, folder = _open(self.path)
        name = f"part-{self.job}-{uuid.uuid4().hex}"
        fs.create_dir(f"{folder}/{name}", recursive=True)
        order = None
        try:
            order = self.fill(fs, f"{folder}/{name}", iterator)
        finally:
            if order is None:  # no rows, or a failure
                fs.delete_dir(f"{folder}/{name}")
        return Part(name if order else "", order or ())

    def commit(self, messages):
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        before = [p.rsplit("/", 1)[1] for p in parts_of(fs, folder) if p != folder]
        # parts follow each other by their first row
        new = [m.name for m in sorted((m for m in messages if m and m.name), key=lambda m: m.order)]
        with fs.open_output_stream(f"{folder}/.{self.job}") as f:
            f.write(json.dumps(new if self.overwrite else before + new).encode())
        fs.move(f"{folder}/.{self.job}", f"{folder}/{PARTS}")
        for name in before if self.overwrite else []:
            fs.delete_dir(f"{folder}/{name}")

    def abort(self, messages):
        fs, folder = _open(self.path)
        for m in messages:
            if m and m.name and _exists(fs, f"{folder}/{m.name}"):
                fs.delete_dir(f"{folder}/{m.name}")


def _versions(batches, keys: tuple[str, ...]):
    """(document, version batch rows) checked to come in order of document and version."""
    last = None
    for batch in batches:
        if batch.num_rows:
            key = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            if any(b <= a for a, b in zip([last, *key] if last else key, key if last else key[1:], strict=False)):
                raise ValueError(f"rows must be sorted by {', '.join(keys)} and have no key twice; use repartitionByRange and sortWithinPartitions")
            last = key[-1]
            yield batch


class _Counted:
    """A file of a count and numbers; the count is written last."""

    def __init__(self, fs, path: str):
        self.fs, self.path, self.n = fs, path, 0
        self.body = fs.open_output_stream(path + ".body")

    def add(self, numbers: np.ndarray, items: int) -> None:
        self.body.write(np.ascontiguousarray(numbers, "<u4").tobytes())
        self.n += items

    def close(self) -> None:
        self.body.close()
        with self.fs.open_output_stream(self.path) as out, self.fs.open_input_stream(self.path + ".body") as body:
            out.write(np.array([self.n], "<u4").tobytes())
            while raw := body.read(PIECE):
                out.write(raw)
        self.fs.delete_file(self.path + ".body")


class _Catalogue:
    """numv and url.idx of documents whose versions come one after the other."""

    def __init__(self, fs, part: str, lengths: bool):
        self.ids = _Counted(fs, f"{part}/url.idx")
        self.numv = _Counted(fs, f"{part}/numv") if lengths else None
        self.doc, self.n = None, 0

    def add(self, docs: np.ndarray) -> None:
        cut = np.flatnonzero(np.diff(docs)) + 1
        for own in np.split(docs, cut):
            if self.doc is not None and own[0] != self.doc:
                self.flush()
            self.doc, self.n = int(own[0]), self.n + len(own)

    def flush(self) -> None:
        self.ids.add(np.array([self.doc, self.n]), 1)
        if self.numv:
            self.numv.add(np.array([self.n]), 1)
        self.n = 0

    def close(self) -> None:
        if self.doc is not None:
            self.flush()
        self.ids.close()
        if self.numv:
            self.numv.close()


class CorpusReader(_Reader):
    """doc, version, toks; doc is the id of url.idx, else the document's number in its part."""

    def ranges(self, fs, part):
        """Runs of documents of about RANGE_BYTES of tokens."""
        first = version = done = 0  # of the range that is open
        at_version = tokens = 0
        lengths = _pieces(fs, f"{part}/word_size", "<u4", 4)
        have = np.zeros(0, np.int64)
        doc = 0
        for doc0, numv in _pieces(fs, f"{part}/numv", "<u4", 4):
            for k, n in enumerate(numv.tolist()):
                while len(have) < n:
                    have = np.concatenate([have, next(lengths)[1].astype(np.int64)])
                own, have = int(have[:n].sum()), have[n:]
                doc = doc0 + k + 1
                tokens += own
                at_version += n
                if (tokens - done) * 4 >= RANGE_BYTES:
                    yield Range(part, first, doc, version, done)
                    first, version, done = doc, at_version, tokens
        if doc > first:
            yield Range(part, first, doc, version, done)

    def rows(self, fs, r):
        numv = _numbers(fs, f"{r.part}/numv", "<u4", 4 + 4 * r.first, r.last - r.first).astype(np.int64)
        size = _numbers(fs, f"{r.part}/word_size", "<u4", 4 + 4 * r.at, int(numv.sum())).astype(np.int64)
        ids = _numbers(fs, f"{r.part}/url.idx", "<u4", 4 + 8 * r.first, 2 * (r.last - r.first))[::2].astype(np.int64) if _exists(fs, f"{r.part}/url.idx") else np.arange(r.first, r.last)
        doc = np.repeat(ids, numv)
        version = ranges(np.zeros(len(numv), np.int64), numv)
        ends = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        with fs.open_input_file(f"{r.part}/completeFile") as f:
            while lo < len(size):
                # bounded pieces of whole versions
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE // 4, side="right")) - 1)
                f.seek(4 * (r.offset + int(ends[lo])))
                toks = np.frombuffer(f.read(4 * int(ends[hi] - ends[lo])), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi]), pa.array(version[lo:hi]), to_lists(toks, ends[lo : hi + 1] - ends[lo], pa.int64())], names=["doc", "version", "toks"])
                lo = hi


class CorpusWriter(_Writer):
    """Rows (doc, version, toks), sorted by document and version; all versions of a document in one partition."""

    def fill(self, fs, part, batches):
        first = None
        catalogue, sizes = _Catalogue(fs, part, True), _Counted(fs, f"{part}/word_size")
        with fs.open_output_stream(f"{part}/completeFile") as out:
            for batch in _versions(batches, ("doc", "version")):
                docs = batch.column(0).to_numpy()
                first = first if first is not None else (int(docs[0]),)
                values, offs = lists(batch.column(2))
                out.write(values.to_numpy().astype("<u4").tobytes())
                sizes.add(np.diff(offs), len(offs) - 1)
                catalogue.add(docs)
        catalogue.close()
        sizes.close()
        return first


class CorpusFiles(_Layout):
    """doc long, version long, toks array<long>."""

    ddl = "doc long, version long, toks array<bigint>"
    reads, writes = CorpusReader, CorpusWriter

    @classmethod
    def name(cls):
        return "corpus_files"


class PostingReader(_Reader):
    """doc, version, terms array<struct<wid, positions>>; versions without words have no terms."""

    DOCS = 1024

    def ranges(self, fs, part):
        n = (_size(fs, f"{part}/url.idx") - 4) // 8
        for a in range(0, n, self.DOCS):
            yield Range(part, a, min(n, a + self.DOCS))

    def rows(self, fs, r):
        items = _numbers(fs, f"{r.part}/url.idx", "<u4", 4 + 8 * r.first, 2 * (r.last - r.first)).reshape(-1, 2).tolist()
        held, size = [], 0
        for doc, n in items:
            held.append((doc, n, _numbers(fs, f"{r.part}/{doc}", "<u4")))
            size += len(held[-1][2])
            if size * 4 >= PIECE:
                yield self.decoded(held)
                held, size = [], 0
        if held:
            yield self.decoded(held)

    @staticmethod
    def decoded(files: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        """The versions of whole files (document, number of versions, numbers)."""
        x = np.concatenate([f for _, _, f in files])
        heads, counts, at = [], [], 0
        for _, n, f in files:
            # only the places of words are found one by one, as each depends on the list before
            own, k = memoryview(np.ascontiguousarray(f)), 0
            for _ in range(n):
                counts.append(own[k])
                k += 1
                for _ in range(own[k - 1]):
                    heads.append(at + k)
                    k += 2 + own[k + 1]
            at += len(f)
        head = np.array(heads, np.int64)
        freq = x[head + 1].astype(np.int64)
        positions = to_lists(x[ranges(head + 2, freq)].astype(np.int32), np.concatenate([[0], np.cumsum(freq)]), pa.int32())
        terms = pa.StructArray.from_arrays([pa.array(x[head].astype(np.int64)), positions], names=["wid", "positions"])
        numv = np.array([n for _, n, _ in files], np.int64)
        doc = np.repeat(np.array([d for d, _, _ in files], np.int64), numv)
        version = ranges(np.zeros(len(numv), np.int64), numv)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(version), to_lists(terms, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), None)], names=["doc", "version", "terms"])


def _encoded(terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, places): the posting lists of versions as a posting file has them, and where each version begins and ends."""
    n = terms.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    values = terms.flatten()  # without what lies behind nulls
    positions = values.field(1)
    freq = positions.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    term_at = np.concatenate([[0], np.cumsum(2 + freq)])
    # each version's count of words comes before its lists
    at = term_at[np.concatenate([[0], np.cumsum(n)])] + np.arange(len(n) + 1)
    out = np.empty(int(at[-1]), "<u4")
    out[at[:-1]] = n
    head = term_at[:-1] + np.repeat(np.arange(len(n)), n) + 1
    out[head] = values.field(0).to_numpy()
    out[head + 1] = freq
    out[ranges(head + 2, freq)] = positions.flatten().to_numpy()
    return out, at


class PostingWriter(_Writer):
    """Rows (doc, version, terms), sorted by document and version; all versions of a document in one partition."""

    def fill(self, fs, part, batches):
        first, doc, out = None, None, None
        catalogue = _Catalogue(fs, part, False)
        for batch in (b for whole in _versions(batches, ("doc", "version")) for b in bounded(whole)):
            docs = batch.column(0).to_numpy()
            catalogue.add(docs)
            numbers, at = _encoded(batch.column(2))
            first = first if first is not None else (int(docs[0]),)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(docs)) + 1, [len(docs)]])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if docs[a] != doc:
                    if out:
                        out.close()
                    doc = int(docs[a])
                    out = fs.open_output_stream(f"{part}/{doc}")
                out.write(numbers[at[a] : at[b]].tobytes())
        if out:
            out.close()
        catalogue.close()
        return first


class PostingFiles(_Layout):
    """doc long, version long, terms array<struct<wid, positions>>."""

    ddl = "doc long, version long, terms array<struct<wid: bigint, positions: array<int>>>"
    reads, writes = PostingReader, PostingWriter

    @classmethod
    def name(cls):
        return "posting_files"


class IndexReader(_Reader):
    """wid, postings array<struct<docid, pos>>; a filter on wid reads the lists of those words only."""

    def __init__(self, path):
        super().__init__(path)
        self.wanted: set[int] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("wid",):
                own = {int(f.value)} if isinstance(f, EqualTo) else {int(v) for v in f.value}
                self.wanted = own if self.wanted is None else self.wanted & own
            else:
                yield f

    def ranges(self, fs, part):
        first = held = 0
        n = 0
        for at, items in _pieces(fs, f"{part}/postings.idx", LEXICON, 0):
            for k, freq in enumerate(items["freq"].tolist()):
                held, n = held + 8 * freq, at + k + 1
                if held >= RANGE_BYTES:
                    yield Range(part, first, n)
                    first, held = n, 0
        if n > first:
            yield Range(part, first, n)

    def rows(self, fs, r):
        items = _numbers(fs, f"{r.part}/postings.idx", LEXICON, LEXICON.itemsize * r.first, r.last - r.first)
        if self.wanted is not None:
            items = items[np.isin(items["wid"], np.array(sorted(self.wanted), np.int64))]
        kind = pa.struct([("docid", pa.int64()), ("pos", pa.int64())])
        lo = 0
        with fs.open_input_file(f"{r.part}/postings.dat") as f:
            while lo < len(items):
                hi, size = lo + 1, int(items["freq"][lo])
                # lists that follow each other in the file are read at once
                while hi < len(items) and size * 8 < PIECE and items["offset"][hi] == items["offset"][lo] + 8 * size:
                    size, hi = size + int(items["freq"][hi]), hi + 1
                f.seek(int(items["offset"][lo]))
                x = np.frombuffer(f.read(8 * size), "<u4").astype(np.int64).reshape(-1, 2)
                posts = pa.StructArray.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], fields=list(kind))
                offs = np.concatenate([[0], np.cumsum(items["freq"][lo:hi].astype(np.int64))])
                yield pa.RecordBatch.from_arrays([pa.array(items["wid"][lo:hi].astype(np.int64)), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), posts)], names=["wid", "postings"])
                lo = hi


class IndexWriter(_Writer):
    """Rows (wid, postings), sorted by word; a list that is too long for one row may come in several, one after the other."""

    def fill(self, fs, part, batches):
        first, offset, open_wid, open_at, open_n = None, 0, None, 0, 0
        with fs.open_output_stream(f"{part}/postings.idx") as idx, fs.open_output_stream(f"{part}/postings.dat") as dat:

            def entry():
                idx.write(np.array([(open_at, open_n, open_wid)], LEXICON).tobytes())

            for batch in batches:
                values, offs = lists(batch.column(1))
                wids = batch.column(0).to_numpy()
                for wid, a, b in zip(wids.tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    first = first if first is not None else (wid,)
                    if wid != open_wid:
                        if open_wid is not None:
                            if wid < open_wid:
                                raise ValueError("rows must be sorted by wid")
                            entry()
                        open_wid, open_at, open_n = wid, offset, 0
                    own = values.slice(a, b - a)
                    dat.write(np.column_stack([own.field(0).to_numpy(), own.field(1).to_numpy()]).astype("<u4").tobytes())
                    offset += 8 * (b - a)
                    open_n += b - a
            if open_wid is not None:
                entry()
        return first


class IndexFiles(_Layout):
    """wid long, postings array<struct<docid, pos>>."""

    ddl = "wid long, postings array<struct<docid: bigint, pos: bigint>>"
    reads, writes = IndexReader, IndexWriter

    @classmethod
    def name(cls):
        return "index_files"


class FragmentReader(_Reader):
    """frag_id, len, apps array<struct<version, offset>>.  The file has no index, so a part is read by one task, in pieces."""

    def ranges(self, fs, part):
        if _size(fs, f"{part}/fragments"):
            yield Range(part, 0, 0)

    def rows(self, fs, r):
        kind = pa.list_(pa.struct([("version", pa.int64()), ("offset", pa.int64())]))
        held = np.zeros(0, np.int64)
        for _, x in _pieces(fs, f"{r.part}/fragments", "<u4", 0):
            held = np.concatenate([held, x.astype(np.int64)])
            at, rows = 0, []
            while at + 3 <= len(held) and at + 3 + 2 * held[at + 2] <= len(held):
                n = int(held[at + 2])
                apps = held[at + 3 : at + 3 + 2 * n].reshape(-1, 2).tolist()
                rows.append((int(held[at]), int(held[at + 1]), [{"version": v, "offset": o} for v, o in apps]))
                at += 3 + 2 * n
            held = held[at:]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], names=["frag_id", "len", "apps"])


class FragmentWriter(_Writer):
    """Rows (frag_id, len, apps) in any order."""

    def fill(self, fs, part, batches):
        first = None
        with fs.open_output_stream(f"{part}/fragments") as out:
            for batch in batches:
                for fid, n, apps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    first = first if first is not None else (fid,)
                    out.write(np.array([fid, n, len(apps), *(x for a in apps for x in (a["version"], a["offset"]))], "<u4").tobytes())
        return first


class FragmentFiles(_Layout):
    """frag_id long, len long, apps array<struct<version, offset>>."""

    ddl = "frag_id long, len long, apps array<struct<version: bigint, offset: bigint>>"
    reads, writes = FragmentReader, FragmentWriter

    @classmethod
    def name(cls):
        return "fragment_files"


def register(spark) -> None:
    """Make the formats known to the session; filters on words are pushed into index files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CorpusFiles, PostingFiles, IndexFiles, FragmentFiles):
        spark.dataSource.register(source)
