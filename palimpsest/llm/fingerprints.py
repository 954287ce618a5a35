"""SimHash fingerprints of documents, and a search for all that lie within a Hamming radius.

**Fingerprint.**  Terms are the words `[^\\x20\\x09-\\x0D]+` of a text, A-Z lower-cased.  A
term's hash is its MD5, 128 bits; its weight the number of binary digits of
its frequency in the text.  Each bit of the fingerprint is the sign of the
weighted votes of all terms: 1 where those with a 1 outweigh the others.  A
text without words has 128 zeros.

**Search.**  The bits are cut into ``BLOCKS`` blocks.  Two fingerprints that
differ in at most ``radius`` bits agree in all of some ``BLOCKS - radius`` blocks, so for
each choice of that many blocks there is a table that brings these blocks to the front: a
permuted block table, keyed by them.  Fingerprints with equal keys are
compared by XOR and popcount.  A pair is counted in the first table only in
which its blocks agree, so nothing has to be made distinct, and pairs
never leave a task: what leaves are counts and, per bucket, at most one
link per member to a member of its class there.

**Skew.**  Equal fingerprints are one row with a count, so copies cost nothing.
Buckets above ``TILE`` members are compared in tiles of ``TILE`` x ``TILE``, dealt
to tasks by themselves; that is quadratic inside one bucket, but bounded per task.

**Neighbours in order.**  The edited text of a document needs the next one.  Documents are range-partitioned
and sorted by id; each partition is streamed, and the first and last document of each partition are
written beside the results, so the two sides of a cut meet afterwards.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import scratch as _scratch
from palimpsest.llm import _chunks as C
from palimpsest.llm import _text as T
from palimpsest.llm._filters import only_wanted
from palimpsest.llm.components import components, smallest
from palimpsest.session import share_seed

BITS = 128
BLOCKS = 8
RADIUS = 6
TILE = 2048
#: Bytes of text that one range of ids is meant to hold, and the most ranges there are.
RANGE_BYTES = 8 << 20
MOST_RANGES = 32768


def fingerprints(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Fingerprints (n, BITS / 8) of a block of texts."""
    w = T.Words(buf, offs, lower=True)
    n = len(offs) - 1
    out = np.zeros((n, BITS), bool)
    if not len(w.start):
        return np.packbits(out, axis=1)
    distinct, first, term = np.unique(w.hash, return_index=True, return_inverse=True)
    raw = T.LOWER[buf].tobytes()
    digests = b"".join(hashlib.md5(raw[a:b]).digest() for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True))
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, BITS // 8), axis=1)
    key = np.repeat(np.arange(n), np.diff(w.offs)) * len(distinct) + term
    key, tf = np.unique(key, return_counts=True)
    doc, term = np.divmod(key, len(distinct))
    weight = np.floor(np.log2(tf)) + 1  # binary digits
    at = np.searchsorted(doc, np.arange(n + 1))
    for d in range(n):
        own = slice(at[d], at[d + 1])
        # exact: whole numbers far below 2**53
        out[d] = 2 * (weight[own] @ bits[term[own]].astype(np.float64)) > weight[own].sum()
    return np.packbits(out, axis=1)


def _of_texts(texts: list[str]) -> list[bytes]:
    out: list[bytes] = []
    for _, _, buf, offs in T.blocks(None, pa.array(texts, pa.large_string())):
        out += [f.tobytes() for f in fingerprints(buf, offs)]
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _result(i, text: str, print_: bytes, following: str, next_print: bytes, edited_text: str, edited_print: bytes) -> dict:
    return {
        "doc_id": i, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited_text.encode()).hexdigest(), "fp": print_, "edited_fp": edited_print,
        "near_edited": likeness(print_, edited_print), "near_next": likeness(print_, next_print), "edge": None, "part": None, "text": None,
    }


ROWS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.binary()), ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edge", pa.int32()), ("part", pa.int32()), ("text", pa.large_string())])
ROWS_DDL = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double, edge int, part int, text string"
FIRST, LAST = 0, 1


def _in_order(batches):
    """Sorted documents of one range: results of all but the last, and the first and the last one as edges."""
    part, held, z = TaskContext.get().partitionId(), None, zstandard.ZstdDecompressor()

    def edge(side: int, doc) -> dict:
        i, text, fp = doc
        return {n: None for n in ROWS.names} | {"doc_id": i, "fp": fp, "edge": side, "part": part, "text": text}

    for batch in batches:
        for lo, hi, _, _ in T.blocks(None, batch.column(1), 1 << 20):
            ids, texts = batch.column(0).slice(lo, hi - lo).to_pylist(), [z.decompress(t).decode("utf-8", "surrogatepass") for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            before = [held] if held else []
            docs = [d[:2] for d in before] + list(zip(ids, texts, strict=True))
            changed = [edited(a[1], b[1]) for a, b in zip(docs, docs[1:])]
            prints = _of_texts(texts + changed)
            own, changed_prints = [d[2] for d in before] + prints[: len(texts)], prints[len(texts) :]
            rows = [] if held else [edge(FIRST, (*docs[0], own[0]))]
            rows += [_result(*docs[k], own[k], docs[k + 1][1], own[k + 1], changed[k], changed_prints[k]) for k in range(len(docs) - 1)]
            held = (*docs[-1], own[-1])
            yield pa.RecordBatch.from_pylist(rows, ROWS)
    if held:
        yield pa.RecordBatch.from_pylist([edge(LAST, held)], ROWS)


def _packed(batches):
    """Texts compressed one by one, as they are shuffled."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "tie", "text"])


def _across(batches):
    """Results of the documents at the end of a range."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            changed = edited(r["text"], r["next_text"])
            rows.append(_result(r["doc_id"], r["text"], r["fp"], r["next_text"], r["next_fp"], changed, _of_texts([changed])[0]))
        yield pa.RecordBatch.from_pylist(rows, ROWS)


def documents_in_order(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next of every row, as a table."""
    share_seed(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    ranges = min(MOST_RANGES, max(16, -(-C.corpus_bytes(docs, text) // RANGE_BYTES)))
    keys = (F.col("doc_id").asc_nulls_last(), F.col("tie").asc())
    small = src.mapInArrow(C.settled(_packed), "doc_id long, tie long, text binary")
    made = _scratch.table(small.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(C.settled(_in_order), ROWS_DDL), "fingerprints")
    # at most MOST_RANGES numbers: which range comes after which
    parts = sorted(r["part"] for r in made.where(F.col("edge") == FIRST).select("part").collect())
    after = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    out = made.where("edge is null").drop("edge", "part", "text")
    if not parts:
        return out
    follows = F.broadcast(docs.sparkSession.createDataFrame(list(after.items()), "part int, follows int"))
    firsts = made.where(F.col("edge") == FIRST).select(F.col("part").alias("follows"), F.col("fp").alias("next_fp"), F.col("text").alias("next_text"))
    ends = made.where(F.col("edge") == LAST).select("doc_id", "fp", "text", "part").join(follows, "part").join(firsts, "follows")
    last = ends.select("doc_id", "fp", "text", "next_fp", "next_text").mapInArrow(C.settled(_across), ROWS_DDL)
    return out.unionByName(last.drop("edge", "part", "text"))


def tables(radius: int, blocks: int = BLOCKS) -> list[tuple[int, ...]]:
    """Which blocks each table brings to the front."""
    return list(combinations(range(blocks), blocks - radius))


def _permuted(radius: int):
    """Per fingerprint a row per table; its bucket is a hash of the table and the table's front blocks."""
    chosen = tables(radius)
    width = BITS // BLOCKS // 8

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, BLOCKS, width)
            for t, blocks in enumerate(chosen):
                front = np.zeros((n, 16), np.uint8)
                front[:, : (BLOCKS - radius) * width] = fp[:, list(blocks)].reshape(n, -1)[:, :16]
                halves = front.view(np.uint64)
                bucket = T.mix(halves[:, 0] ^ T.mix(halves[:, 1] + np.uint64(t + 1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(n, t, np.int32)), pa.array(bucket)], names=["node", "fp", "n", "table", "bucket"])

    return run


def first_tables(radius: int) -> np.ndarray:
    """For each set of agreeing blocks, as bits, the number of the first table in which all blocks agree; -1 if there is none."""
    out = np.full(1 << BLOCKS, -1)
    for number, chosen in reversed(list(enumerate(tables(radius)))):
        mask = sum(1 << b for b in chosen)
        out[[k for k in range(1 << BLOCKS) if k & mask == mask]] = number
    return out


def bucket_pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b), a < b, of all pairs inside runs of so many rows each."""
    begin = np.cumsum(size) - size
    after = np.repeat(begin + size, size) - np.arange(int(size.sum())) - 1  # rows behind each row in its run
    a = np.repeat(np.arange(len(after)), after)
    return a, C.spread(np.arange(len(after)) + 1, after)


class Comparison:
    """Links of complete buckets, (table, number of the tile's first side) by row."""

    def __init__(self, radius: int):
        self.radius, self.first, self.chosen = radius, first_tables(radius), tables(radius)

    def confirmed(self, raw: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs within the radius whose first table this is."""
        words = raw.view(np.uint64)
        far = np.zeros(len(a), np.uint8)
        for k in range(words.shape[1]):
            far += np.bitwise_count(words[a, k] ^ words[b, k])
        near = np.flatnonzero(far <= self.radius)
        a, b = a[near], b[near]
        clean = ((raw[a] ^ raw[b]).reshape(len(a), BLOCKS, BITS // BLOCKS // 8) == 0).all(axis=2)
        own = self.first[clean @ (1 << np.arange(BLOCKS))] == table[a]
        return a[own], b[own]

    def links(self, raw: np.ndarray, table: np.ndarray, side: np.ndarray, two: np.ndarray, size: np.ndarray):
        """Pairs of linked rows; rows of a bucket follow each other, ``size`` rows each; two: its sides are compared with each other."""
        begin = np.cumsum(size) - size
        small = ~two & (size <= SMALL)
        rows = np.flatnonzero(np.repeat(small, size))
        own, lo = size[small], 0
        ends = np.cumsum(own * (own - 1) // 2)
        while lo < len(own):
            # as many buckets at a time as make a bounded number of pairs
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            a, b = bucket_pairs(own[lo:hi])
            at = rows[int(own[:lo].sum()) :]
            yield self.confirmed(raw, table, at[a], at[b])
            lo = hi
        for k in np.flatnonzero(~small).tolist():
            own_rows = np.arange(begin[k], begin[k] + size[k])
            left, right = own_rows[side[own_rows] == 0], own_rows[side[own_rows] == 1] if two[k] else own_rows
            for lo in range(0, len(left), 256):
                i = left[lo : lo + 256]
                a, b = np.repeat(i, len(right)), np.tile(right, len(i))
                if not two[k]:
                    a, b = a[a < b], b[a < b]
                yield self.confirmed(raw, table, a, b)


#: Buckets up to this size are compared many at a time, in so many pairs.
SMALL = 64
PAIRS = 1 << 20


def _compared(radius: int):
    """Links of sorted buckets: per fingerprint how many documents it links with, and a link to its class among them."""
    names = ["table", "bucket", "i", "j"]

    def results(t: pa.Table, size: np.ndarray) -> pa.RecordBatch:
        node, n, side, which = (t.column(c).to_numpy() for c in ("node", "n", "side", "table"))
        raw = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(len(node), -1)
        links = np.zeros(len(node), np.int64)
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        heads = np.cumsum(size) - size
        two = t.column("i").to_numpy()[heads] != t.column("j").to_numpy()[heads]
        for a, b in Comparison(radius).links(raw, which, side, two, size):
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            if len(a):
                # members of one class there need one link each
                members, least = smallest(node[a], node[b])
                pairs.append((members, least))
        own, at = np.unique(node, return_inverse=True)
        total = np.bincount(at, links, len(own)).astype(np.int64)
        members, least = smallest(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
        root = own.copy()
        root[np.searchsorted(own, members)] = least
        out = total > 0
        return pa.RecordBatch.from_arrays([pa.array(own[out]), pa.array(total[out]), pa.array(root[out])], names=["node", "links", "root"])

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in names:
                col = t.column(c).combine_chunks()
                new[1:] |= pa.compute.not_equal(col.slice(1), col.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(new)
            if heads[-1]:
                yield results(t.slice(0, int(heads[-1])), np.diff(heads))
            held = [t.slice(int(heads[-1]))]
        if held:
            yield results(held[0].combine_chunks(), np.array([held[0].num_rows]))

    return run


def near_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, n_near, component_id of every distinct fp of (doc_id, fp).

    n_near: how many other rows lie within ``radius`` bits of it, its own copies
    included; component_id: the smallest doc_id that is reachable over such links.
    """
    share_seed(prints.sparkSession)
    nodes = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    # 64 bits of MD5 name a fingerprint in the search; equal names of different ones are told apart by the bits
    nodes = _scratch.table(nodes.withColumn("node", F.conv(F.substring(F.md5("fp"), 1, 15), 16, 10).cast("long")), "prints")
    placed = nodes.select("node", "fp", "n").mapInArrow(C.settled(_permuted(radius)), "node long, fp binary, n long, table int, bucket long")
    # most fingerprints are alone in their buckets: those don't go further than a count
    several = _scratch.table(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    live = only_wanted(placed, "bucket", several)
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    dealt = live.withColumn("nt", tiles).withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("nt")).cast("int"))
    pairs = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))
    pairs = pairs.select("table", "bucket", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), F.when(F.col("own") > F.col("o"), 1).otherwise(0).alias("side"), "node", "fp", "n")
    bucket = ("table", "bucket", "i", "j")
    found = pairs.repartition(*bucket).sortWithinPartitions(*bucket, "side", "node").mapInArrow(C.settled(_compared(radius)), "node long, links long, root long")
    found = _scratch.table(found, "near")
    label = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(counts, "node", "left").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("fp", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_near"), "component_id", "n")


HOT_PRINTS = 2000


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near, component_id.

    The edited text is the text with its last half replaced by as many code
    points of the next document by id (after the last: the first), or all it
    has.  ``near_edited`` and ``near_next`` are the shares of equal bits with the edited
    text's fingerprint and the next document's.  ``n_near`` counts the other documents within ``radius`` bits;
    component_id is the smallest id reachable over such documents, so it names a class.

    A null text counts as empty; texts without words have fingerprint 0 and so are alike; a null id
    comes after all others, and a class of null ids only has a null component_id; rows
    with equal ids follow each other by a hash of their texts; rows that repeat both follow each other and get a row each.  Texts of
    any length are read whole.  Other columns are ignored; an empty table gives an empty result.
    """
    made = _scratch.table(documents_in_order(docs, id_col, text), "documents")
    near = _scratch.table(near_fingerprints(made.select("doc_id", "fp"), radius), "classes")
    # the most frequent fingerprints are broadcast, a bounded number, so that no key of the join is hot
    hot = near.orderBy(F.desc("n"), "fp").limit(HOT_PRINTS).select("fp", F.col("n_near").alias("hot_near"), F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    split = made.join(F.broadcast(hot), "fp", "left")
    done = split.where("hot").select(*made.columns, F.col("hot_near").alias("n_near"), F.col("hot_id").alias("component_id"))
    cold = split.where("hot is null").select(*made.columns).join(near.select("fp", "n_near", "component_id"), "fp").select(*made.columns, "n_near", "component_id")
    hexed = lambda c: F.lower(F.hex(c))
    out = done.unionByName(cold)
    return out.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near", "component_id")


def op11_fingerprints(spark, sf_dir: str) -> DataFrame:
    """SimHash of all `documents` and of their edited texts, and each one's neighbours within 6 of 128 bits."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id::BIGINT AS doc_id, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (
  SELECT doc_id, next_id, text, length(text) AS n_chars, left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) AS changed FROM o),
words AS (
  SELECT doc_id, x, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term
  FROM (SELECT doc_id, 0 AS x, text AS t FROM e UNION ALL SELECT doc_id, 1, changed FROM e)),
terms AS (SELECT doc_id, x, term, length(bin(count(*))) AS weight FROM words GROUP BY ALL),
hashed AS (SELECT term, md5(term) AS h FROM (SELECT DISTINCT term FROM terms)),
bits AS MATERIALIZED (SELECT term, b, (('0x' || h[b // 4 + 1])::INT >> (3 - b % 4)) & 1 AS bit FROM hashed, range(128) r(b)),
votes AS (SELECT doc_id, x, b, sum(CASE bit WHEN 1 THEN weight ELSE -weight END) > 0 AS bit FROM terms JOIN bits USING (term) GROUP BY doc_id, x, b),
prints AS MATERIALIZED (
  SELECT i.doc_id, i.x, coalesce(s, repeat('0', 128)) AS s FROM (SELECT doc_id, x FROM e, (VALUES (0), (1)) v(x)) i
  LEFT JOIN (SELECT doc_id, x, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY b) AS s FROM votes GROUP BY doc_id, x) USING (doc_id, x)),
hexed AS (SELECT doc_id, x, s, lower(string_agg(printf('%x', ('0b' || s[4 * k + 1 : 4 * k + 4])::INT), '' ORDER BY k)) AS fp FROM prints, range(32) r(k) GROUP BY doc_id, x, s),
own AS MATERIALIZED (SELECT doc_id, s, fp FROM hexed WHERE x = 0),
near AS MATERIALIZED (
  SELECT a.doc_id, b.doc_id AS other FROM own a JOIN own b ON a.doc_id != b.doc_id AND hamming(a.s, b.s) <= 6),
reach AS (SELECT doc_id, doc_id AS other FROM own UNION SELECT r.doc_id, n.other FROM reach r JOIN near n ON r.other = n.doc_id),
component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY doc_id)
SELECT e.doc_id, n_chars, sha256(changed) AS edited_sha256, a.fp AS fingerprint, c.fp AS edited_fingerprint,
       1 - hamming(a.s, c.s) / 128 AS near_edited, 1 - hamming(a.s, b.s) / 128 AS near_next, coalesce(n_near, 0) AS n_near, component_id
FROM e JOIN own a ON a.doc_id = e.doc_id JOIN own b ON b.doc_id = next_id JOIN hexed c ON c.doc_id = e.doc_id AND c.x = 1
JOIN component ON component.doc_id = e.doc_id LEFT JOIN counted ON counted.doc_id = e.doc_id
"""
