"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting reads a bounded sample of labelled documents (``max_per_class`` of each
label, by smallest hash of the id, one text per id).  Terms are lower-cased letter
runs.  Every term of a text counts in its vector and norm, with the weight

    (1 + ln tf) * ln((N + 1) / (df + 1)) * (FLOOR + (1 - FLOOR) * g / (g + HALF))

N and df are those of all labelled documents, estimated from the sample, which
is stratified by label; g is the term's likelihood ratio between the labels.
Plain TF-IDF (``floor`` = 1) lets the many rare words of a text outweigh the few
that make it toxic; the last factor leaves no term out, but one that doesn't
tell the labels apart weighs a tenth.  A term that no example holds counts in
the norm as one of df 0 and g 0.

The index.  Examples are numbered so that those with the same strongest term are
neighbours, in blocks of ``BLOCK``.  A term held by more than one in ``DENSE``
examples stores its postings as a dense row; any other as sorted postings, with
its greatest weight in each block it occurs in.

Scoring is one map over the documents, without a shuffle.  The dense rows give
each example its exact part of the cosine; a block's best example can't exceed
its best exact part plus the block maxima of the other terms.  The blocks of the
best bounds are finished first; of the others only those whose bound reaches
the k-th best cosine.  So the neighbours are exact.

Votes are weighted by cosine distance and by class (the sample is stratified),
then calibrated by a monotone fit to the leave-one-out votes of the examples.
The index that is broadcast grows with the sample's texts, never with the corpus;
its weights are kept in single precision, and summed in double.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _chunks as C
from palimpsest.llm import _text as T
from palimpsest.session import share_seed

BLOCK = 64
DENSE = 12
FLOOR = 0.1
HALF = 30.0
#: Documents whose dense parts are computed together.
BATCH = 64
#: Vectors whose result a worker keeps for copies.
CACHE = 20_000
U64 = np.uint64


def counted_terms(buf: np.ndarray, offs: np.ndarray):
    """(term hashes, term frequencies, offsets per document) of a block, terms ascending per document."""
    w = T.Words(buf, offs, lower=True, separator=T.NOT_LETTER)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(w.offs))
    order = np.lexsort((w.hash, doc))
    h, d = w.hash[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h))), np.searchsorted(d[first], np.arange(len(offs)))


def _ranges(begin: np.ndarray, end: np.ndarray):
    """(which range, index) of all ranges begin[i]:end[i], one after the other."""
    n = (end - begin).astype(np.int64)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[which]


@dataclass
class Index:
    """Block-max inverted index of labelled examples."""

    k: int
    floor: float = FLOOR
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))  # sorted term hashes
    factor: np.ndarray = field(default_factory=lambda: np.zeros(0))  # weight of a term seen once
    unknown: float = 1.0  # the same of a term that no example holds
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # 0 or 1 per example
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    class_weight: tuple[float, float] = (1.0, 1.0)
    # calibration: votes at or above steps[i] give values[i]
    steps: np.ndarray = field(default_factory=lambda: np.zeros(1))
    values: np.ndarray = field(default_factory=lambda: np.zeros(1))

    # --- building ---------------------------------------------------------------

    def build(self, term: np.ndarray, weight: np.ndarray, offs: np.ndarray) -> None:
        """Postings of the examples' unit vectors: term numbers and weights, offsets per example."""
        n = len(offs) - 1
        self.n_blocks = max(1, -(-n // BLOCK))
        example = np.repeat(np.arange(n), np.diff(offs))
        df = np.bincount(term, minlength=len(self.vocabulary))
        often = np.flatnonzero(df * DENSE > n)
        self.row = np.full(len(self.vocabulary), -1, np.int32)
        self.row[often] = np.arange(len(often))
        own = self.row[term] >= 0
        self.dense = np.zeros((len(often), self.n_blocks * BLOCK), np.float32)
        self.dense[self.row[term[own]], example[own]] = weight[own]
        term, example, weight = term[~own], example[~own], weight[~own]
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order].astype(np.float32)
        block = (self.example // BLOCK).astype(np.int32)
        # entries: runs of one term in one block
        head = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.entry_block = block[head]
        self.entry_max = np.maximum.reduceat(self.weight, head) if len(head) else np.zeros(0)
        self.entry_begin = np.append(head, len(term)).astype(np.int32)
        self.term_begin = np.searchsorted(term[head], np.arange(len(self.vocabulary) + 1)).astype(np.int32)

    # --- vectors ----------------------------------------------------------------

    def vectors(self, buf: np.ndarray, offs: np.ndarray):
        """(term numbers, weights, offsets per document): unit TF-IDF vectors of a block, unknown terms in the norm only."""
        h, tf, cut = counted_terms(buf, offs)
        return self.weigh(h, tf, cut)

    def weigh(self, h: np.ndarray, tf: np.ndarray, cut: np.ndarray):
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        ok = self.vocabulary[at] == h if len(self.vocabulary) else np.zeros(len(h), bool)
        weight = (1 + np.log(tf)) * np.where(ok, self.factor[at] if len(self.factor) else 0.0, self.unknown)
        doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        norm = np.sqrt(np.bincount(doc, weight**2, len(cut) - 1))
        weight /= np.maximum(norm, 1e-300)[doc]
        known = np.concatenate([[0], np.cumsum(ok)])
        return at[ok], weight[ok], known[cut]

    # --- search -----------------------------------------------------------------

    def dense_part(self, term: np.ndarray, weight: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Of several vectors: each example's cosine over the dense terms."""
        if self.dense.dtype != np.float64:
            self.dense = self.dense.astype(np.float64)
        q = np.zeros((len(offs) - 1, len(self.dense)))
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        row = self.row[term]
        q[doc[row >= 0], row[row >= 0]] = weight[row >= 0]
        return q @ self.dense

    def nearest(self, term: np.ndarray, weight: np.ndarray, exact: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest, cosine above 0, and all others as near as the k-th; equal ones by number.

        exact: the dense part of the vector.
        """
        light = self.row[term] < 0
        which, entry = _ranges(self.term_begin[term[light]], self.term_begin[term[light] + 1])
        q = weight[light][which]
        block = self.entry_block[entry]
        bound = exact.reshape(-1, BLOCK).max(1) + np.bincount(block, q * self.entry_max[entry], self.n_blocks)
        todo = np.zeros(self.n_blocks, bool)
        few = min(self.n_blocks, 1 + -(-self.k // BLOCK))
        todo[np.argpartition(-bound, few - 1)[:few]] = True
        cos, done, least = np.zeros(len(exact)), np.zeros(self.n_blocks, bool), 0.0
        while todo.any():
            own = np.flatnonzero(todo[block])
            part, posting = _ranges(self.entry_begin[entry[own]], self.entry_begin[entry[own] + 1])
            cos += np.bincount(self.example[posting], q[own][part] * self.weight[posting], len(cos))
            members = np.repeat(todo, BLOCK)
            cos[members] += exact[members]
            done |= todo
            if skip >= 0:
                cos[skip] = 0
            if self.k <= len(cos):
                least = max(0.0, np.partition(cos, len(cos) - self.k)[len(cos) - self.k])
            todo = ~done & (bound > 0) & (bound >= least - 1e-9)
        cos = np.round(cos, 9)
        if self.k < len(cos):
            least = np.partition(cos, len(cos) - self.k)[len(cos) - self.k]
        else:
            least = 0.0
        e = np.flatnonzero((cos > 0) & (cos >= least))
        e = e[np.lexsort((e, -cos[e]))]
        return e, cos[e]

    # --- votes ------------------------------------------------------------------

    def vote(self, e: np.ndarray, c: np.ndarray) -> float:
        """Share of label 1 among neighbours, weighted by 1 / (distance + 0.05) and class."""
        w = 1 / (1.05 - c) * np.where(self.labels[e] == 1, self.class_weight[1], self.class_weight[0])
        return float(w[self.labels[e] == 1].sum() / w.sum())

    def calibrated(self, vote: float) -> float:
        # between two steps the vote itself orders, so equal scores are rare
        i = max(0, int(np.searchsorted(self.steps, vote, side="right")) - 1)
        return float(np.clip(0.999 * self.values[i] + 0.001 * vote, 0, 1))

    def scores(self, term: np.ndarray, weight: np.ndarray, offs: np.ndarray, known: dict, evidence: int = 0):
        """(score, nearest examples, their cosines) of each vector; copies are looked up in ``known``."""
        spans = list(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))
        keys = [blake2b(term[a:b].tobytes() + weight[a:b].tobytes(), digest_size=16).digest() for a, b in spans]
        got: dict = {}
        new = [i for i, key in enumerate(keys) if spans[i][0] < spans[i][1] and key not in known and not (key in got or got.setdefault(key, None))] if len(self.labels) else []
        got.clear()
        for lo in range(0, len(new), BATCH):
            part = new[lo : lo + BATCH]
            n = [spans[i][1] - spans[i][0] for i in part]
            at = np.concatenate([np.arange(*spans[i]) for i in part])
            exact = self.dense_part(term[at], weight[at], np.concatenate([[0], np.cumsum(n)]))
            for row, i in zip(exact, part, strict=True):
                a, b = spans[i]
                e, c = self.nearest(term[a:b], weight[a:b], row)
                got[keys[i]] = (self.calibrated(self.vote(e, c)), e[:evidence], c[:evidence]) if len(e) else (0.0, e, c)
        blank = (0.0, np.zeros(0, np.int64), np.zeros(0))
        out = [got.get(key) or known.get(key) or blank for key in keys]
        if len(known) + len(got) > CACHE:
            known.clear()
        known.update(got)
        return out


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted non-decreasing least-squares fit of y on x: (steps, values)."""
    pools: list[list[float]] = []  # first x, weight, weighted sum
    for v in np.unique(x):
        own = x == v
        pools.append([float(v), float(w[own].sum()), float((w[own] * y[own]).sum())])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    return np.array([p[0] for p in pools]), np.array([p[2] / p[1] for p in pools])


def _train_rows(docs: DataFrame, labels: DataFrame, label: str, max_per_class: int) -> tuple[DataFrame, tuple[int, int]]:
    """Sampled labelled documents (doc_id, text, y), one row per id, and how many labels of each class there are to learn from."""
    learn = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    learn = learn.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    total = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [learn.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for y in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))  # at most 2 * max_per_class rows of 12 bytes
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    one = src.join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return one, (total.get(0, 0), total.get(1, 0))


def _count(batches):
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for lo, hi, buf, offs in T.blocks(None, batch.column(1)):
            h, tf, cut = counted_terms(buf, offs)
            cuts = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([h[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([z.compress(tf[a:b].astype(np.int32).tobytes()) for a, b in cuts], pa.binary())],
                names=["doc_id", "y", "h", "tf"],
            )


def _boost(n0: int, n1: int, df0: np.ndarray, df1: np.ndarray) -> np.ndarray:
    """Likelihood ratio between the labels of each term, from document counts."""
    df, whole = df0 + df1, float(n0 + n1)

    def part(c, of_df, of_n):
        return np.where(c > 0, c * np.log(np.maximum(c, 1e-300) * whole / np.maximum(of_df * of_n, 1e-300)), 0.0)

    return 2 * (part(df0, df, n0) + part(df1, df, n1) + part(n0 - df0, whole - df, n0) + part(n1 - df1, whole - df, n1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_per_class: int = 3000, k: int = 40, floor: float = FLOOR) -> Index:
    """Index of labelled examples; the bound is max_per_class documents of each label, whatever the tables hold.

    Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from; null
    labels and ids are left out; of several labels of a document the greater
    counts, of several texts of an id the least (a null text counts as empty);
    examples without a term are no one's neighbour.  Texts of any length count
    whole; other columns are ignored.  Where a label has no example, as in empty
    tables, nothing is learned: the index has no examples and every score is 0.
    """
    share_seed(docs.sparkSession)
    rows, (all0, all1) = _train_rows(docs, labels, label, max_per_class)
    # at most 2 * max_per_class rows
    got = sorted(rows.mapInArrow(C.settled(_count), "doc_id long, y int, h binary, tf binary").collect(), key=lambda r: r["doc_id"])
    index = Index(k, floor)
    y, ids = np.array([r["y"] for r in got], np.int64), np.array([r["doc_id"] for r in got], np.int64)
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    if not n0 or not n1:
        return index
    z = zstandard.ZstdDecompressor()
    cut = np.concatenate([[0], np.cumsum([len(r["h"]) // 8 for r in got])])
    h = np.frombuffer(b"".join(r["h"] for r in got), U64)
    tf = np.frombuffer(b"".join(z.decompress(r["tf"]) for r in got), np.int32)
    del got
    index.vocabulary, term = np.unique(h, return_inverse=True)
    df1 = np.bincount(term, np.repeat(y, np.diff(cut)), len(index.vocabulary))
    df0 = np.bincount(term, minlength=len(index.vocabulary)) - df1
    del term
    index.class_weight = (all0 / n0, all1 / n1)
    whole = float(all0 + all1)
    df = df0 * index.class_weight[0] + df1 * index.class_weight[1]
    g = np.maximum(_boost(n0, n1, df0, df1), 0.0)
    # a term of every text still counts
    index.factor = np.maximum(np.log((whole + 1) / (df + 1)), 1e-6) * (floor + (1 - floor) * g / (g + HALF))
    index.unknown = float(np.log(whole + 1) * floor)
    term, weight, offs = index.weigh(h, tf, cut)
    del h, tf, df, df0, df1, g
    # examples with the same strongest term go side by side, so that block bounds are tight
    size = np.diff(offs)
    strongest = np.full(len(ids), -1)
    best = np.lexsort((-weight, np.repeat(np.arange(len(ids)), size)))
    strongest[size > 0] = term[best[offs[:-1][size > 0]]]
    order = np.lexsort((ids, strongest))
    index.labels, index.ids = y[order], ids[order]
    at = C.spread(offs[:-1][order], size[order])
    term, weight = term[at].astype(np.int32), weight[at]
    offs = np.concatenate([[0], np.cumsum(size[order])])
    del at, best
    index.build(term, weight, offs)
    # calibration on leave-one-out votes
    votes = np.full(len(ids), np.nan)
    for lo in range(0, len(ids), BATCH):
        hi = min(lo + BATCH, len(ids))
        own = slice(offs[lo], offs[hi])
        exact = index.dense_part(term[own], weight[own], offs[lo : hi + 1] - offs[lo])
        for i in range(lo, hi):
            e, c = index.nearest(term[offs[i] : offs[i + 1]], weight[offs[i] : offs[i + 1]], exact[i - lo], skip=i)
            if len(e):
                votes[i] = round(index.vote(e, c), 3)
    blank = np.isnan(votes)
    if not blank.all():
        cw = np.where(index.labels == 1, index.class_weight[1], index.class_weight[0])
        index.steps, index.values = monotone(votes[~blank], index.labels[~blank].astype(float), cw[~blank])
    index.dense = index.dense.astype(np.float32)
    del term, weight
    C.settle()
    return index


def _scores(index: Index, texts, evidence: int = 0):
    """(score, example numbers, cosines) of each text, in order."""
    known: dict = {}
    for _, _, buf, offs in T.blocks(None, texts, 1 << 19):
        yield from index.scores(*index.vectors(buf, offs), known, evidence)


def score_documents(docs: DataFrame, index: Index, evidence: int = 0) -> DataFrame:
    """One row per input row: doc_id, score, and with ``evidence`` the so many nearest examples (doc_id, cosine, label).

    Null and empty texts, and texts that share no term with an example, have no
    neighbour: their score is 0, without evidence.  Equal cosines count alike:
    all examples as near as the k-th vote; evidence lists them by number.  Rows
    with the same id are scored one by one; texts of any length are scored whole;
    other columns are ignored; an empty table gives an empty result.
    """
    share_seed(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        for batch in batches:
            got = list(_scores(held.value, batch.column(1), evidence))
            cols = [batch.column(0), pa.array([round(g[0], 9) for g in got], pa.float64())]
            if evidence:
                m = held.value
                cols.append(pa.array([[{"doc_id": int(m.ids[e]), "cosine": float(c), "label": int(m.labels[e])} for e, c in zip(g[1], g[2], strict=True)] for g in got], kind))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "evidence"][: len(cols)])

    schema = "doc_id long, score double" + (", evidence array<struct<doc_id: long, cosine: double, label: int>>" if evidence else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(C.settled(run), schema)


def drop_toxic(docs: DataFrame, index: Index, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns unchanged; no shuffle.

    Decided row by row, so repeated rows go or stay alike; null and empty texts
    and those without a neighbour score 0 and stay; an empty table stays empty.
    """
    share_seed(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [g[0] < threshold for g in _scores(held.value, batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(C.settled(run), docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all `documents`, learned from `labels.toxic` of rows that aren't held out, with the three nearest examples."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return score_documents(docs, index, evidence=3).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
