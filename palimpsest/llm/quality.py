"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over bytes: an n-gram of up to ``ORDER`` = 5 bytes is its own exact key (an
integer with the order above it), there are no unknown symbols, and the number
of n-gram types per chunk levels off, so what is shuffled stays far below the
text.  Counts of the highest order come from all trusted documents; lower
orders are continuation counts, as Kneser-Ney asks for.

1. Per chunk of documents: distinct n-grams to score, and counts over its
   trusted documents.  Trusted ids meet the documents by chunk, not by a
   broadcast, so both may grow.
2. Counts are summed in shards by n-gram.  Discounts D1, D2, D3+ per order come
   from counts of counts, contexts' back-off weights from an aggregate, both
   plain DataFrame steps.
3. The distinct n-grams of the corpus are joined with the count shards, order by
   order, which gives each its interpolated log probability.
4. Each shard answers its chunks; each chunk sums its documents' log
   probabilities.
5. A quarter of the trusted documents, by hash of the id, isn't learned from.  A
   language's threshold is the quantile of its own held-out perplexities; a
   language that has none takes the quantile of all.

Shards answer with log probabilities alone: a chunk finds its n-grams again from
its text, in the same order.  Tables are dropped as soon as nothing reads them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _chunks as C
from palimpsest import scratch as _scratch
from palimpsest.llm import _text as T

ORDER = 5
SHARDS_PER_CHUNK = 2
#: n-gram types of a chunk level off, so larger chunks send fewer.
CHUNK_BYTES = 8 << 20
#: Log probabilities are summed in steps of 1 / UNIT.
UNIT = 1 << 30
START = 2  # a control byte stands for the beginning of a text


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of the ORDER bytes that end at each byte, n-gram offsets per document).

    White space runs count as one space; a text is preceded by ORDER - 1 start marks.
    """
    sep = T.SEPARATOR[buf]
    keep = ~sep
    keep[1:] |= sep[1:] & ~sep[:-1]
    begins = offs[:-1][np.diff(offs) > 0]
    keep[begins] = True
    data = np.where(sep, 32, buf)[keep].astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(keep)])[offs]
    n = np.diff(at)
    pad = ORDER - 1
    wide = np.full(len(data) + pad * len(n), START, np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    wide[np.arange(len(data)) + pad * (doc + 1)] = data
    end = np.arange(len(data)) + pad * (doc + 1)
    key = np.zeros(len(data), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        key = (key << np.uint64(8)) | wide[end - k]
    return key.view(np.int64), at


def _shard(key: np.ndarray, n: int) -> np.ndarray:
    return (T.mix(key.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _distinct(texts, n_shards: int, trusted: np.ndarray | None = None):
    """Distinct n-grams of a chunk ordered by (shard, key): keys, their shards, and counts in trusted documents."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, _, buf, offs in T.blocks(None, texts):
        key, at = grams(buf, offs)
        if trusted is None:
            keys.append(np.unique(key))
            continue
        good = np.repeat(trusted[lo : lo + len(at) - 1], np.diff(at))
        k, back = np.unique(key, return_inverse=True)
        keys.append(k)
        counts.append(np.bincount(back, good, len(k)).astype(np.int64))
    if trusted is None:
        key, count = np.unique(np.concatenate(keys)), None
    else:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
    shard = _shard(key, n_shards)
    order = np.argsort(shard, kind="stable")
    return key[order], shard[order], None if count is None else count[order]


def collect_pass(n_shards: int):
    """Rows (shard, chunk, keys, counts): distinct n-grams of a chunk, with their counts in trusted documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, z = [], zstandard.ZstdCompressor(level=3)
        if left.num_rows:
            ids, texts = C.unpack(left)
            trusted = np.isin(ids, right.column("id").to_numpy()) if right.num_rows else np.zeros(len(ids), bool)
            key, shard, count = _distinct(texts, n_shards, trusted)
            chunk = left.column("chunk")[0].as_py()
            for s, part in C.cut_by(shard):
                # ascending keys: the gaps are small
                rows.append((s, chunk, C.pack(z, np.diff(key[part], prepend=0)), C.pack(z, count[part])))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table({n: pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, (n, c) in enumerate(zip(("shard", "chunk", "keys", "counts"), cols, strict=True))})

    return run


def _keys_of(z: zstandard.ZstdDecompressor, blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(z.decompress(blob), np.int64))


def sum_shard(table: pa.Table) -> pa.Table:
    """Distinct n-grams of one shard with their trusted counts."""
    z = zstandard.ZstdDecompressor()
    keys = np.concatenate([_keys_of(z, k) for k in table.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(z.decompress(k), np.int64) for k in table.column("counts").to_pylist()])
    key, back = np.unique(keys, return_inverse=True)
    return pa.table({"key": pa.array(key), "n": pa.array(np.bincount(back, counts, len(key)).astype(np.int64))})


def answer_shard(left: pa.Table, right: pa.Table) -> pa.Table:
    """Per chunk of one shard: log probabilities in the order of its keys."""
    rows, z, zc = [], zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    if left.num_rows and right.num_rows:
        key, logp = right.column("key").to_numpy(), right.column("logp").to_numpy()
        order = np.argsort(key)
        key, logp = key[order], logp[order].astype(np.float32)
        shard = left.column("shard")[0].as_py()
        for c, k in zip(left.column("chunk").to_pylist(), left.column("keys").to_pylist(), strict=True):
            own = logp[np.searchsorted(key, _keys_of(z, k))]
            # bytes of equal weight side by side compress better
            rows.append((c, shard, zc.compress(np.ascontiguousarray(own.view(np.uint8).reshape(-1, 4).T).tobytes())))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table({n: pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, (n, c) in enumerate(zip(("chunk", "shard", "logp"), cols, strict=True))})


def perplexity_pass(n_shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_bytes": [], "nll": []}
        if left.num_rows:
            z = zstandard.ZstdDecompressor()
            ids, texts = C.unpack(left)
            keys, _, _ = _distinct(texts, n_shards)
            got = sorted(zip(right.column("shard").to_pylist(), right.column("logp").to_pylist(), strict=True))
            logp = np.concatenate([np.zeros(0, np.float32), *(np.ascontiguousarray(np.frombuffer(z.decompress(b), np.uint8).reshape(4, -1).T).view(np.float32).ravel() for _, b in got)])
            order = np.argsort(keys)
            # whole numbers, so a sum doesn't depend on the block that a document is in
            keys, units = keys[order], np.round(logp[order].astype(np.float64) * UNIT).astype(np.int64)
            for lo, hi, buf, offs in T.blocks(ids, texts):
                key, at = grams(buf, offs)
                k, back = np.unique(key, return_inverse=True)
                total = np.zeros(len(key) + 1, np.int64)
                np.cumsum(units[np.searchsorted(keys, k)][back], out=total[1:])
                out["doc_id"] += [None if i == C.NULL_ID else i for i in ids[lo:hi].tolist()]
                out["n_bytes"] += np.diff(at).tolist()
                out["nll"] += ((total[at[:-1]] - total[at[1:]]) / UNIT).tolist()
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "nll": pa.array(out["nll"], pa.float64())})

    return run


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts D1, D2, D3+ from counts of counts."""
    n = {r["n"]: r["c"] for r in counts.where("n between 1 and 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1:
        return 0.0, 0.0, 0.0
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return tuple(min(max(x, 0.0), k + 1.0) for k, x in enumerate(d))


def score_grams(top: DataFrame) -> DataFrame:
    """(key, logp) of every n-gram of ``top`` (key, n), n its count in trusted text, 0 for none.

    P(w | h) = max(n(hw) - D, 0) / n(h.) + gamma(h) P(w | h'), down to uniform bytes.
    """
    tables, counts = [], top.where("n > 0")
    for m in range(ORDER, 0, -1):
        counts = _scratch.table(counts, f"order{m}")
        d1, d2, d3 = discounts(counts)
        c = F.col("n")
        taken = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        gram = counts.withColumn("h", F.shiftright("key", 8))
        contexts = gram.groupBy("h").agg(F.sum("n").alias("total"), F.sum(taken).alias("free"))
        tables.append((m, counts, gram.select("key", F.greatest(c - taken, F.lit(0.0)).alias("rest")), contexts))
        # continuation counts: distinct bytes before the shorter n-gram
        counts = counts.select(F.col("key").bitwiseAND((1 << (8 * (m - 1))) - 1).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # P of the suffixes that are asked for, from the shortest up
    asked = top.select("key")
    below = made = None
    for m, counts, gram, contexts in reversed(tables):
        now = asked.select(F.col("key").bitwiseAND((1 << (8 * m)) - 1).alias("key")).distinct().withColumn("h", F.shiftright("key", 8)).withColumn("low", F.col("key").bitwiseAND((1 << (8 * (m - 1))) - 1))
        now = now.join(gram, "key", "left").join(contexts, "h", "left")
        lower = F.lit(1.0 / 256) if below is None else F.col("p_low")
        if below is not None:
            now = now.join(below.select(F.col("key").alias("low"), F.col("p").alias("p_low")), "low")
        p = F.when(F.col("total").isNull(), lower).otherwise(F.coalesce("rest", F.lit(0.0)) / F.col("total") + F.col("free") / F.col("total") * lower)
        below, last = _scratch.table(now.select("key", p.alias("p")), f"p{m}"), made
        _scratch.drop(counts, *([last] if last is not None else []))
        made = below
    return below.select("key", F.log("p").cast("float").alias("logp"))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, perplexity (null for texts without bytes).

    trusted: a column doc_id of documents to learn from; repeated ones count
    once, unknown ones not at all.  Null texts count as empty; null ids are
    scored but never trusted; rows with the same id are scored one by one; texts
    of any length are scored whole; other columns are ignored; an empty table
    gives an empty result.
    """
    n_chunks = C.sizes(C.corpus_bytes(docs, text), CHUNK_BYTES)[0]
    n_shards = max(8, n_chunks // SHARDS_PER_CHUNK)
    chunks = C.packed(docs, id_col, text, n_chunks, by_id=True)
    good = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct().withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n_chunks)).cast("int"))
    asked, opened = C.deal(chunks.groupBy("chunk").cogroup(good.groupBy("chunk")), collect_pass(n_shards), "shard int, chunk int, keys binary, counts binary", "chunk", "shard", n_shards, True)
    asked = _scratch.table(asked, "asked")
    top = _scratch.table(asked.groupBy("shard").applyInArrow(opened(sum_shard), "key long, n long"), "top")
    scored = score_grams(top)
    _scratch.drop(top)

    def sharded(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_shard(key, n_shards).astype(np.int32)), batch.column(0), batch.column(1)], names=["shard", "key", "logp"])

    scored = scored.mapInArrow(sharded, "shard int, key long, logp float")
    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return answer_shard(opened(lambda t: t)(left) if left.num_rows else left, right)

    answers, found = C.deal(asked.groupBy("shard").cogroup(scored.groupBy("shard")), answer, "chunk int, shard int, logp binary", "shard", "chunk", n_chunks, True)
    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(found(perplexity_pass(n_shards), True), "doc_id long, n_bytes long, nll double")
    return out.select("doc_id", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(F.col("nll") / F.col("n_bytes"))).alias("perplexity"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99) -> DataFrame:
    """One row per input row: doc_id, lang, n_bytes, perplexity, threshold, keep.

    keep: the perplexity is at most the threshold, the ``quantile`` of that of
    held-out trusted documents of the same language (a null language is one of
    its own), or of all languages where it has none; equal perplexities are
    kept alike.  White space runs count as one byte; null and empty texts have
    none, get no perplexity and aren't kept.  Without any held-out trusted text all others are
    kept, so an empty ``trusted`` keeps them; an empty table gives an empty
    result.  Texts of any length are scored whole.  Rows with the same id are
    scored one by one and take the smallest of the id's languages; other columns
    are ignored.
    """
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(6)), F.lit(4)) == 0
    with _scratch.owned([]) as made:
        scored = perplexities(docs, trusted.where(~held))
    scored = _scratch.table(scored, "perplexity")
    _scratch.release(docs.sparkSession, made)
    langs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("lang")).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    rows = scored.join(langs, scored["doc_id"].eqNullSafe(langs["doc_id"])).select(scored["doc_id"], "lang", "n_bytes", "perplexity")
    good = trusted.where(held).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    limit = rows.join(good, "doc_id", "left_semi").where("perplexity is not null")
    at = F.percentile_approx("perplexity", quantile, 10000)
    by_lang = limit.groupBy("lang").agg(at.alias("own"))
    of_all = limit.agg(at.alias("of_all")).first()["of_all"]
    out = rows.join(by_lang, "lang", "left")
    threshold = F.coalesce("own", F.lit(of_all).cast("double"))
    return out.select("doc_id", "lang", "n_bytes", F.round("perplexity", 6).alias("perplexity"), F.round(threshold, 6).alias("threshold"), (F.col("perplexity").isNotNull() & (threshold.isNull() | (F.col("perplexity") <= threshold))).alias("keep"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Perplexity of all `documents` under a model of those labelled good, and whether they stay."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted)
