"""MinHash near-duplicates with sequential Bayesian verification.

A document is its set of distinct word shingles; documents with equal sets form
a class, and only a class's representative (smallest id) is compared.

1. Banding: ``BANDS`` bands of ``ROWS`` minima.  At similarity 0.85 a pair shares
   no band with probability (1 - 0.85**5)**30 < 3e-8.
2. First links: each band's members are compared with its smallest one, a
   number of pairs linear in documents.
3. Signatures are compared in batches of ``BATCH`` minima.  After n of them with m equal,
   the posterior of the similarity is Beta(1+m, 1+n-m); a pair is pruned when
   it is at or above the threshold with probability below ``MISS``.  Survivors
   are verified on the full shingle sets.
4. Bands that still hold several components need their other pairs.  Small bands
   list them, each pair once.
5. The members of larger ones (more than ``WIDE``: texts that share much without
   being alike) are joined by prefixes instead: shingles are ranked by how many
   members have them, and a pair at the threshold or above shares one of the
   rarest (100 - percent) % of each set.  So what they have in common, however
   many share it, makes no candidates.  Groups of one prefix shingle list their pairs
   if they are small; any that is still larger than ``WIDE`` is cut into blocks, and each pair
   of blocks is compared in one task, which emits verified links only, at most
   one per merge.  So no link is lost, and no large group's pairs are emitted.

Rows are told apart by a hash of id and text, so null and repeated ids take the
same way as all others.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import scratch as _scratch
from palimpsest.llm import _chunks as C
from palimpsest.llm import _text as T
from palimpsest.llm._filters import marked, only_wanted, without
from palimpsest.llm.components import components
from palimpsest.session import share_seed

BANDS, ROWS, BATCH = 30, 5, 30
PERMS = BANDS * ROWS
MISS = 1e-7
WIDE = 48
BLOCK = 512
SALT = 64
HOT_CLASSES = 2_000
FREQUENT = 256
MEMBER_SALTS = 32
_r = np.random.Generator(np.random.PCG64(77))
_A = (_r.integers(0, 1 << 31, PERMS, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_B = _r.integers(0, 1 << 32, PERMS, dtype=np.uint32)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document of a block."""
    w = T.Words(buf, offs, lower=True)
    h = T.run_hash(w.hash, k)
    out = []
    for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(T.run_hash(w.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """PERMS minima of each set that isn't empty, one row per set."""
    size = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), PERMS), np.uint32)
    full = np.flatnonzero(size)
    if len(full):
        x = np.concatenate([sets[i] for i in full])
        x = (x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)
        starts = np.cumsum(size[full]) - size[full]
        for p in range(PERMS):
            v = x * _A[p]
            v += _B[p]
            v ^= v >> np.uint32(15)  # a plain linear map orders neighbours alike
            v *= np.uint32(0x2C1B3C6D)
            out[full, p] = np.minimum.reduceat(v, starts)
    return out


def least_matches(threshold: float, miss: float, batch: int = BATCH, total: int = PERMS) -> list[int]:
    """Per batch end n: the fewest equal minima m with P(similarity >= threshold | m of n) >= miss."""
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            # P(Beta(1+m, 1+n-m) >= t) = P(Binomial(n+1, t) <= m)
            tail = sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
            if tail >= miss:
                out.append(m)
                break
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int], batch: int = BATCH) -> np.ndarray:
    """Indices of signature pairs a[i], b[i] that no batch prunes."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        s = slice(k * batch, (k + 1) * batch)
        equal = equal + (a[alive, s] == b[alive, s]).sum(1)
        ok = equal >= m
        alive, equal = alive[ok], equal[ok]
    return alive


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y| of sorted distinct arrays."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = int(T.in_sorted(x, y).sum()) if len(x) < len(y) else int(T.in_sorted(y, x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _describe(k: int):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in T.blocks(None, batch.column(2), 1 << 18):
                sets = shingle_sets(buf, offs, k)
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([row.tobytes() for row in sig], pa.binary()),
                    ],
                    names=["doc_id", "row", "n", "key", "sig"],
                )

    return run


def _beside(edges: DataFrame, payload: DataFrame, kind: str) -> DataFrame:
    """Rows (star, salt, kind, id, payload): each star's payload once per salt, then its members'.

    A star with many members is dealt to many salts, so no task holds them all.
    """
    count = edges.groupBy("star").agg(F.count(F.lit(1)).alias("c")).select("star", F.ceil(F.col("c") / SALT).cast("int").alias("salts"))
    # the links of a star with several salts are dealt to several tasks here too
    many = count.where("salts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(MEMBER_SALTS - 1))))
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(MEMBER_SALTS)).cast("int"))
    salted = dealt.join(many, ["star", "part"], "left").select("star", F.pmod(F.xxhash64("id", F.lit(7)), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "id")
    wanted = salted.select("id").distinct()
    members = salted.join(only_wanted(payload.withColumnRenamed("node", "id"), "id", wanted), "id").select("star", "salt", F.lit(1).alias("kind"), "id", kind)
    stars = only_wanted(payload.withColumnRenamed("node", "star"), "star", count).select("star", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("star").alias("id"), kind)
    return stars.union(members).repartition("star", "salt").sortWithinPartitions("star", "salt", "kind", "id")


PAIR = pa.schema([("id", pa.int64()), ("star", pa.int64())])


def _pairs_out(ids, stars):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(stars, pa.int64())], schema=PAIR)


def _prune(least: list[int]):
    """Of sorted (star, salt, kind, id, sig) rows: the pairs that survive their signatures."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            star, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            sig = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(-1, PERMS)
            heads = np.flatnonzero(kind == 0)
            # the star row of each member: in this batch, or the last one of the batch before
            at = np.searchsorted(heads, np.arange(len(star)), side="right") - 1
            table = np.concatenate([held["sig"][None] if held else np.zeros((1, PERMS), np.uint32), sig[heads]])
            rows = np.flatnonzero(kind == 1)
            keep = rows[survivors(sig[rows], table[at[rows] + 1], least)]
            if len(heads):
                held["sig"] = sig[heads[-1]].copy()
            if len(keep):
                yield _pairs_out(ids[keep], star[keep])

    return run


def _verify(k: int, percent: int):
    """Of sorted (star, salt, kind, id, text) rows: the links."""

    def run(batches):
        now = np.zeros(0, np.uint64)
        for batch in batches:
            star, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            got: list[int] = []
            for lo, hi, buf, offs in T.blocks(None, batch.column(4), 1 << 19):
                for row, own in zip(range(lo, hi), shingle_sets(buf, offs, k), strict=True):
                    if kind[row] == 0:
                        now = own
                    elif linked(now, own, percent):
                        got.append(row)
            if got:
                yield _pairs_out(ids[got], star[got])

    return run


def _sets(k: int):
    """(node, set, s) of texts: the shingle set as bytes, and as an array."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in T.blocks(None, batch.column(1), 1 << 18):
                sets = shingle_sets(buf, offs, k)
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["node", "set", "s"])

    return run


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, s): of each set's shingles, ranked by how many sets have them, the rarest that a partner must share one of.

    A pair at the threshold has at least ceil(percent * n / 100) of either set in
    common, so it meets in the first n - that + 1.  Shingles of one set only count
    in the rank but are left out; those of more than ``FREQUENT`` sets rank last, by
    their hash, and aren't joined with their counts.
    """
    rows = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("s"))
    common = _scratch.table(rows.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shingles")
    # any order of shingles will do that is the same for all sets: the bitmap's errors depend on the shingle alone
    known = marked(rows, "s", common.where(F.col("c") > FREQUENT).select("s"))
    often = known.where("_maybe").select("node", "n", "s", F.lit(FREQUENT + 1).cast("long").alias("c"))
    seldom = known.where(~F.col("_maybe")).select("node", "n", "s").join(common, "s").select("node", "n", "s", "c")
    own = Window.partitionBy("node")
    ranked = often.unionByName(seldom).withColumn("rank", F.row_number().over(own.orderBy("c", "s"))).withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own))
    room = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    return ranked.where(F.col("alone") + F.col("rank") <= room).select("node", "s")


def block_links(ids, comp, side, sig, sets, least, percent):
    """Verified links among the members of one pair of blocks, at most one per merge.

    side: 0 and 1 for members of the two blocks, all 0 if they are the same.
    Only pairs of different components are looked at, likeliest first; a link
    joins components, which spares their other pairs.
    """
    parent: dict[int, int] = {c: c for c in comp.tolist()}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    same = not len(right)
    out, found = [], []
    for i in left.tolist():
        others = left[left > i] if same else right
        others = others[comp[others] != comp[i]]
        if not len(others):
            continue
        others = others[survivors(np.broadcast_to(sig[i], (len(others), PERMS)), sig[others], least)]
        if len(others):
            equal = (sig[others] == sig[i]).sum(1)
            found += zip((-equal).tolist(), [i] * len(others), others.tolist(), strict=True)
    for _, i, j in sorted(found):
        a, b = find(int(comp[i])), find(int(comp[j]))
        if a != b and linked(sets[i], sets[j], percent):
            parent[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


def _block_links(least, percent):
    def run(table: pa.Table) -> pa.Table:
        ids, comp, side = (table.column(c).to_numpy() for c in ("id", "comp", "side"))
        order = np.lexsort((ids, side))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, PERMS)[order]
        raw = table.column("set").to_pylist()
        sets = [np.frombuffer(raw[k], np.uint64) for k in order]
        got = block_links(ids[order], comp[order], side[order], sig, sets, least, percent)
        return pa.table({"id": pa.array([g[0] for g in got], pa.int64()), "star": pa.array([g[1] for g in got], pa.int64())})

    return run


def row_id(doc_id, text) -> Column:
    """64 bits of a row's id and text."""
    return F.xxhash64(doc_id, text)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set holds its distinct
    runs of ``shingle`` words, or its whole sequence if it has fewer.  Documents are
    linked where 100 * intersection >= percent * union; component_id is the
    smallest id reachable, and the row with that id is kept.  A null or empty
    text has no shingles and links with nothing, so it stays; rows with the same
    id but other texts are documents of their own; a null id counts in its group, but
    only non-null ids name it: a group of null ids has a null component and stays
    whole; other columns are ignored; an empty table gives an empty result.
    """
    return _groups(docs, id_col, text, shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _candidates(groups: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(pairs id, star of groups up to WIDE, members of larger ones) where a group (key, node, comp) still holds several components."""
    live = groups.groupBy(key).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).where("low != high").select(key, "size")
    # a group may be large: its members are dealt to several tasks
    live = live.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(MEMBER_SALTS - 1))))
    dealt = groups.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(13)), F.lit(MEMBER_SALTS)).cast("int"))
    members = _scratch.table(dealt.join(live, [key, "salt"]).drop("salt"), "members")
    small = members.where(F.col("size") <= WIDE)
    a, b = (small.select(key, F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in ("id", "star"))
    pairs = a.join(b, key).where("star < id and comp_id != comp_star").select("id", "star").distinct()
    return pairs, members.where(F.col("size") > WIDE)


def _groups(docs: DataFrame, id_col: str, text: str, shingle: int, percent: int) -> DataFrame:
    """near_duplicates, with row, a hash of id and text."""
    share_seed(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", row_id("doc_id", "text")).select("doc_id", "row", "text")
    described = _scratch.table(src.mapInArrow(C.settled(_describe(shingle)), "doc_id long, row long, n long, key binary, sig binary"), "signatures")
    # a class's node is one of its rows; its name the smallest id
    classes = described.where("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("sig").alias("sig"))
    nodes = _scratch.table(classes, "nodes")
    least = least_matches(percent / 100, MISS)
    sigs = nodes.select("node", "sig")

    width = 4 * ROWS
    keys = F.array(*(F.xxhash64(F.substring("sig", 1 + b * width, width), F.lit(b)) for b in range(BANDS)))
    bands = nodes.select("node", F.explode(keys).alias("band"))
    # bands with several members only: all later steps read this table
    leads = _scratch.table(bands.groupBy("band").agg(F.min("node").alias("star"), F.max("node").alias("last")).where("star != last").drop("last"), "leads")
    shared = _scratch.table(only_wanted(bands, "band", leads), "shared")
    _scratch.drop(leads)
    first = _scratch.table(shared.where("node != star").select(F.col("node").alias("id"), "star").distinct(), "pairs")

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        """(node, text) of the wanted nodes, each once."""
        rows = only_wanted(src.select(F.col("row").alias("node"), "text"), "node", wanted)
        return _scratch.table(rows.dropDuplicates(["node"]), name)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        alive = _scratch.table(_beside(pairs, sigs, "sig").mapInArrow(C.settled(_prune(least)), "id long, star long"), f"{name}-alive")
        texts = texts_of(alive.select(F.col("id").alias("node")).union(alive.select(F.col("star").alias("node"))).distinct(), f"{name}-texts")
        links = _scratch.table(_beside(alive, texts, "text").mapInArrow(C.settled(_verify(shingle, percent)), "id long, star long"), f"{name}-links")
        _scratch.drop(alive, texts)
        return links

    links = confirmed(first, "first")
    label = components(links.select(F.col("id").alias("a"), F.col("star").alias("b")))
    labelled = shared.join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("comp"))
    rest, wide = _candidates(labelled, "band")
    chosen = _scratch.table(wide.select("node", "comp").distinct(), "wide")
    if chosen.limit(1).count():
        sets = _scratch.table(texts_of(chosen.select("node"), "wide-texts").mapInArrow(C.settled(_sets(shingle)), "node long, set binary, s array<long>"), "sets")
        more, wide = _candidates(prefixes(sets, percent).join(chosen, "node"), "s")
        rest = rest.unionByName(more).distinct()
        if wide.limit(1).count():
            n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
            dealt = wide.select("s", "node", "comp", n_blocks.alias("nb"), F.pmod(F.xxhash64("node", F.lit(11)), n_blocks).cast("int").alias("own"))
            other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
            blocks = dealt.select("s", F.col("node").alias("id"), "comp", "own", other)
            blocks = blocks.select("s", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), F.when(F.col("own") > F.col("o"), 1).otherwise(0).alias("side"), "id", "comp")
            full = only_wanted(sigs, "node", wide.select("node").distinct()).join(sets.select("node", "set"), "node").withColumnRenamed("node", "id")
            got = blocks.join(full, "id").groupBy("s", "i", "j").applyInArrow(_block_links(least, percent), "id long, star long")
            links = links.union(_scratch.table(got, "wide-links"))
    links = links.union(confirmed(_scratch.table(rest.join(first, ["id", "star"], "left_anti"), "rest"), "rest"))

    final = components(links.select(F.col("id").alias("a"), F.col("star").alias("b")))
    named = nodes.select("key", "node", "least", "size").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = _scratch.table(named.join(names, "component").select("key", "component_id", "size"), "classes")
    _scratch.drop(shared, first, nodes)
    # the largest classes are broadcast, a bounded number, so that no key of the join is hot
    hot = by_key.orderBy(F.desc("size"), "key").limit(HOT_CLASSES).select("key", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    rows = described.select("doc_id", "row", "n", "key")
    split = rows.where("n > 0").join(F.broadcast(hot), "key", "left")
    done = split.where("hot").select("doc_id", "row", "n", F.col("hot_id").alias("component_id"))
    cold = split.where("hot is null").select("doc_id", "row", "n", "key").join(by_key, "key").select("doc_id", "row", "n", "component_id")
    empty = rows.where("n = 0").select("doc_id", "row", "n", F.col("doc_id").alias("component_id"))
    out = done.unionByName(cold).unionByName(empty)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, all columns unchanged.

    Decided per row, by id and text: other texts of a null or repeated id stay or
    go by themselves, rows that repeat both alike; null and empty texts stay; an
    empty table stays empty.
    """
    gone = _groups(docs, id_col, text, shingle, percent).where(~F.col("kept")).select(F.col("row").alias("_row")).distinct()
    return without(docs, {"_row": row_id(F.col(id_col).cast("long"), F.col(text))}, _scratch.table(gone, "gone"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all `documents`: 3-word shingles, similarity 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)
