"""Fusing fragments that always stand side by side.

Two fragments with the same number of applications, of which each one of the left is
followed at once by one of the right, can be one.  Such pairs form chains: a
fragment has at most one on either side.  Chains are found by pointer jumping over the table of pairs:
every fragment points to its left neighbour, and in each round to what
that one points to, adding up the tokens between; so a chain of n takes log2(n)
rounds of one join, and nothing is walked one by one.

Collections of bounded size take their rounds together, a batch of collections at once, in arrays
(``chain_batch``); larger ones take rounds of joins.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import scratch
from palimpsest.operators import grammar, index, kernels, optimise, versioned

#: Tokens up to which a collection's chains are found in a batch; larger ones take rounds of joins.
GROUP_TOKENS = 1_000_000
#: Tokens of the collections that are taken together.
BATCH_TOKENS = 1 << 18


def numbered(collection: np.ndarray, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(frag, first): a number for each distinct (collection, digest), and a place that has it."""
    parts = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((parts[:, 1], parts[:, 0], collection))
    new = np.ones(len(order), bool)
    c, p = collection[order], parts[order]
    new[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1]).any(axis=1)
    frag = np.zeros(len(order), np.int64)
    frag[order] = np.cumsum(new) - 1
    return frag, order[new]


def chain_batch(frag: np.ndarray, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, rank, shift) of each fragment, as in chains(); length: tokens of each fragment.

    frag: the fragments 0, 1, ... that tile versions, from left to right, in whole collections; row: each place's version.
    """
    order = np.argsort(frag, kind="stable")
    heads = np.flatnonzero(np.diff(frag[order], prepend=-1))

    def sole(beside):
        # the one fragment that is always there, or -1
        x = beside[order]
        return np.where(np.minimum.reduceat(x, heads) == np.maximum.reduceat(x, heads), x[heads], -1) if len(heads) else x

    met = row[1:] == row[:-1]
    after, before = np.full(len(frag), -1), np.full(len(frag), -1)
    after[:-1][met], before[1:][met] = frag[1:][met], frag[:-1][met]
    after, before = sole(after), sole(before)
    head = np.arange(len(heads))
    right = np.flatnonzero(before >= 0)
    right = right[after[before[right]] == right]
    head[right] = before[right]
    rank, shift = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
    rank[right], shift[right] = 1, length[head[right]]
    while (head[head] != head).any():
        rank, shift, head = rank + rank[head], shift + shift[head], head[head]
    return head, rank, shift


def chains(apps: DataFrame) -> DataFrame:
    """collection, id, head, rank, shift: each fragment's chain by its first fragment, its number in it and its first token there.

    apps: collection, id, version, offset, len, which tile each version.  A fragment that can't be fused is a chain of itself.
    """
    beside = Window.partitionBy("collection", "version").orderBy("offset")
    placed = apps.select("collection", "id", "len", F.lag("id").over(beside).alias("before"), F.lead("id").over(beside).alias("after"))
    sole = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    one = scratch.table(placed.groupBy("collection", "id").agg(F.first("len").cast("long").alias("len"), sole("before"), sole("after")), "fragments")
    left = one.where("after is not null").select("collection", F.col("id").alias("before"), F.col("after").alias("id"), F.col("len").alias("tokens"))
    met = one.where("before is not null").select("collection", "id", "before").join(left, ["collection", "before", "id"])
    now = scratch.table(met.select("collection", "id", F.col("before").alias("at"), F.lit(1).alias("hops"), "tokens"), "pointers")
    while True:
        behind = now.select("collection", F.col("id").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("tokens").alias("more_tokens"))
        jumped = now.join(behind, ["collection", "at"], "left")
        jumped = jumped.select("collection", "id", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), (F.col("tokens") + F.coalesce("more_tokens", F.lit(0))).alias("tokens"), F.col("next").isNotNull().alias("moved"))
        then = scratch.table(jumped, "pointers")
        moved = then.where("moved").limit(1).count()
        scratch.drop(now)
        now = then.drop("moved")
        now._scratch_path = then._scratch_path
        if not moved:
            break
    found = one.select("collection", "id").join(now, ["collection", "id"], "left")
    return found.select("collection", "id", F.coalesce("at", "id").alias("head"), F.coalesce("hops", F.lit(0)).alias("rank"), F.coalesce("tokens", F.lit(0)).cast("long").alias("shift"))


def _rows(found: versioned.VersionedIndex) -> tuple[DataFrame, DataFrame]:
    """(collection, head, hash, len, size, first of the fused fragments; head, toks of them)."""
    apps = found.metadata.join(found.dictionary.select("frag_id", "len"), "frag_id").select("collection", F.col("frag_id").alias("id"), "version", "offset", "len")
    apps = scratch.table(apps, "applications")
    chain = scratch.table(chains(apps), "chains")
    named = found.dictionary.join(chain.select(F.col("id").alias("frag_id"), "head", "rank", "shift"), "frag_id")
    members = F.array_sort(F.collect_list(F.struct("rank", "hash")))
    whole = named.groupBy("collection", "head").agg(F.sum("len").alias("len"), F.min(F.struct("rank", "size", "first")).alias("x"), members.alias("m"))
    fused_hash = F.when(F.size("m") == 1, F.col("m")[0]["hash"]).otherwise(F.md5(F.array_join(F.col("m.hash"), " ")))
    rows = whole.select("collection", "head", fused_hash.alias("hash"), "len", F.col("x.size").alias("size"), F.col("x.first").alias("first"))
    texts = index.texts(found.postings) if found.texts is None else found.texts.withColumnRenamed("frag_id", "docid")
    moved = texts.join(chain.select(F.col("id").alias("docid"), "head", "rank"), "docid")
    return rows, moved.groupBy("head").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "toks"))), lambda x: x["toks"])).alias("toks"))


def fuse(found: versioned.VersionedIndex) -> versioned.VersionedIndex:
    """The same index over fused fragments: fewer ids and applications, the same postings in them.

    A fused fragment's hash is the MD5 of its members' hashes; ids are dense again, in order of collection and first application.
    """
    rows, texts = _rows(found)
    dictionary = scratch.table(versioned.with_ids(scratch.table(rows, "fused")), "fused")
    ids = dictionary.select("head", F.col("frag_id").alias("new_id"))
    metadata = found.metadata.join(ids, found.metadata["frag_id"] == ids["head"]).select(F.col("new_id").alias("frag_id"), "collection", "version", "offset")
    postings = index.build_texts(texts.join(ids, "head").select(F.col("new_id").alias("frag_id"), "toks"), "frag_id", dictionary.count())
    return versioned.VersionedIndex(found.chosen, dictionary.drop("head"), metadata, postings)


def _fused(table: pa.Table, windows) -> pa.RecordBatch:
    """FUSED rows of a batch of whole collections (collection, version, toks), versions in order."""
    toks = table.column("toks").combine_chunks()
    collection, version = grammar.numbers_of(table.column("collection")), table.column("version").to_numpy()
    j, cuts = _cuts(toks, windows)
    many = int(collection.max()) + 1
    best, chosen = np.full(many, np.iinfo(np.int64).max), np.zeros(many, np.int64)
    for k in np.argsort(windows, kind="stable").tolist():
        row, _, length, digests = cuts[k]
        c = collection[row]
        _, first = numbered(c, digests)
        tokens, frags = np.bincount(c[first], length[first], many).astype(np.int64), np.bincount(c[first], minlength=many)
        cost = optimise.cost(tokens, frags, np.bincount(c, minlength=many))
        chosen[cost < best] = k
        best = np.minimum(best, cost)
    own = [np.flatnonzero(chosen[collection[row]] == k) for k, (row, *_) in enumerate(cuts)]
    row, start, length = (np.concatenate([cuts[k][i][x] for k, x in enumerate(own)]) for i in range(3))
    digests = [cuts[k][3][i] for k, x in enumerate(own) for i in x.tolist()]
    order = np.lexsort((start, row))
    row, start, length, digests = row[order], start[order], length[order], [digests[i] for i in order.tolist()]
    frag, first = numbered(collection[row], digests)
    head, rank, _ = chain_batch(frag, row, length[first])
    # members in order of their chains
    m = np.lexsort((rank, head))
    heads = np.flatnonzero(np.diff(head[m], prepend=-1))
    named = [digests[k].hex() for k in first[m].tolist()]
    hashes = [named[a] if b == a + 1 else md5(" ".join(named[a:b]).encode()).hexdigest() for a, b in zip(heads.tolist(), np.append(heads, len(m))[1:].tolist(), strict=True)]
    total = np.add.reduceat(length[first[m]], heads)
    led = head[m][heads]
    lead = first[led]
    begin = j.offs[:-1][row[lead]] + start[lead]
    texts = [j.raw[a:b].decode() for a, b in zip(j.start[begin].tolist(), j.end[begin + total - 1].tolist(), strict=True)]
    places = np.flatnonzero(head[frag] == frag)
    places = places[np.argsort(frag[places], kind="stable")]
    size = np.bincount(frag)[led]
    at = lambda p: pa.StructArray.from_arrays([pa.array(version[row[p]]), pa.array(start[p].astype(np.int32))], names=["version", "offset"])
    w = np.array([float(x) for x in windows])[chosen[collection[row[lead]]]]
    cols = [table.column("collection").combine_chunks().take(pa.array(row[lead])), pa.array(w), pa.array(hashes, pa.string()), pa.array(total), pa.array(size), at(lead), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays([*cols, kernels.to_lists(at(places), np.concatenate([[0], np.cumsum(size)]), None)], names=["collection", "w", "hash", "len", "size", "first", "text", "apps"])


FUSED = "w double, hash string, len long, size long, first struct<version: long, offset: int>, text string, apps array<struct<version: long, offset: int>>"


def build(small: DataFrame, large: DataFrame | None, windows) -> versioned.VersionedIndex:
    """fuse() of the versioned index, for rows (collection, version, text, n) as of numbered texts.

    small: collections of bounded size, versions side by side and in order; they are cut, compared and fused in batches, and only
    fused fragments leave the map.  large: all others, which take joins.
    """
    kind = small.schema["collection"].dataType.simpleString()
    arrays = lambda rows: rows.where("n > 0").select("collection", "version", "n", grammar.toks_of().alias("toks"))

    def run(batches):
        for table in kernels.whole_groups(batches, BATCH_TOKENS):
            yield _fused(table, windows)

    made = scratch.table(arrays(small).mapInArrow(run, f"collection {kind}, {FUSED}"), "fused")
    every, found = made.withColumn("head", F.lit(None).cast("long")), None
    if large is not None:
        found = versioned.build(arrays(large), windows)
        rows, texts = _rows(found)
        rows = rows.join(texts, "head").join(found.chosen, "collection").select("collection", "w", "hash", "len", "size", "first", F.array_join("toks", " ").alias("text"), F.lit(None).cast(made.schema["apps"].dataType).alias("apps"), "head")
        every = every.unionByName(scratch.table(rows, "fused"))
    named = scratch.table(versioned.with_ids(every), "dictionary")
    scratch.drop(made)
    metadata = named.select("frag_id", "collection", F.explode("apps").alias("a")).select("frag_id", "collection", "a.*")
    if found is not None:
        ids = named.where("head is not null").select("head", F.col("frag_id").alias("new_id"))
        metadata = metadata.unionByName(found.metadata.join(ids, found.metadata["frag_id"] == ids["head"]).select(F.col("new_id").alias("frag_id"), "collection", "version", "offset"))
    dictionary = named.drop("w", "text", "apps", "head")
    # fused fragments may be long
    blocks = dictionary.groupBy(index.block_of("frag_id").alias("block")).agg(F.sum("len").alias("tokens"), F.count(F.lit(1)).alias("n"))
    most = blocks.agg(F.max("tokens").alias("tokens"), F.sum("n").alias("n")).first()
    whole, n = (most["tokens"] or 0) <= index.BLOCK_TOKENS, most["n"] or 0
    if whole:
        postings = index.build_blocks(named.select("frag_id", "text", F.col("len").alias("n")), "frag_id", n)
    else:
        postings = index.build_texts(named.select("frag_id", F.split("text", " ").alias("toks")), "frag_id", n)
    return versioned.VersionedIndex(named.select("collection", "w").distinct(), dictionary, metadata, postings, whole=whole)


def groups(apps: DataFrame) -> DataFrame:
    """collection, head, id, rank, n: the members of chains of several fragments, n each."""
    n = F.count(F.lit(1)).over(Window.partitionBy("collection", "head"))
    return chains(apps).withColumn("n", n).where("n > 1").select("collection", "head", "id", "rank", "n")


def _cuts(toks: pa.ListArray, windows) -> tuple[kernels.Joined, list]:
    """The tokens of a batch, and (row, start, length, digest) of the winnowed fragments of its versions at each window."""
    h, at = kernels.gram_hashes(toks)
    j = kernels.Joined(toks)
    n = np.diff(j.offs)
    out = []
    for w in windows:
        start, offs = kernels.winnowed(h, at, n, w)
        row = np.repeat(np.arange(len(n)), np.diff(offs))
        end = np.append(start[1:], 0)[: len(start)]
        last = np.append(row[1:] != row[:-1], True)[: len(row)]
        end[last] = n[row[last]]
        base = j.offs[:-1][row]
        out.append((row, start, end - start, j.digest(base + start, base + end - 1)))
    return j, out


def _groups_of(table: pa.Table, window: int) -> pa.RecordBatch:
    """groups() of a batch of whole collections (collection, toks)."""
    _, ((row, _, length, digests),) = _cuts(table.column("toks").combine_chunks(), (window,))
    frag, first = numbered(grammar.numbers_of(table.column("collection"))[row], digests)
    head, rank, _ = chain_batch(frag, row, length[first])
    n = np.bincount(head, minlength=len(head))[head] if len(head) else head
    own = np.flatnonzero(n > 1)
    named = pa.array([digests[k].hex() for k in first.tolist()], pa.string())
    cols = [table.column("collection").combine_chunks().take(pa.array(row[first[own]])), named.take(pa.array(head[own])), named.take(pa.array(own)), pa.array(rank[own]), pa.array(n[own])]
    return pa.RecordBatch.from_arrays(cols, names=["collection", "head", "id", "rank", "n"])


def window_groups(texts: DataFrame, window: int) -> DataFrame:
    """groups() of the winnowed fragments of texts (collection, version, text, n), stored, see grammar.stored_texts.

    Copies of a version change no chain, so collections that are large by their copies count without them.
    """
    small, large = grammar.folded_by_size(texts, GROUP_TOKENS)
    kind = texts.schema["collection"].dataType.simpleString()

    def run(batches):
        for table in kernels.whole_groups(batches, BATCH_TOKENS):
            yield _groups_of(table, window)

    out = grammar.side_by_side(small).mapInArrow(run, f"collection {kind}, head string, id string, rank long, n long")
    if large is None:
        return out
    rows = large.select("collection", "version", grammar.toks_of().alias("toks"))
    cut = versioned.fragment_rows(rows, (window,))
    # the chains read them several times
    apps = scratch.table(cut.select("collection", F.col("hash").alias("id"), "version", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("len")), "fragments")
    return out.unionByName(groups(apps).withColumn("rank", F.col("rank").cast("long")))
