"""The index of a versioned collection: tokens of each distinct fragment once, and where fragments stand.

A collection's windows are compared by cost; its versions are cut at the chosen
one.  Each distinct fragment has a global id, its postings are those of its
first application, and the metadata hold all applications.  A lookup finds
terms in fragments and resolves them to versions through the metadata.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import scratch
from palimpsest.operators import fragments, index, kernels, optimise


def prefix_sums(rows: DataFrame, key: str, amount: str, *levels: Column) -> DataFrame:
    """rows with base, the exclusive running sum of ``amount`` in order of the key.

    levels: prefixes of the key from coarse to fine, in key order.  Sums are taken per
    level, each inside the one above, so a task sorts the members of one prefix
    only, and the top level alone is one task: choose it small.
    """
    names = [f"_p{k}" for k in range(len(levels))]
    # each level reads them
    rows = scratch.table(rows, "amounts")
    placed = rows.select("*", *(c.alias(n) for c, n in zip(levels, names, strict=True)))
    out = placed
    for k in range(len(names)):
        inside = Window.partitionBy(*names[:k]) if k else Window.partitionBy()
        sums = placed.groupBy(*names[: k + 1]).agg(F.sum(amount).alias("_s"))
        before = F.coalesce(F.sum("_s").over(inside.orderBy(names[k]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.join(sums.withColumn(f"_b{k}", before).drop("_s"), names[: k + 1])
    own = Window.partitionBy(*names).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(amount).over(own), F.lit(0))
    for k in range(len(names)):
        base = base + F.col(f"_b{k}")
    return out.withColumn("base", base.cast("long")).select(*rows.columns, "base")


def hex_levels(key: str = "collection") -> tuple[Column, ...]:
    """Levels of keys in hex: 4096 prefixes, then 4096 in each."""
    return F.substring(key, 1, 3), F.substring(key, 1, 6)


def tradeoff(cut: DataFrame) -> DataFrame:
    """collection, w, n_apps, n_frags, n_postings of fragment rows (collection, w, hash, start, end)."""
    return totals(cut.groupBy("collection", "w", "hash").agg(F.first(F.col("end") - F.col("start")).alias("len"), F.count(F.lit(1)).alias("size")))


def totals(one: DataFrame) -> DataFrame:
    """The trade-off of distinct fragments (collection, w, hash, len, size)."""
    return one.groupBy("collection", "w").agg(F.sum("size").alias("n_apps"), F.count(F.lit(1)).alias("n_frags"), F.sum("len").cast("long").alias("n_postings"))


def fragment_rows(arrays: DataFrame, windows) -> DataFrame:
    """collection, version, w, idx, start, end, hash at each window."""
    keys = ("collection", "version")
    return kernels.with_fragments(arrays, windows, *keys).select(*keys, F.explode("frags").alias("f")).select(*keys, "f.*")


def with_ids(dictionary: DataFrame, *levels: Column) -> DataFrame:
    """The dictionary with frag_id: dense over all collections, in order of collection and first application."""
    order = Window.partitionBy("collection").orderBy("first.version", "first.offset")
    counts = dictionary.groupBy("collection").agg(F.count(F.lit(1)).alias("n_frags"))
    bases = prefix_sums(counts, "collection", "n_frags", *(levels or hex_levels())).select("collection", "base")
    ranked = dictionary.withColumn("_rank", F.row_number().over(order))
    return ranked.join(bases, "collection").withColumn("frag_id", F.col("base") + F.col("_rank") - 1).drop("_rank", "base")


@dataclass
class VersionedIndex:
    """chosen: collection, w; dictionary: collection, hash, len, size, first, frag_id; metadata: frag_id, collection, version, offset; postings: index blocks over frag_id.

    texts: frag_id, toks of the fragments, where a builder has them stored.  whole: blocks of postings stand side by side (index.build_blocks).
    """

    chosen: DataFrame
    dictionary: DataFrame
    metadata: DataFrame
    postings: DataFrame
    texts: DataFrame | None = None
    whole: bool = False


def windowed(arrays: DataFrame, windows) -> tuple[DataFrame, DataFrame]:
    """(collection, w) and the fragments at these windows: collection, version, alone, start, len, size, hash as bytes, toks.

    size: how often its version holds a fragment, told at the first place there, where toks are told too; 0 at all others.
    A collection of one version (alone) is judged where it stands.  Of all others the versions' distinct fragments are summed
    for each window, and only those at the chosen one are told.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("collection"))
    base = scratch.table(arrays.select("collection", "version", "toks").withColumn("n", n).where(F.size("toks") > 0), "versions")
    tried = kernels.with_trials(base.where("n = 1"), windows, "collection", "version")
    cheapest = F.array_min(F.transform("totals", lambda t: F.struct(optimise.cost(t["n_postings"], t["n_frags"], t["n_apps"]).alias("cost"), t["w"].alias("w"))))["w"]
    tried = tried.withColumn("w", cheapest)
    several = kernels.with_trials(base.where("n > 1"), windows, "collection", "version")
    each = several.select("collection", F.explode(F.filter("frags", lambda f: f["size"] > 0)).alias("f")).select("collection", "f.w", "f.hash", "f.len", "f.size")
    one = each.groupBy("collection", "w", "hash").agg(F.first("len").alias("len"), F.sum("size").alias("size"))
    best = scratch.table(optimise.best_by_cost(totals(one)).select("collection", "w"), "chosen")
    chosen = scratch.table(tried.select("collection", "w").unionByName(best), "chosen")
    both = tried.select("collection", "version", F.lit(True).alias("alone"), "toks", "frags", "w")
    both = both.unionByName(several.join(best, "collection").select("collection", "version", F.lit(False).alias("alone"), "toks", "frags", "w"))
    run = lambda f: F.when(f["size"] > 0, F.slice("toks", f["start"] + 1, f["len"])).alias("toks")
    own = F.transform(F.filter("frags", lambda f: f["w"] == F.col("w")), lambda f: F.struct(f["start"].alias("start"), f["len"].alias("len"), f["size"].alias("size"), f["hash"].alias("hash"), run(f)))
    rows = both.select("collection", "version", "alone", F.explode(own).alias("f")).select("collection", "version", "alone", "f.*")
    return chosen, scratch.table(rows, "fragments")


def build(arrays: DataFrame, windows, cut: DataFrame | None = None) -> VersionedIndex:
    """The index of (collection, version, toks); versions without tokens are in none of its tables.

    cut: fragments (collection, version, w, idx, start, end, hash) of any cutter, in place of winnowing at ``windows``.
    """
    if cut is not None:
        return build_cut(arrays, cut)
    chosen, own = windowed(arrays, windows)
    told = own.where("size > 0").select("collection", "hash", "len", "size", F.struct("version", F.col("start").alias("offset")).alias("first"), "alone", "toks")
    # equal hashes are equal tokens
    met = told.where("not alone").groupBy("collection", "hash").agg(F.first("len").alias("len"), F.sum("size").alias("size"), F.min("first").alias("first"), F.first("toks").alias("toks"))
    every = told.where("alone").drop("alone").withColumn("size", F.col("size").cast("long")).unionByName(met)
    named = scratch.table(with_ids(every).withColumn("hash", F.lower(F.hex("hash"))), "dictionary")
    ids = named.select("collection", F.unhex("hash").alias("hash"), "frag_id")
    metadata = own.select("collection", "hash", "version", F.col("start").alias("offset")).join(ids, ["collection", "hash"]).select("frag_id", "collection", "version", "offset")
    texts = named.select("frag_id", "toks")
    return VersionedIndex(chosen, named.drop("toks"), metadata, index.build_texts(texts, "frag_id", named.count()), texts)


def build_cut(arrays: DataFrame, cut: DataFrame) -> VersionedIndex:
    cut = scratch.table(cut, "fragments")
    chosen = optimise.best_by_cost(tradeoff(cut)).select("collection", "w")
    own = cut.join(chosen, ["collection", "w"]).withColumn("len", F.col("end") - F.col("start"))
    named = scratch.table(with_ids(scratch.table(fragments.dictionary(own), "dictionary")), "dictionary")
    metadata = own.join(named.select("collection", "hash", "frag_id"), ["collection", "hash"]).select("frag_id", "collection", "version", F.col("start").alias("offset"))
    first = named.select("frag_id", "collection", F.col("first.version").alias("version"), F.col("first.offset").alias("offset"), "len")
    texts = first.join(arrays.select("collection", "version", "toks"), ["collection", "version"]).select("frag_id", F.slice("toks", F.col("offset") + 1, F.col("len")).alias("toks"))
    return VersionedIndex(chosen, named, metadata, index.build(index.term_rows(texts, "frag_id"), "frag_id"))


def resolve(found: VersionedIndex, terms: list[str]) -> DataFrame:
    """term, collection, version, pos: every place of the terms in every version, through the applications."""
    hits = index.read(found.postings.where(F.col("term").isin(sorted(set(terms)))))
    return hits.join(found.metadata, hits["docid"] == found.metadata["frag_id"]).select("term", "collection", "version", (F.col("offset") + F.col("pos")).cast("long").alias("pos"))


def lookup_phrase(found: VersionedIndex, terms: list[str]) -> DataFrame:
    """collection, version, pos of a phrase, also where it crosses from one fragment to the next."""
    return index.phrase(resolve(found, terms), terms, "collection", "version")


def restored_texts(found: VersionedIndex) -> DataFrame:
    """collection, version, text: all versions rebuilt from the index alone, their tokens joined by spaces."""
    # one text is a third of its tokens in an exchange
    runs = index.block_texts(found.postings) if found.whole else index.texts(found.postings).select("docid", F.array_join("toks", " ").alias("text"))
    parts = found.metadata.join(runs.withColumnRenamed("docid", "frag_id"), "frag_id").groupBy("collection", "version").agg(F.array_sort(F.collect_list(F.struct("offset", "text"))).alias("parts"))
    return parts.select("collection", "version", F.array_join("parts.text", " ").alias("text"))


def restore(found: VersionedIndex) -> DataFrame:
    """collection, version, toks: all versions rebuilt from the index alone."""
    return restored_texts(found).select("collection", "version", F.split("text", " ").alias("toks"))
