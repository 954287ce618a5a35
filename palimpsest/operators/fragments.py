"""Fragments: distinct token runs of a collection, their applications, scores and covers."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import scratch
from palimpsest.operators import greedy, intervals


def cut_tokens(block_rows: DataFrame, arrays: DataFrame, *keys: str) -> DataFrame:
    """Blocks with hash, the MD5 of their tokens, and len."""
    run = F.slice("toks", F.col("start") + 1, F.col("end") - F.col("start"))
    return block_rows.join(arrays.select(*keys, "toks"), [*keys]).select(*block_rows.columns, F.md5(F.array_join(run, " ")).alias("hash"), (F.col("end") - F.col("start")).alias("len"))


def dictionary(cut: DataFrame, collection: str = "collection") -> DataFrame:
    """One row per distinct fragment of a collection: hash, len, size (applications), first version and offset.

    The same place may be cut alike on several levels; it counts once.
    """
    places = cut.select(collection, "hash", "len", "version", F.col("start").alias("offset")).distinct()
    return places.groupBy(collection, "hash").agg(F.first("len").alias("len"), F.count(F.lit(1)).alias("size"), F.min(F.struct("version", "offset")).alias("first"))


def score(length: Column, size: Column, w: Column) -> Column:
    """Saved postings per cost: len * size / (1 + len + w * (1 + size))."""
    return length * size / (1 + length + w * (1 + size))


def grammar_score(length: Column, size: Column, w: Column) -> Column:
    """The variant whose index cost ignores the length."""
    return length * size / (1 + w * (1 + size))


def overlaps(block_rows: DataFrame, *keys: str) -> DataFrame:
    """keys, a, b: pairs (a < b by id) of overlapping blocks of a version, by a sweep (``intervals``)."""
    return intervals.overlapping(block_rows, keys, "id").select(*keys, F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def cover(frags: dict, w: float, grammar: bool = False, copies: dict | None = None) -> list[tuple]:
    """Greedy non-overlapping cover of one collection.

    frags: fragment -> (len, [(version, offset), ...]); copies: how many equal versions
    one stands for, 1 if not told; an application counts that often.  The best fragment is
    taken with its live applications, first ones first; every application that
    overlaps a taken one is void.  Sizes only shrink and scores with them, so a
    stale heap entry is an upper bound and may be re-scored when it is popped.
    Ties go by first version, first offset, length, fragment.
    Returns (rank, fragment, version, offset, len).
    """

    def rate(n: int, now: list) -> float:
        size = sum(copies.get(v, 1) for v, _ in now) if copies else len(now)
        return n * size / (1 + (0 if grammar else n) + w * (1 + size))

    taken: dict[int, bytearray] = {}
    for n, apps in frags.values():
        for v, o in apps:
            have = taken.setdefault(v, bytearray())
            if len(have) < o + n:
                have.extend(bytes(o + n - len(have)))

    def live(n, apps):
        out, until = [], {}
        for v, o in apps:
            if o >= until.get(v, 0) and not any(taken[v][o : o + n]):
                out.append((v, o))
                until[v] = o + n
        return out

    heap = []
    for f, (n, apps) in frags.items():
        apps = sorted(apps)
        now = live(n, apps)
        heapq.heappush(heap, (-rate(n, now), now[0], n, f, now))
    out, rank = [], 0
    while heap:
        key, first, n, f, apps = heapq.heappop(heap)
        now = live(n, apps)
        if not now:
            continue
        if len(now) < len(apps) or now[0] != first:
            heapq.heappush(heap, (-rate(n, now), now[0], n, f, now))
            continue
        for v, o in now:
            taken[v][o : o + n] = b"\1" * n
            out.append((rank, f, v, o, n))
        rank += 1
    return out


COVER = "w double, rank int, hash string, version long, offset int, len int"


def fold(arrays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, members) of equal versions of a collection.

    representatives: collection, version (the first of its class), toks, copies;
    members: collection, version (of the representative), member, all of them.
    """
    named = arrays.select("collection", "version", "toks", F.md5(F.array_join("toks", " ")).alias("_c"))
    classes = named.groupBy("collection", "_c").agg(F.min("version").alias("least"), F.count(F.lit(1)).alias("copies"))
    both = named.join(classes, ["collection", "_c"])
    members = both.select("collection", F.col("least").alias("version"), F.col("version").alias("member"))
    return both.where("version = least").select("collection", "version", "toks", "copies"), members


def unfold(covers: DataFrame, members: DataFrame) -> DataFrame:
    """A cover of representatives, given to every member of their classes."""
    return covers.join(members, ["collection", "version"]).drop("version").withColumnRenamed("member", "version").select("collection", "w", "rank", "hash", F.col("version").cast("long").alias("version"), "offset", "len")


#: Places up to which a collection is covered by one call of ``cover``; larger ones take rounds of joins, with the same result.
GROUP_PLACES = 200_000


def select_covers(cut: DataFrame, weights: list[float], grammar: bool = False, copies: DataFrame | None = None, group_places: int | None = None) -> DataFrame:
    """collection, w, rank, hash, version, offset, len: the cover of each collection at each weight.

    Equal versions may be folded before (``fold``; copies: collection, version, copies).
    Collections of at most ``group_places`` places are covered one by one, a bounded group per
    collection and weight; all larger ones by rounds over all tasks
    (``greedy``), where no group holds a collection.  A collection without candidates has no cover.
    """
    limit = GROUP_PLACES if group_places is None else group_places
    places = cut.select("collection", "hash", "len", "version", F.col("start").alias("offset")).distinct()
    places = places.withColumn("copies", F.lit(1).cast("long")) if copies is None else places.join(copies.select("collection", "version", "copies"), ["collection", "version"])
    places = scratch.table(places, "places")
    large = places.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("collection")
    kind = cut.schema["collection"].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        frags: dict = {}
        for h, n, v, o in zip(df["hash"], df["len"], df["version"], df["offset"], strict=True):
            frags.setdefault(h, (int(n), []))[1].append((int(v), int(o)))
        w = float(df["w"].iloc[0])
        many = {int(v): int(c) for v, c in zip(df["version"], df["copies"], strict=True) if c > 1}
        rows = cover(frags, w, grammar, many)
        return pd.DataFrame([(df["collection"].iloc[0], w, *r) for r in rows], columns=["collection", "w", "rank", "hash", "version", "offset", "len"])

    many = large.limit(1).count() > 0
    spread = (places.join(large, "collection", "left_anti") if many else places).withColumn("w", F.explode(F.array(*(F.lit(float(w)) for w in weights))))
    out = spread.groupBy("collection", "w").applyInPandas(run, f"collection {kind}, {COVER}")
    return out.unionByName(greedy.covers_in_rounds(places.join(large, "collection", "left_semi"), list(weights), grammar)) if many else out


def tradeoff(covers: DataFrame) -> DataFrame:
    """collection, w, n_apps, n_frags, n_postings of each cover."""
    firsts = F.sum(F.when(F.col("app") == 1, F.col("len")).otherwise(0))
    numbered = covers.withColumn("app", F.row_number().over(Window.partitionBy("collection", "w", "rank").orderBy("version", "offset")))
    return numbered.groupBy("collection", "w").agg(F.count(F.lit(1)).alias("n_apps"), F.sum(F.when(F.col("app") == 1, 1).otherwise(0)).alias("n_frags"), firsts.alias("n_postings"))


def coverage_faults(covers: DataFrame, arrays: DataFrame) -> DataFrame:
    """Versions that a cover doesn't hold exactly once; none if all is well."""
    held = covers.groupBy("collection", "w", "version").agg(F.sum("len").alias("held"), F.array_sort(F.collect_list(F.struct("offset", "len"))).alias("apps"))
    held = held.withColumn("clash", F.expr("exists(sequence(1, greatest(size(apps) - 1, 1)), i -> i < size(apps) and apps[i - 1].offset + apps[i - 1].len > apps[i].offset)"))
    return held.join(arrays.select("collection", "version", F.size("toks").alias("n")), ["collection", "version"]).where("clash or held != n")


def hash_faults(covers: DataFrame, arrays: DataFrame) -> DataFrame:
    """Applications whose tokens don't have their fragment's hash; none if all is well."""
    run = F.slice("toks", F.col("offset") + 1, F.col("len"))
    return covers.join(arrays.select("collection", "version", "toks"), ["collection", "version"]).where(F.md5(F.array_join(run, " ")) != F.col("hash"))


def first_postings(covers: DataFrame, arrays: DataFrame) -> DataFrame:
    """collection, w, rank, pos, term: the postings of each chosen fragment, once, from its first application."""
    first = covers.groupBy("collection", "w", "rank").agg(F.min(F.struct("version", "offset", "len")).alias("f")).select("collection", "w", "rank", "f.*")
    run = F.slice("toks", F.col("offset") + 1, F.col("len"))
    return first.join(arrays.select("collection", "version", "toks"), ["collection", "version"]).select("collection", "w", "rank", F.posexplode(run).alias("pos", "term"))


def restore(covers: DataFrame, postings: DataFrame) -> DataFrame:
    """collection, w, version, toks: versions rebuilt from postings and applications alone."""
    runs = postings.groupBy("collection", "w", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("run"))
    parts = covers.join(runs, ["collection", "w", "rank"]).groupBy("collection", "w", "version").agg(F.array_sort(F.collect_list(F.struct("offset", "run"))).alias("parts"))
    return parts.select("collection", "w", "version", F.flatten("parts.run").alias("toks"))


def mergeable(apps: DataFrame) -> DataFrame:
    """collection, left_id, right_id: fragments that stand side by side, left before right, in every place.

    apps: collection, id, version, offset, len.  Both have the same number of
    applications, and each of the left one is followed at once by the right one.
    """
    count = apps.groupBy("collection", "id").agg(F.count(F.lit(1)).alias("n"))
    a = apps.select("collection", "version", F.col("id").alias("left_id"), (F.col("offset") + F.col("len")).alias("at"))
    b = apps.select("collection", "version", F.col("id").alias("right_id"), F.col("offset").alias("at"))
    met = a.join(b, ["collection", "version", "at"]).groupBy("collection", "left_id", "right_id").agg(F.count(F.lit(1)).alias("met"))
    left = count.select("collection", F.col("id").alias("left_id"), F.col("n").alias("n_left"))
    right = count.select("collection", F.col("id").alias("right_id"), F.col("n").alias("n_right"))
    return met.join(left, ["collection", "left_id"]).join(right, ["collection", "right_id"]).where("met = n_left and met = n_right").select("collection", "left_id", "right_id")
