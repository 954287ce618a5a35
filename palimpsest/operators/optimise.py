"""Choosing parameters: Pareto frontiers per collection, one weight each under a global budget."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import scratch


def frontier(rows: DataFrame, key: str = "collection") -> DataFrame:
    """Rows with strictly fewer postings than every row before them by (n_apps, n_postings)."""
    before = Window.partitionBy(key).orderBy("n_apps", "n_postings", "w").rowsBetween(Window.unboundedPreceding, -1)
    least = F.min("n_postings").over(before)
    return rows.withColumn("least", least).where(F.col("least").isNull() | (F.col("n_postings") < F.col("least"))).drop("least")


def unchanged(rows: DataFrame, key: str = "collection") -> DataFrame:
    """Collections whose postings don't depend on the parameter."""
    return rows.groupBy(key).agg(F.min("n_postings").alias("low"), F.max("n_postings").alias("high")).where("low = high").select(key, F.col("low").alias("n_postings"))


def steps(rows: DataFrame, key: str = "collection") -> DataFrame:
    """Pairs of rows of a collection, the second with more applications and fewer postings."""
    a = rows.select(key, F.col("w").alias("w_from"), F.col("n_apps").alias("apps_from"), F.col("n_postings").alias("post_from"))
    b = rows.select(key, F.col("w").alias("w_to"), F.col("n_apps").alias("apps_to"), F.col("n_postings").alias("post_to"))
    return a.join(b, key).where("apps_to > apps_from and post_to < post_from")


def cost(n_postings: Column, n_frags: Column, n_apps: Column) -> Column:
    return 2 * n_postings + 2 * n_frags + 2 * n_apps


def best_by_cost(rows: DataFrame, key: str = "collection") -> DataFrame:
    """The row of least cost, 2 * postings + 2 * fragments + 2 * applications, the smallest w among equals."""
    order = Window.partitionBy(key).orderBy("cost", "w")
    return rows.withColumn("cost", cost(F.col("n_postings"), F.col("n_frags"), F.col("n_apps"))).withColumn("r", F.row_number().over(order)).where("r = 1").select(key, "w", "cost")


def _rate(a, b) -> float:
    return (a[1] - b[1]) / (b[0] - a[0])


def next_steps(p: list, at: int, left: int) -> list[tuple[int, int, float]]:
    """(target, applications, rate) of the steps from row ``at`` on, one row at a time, up to the first that can't fit."""
    out: list[tuple[int, int, float]] = []
    for k in range(at + 1, len(p)):
        extra = p[k][0] - p[k - 1][0]
        if extra > left:
            break
        out.append((k, extra, _rate(p[k - 1], p[k])))
    return out


def next_jumps(p: list, at: int, left: int) -> list[tuple[int, int, float]]:
    """The same where a step may skip rows: from each row the jump of the best rate that can fit, the shortest among equals."""
    out: list[tuple[int, int, float]] = []
    while True:
        can = [(-_rate(p[at], p[k]), k) for k in range(at + 1, len(p)) if p[k][1] < p[at][1] and p[k][0] - p[at][0] <= left]
        if not can:
            return out
        rate, k = min(can)
        out.append((k, p[k][0] - p[at][0], -rate))
        at = k


def _spend(points: dict, at: dict, left: int, steps) -> dict:
    """The greedy spending of ``left`` from the rows ``at`` on: best rate first, equal rates by document."""
    heap: list = []

    def push(d):
        if found := steps(points[d], at[d], left):
            heapq.heappush(heap, (-found[0][2], d, found[0][0], found[0][1]))

    for d in points:
        push(d)
    while heap:
        _, d, k, extra = heapq.heappop(heap)
        if extra <= left:
            left -= extra
            at[d] = k
            push(d)
        elif steps is next_jumps:
            push(d)  # a smaller jump may fit
    return at


def _start(points: dict, budget: int):
    points = {d: sorted(p) for d, p in points.items()}
    left = budget - sum(p[0][0] for p in points.values())
    if left < 0:
        raise ValueError("the budget doesn't hold the smallest choice of every document")
    return points, left


def spend_marginal(points: dict, budget: int) -> dict:
    """Each document starts at its fewest applications; the best step of all (postings saved per application) is taken while it fits.

    points: document -> frontier rows (n_apps, n_postings, w).  A document whose step
    doesn't fit stays, others go on.  Equal rates go by document.  For tables, see spend.
    """
    points, left = _start(points, budget)
    return {d: points[d][k] for d, k in _spend(points, dict.fromkeys(points, 0), left, next_steps).items()}


def spend_pairs(points: dict, budget: int) -> dict:
    """The same over jumps between any two rows of a document; one that doesn't fit leaves the smaller ones."""
    points, left = _start(points, budget)
    return {d: points[d][k] for d, k in _spend(points, dict.fromkeys(points, 0), left, next_jumps).items()}


def spend(rows: DataFrame, budget: int, key: str = "collection", jumps: bool = False) -> DataFrame:
    """key, w: spend_marginal (or with ``jumps`` spend_pairs) of frontier rows, in rounds over a table of any size.

    A document's steps have a fixed place in the global order: that of the worst
    rate up to them, since a better step follows at once.  In a round all steps that can
    fit are dealt to ranges of that order, by sampled quantiles of their rates; their running sum, per range and then inside the
    range in which the budget ends, tells the first that doesn't fit, ties by document included.  All before it are taken, and as the
    budget only shrinks, steps larger than what is left never fit again.  Only
    sums per range reach the driver.  The first step of a round always fits, and what is left is less than
    the step that ended it, so few rounds follow.
    Raises ValueError if the budget doesn't hold every document's first row.
    An empty table gives an empty result.
    """
    chain = next_jumps if jumps else next_steps
    kind = rows.schema[key].dataType.simpleString()
    cells = F.array_sort(F.collect_list(F.struct(F.col("n_apps").cast("long").alias("n_apps"), F.col("n_postings").cast("long").alias("n_postings"), F.col("w").cast("double").alias("w"))))
    state = scratch.table(rows.groupBy(F.col(key).alias("d")).agg(cells.alias("p")).withColumn("at", F.lit(0)), "budget")
    left = budget - (state.agg(F.sum(F.col("p")[0]["n_apps"])).first()[0] or 0)
    if left < 0:
        raise ValueError("the budget doesn't hold the smallest choice of every document")

    def chained(left: int):
        def run(frames):
            for df in frames:
                out = []
                for d, p, at in zip(df["d"], df["p"], df["at"], strict=True):
                    worst = float("inf")
                    for k, extra, rate in chain([(x["n_apps"], x["n_postings"]) for x in p], int(at), left):
                        worst = min(worst, rate)
                        out.append((d, k, extra, worst))
                yield pd.DataFrame(out, columns=["d", "to", "apps", "rate"])

        return run

    while True:
        steps_ = state.mapInPandas(chained(left), f"d {kind}, to int, apps long, rate double")
        order = [F.desc("rate"), F.asc("d"), F.asc("to")]
        dealt = scratch.table(steps_.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "steps")
        # one row per range
        sums = sorted(dealt.groupBy("part").agg(F.sum("apps").alias("apps")).collect(), key=lambda r: r["part"])
        rest, last = left, None
        for r in sums:
            if r["apps"] > rest:
                last = r["part"]
                break
            rest -= r["apps"]
        taken = dealt if last is None else dealt.where(F.col("part") < last)
        if last is not None:
            run = F.sum("apps").over(Window.partitionBy("part").orderBy(*order))
            partly = dealt.where(F.col("part") == last).withColumn("run", run).where(F.col("run") <= rest)
            rest -= partly.agg(F.max("run")).first()[0] or 0
            taken = taken.unionByName(partly.drop("run"))
        moved = taken.groupBy("d").agg(F.max("to").alias("to"))
        state = scratch.table(state.join(moved, "d", "left").select("d", "p", F.coalesce("to", "at").alias("at")), "budget")
        left = rest
        if last is None:
            return state.select(F.col("d").alias(key), F.col("p")[F.col("at")]["w"].alias("w"))


def with_chosen(rows: DataFrame, chosen: DataFrame, default: float = 1.0, key: str = "collection") -> DataFrame:
    """Rows with the weight chosen for their collection, ``default`` where none is."""
    return rows.join(chosen.select(key, F.col("w").alias("chosen")), key, "left").withColumn("w", F.coalesce("chosen", F.lit(default))).drop("chosen")


def sample(keys: DataFrame, key: str, n: int) -> DataFrame:
    """n keys, the same ones each time: those with the smallest MD5."""
    return keys.select(key).distinct().orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
