"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a group-by and a join over the links; only counts come to the
driver.  Each round is written to the shared folder, which cuts the lineage.
``FEW`` links or less, some MB, take one task instead of rounds: the result is
the same, and a round of shuffles costs more than they do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import scratch as _scratch
from palimpsest.llm import _chunks as C
from palimpsest.llm._filters import replaced

#: Links that one task joins: 16 bytes each, and about ten times that at work.
FEW = 1 << 19


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of links a[i], b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # each root is hung on its smallest neighbour, then paths are cut short
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _in_one_task(batches):
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        nodes, least = smallest(*(np.concatenate(side) for side in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64())], names=["node", "component"])


def _large(links: DataFrame) -> DataFrame:
    """Each link (u, v), v < u, hung on the smallest neighbour of v.

    Only nodes that have a smaller neighbour change anything, so the links of a
    component's root, its hub, are passed on without a shuffle.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return replaced(links, "v", least.withColumnRenamed("u", "v"), "m").where("u != v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hung on the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _print(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node.

    The links are read twice, so they should be a table.
    """
    links = links.where("a != b")
    if links.count() <= FEW:
        one = links.select("a", "b").repartition(1).mapInArrow(C.settled(_in_one_task), "node long, component long")
        return _scratch.table(one, "components")
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = _scratch.table(now, "links")
    seen = _print(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        made, now = [now], _scratch.table(_small(_large(now)), "links")
        _scratch.drop(*made)
        if (then := _print(now)) == seen:
            break
        seen = then
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
