"""Connected components of a link table: by one task while it can hold all links, by alternating large-star and
small-star rounds beyond.

A round is some ten stages, each of as many tasks as there are shuffle partitions; over few links its cost is that of
the tasks, their files and their records, not of the links.

In rounds, every node ends up with a single link to the smallest node of its component. A round is
aggregations and joins on node keys; a hub's links are pre-aggregated for its minimum
and split by the adaptive skew join when that minimum is joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import released, stable, tidy

#: Links that one task unites: 8 MB, and some 60 MB while it does.
MOST_TOGETHER = 500_000


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """parent with i and j joined, each node pointing at the least index of its component."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _together(links: DataFrame) -> DataFrame:
    """components() of links by a single task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
        nodes, at = np.unique(np.concatenate([np.empty((2, 0), np.int64), *ends], axis=1), return_inverse=True)
        at = at.reshape(2, -1)
        root = unite(np.arange(len(nodes)), at[0], at[1])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["node", "root"])

    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(tidy(run), "node long, root long")


def _minima(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = both.join(_minima(both), "u").filter("v > u")
    return found.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minima(down)
    found = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return found.unionByName(least.select("u", F.col("m").alias("v")))


def _state(links: DataFrame):
    """What tells one set of links from another: their number, and sums of two hashes of 64 bits as they are."""
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), wide("u", "v"), wide(F.lit(1), "v", "u")).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v); root is the smallest node of its component, itself not listed.

    Repeated links, links both ways and links of a node with itself change nothing; no links give no rows. Rounds
    go on until nothing changes, which takes about the logarithm of the longest chain.
    """
    links = stable(links.filter("u != v"))
    if links.count() <= MOST_TOGETHER:
        found = stable(_together(links))
        released(links.sparkSession)
        return found
    links = stable(links.distinct())
    state = _state(links)
    while state[0]:
        links = stable(_small_star(_large_star(links).distinct()).distinct())
        after = _state(links)
        if after == state:
            break
        state = after
    released(links.sparkSession)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
