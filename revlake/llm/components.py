"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Links that a task contracts together before they are shuffled.
HELD = 400_000


def stars_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the given links, each as a star around its smallest node."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of as many links at a time as a task may hold."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        return pa.record_batch([*map(pa.array, stars_of(u, v))], ["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield out(held)
            held = []
    if held:
        yield out(held)


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node (a larger one linked with smaller ones) and these go to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def _all_stars(links: DataFrame) -> bool:
    """Whether each larger node has one link, to a node that has no link to a smaller one itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    count = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return count.filter("down > 1 OR (down = 1 AND least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long) that is linked with another; root is the smallest of its component.

    Every round contracts the links that a task holds, then lets stars grow across tasks. Nodes with many links are aggregated
    before each shuffle and never gathered. The number of rounds grows with the logarithm of a component's
    size; each round is a written table. Links of a node with itself and repeated links change nothing.
    """
    # written first, so that a task reads many links at once to contract; u is the larger node from here on
    given = materialize(links.filter("u <> v"), "links")
    links = materialize(given.mapInArrow(_contract, "u long, v long").distinct(), "links")
    while not _all_stars(links):
        grown = materialize(_large_star(links), "stars").mapInArrow(_contract, "u long, v long")
        links = materialize(_small_star(grown).distinct(), "links")
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
