"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paywarden.llm.common import written

#: More rounds than any graph has needed; each one about halves the depth of the trees.
ROUNDS = 60
#: Links that a task contracts at a time.
HELD = 1 << 20


def least_of_each(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of some links that are not the least of their component there."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (left, right) = np.arange(len(nodes)), np.split(ends, 2)
    while len(left):
        left, right = root[left], root[right]
        open_ = left != right
        left, right = left[open_], right[open_]
        np.minimum.at(root, np.maximum(left, right), np.minimum(left, right))
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def stars(links: list[list[np.ndarray]]) -> pa.RecordBatch:
    found = least_of_each(*(np.concatenate(ends) for ends in zip(*links)))
    return pa.RecordBatch.from_arrays([pa.array(ends) for ends in found], ["a", "b"])


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links that span the same components, each from a node to the least one that a task sees of its component."""
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("a", "b")])
        size += batch.num_rows
        if size >= HELD:
            yield stars(held)
            held, size = [], 0
    if held:
        yield stars(held)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), both bigint; the root is the least node of its component.

    Every task first contracts the links that it reads, so that chains are short
    and copies of a link are gone. Then alternating stars: every node first hands
    its larger neighbours to its least one, then its smaller ones. Both steps are
    a minimum per node and a join, so a node with very many links costs a join
    that Spark can split. A round is written before the next one reads it.
    """
    a, b = F.col("a"), F.col("b")
    edges, before = written(links.where(a != b).mapInArrow(contracted, "a bigint, b bigint").distinct(), "edges"), None
    for _ in range(ROUNDS):
        state = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == before:
            return edges.select(a.alias("node"), b.alias("root")).unionByName(
                edges.select(b.alias("node"), b.alias("root")).distinct()
            )
        before = state
        # Larger neighbours of u go to the least of u and its neighbours.
        low = edges.groupBy(a.alias("u")).agg(F.min("b").alias("low"))
        large = edges.join(low, b == F.col("u"), "left").select("a", F.coalesce("low", "b").alias("b")).distinct()
        # Smaller neighbours of u, and u itself, go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(least.withColumnRenamed("a", "u"), a == F.col("u")).where(b != F.col("low"))
            .select(b.alias("a"), F.col("low").alias("b"))
        )
        edges = written(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "edges")
    raise RuntimeError("The components did not settle.")
