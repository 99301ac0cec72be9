"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Edges that one task unites in memory: a few hundred MB.
AT_ONCE = 1_000_000


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the least node reachable.

    The edges are written and go to as few tasks as may hold them: each makes
    stars of its own, so the edges of one group don't leave a forest in every
    partition. Of more than ``AT_ONCE`` edges, large-star and small-star steps
    alternate until they are stars; each round is written to the shared folder.
    A round is linear in the edges, the number of rounds is logarithmic in the
    longest path. So few edges as one task may hold are united by one.
    Self-loops and repeated edges are allowed; an empty table gives an empty
    result.
    """
    given = materialize(edges.select("a", "b"), name)
    count = given.count()
    current = materialize(_stars(given.coalesce(max(1, -(-count // AT_ONCE)))), name)
    discard(given)
    shape = _shape(current) if count > AT_ONCE else (0,)
    while shape[0]:
        if shape[0] <= AT_ONCE:
            step = materialize(_stars(current.coalesce(1)), name)
            discard(current)
            current = step
            break
        step = materialize(_small_star(_large_star(current)), name)
        after = _shape(step)
        discard(current)
        current = step
        if after == shape:
            break
        shape = after
    # now every edge is (node, root) with root < node
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b"), F.col("b")).distinct())


def _stars(edges: DataFrame) -> DataFrame:
    """Edges with the same components as ``edges``: stars for each ``AT_ONCE`` edges of a partition."""
    at_once = AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("a", "b")])
            count += batch.num_rows
            if count >= at_once:
                yield _united(held)
                held, count = [], 0
        if held:
            yield _united(held)

    return edges.mapInArrow(run, "a long, b long")


def _united(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    """(node, least node reachable) for the nodes that aren't that node."""
    a, b = (np.concatenate(column) for column in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = low[apart], high[apart]
        np.minimum.at(root, b, a)
        while not np.array_equal(above := root[root], root):
            root = above
    moved = root < np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def _shape(edges: DataFrame) -> tuple:
    """Edges, their checksum and how many distinct roots there are; equal for equal tables."""
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], row[1]


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    return both.join(_least(both), F.col("u") == F.col("node")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    least = _least(down)
    moved = down.join(least, F.col("u") == F.col("node")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("node"), F.col("m"))).where("a <> b").distinct()
