"""Connected components of a link table, by large-star and small-star steps.

Each step lowers the target of every link towards the smallest node that is
known in its neighbourhood; steps alternate until nothing changes. All state is
a link table written to the shared folder, so no step depends on an executor
that held an earlier one, and no neighbour list is ever gathered in one row:
minima are partially aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (hi > lo), written. Large: each node points its larger
    neighbours at its smallest; small: it points itself and its smaller ones.

    The smallest neighbours are written before the join: a join in the stage of
    their aggregate could not split the links of a hub, as both would have to
    keep its partitions."""
    hi, lo = F.col("hi"), F.col("lo")
    if large:
        both = links.select(hi.alias("u"), lo.alias("v")).unionAll(links.select(lo.alias("u"), hi.alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        # of a node's links only those to larger ones move
        out = links.select(lo.alias("u"), hi.alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        least = materialize(links.groupBy(hi.alias("u")).agg(F.min("lo").alias("m")), "least")
        moved = links.join(least, hi == F.col("u")).filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        out = moved.unionAll(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    out = materialize(out.filter("hi != lo").distinct(), "links")
    discard(least)
    return out


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is its component's
    smallest node. Nodes without a link do not appear."""
    now = links.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, was = materialize(now, "links"), None
    state = _state(now)
    while state != was and state[0]:
        was = state
        before, middle = now, _star(now, large=True)
        now = _star(middle, large=False)
        discard(before, middle)
        state = _state(now)
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
