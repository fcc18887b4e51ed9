"""Connected components by contraction, in aggregations and joins.

In each round every node picks one among itself and its neighbours, and nodes with the same pick become
one. Even rounds pick the least node, which folds stars at once; odd rounds pick the least by a hash
of that round, which takes a constant factor off the nodes of any graph, long chains included. So rounds
grow with the logarithm of the nodes. Picks combine before the shuffle; joins on a hot node can be
split by Spark. Once few links are left, one task follows them to the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.grouping import smallest_reachable
from tarnflow.llm.storage import cut, discard


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with the least node that the links of all batches lead to."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        low = smallest_reachable(len(nodes), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], ["node", "pick"])


def connected_components(edges: DataFrame, few: int = 400_000) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the edges ``a, b`` (long). Nulls and loops are left out.

    At most ``few`` links, of 16 bytes each, go to one task.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    both = cut(pairs.union(pairs.select("b", "a")).distinct(), "edges-0")
    picks: list[DataFrame] = []
    while left_over := both.count():
        if left_over <= few:
            picks.append(cut(both.where("a < b").repartition(1).mapInArrow(_follow, "node long, pick long"), f"picks-{len(picks)}"))
            break
        rank = lambda c, k=len(picks): F.struct((F.xxhash64(F.lit(k), c) if k % 2 else F.lit(0)).alias("h"), F.col(c).alias("node"))
        pick = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("near"))["node"].alias("pick"))
        pick = cut(pick, f"picks-{len(picks)}")
        picks.append(pick)
        one, two = pick.toDF("a", "pa"), pick.toDF("b", "pb")
        left = both.join(one, "a").join(two, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        left = cut(left, f"edges-{len(picks)}")
        discard(both)
        both = left
    if not picks:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    total = picks[-1]
    for pick in reversed(picks[:-1]):
        later = total.toDF("pick", "last")
        total = pick.join(later, "pick", "left").select("node", F.coalesce("last", "pick").alias("pick"))
    total = cut(total, "roots")
    low = total.groupBy("pick").agg(F.min("node").alias("component"))
    out = cut(total.join(low, "pick").select("node", "component"), "components")
    discard(total, both, *picks)
    return out
