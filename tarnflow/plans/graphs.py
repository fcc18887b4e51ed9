"""Graph and machine-learning loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions import squared_distance
from tarnflow.plans.iteration import delta_iterate, fixpoint
from tarnflow.storage import bucketed, discard, drop, materialize


#: Nodes with twice the mean degree are hubs if they are no more than this: what they send is broadcast.
MAX_HUBS = 1 << 20
#: Edges in a bucket.
BUCKET_EDGES = 1 << 20


class Sender:
    """What nodes send along edges ``src, dst``, summed where it arrives, round after round without shuffling the edges again.

    Edges from hubs lie by their ``dst``: what hubs send is broadcast, and almost all of a node's sum is made in one task. The other
    edges are bucketed by ``src``, to which only what nodes send is shuffled; sums for hubs shrink before the shuffle.
    ``nodes`` has ``node, degree`` (out-edges, 0 for none).
    """

    def __init__(self, edges: DataFrame) -> None:
        edges = materialize(edges.select("src", "dst"), "edges")
        self.spark = edges.sparkSession
        ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out")).union(edges.select("dst", F.lit(0)))
        known = materialize(ends.groupBy("node").agg(F.sum("out").alias("degree"), F.count(F.lit(1)).alias("ends")), "nodes")
        self.nodes = known.select("node", "degree")
        self.n, total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0))).first()
        hubs = known.where((F.col("ends") * self.n > 4 * total) & (F.col("degree") > 0)).select(F.col("node").alias("src"))
        parts = max(self.spark.sparkContext.defaultParallelism, total // BUCKET_EDGES)
        self.hubs = self.wide = None
        if 0 < hubs.count() <= MAX_HUBS:
            self.hubs = materialize(hubs, "hubs")
            self.wide = materialize(edges.join(F.broadcast(self.hubs), "src").repartition(parts, "dst"), "wide")
            edges_left = edges.join(F.broadcast(self.hubs), "src", "left_anti")
        else:
            edges_left = edges
        self.narrow, self.table = bucketed(edges_left, "src", parts)
        discard(edges)

    def __call__(self, sent: DataFrame) -> DataFrame:
        """``node, sum`` of ``sent`` (``src, value``, a row a node) over the edges from ``src``."""
        got = self.narrow.join(sent.hint("SHUFFLE_HASH"), "src").select("dst", "value")
        if self.wide is not None:
            got = got.union(self.wide.join(F.broadcast(self.hubs.join(sent, "src")), "src").select("dst", "value"))
        return got.groupBy(F.col("dst").alias("node")).agg(F.sum("value").alias("sum"))

    def close(self) -> None:
        drop(self.spark, self.table)
        if self.wide is not None:
            discard(self.wide, self.hubs)


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``node, rank`` after ``rounds`` of the power method over edges ``src, dst``; nodes without out-edges give nothing on."""
    send = Sender(edges)
    n, nodes = send.n, send.nodes
    ranks = nodes.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    last = None
    for _ in range(rounds):
        given = send(ranks.where("degree > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("value")))
        ranks = nodes.join(given, "node", "left").select("node", "degree", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("sum", F.lit(0.0))).alias("rank"))
        ranks = materialize(ranks, "ranks")
        if last is not None:
            discard(last)
        last = ranks
    send.close()
    return ranks.select("node", "rank")


def pagerank_stateful(edges: DataFrame, rounds: int = 10, tolerance: float = 1e-8, damping: float = 0.85) -> DataFrame:
    """``node, before, rank``: ranks of the last round and of the one before it, kept as each node's state.

    Ends early when no rank moves by more than ``tolerance`` of itself. Nodes that nothing leads to have no rank after
    the first round.
    """
    send = Sender(edges)
    n = max(send.n, 1)
    state = materialize(send.nodes.select("node", "degree", F.lit(0.0).alias("before"), F.lit(1.0 / n).alias("rank")), "ranks")
    for _ in range(rounds):
        given = send(state.where("degree > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("value")))
        moved = given.join(send.nodes, "node", "left").join(state.select("node", F.col("rank").alias("old")), "node", "left")
        new = (F.col("sum") * damping + (1 - damping) / n).alias("rank")
        old, state = state, materialize(moved.select("node", "degree", F.coalesce("old", F.lit(0.0)).alias("before"), new), "ranks")
        discard(old)
        if state.where(F.abs(F.col("rank") - F.col("before")) / F.col("rank") > tolerance).isEmpty():
            break
    send.close()
    return state.select("node", "before", "rank")


def pagerank_delta(edges: DataFrame, rounds: int = 100, start: int = 6_000_000, jump: int = 1_000_000) -> DataFrame:
    """``node, rank`` in integers: a rank is ``jump`` and, from each node that leads here, 5 / 6 of its rank over its degree, rounded down.

    Nodes send on only by how much their share has changed, until nothing changes or ``rounds`` have passed.
    """
    sender = Sender(edges)
    share = lambda rank: F.coalesce(F.expr(f"({rank}) * 5 div (6 * nullif(degree, 0))"), F.lit(0)).cast("long")
    first = sender.nodes.select("node", "degree", F.lit(start).cast("long").alias("rank"))
    first = materialize(first.select("node", "degree", "rank", share("rank").alias("share"), share("rank").alias("step")), "ranks")

    def send(changed: DataFrame) -> DataFrame:
        return sender(changed.where("step <> 0").select(F.col("node").alias("src"), F.col("step").alias("value"))).withColumnRenamed("sum", "add")

    def take(joined: DataFrame) -> DataFrame:
        moved = joined.withColumn("rank", F.col("rank") + F.coalesce("add", F.lit(0)))
        moved = moved.withColumn("new", share("rank"))
        return moved.select("node", "degree", "rank", F.col("new").alias("share"), (F.col("new") - F.col("share")).alias("step"), (F.coalesce("add", F.lit(0)) != 0).alias("changed"))

    opening = send(first).join(first.select("node"), "node", "right").select("node", (F.coalesce("add", F.lit(0)) + jump - start).alias("add"))
    out = delta_iterate(first, opening, rounds, "node", take, send).select("node", "rank")
    sender.close()
    return out


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` (least node reachable) for every node of the edges ``src, dst``. An edge with a null end links nothing.

    In each round every node picks one among itself and its neighbours, and nodes with the same pick become one:
    the least node in even rounds, the least by a hash of the round in odd ones, which takes a constant factor off the
    nodes of any graph, long paths included. A graph that is not done after ``rounds`` is an error.
    """
    edges = materialize(edges.select("src", "dst"), "edges")
    nodes = materialize(edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct(), "nodes")
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, 2 * edges.count() // BUCKET_EDGES)
    once = lambda df: df.repartition(tasks, "src", "dst").distinct()  # noqa: E731  (few edges a task, whatever Spark makes of small partitions)
    pairs = edges.where("src <> dst")
    both = materialize(once(pairs.union(pairs.select("dst", "src"))), "edges")
    picks: list[DataFrame] = []
    while not both.isEmpty():
        if len(picks) == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        by = lambda c, k=len(picks): F.xxhash64(F.lit(k), c) if k % 2 else F.col(c)
        # plain numbers are aggregated by hash; a struct of both would sort the edges
        near = both.groupBy("src").agg(F.min(by("dst")).alias("h"), F.min_by("dst", by("dst")).alias("near"))
        pick = near.select(F.col("src").alias("node"), F.when(by("src") <= F.col("h"), F.col("src")).otherwise(F.col("near")).alias("pick"))
        pick = materialize(pick, "picks")
        picks.append(pick)
        left = both.join(pick.toDF("src", "a").hint("SHUFFLE_HASH"), "src").join(pick.toDF("dst", "b").hint("SHUFFLE_HASH"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        both = materialize(once(left), "edges")
    total = nodes.select("node", F.col("node").alias("pick")) if not picks else picks[-1]
    for pick in reversed(picks[:-1]):
        total = pick.join(total.toDF("pick", "last"), "pick", "left").select("node", F.coalesce("last", "pick").alias("pick"))
    total = materialize(total, "roots")
    low = total.groupBy("pick").agg(F.min("node").alias("component"))
    return nodes.join(total.join(low, "pick").select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All ``src, dst`` with a path between them. Lengths double: rounds grow with the logarithm of the longest path.

    Known pairs are those up to a distance L, new ones those beyond L / 2. A pair beyond L and up to 2 L has a shortest path
    that starts with L steps, a new pair, and goes on with a known one; so new ones need no join from the other side.
    """

    def longer(known: DataFrame, new: DataFrame) -> DataFrame:
        return new.join(known.toDF("dst", "next"), "dst").select("src", F.col("next").alias("dst"))

    return fixpoint(edges.select("src", "dst"), longer)


def triangles(edges: DataFrame) -> DataFrame:
    """The number ``triangles`` in an undirected graph.

    Edges point from the end of lower degree to the other, so that no node has more than the square root of
    the edges going out: the pairs to check stay few whatever the hubs. Of a node's pairs only those are made whose lower end has
    both edges coming in and going out, and whose upper end is reached from such a node; no other pair is closed.
    """
    flat = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    flat = materialize(flat, "edges")
    degree = materialize(flat.select("a").union(flat.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("d")), "degrees")
    ranked = flat.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    lower, upper = F.struct(F.col("da").alias("d"), F.col("a").alias("v")), F.struct(F.col("db").alias("d"), F.col("b").alias("v"))
    ends = ranked.select(F.when(up, lower).otherwise(upper).alias("l"), F.when(up, upper).otherwise(lower).alias("h"))
    out = materialize(ends.select(F.col("l.v").alias("lo"), F.col("h.v").alias("hi"), F.col("h.d").alias("d")), "oriented")
    mids = materialize(out.select("hi").distinct().join(out.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi"), "mids")
    closed = materialize(out.join(mids.toDF("lo"), "lo", "left_semi").select(F.col("lo").alias("x"), F.col("hi").alias("y")), "closing")
    tops = closed.select(F.col("y").alias("hi")).distinct()
    x = out.join(mids, "hi", "left_semi").select("lo", F.col("hi").alias("x"), F.col("d").alias("dx"))
    y = out.join(tops, "hi", "left_semi").select("lo", F.col("hi").alias("y"), F.col("d").alias("dy"))
    wedge = x.join(y, "lo").where(F.struct("dx", "x") < F.struct("dy", "y")).select("x", "y")
    return wedge.join(closed, ["x", "y"]).agg(F.count(F.lit(1)).alias("triangles"))


def kmeans(points: DataFrame, vector: str, centroids: list[list[float]], rounds: int = 10, tolerance: float = 1e-6) -> list[list[float]]:
    """Centroids after Lloyd's rounds, keyed by their index; those that lose all points stay."""
    points = materialize(points.select(F.col(vector).cast("array<double>").alias("v")), "points")
    for _ in range(max(1, rounds)):
        places = F.expr("array(" + ", ".join("array(" + ", ".join(f"double('{float(x)!r}')" for x in c) + ")" for c in centroids) + ")")
        near = F.array_min(F.transform(places, lambda c, k: F.struct(squared_distance(F.col("v"), c).alias("d"), k.alias("k"))))["k"]
        spread = points.select("v", near.alias("c")).select("c", F.posexplode("v").alias("d", "x"))
        means = spread.groupBy("c", "d").agg(F.avg("x").alias("m")).collect()  # one row per centroid and dimension
        moved = [list(map(float, c)) for c in centroids]
        for r in means:
            if r.c is not None:
                moved[r.c][r.d] = r.m
        shift = max(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(moved, centroids, strict=True))
        centroids = moved
        if shift <= tolerance:
            break
    return centroids


def collatz_steps(value: int) -> int:
    steps = 0
    while value > 1:
        value = value // 2 if value % 2 == 0 else 3 * value + 1
        steps += 1
    return steps


def collatz_longest(spark, limit: int) -> DataFrame:
    """The start below ``limit`` with most Collatz steps: ``value, steps``; vectorised over Arrow batches."""
    @F.pandas_udf("long")
    def steps(values: pd.Series) -> pd.Series:
        v = values.to_numpy(np.int64).copy()
        n = np.zeros(len(v), np.int64)
        live = np.flatnonzero(v > 1)
        while len(live):
            x = v[live]
            v[live] = np.where(x % 2 == 0, x // 2, 3 * x + 1)
            n[live] += 1
            live = live[v[live] > 1]
        return pd.Series(n)

    counted = spark.range(1, limit).select(F.col("id").alias("value"), steps("id").alias("steps"))
    return counted.agg(F.max(F.struct("steps", (-F.col("value")).alias("v"))).alias("m")).select((-F.col("m.v")).alias("value"), F.col("m.steps").alias("steps"))
