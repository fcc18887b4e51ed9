"""Queries of loops over whole tables, of column expressions, and of operators whose results are counts or orders."""

from __future__ import annotations

import asyncio

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow import functions as fn
from tarnflow.flow import Engine, Flow
from tarnflow.operators import stateful
from tarnflow.operators import windows as win
from tarnflow.plans import graphs
from tarnflow.registry import EVENTS, events, flow, query
from tarnflow.sources import readers
from tarnflow.storage import shared_dir

# Graphs


def part_edges(spark, sf_dir) -> DataFrame:
    """Every part with every supplier that a line item has it from, with disjoint ids: few nodes with very many edges."""
    items = flow(spark, sf_dir, "lineitem").df
    tasks = max(spark.sparkContext.defaultParallelism, items.count() // graphs.BUCKET_EDGES)
    return items.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100_000_000).alias("dst")).repartition(tasks, "src", "dst").distinct()


def next_orders(spark, sf_dir) -> DataFrame:
    """Each order with the next one of its customer: paths."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return flow(spark, sf_dir, "orders").df.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(by).alias("dst")).where("dst is not null")


def _both_ways(spark, sf_dir) -> DataFrame:
    g = part_edges(spark, sf_dir)
    return g.union(g.select("dst", "src"))


_PARTS = "g AS MATERIALIZED (SELECT DISTINCT l_partkey AS src, l_suppkey + 100000000 AS dst FROM lineitem)"
_BOTH = f"{_PARTS}, b AS MATERIALIZED (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g)"


@query("WITH g AS (SELECT o_orderkey AS node, o_custkey FROM orders), n AS (SELECT o_custkey, min(node) AS component, count(*) AS n FROM g GROUP BY o_custkey) SELECT node, component FROM g JOIN n USING (o_custkey) WHERE n > 1")
def connected_components(spark, sf_dir):
    """Orders by customer, found along the paths from order to order."""
    return graphs.connected_components(next_orders(spark, sf_dir))


@query(f"WITH RECURSIVE {_BOTH}, r(node, seen) USING KEY (node) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.dst, min(r.seen) FROM r JOIN b ON r.node = b.src JOIN recurring.r AS old ON old.node = b.dst GROUP BY b.dst, old.seen HAVING min(r.seen) < old.seen) SELECT node, seen AS component FROM r")
def connected_components_hubs(spark, sf_dir):
    return graphs.connected_components(part_edges(spark, sf_dir))


@query("WITH RECURSIVE g AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders), r(src, dst) AS (SELECT src, dst FROM g WHERE dst IS NOT NULL UNION SELECT r.src, g.dst FROM r JOIN g ON r.dst = g.src WHERE g.dst IS NOT NULL) SELECT src, dst FROM r")
def transitive_closure(spark, sf_dir):
    """Each order with all later ones of its customer, from edges to the next one."""
    return graphs.transitive_closure(next_orders(spark, sf_dir))


@query("WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 100000000 AS b FROM lineitem UNION SELECT l_partkey, l_orderkey + 200000000 FROM lineitem UNION SELECT l_suppkey + 100000000, l_orderkey + 200000000 FROM lineitem) SELECT count(*) AS triangles FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b")
def triangles(spark, sf_dir):
    """Among parts, suppliers and orders, linked where a line item has both."""
    items = flow(spark, sf_dir, "lineitem").df.select(F.col("l_partkey").alias("p"), (F.col("l_suppkey") + 100_000_000).alias("s"), (F.col("l_orderkey") + 200_000_000).alias("o"))
    return graphs.triangles(items.select(F.col("p").alias("src"), F.col("s").alias("dst")).union(items.select("p", "o")).union(items.select("s", "o")))


def _ranks(rounds: int) -> str:
    """The power method, round by round."""
    step = "r{b} AS MATERIALIZED (SELECT b.dst AS node, any_value(0.15 / k) + 0.85 * sum(rank / degree) AS rank FROM b JOIN d ON d.src = b.src JOIN r{a} ON r{a}.node = b.src, k GROUP BY b.dst)"
    return f"{_BOTH}, d AS (SELECT src, count(*) AS degree FROM b GROUP BY src), k AS (SELECT count(*) AS k FROM d), r0 AS MATERIALIZED (SELECT src AS node, 1.0::DOUBLE / k AS rank FROM d, k), " + ", ".join(step.format(a=n, b=n + 1) for n in range(rounds))


@query(f"WITH {_ranks(10)} SELECT node, round(rank * 1e6, 3) AS rank FROM r10")
def pagerank(spark, sf_dir):
    """Parts and suppliers of all line items, with an edge each way."""
    return graphs.pagerank(_both_ways(spark, sf_dir)).select("node", F.round(F.col("rank") * 1e6, 3).alias("rank"))


@query(f"WITH {_ranks(10)} SELECT node, round(r9.rank * 1e6, 3) AS before, round(r10.rank * 1e6, 3) AS rank FROM r10 JOIN r9 USING (node)")
def pagerank_stateful(spark, sf_dir):
    out = graphs.pagerank_stateful(_both_ways(spark, sf_dir), rounds=10, tolerance=1e-9)
    return out.select("node", F.round(F.col("before") * 1e6, 3).alias("before"), F.round(F.col("rank") * 1e6, 3).alias("rank"))


def _integer_ranks(rounds: int) -> str:
    step = "r{b} AS MATERIALIZED (SELECT b.dst AS node, 1000000 + sum(rank * 5 // (6 * degree))::BIGINT AS rank FROM b JOIN d ON d.src = b.src JOIN r{a} ON r{a}.node = b.src GROUP BY b.dst)"
    return f"{_BOTH}, d AS (SELECT src, count(*) AS degree FROM b GROUP BY src), r0 AS MATERIALIZED (SELECT src AS node, 6000000::BIGINT AS rank FROM d), " + ", ".join(step.format(a=n, b=n + 1) for n in range(rounds))


@query(f"WITH {_integer_ranks(12)} SELECT node, rank FROM r12")
def pagerank_delta(spark, sf_dir):
    return graphs.pagerank_delta(_both_ways(spark, sf_dir), rounds=12)


_LLOYD = "a{b} AS MATERIALIZED (SELECT vec_id, any_value(v.e) AS e, arg_min(k, (list_distance(v.e, c.e), k)) AS k FROM v, c{a} AS c GROUP BY vec_id), c{b} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{a} AS c LEFT JOIN (SELECT k, list(x ORDER BY d) AS e FROM (SELECT k, d, avg(e[d]) AS x FROM a{b}, range(1, 65) AS r(d) GROUP BY k, d) GROUP BY k) m USING (k))"


@query("WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, e FROM v ORDER BY vec_id LIMIT 10), " + ", ".join(_LLOYD.format(a=n, b=n + 1) for n in range(5)) + " SELECT k::INT AS cluster, d::INT AS dim, round(e[d + 1], 6) AS value FROM c5, range(0, 64) AS r(d)")
def kmeans(spark, sf_dir):
    """Centroids of the embeddings after five rounds from the ten vectors of least id."""
    points = flow(spark, sf_dir, "embeddings").df
    first = [list(map(float, r.embedding)) for r in points.orderBy("vec_id").limit(10).collect()]
    out = graphs.kmeans(points, "embedding", first, rounds=5)
    return spark.createDataFrame([(k, d, round(x, 6)) for k, c in enumerate(out) for d, x in enumerate(c)], "cluster int, dim int, value double")


@query("WITH RECURSIVE r(round, value) AS (SELECT 0, p_partkey FROM part UNION ALL SELECT round + 1, value + 3 FROM r WHERE round < 2) SELECT value FROM r WHERE round = 2")
def nested_iterate(spark, sf_dir):
    """A loop of two rounds whose body is a loop of three, each adding one."""
    add = lambda df, _: df.select((F.col("value") + 1).alias("value"))
    zero, same = lambda df: 0, lambda s, d: s
    rows = flow(spark, sf_dir, "part").map(value="p_partkey")
    return rows.iterate(2, 0, lambda df, s: Flow(df).iterate(3, 0, add, zero, same)[1].df, zero, same)[1].df


# Column expressions


@query("SELECT dayofyear(o_orderdate) // 7 AS week, count(*) AS n FROM orders GROUP BY ALL")
def us_dates(spark, sf_dir):
    """Weeks of dates written month first."""
    written = flow(spark, sf_dir, "orders").df.select(F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    return Flow(written.select(fn.week_of_year(fn.us_date("day")).alias("week"))).group_by_count({"week": "week"}).df.withColumnRenamed("count", "n")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, e FROM v ORDER BY vec_id LIMIT 5) SELECT vec_id, arg_min(k, (list_distance(v.e, c.e), k))::INT AS nearest FROM v, c GROUP BY vec_id")
def nearest_centroid(spark, sf_dir):
    points = flow(spark, sf_dir, "embeddings").df.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = [list(map(float, r.v)) for r in points.orderBy("vec_id").limit(5).collect()]
    return points.select("vec_id", fn.argmin(F.array(*[fn.squared_distance("v", F.array(*map(F.lit, c))) for c in first])).alias("nearest"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x + x * 0.5)), 4) AS total FROM embeddings")
def vector_update(spark, sf_dir):
    points = flow(spark, sf_dir, "embeddings").df.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    moved = fn.add_scaled("v", "v", 0.5)
    return points.select("vec_id", F.round(F.aggregate(moved, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("WITH t AS (SELECT o_custkey, list(o_totalprice ORDER BY o_totalprice DESC)[1:3] AS top FROM orders GROUP BY o_custkey) SELECT o_custkey, k::INT - 1 AS place, top[k] AS price FROM t, unnest(range(1, len(top) + 1)) AS u(k)")
def top_of_list(spark, sf_dir):
    prices = flow(spark, sf_dir, "orders").df.groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("prices"))
    return prices.select("o_custkey", F.posexplode(fn.top_of("prices", 3)).alias("place", "price"))


@query("SELECT event_id, (props ->> 'k')::INT AS k FROM events")
def json_fields(spark, sf_dir):
    return readers.from_json(flow(spark, sf_dir, "events").df, "props", "k int", "p").select("event_id", "p.k")


# Sources and sinks


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_options(spark, sf_dir):
    """Other delimiter, quote and comment marks, blanks around fields, no header."""
    path = f"{shared_dir(spark)}/csv-options"
    quoted = F.concat(F.lit("'"), F.regexp_replace("s_name", "'", "''"), F.lit("'"))
    lines = flow(spark, sf_dir, "supplier").df.select(F.concat_ws(" ; ", F.col("s_suppkey").cast("string"), quoted, F.col("s_acctbal").cast("string")).alias("value"))
    lines.union(spark.createDataFrame([("# a remark",)], "value string")).write.mode("overwrite").text(path)
    return Engine(spark).csv(path, "s_suppkey long, s_name string, s_acctbal double", header=False, delimiter=";", quote="'", comment="#", trim=True).df


@query("SELECT 'collect_vec' AS sink, count(*) AS n FROM nation UNION ALL SELECT 'collect', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'collect_all', count(*) FROM nation UNION ALL SELECT 'collect_channel', count(*) FROM nation UNION ALL SELECT 'collect_channel_parallel', count(*) FROM nation UNION ALL SELECT 'for_each', sum(n_nationkey)::BIGINT FROM nation")
def sinks(spark, sf_dir):
    """What each sink that hands rows to the program got of them."""
    nations, regions = flow(spark, sf_dir, "nation"), flow(spark, sf_dir, "nation").map(r="n_regionkey")
    rows, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    nations.collect_channel_parallel(lambda part: rows.add(sum(1 for _ in part)))
    nations.for_each(lambda r: total.add(r["n_nationkey"]))
    found = {"collect_vec": len(nations.collect_vec()), "collect": len(regions.collect(set)), "collect_all": len(nations.collect_all().value), "collect_channel": sum(1 for _ in nations.collect_channel()), "collect_channel_parallel": rows.value, "for_each": total.value}
    return spark.createDataFrame(list(found.items()), "sink string, n long")


@query("SELECT r_regionkey, r_name FROM region")
def channel(spark, sf_dir):
    """Rows that the program sends one by one."""
    sent = readers.Channel(spark, "r_regionkey int, r_name string", size=2)
    for row in flow(spark, sf_dir, "region").map(r_regionkey="r_regionkey", r_name="r_name").collect_channel():
        sent.send(tuple(row))
    sent.close()
    return sent.frame()


@query("SELECT 10 AS taken, 5 AS skipped, (SELECT count(*) FROM orders) - 5 AS rest")
def limits(spark, sf_dir):
    orders = flow(spark, sf_dir, "orders").map(o_orderkey="o_orderkey")
    n = orders.collect_count()
    rest = orders.limit(n, 5).collect_count()
    return spark.createDataFrame([(orders.limit(10, 5).collect_count(), n - rest, rest)], "taken int, skipped int, rest long")


@query("SELECT n_nationkey FROM nation")
def plain_passes(spark, sf_dir):
    """Operators that leave rows as they are: boxing, batch modes, an operator of one's own."""
    return flow(spark, sf_dir, "nation").map(n_nationkey="n_nationkey").into_boxed().batch_mode("adaptive").transform(lambda df: df.where("n_nationkey is not null")).df


# Time and state


@query(f"WITH {EVENTS} SELECT event_id, ts AS at FROM e")
def timestamps(spark, sf_dir):
    """A time column put on and, from a second flow, taken off again."""
    timed = events(spark, sf_dir).map(event_id="event_id", ts="ts").add_timestamps("ts", name="at")
    return timed.drop_timestamps("ts").df.join(timed.drop_timestamps("at").df.select("event_id"), "event_id")


@query("SELECT o_orderkey + 9007199254740993 AS id, (lag(o_orderkey + 9007199254740993) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::VARCHAR AS before, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey + 9007199254740993)::VARCHAR END AS part FROM orders")
def rich_map_exact(spark, sf_dir):
    """Integers above 2 ** 53 and nulls through a closure with state."""
    big = "o_orderkey + 9007199254740993"
    rows = flow(spark, sf_dir, "orders").map(o_custkey="o_custkey", id=big, part=f"CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {big} END").to_keyed("o_custkey")

    def make():
        last = [None]

        def step(row):
            before, last[0] = last[0], row["id"]
            return {"id": row["id"], "before": before, "part": row["part"]}

        return step

    out = rows.rich_map(["id"], make, "id long, before long, part long").df
    return out.select("id", *[F.col(c).cast("string").alias(c) for c in ("before", "part")])


@query("SELECT p_partkey + 9007199254740993 AS id, CASE WHEN p_size % 2 = 0 THEN NULL ELSE (p_partkey + 9007199254740994)::VARCHAR END AS next FROM part")
def map_async_exact(spark, sf_dir):
    rows = flow(spark, sf_dir, "part").map(id="p_partkey + 9007199254740993", size="CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_partkey + 9007199254740993 END")

    async def step(row):
        await asyncio.sleep(0)
        return {"id": row["id"], "next": None if row["size"] is None else row["size"] + 1}

    return rows.map_async(step, "id long, next long").df.withColumn("next", F.col("next").cast("string"))


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders")
def rich_map_tasks(spark, sf_dir):
    """Without keys and with a state for each task: counts and sums of tasks, added up."""
    rows = flow(spark, sf_dir, "orders").map(o_orderkey="o_orderkey").df.repartition(8)

    def make():
        seen = [0, 0]

        def step(row):
            if row is None:
                return [{"n": seen[0], "total": seen[1]}]
            seen[0] += 1
            seen[1] += row["o_orderkey"]
            return []

        return step

    parts = stateful.rich_flat_map(rows, [], [], make, "n long, total long", at_end=True, scope="partition")
    return parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


# Windows over all rows, in as many tasks as there are

_ALL = f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM e)"


@query(f"{_ALL}, w AS (SELECT r.*, win FROM r, unnest(range(greatest(0, ceil((rn - 99) / 40.0)::BIGINT), rn // 40 + 1)) AS u(win)) SELECT win, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM w GROUP BY win HAVING count(*) = 100")
def count_window_all(spark, sf_dir):
    return events(spark, sf_dir).window_all(win.CountWindow.sliding(100, 40), ["event_id"]).fold(n="count(*)", first="min(event_id)", last="max(event_id)").df.select("win", "n", "first", "last")


@query(f"{_ALL} SELECT rn AS win, min(event_id) OVER w AS first, count(*) OVER w AS n FROM r WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def last_k_window_all(spark, sf_dir):
    return events(spark, sf_dir).window_all(win.LastKWindow(5), ["event_id"]).fold(first="min(event_id)", n="count(*)").df.select("win", "first", "n")


@query(f"WITH {EVENTS}, o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= 60000000 THEN 0 ELSE 1 END AS opens FROM e), s AS (SELECT *, sum(opens) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM o) SELECT min(ts) AS win, count(*) AS n FROM s GROUP BY k")
def session_window_all(spark, sf_dir):
    return events(spark, sf_dir).window_all(win.SessionWindow(60_000_000)).fold(n="count(*)").df.select("win", "n")


@query(f"{_ALL}, t AS (SELECT *, coalesce(sum((event_type IN ('purchase', 'error'))::INT) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS win FROM r) SELECT win, count(*) AS n FROM t GROUP BY win HAVING bool_or(event_type = 'purchase')")
def transaction_window_all(spark, sf_dir):
    return events(spark, sf_dir).window_all(win.TransactionWindow("event_type = 'purchase'", "event_type = 'error'"), ["event_id"]).fold(n="count(*)").df.select("win", "n")


@query(f"{_ALL} SELECT rn // 3 AS win, count(*) AS n FROM r GROUP BY ALL HAVING count(*) = 3")
def count_window_gaps(spark, sf_dir):
    """A slide above the size leaves no gaps."""
    return events(spark, sf_dir).window_all(win.CountWindow(3, 5), ["event_id"]).fold(n="count(*)").df.select("win", "n")
