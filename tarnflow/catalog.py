"""Registered queries over the driver's tables, each beside the SQL that it must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnflow import catalog_loops  # noqa: F401  (registers its queries)
from tarnflow import functions as fn
from tarnflow.flow import Engine, Flow
from tarnflow.operators import joins, ordering
from tarnflow.operators import windows as win
from tarnflow.plans import graphs, iteration, nexmark
from tarnflow.registry import DAY, EVENTS, HOUR, ORACLE_SQL, QUERIES, events, flow, micros, money, query  # noqa: F401
from tarnflow.storage import bucketed, drop, shared_dir


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def filter_rows(spark, sf_dir):
    return flow(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 100000").map(o_orderkey="o_orderkey", o_totalprice="o_totalprice").df


@query("SELECT c_custkey, upper(c_mktsegment) AS segment, c_acctbal * 2 AS twice FROM customer")
def map_rows(spark, sf_dir):
    return flow(spark, sf_dir, "customer").map(c_custkey="c_custkey", segment="upper(c_mktsegment)", twice="c_acctbal * 2").df


@query("SELECT event_id, value, CASE WHEN event_type = 'purchase' THEN value * 2 END AS paid FROM events WHERE event_type = 'purchase'")
def filter_map(spark, sf_dir):
    return flow(spark, sf_dir, "events").filter_map("paid", "CASE WHEN event_type = 'purchase' THEN value * 2 END").map(event_id="event_id", value="value", paid="paid").df


@query("SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part FROM orders")
def flat_map(spark, sf_dir):
    return flow(spark, sf_dir, "orders").flat_map("part", "split(o_orderpriority, '-')").map(o_orderkey="o_orderkey", part="part").df


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def flatten(spark, sf_dir):
    return flow(spark, sf_dir, "embeddings").map(vec_id="vec_id", x="embedding").flatten("x").df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def inspect(spark, sf_dir):
    from pyspark.sql import Observation

    return flow(spark, sf_dir, "nation").inspect(Observation(), rows=F.count(F.lit(1))).df


@query("SELECT o_orderkey, length(o_orderpriority) AS size FROM orders")
def map_memo(spark, sf_dir):
    return flow(spark, sf_dir, "orders").map_memo(["o_orderpriority"], lambda b: b["o_orderpriority"].str.len(), "size", "int").map(o_orderkey="o_orderkey", size="size").df.withColumn("size", F.col("size").cast("long"))


@query("SELECT n_nationkey, upper(n_name) AS name FROM nation")
def map_async(spark, sf_dir):
    async def shout(row):
        return {"n_nationkey": row["n_nationkey"], "name": row["n_name"].upper()}

    return flow(spark, sf_dir, "nation").map_async(shout, "n_nationkey int, name string").df


@query("SELECT c_custkey, length(c_mktsegment) AS size FROM customer")
def map_async_memo(spark, sf_dir):
    async def size(row):
        return len(row["c_mktsegment"])

    return flow(spark, sf_dir, "customer").map_async_memo(["c_mktsegment"], size, "size", "long").map(c_custkey="c_custkey", size="size").df


@query("SELECT c_custkey % 7 AS k, c_custkey FROM customer")
def key_by(spark, sf_dir):
    return flow(spark, sf_dir, "customer").key_by(k="c_custkey % 7").map(c_custkey="c_custkey").unkey().df


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 = 3")
def drop_key(spark, sf_dir):
    return flow(spark, sf_dir, "customer").key_by(k="c_custkey % 7").filter("k = 3").map(c_custkey="c_custkey").drop_key().df


@query("SELECT range AS value, range * range AS square FROM range(0, 1000)")
def parallel_source(spark, sf_dir):
    def make(index, peers):
        return ({"value": v, "square": v * v} for v in range(index, 1000, peers))

    return Engine(spark).parallel(8, make, "value long, square long").df


@query("SELECT range AS value FROM range(5, 5005)")
def range_source(spark, sf_dir):
    return Engine(spark).integers(5, 5005, 8).df


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) AS t(id, name)")
def rows_source(spark, sf_dir):
    return Engine(spark).rows([(1, "a"), (2, None), (None, "c")], "id int, name string").df


def _scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    path = _scratch(spark, "csv")
    flow(spark, sf_dir, "customer").map(c_custkey="c_custkey", c_name="c_name", c_acctbal="c_acctbal").write_csv(path)
    return Engine(spark).csv(path, "c_custkey long, c_name string, c_acctbal double").df


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def parquet_round_trip(spark, sf_dir):
    path = _scratch(spark, "parquet")
    flow(spark, sf_dir, "part").map(p_partkey="p_partkey", p_name="p_name", p_retailprice="p_retailprice").write_parquet(path, one=True)
    return Engine(spark).parquet(path).df


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def avro_round_trip(spark, sf_dir):
    path = _scratch(spark, "avro")
    flow(spark, sf_dir, "supplier").map(s_suppkey="s_suppkey", s_name="s_name", s_acctbal="s_acctbal").write_avro(path)
    return Engine(spark).avro(path).df


@query("SELECT s_name AS value FROM supplier")
def text_round_trip(spark, sf_dir):
    path = _scratch(spark, "text")
    flow(spark, sf_dir, "supplier").map(value="s_name").df.write.text(path)
    return Engine(spark).text(path).df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def cached(spark, sf_dir):
    return flow(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").map(o_orderkey="o_orderkey", o_totalprice="o_totalprice").collect_cache("shared").df


@query("SELECT count(*) AS rows FROM lineitem")
def collect_count(spark, sf_dir):
    return spark.createDataFrame([(flow(spark, sf_dir, "lineitem").collect_count(),)], "rows long")


# Aggregates


@query(f"SELECT l_returnflag, l_linestatus, {money('l_quantity')} AS sum_qty, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")
def group_by_sum(spark, sf_dir):
    return flow(spark, sf_dir, "lineitem").filter("l_quantity > 10").group_by_fold({"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}, sum_qty=money("l_quantity"), n="count(*)").df


@query("SELECT n_regionkey AS region, avg(n_nationkey) AS avg FROM nation GROUP BY ALL")
def group_by_avg(spark, sf_dir):
    return flow(spark, sf_dir, "nation").group_by_avg({"region": "n_regionkey"}, "n_nationkey").map(avg="avg").df


@query("SELECT event_type, count(*) AS count FROM events GROUP BY ALL")
def group_by_count(spark, sf_dir):
    return flow(spark, sf_dir, "events").group_by_count({"event_type": "event_type"}).df


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def group_by_max_element(spark, sf_dir):
    orders = Flow(flow(spark, sf_dir, "orders").df.select("o_custkey", "o_orderkey", "o_totalprice"))
    return orders.group_by_max_element({"o_custkey": "o_custkey"}, "o_totalprice", ["o_orderkey"]).df


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1")
def group_by_min_element(spark, sf_dir):
    orders = Flow(flow(spark, sf_dir, "orders").df.select("o_custkey", "o_orderkey", "o_totalprice"))
    return orders.group_by_min_element({"o_custkey": "o_custkey"}, "o_totalprice", ["o_orderkey"]).df


@query(f"SELECT count(*) AS n, {money('l_extendedprice')} AS total, max(l_orderkey) AS top FROM lineitem")
def fold_global(spark, sf_dir):
    return flow(spark, sf_dir, "lineitem").fold(n="count(*)", total=money("l_extendedprice"), top="max(l_orderkey)").df


@query("SELECT sum(l_orderkey) AS total FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
def fold_empty(spark, sf_dir):
    return flow(spark, sf_dir, "lineitem").filter("l_quantity < 0").fold(total="sum(l_orderkey)").df


@query("SELECT max(o_orderkey) AS top, min(o_orderkey) AS low FROM orders")
def reduce_global(spark, sf_dir):
    return flow(spark, sf_dir, "orders").reduce_assoc(top="max(o_orderkey)", low="min(o_orderkey)").df


@query(f"WITH {EVENTS} SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) AS path FROM e GROUP BY user_id")
def fold_rows(spark, sf_dir):
    keyed = events(spark, sf_dir).to_keyed("user_id")
    return keyed.fold_rows(["event_id"], str, lambda s, r: s + r["event_type"][0], lambda s: {"path": s}, "user_id long, path string").df


@query("SELECT s_suppkey, s_nationkey, count(*) OVER () AS n, max(s_suppkey) OVER () AS top FROM supplier")
def fold_scan(spark, sf_dir):
    return Flow(flow(spark, sf_dir, "supplier").df.select("s_suppkey", "s_nationkey")).fold_scan(n="count(*)", top="max(s_suppkey)").df


@query("SELECT s_suppkey, s_nationkey, sum(s_suppkey) OVER (PARTITION BY s_nationkey) AS total FROM supplier")
def keyed_fold_scan(spark, sf_dir):
    suppliers = Flow(flow(spark, sf_dir, "supplier").df.select("s_suppkey", "s_nationkey")).to_keyed("s_nationkey")
    return suppliers.reduce_scan(total="sum(s_suppkey)").df.select("s_suppkey", "s_nationkey", F.col("total").cast("decimal(38,0)").cast("long").alias("total"))


ORACLE_SQL["keyed_fold_scan"] = "SELECT s_suppkey, s_nationkey, CAST(sum(s_suppkey) OVER (PARTITION BY s_nationkey) AS BIGINT) AS total FROM supplier"
ORACLE_SQL["fold_empty"] = "SELECT CAST(sum(l_orderkey) AS BIGINT) AS total FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0"


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return flow(spark, sf_dir, "lineitem").df.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup(spark, sf_dir):
    return flow(spark, sf_dir, "nation").df.rollup("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("n"))


# Joins


def _sides(spark, sf_dir) -> tuple[Flow, Flow]:
    """All customers and orders, with null keys and keys that the other side lacks."""
    c = flow(spark, sf_dir, "customer").map(ck=_CK, c="c_custkey")
    o = flow(spark, sf_dir, "orders").map(ok=_OK, o="o_orderkey")
    return c, o


_CK = "CASE WHEN c_custkey % 100 = 1 THEN NULL WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END"
_OK = "CASE WHEN o_orderkey % 500 = 1 THEN NULL WHEN o_custkey % 5 = 0 THEN -1000000000 - o_custkey ELSE o_custkey END"
SIDES = f"c AS (SELECT {_CK} AS ck, c_custkey AS c FROM customer), o AS (SELECT {_OK} AS ok, o_orderkey AS o FROM orders)"
_JOINED = "WITH {sides} SELECT coalesce(ck, ok) AS k0, c, o AS r_o FROM c {how} JOIN o ON ck IS NOT DISTINCT FROM ok"


def _join(key: str, how: str, strategy: str | None) -> None:
    def run(spark, sf_dir):
        c, o = _sides(spark, sf_dir)
        return c.join(o, ("ck", "ok"), how=how, strategy=strategy).df.select("k0", "c", "r_o")

    query(_JOINED.format(sides=SIDES, how=how.upper()), key)(run)


for _how in ("inner", "left", "right", "full"):
    _join(f"join_{_how}", _how, None)
for _how in ("inner", "left", "full"):
    _join(f"join_{_how}_hash", _how, "hash")
    _join(f"join_{_how}_sort_merge", _how, "sort_merge")
for _how in ("inner", "left"):
    _join(f"join_{_how}_broadcast", _how, "broadcast_right")
    _join(f"join_{_how}_broadcast_sort_merge", _how, "broadcast_right_sort_merge")


@query(f"WITH {SIDES} SELECT ck, c FROM c WHERE EXISTS (SELECT 1 FROM o WHERE ck IS NOT DISTINCT FROM ok)")
def join_semi(spark, sf_dir):
    c, o = _sides(spark, sf_dir)
    return c.join(o, ("ck", "ok"), how="left_semi").df


@query(f"WITH {SIDES} SELECT ck, c FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE ck IS NOT DISTINCT FROM ok)")
def join_anti(spark, sf_dir):
    c, o = _sides(spark, sf_dir)
    return c.join(o, ("ck", "ok"), how="left_anti").df


@query(f"WITH {SIDES} SELECT coalesce(ck, ok) AS k0, c, o AS r_o FROM c FULL JOIN o ON ck IS NOT DISTINCT FROM ok")
def keyed_join_outer(spark, sf_dir):
    c, o = _sides(spark, sf_dir)
    return c.to_keyed("ck").join_outer(o.to_keyed("ok")).df.select("k0", "c", "r_o")


@query("SELECT c.c_custkey AS k0, c_acctbal, o_orderkey AS r_o_orderkey FROM customer c JOIN orders ON c.c_custkey = o_custkey")
def keyed_join(spark, sf_dir):
    c = Flow(flow(spark, sf_dir, "customer").df.select("c_custkey", "c_acctbal")).to_keyed("c_custkey")
    o = Flow(flow(spark, sf_dir, "orders").df.select("o_custkey", "o_orderkey")).to_keyed("o_custkey")
    return c.join_keyed(o).df.select("k0", "c_acctbal", "r_o_orderkey")


def _views_and_buys(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.filter("event_type = 'view'").map(user_id="user_id", ts="ts", v="event_id"), e.filter("event_type = 'purchase'").map(user_id="user_id", ts="ts", p="event_id")


_VB = f"WITH {EVENTS}, a AS (SELECT user_id, ts, event_id AS v FROM e WHERE event_type = 'view'), b AS (SELECT user_id AS r_user_id, ts AS r_ts, event_id AS r_p FROM e WHERE event_type = 'purchase')"


@query(f"{_VB} SELECT v, r_p, greatest(ts, r_ts) AS ts FROM a JOIN b ON r_ts BETWEEN ts - {HOUR} AND ts + {2 * HOUR}")
def interval_join(spark, sf_dir):
    a, b = _views_and_buys(spark, sf_dir)
    return a.interval_join(b, "ts", "ts", HOUR, 2 * HOUR).df.select("v", "r_p", F.greatest("ts", "r_ts").alias("ts"))


@query(f"{_VB} SELECT user_id, v, r_p FROM a JOIN b ON user_id = r_user_id AND r_ts BETWEEN ts AND ts + {DAY}")
def keyed_interval_join(spark, sf_dir):
    a, b = _views_and_buys(spark, sf_dir)
    return a.to_keyed("user_id").interval_join(b.to_keyed("user_id"), "ts", "ts", 0, DAY).df.select("user_id", "v", "r_p")


@query(f"{_VB}, m AS (SELECT u, min(t) AS t0 FROM (SELECT user_id AS u, ts AS t FROM a UNION ALL SELECT r_user_id, r_ts FROM b) GROUP BY u) SELECT user_id, v, r_p, t0 + (ts - t0) // {DAY} * {DAY} AS win FROM a JOIN b ON user_id = r_user_id JOIN m ON user_id = u WHERE (ts - t0) // {DAY} = (r_ts - t0) // {DAY}")
def window_join(spark, sf_dir):
    a, b = _views_and_buys(spark, sf_dir)
    return a.to_keyed("user_id").window_join(win.EventTimeWindow.tumbling(DAY), b.to_keyed("user_id")).df.select("user_id", "v", "r_p", "win")


@query(f"{_VB} SELECT user_id, v, r_p AS last_buy FROM a ASOF LEFT JOIN b ON user_id = r_user_id AND ts >= r_ts")
def asof_join(spark, sf_dir):
    a, b = _views_and_buys(spark, sf_dir)
    return joins.asof_join(a.df, b.df, ["user_id"], "ts", "ts", "p", "last_buy").select("user_id", "v", "last_buy")


# Windows

_NUMBERED = f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM e)"
_SLID = "w AS (SELECT r.*, win FROM r, unnest(range(greatest(0, ceil((rn - {size} + 1) / {slide}.0)::BIGINT), rn // {slide} + 1)) AS u(win))"


def users(spark, sf_dir):
    return events(spark, sf_dir).to_keyed("user_id")


@query(f"{_NUMBERED} SELECT user_id, rn // 10 AS win, count(*) AS n, {money('value')} AS total FROM r GROUP BY ALL HAVING count(*) = 10")
def count_window_tumbling(spark, sf_dir):
    return users(spark, sf_dir).window(win.CountWindow.tumbling(10), ["event_id"]).fold(n="count(*)", total=money("value")).df


@query(f"{_NUMBERED}, {_SLID.format(size=10, slide=5)} SELECT user_id, win, min(value) AS low, max(value) AS high, arg_min(event_id, event_id) AS first, arg_max(event_id, event_id) AS last FROM w GROUP BY user_id, win HAVING count(*) = 10")
def count_window_sliding(spark, sf_dir):
    return users(spark, sf_dir).window(win.CountWindow.sliding(10, 5), ["event_id"]).fold(low="min(value)", high="max(value)", first=win.first_value("event_id", ["event_id"]), last=win.last_value("event_id", ["event_id"])).df


@query(f"{_NUMBERED}, {_SLID.format(size=4, slide=1)}, a AS (SELECT user_id, win, count(*) AS n FROM w GROUP BY user_id, win), b AS (SELECT *, min(CASE WHEN n < 4 THEN win END) OVER (PARTITION BY user_id) AS first_open FROM a) SELECT user_id, win, n FROM b WHERE n = 4 OR win = first_open")
def count_window_inexact(spark, sf_dir):
    return users(spark, sf_dir).window(win.CountWindow(4, 1, exact=False), ["event_id"]).fold(n="count(*)").df


@query(f"WITH {EVENTS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS win, count(*) OVER f AS n, max(value) OVER f AS high FROM e WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def last_k_window(spark, sf_dir):
    return users(spark, sf_dir).window(win.LastKWindow(5), ["event_id"]).fold(n="count(*)", high="max(value)").df


@query(f"WITH {EVENTS} SELECT user_id, 0::BIGINT AS win, min(ts) AS first_ts, count(*) AS n FROM e GROUP BY user_id")
def all_window(spark, sf_dir):
    return users(spark, sf_dir).window(win.AllWindow()).fold(first_ts="min(ts)", n="count(*)").df


_ANCHORED = f"WITH {EVENTS}, d AS (SELECT *, ts - min(ts) OVER (PARTITION BY user_id) AS d, min(ts) OVER (PARTITION BY user_id) AS t0 FROM e)"


@query(f"{_ANCHORED} SELECT user_id, t0 + d // {DAY} * {DAY} AS win, count(*) AS n, {money('value')} AS total FROM d GROUP BY ALL")
def event_window_tumbling(spark, sf_dir):
    return users(spark, sf_dir).window(win.EventTimeWindow.tumbling(DAY)).fold(n="count(*)", total=money("value")).df


@query(f"{_ANCHORED}, w AS (SELECT d.*, t0 + k * {DAY} AS win FROM d, unnest(range(greatest(0, floor((d - {3 * DAY}) / {DAY}.0)::BIGINT + 1), d // {DAY} + 1)) AS u(k)) SELECT user_id, win, count(*) AS n FROM w GROUP BY ALL")
def event_window_sliding(spark, sf_dir):
    return users(spark, sf_dir).window(win.EventTimeWindow.sliding(3 * DAY, DAY)).count().df.withColumnRenamed("count", "n")


@query(f"{_ANCHORED} SELECT user_id, t0 + d // {3 * DAY} * {3 * DAY} AS win, count(*) AS n FROM d WHERE d % {3 * DAY} < {DAY} GROUP BY ALL")
def event_window_gaps(spark, sf_dir):
    return users(spark, sf_dir).window(win.EventTimeWindow.sliding(DAY, 3 * DAY)).fold(n="count(*)").df


@query(f"WITH {EVENTS} SELECT event_type, ts // {DAY} * {DAY} AS win, count(*) AS n FROM e GROUP BY ALL")
def event_window_epoch(spark, sf_dir):
    return events(spark, sf_dir).to_keyed("event_type").window(win.EventTimeWindow.tumbling(DAY, align="epoch")).fold(n="count(*)").df


@query(f"WITH {EVENTS}, w AS (SELECT e.*, k * {HOUR} AS win FROM e, unnest(range(floor((ts - {6 * HOUR}) / {HOUR}.0)::BIGINT + 1, ts // {HOUR} + 1)) AS u(k)) SELECT event_type, win, count(*) AS n FROM w GROUP BY ALL")
def event_window_sliding_epoch(spark, sf_dir):
    return events(spark, sf_dir).to_keyed("event_type").window(win.EventTimeWindow.sliding(6 * HOUR, HOUR, align="epoch")).fold(n="count(*)").df


@query(f"WITH {EVENTS}, m AS (SELECT min(ts) AS t0 FROM e) SELECT t0 + (ts - t0) // {DAY} * {DAY} AS win, max(value) AS max FROM e, m GROUP BY ALL")
def window_all_max(spark, sf_dir):
    return events(spark, sf_dir).window_all(win.EventTimeWindow.tumbling(DAY)).max("value").df


@query(f"WITH {EVENTS}, s AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > {6 * HOUR}, true) AS opens FROM e), g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM s) SELECT user_id, min(ts) AS win, count(*) AS n, max(ts) AS last_ts FROM g GROUP BY user_id, s")
def session_window(spark, sf_dir):
    return users(spark, sf_dir).window(win.SessionWindow(6 * HOUR)).fold(n="count(*)", last_ts="max(ts)").df


@query(f"WITH {EVENTS}, t AS (SELECT *, coalesce(sum((event_type IN ('purchase', 'error'))::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS win FROM e) SELECT user_id, win, count(*) AS n FROM t GROUP BY user_id, win HAVING bool_or(event_type = 'purchase')")
def transaction_window(spark, sf_dir):
    return users(spark, sf_dir).window(win.TransactionWindow("event_type = 'purchase'", "event_type = 'error'"), ["event_id"]).fold(n="count(*)").df


@query(f"{_NUMBERED} SELECT user_id, rn // 8 AS win, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM r GROUP BY ALL HAVING count(*) = 8")
def window_to_vec(spark, sf_dir):
    out = users(spark, sf_dir).window(win.CountWindow.tumbling(8), ["event_id"]).to_vec("event_type").df
    return out.select("user_id", "win", F.array_join("vec", ",").alias("kinds"))


@query(f"{_NUMBERED} SELECT user_id, rn // 8 AS win, string_agg(event_type, '>' ORDER BY event_id) AS out FROM r GROUP BY ALL HAVING count(*) = 8")
def window_fold_first(spark, sf_dir):
    return users(spark, sf_dir).window(win.CountWindow.tumbling(8), ["event_id"]).fold_first("event_type", lambda a, b: F.concat(a, F.lit(">"), b)).df


@query(f"{_NUMBERED} SELECT user_id, rn // 8 AS win, (list(event_id ORDER BY value, event_id))[1] AS low_id, (list(event_id ORDER BY value DESC, event_id))[1] AS high_id FROM r GROUP BY ALL HAVING count(*) = 8")
def window_extremes(spark, sf_dir):
    return users(spark, sf_dir).window(win.CountWindow.tumbling(8), ["event_id"]).fold(low_id=win.min_by_key(F.col("event_id"), "value", ["event_id"]), high_id=win.max_by_key(F.col("event_id"), "value", ["event_id"])).df


@query(f"WITH {EVENTS} SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM e GROUP BY user_id")
def window_to_arrow(spark, sf_dir):
    import pyarrow as pa

    def both(table):
        return pa.table({"user_id": table["user_id"].slice(0, 1), "n": pa.array([table.num_rows]), "ids": pa.array([sum(table["event_id"].to_pylist())])})

    return users(spark, sf_dir).window(win.AllWindow(), ["event_id"]).to_arrow(both, "user_id long, n long, ids long").df


# State


@query(f"WITH {EVENTS} SELECT event_id, user_id, count(*) OVER f AS seen, max(value) OVER f AS high FROM e WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running(spark, sf_dir):
    return users(spark, sf_dir).running(["event_id"], seen="count(*)", high="max(value)").df.select("event_id", "user_id", "seen", "high")


@query(f"WITH {EVENTS} SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e")
def rich_map(spark, sf_dir):
    def make():
        last = [None]

        def step(row):
            before, last[0] = last[0], row["event_type"]
            return {"event_id": row["event_id"], "user_id": row["user_id"], "before": before}

        return step

    return users(spark, sf_dir).rich_map(["event_id"], make, "event_id long, user_id long, before string").df


@query(f"WITH {EVENTS} SELECT event_id, user_id FROM e QUALIFY coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type, true)")
def rich_filter_map(spark, sf_dir):
    def make():
        last = [None]

        def step(row):
            changed, last[0] = row["event_type"] != last[0], row["event_type"]
            return {"event_id": row["event_id"], "user_id": row["user_id"]} if changed else None

        return step

    return users(spark, sf_dir).rich_filter_map(["event_id"], make, "event_id long, user_id long").df


@query(f"{_NUMBERED} SELECT event_id, user_id, unnest(range(0, rn % 3)) AS copy FROM r")
def rich_flat_map(spark, sf_dir):
    def make():
        seen = [-1]

        def step(row):
            seen[0] += 1
            return [{"event_id": row["event_id"], "user_id": row["user_id"], "copy": k} for k in range(seen[0] % 3)]

        return step

    return users(spark, sf_dir).rich_flat_map(["event_id"], make, "event_id long, user_id long, copy long").df


@query(f"WITH {EVENTS} SELECT user_id, count(*) AS n, max(event_id) AS last FROM e GROUP BY user_id")
def rich_map_custom(spark, sf_dir):
    def make():
        state = {}

        def step(row):
            if row is None:
                return [state]
            state.update(user_id=row["user_id"], n=state.get("n", 0) + 1, last=row["event_id"])
            return []

        return step

    return users(spark, sf_dir).rich_map_custom(["event_id"], make, "user_id long, n long, last long").df


@query(f"WITH {EVENTS} SELECT event_id, ts FROM e")
def reorder(spark, sf_dir):
    return events(spark, sf_dir).map(event_id="event_id", ts="ts").reorder("ts", "event_id").df


# Combination, order, distribution


@query("SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def merge(spark, sf_dir):
    return flow(spark, sf_dir, "customer").map(id="c_custkey").merge(flow(spark, sf_dir, "supplier").map(id="s_suppkey")).df


@query("SELECT c_custkey, NULL::BIGINT AS s_suppkey, 'left' AS side FROM customer UNION ALL SELECT NULL, s_suppkey, 'right' FROM supplier")
def merge_tagged(spark, sf_dir):
    return flow(spark, sf_dir, "customer").map(c_custkey="c_custkey").merge_tagged(flow(spark, sf_dir, "supplier").map(s_suppkey="s_suppkey")).df


@query("SELECT DISTINCT l_returnflag, l_quantity FROM lineitem")
def unique(spark, sf_dir):
    return flow(spark, sf_dir, "lineitem").map(l_returnflag="l_returnflag", l_quantity="l_quantity").unique().df


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def unique_by_key(spark, sf_dir):
    return flow(spark, sf_dir, "orders").map(o_custkey="o_custkey", o_orderkey="o_orderkey", o_orderstatus="o_orderstatus").unique_by_key(["o_custkey"], ["o_orderkey"]).df


@query("WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM customer), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier) SELECT position, c_custkey, s_suppkey FROM a JOIN b USING (position)", "zip")
def zip_flows(spark, sf_dir):
    a = flow(spark, sf_dir, "customer").map(c_custkey="c_custkey", c_acctbal="c_acctbal")
    return a.zip(flow(spark, sf_dir, "supplier").map(s_suppkey="s_suppkey"), ["c_acctbal", "c_custkey"], ["s_suppkey"]).df.select("position", "c_custkey", "s_suppkey")


@query("SELECT n_nationkey, 'a' AS copy FROM nation UNION ALL SELECT n_nationkey, 'b' FROM nation")
def split(spark, sf_dir):
    a, b = flow(spark, sf_dir, "nation").map(n_nationkey="n_nationkey").split(2)
    return a.with_columns(copy="'a'").merge(b.with_columns(copy="'b'")).df


@query("SELECT event_id, CASE WHEN value < 5 THEN 'low' WHEN event_type = 'view' THEN 'view' END AS way FROM events WHERE value < 5 OR event_type = 'view'")
def route(spark, sf_dir):
    low, view = flow(spark, sf_dir, "events").route("value < 5", "event_type = 'view'")
    return low.map(event_id="event_id", way="'low'").merge(view.map(event_id="event_id", way="'view'")).df


@query("SELECT n_nationkey, r.range::INT AS replica FROM nation, range(0, 4) AS r")
def broadcast_rows(spark, sf_dir):
    return flow(spark, sf_dir, "nation").map(n_nationkey="n_nationkey").broadcast(4).df


@query("SELECT p_partkey FROM part")
def shuffle(spark, sf_dir):
    return flow(spark, sf_dir, "part").map(p_partkey="p_partkey").shuffle().df


@query("SELECT p_partkey, (p_partkey % 4)::INT AS task FROM part")
def repartition_by(spark, sf_dir):
    return flow(spark, sf_dir, "part").map(p_partkey="p_partkey").repartition_by(4, "p_partkey % 4").df.withColumn("task", F.spark_partition_id())


@query("SELECT p_partkey FROM part")
def replication(spark, sf_dir):
    return flow(spark, sf_dir, "part").map(p_partkey="p_partkey").replication(2).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sorted_by(spark, sf_dir):
    return flow(spark, sf_dir, "orders").map(o_orderkey="o_orderkey", o_totalprice="o_totalprice").sorted_by(F.desc("o_totalprice"), "o_orderkey").df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def sorted_limit_by(spark, sf_dir):
    return flow(spark, sf_dir, "orders").map(o_orderkey="o_orderkey", o_totalprice="o_totalprice").sorted_limit_by(F.desc("o_totalprice"), "o_orderkey", n=25, offset=5).df


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS place FROM customer QUALIFY place <= 3")
def top_k(spark, sf_dir):
    return ordering.top_k(flow(spark, sf_dir, "customer").df.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 3, F.desc("c_acctbal"), F.col("c_custkey")).drop("c_acctbal")


@query("SELECT l_partkey AS k FROM lineitem INTERSECT ALL SELECT l_suppkey FROM lineitem")
def intersect_all(spark, sf_dir):
    items = flow(spark, sf_dir, "lineitem").df
    return items.select(F.col("l_partkey").alias("k")).intersectAll(items.select("l_suppkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def except_all(spark, sf_dir):
    return flow(spark, sf_dir, "customer").df.select(F.col("c_custkey").alias("k")).exceptAll(flow(spark, sf_dir, "orders").df.where("o_orderkey % 2 = 0").select("o_custkey"))


# Loops


@query("WITH RECURSIVE r(round, value) AS (SELECT 0, n_nationkey FROM nation UNION ALL SELECT round + 1, value + 10 FROM r WHERE round < 3) SELECT value, (SELECT sum(value) FROM r WHERE round > 0)::BIGINT AS state FROM r WHERE round = 3")
def iterate(spark, sf_dir):
    rows = flow(spark, sf_dir, "nation").map(value="n_nationkey")
    state, out = rows.iterate(3, 0, lambda df, _: df.select((F.col("value") + 10).alias("value")), lambda df: df.agg(F.sum("value")).first()[0], lambda s, d: s + d)
    return out.df.withColumn("state", F.lit(state).cast("long"))


@query("SELECT (3 * (SELECT sum(n_nationkey + 10) FROM nation))::BIGINT AS state")
def replay(spark, sf_dir):
    rows = flow(spark, sf_dir, "nation").map(value="n_nationkey")
    state = rows.replay(3, 0, lambda df, _: df.select((F.col("value") + 10).alias("value")), lambda df: df.agg(F.sum("value")).first()[0], lambda s, d: s + d)
    return spark.createDataFrame([(state,)], "state long")


@query("SELECT o_orderkey AS node, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS best FROM orders")
def delta_iterate(spark, sf_dir):
    """The least price of each order and those of its customer before it, passed on from order to order until nothing falls."""
    orders = catalog_loops.next_orders(spark, sf_dir)
    links, table = bucketed(orders, "src", max(spark.sparkContext.defaultParallelism, flow(spark, sf_dir, "orders").df.count() >> 20))
    solution = flow(spark, sf_dir, "orders").df.select(F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("best"))
    step = lambda df: df.join(links, df["node"] == links["src"]).select(F.col("dst").alias("node"), F.col("best").alias("offer"))
    lower = lambda df: df.select("node", F.least("best", F.coalesce("offer", "best")).alias("best"), (F.coalesce("offer", "best") < F.col("best")).alias("changed"))
    out = iteration.delta_iterate(solution, step(solution), 1000, "node", lower, step)
    drop(spark, table)
    return out


@query("WITH RECURSIVE c(value, v, steps) AS (SELECT range, range, 0 FROM range(1, 2000) UNION ALL SELECT value, CASE WHEN v % 2 = 0 THEN v // 2 ELSE 3 * v + 1 END, steps + 1 FROM c WHERE v > 1) SELECT value, max(steps)::BIGINT AS steps FROM c GROUP BY value ORDER BY steps DESC, value LIMIT 1")
def collatz(spark, sf_dir):
    return graphs.collatz_longest(spark, 2000)


# Workloads


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def wordcount(spark, sf_dir):
    return Flow(flow(spark, sf_dir, "documents").df.select(F.explode(fn.tokens("text")).alias("word"))).group_by_fold({"word": "word"}, n="count(*)").df


@query("WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS ws FROM documents), r AS (SELECT doc_id, ws[i] AS word, i FROM w, unnest(range(1, len(ws) + 1)) AS u(i)), n AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id, i) - 1 AS rn FROM r WHERE word <> ''), s AS (SELECT n.*, win FROM n, unnest(range(greatest(0, ceil((rn - 9) / 5.0)::BIGINT), rn // 5 + 1)) AS u(win)) SELECT word, win, count(*) AS n FROM s GROUP BY word, win HAVING count(*) = 10")
def wordcount_windowed(spark, sf_dir):
    words = flow(spark, sf_dir, "documents").df.select("doc_id", F.posexplode(fn.tokens("text")).alias("i", "word"))
    return Flow(words).to_keyed("word").window(win.CountWindow.sliding(10, 5), ["doc_id", "i"]).fold(n="count(*)").df


@query(f"WITH {EVENTS}, c AS (SELECT k * {DAY} AS win, event_type, count(*) AS n FROM e, unnest(range(ts // {DAY} - 1, ts // {DAY} + 1)) AS u(k) GROUP BY ALL) SELECT win, event_type, n, row_number() OVER (PARTITION BY win ORDER BY n DESC, event_type)::INT AS place FROM c QUALIFY place <= 3")
def rolling_top_words(spark, sf_dir):
    """Counts in windows of two days that slide by one, then the first three of each step in a window over all words."""
    counts = events(spark, sf_dir).to_keyed("event_type").window(win.EventTimeWindow.sliding(2 * DAY, DAY, align="epoch")).fold(n="count(*)").df
    step = win.EventTimeWindow.tumbling(DAY, ts="win", align="epoch").assign(counts, [], [])
    return ordering.top_k(step, ["win"], 3, F.desc("n"), F.col("event_type"))


@query("SELECT (dayofyear(o_orderdate) // 7)::BIGINT AS week, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled FROM orders GROUP BY ALL")
def accidents_per_week(spark, sf_dir):
    return Flow(flow(spark, sf_dir, "orders").df.select(fn.week_of_year("o_orderdate").alias("week"), "o_orderstatus")).group_by_fold({"week": "week"}, n="count(*)", filled="count_if(o_orderstatus = 'F')").df


@query("SELECT factor, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS heavy FROM (SELECT l_quantity, unnest(list_distinct([l_returnflag, l_linestatus])) AS factor FROM lineitem) GROUP BY factor")
def accidents_per_factor(spark, sf_dir):
    return flow(spark, sf_dir, "lineitem").flat_map("factor", "array_distinct(array(l_returnflag, l_linestatus))").group_by_fold({"factor": "factor"}, n="count(*)", heavy="count_if(l_quantity > 25)").df


@query("WITH w AS (SELECT o_orderpriority AS place, (dayofyear(o_orderdate) // 7)::BIGINT AS week, count(*) AS n FROM orders GROUP BY ALL) SELECT place, count(*) AS weeks, sum(n)::BIGINT AS n, round(avg(n), 6) AS per_week FROM w GROUP BY place")
def accidents_per_place(spark, sf_dir):
    weekly = Flow(flow(spark, sf_dir, "orders").df.select(F.col("o_orderpriority").alias("place"), fn.week_of_year("o_orderdate").alias("week"))).group_by_fold({"place": "place", "week": "week"}, n="count(*)")
    return weekly.unkey().group_by_fold({"place": "place"}, weeks="count(*)", n="sum(n)", per_week="round(avg(n), 6)").df.withColumn("per_week", F.col("per_week"))


def _auction(spark, sf_dir):
    people = flow(spark, sf_dir, "customer").df.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), F.col("c_nationkey").cast("string").alias("state"), (F.lit(788918400000000) + F.col("c_custkey") % 100 * DAY).alias("date_time"))
    opened = micros("o_orderdate")
    auctions = flow(spark, sf_dir, "orders").df.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seller"), F.substring("o_orderpriority", 1, 1).cast("long").alias("category"), (F.col("o_orderkey") % 50 * 1000).alias("reserve"), opened.alias("date_time"), (opened + 60 * DAY).alias("expires"))
    bids = flow(spark, sf_dir, "lineitem").df.select(F.col("l_orderkey").alias("auction"), F.col("l_suppkey").alias("bidder"), F.floor("l_extendedprice").alias("price"), micros("l_shipdate").alias("date_time"))
    return people, auctions, bids


_NX = f"""WITH person AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS city, c_nationkey::VARCHAR AS state, 788918400000000 + c_custkey % 100 * {DAY} AS date_time FROM customer),
auction AS (SELECT o_orderkey AS id, o_custkey AS seller, substr(o_orderpriority, 1, 1)::BIGINT AS category, o_orderkey % 50 * 1000 AS reserve, epoch_us(o_orderdate) AS date_time, epoch_us(o_orderdate) + {60 * DAY} AS expires FROM orders),
bid AS (SELECT l_orderkey AS auction, l_suppkey AS bidder, floor(l_extendedprice)::BIGINT AS price, epoch_us(l_shipdate) AS date_time FROM lineitem),
won AS (SELECT auction, seller, category, bidder, price, bid.date_time, expires FROM bid JOIN auction a ON bid.auction = a.id AND price >= reserve AND bid.date_time >= a.date_time AND bid.date_time < expires QUALIFY row_number() OVER (PARTITION BY auction ORDER BY price DESC, bid.date_time, bidder) = 1)"""


@query(f"{_NX} SELECT * FROM bid")
def nexmark_q0(spark, sf_dir):
    return nexmark.q0(_auction(spark, sf_dir)[2])


@query(f"{_NX} SELECT auction, bidder, trunc(price::FLOAT * 0.908::FLOAT)::BIGINT AS price, date_time FROM bid")
def nexmark_q1(spark, sf_dir):
    return nexmark.q1(_auction(spark, sf_dir)[2])


@query(f"{_NX} SELECT auction, price FROM bid WHERE auction % 123 = 0")
def nexmark_q2(spark, sf_dir):
    return nexmark.q2(_auction(spark, sf_dir)[2])


@query(f"{_NX} SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id WHERE a.category = 1 AND p.state IN ('1', '5', '9')")
def nexmark_q3(spark, sf_dir):
    people, auctions, _ = _auction(spark, sf_dir)
    return nexmark.q3(people, auctions, 1, ["1", "5", "9"])


@query(f"{_NX} SELECT * FROM won")
def nexmark_winning_bids(spark, sf_dir):
    _, auctions, bids = _auction(spark, sf_dir)
    return nexmark.winning_bids(auctions, bids)


@query(f"{_NX} SELECT category, round(avg(price), 6) AS avg_price FROM won GROUP BY category")
def nexmark_q4(spark, sf_dir):
    _, auctions, bids = _auction(spark, sf_dir)
    return nexmark.q4(auctions, bids).select("category", F.round("avg_price", 6).alias("avg_price"))


@query(f"{_NX} SELECT category, round(avg(price), 6) AS avg_price FROM won GROUP BY category")
def nexmark_q4_opt(spark, sf_dir):
    _, auctions, bids = _auction(spark, sf_dir)
    return nexmark.q4_opt(auctions, bids).select("category", F.round("avg_price", 6).alias("avg_price"))


@query(f"{_NX} SELECT auction, category, bidder, price FROM won")
def commit_after(spark, sf_dir):
    """Winning bids by transaction windows that each auction opens, to be committed after it expires."""
    _, auctions, bids = _auction(spark, sf_dir)
    return nexmark.committed_bids(auctions, bids)


@query(f"{_NX}, w AS (SELECT auction, k * {2 * DAY} AS win, count(*) AS n FROM bid, unnest(range(floor((date_time - {10 * DAY}) / {2 * DAY}.0)::BIGINT + 1, date_time // {2 * DAY} + 1)) AS u(k) GROUP BY ALL) SELECT win, auction, n FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY n DESC, auction) = 1")
def nexmark_q5(spark, sf_dir):
    return nexmark.q5(_auction(spark, sf_dir)[2], 10 * DAY, 2 * DAY)


@query(f"{_NX}, r AS (SELECT *, row_number() OVER (PARTITION BY seller ORDER BY expires, auction) - 1 AS rn FROM won), s AS (SELECT r.*, win FROM r, unnest(range(greatest(0, rn - 3), rn + 1)) AS u(win)) SELECT seller, win, round(avg(price), 6) AS avg_price FROM s GROUP BY seller, win HAVING count(*) = 4")
def nexmark_q6(spark, sf_dir):
    _, auctions, bids = _auction(spark, sf_dir)
    return nexmark.q6(auctions, bids, 4).select("seller", "win", F.round("avg_price", 6).alias("avg_price"))


@query(f"{_NX} SELECT date_time // {10 * DAY} * {10 * DAY} AS win, auction, bidder, price FROM bid QUALIFY row_number() OVER (PARTITION BY win ORDER BY price DESC, date_time, auction, bidder) = 1")
def nexmark_q7(spark, sf_dir):
    return nexmark.q7(_auction(spark, sf_dir)[2], 10 * DAY)


@query(f"{_NX} SELECT p.id AS seller, name, p.date_time // {100 * DAY} * {100 * DAY} AS win, a.id AS auction FROM person p JOIN auction a ON a.seller = p.id AND p.date_time // {100 * DAY} = a.date_time // {100 * DAY}")
def nexmark_q8(spark, sf_dir):
    people, auctions, _ = _auction(spark, sf_dir)
    return nexmark.q8(people, auctions, 100 * DAY)
