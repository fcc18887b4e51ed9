"""Small goldens for the fluent interface: numbers in, known results out."""

import asyncio
import itertools

import pytest
from pyspark.sql import functions as F

from tarnflow.flow import Engine
from tarnflow.operators import joins, ordering
from tarnflow.operators import windows as win
from tarnflow.operators.stateful import commit_after
from tarnflow.plans import graphs, iteration


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def vals(flow, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in flow.df.collect())


def numbers(engine, n, start=0):
    return engine.integers(start, start + n)


def test_fold_in_order_and_reduce(engine):
    text = numbers(engine, 10).fold_rows(["value"], str, lambda s, r: s + str(r["value"]), lambda s: {"text": s}, "text string")
    assert vals(text, "text") == ["0123456789"]
    assert vals(numbers(engine, 10).reduce(total="sum(value)"), "total") == [45]


def test_empty_input_gives_no_row(engine):
    none = numbers(engine, 10).filter("value < 0")
    assert none.fold(total="sum(value)").collect_vec() == [] and none.collect_count() == 0
    assert none.fold_rows(["value"], int, lambda s, r: s + 1, lambda s: {"n": s}, "n long").collect_vec() == []
    assert none.group_by_count({"k": "value % 2"}).collect_vec() == []


def test_extreme_elements(engine):
    flow = numbers(engine, 10)
    assert vals(flow.group_by_min_element({"k": "value % 2"}, "value", ["value"]), "k", "value") == [(0, 0), (1, 1)]
    assert vals(flow.with_columns(v="value DIV 4").group_by_max_element({"k": "value % 2"}, "v", ["value"]), "k", "value") == [(0, 8), (1, 9)]
    words = engine.rows([(1, "b", 2), (1, "b", 1), (1, "a", 0)], "k int, v string, s int")
    assert vals(words.group_by_max_element({"k": "k"}, "v", ["s"]), "k", "s") == [(1, 1)]
    nulls = engine.rows([(1, None, 1), (1, 5, 2), (2, None, 3), (None, 1, 4)], "k int, v int, s int")
    assert vals(nulls.group_by_max_element({"k": "k"}, "v", ["s"]).filter("k is not null"), "k", "s") == [(1, 2), (2, 3)]


def test_scans(engine):
    assert vals(numbers(engine, 10, 200).fold_scan(n="count(*)"), "value", "n") == [(x, 10) for x in range(200, 210)]
    assert vals(numbers(engine, 10, 200).reduce_scan(t="sum(value)", n="count(*)"), "value", "t", "n") == [(x, 2045, 10) for x in range(200, 210)]
    keyed = numbers(engine, 100).key_by(k="value % 5").fold_scan(t="sum(value)")
    assert vals(keyed, "k", "value", "t") == sorted((x % 5, x, sum(range(x % 5, 100, 5))) for x in range(100))


@pytest.mark.parametrize(("how", "strategy"), list(itertools.product(["inner", "left", "full"], [None, "hash", "sort_merge", "broadcast_right"])))
def test_join_matrix(engine, how, strategy):
    l, r = numbers(engine, 12).with_columns(k="CASE WHEN value = 11 THEN NULL ELSE value % 7 END"), numbers(engine, 9).with_columns(k="CASE WHEN value = 8 THEN NULL ELSE value % 5 END")  # noqa: E741
    a = [(None if x == 11 else x % 7, x) for x in range(12)]
    b = [(None if x == 8 else x % 5, x) for x in range(9)]
    expected = [(ka, x, y) for ka, x in a for kb, y in b if ka == kb]
    if how != "inner":
        expected += [(ka, x, None) for ka, x in a if all(ka != kb for kb, _ in b)]
    if how == "full":
        expected += [(kb, None, y) for kb, y in b if all(ka != kb for ka, _ in a)]
    got = l.join(r, ("k", "k"), how=how, strategy=strategy)
    assert sorted(((x.k0, x.value, x.r_value) for x in got.collect_vec()), key=str) == sorted(expected, key=str)


def test_self_join(engine):
    left = numbers(engine, 200)
    right = left.map(value="value * 2").shuffle()
    got = left.filter("value % 2 = 0").key_by(k="value % 2").join_keyed(right.key_by(k="value % 2"))
    assert got.collect_count() == 100 * 200


def test_interval_join(engine):
    l, r = numbers(engine, 10).with_columns(ts="value"), numbers(engine, 10).with_columns(ts="value")  # noqa: E741
    pairs = [(x, y) for x in range(10) for y in range(10) if x - 1 <= y <= x + 2]
    assert vals(l.interval_join(r, "ts", "ts", 1, 2), "value", "r_value") == pairs
    keyed = l.key_by(k="value % 2").interval_join(r.key_by(k="value % 2"), "ts", "ts", 1, 2)
    assert vals(keyed, "value", "r_value") == [(x, y) for x, y in pairs if x % 2 == y % 2]
    plan = joins.interval_join(l.df, r.df, "ts", "ts", 1, 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def dealt(monkeypatch):
    """Nearly every key is hot."""
    monkeypatch.setattr(joins, "HOT_PAIRS", 20)
    monkeypatch.setattr(joins, "CELL_ROWS", 4)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("strategy", list(joins.STRATEGIES))
def test_join_of_hot_keys(spark, monkeypatch, how, strategy):
    """Hot keys (null among them) beside cold ones and ones that the other side lacks, of two integer types, with repeated rows."""
    dealt(monkeypatch)
    a = [(None if i % 5 == 0 else i % 11, i) for i in range(60)] + [(99, 1)] * 3 + [(1, 1)] * 3
    b = [(None if i % 4 == 0 else i % 13, i) for i in range(70)] + [(98, 5)]
    expected = [(x, v, w) for x, v in a for y, w in b if x == y]
    expected += [(x, v, None) for x, v in a if how in ("left", "full") and all(x != y for y, _ in b)]
    expected += [(y, None, w) for y, w in b if how in ("right", "full") and all(y != x for x, _ in a)]
    out = joins.equi_join(spark.createDataFrame(a, "k int, v int"), spark.createDataFrame(b, "k long, v int"), [("k", "k")], how, strategy)
    assert sorted(map(str, out.select("k0", "v", "r_v").collect())) == sorted(map(str, spark.createDataFrame(expected, "k0 long, v int, r_v int").collect()))


def test_pairs_of_a_key_are_spread(spark):
    """Null keys with nine million pairs: no task makes more than a few cells of them, whatever the strategy."""
    nulls = lambda n: spark.range(n).select(F.expr("if(id % 2 = 0, null, id)").alias("k"), "id")
    for how, strategy in [("full", None), ("inner", "hash"), ("left", "broadcast_right"), ("inner", "sort_merge")]:
        out = joins.equi_join(nulls(6000), nulls(6000), [("k", "k")], how, strategy)
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 3000 * 3000 + 3000 and max(tasks) < 4_000_000


def test_interval_join_of_dense_times(spark, monkeypatch):
    """A bucket of time with very many pairs is spread as well; with and without keys, null ones among them."""
    dealt(monkeypatch)
    rows = [(None if i % 7 == 0 else i % 2, i % 40 // 3, i) for i in range(80)] + [(1, None, -1)]
    a, b = spark.createDataFrame(rows, "k int, ts long, v int"), spark.createDataFrame(rows, "k int, ts long, w int")
    near = [(k, v, h, w) for k, t, v in rows for h, u, w in rows if None not in (t, u) and t - 1 <= u <= t + 2]
    assert sorted((r.v, r.r_w) for r in joins.interval_join(a, b, "ts", "ts", 1, 2).collect()) == sorted((v, w) for _, v, _, w in near)
    assert sorted((r.v, r.r_w) for r in joins.interval_join(a, b, "ts", "ts", 1, 2, [("k", "k")]).collect()) == sorted((v, w) for k, v, h, w in near if k == h)
    monkeypatch.undo()
    dense = spark.range(3000).select(F.lit(5).cast("long").alias("ts"), "id")
    tasks = [r["count"] for r in joins.interval_join(dense, dense, "ts", "ts", 1, 2).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 3000 * 3000 and max(tasks) < 4_000_000


def test_count_windows(engine):
    w = numbers(engine, 10).window_all(win.CountWindow.sliding(3, 2), ["value"])
    assert [x for _, x in vals(w.sum("value"), "win", "sum")] == [3, 9, 15, 21]
    assert [x for _, x in vals(w.first("value"), "win", "first")] == [0, 2, 4, 6]
    exact = numbers(engine, 5, 1).window_all(win.CountWindow(4, 1), ["value"]).to_vec("value")
    assert [x for _, x in vals(exact, "win", "vec")] == [[1, 2, 3, 4], [2, 3, 4, 5]]
    loose = numbers(engine, 5, 1).window_all(win.CountWindow(4, 1, exact=False), ["value"]).to_vec("value")
    assert [x for _, x in vals(loose, "win", "vec")] == [[1, 2, 3, 4], [2, 3, 4, 5], [3, 4, 5]]
    wide = numbers(engine, 10).window_all(win.CountWindow(3, 5), ["value"]).to_vec("value")
    assert [x for _, x in vals(wide, "win", "vec")] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]


def test_last_k(engine):
    out = numbers(engine, 6).window_all(win.LastKWindow(3), ["value"]).to_vec("value")
    assert [x for _, x in vals(out, "win", "vec")] == [[0], [0, 1], [0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 5]]


def test_event_windows(engine):
    flow = numbers(engine, 99, 1).with_columns(ts="cast(floor(value / 10) as bigint)")
    out = flow.window_all(win.EventTimeWindow.sliding(5, 4), ["value"]).to_vec("value")
    assert [x for _, x in vals(out, "win", "vec")] == [list(range(1, 50)), list(range(40, 90)), list(range(80, 100))]
    gaps = numbers(engine, 10).with_columns(ts="value").window_all(win.EventTimeWindow.sliding(2, 5), ["value"]).to_vec("value")
    assert [x for _, x in vals(gaps, "win", "vec")] == [[0, 1], [5, 6]]


def test_session_windows(engine):
    flow = numbers(engine, 100).with_columns(ts="value + CASE WHEN value >= 33 THEN 100 ELSE 0 END + CASE WHEN value >= 80 THEN 100 ELSE 0 END")
    out = flow.window_all(win.SessionWindow(50), ["value"]).fold(a="min(value)", b="max(value)")
    assert vals(out, "a", "b") == [(0, 32), (33, 79), (80, 99)]


def test_transactions(engine):
    rows = [(1, "a", "c"), (2, "b", "commit"), (3, "c", "c"), (4, "d", "discard"), (5, "e", "commit"), (6, "f", "c")]
    flow = engine.rows(rows, "seq int, v string, op string")
    out = flow.window_all(win.TransactionWindow("op = 'commit'", "op = 'discard'"), ["seq"]).to_vec("v")
    assert [x for _, x in vals(out, "win", "vec")] == [["a", "b"], ["e"]]
    timed = engine.rows([(1, 1, None), (2, 2, 5), (3, 5, None), (4, 6, None), (5, 7, 9), (6, 8, None)], "seq int, ts int, close int")
    out = commit_after(timed.df.withColumn("k", F.lit(1)), ["k"], ["seq"], "ts", "close", "seqs string", lambda rows: {"seqs": ",".join(str(int(r["seq"])) for r in rows)})
    assert sorted(r.seqs for r in out.collect()) == ["1,2,3", "4,5,6"]


def test_window_reductions(engine):
    flow = numbers(engine, 6).with_columns(v="value % 3")
    w = flow.window_all(win.CountWindow.tumbling(6), ["value"])
    assert vals(w.max_by_key(F.col("value"), "v"), "max") == [2] and vals(w.min_by_key(F.col("value"), "v"), "min") == [0]
    assert vals(w.fold_first("value", lambda a, b: a * 2 + b), "out") == [57]
    assert vals(w.map("value", F.size), "out") == [6] and vals(w.last("value"), "last") == [5] and vals(w.count(), "count") == [6]


def test_route_split_merge_zip(engine):
    low, even = numbers(engine, 10).route("value < 5", "value % 2 = 0")
    assert vals(low, "value") == [0, 1, 2, 3, 4] and vals(even, "value") == [6, 8]
    a, b = numbers(engine, 5).split(2)
    assert vals(a.merge(b), "value") == sorted([*range(5)] * 2)
    names = engine.rows([(0, "x"), (1, "y"), (2, "z")], "at int, name string")
    assert vals(numbers(engine, 10).zip(names, ["value"], ["at"]), "value", "name") == [(0, "x"), (1, "y"), (2, "z")]
    assert vals(numbers(engine, 100).broadcast(3).fold(t="sum(value)"), "t") == [3 * 4950]


def test_unique(engine):
    flow = numbers(engine, 20).with_columns(k="value % 4")
    assert vals(flow.map(k="k").unique(), "k") == [0, 1, 2, 3]
    assert vals(flow.unique_by_key(["k"], ["value"]), "value") == [0, 1, 2, 3]


def test_flat_maps_and_filters(engine):
    nested = engine.rows([([1, 2, 3],), ([],), ([4, 5],), (None,)], "value array<int>")
    assert vals(nested.flatten("value"), "value") == [1, 2, 3, 4, 5]
    assert vals(numbers(engine, 6).filter_map("even", "CASE WHEN value % 2 = 0 THEN value * 10 END"), "even") == [0, 20, 40]
    assert vals(numbers(engine, 4).flat_map("x", "array_repeat(value, cast(value as int))"), "x") == [1, 2, 2, 3, 3, 3]


def test_prefix_sums_without_negatives(engine):
    def make():
        total = [0]

        def step(row):
            total[0] += row["value"]
            return {"total": total[0]} if total[0] >= 0 else None

        return step

    flow = engine.rows(list(enumerate([1, 2, -5, 3, 1])), "seq int, value int")
    assert [r.total for r in flow.rich_filter_map(["seq"], make, "total long").collect_vec()] == [1, 3, 1, 2]


def test_memo_and_async(engine):
    flow = numbers(engine, 100).with_columns(k="value % 3")
    out = flow.map_memo(["k"], lambda b: b["k"] * 7, "seven", "long")
    assert vals(out, "value", "seven") == [(x, x % 3 * 7) for x in range(100)]

    async def double(row):
        await asyncio.sleep(0)
        return {"value": row["value"] * 2}

    assert vals(numbers(engine, 30).map_async(double, "value long"), "value") == [2 * x for x in range(30)]


def test_loops(engine):
    add = lambda df, _: df.select((F.col("value") + 10).alias("value"))
    total = lambda df: df.agg(F.sum("value")).first()[0]
    state, out = numbers(engine, 3).iterate(3, 0, add, total, lambda s, d: s + d)
    assert state == 189 and vals(out, "value") == [30, 31, 32]
    assert numbers(engine, 3).replay(3, 0, add, total, lambda s, d: s + d) == 99
    state, _ = numbers(engine, 3).iterate(10, 0, add, total, lambda s, d: s + d, lambda s: s < 50)
    assert state == 33 + 63


def test_sieve_by_iteration(engine):
    def body(df, least):
        return df.where((F.col("value") % least != 0) | (F.col("value") == least))

    _, out = numbers(engine, 98, 2).iterate(9, 2, body, lambda df: None, lambda s, _: s + 1)
    assert vals(out, "value") == [p for p in range(2, 100) if all(p % q for q in range(2, p))]


def test_components_of_a_long_path(spark):
    """Ids in random order along a path, a lone node and a null end; and an error where the rounds are too few."""
    import random

    ids = list(range(10, 1010))
    random.Random(3).shuffle(ids)
    path = spark.createDataFrame([*zip(ids, ids[1:]), (5, 5), (6, None)], "src long, dst long")
    got = {r.node: r.component for r in graphs.connected_components(path).collect()}
    assert got == {k: 10 for k in ids} | {5: 5, 6: 6}
    with pytest.raises(RuntimeError):
        graphs.connected_components(path, rounds=2)


def test_graphs(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    labels = {r.node: r.component for r in graphs.connected_components(path).collect()}
    assert labels == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graphs.transitive_closure(path).count() == 40 * 41 // 2 + 1
    k5 = spark.createDataFrame([(a, b) for a in range(5) for b in range(a)], "src long, dst long")
    assert graphs.triangles(k5).first()[0] == 10


@pytest.mark.parametrize("hubs", [0, 1 << 20])
def test_ranks_of_a_directed_graph(spark, monkeypatch, hubs):
    """Two hubs that are broadcast or not, nodes that nothing leads to and ones that lead nowhere: the sums along the edges are the same."""
    import random

    monkeypatch.setattr(graphs, "MAX_HUBS", hubs)
    draw = random.Random(5)
    pairs = {(draw.randrange(50), draw.randrange(30, 80)) for _ in range(120)} | {(h, v) for h in (0, 1) for v in range(40)} | {(90, 5), (6, 91)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    nodes, degree = {x for p in pairs for x in p}, {x: sum(a == x for a, _ in pairs) for p in pairs for x in p}
    rank, before = dict.fromkeys(nodes, 1 / len(nodes)), {}
    whole = dict.fromkeys(nodes, 6_000_000)
    for _ in range(4):
        rank = {x: 0.15 / len(nodes) + 0.85 * sum(rank[a] / degree[a] for a, b in pairs if b == x) for x in nodes}
        whole = {x: 1_000_000 + sum(whole[a] * 5 // (6 * degree[a]) for a, b in pairs if b == x) for x in nodes}
    got = {r.node: r.rank for r in graphs.pagerank(edges, 4).collect()}
    assert got == {x: pytest.approx(v, abs=1e-12) for x, v in rank.items()}
    assert {r.node: r.rank for r in graphs.pagerank_delta(edges, 4).collect()} == whole
    state, led = dict.fromkeys(nodes, 1 / len(nodes)), {b for _, b in pairs}
    for _ in range(4):
        before, state = state, {x: 0.15 / len(nodes) + 0.85 * sum(state[a] / degree[a] for a, b in pairs if b == x and a in state) for x in led if any(a in state for a, b in pairs if b == x)}
    assert {r.node: r.rank for r in graphs.pagerank_stateful(edges, 4).collect()} == {x: pytest.approx(v, abs=1e-12) for x, v in state.items()}


def test_rounds_leave_the_edges_in_place(spark):
    """What nodes send is shuffled or broadcast; the edges are only read."""
    edges = spark.range(5000).selectExpr("id as src", "id % 1000 as dst")
    send = graphs.Sender(edges)
    plan = send(spark.range(5000).selectExpr("id as src", "1.0D as value"))._jdf.queryExecution().executedPlan().toString()
    send.close()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(src") <= 1 and "Exchange hashpartitioning(dst" in plan


def test_triangles_make_only_pairs_that_may_close(spark, monkeypatch):
    """A bipartite graph has no pair to check; a random one with hubs has the triangles of brute force."""
    import random

    kept, write = {}, graphs.materialize
    monkeypatch.setattr(graphs, "materialize", lambda df, label: kept.setdefault(label, write(df, label)))
    two = spark.createDataFrame([(a, b) for a in range(12) for b in range(20, 35)], "src long, dst long")
    assert graphs.triangles(two).first()[0] == 0 and kept["mids"].isEmpty()
    kept.clear()
    draw = random.Random(2)
    pairs = {tuple(sorted(draw.sample(range(40), 2))) for _ in range(200)} | {(0, v) for v in range(1, 40)}
    expected = sum((a, b) in pairs and (b, c) in pairs and (a, c) in pairs for a, b, c in itertools.combinations(range(40), 3))
    assert graphs.triangles(spark.createDataFrame(sorted(pairs), "src long, dst long")).first()[0] == expected


def test_components_deal_edges_by_number(spark, monkeypatch):
    """Edges of each round go to as many tasks as their number asks for, and nothing sorts them to aggregate."""
    monkeypatch.setattr(graphs, "BUCKET_EDGES", 20)
    kept, write = [], graphs.materialize
    monkeypatch.setattr(graphs, "materialize", lambda df, label: kept.append((label, df._jdf.queryExecution().executedPlan().toString())) or write(df, label))
    pairs = [(i, (i * 7) % 90 + 200) for i in range(180)] + [(500, 501)]
    got = {r.node: r.component for r in graphs.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    dealt = [p for label, p in kept if label == "edges"][1:]
    assert dealt and all("REPARTITION_BY_NUM" in p and "18)" in p for p in dealt) and not any("SortAggregate" in p for _, p in kept)


def test_offers_meet_links_in_place(spark, monkeypatch):
    """Links are made once, not in each round."""
    from tarnflow import catalog

    plans = []
    monkeypatch.setattr(catalog.iteration, "delta_iterate", lambda solution, delta, rounds, key, merge, body: plans.append(body(solution)._jdf.queryExecution().executedPlan().toString()) or solution)
    catalog.QUERIES["delta_iterate"](spark, "/root/testdata/sf0.001")
    assert "default.cut_" in plans[0] and "Window" not in plans[0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cut_")]


def test_fixpoint_writes_what_is_new(spark, monkeypatch):
    """What is known isn't written again each round; and many rounds are put together without loss."""
    kept, write = [], iteration.materialize
    monkeypatch.setattr(iteration, "materialize", lambda df, label: kept.append(label) or write(df, label))
    path = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (32, 30)], "src long, dst long")
    got = {tuple(r) for r in graphs.transitive_closure(path).collect()}
    assert got == {(a, b) for a in range(20) for b in range(a + 1, 21)} | {(a, b) for a in (30, 31, 32) for b in (30, 31, 32)}
    assert kept.count("known") == 1
    monkeypatch.setattr(iteration, "MANY", 3)
    count = iteration.fixpoint(spark.createDataFrame([(0,)], "v long"), lambda known, new: new.where("v < 8").select((F.col("v") + 1).alias("v")))
    assert sorted(r.v for r in count.collect()) == list(range(9))


def test_limits(engine):
    flow = numbers(engine, 100)
    assert [r.value for r in flow.sorted_limit_by(F.desc("value"), n=3, offset=2).collect_vec()] == [97, 96, 95]
    assert [r.value for r in flow.sorted_by(F.desc("value")).limit(2, 1).collect_vec()] == [98, 97]
    parts = ordering.sorted_limit_by(flow.df.repartition(4), "value", n=2, scope="partition")
    assert parts.count() == 8


def test_sinks(engine, tmp_path):
    flow = numbers(engine, 20)
    assert sorted(flow.collect(set)) == list(range(20)) and sum(r.value for r in flow.collect_channel()) == 190
    assert flow.with_columns(v="value * 2").collect(dict)[7] == 14
    assert sorted(flow.collect_all().value) == list(range(20))
    flow.write_csv(str(tmp_path / "csv"), one=True)
    assert vals(engine.csv(str(tmp_path / "csv"), "value long"), "value") == list(range(20))
    flow.write_parquet(str(tmp_path / "pq"))
    flow.write_parquet(str(tmp_path / "pq"), append=True)
    assert engine.parquet(str(tmp_path / "pq"), flow.df.schema).collect_count() == 40
    with pytest.raises(ValueError):
        from pyspark.sql.types import StringType, StructField, StructType

        engine.parquet(str(tmp_path / "pq"), StructType([StructField("value", StringType())]))
    assert flow.cache("memory").collect_count() == 20


def test_csv_options(engine, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a;b\r\n# note\r\n1; 'x;y' \r\n2;'it''s'\r\n")
    out = engine.csv(str(tmp_path / "a.csv"), "a int, b string", delimiter=";", quote="'", comment="#", trim=True)
    assert vals(out, "a", "b") == [(1, "x;y"), (2, "it's")]
    (tmp_path / "b.csv").write_text("".join(f"{i},{i + 1}\n" for i in range(100)))
    assert vals(engine.csv(str(tmp_path / "b.csv"), "a int, b int", header=False), "a", "b") == [(i, i + 1) for i in range(100)]
    (tmp_path / "c.csv").write_text("1,2\nx\n")
    assert vals(engine.csv(str(tmp_path / "c.csv"), "a int, b int", header=False, flexible=True).filter("a is not null"), "a", "b") == [(1, 2)]
    with pytest.raises(Exception):  # noqa: B017
        engine.csv(str(tmp_path / "c.csv"), "a int, b int", header=False).collect_vec()


def test_avro(engine, tmp_path):
    rows = [(i, f"s{i}" if i % 3 else None, i / 2, [i, None], {"k": i}, (i, "x")) for i in range(50)]
    flow = engine.rows(rows, "num int, s string, d double, a array<int>, m map<string,int>, r struct<x:int,y:string>")
    flow.write_avro(str(tmp_path / "avro"))
    got = sorted((tuple(r) for r in engine.avro(str(tmp_path / "avro")).collect_vec()), key=lambda r: r[0])
    assert [(n, s, d, list(a), m, tuple(r)) for n, s, d, a, m, r in got] == rows


def foreign_avro(path, ids, sync, codec=b"null"):
    """A container file as another writer makes it, in blocks of 100 records; its marker is any bytes."""
    import json
    import zlib

    from tarnflow.sources.avro import _MAGIC, _put_long, encode

    schema = {"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["string", "null"]}]}
    out = [_MAGIC, encode({"avro.schema": json.dumps(schema).encode(), "avro.codec": codec}, {"type": "map", "values": "bytes"}), sync]
    for at in range(0, len(ids), 100):
        data = b"".join(encode({"id": i, "s": f"row {i}\n\r\u00e9" * 20 if i % 2 else None}, schema) for i in ids[at : at + 100])
        if codec == b"deflate":
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = packer.compress(data) + packer.flush()
        out += [_put_long(len(ids[at : at + 100])), _put_long(len(data)), data, sync]
    path.write_bytes(b"".join(out))


def test_avro_of_other_writers_in_several_tasks(engine, spark, tmp_path):
    (tmp_path / "in").mkdir()
    foreign_avro(tmp_path / "in" / "a.avro", range(20_000), bytes([0, 10, 13, 200, 255, 1, 2, 128, 9, 34, 92, 39, 10, 0, 250, 7]))
    foreign_avro(tmp_path / "in" / "b.avro", range(20_000, 20_300), bytes(range(16)), b"deflate")
    (tmp_path / "in" / "c.avro").write_bytes(b"")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
        df = engine.avro(str(tmp_path / "in")).df
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        got = {r.id: r.s for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert got == {i: f"row {i}\n\r\u00e9" * 20 if i % 2 else None for i in range(20_300)}


def test_avro_appends_and_keeps_empty_tables(engine, tmp_path):
    path = str(tmp_path / "avro")
    engine.rows([], "num long").write_avro(path)
    assert engine.avro(path).collect_vec() == []
    engine.rows([(2**53 + 1,), (None,)], "num long").write_avro(path, append=True)
    assert sorted((r.num for r in engine.avro(path).collect_vec()), key=str) == [2**53 + 1, None]
    with pytest.raises(Exception, match="exist"):
        engine.rows([(1,)], "num long").write_avro(path)


def test_missing_packages_say_so(engine):
    with pytest.raises(RuntimeError, match="class path"):
        engine.kafka("localhost:9092", ["t"])


def test_closures_keep_integers_and_nulls(engine):
    """Values above 2 ** 53 and nulls in one batch, for closures with state, folds and coroutines."""
    big = 9007199254740993
    rows = engine.rows([(1, big, None), (1, big + 2, big + 4), (None, None, big)], "k long, v long, w long")
    same = lambda: lambda row: dict(row)
    got = sorted((tuple(r) for r in rows.to_keyed("k").rich_map(["v"], same, "k long, v long, w long").df.collect()), key=str)
    assert got == sorted([(1, big, None), (1, big + 2, big + 4), (None, None, big)], key=str)

    async def pass_on(row):
        return row

    assert sorted((tuple(r) for r in rows.map_async(pass_on, "k long, v long, w long").df.collect()), key=str) == got
    folded = rows.to_keyed("k").fold_rows(["v"], int, lambda s, r: s + (r["w"] or 0), lambda s: {"total": s}, "k long, total long")
    assert {r.k: r.total for r in folded.df.collect()} == {1: big + 4, None: big}


def test_unkeyed_windows_run_in_several_tasks(engine):
    """The plan of a window over all rows has no single partition for the rows."""
    flow = engine.integers(0, 5000, 4)
    spark = flow.df.sparkSession
    out = flow.window_all(win.CountWindow.tumbling(10), ["value"]).fold(n="count(*)", low="min(value)").df
    assert {(r.win, r.n, r.low) for r in out.collect()} == {(k, 10, 10 * k) for k in range(500)}
    plan = flow.window_all(win.LastKWindow(2), ["value"]).fold(n="count(*)").df._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(0," not in plan and spark is not None


def test_shared_folder_is_required_on_a_cluster():
    """Without ``spark.checkpoint.dir`` a session on several machines is an error."""
    from types import SimpleNamespace

    from tarnflow.storage import shared_dir

    there = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(there)
