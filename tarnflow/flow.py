"""A fluent interface over the operators: ``Engine`` makes flows, flows become keyed, keyed flows windowed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from tarnflow.operators import aggregates, combine, joins, ordering, stateful, transforms
from tarnflow.operators import windows as win
from tarnflow.plans import iteration
from tarnflow.sources import readers, writers


class Engine:
    """Entry point: a session and the sources that start flows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def flow(self, df: DataFrame) -> Flow:
        return Flow(df)

    def table(self, name: str) -> Flow:
        return Flow(self.spark.table(name))

    def sql(self, query: str, **views: Flow | DataFrame) -> Flow:
        for name, view in views.items():
            (view.df if isinstance(view, Flow) else view).createOrReplaceTempView(name)
        return Flow(self.spark.sql(query))

    def rows(self, values, schema) -> Flow:
        return Flow(readers.rows(self.spark, values, schema))

    def integers(self, start: int, end: int, tasks: int | None = None) -> Flow:
        return Flow(readers.integers(self.spark, start, end, tasks))

    def parallel(self, peers: int, make, schema) -> Flow:
        return Flow(readers.parallel(self.spark, peers, make, schema))

    def text(self, path: str) -> Flow:
        return Flow(readers.text(self.spark, path))

    def csv(self, path: str, schema, **options) -> Flow:
        return Flow(readers.csv(self.spark, path, schema, **options))

    def parquet(self, path: str, schema=None) -> Flow:
        return Flow(readers.parquet(self.spark, path, schema))

    def avro(self, path: str) -> Flow:
        return Flow(readers.avro(self.spark, path))

    def kafka(self, servers: str, topics: list[str], stream: bool = True, **options) -> Flow:
        return Flow(readers.kafka(self.spark, servers, topics, stream, **options))

    def custom(self, source: type, **options) -> Flow:
        return Flow(readers.custom(self.spark, source, **options))


class Flow:
    """Rows without a key."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _new(self, df: DataFrame) -> Flow:
        return type(self)(df)

    # Rows

    def map(self, **named: Column | str) -> Flow:
        return self._new(transforms.map_columns(self.df, **named))

    def with_columns(self, **named: Column | str) -> Flow:
        return self._new(self.df.withColumns({n: transforms.as_column(c) for n, c in named.items()}))

    def map_batches(self, fn, schema) -> Flow:
        return self._new(transforms.map_batches(self.df, fn, schema))

    def filter(self, condition: Column | str) -> Flow:
        return self._new(self.df.where(condition))

    def filter_map(self, name: str, expr: Column | str) -> Flow:
        return self._new(transforms.filter_map(self.df, name, expr))

    def flat_map(self, name: str, array: Column | str) -> Flow:
        return self._new(transforms.flat_map(self.df, name, array))

    def flatten(self, name: str) -> Flow:
        return self._new(transforms.flatten(self.df, name))

    def inspect(self, observation, **measures: Column) -> Flow:
        return self._new(transforms.inspect(self.df, observation, **measures))

    def map_memo(self, keys: list[str], fn, name: str, kind: str) -> Flow:
        return self._new(transforms.map_memo(self.df, keys, fn, name, kind))

    def map_async(self, fn, schema, concurrency: int = 4) -> Flow:
        return self._new(transforms.map_async(self.df, fn, schema, concurrency))

    def map_async_memo(self, keys: list[str], fn, name: str, kind: str) -> Flow:
        return self._new(transforms.map_async_memo(self.df, keys, fn, name, kind))

    def explain(self, mode: str = "formatted") -> None:
        """The physical plan."""
        self.df.explain(mode)

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> Flow:
        """Any operator of one's own."""
        return self._new(fn(self.df))

    def rich_map(self, order_by: list[str], make, schema) -> Flow:
        return Flow(stateful.rich_map(self.df, [], order_by, make, schema))

    def rich_filter_map(self, order_by: list[str], make, schema) -> Flow:
        return Flow(stateful.rich_filter_map(self.df, [], order_by, make, schema))

    def rich_flat_map(self, order_by: list[str], make, schema) -> Flow:
        return Flow(stateful.rich_flat_map(self.df, [], order_by, make, schema))

    def rich_map_custom(self, order_by: list[str], make, schema) -> Flow:
        return Flow(stateful.rich_map_custom(self.df, [], order_by, make, schema))

    # Keys

    def key_by(self, **named: Column | str) -> KeyedFlow:
        """Key columns; rows move only when an operator needs them together."""
        return KeyedFlow(self.with_columns(**named).df, list(named))

    group_by = key_by

    def to_keyed(self, *keys: str) -> KeyedFlow:
        return KeyedFlow(self.df, list(keys))

    # Aggregates

    def fold(self, **named: Column | str) -> Flow:
        return Flow(aggregates.fold(self.df, **named))

    reduce = reduce_assoc = fold_assoc = fold

    def fold_rows(self, order_by: list[str], zero, step, finish, schema) -> Flow:
        return Flow(stateful.fold_rows(self.df, [], order_by, zero, step, finish, schema))

    def fold_scan(self, **named: Column | str) -> Flow:
        return Flow(aggregates.fold_scan(self.df, [], **named))

    reduce_scan = fold_scan

    def group_by_fold(self, keys: dict[str, Column | str], **named: Column | str) -> KeyedFlow:
        return self.key_by(**keys).fold(**named)

    group_by_reduce = group_by_fold

    def group_by_sum(self, keys: dict[str, Column | str], value: str) -> KeyedFlow:
        return self.group_by_fold(keys, sum=f"sum({value})")

    def group_by_avg(self, keys: dict[str, Column | str], value: str) -> KeyedFlow:
        return self.group_by_fold(keys, avg=f"avg({value})")

    def group_by_count(self, keys: dict[str, Column | str]) -> KeyedFlow:
        return self.group_by_fold(keys, count="count(*)")

    def group_by_max_element(self, keys: dict[str, Column | str], value: str, order_by: list[str]) -> KeyedFlow:
        keyed = self.key_by(**keys)
        return KeyedFlow(aggregates.extreme_element(keyed.df, keyed.keys, value, order_by, True), keyed.keys)

    def group_by_min_element(self, keys: dict[str, Column | str], value: str, order_by: list[str]) -> KeyedFlow:
        keyed = self.key_by(**keys)
        return KeyedFlow(aggregates.extreme_element(keyed.df, keyed.keys, value, order_by, False), keyed.keys)

    # Several flows

    def join(self, other: Flow, *keys: tuple[str, str], how: str = "inner", strategy: str | None = None) -> KeyedFlow:
        out = joins.equi_join(self.df, other.df, list(keys), how, strategy)
        return KeyedFlow(out, [f"k{i}" for i in range(len(keys))] if how not in ("left_semi", "left_anti") else [a for a, _ in keys])

    def left_join(self, other: Flow, *keys: tuple[str, str], strategy: str | None = None) -> KeyedFlow:
        return self.join(other, *keys, how="left", strategy=strategy)

    def outer_join(self, other: Flow, *keys: tuple[str, str], strategy: str | None = None) -> KeyedFlow:
        return self.join(other, *keys, how="full", strategy=strategy)

    def interval_join(self, other: Flow, left_ts: str, right_ts: str, lower: int, upper: int) -> Flow:
        return Flow(joins.interval_join(self.df, other.df, left_ts, right_ts, lower, upper))

    def merge(self, *others: Flow) -> Flow:
        return self._new(combine.merge(self.df, *(o.df for o in others)))

    def merge_tagged(self, other: Flow) -> Flow:
        return Flow(combine.merge_tagged(self.df, other.df))

    def zip(self, other: Flow, left_order: list[str], right_order: list[str]) -> Flow:
        return Flow(combine.zip_flows(self.df, other.df, left_order, right_order))

    def split(self, n: int) -> list[Flow]:
        return [self._new(x) for x in combine.split(self.df, n)]

    def route(self, *predicates: Column | str) -> list[Flow]:
        return [self._new(x) for x in combine.route(self.df, *predicates)]

    def unique(self) -> Flow:
        return self._new(combine.unique(self.df))

    def unique_by_key(self, keys: list[str], order_by: list[str]) -> Flow:
        return self._new(combine.unique_by_key(self.df, keys, order_by))

    # Distribution

    def broadcast(self, replicas: int) -> Flow:
        return self._new(combine.broadcast_rows(self.df, replicas))

    def shuffle(self, n: int | None = None) -> Flow:
        return Flow(combine.shuffle(self.df, n))

    def replication(self, n: int) -> Flow:
        return self._new(combine.replication(self.df, n))

    def repartition_by(self, n: int, target: Column | str) -> Flow:
        return Flow(combine.repartition_by(self.df, n, target))

    def batch_mode(self, *_, **__) -> Flow:
        """Batches are Spark's to size; streams set theirs by trigger and source options."""
        return self

    def into_boxed(self) -> Flow:
        return self

    # Order

    def sorted_by(self, *order, scope: str = "global") -> Flow:
        return self._new(ordering.sorted_by(self.df, *order, scope=scope))

    def limit(self, n: int, offset: int = 0) -> Flow:
        return self._new(ordering.limit(self.df, n, offset))

    def sorted_limit_by(self, *order, n: int, offset: int = 0, scope: str = "global") -> Flow:
        return self._new(ordering.sorted_limit_by(self.df, *order, n=n, offset=offset, scope=scope))

    # Time

    def add_timestamps(self, ts: Column | str, delay: str | None = None, name: str = "ts") -> Flow:
        return self._new(stateful.add_timestamps(self.df, ts, delay, name))

    def drop_timestamps(self, name: str = "ts") -> Flow:
        return self._new(stateful.drop_timestamps(self.df, name))

    def reorder(self, ts: str, *tie: str) -> Flow:
        return self._new(stateful.reorder(self.df, ts, *tie))

    def window_all(self, window, order_by: list[str] = ()) -> WindowedFlow:
        return WindowedFlow(self.df, [], window, list(order_by))

    # Loops

    def iterate(self, rounds: int, state, body, fold, update, go_on=lambda s: True):
        state, df = iteration.iterate(self.df, rounds, state, body, fold, update, go_on)
        return state, self._new(df)

    def replay(self, rounds: int, state, body, fold, update, go_on=lambda s: True):
        return iteration.replay(self.df, rounds, state, body, fold, update, go_on)

    # Sinks

    def collect_vec(self):
        return writers.collect_vec(self.df)

    def collect(self, container=list):
        return writers.collect(self.df, container)

    def collect_all(self, container=list):
        return writers.collect_all(self.df, container)

    collect_vec_all = collect_all

    def collect_count(self) -> int:
        return writers.collect_count(self.df)

    def collect_channel(self):
        return writers.collect_channel(self.df)

    def collect_channel_parallel(self, fn) -> None:
        writers.collect_channel_parallel(self.df, fn)

    def for_each(self, fn) -> None:
        writers.for_each(self.df, fn)

    def write_csv(self, path: str, **options) -> None:
        writers.write_csv(self.df, path, **options)

    def write_parquet(self, path: str, **options) -> None:
        writers.write_parquet(self.df, path, **options)

    def write_avro(self, path: str, **options) -> None:
        writers.write_avro(self.df, path, **options)

    def write_kafka(self, servers: str, topic: str, **options) -> None:
        writers.write_kafka(self.df, servers, topic, **options)

    def cache(self, where: str = "memory_and_disk") -> Flow:
        return self._new(writers.cache(self.df, where))

    def collect_cache(self, where: str = "shared") -> Flow:
        return self._new(writers.collect_cache(self.df, where))


class KeyedFlow(Flow):
    """Rows with key columns."""

    def __init__(self, df: DataFrame, keys: list[str]):
        super().__init__(df)
        self.keys = keys

    def _new(self, df: DataFrame) -> KeyedFlow:
        return KeyedFlow(df, self.keys)

    def map(self, **named: Column | str) -> KeyedFlow:
        return self._new(transforms.map_columns(self.df, self.keys, **named))

    def fold(self, **named: Column | str) -> KeyedFlow:
        return self._new(aggregates.keyed_fold(self.df, self.keys, **named))

    reduce = fold

    def fold_rows(self, order_by: list[str], zero, step, finish, schema) -> KeyedFlow:
        return self._new(stateful.fold_rows(self.df, self.keys, order_by, zero, step, finish, schema))

    def fold_scan(self, **named: Column | str) -> KeyedFlow:
        return self._new(aggregates.fold_scan(self.df, self.keys, **named))

    reduce_scan = fold_scan

    def running(self, order_by: list[str], **named: Column | str) -> KeyedFlow:
        return self._new(stateful.running(self.df, self.keys, order_by, **named))

    def rich_map(self, order_by: list[str], make, schema) -> KeyedFlow:
        return self._new(stateful.rich_map(self.df, self.keys, order_by, make, schema))

    def rich_filter_map(self, order_by: list[str], make, schema) -> KeyedFlow:
        return self._new(stateful.rich_filter_map(self.df, self.keys, order_by, make, schema))

    def rich_flat_map(self, order_by: list[str], make, schema) -> KeyedFlow:
        return self._new(stateful.rich_flat_map(self.df, self.keys, order_by, make, schema))

    def rich_map_custom(self, order_by: list[str], make, schema) -> KeyedFlow:
        return self._new(stateful.rich_map_custom(self.df, self.keys, order_by, make, schema))

    def join_keyed(self, other: KeyedFlow, how: str = "inner") -> KeyedFlow:
        return self.join(other, *zip(self.keys, other.keys, strict=True), how=how)

    def join_outer(self, other: KeyedFlow) -> KeyedFlow:
        return self.join_keyed(other, "full")

    def interval_join(self, other: KeyedFlow, left_ts: str, right_ts: str, lower: int, upper: int) -> KeyedFlow:
        return self._new(joins.interval_join(self.df, other.df, left_ts, right_ts, lower, upper, list(zip(self.keys, other.keys, strict=True))))

    def window(self, window, order_by: list[str] = ()) -> WindowedFlow:
        return WindowedFlow(self.df, self.keys, window, list(order_by))

    def window_join(self, window, other: KeyedFlow) -> KeyedFlow:
        return self._new(win.window_join(self.df, other.df, self.keys, window))

    def delta_iterate(self, delta: DataFrame, rounds: int, merge, body) -> KeyedFlow:
        return self._new(iteration.delta_iterate(self.df, delta, rounds, self.keys[0], merge, body))

    def unkey(self) -> Flow:
        return Flow(self.df)

    def drop_key(self) -> Flow:
        return Flow(self.df.drop(*self.keys))


class WindowedFlow:
    """Rows of each key in windows, waiting for an aggregate."""

    def __init__(self, df: DataFrame, keys: list[str], spec, order_by: list[str]):
        self.df, self.keys, self.spec, self.order_by = df, keys, spec, order_by

    def fold(self, **named: Column | str) -> KeyedFlow:
        return KeyedFlow(win.aggregate(self.df, self.keys, self.spec, self.order_by, **named), self.keys)

    def count(self) -> KeyedFlow:
        return self.fold(count="count(*)")

    def sum(self, value: str) -> KeyedFlow:
        return self.fold(sum=f"sum({value})")

    def min(self, value: str) -> KeyedFlow:
        return self.fold(min=f"min({value})")

    def max(self, value: str) -> KeyedFlow:
        return self.fold(max=f"max({value})")

    def first(self, value: str) -> KeyedFlow:
        return self.fold(first=win.first_value(value, self.order_by))

    def last(self, value: str) -> KeyedFlow:
        return self.fold(last=win.last_value(value, self.order_by))

    def min_by_key(self, row: Column, key: str) -> KeyedFlow:
        return self.fold(min=win.min_by_key(row, key, self.order_by))

    def max_by_key(self, row: Column, key: str) -> KeyedFlow:
        return self.fold(max=win.max_by_key(row, key, self.order_by))

    def to_vec(self, value: Column | str) -> KeyedFlow:
        return self.fold(vec=win.ordered_list(value, self.order_by))

    def map(self, value: Column | str, fn: Callable[[Column], Column]) -> KeyedFlow:
        """A function of the list of values in order."""
        return self.fold(out=fn(win.ordered_list(value, self.order_by)))

    def fold_first(self, value: Column | str, fn: Callable[[Column, Column], Column]) -> KeyedFlow:
        """Combine values in order, starting from the first."""
        from pyspark.sql import functions as F

        return self.map(value, lambda vec: F.reduce(F.slice(vec, 2, F.greatest(F.size(vec), F.lit(1))), vec[0], fn))

    def to_arrow(self, fn, schema) -> KeyedFlow:
        return KeyedFlow(win.window_to_arrow(self.df, self.keys, self.spec, self.order_by, fn, schema), self.keys)
