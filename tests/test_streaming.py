"""Streaming forms on file streams, run until the input is used up."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnflow.sources import readers, writers
from tarnflow.streaming import flows

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def ticks(spark, tmp_path):
    rows = [(i, "a" if i % 2 else "b", T0 + dt.timedelta(seconds=i)) for i in range(60)] + [(99, "a", T0 + dt.timedelta(hours=2))]
    spark.createDataFrame(rows, "id long, k string, ts timestamp").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = readers.files_stream(spark, str(tmp_path / "in"), "id long, k string, ts timestamp", per_trigger=1)
    return stream, rows, tmp_path


def run(spark, df, tmp_path, name, mode="append"):
    flows.to_table(df, name, str(tmp_path / f"ck-{name}"), mode).awaitTermination()
    return spark.table(name).collect()


def test_windows(spark, ticks):
    stream, rows, tmp = ticks
    out = flows.windowed(flows.with_watermark(stream, "ts", "3 hours"), ["k"], "ts", "10 seconds", n=F.count(F.lit(1)))
    got = run(spark, out, tmp, "w1", "complete")
    assert sum(r.n for r in got) == len(rows) and max(r.n for r in got) == 5


def test_sessions(spark, ticks):
    stream, rows, tmp = ticks
    out = flows.sessions(flows.with_watermark(stream, "ts", "3 hours"), ["k"], "ts", "1 minute", n=F.count(F.lit(1)))
    got = run(spark, out, tmp, "w2", "complete")
    assert sorted((r.k, r.n) for r in got) == [("a", 1), ("a", 30), ("b", 30)]


def test_processing_time_keeps_every_row(spark, ticks):
    stream, rows, tmp = ticks
    got = run(spark, flows.processing_time(stream, ["k"], "1 hour", n=F.count(F.lit(1))), tmp, "w3", "complete")
    assert sum(r.n for r in got) == len(rows)


def test_interval_join(spark, ticks):
    stream, rows, tmp = ticks
    left = flows.with_watermark(stream, "ts", "3 hours")
    right = flows.with_watermark(readers.files_stream(spark, str(tmp / "in"), "id long, k string, ts timestamp"), "ts", "3 hours")
    got = run(spark, flows.interval_join(left, right, "k", "ts", "0 seconds", "2 seconds"), tmp, "w4")
    assert sorted((r.id, r.r_id) for r in got) == sorted((a, b) for a, k, t in rows for b, k2, t2 in rows if k == k2 and 0 <= (t2 - t).total_seconds() <= 2)


def test_state_across_batches(spark, ticks):
    stream, rows, tmp = ticks

    def make(state):
        def step(row):
            state["n"] = state.get("n", 0) + 1
            return [{"k": row["k"], "n": state["n"]}]

        return step

    got = run(spark, flows.rich_map(stream, ["k"], ["ts"], make, "k string, n long"), tmp, "w5")
    assert sorted((r.k, r.n) for r in got) == [("a", n) for n in range(1, 32)] + [("b", n) for n in range(1, 31)]


def test_unique_and_in_order(spark, ticks):
    stream, _, tmp = ticks
    got = run(spark, flows.unique(flows.with_watermark(stream, "ts", "3 hours"), ["k"]).select("k"), tmp, "w6")
    assert sorted(r.k for r in got) == ["a", "b"]
    seen = []
    flows.in_order(stream, "ts", lambda batch, n: seen.append([r.ts for r in batch.collect()]), str(tmp / "ck-r")).awaitTermination()
    assert sum(map(len, seen)) == 61 and all(b == sorted(b) for b in seen)


@pytest.fixture
def late(spark, tmp_path):
    """Four micro-batches, out of order across them; the last has a row that is older than the watermark before it."""
    at = lambda s: T0 + dt.timedelta(seconds=s, microseconds=s + 1)
    big = 2**53 + 1
    parts = [[(big, "a", at(5)), (2, "a", at(9)), (3, "b", at(1))], [(4, "a", at(7)), (None, "a", at(2)), (6, "b", at(40))], [(8, "b", at(39)), (9, "a", at(90))], [(7, "a", at(3)), (10, "a", at(200))]]
    kind = "id long, k string, ts timestamp"
    for n, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / "late" / f"n={n}"))
    ticking = flows.with_watermark(readers.files_stream(spark, str(tmp_path / "late" / "*"), kind, per_trigger=1), "ts", "10 seconds")
    return ticking, parts, tmp_path, kind


@pytest.mark.parametrize("keys", [["k"], []])
def test_reorder_across_batches(spark, late, keys):
    stream, parts, tmp, kind = late
    out = flows.reorder(stream, keys, "ts")
    assert [f.dataType for f in out.schema] == [f.dataType for f in stream.schema]
    seen, name = [], f"r{len(keys)}"
    query = out.writeStream.foreachBatch(lambda b, n: seen.extend((r.id, r.k, r.ts) for r in b.collect())).option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    expected = sorted((r for p in parts for r in p if r[0] not in (7, 10)), key=lambda r: r[2])  # 7 is late, 10 still waits
    if keys:
        assert [r for r in seen if r[1] == "a"] == [r for r in expected if r[1] == "a"] and [r for r in seen if r[1] == "b"] == [r for r in expected if r[1] == "b"]
    else:
        assert seen == expected
    assert flows.dropped_rows(query) == 1


def test_late_rows_of_a_join(spark, late):
    stream, parts, tmp, kind = late
    right = flows.with_watermark(readers.files_stream(spark, str(tmp / "late" / "*"), kind, per_trigger=1), "ts", "10 seconds")
    query = flows.to_table(flows.interval_join(stream, right, "k", "ts", "0 seconds", "0 seconds"), "late_join", str(tmp / "lj"))
    query.awaitTermination()
    ids = {r.id for r in spark.table("late_join").collect()}
    assert 7 not in ids and ids == {r[0] for p in parts for r in p if r[0] != 7} and flows.dropped_rows(query) == 2


def test_sessions_by_the_clock(spark, ticks):
    stream, rows, tmp = ticks
    got = run(spark, flows.processing_sessions(stream, ["k"], "1 hour", n=F.count(F.lit(1))), tmp, "w9", "complete")
    assert sorted((r.k, r.n) for r in got) == [("a", 31), ("b", 30)]


def test_transactions(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, "a", at(1), "go", None), (2, "a", at(2), "commit", None), (3, "a", at(3), "go", None), (4, "a", at(4), "discard", None), (5, "b", at(1), "commit_after", at(3)), (6, "b", at(2), "go", None), (7, "b", at(9), "go", None)]
    later = [(8, "c", at(100), "go", None)]
    kind = "id long, k string, ts timestamp, op string, close timestamp"
    for k, part in enumerate((rows[:6], rows[6:] + later, [(9, "c", at(200), "go", None)])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = flows.with_watermark(readers.files_stream(spark, str(tmp_path / "in"), kind), "ts", "1 second")
        out = flows.transactions(stream, ["k"], "ts", "op", "close", lambda rs: {"ids": ",".join(str(r["id"]) for r in rs)}, "ids string")
        flows.to_parquet(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        del k
    assert sorted(r.ids for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1,2", "5,6"]


def test_channels(spark, tmp_path):
    channel = readers.Channel(spark, "x long", size=4)
    for k in range(10):
        channel.send((k,))
    channel.close()
    query, out = writers.stream_channel(channel.stream(), str(tmp_path / "ck"))
    query.awaitTermination()
    assert sorted(out.get().x for _ in range(10)) == list(range(10))
    assert channel.frame().count() == 10


def test_parquet_sink(spark, ticks):
    stream, rows, tmp = ticks
    flows.to_parquet(stream, str(tmp / "out"), str(tmp / "ck-p")).awaitTermination()
    assert spark.read.parquet(str(tmp / "out")).count() == len(rows)


def test_custom_source(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Squares(DataSource):
        @classmethod
        def name(cls):
            return "squares"

        def schema(self):
            return "x int, y int"

        def reader(self, schema):
            return Reader()

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(k) for k in range(3)]

        def read(self, partition):
            yield partition.value, partition.value**2

    assert sorted(tuple(r) for r in readers.custom(spark, Squares).collect()) == [(0, 0), (1, 1), (2, 4)]


def stub_topics(folder):
    """A data source with the options of Kafka's: a topic is a folder with a file of JSON messages per write."""
    import json
    import uuid
    from pathlib import Path

    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

    root = Path(folder)

    class Topics(DataSource):
        @classmethod
        def name(cls):
            return "stub_topics"

        def schema(self):
            return "key binary, value binary, topic string"

        def messages(self):
            assert self.options["kafka.bootstrap.servers"] == "nowhere:9092"
            files = [f for t in self.options["subscribe"].split(",") for f in sorted((root / t).glob("*.json"))]
            return [(None, m["value"].encode(), f.parent.name) for f in files for m in json.loads(f.read_text())]

        def reader(self, schema):
            source = self

            class Reader(DataSourceReader):
                def partitions(self):
                    return [InputPartition(0)]

                def read(self, partition):
                    yield from source.messages()

            return Reader()

        def simpleStreamReader(self, schema):
            source = self

            class Reader(SimpleDataSourceStreamReader):
                def initialOffset(self):
                    return {"n": 0}

                def read(self, start):
                    found = source.messages()[start["n"] :]
                    return iter(found), {"n": start["n"] + len(found)}

                def readBetweenOffsets(self, start, end):
                    return iter(source.messages()[start["n"] : end["n"]])

                def commit(self, end):
                    pass

            return Reader()

        def put(self, rows):
            assert self.options["kafka.bootstrap.servers"] == "nowhere:9092"
            at = root / self.options["topic"]
            at.mkdir(exist_ok=True)
            found = [{"key": r["key"], "value": r["value"]} for r in rows]
            (at / f"{uuid.uuid4().hex}.json").write_text(json.dumps(found))

        def writer(self, schema, overwrite):
            source = self

            class Writer(DataSourceWriter):
                def write(self, rows):
                    source.put(rows)
                    return WriterCommitMessage()

            return Writer()

        def streamWriter(self, schema, overwrite):
            source = self

            class Writer(DataSourceStreamWriter):
                def write(self, rows):
                    source.put(rows)
                    return WriterCommitMessage()

            return Writer()

    return Topics


def test_topics_and_running_word_count(spark, tmp_path):
    """Options and plans of the Kafka source and sinks, over a stub with the same options."""
    import json

    spark.dataSource.register(stub_topics(str(tmp_path)))
    frame = spark.createDataFrame([(None, x) for x in ("The cat", "the dog the", "Cat")], "key string, value string")
    writers.write_kafka(frame, "nowhere:9092", "lines", source="stub_topics")
    read = readers.kafka(spark, "nowhere:9092", ["lines"], stream=False, source="stub_topics")
    assert sorted(bytes(r.value).decode() for r in read.collect()) == ["Cat", "The cat", "the dog the"]
    stream = readers.kafka(spark, "nowhere:9092", ["lines"], source="stub_topics")
    query = writers.stream_kafka(flows.running_words(stream), "nowhere:9092", "counts", str(tmp_path / "ck-k"), mode="complete", trigger={"processingTime": "1 second"}, source="stub_topics")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((m["key"], m["value"]) for f in (tmp_path / "counts").glob("*.json") for m in json.loads(f.read_text()))
    assert got == [("cat", "2"), ("dog", "1"), ("the", "3")]
