"""Benchmark decontamination by winnowing.

Every run of ``ngram`` words yields as fingerprint the smallest hash of its ``kgram``-word
grams. Texts that share such a run share its fingerprint, so joining the fingerprints of
training and test texts finds every shared run; each hit is then extended to the whole run
and compared with the item's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.storage import bound_batches, cut
from tarnflow.llm.textbytes import ALNUM, U64, Lookup, Words, pieces, sliding_min, text_bytes

_WINDOWS = "item string, m int, fp long, h long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _windows(words: Words, ngram: int, kgram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word, fingerprint and hash of each run of ``ngram`` words."""
    at, full = words.grams(ngram)
    if not len(at):
        return at, full, full
    every = np.full(len(words.hash) - kgram + 1, np.iinfo(np.uint64).max, U64)
    starts, grams = words.grams(kgram)
    every[starts] = grams
    return at, sliding_min(every, ngram - kgram + 1)[at], full


def _item_windows(ngram: int, kgram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(*text_bytes(batch.column("text")), ALNUM)
            items = np.asarray(batch.column("item").to_pylist(), object)
            at, fp, full = _windows(words, ngram, kgram)
            rows = [(words.doc[at], np.full(len(at), ngram), fp, full)]
            for m in range(1, ngram):
                at, h = words.grams(m)
                at, h = at[keep := words.count[words.doc[at]] == m], h[keep]
                rows.append((words.doc[at], np.full(len(at), m), h, h))
            doc, m, fp, full = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(items[doc], pa.string()), pa.array(m, pa.int32()), pa.array(_signed(fp)), pa.array(_signed(full))], ["item", "m", "fp", "h"])

    return run


class Index:
    """Item windows by length, for looking up the windows of a batch of texts."""

    def __init__(self, names: list[str], code: np.ndarray, m: np.ndarray, fp: np.ndarray, h: np.ndarray):
        self.names = names
        self.by_length = {}
        for length in sorted(set(m.tolist())):
            own = m == length
            order = np.lexsort((code[own], h[own]))
            hashes, items = h[own][order], code[own][order]
            full = Lookup(hashes)
            self.by_length[length] = (Lookup(fp[own]), full, np.searchsorted(hashes, full.keys, "left"), np.searchsorted(hashes, full.keys, "right"), items)

    def hits(self, words: Words, ngram: int, kgram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end words of the windows that occur, then (row, item code) pairs."""
        starts, ends, docs, codes = [], [], [], []
        for m, (fingerprints, full, lo, hi, items) in self.by_length.items():
            if m == ngram:
                at, fp, h = _windows(words, ngram, kgram)
                if not len(at):
                    continue
                first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))  # one look-up for a run of windows with one fingerprint
                found, _ = fingerprints.find(fp[first])
                likely = np.zeros(len(first), bool)
                likely[found] = True
                near = np.flatnonzero(np.repeat(likely, np.diff(np.append(first, len(at)))))
                at, h = at[near], h[near]
            else:
                at, h = words.grams(m)
            i, place = full.find(h)
            at = at[i]
            starts.append(at)
            ends.append(at + m)
            n = hi[place] - lo[place]
            flat = np.repeat(lo[place] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            docs.append(np.repeat(words.doc[at], n))
            codes.append(items[flat])
        none = [np.zeros(0, np.int64)]
        return tuple(np.concatenate(x or none) for x in (starts, ends, docs, codes))


def _score(index_of, ngram: int, kgram: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        for batch in pieces(batches, "text"):
            words = Words(*text_bytes(batch.column("text")), ALNUM)
            starts, ends, docs, codes = index.hits(words, ngram, kgram)
            cover = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, ends, -1)
            n_hit = np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=batch.num_rows)
            pairs = np.unique(docs * max(1, len(index.names)) + codes)
            listed: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for pair in pairs.tolist():
                listed[pair // len(index.names)].append(index.names[pair % len(index.names)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(id_type), pa.array(words.count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(listed, pa.list_(pa.string()))],
                ["id", "n_words", "n_hit", "items"],
            )

    return run


def _fingerprint_rows(ngram: int, kgram: int, lengths: list[int]):
    """One row for each run of windows with one fingerprint: the look-up side of the shuffled join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(*text_bytes(batch.column("text")), ALNUM)
            for m in lengths:
                if m == ngram:
                    at, fp, h = _windows(words, ngram, kgram)
                else:
                    at, h = words.grams(m)
                    fp = h
                if not len(at):
                    continue
                doc = words.doc[at]
                first = np.flatnonzero(np.concatenate(([True], (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1]))))
                offsets = np.append(first, len(at)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(doc[first])), pa.array(np.full(len(first), m), pa.int32()), pa.array(_signed(fp[first])), pa.array(at[first] - words.first[doc[first]]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(h)))],
                    ["key", "m", "fp", "start", "hs"],
                )

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        words = Words(*text_bytes(batch.column("text")), ALNUM)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(words.count, pa.int64())], ["id", "key", "n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", ngram: int = 10, kgram: int = 4, max_index_rows: int = 2_000_000, max_name_bytes: int = 16 << 20) -> DataFrame:
    """Per document: ``id, n_words, n_hit, items`` (sorted ids of the items with occurring windows).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. An item's windows are its
    runs of ``ngram`` words; an item of fewer words is one window, one without words has none.
    Null texts have no words; items with a null id are left out; repeated rows each give a row;
    empty tables give no rows or no hits; other columns are ignored.

    Up to ``max_index_rows`` item windows, of 24 bytes each, with up to ``max_name_bytes`` of item ids are sent to
    every executor and looked up while the texts stream by. Beyond, fingerprints of both sides are joined by a
    shuffle. Texts are read whole; memory follows the longest.
    """
    bound_batches(docs.sparkSession)
    if not 1 <= kgram <= ngram:
        raise ValueError("kgram must be between 1 and ngram")
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    windows = items.mapInArrow(_item_windows(ngram, kgram), _WINDOWS).distinct()
    head = windows.limit(max_index_rows + 1).toArrow()
    id_type = source.limit(0).toArrow().schema.field("id").type
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>"
    codes = head["item"].combine_chunks().dictionary_encode()
    names = codes.dictionary.to_pylist()
    if head.num_rows <= max_index_rows and sum(map(len, names)) <= max_name_bytes:
        place = np.argsort(np.argsort(np.array(names, object))) if names else np.zeros(0, np.int64)  # codes in the order of names
        sent = spark.sparkContext.broadcast((sorted(names), place[codes.indices.to_numpy()].astype(np.int32), head["m"].to_numpy(), head["fp"].to_numpy().view(U64), head["h"].to_numpy().view(U64)))
        return source.mapInArrow(_score(lambda: Index(*sent.value), ngram, kgram, id_type), schema)

    windows = cut(windows, "item-windows")
    lengths = sorted(r.m for r in windows.select("m").distinct().collect())  # at most ngram values
    keyed = source.withColumn("key", F.sha2(F.col("text"), 256))
    texts = keyed.where("text is not null").groupBy("key").agg(F.first("text").alias("text"))
    runs = texts.mapInArrow(_fingerprint_rows(ngram, kgram, lengths), "key string, m int, fp long, start long, hs array<long>")
    likely = runs.join(windows.select("m", "fp").distinct(), ["m", "fp"], "left_semi")
    starts = likely.select("key", "m", "start", F.posexplode("hs").alias("i", "h")).select("key", "m", (F.col("start") + F.col("i")).alias("s"), "h")
    hits = cut(starts.join(windows.select("m", "h", "item").distinct(), ["m", "h"]), "window-hits")
    # Union of the hit intervals of a text: new words that each interval adds to those before it.
    from pyspark.sql.window import Window

    spans = hits.groupBy("key", "s").agg((F.col("s") + F.max("m")).alias("e"))
    before = F.max("e").over(Window.partitionBy("key").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("b", before).groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce("b", F.lit(0))))).alias("n_hit"))
    named = hits.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    counts = keyed.mapInArrow(_word_counts, f"id {source.schema['id'].dataType.simpleString()}, key string, n_words long")
    out = counts.join(covered.join(named, "key"), "key", "left")
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, by windows of ten words."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_OP4 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[s : s + least(10, len(ws)) - 1], ' ') AS win FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS u(s) WHERE len(ws) > 0),
d AS (SELECT doc_id, m, s, array_to_string(ws[s : s + m - 1], ' ') AS win FROM w, (SELECT DISTINCT m FROM i), unnest(range(1, len(ws) - m + 2)) AS u(s)),
h AS (SELECT d.doc_id, d.s, d.m, item_id FROM d JOIN i USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + m)) AS u(p) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
