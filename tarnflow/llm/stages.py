"""Stages of the corpus pipeline: each takes ``(spark, docs, sf_dir)`` and keeps the columns of ``documents``.

In all of them null texts have no words and aren't toxic by themselves, rows with a null id are judged by their text like others
unless a stage says otherwise, repeated rows are judged alike, texts are taken whole, empty tables give no rows, and
columns beside those of ``documents``, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import decontamination as leaks
from tarnflow.llm import jaccard_join, source_mixing, storage
from tarnflow.llm import line_dedup as lines
from tarnflow.llm import toxicity as toxic

#: Fixed for stages on word shingles.
WORDS_EACH, SIMILARITY = 5, (80, 100)


def _columns(out: DataFrame, names: list[str], **changed) -> DataFrame:
    """The columns of a document again, from an operator's ``row`` and ``text``."""
    return out.select(*[(changed.get(c, F.col("text")) if c == "text" or c in changed else F.col(f"row.`{c}`")).alias(c) for c in names])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    out = toxic.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(out.where("score < 0.5"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines go, but from copies that ``ngram_jaccard`` joins; ``n_chars`` follows the text. No document goes."""
    out = lines.remove_spread_lines(docs, similarity=SIMILARITY, words_each=WORDS_EACH)
    changed = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return _columns(out, docs.columns, **changed)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    A document is an id with a text: where one id has several texts, each is judged by its own group, and of several
    texts of the smallest id in a group the one with the least hash stays. Repeated rows stay as one. Documents
    without words link with nothing and stay, and so do all rows without an id.
    """
    found = jaccard_join.jaccard_components(docs, words_each=WORDS_EACH, threshold=SIMILARITY).where("id is not null")
    keep = found.where("group is not null").groupBy("group").agg(F.min(F.struct("id", "text_key")).alias("k")).select("k.*")
    keep = keep.union(found.where("group is null").select("id", "text_key"))
    one = docs.where("doc_id is not null").withColumn("__text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "__text_key"])
    one = one.join(keep, (one["doc_id"] == keep["id"]) & (one["__text_key"] == keep["text_key"]), "left_semi").drop("__text_key")
    return one.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item's window occurs go."""
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    keyed = docs.select(key.alias("key"), "text")
    out = leaks.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key")
    hit = storage.cut(out.where("n_hit > 0").select(F.col("id").alias("hit")).distinct(), "leaks")
    return docs.join(hit, key == F.col("hit"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards tempered source weights, in random order."""
    return source_mixing.mix_sources(docs).select("row.*", "copy", "shuffle_key")
