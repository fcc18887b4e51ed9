"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each document is repeated a number of times drawn from a Poisson distribution whose mean is its
source's target share over its present share. The draw inverts the distribution at a point hashed
from a seed and the document, so it is the same on every run and however rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.storage import cut

#: Hexadecimal digits of a hash taken as a number: 13 digits are 52 bits, exact in a double.
_DIGITS = 13


def _unit(text: Column) -> Column:
    """A number in [0, 1) hashed from a string."""
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


#: Larger means are split into equal parts, drawn one by one and added up, so that exp(-mean) never underflows.
PART = 64.0


#: Rows of a source are dealt out by so many numbers in the join with its mean, since one source may hold a third of them.
SALTS = 32


def _draw(mean: Column, point: Column) -> Column:
    """Inversion: how many values of the Poisson distribution function are at most ``point``, as far as they grow."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), (first <= point).cast("int").alias("n"))

    def step(s, k):
        p = s["p"] * mean / k
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), (s["n"] + ((c <= point) & (c > s["c"])).cast("int")).alias("n"))

    reach = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(30.0)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), reach), start, step, lambda s: s["n"])


def mixing_means(docs: DataFrame, *, source: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None) -> DataFrame:
    """Per source (null is one): ``source``, ``n`` documents and ``mean`` repetitions per document.

    Without ``weights`` the target share of a source is its present share to the power ``temperature``,
    made to sum to one. Given weights are made to sum to one over the sources present; a source that
    isn't given has weight 0. ``total`` documents are expected out, by default as many as go in.
    """
    n = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        if not weights or min(weights.values()) < 0 or max(weights.values()) <= 0:
            raise ValueError("weights must be non-negative, with one above zero")
        weight = F.coalesce(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col("source")], F.lit(0.0))
    sums = cut(n.select("source", "n", F.round(weight, 15).alias("w")), "mixing-weights")
    # One row of exact sums, so that means are the same on every run.
    whole = sums.agg(F.sum("n").alias("n"), F.sum(F.col("w").cast("decimal(38,15)")).cast("double").alias("w")).first()
    size = float(total if total is not None else whole.n or 0)
    mean = F.lit(size) * F.col("w") / F.lit(whole.w) / F.col("n") if whole.w else F.lit(0.0)
    return sums.select("source", "n", mean.alias("mean"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None, seed: int = 17) -> DataFrame:
    """Documents in random order, each as often as drawn: ``row`` (struct of its columns), ``copy`` from 1, ``shuffle_key``.

    The point of a draw comes from the seed, the id (null: empty) and the text (null or no such column: empty), so only rows that agree in
    both are drawn alike. Null sources form a source of their own, of weight 0 where weights are given. Empty
    tables give no rows; other columns, whatever their names, are carried in ``row``.

    A row goes to a partition by the hash of its key, which comes from seed, id, text and copy, and of a number that
    tells rows with one key apart; it is sorted by key there. That deals every source evenly over
    all partitions, repeated rows too.
    """
    means = cut(mixing_means(docs, source=source, weights=weights, temperature=temperature, total=total), "mixing-means")
    table = means.select(F.col("source").alias("of"), "mean", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    name = F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")) if text in docs.columns else F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("id"), F.col(source).cast("string").alias("source"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int"))
    joined = rows.join(table, rows["source"].eqNullSafe(table["of"]) & (rows["salt"] == table["part"]))
    parts = F.greatest(F.ceil(F.col("mean") / PART), F.lit(1)).cast("int")
    point = lambda j: _unit(F.concat_ws("|", F.lit(str(seed)), F.col("id"), j.cast("string")))
    count = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, j: n + _draw(F.col("mean") / parts, point(j)))
    drawn = joined.select("row", "id", "place", count.alias("times")).where("times > 0")
    copies = drawn.select("row", "id", "place", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    keyed = copies.select("row", "copy", F.md5(F.concat_ws("|", F.lit(f"{seed} order"), F.col("id"), F.col("copy").cast("string"))).alias("shuffle_key"), "place")
    return keyed.repartition("shuffle_key", "place").sortWithinPartitions("shuffle_key").drop("place")


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, repeated towards shares to the power 0.5, total unchanged."""
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("row.doc_id", "row.source", "copy", "shuffle_key", F.col("row.text").alias("text"))


ORACLE_OP10 = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
m AS (SELECT source, (SELECT sum(n) FROM n) * sqrt(n) / (SELECT sum(sqrt(n)) FROM n) / n AS mean FROM n),
t AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM m, range(0, 80) AS r(k)),
u AS (SELECT doc_id, source, text, ('0x' || substr(md5('17|' || doc_id || '|' || md5(coalesce(text, '')) || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
d AS (SELECT doc_id, u.source, text, count(*) FILTER (WHERE cdf <= u) AS times FROM u JOIN t ON t.source IS NOT DISTINCT FROM u.source GROUP BY doc_id, u.source, text)
SELECT doc_id, source, c::INTEGER AS copy, md5('17 order|' || doc_id || '|' || md5(coalesce(text, '')) || '|' || c) AS shuffle_key, text FROM d, unnest(range(1, times + 1)) AS x(c)
"""
