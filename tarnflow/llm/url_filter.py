"""URL rules, judged by a blocked Bloom filter and an exact hash join, in DataFrame operations only.

A rule lists a canonical URL: a host, which stands for its subdomains too, and the beginning of a path.
Every URL is looked up under each of its host's suffixes and each path length that a rule has. A
blocked Bloom filter of the listed URLs passes the look-ups that may hit; an exact hash join of those
with the rules removes the false positives. The longest rule decides; URLs without one are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.storage import cut

#: Words of 64 bits in a block, and bits set in a block for each key.
_WORDS, _PROBES = 8, 6


def url_host(url: Column) -> Column:
    """From after the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://`` empty."""
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _bits(key: Column) -> list[tuple[Column, Column]]:
    """Word and bit, within its block, of each probe of a key."""
    second = F.xxhash64(key, F.lit(7))
    probes = [F.shiftrightunsigned(second, 9 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(_PROBES)]
    return [(F.shiftright(p, 6), _power(p % 64)) for p in probes]


def _power(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def _masks(key: Column) -> list[Column]:
    """For each word of a block the bits that a key sets in it."""
    bits = _bits(key)
    out = []
    for w in range(_WORDS):
        mask = F.lit(0).cast("long")
        for word, bit in bits:
            mask = mask.bitwiseOR(F.when(word == w, bit).otherwise(F.lit(0).cast("long")))
        out.append(mask)
    return out


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter's non-empty blocks ``block, w0..w7`` over the column ``key``."""
    masked = keys.select(F.pmod("key", F.lit(blocks)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return masked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", keys_per_block: int = 32) -> DataFrame:
    """Each page as ``row`` (struct of its columns) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``verdict, host, path``; a rule with a null in any of them is left out, and of rules that
    list the same URL ``block`` wins. The longest fitting rule decides, by the length of host and path
    together; of equally long ones that with the longer host. A null URL or one without ``://`` has an
    empty host and path and gets ``default``, like every URL that no rule fits. Repeated rows each give
    a row; empty tables give no rows, or the default.

    Distinct (host, path) pairs are judged once and joined back; URLs without a host take no part in that. A URL that
    holds a third of all rows is one row to judge; in the join back its rows share a key, and Spark
    splits or broadcasts around it. Rules and blocks are tables of known size on disk:
    Spark broadcasts them under its threshold and shuffles beyond it.
    """
    spark = pages.sparkSession
    listed = rules.select(F.col("verdict").cast("string"), F.col("host").cast("string"), F.col("path").cast("string")).where("verdict is not null and host is not null and path is not null")
    listed = cut(listed.groupBy("host", "path").agg(F.max_by("verdict", F.col("verdict") == "block").alias("verdict")).withColumn("key", _key(F.col("host"), F.col("path"))), "url-rules")
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).first()
    blocks = max(1, -(-size.n // keys_per_block))
    bloom = cut(bloom_blocks(listed.select("key"), blocks), "url-bloom")

    named = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    distinct = named.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.lit(size.lengths).cast("array<int>") if size.lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    looked = distinct.select("host", "path", F.explode(suffixes).alias("h")).select("host", "path", "h", F.explode(F.transform(lengths, lambda n: F.substring("path", F.lit(1), n))).alias("p"))
    keyed = looked.withColumn("key", _key(F.col("h"), F.col("p"))).withColumn("block", F.pmod("key", F.lit(blocks)))
    passes = None
    for i, mask in enumerate(_masks(F.col("key"))):
        hit = F.col(f"w{i}").bitwiseAND(mask) == mask
        passes = hit if passes is None else passes & hit
    possible = keyed.join(bloom, "block").where(passes).select("host", "path", "h", "p", "key")
    exact = listed.select("key", F.col("host").alias("h"), F.col("path").alias("p"), "verdict")
    hits = possible.join(exact, ["key", "h", "p"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct((F.length("h") + F.length("p")).alias("size"), F.length("h").alias("host_size"), F.concat("h", "p").alias("rule"), "verdict")).alias("best"))
    out = named.where("host <> ''").join(best, ["host", "path"], "left")
    out = out.select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    bare = named.where("host = ''").select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return out.unionByName(bare)


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages judged by the five rules of the contract."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    out = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
    return out.select("row.page_id", "host", "path", "rule", "verdict")


ORACLE_OP3 = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT page_id, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(verdict, length(h || r.p)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT p.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""
