"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, connected components.

The signs of projections on random hyperplanes make a signature, and some of its bits a bucket number in
each table. Only ids and signatures go to the buckets. There, signatures that differ in few bits make
groups, but only of vectors that meet no earlier; a vector itself is sent once to each such group, where
exact cosines decide. So what is sent of a vector follows its near vectors, not the number of tables. What
leaves a group is a count per vector and a spanning set of links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.components import connected_components
from tarnflow.llm.grouping import dealt, grouped, smallest_reachable
from tarnflow.llm.storage import cut, discard


#: Bits of a signature.
SIGNS = 384


def _binomial(p: float) -> list[float]:
    """Chances of 0, 1, ... of the signs to differ, each with a chance of ``p``."""
    return [math.comb(SIGNS, d) * p**d * (1 - p) ** (SIGNS - d) for d in range(SIGNS + 1)]


def most_differing(threshold: float, miss: float) -> int:
    """The least number of signs such that a pair at the threshold differs in more with a chance of at most ``miss``."""
    left, most = 1.0, 0
    for most, chance in enumerate(_binomial(math.acos(threshold) / math.pi)):
        left -= chance
        if left <= miss:
            break
    return most


def plan_tables(n: int, threshold: float, miss: float, per_bucket: int = 512) -> tuple[int, int]:
    """Bits a table and number of tables: buckets of about ``per_bucket`` vectors, and a chance of at most ``miss`` to lose a pair at the threshold.

    Tables draw their bits from one signature, so the chance is taken over how many of its signs differ.
    """
    bits = min(31, max(4, math.ceil(math.log2(max(2, n) / per_bucket))))
    weights = _binomial(math.acos(threshold) / math.pi)
    apart = [1 - math.comb(SIGNS - d, bits) / math.comb(SIGNS, bits) for d in range(SIGNS + 1)]
    chance = lambda tables: sum(w * x**tables for w, x in zip(weights, apart, strict=True))
    high = 1
    while chance(high) > miss:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if chance(mid) > miss else (low, mid)
    return bits, high


def _picks(dims: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """The places in a signature that each table reads."""
    rng = np.random.default_rng([seed, dims, 1])
    return np.stack([rng.permutation(SIGNS)[:bits] for _ in range(tables)])


def _codes(signs: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Bucket numbers in each table, from rows of 0 and 1."""
    weights = (1 << np.arange(picks.shape[1], dtype=np.int64)).astype(float)
    return np.stack([signs[:, p] @ weights for p in picks], 1).astype(np.int32)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNS // 8)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors, in double precision, from the bytes of a binary column."""
    data = b"".join(column.to_pylist())
    x = np.frombuffer(data, "<f8" if len(data) == 8 * dims * len(column) else "<f4").reshape(-1, dims).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes, in the precision they come in; the rest as null."""
    for batch in batches:
        column = batch.column("embedding")
        sizes = np.asarray(column.value_lengths().fill_null(0))
        flat, offs = np.asarray(column.flatten().fill_null(np.nan)), np.concatenate(([0], np.cumsum(sizes)))
        flat = flat + flat.dtype.type(0)  # no negative zeros
        out = []
        for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            x = flat[lo:hi]
            out.append(x.tobytes() if hi > lo and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary()), pa.array(sizes, pa.int32())], ["id", "vec", "dims"])


def _sign(bits_of: dict[int, tuple[int, int]], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, picks = {}, {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, SIGNS))
                    picks[d] = _picks(d, *bits_of[d], seed)
                for at in range(0, part.num_rows, 2048):
                    own = part.slice(at, 2048)
                    signs = _matrix(own.column("vec"), d) @ planes[d] > 0
                    codes = _codes(signs, picks[d])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(own.num_rows + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel()))
                    sign = pa.array([x.tobytes() for x in np.packbits(signs, axis=1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("cid", "rep", "size", "dims", "vec")], sign, lists], ["cid", "rep", "size", "dims", "vec", "sign", "codes"])

    return run


def _met_before(signs: np.ndarray, picks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j agree in all bits of one of the tables of ``picks``."""
    met = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 12):
        part = slice(at, at + (1 << 12))
        same = signs[i[part]] == signs[j[part]]
        for p in picks:
            met[part] |= same[:, p].all(1)
    return met


def _gather(bits_of: dict[int, tuple[int, int]], seed: int, most: int):
    """Groups of a bucket's vectors that are linked by signatures that differ in few bits and meet in no earlier table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = {d: _picks(d, *of, seed) for d, of in bits_of.items()}
        rows: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush():
            out = [np.concatenate(x) for x in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["t", "p", "q", "head", "cid", "own"])

        for group in grouped(batches, ["dims", "t", "code", "p", "q"]):
            if group.num_rows < 2:
                continue
            d, t, p, q = (group.column(c)[0].as_py() for c in ("dims", "t", "p", "q"))
            packed = _signatures(group.column("sign"))
            words, block, cid = packed.view(np.uint64), group.column("own").to_numpy(), group.column("cid").to_numpy()
            one = np.arange(len(cid)) if p == q else np.flatnonzero(block == p)
            two = one if p == q else np.flatnonzero(block == q)
            apart = np.zeros((len(one), len(two)), np.uint16)
            for k in range(words.shape[1]):
                apart += np.bitwise_count(words[one, k][:, None] ^ words[two, k][None, :])
            close = apart <= most
            i, j = np.nonzero(np.triu(close, 1) if p == q else close)
            i, j = one[i], two[j]
            if t and len(i):
                new = ~_met_before(np.unpackbits(packed, axis=1), picks[d][:t], i, j)
                i, j = i[new], j[new]
            if not len(i):
                continue
            head = smallest_reachable(len(cid), i, j)
            some = np.unique(np.concatenate((i, j)))
            rows.append((*[np.full(len(some), x, np.int32) for x in (t, p, q)], cid[head[some]], cid[some], block[some]))
            held += len(some)
            if held > 50_000:
                yield flush()
                held = 0
        if rows:
            yield flush()

    return run


def _compare(bits_of: dict[int, tuple[int, int]], seed: int, threshold: float, most: int):
    """Exact cosines within a group, for the pairs that the bucket put into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = {d: _picks(d, *of, seed) for d, of in bits_of.items()}
        rows: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush():
            rep, add, low = (np.concatenate(x) for x in zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(add), pa.array(low)], ["rep", "add", "low"])

        for group in grouped(batches, ["t", "p", "q", "head"]):
            d, t, p, q = (group.column(c)[0].as_py() for c in ("dims", "t", "p", "q"))
            x = _matrix(group.column("vec"), d)
            rep, size, block = (group.column(c).to_numpy() for c in ("rep", "size", "own"))
            one = np.arange(len(x)) if p == q else np.flatnonzero(block == p)
            two = one if p == q else np.flatnonzero(block == q)
            near = x[one] @ x[two].T >= threshold
            i, j = np.nonzero(np.triu(near, 1) if p == q else near)
            i, j = one[i], two[j]
            if len(i):
                signs = np.unpackbits(_signatures(group.column("sign")), axis=1)
                new = (signs[i] != signs[j]).sum(1) <= most
                new &= ~_met_before(signs, picks[d][:t], i, j)
                i, j = i[new], j[new]
            if not len(i):
                continue
            add = np.bincount(i, size[j], len(x)) + np.bincount(j, size[i], len(x))
            order = np.argsort(rep)
            place = np.empty(len(x), np.int64)
            place[order] = np.arange(len(x))
            low = rep[order][smallest_reachable(len(x), place[i], place[j])][place]
            some = np.flatnonzero(add)
            rows.append((rep[some], add[some].astype(np.int64), low[some]))
            held += len(some)
            if held > 50_000:
                yield flush()
                held = 0
        if rows:
            yield flush()

    return run


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, miss: float = 1e-4, block: int = 1024, seed: int = 11) -> DataFrame:
    """One row per vector: ``id, n_links, component`` (smallest id that links lead to, itself included).

    Vectors link when their cosine, in double precision, is at least ``threshold``. A pair at the threshold
    is missed with a chance of at most ``miss``, closer ones with less; no pair below it links. Vectors that
    are null, empty, zero or hold a null or non-finite component, and rows with a null id, link with
    nothing; vectors of different length neither. Equal vectors are one class and count each by its size;
    repeated rows each give a row and count as vectors; rows that share an id but not
    their vector share their links. Empty tables give no rows; other columns are ignored. Ids are integers.

    Buckets of more than ``block`` classes are dealt into blocks and all pairs of blocks become tasks of their own.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    if vectors.schema[vec_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{vec_id} must hold integers")
    given = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("embedding"))
    if given.schema["embedding"].dataType.elementType.typeName() != "float":
        given = given.withColumn("embedding", F.col("embedding").cast("array<double>"))
    packed = cut(given.mapInArrow(_pack, "id long, vec binary, dims int"), "vectors")
    usable = packed.where("id is not null and vec is not null")
    classes = cut(usable.groupBy("vec", "dims").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")), "vector-classes")
    bits_of = {r.dims: plan_tables(r["count"], threshold, miss) for r in classes.groupBy("dims").count().collect()}  # one row per length of vector
    most = most_differing(threshold, miss / 10)
    numbered = classes.select(F.monotonically_increasing_id().alias("cid"), "rep", "size", "dims", "vec")
    signed = cut(numbered.mapInArrow(_sign(bits_of, seed), "cid long, rep long, size long, dims int, vec binary, sign binary, codes array<int>"), "signed")
    spread = signed.select("cid", "dims", "sign", F.posexplode("codes").alias("t", "code"))
    large = spread.groupBy("dims", "t", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    large = cut(large.select("dims", "t", "code", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-buckets")
    met = spread.join(large, ["dims", "t", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = met.select("*", other.alias("other")).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    rows = dealt(pairs.select("dims", "t", "code", "p", "q", "own", "cid", "sign"), "dims", "t", "code", "p", "q")
    groups = cut(rows.mapInArrow(_gather(bits_of, seed, most), "t int, p int, q int, head long, cid long, own int"), "groups")
    sent = groups.join(signed.select("cid", "rep", "size", "dims", "vec", "sign"), "cid")
    links = cut(dealt(sent, "t", "p", "q", "head").mapInArrow(_compare(bits_of, seed, threshold, most), "rep long, add long, low long"), "links")
    discard(signed, large, groups)
    counts = links.groupBy("rep").agg(F.sum("add").alias("add"))
    parts = connected_components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    judged = classes.select("vec", "rep", "size").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    judged = judged.select("vec", (F.col("size") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = usable.join(judged, "vec").select("id", "n_links", "component")
    alone = packed.where("id is null or vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone)


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All vectors with their links, component and whether they stand for it, as the contract has it."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


ORACLE_OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
