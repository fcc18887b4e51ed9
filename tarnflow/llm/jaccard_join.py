"""Jaccard join of documents on word shingles, by signature trees.

Equal shingle sets are one set. Sets that share a band of minimum hashes are gathered into candidate
components, small enough for one task or dealt into blocks. What is apart after that in a large component meets
block by block, or only where it shares a band and a range of sizes if there are many blocks and that sends less. Within a task the sets are the leaves of
a tree whose nodes hold the OR of the token bitmaps below and the range of set sizes; a traversal of
pairs of nodes drops those whose largest possible overlap is too small, and the pairs of leaves that
are left are compared exactly unless they are linked already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.components import connected_components
from tarnflow.llm.grouping import dealt, grouped
from tarnflow.llm.storage import cut, discard
from tarnflow.llm.textbytes import NOT_SPACE, U64, Prefix, Words, mix, pieces, text_bytes

#: Minimum hashes kept per set, from which each band picks some.
_BASE = 128
_FANOUT = 16
#: A large component is compared as a whole while that sends no more than so many rows for each of its sets.
_TIMES = 16


class Shingles:
    """Sorted distinct shingle hashes of each text: ``tokens`` end to end, ``n`` per row, ``first``."""

    def __init__(self, column: pa.Array, words_each: int):
        words = Words(*text_bytes(column), NOT_SPACE)
        at, h = words.grams(words_each)
        doc = words.doc[at]
        few = np.flatnonzero((words.count > 0) & (words.count < words_each))
        if len(few):  # the whole sequence is their one shingle
            whole = Prefix(words.hash).hash(words.first[few], words.first[few] + words.count[few])
            doc, h = np.concatenate((doc, few)), np.concatenate((h, whole))
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        doc, h = doc[order], h[order]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
        self.tokens, doc = h[new], doc[new]
        self.n = np.bincount(doc, minlength=len(column))
        self.first = np.concatenate(([0], np.cumsum(self.n)))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums that name each set."""
        out = []
        for salt in (U64(0x51ED270B), U64(0xC2B2AE3D27D4EB4F)):
            sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(self.tokens ^ salt))))
            out.append(mix(sums[self.first[1:]] - sums[self.first[:-1]]).view(np.int64))
        return tuple(out)


def miss_chance(threshold: float, each: int, bands: int) -> float:
    """Chance that a pair at the threshold shares no band, over how many of the base's hashes agree."""
    chance = 0.0
    for m in range(_BASE + 1):
        weight = math.comb(_BASE, m) * threshold**m * (1 - threshold) ** (_BASE - m)
        chance += weight * (1 - math.comb(m, each) / math.comb(_BASE, each)) ** bands
    return chance


def plan_bands(threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """Minimum hashes a band, and the least number of bands that keeps the chance of a miss under ``miss``."""
    each = max(1, math.floor(math.log(0.4) / math.log(threshold)))
    bands = 1
    while miss_chance(threshold, each, bands) > miss:
        bands += 1
    return each, bands


def band_hashes(sets: Shingles, each: int, bands: int, seed: int) -> np.ndarray:
    """A 64-bit hash per non-empty set and band."""
    rng = np.random.default_rng(seed)
    salts = rng.integers(0, 1 << 32, _BASE, dtype=np.uint32)
    odd = rng.integers(0, 1 << 31, _BASE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    picks = np.stack([rng.permutation(_BASE)[:each] for _ in range(bands)])
    base = (sets.tokens >> U64(32)).astype(np.uint32)
    starts = sets.first[:-1][sets.n > 0]
    low = np.empty((len(starts), _BASE), np.uint32)
    for k in range(_BASE):
        v = (base ^ salts[k]) * odd[k]
        low[:, k] = np.minimum.reduceat(v ^ (v >> np.uint32(15)), starts)
    out = np.empty((len(starts), bands), U64)
    for b in range(bands):
        h = np.full(len(starts), b + 1, U64)
        for k in picks[b]:
            h = mix(h * U64(0x9E3779B97F4A7C15) + low[:, k])
        out[:, b] = h
    return out


def _describe(words_each: int, each: int, bands: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = Shingles(batch.column("text"), words_each)
            k1, k2 = sets.keys()
            hashes = band_hashes(sets, each, bands, seed) if len(sets.tokens) else np.zeros((0, bands), U64)
            sizes = np.where(sets.n > 0, bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(hashes.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(k1), pa.array(k2), pa.array(sets.n, pa.int64()), lists], ["id", "text_key", "k1", "k2", "n", "bands"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set with the first set of its band, from rows in order of band and set."""
    last_h = last_rep = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, rep = batch.column("h").to_numpy(), batch.column("rep").to_numpy()
        if last_h is not None:
            h, rep = np.append(last_h, h), np.append(last_rep, rep)
        new = np.append(True, h[1:] != h[:-1])
        head = rep[np.flatnonzero(new)][np.cumsum(new) - 1]
        last_h, last_rep = h[-1], head[-1]
        far = rep != head
        pairs = np.unique(np.stack((rep[far], head[far]), 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _tokens(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = Shingles(batch.column("text"), words_each)
            k1, k2 = sets.keys()
            good = np.flatnonzero((k1 == batch.column("k1").to_numpy()) & (k2 == batch.column("k2").to_numpy()))
            data = [sets.tokens[sets.first[i] : sets.first[i + 1]].tobytes() for i in good.tolist()]
            own = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([own.column("rep"), own.column("part"), own.column("blocks"), pa.array(data, pa.binary())], ["rep", "part", "blocks", "tokens"])

    return run


class Tree:
    """The signature tree of some sets, in order of size; level 0 has the sets themselves."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets])
        bits = 1 << min(16, max(8, int(4 * np.median(n)).bit_length()))
        maps = np.zeros((len(sets), bits // 64), U64)
        for i, s in enumerate(sets):
            place = (s & U64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[i], place >> 6, U64(1) << (place & 63).astype(U64))
        extra = n - np.bitwise_count(maps).sum(1)  # tokens that share a bit with another
        self.levels = [(maps, n, n, extra)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, extra = self.levels[-1]
            cuts = np.arange(0, len(low), _FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(extra, cuts)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether the largest overlap of a set below node i with one below node j could reach the threshold."""
        maps, low, high, extra = self.levels[level]
        need = num * (low[i] + low[j])  # overlap * (num + den) >= num * (sizes together)
        good = np.minimum(high[i], high[j]) * (num + den) >= need
        at = np.flatnonzero(good)
        step = max(1, (1 << 21) // maps.shape[1])
        for k in range(0, len(at), step):
            own = at[k : k + step]
            common = np.bitwise_count(maps[i[own]] & maps[j[own]]).sum(1, dtype=np.int64)
            good[own] = (common + np.minimum(extra[i[own]], extra[j[own]])) * (num + den) >= need[own]
        return good

    def pairs(self, label_of, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets that may link and have different labels, by dual traversal from the root."""
        size = len(self.levels[0][1])
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            label = label_of()
            cuts = np.arange(0, size, _FANOUT**level)
            low, high = np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts)
            open_ = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
            i, j = i[open_], j[open_]
            good = self.may_link(level, i, j, num, den)
            i, j = i[good], j[good]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            below = len(self.levels[level - 1][1])
            a, b = np.divmod(np.arange(_FANOUT * _FANOUT), _FANOUT)
            step = 256
            for k in range(0, len(i), step):
                x = (i[k : k + step, None] * _FANOUT + a).ravel()
                y = (j[k : k + step, None] * _FANOUT + b).ravel()
                inside = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
                stack.append((level - 1, x[inside], y[inside]))


def link_sets(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Exact links that join sets whose labels differ, enough of them to connect all that link."""
    order = np.lexsort((np.array([s[0] if len(s) else 0 for s in sets], U64), np.array([len(s) for s in sets])))
    sets = [sets[k] for k in order]
    parent = np.unique(labels[order], return_inverse=True)[1].astype(np.int64)
    roots = np.full(parent.max() + 1, -1)
    for k, p in enumerate(parent.tolist()):  # one place of each label stands for it
        if roots[p] < 0:
            roots[p] = k
    up = roots[parent]

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def all_roots() -> np.ndarray:
        nonlocal up
        while (higher := up[up]).tobytes() != up.tobytes():
            up = higher
        return up

    found: list[tuple[int, int]] = []

    def compare(a: int, b: int) -> bool:
        x, y = sets[a], sets[b]
        if len(x) > len(y):
            x, y = y, x
        if len(x) * den < num * len(y):
            return False
        place = np.searchsorted(y, x)
        place[place == len(y)] = 0
        both = int((y[place] == x).sum())
        if den * both < num * (len(x) + len(y) - both):
            return False
        found.append((int(order[a]), int(order[b])))
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
        return True

    pivot = 0
    for k in range(1, len(sets)):  # copies of one text: most are linked here already
        if find(k) != find(pivot) and not compare(pivot, k) and (k < 2 or not (find(k) != find(k - 1) and compare(k - 1, k))):
            pivot = k
    for i, j in Tree(sets).pairs(all_roots, num, den):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if find(a) != find(b):
                compare(a, b)
    return found


def _link(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["part", "p", "q"]):
            if group.num_rows < 2:
                continue
            rep, label = group.column("rep").to_numpy(), group.column("label").to_numpy()
            links = link_sets([np.frombuffer(x, U64) for x in group.column("tokens").to_pylist()], label, num, den)
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    return run


def _linked(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links within each (part, p, q) of ``part, p, q, rep, label, tokens``."""
    return cut(dealt(rows.select("part", "p", "q", "rep", "label", "tokens"), "part", "p", "q").mapInArrow(_link(num, den), "a long, b long"), "jaccard-links")


def _contested(bands: DataFrame, named: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Where sets of one large component that have different labels are to meet: ``part, p, q, rep, label, tokens``.

    ``bands``: rep, n, bands; ``named``: part, rep, label, tokens. A component is one place, or, if that would send more than ``_TIMES`` rows
    a set and they send fewer, its places are where sets share a band and a range of sizes. Sets that can link differ in size by less than one
    step, so each is in the range of its size and the next. The sets of the most frequent label of a place are dealt into blocks, and
    each of the others meets all blocks. Only ids are sent until it is known what meets.
    """
    whole = named.select("part", "rep", "label", F.col("part").alias("place"))

    def meetings(rows: DataFrame, label: str) -> DataFrame:
        held = rows.groupBy("part", "place", "label").agg(F.count(F.lit(1)).alias("n"))
        size = held.groupBy("part", "place").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
        dealt_ = size.select("*", F.ceil(F.col("all") / block).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("sides"))
        return cut(dealt_.select("part", "place", "main", "all", "blocks", "sides", F.expr("(all - most) * blocks + all * sides").alias("sent")), label)

    at_once = meetings(whole, "met-at-once")
    many = at_once.where(F.col("sent") > _TIMES * F.col("all")).select("part", "sent")
    step = F.floor(F.log("n") / math.log(den / num)) if num < den else F.col("n")
    banded = bands.join(named.select("rep", "part", "label").join(many.select("part"), "part", "left_semi"), "rep")
    banded = banded.select("part", "rep", "label", F.explode("bands").alias("h"), step.alias("step")).select("part", "rep", "label", "h", F.explode(F.array("step", F.col("step") + 1)).alias("c"))
    banded = banded.select("part", "rep", "label", F.xxhash64("h", "c").alias("place"))  # two places under one number only compare more
    by_band = meetings(banded, "met-in-bands")
    costs = by_band.groupBy("part").agg(F.sum("sent").alias("in_bands"))
    fewer = cut(many.join(costs, "part", "left").where("coalesce(in_bands, 0) < sent").select("part"), "parts-by-band")
    both = banded.join(by_band.join(fewer, "part", "left_semi"), ["part", "place"]).unionByName(whole.join(at_once.join(fewer, "part", "left_anti"), ["part", "place"]))
    spot = lambda k: F.pmod(F.xxhash64(F.lit(3), F.col("rep")), F.col(k)).cast("int")
    to = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    apart = both.where("label <> main").select("place", "rep", spot("sides").alias("p"), to("blocks").alias("q"))
    all_ = both.select("place", "rep", to("sides").alias("p"), spot("blocks").alias("q"))
    ids = apart.unionByName(all_).distinct().withColumnRenamed("place", "part")
    return ids.join(named.select("rep", "label", "tokens"), "rep")


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words_each: int = 3, threshold: tuple[int, int] = (90, 100), block: int = 2048, block_tokens: int = 4_000_000, miss: float = 1e-6, seed: int = 5) -> DataFrame:
    """One row per document: ``id, n_shingles, component`` (smallest id that links lead to, itself included), ``text_key``, ``group``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A set is a text's distinct runs of ``words_each``
    words; fewer words are one run. Sets link when den * intersection >= num * union. Texts without words,
    or null, have an empty set that links with nothing; rows with a null id neither, and their component is
    null. Equal texts count as linked; repeated rows each give a row. One id with different texts is as many
    documents, each in the component of its text. Ids are integers. Empty tables give no rows; other columns are
    ignored. Texts are read whole; memory follows the longest.

    ``group`` numbers components (null: linked with nothing for lack of words or id) and ``text_key`` is a 64-bit hash of the text: two
    components whose smallest ids are equal differ in ``group``.

    A pair at the threshold shares no band with a chance of at most ``miss``, closer pairs with far less.
    Components of more than ``block`` sets or ``block_tokens`` tokens are
    dealt into blocks twice, at random, and linked within blocks; what has another label than the rest of its
    component, or of a band of it, is then compared with that rest.
    """
    num, den = threshold
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{doc_id} must hold integers")
    each, bands = plan_bands(num / den, miss)
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    keyed = given.withColumn("text_key", F.xxhash64("text"))
    described = cut(keyed.mapInArrow(_describe(words_each, each, bands, seed), "id long, text_key long, k1 long, k2 long, n long, bands array<long>"), "shingle-sets")
    worded = described.where("id is not null and n > 0")
    sets = worded.groupBy("k1", "k2").agg(F.min("id").alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("rep"), "*"), "distinct-sets")  # numbers of sets, fixed by the table
    ordered = sets.select("rep", F.explode("bands").alias("h")).repartition("h").sortWithinPartitions("h", "rep")
    parts = connected_components(ordered.mapInArrow(_stars, "a long, b long"))

    members = sets.select("k1", "k2", "rep", "low", "n").join(parts.select(F.col("node").alias("rep"), F.col("component").alias("part")), "rep")
    members = cut(members, "part-members")
    sizes = members.groupBy("part").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("sets") / block), F.ceil(F.col("tokens") / block_tokens)).cast("int")
    wanted = members.join(sizes.select("part", blocks.alias("blocks")), "part").select("k1", "k2", "rep", F.col("low").alias("id"), "part", "blocks")
    texts = given.where("id is not null").join(wanted.hint("merge"), "id")  # one way at every size
    tokens = rows = cut(texts.select("rep", "part", "blocks", "k1", "k2", "text").mapInArrow(_tokens(words_each), "rep long, part long, blocks int, tokens binary"), "part-sets")
    again = cut(rows.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep"), "repeated-sets")
    if not again.isEmpty():  # repeated rows of one id and text
        rows = rows.join(again, "rep", "left_anti").unionByName(rows.join(again, "rep", "left_semi").dropDuplicates(["rep"]))

    zero = F.lit(0)
    links = _linked(rows.where("blocks = 1").select("*", zero.alias("p"), zero.alias("q"), F.col("rep").alias("label")), num, den)
    large = rows.where("blocks > 1")
    if not large.isEmpty():
        for salt in (1, 2):
            own = F.pmod(F.xxhash64(F.lit(salt), F.col("rep")), F.col("blocks")).cast("int")
            links = links.union(_linked(large.select("*", own.alias("p"), zero.alias("q"), F.col("rep").alias("label")), num, den))
        so_far = connected_components(links)
        named = large.join(so_far.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        named = cut(named.select("part", "rep", "label", "tokens"), "labelled-sets")
        links = links.union(_linked(_contested(sets.select("rep", "n", "bands"), named, num, den, block), num, den))
        discard(named)
    discard(members, tokens, again)
    final = connected_components(links)
    by_set = sets.select("k1", "k2", "rep", "low").join(final.select(F.col("node").alias("rep"), F.col("component").alias("group")), "rep", "left").select("k1", "k2", "low", F.coalesce("group", "rep").alias("group"))
    by_set = cut(by_set, "set-groups")
    lowest = by_set.groupBy("group").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1").select("group", "component")
    by_set = by_set.join(lowest, "group", "left").select("k1", "k2", "group", F.coalesce("component", "low").alias("component"))
    judged = worded.select("id", "n", "text_key", "k1", "k2").join(by_set, ["k1", "k2"]).select("id", F.col("n").alias("n_shingles"), "component", "text_key", "group")
    alone = described.where("id is null or n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component"), "text_key", F.lit(None).cast("long").alias("group"))
    return judged.union(alone)


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Documents with the size of their shingle set and their component, as the contract has it."""
    out = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


ORACLE_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(3, len(ws)) - 1], ' ') AS t FROM w, unnest(range(1, len(ws) - least(3, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.doc_id = a GROUP BY a, n
"""
