"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings that mark toxic texts is learned from a labelled sample. Each fold
of the sample gets its features from a lexicon of the other folds and, for the calibration, its margins
from trees of the other folds; so no row is judged by what it taught. Features are lexicon densities,
lexicon words near second-person words, capitals, punctuation and obfuscation rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tarnflow.llm.boosting import BoostedTrees, Isotonic
from tarnflow.llm.storage import cut
from tarnflow.llm.textbytes import ALNUM, U64, Lookup, Words, byte_prefix, mix, pieces, text_bytes

#: Second-person words of the corpus's four languages.
SECOND_PERSON = (
    "you your yours yourself u ur "
    "du dich dir dein deine deiner deinem deinen ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vos tuyo tuya tus vosotros vosotras os vuestro"
).split()
#: Characters that stand for letters in disguised words.
LEET = dict(zip("013457@$!", "oieastasi", strict=True))
#: Lengths, in bytes, of the word beginnings in the lexicon; 0 stands for whole words.
KINDS = (0, 4, 5, 6)
_NEAR = 4

_LEET = np.arange(256, dtype=np.uint8)
for _from, _to in LEET.items():
    _LEET[ord(_from)] = ord(_to)
_LEET_ALPHABET = ALNUM.copy()
_LEET_ALPHABET[[ord(c) for c in "@$!*"]] = True
_SPECIAL = np.zeros(256, bool)
_SPECIAL[[ord(c) for c in "@$*0134579"]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    return Words(*text_bytes(pa.array([" ".join(words)])), ALNUM).hash


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id, as text, is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Scanned:
    """Words of a batch with the hashes of each lexicon kind."""

    def __init__(self, column: pa.Array):
        self.raw, self.offs = text_bytes(column)
        self.words = Words(self.raw, self.offs, ALNUM)
        low = np.where((self.raw >= 65) & (self.raw <= 90), self.raw + 32, self.raw).astype(np.uint8)
        prefix = byte_prefix(low)
        size = self.words.ends - self.words.starts
        self.hashes = {}
        for kind in KINDS:
            at = np.arange(len(size)) if not kind else np.flatnonzero(size > kind)
            h = self.words.hash[at] if not kind else mix(prefix.hash(self.words.starts[at], self.words.starts[at] + kind) + U64(kind))
            self.hashes[kind] = (at, h)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts each word and word beginning occurs, batch by batch."""
    for batch, part in ((b.filter(pa.array(b.column("part").to_numpy() == k)), k) for b in pieces(batches, "text") for k in np.unique(b.column("part").to_numpy()).tolist()):
        scan = Scanned(batch.column("text"))
        toxic = batch.column("toxic").to_numpy().astype(bool)
        doc = np.concatenate([scan.words.doc[at] for at, _ in scan.hashes.values()])
        h = np.concatenate([h for _, h in scan.hashes.values()])
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
        doc, h = doc[new], h[new]
        keys, start = np.unique(h, return_index=True)
        bad = np.add.reduceat(toxic[doc].astype(np.int64), start) if len(h) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part), pa.int32()), pa.array(keys.view(np.int64)), pa.array(bad), pa.array(np.diff(np.append(start, len(h))) - bad)], ["part", "h", "toxic", "clean"])


class Lexicon:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.lookup, self.weights = Lookup(hashes), weights[order]
        self.second = Lookup(_hash_words(SECOND_PERSON))

    def features(self, column: pa.Array) -> np.ndarray:
        """A row of dense features per text; texts without words give zeros."""
        scan = Scanned(column)
        words, raw, offs, rows = scan.words, scan.raw, scan.offs, len(column)
        count = np.maximum(words.count, 1)
        out = []
        any_hit = np.zeros(len(words.hash), bool)
        best = np.zeros(len(words.hash))
        for kind in KINDS:
            at, h = scan.hashes[kind]
            found, place = self.lookup.find(h)
            at, weight = at[found], self.weights[place]
            any_hit[at] = True
            best[at] = np.maximum(best[at], weight)
            n = np.bincount(words.doc[at], minlength=rows)
            top = np.zeros(rows)
            np.maximum.at(top, words.doc[at], weight)
            out += [n, n / count, top, np.bincount(words.doc[at], weight, rows) / count]
        hits = np.flatnonzero(any_hit)
        out += [np.bincount(words.doc[hits], minlength=rows), np.bincount(words.doc[hits], best[hits], rows)]

        second = np.sort(self.second.find(words.hash)[0])
        out.append(np.bincount(words.doc[second], minlength=rows) / count)
        near = np.zeros(len(hits), bool)
        for side in ("left", "right"):
            place = np.searchsorted(second, hits, side) - (side == "right")
            inside = (place >= 0) & (place < len(second))
            other = second[np.clip(place, 0, max(0, len(second) - 1))] if len(second) else np.zeros(len(hits), np.int64)
            if len(second):
                near |= inside & (abs(other - hits) <= _NEAR) & (words.doc[other] == words.doc[hits])
        out.append(np.bincount(words.doc[hits[near]], minlength=rows))

        size = np.maximum(np.diff(offs), 1)
        per = lambda mask: np.add.reduceat(np.append(mask, 0).astype(np.int64), offs[:-1]) * (np.diff(offs) > 0)
        upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
        caps, letters = per(upper), per(upper | lower)
        out.append(caps / np.maximum(letters, 1))
        sums = np.concatenate(([0], np.cumsum(upper)))
        shouted = (sums[words.ends] - sums[words.starts] == words.ends - words.starts) & (words.ends - words.starts > 2)
        out.append(np.bincount(words.doc[shouted], minlength=rows) / count)
        bang, ask = raw == 33, raw == 63
        twice = np.append(bang[1:] & bang[:-1], False) if len(raw) else bang
        for mask in (bang, ask, twice, (raw == 42) | (raw == 64) | (raw == 36), (raw > 32) & ~ALNUM[raw] & ~upper):
            out.append(per(mask) / size)
        disguised = Words(_LEET[raw], offs, _LEET_ALPHABET)
        marks = np.concatenate(([0], np.cumsum(_SPECIAL[raw])))
        mixed = marks[disguised.ends] - marks[disguised.starts]
        odd = (mixed > 0) & (mixed < disguised.ends - disguised.starts)
        out.append(np.bincount(disguised.doc[odd], minlength=rows) / count)
        found, _ = self.lookup.find(disguised.hash)
        found = found[odd[found]]
        out.append(np.bincount(disguised.doc[found], minlength=rows))
        out += [np.log1p(words.count), np.bincount(words.doc, words.ends - words.starts, rows) / count, per(raw >= 128) / size]
        return np.stack([np.asarray(x, float) for x in out], 1)


class Model:
    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, calibration: Isotonic | None, base: float):
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.base)
        return np.clip(self.calibration.score(self.trees.margin(self.lexicon.features(column))), 0, 1)


#: Folds of the sample: each gets its features from a lexicon of the others, and its margins from trees of the others.
FOLDS = 4


def labelled_sample(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """``id, toxic, part, text`` of at most ``max_rows`` labelled documents outside the held-out fold, those whose ids hash lowest."""
    ids = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    ids = ids.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("id").cast("string"), F.lit(23))
    few = cut(ids.orderBy(order, "id").limit(max_rows), "label-sample")  # at most max_rows rows of 12 bytes: small enough to send everywhere
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(41)), F.lit(FOLDS)).cast("int")
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    return cut(texts.join(F.broadcast(few), "id").select("id", "toxic", part.alias("part"), "text"), "labelled-texts")


def _features(lexicons: list[Lexicon]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 19):
            parts = batch.column("part").to_numpy()
            for k in np.unique(parts).tolist():
                own = batch.filter(pa.array(parts == k))
                x = lexicons[k].features(own.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([own.column("id").cast(pa.string()), own.column("toxic"), own.column("part"), lists], ["id", "toxic", "part", "x"])

    return run


def _lexicon(hashes: np.ndarray, toxic: np.ndarray, clean: np.ndarray, sizes: tuple[int, int], max_terms: int, least: int) -> Lexicon:
    odds = np.log((toxic + 0.5) / (sizes[0] + 1)) - np.log((clean + 0.5) / (sizes[1] + 1))
    good = np.flatnonzero((odds > 2.5) & (toxic >= least))
    good = good[np.lexsort((hashes[good], -odds[good] * np.sqrt(toxic[good])))][:max_terms]
    return Lexicon(hashes[good], odds[good])


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 20_000, max_terms: int = 4_000, least: int = 3) -> Model:
    """A model from a bounded sample of labelled documents; without both classes in every fold it scores everything with their share."""
    sample = labelled_sample(docs, labels, doc_id=doc_id, text=text, label=label, max_rows=max_rows)
    by_part = np.zeros((FOLDS, 2), np.int64)
    for r in sample.groupBy("part", "toxic").count().collect():
        by_part[r.part, r.toxic] = r["count"]
    good, bad = by_part.sum(0)
    base = (bad + 1) / (bad + good + 2)
    kinds = ("toxic", "clean")
    counts = sample.select("part", "text", "toxic").mapInArrow(_count_tokens, "part int, h long, toxic long, clean long")
    counts = counts.groupBy("h").agg(*[F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in kinds])
    total = {c: sum((F.col(f"{c}{k}") for k in range(1, FOLDS)), F.col(f"{c}0")) for c in kinds}
    odds = F.log((total["toxic"] + 0.5) / float(bad + 1)) - F.log((total["clean"] + 0.5) / float(good + 1))
    terms = counts.where((total["toxic"] >= least) & (odds > 1)).orderBy((odds * F.sqrt(total["toxic"])).desc(), "h").limit(4 * max_terms).toArrow()
    hashes = terms["h"].to_numpy().view(U64)
    each = {c: np.stack([terms[f"{c}{k}"].to_numpy() for k in range(FOLDS)]) for c in kinds}
    of = lambda parts: _lexicon(hashes, each["toxic"][parts].sum(0), each["clean"][parts].sum(0), tuple(by_part[parts].sum(0)[::-1].tolist()), max_terms, least)
    lexicons = [of([j for j in range(FOLDS) if j != k]) for k in range(FOLDS)]
    lexicon = of(list(range(FOLDS)))
    if (by_part == 0).any():
        return Model(lexicon, None, None, base)
    rows = sample.mapInArrow(_features(lexicons), "id string, toxic int, part int, x array<double>").orderBy("id").toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    y, part = rows["toxic"].to_numpy(), rows["part"].to_numpy()
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        margin[part == k] = BoostedTrees().fit(x[part != k], y[part != k]).margin(x[part == k])
    return Model(lexicon, BoostedTrees().fit(x, y), Isotonic().fit(margin, y), base)


def _score(sent, row_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in pieces(batches, "text", 1 << 19):
            yield pa.RecordBatch.from_arrays([batch.column("row").cast(row_type), batch.column("text").cast(pa.string()), pa.array(model.score(batch.column("text")))], ["row", "text", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 20_000) -> DataFrame:
    """Each document as ``row`` (struct of its other columns), ``text`` and ``score`` from 0 to 1.

    The model is fitted on at most ``max_rows`` labelled rows whose ids' checksum isn't a multiple of five.
    Labels that are null or neither 0 nor 1, or whose id is null, are left out; an id with both labels counts
    as toxic. Null texts score like empty ones. Repeated rows each give a row; without documents there are
    no rows, and without labels of both kinds all scores are the share of toxic labels. Other columns are
    only carried: neither ids nor sources are inputs of a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id=doc_id, text=text, label=label, max_rows=max_rows))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others).alias("row"), F.col(text).cast("string").alias("text"))
    row_type = packed.select("row").limit(0).toArrow().schema.field("row").type
    return packed.mapInArrow(_score(model, row_type), StructType([packed.schema["row"], StructField("text", StringType()), StructField("score", DoubleType())]))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the labels outside the held-out fold."""
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    doc_id = F.col("row.doc_id")
    return out.select(doc_id, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
