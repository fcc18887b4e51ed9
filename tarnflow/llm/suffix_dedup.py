"""Exact removal of long repeated byte strings, by threshold-bounded interval expansion on a BWT.

Every string of ``least`` bytes names one anchor in itself: its smallest gram hash. The starts that share an
anchor form a segment, so equal strings lie in segments with equal anchors. Equal segments are one
class, repeated as a whole if it has two members. Where segments with one anchor differ, their texts meet
in a Burrows-Wheeler transform; intervals of growing strings, extended backwards breadth first, give its
common prefixes in increasing order up to ``least``, and what is left unset is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tarnflow.llm.grouping import dealt, grouped
from tarnflow.llm.storage import cut, discard
from tarnflow.llm.textbytes import U64, byte_prefix, pieces, sliding_min, text_bytes

#: Starts handled at a time, and the bits that hold a place among them.
_STARTS, _PLACE = 1 << 22, 23


def segments(raw: np.ndarray, offs: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run of starts with one anchor: row, first start, number of starts, hashes of the anchor and of the run's bytes, and of the bytes beside it.

    Equal strings around an anchor agree in at least half of what ``least`` leaves beside the anchor, on its left
    or on its right. The last hash has 32 bits for each side, 0 where a run has fewer bytes than that there.
    """
    prefix = byte_prefix(raw)
    width = least - gram + 1
    out = []
    for lo in range(0, max(0, len(raw) - least + 1), _STARTS):
        hi = min(len(raw) - least + 1, lo + _STARTS)
        at = np.arange(lo, hi + width - 1)
        grams = prefix.hash(at, at + gram)
        place = np.arange(len(at), dtype=U64)
        low = sliding_min(grams >> U64(_PLACE) << U64(_PLACE) | place, width)
        anchor = (low & U64((1 << _PLACE) - 1)).astype(np.int64)
        start = np.arange(lo, hi)
        doc = np.searchsorted(offs, start, "right") - 1
        fits = start + least <= offs[doc + 1]
        start, doc, anchor = start[fits], doc[fits], anchor[fits]
        if len(start):
            new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
            n = np.diff(np.append(new, len(start)))
            first = start[new]
            end = first + n + least - 1
            mid, side = lo + anchor[new], -(-(least - gram) // 2)
            left, right = np.maximum(first, mid - side), np.minimum(end, mid + gram + side)
            left = np.where(mid - left == side, prefix.hash(left, mid), 0).astype(U64)
            right = np.where(right - mid - gram == side, prefix.hash(mid + gram, right), 0).astype(U64)
            half = U64(32)
            out.append((doc[new], first, n, grams[anchor[new]], prefix.hash(first, end), left >> half << half | right >> half))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, *[none.astype(U64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _segment_rows(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 19):
            raw, offs = text_bytes(batch.column("text"))
            doc, start, n, *hashes = segments(raw, offs, least, gram)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(pa.array(doc)) for k in ("k1", "k2")], pa.array(start - offs[doc]), pa.array(n, pa.int32()), *[pa.array(h.view(np.int64)) for h in hashes]],
                ["k1", "k2", "start", "n", "anchor", "seg", "sides"],
            )

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of the strings of at least ``depth`` symbols from there, by prefix doubling."""
    size, base = len(text), int(text.max()) + 2
    have = max(1, int(62 / np.log2(base)))  # so many symbols fit in a first key
    key = np.zeros(size, np.int64)
    for k in range(have):
        key *= base
        key[: max(0, size - k)] += text[k:] + 1
    while True:
        order = np.argsort(key)
        ranked = key[order]
        steps = np.append(0, np.cumsum(ranked[1:] != ranked[:-1]))
        if have >= depth or steps[-1] == size - 1:
            return order
        rank = np.empty(size, np.int64)
        rank[order] = steps + 1
        key = rank * (size + 2)
        key[: max(0, size - have)] += rank[have:]
        have *= 2


def repeated_starts(parts: list[bytes], least: int) -> list[np.ndarray]:
    """Starts in each part of strings of ``least`` bytes that start anywhere else in the parts too.

    Common prefixes below ``least`` are set in increasing order (Beller and others' interval queue on the
    transform); the entries that are left belong to repeats.
    """
    raw = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    symbols, coded = np.unique(raw, return_inverse=True)
    sigma, many = len(symbols), len(parts)
    total = len(raw) + many
    ends = np.cumsum(sizes + 1) - 1
    text = np.empty(total, np.int64)
    text[ends] = sigma + np.arange(many)  # every part ends in a symbol of its own
    inside = np.ones(total, bool)
    inside[ends] = False
    text[inside] = coded
    order = suffix_order(text, least + 1)
    bwt = text[order - 1]
    counts = np.bincount(coded, minlength=sigma)
    before = np.concatenate(([0], np.cumsum(counts)[:-1]))
    seen = np.zeros((total + 1, sigma), np.int32)  # how often each symbol stands before a place of the transform
    real = np.flatnonzero(bwt < sigma)
    seen[real + 1, bwt[real]] = 1
    np.cumsum(seen, 0, out=seen)

    common = np.full(total + 1, -1)
    common[0] = 0
    common[len(raw) :] = 0
    lo = np.concatenate((before, len(raw) + np.arange(many)))
    hi = np.concatenate((before + counts, len(raw) + np.arange(many) + 1))
    common[hi] = 0
    for length in range(1, least):
        alone = hi - lo == 1
        at = lo[alone]  # an interval of one place is extended by the one symbol before it
        symbol = bwt[at]
        at, symbol = at[symbol < sigma], symbol[symbol < sigma]
        single = before[symbol] + seen[at, symbol]
        below, above = seen[lo[~alone]], seen[hi[~alone]]
        which, symbol = np.nonzero(above > below)
        new_lo = np.concatenate((single, before[symbol] + below[which, symbol]))
        new_hi = np.concatenate((single + 1, before[symbol] + above[which, symbol]))
        unset = common[new_hi] < 0
        lo, hi = new_lo[unset], new_hi[unset]
        if not len(lo):
            break
        common[hi] = length
    longer = common < 0
    hit = np.zeros(total, bool)
    hit[order[longer[:-1] | np.append(longer[1:-1], False)]] = True
    out, at = [], 0
    for size in sizes.tolist():
        out.append(np.flatnonzero(hit[at : at + size]))
        at += size + 1
    return out


def _ranges(starts: np.ndarray) -> list[dict[str, int]]:
    """Runs of consecutive starts as first and last."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.append(True, np.diff(starts) > 1))
    return [{"a": int(a), "b": int(b)} for a, b in zip(starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)], strict=True)]


_RANGES = "array<struct<a:int,b:int>>"
_RANGES_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _expand(least: int, most: int = 96 << 10):
    """Repeats within groups of one anchor; small groups share a transform, which finds no more than true repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        held = 0

        def flush():
            found = repeated_starts([x[2] for x in rows], least)
            keep = [(r[0], r[1], _ranges(f)) for r, f in zip(rows, found, strict=True) if len(f)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in keep], pa.int64()), pa.array([x[1] for x in keep], pa.int64()), pa.array([x[2] for x in keep], _RANGES_ARROW)], ["anchor", "seg", "ranges"])

        for group in grouped(batches, ["anchor"]):
            seg, first = np.unique(group.column("seg").to_numpy(), return_index=True)
            own = group.take(pa.array(first))
            size = int(np.sum([len(x) for x in own.column("bytes").to_pylist()]))
            if rows and held + size > most:
                yield flush()
                held = 0
            rows += zip(own.column("anchor").to_pylist(), seg.tolist(), own.column("bytes").to_pylist(), strict=True)
            held += size
        if rows:
            yield flush()

    return run


def _cut_out(least: int):
    """The bytes of the segments that are asked for, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            raw, offs = text_bytes(batch.column("text"))
            anchors, segs, data, blocks = [], [], [], []
            for base, wanted in zip(offs[:-1].tolist(), batch.column("wanted").to_pylist(), strict=True):
                for x in wanted:
                    lo = base + x["start"]
                    anchors.append(x["anchor"])
                    segs.append(x["seg"])
                    blocks.append(x["large"])
                    data.append(raw[lo : lo + x["n"] + least - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(segs, pa.int64()), pa.array(blocks, pa.bool_()), pa.array(data, pa.binary())], ["anchor", "seg", "large", "bytes"])

    return run


def _windows(least: int):
    """Every string of ``least`` bytes of a segment by hash, for anchors with too many segments for a transform."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data = part.column("bytes").to_pylist()
                sizes = np.array([len(x) for x in data])
                n = sizes - least + 1
                base = np.repeat(np.cumsum(sizes) - sizes, n)
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h = byte_prefix(np.frombuffer(b"".join(data), np.uint8)).hash(base + off, base + off + least)
                row = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([part.column("anchor").take(row), part.column("seg").take(row), pa.array(off, pa.int32()), pa.array(h.view(np.int64))], ["anchor", "seg", "off", "h"])

    return run


def _join_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [_ranges(np.unique(np.asarray(x))) for x in batch.column("offs").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("seg"), pa.array(lists, _RANGES_ARROW)], ["anchor", "seg", "ranges"])


def _strip(least: int, row_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            raw, offs = text_bytes(batch.column("text"))
            size, removed, runs, kept, left = [], [], [], [], []
            for lo, hi, spans in zip(offs[:-1].tolist(), offs[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
                own = raw[lo:hi]
                if spans:
                    a = np.array([x["a"] for x in spans])
                    b = np.array([x["b"] for x in spans]) + least
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.append(True, a[1:] > b[:-1])
                    a, b = a[new], np.append(b[:-1][new[1:]], b[-1])
                    mask = np.zeros(len(own) + 1, np.int8)
                    mask[a] += 1
                    mask[b] -= 1
                    own = own[np.cumsum(mask[:-1]) == 0]
                    runs.append(len(a))
                else:
                    runs.append(0)
                size.append(hi - lo)
                removed.append(hi - lo - len(own))
                data = own.tobytes()
                kept.append(hashlib.sha256(data).hexdigest())
                left.append(data)
            yield pa.RecordBatch.from_arrays([batch.column("row").cast(row_type), *[pa.array(x, pa.int64()) for x in (size, removed, runs)], pa.array(kept, pa.string()), pa.array(left, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 400, gram: int = 100, block: int = 256) -> DataFrame:
    """Each document as ``row`` (struct of its other columns), ``n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (binary).

    Bytes that a string of ``least`` bytes covers go if it starts anywhere else, in the same text or another;
    overlaps count and strings are judged on the input. Matches don't cross texts. What is kept may be cut
    within a character, so it is binary. Null texts are empty. Repeated rows each give a row and repeat each
    other; documents are told apart by id and a 64-bit hash of their
    text; a null id is an id like others; empty tables give no rows; other columns are only carried.

    An anchor with more than ``block`` different segments would make a transform too large for one task: its
    strings are counted one by one instead, by hash, combined before the shuffle.
    """
    if not 0 < gram <= least:
        raise ValueError("gram must be between 1 and least")
    kind = docs.schema[doc_id].dataType.typeName()
    k1 = F.col(doc_id).cast("long") if kind in ("byte", "short", "integer", "long") else F.xxhash64(F.lit(2), F.col(doc_id))
    keys = [F.coalesce(k1, F.lit(-(1 << 63))).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others).alias("row"), F.col(text).cast("string").alias("text"), *keys)
    texts = packed.select("k1", "k2", "text").where(F.octet_length("text") >= least)
    runs = cut(texts.mapInArrow(_segment_rows(least, gram), "k1 long, k2 long, start long, n int, anchor long, seg long, sides long"), "segments")

    firsts = [F.first(c).alias(c) for c in ("k1", "k2", "start", "n", "sides")]  # all of one row, which the table then fixes
    classes = cut(runs.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("copies"), *firsts), "segment-classes")
    # Nothing is to be found under an anchor with one class, or with repeated ones only.
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 and fewest = 1").select("anchor")
    several = cut(classes.join(several, "anchor", "left_semi"), "segment-kinds")
    # Classes with one anchor and equal bytes on one side of it may hold equal strings.
    halves = F.array(F.struct(F.lit(0).alias("side"), F.shiftright("sides", 32).alias("h")), F.struct(F.lit(1).alias("side"), F.col("sides").bitwiseAND(0xFFFFFFFF).alias("h")))
    beside = several.select("anchor", "seg", "copies", F.inline(halves)).where("h <> 0")
    alike = beside.groupBy("anchor", "side", "h").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 and fewest = 1")
    near = cut(beside.join(alike.select("anchor", "side", "h"), ["anchor", "side", "h"], "left_semi").select("anchor", "seg").distinct(), "near-classes")
    met = near.join(near.groupBy("anchor").agg((F.count(F.lit(1)) > block).alias("large")), "anchor")
    unclear = several.join(met, ["anchor", "seg"]).select("k1", "k2", F.struct("anchor", "seg", "start", "n", "large").alias("x"))
    wanted = unclear.groupBy("k1", "k2").agg(F.collect_list("x").alias("wanted"))  # no more than a text has segments
    found = texts.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(_cut_out(least), "anchor long, seg long, large boolean, bytes binary")
    found = cut(found, "segment-bytes")

    some = dealt(found.where("not large").select("anchor", "seg", "bytes"), "anchor").mapInArrow(_expand(least), f"anchor long, seg long, ranges {_RANGES}")
    strings = cut(found.where("large").dropDuplicates(["anchor", "seg"]).mapInArrow(_windows(least), "anchor long, seg long, off int, h long"), "segment-strings")
    twice = strings.groupBy("anchor", "h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("anchor", "h")
    listed = strings.join(twice, ["anchor", "h"]).groupBy("anchor", "seg").agg(F.collect_set("off").alias("offs"))  # at most least - gram + 1 each
    many = listed.mapInArrow(_join_ranges, f"anchor long, seg long, ranges {_RANGES}")
    whole = classes.where("copies > 1").select("anchor", "seg", F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))).alias("ranges"))
    covered = cut(whole.unionByName(some.unionByName(many).join(whole, ["anchor", "seg"], "left_anti")), "covered")
    discard(classes, several, near, found, strings)

    spans = runs.join(covered, ["anchor", "seg"]).select("k1", "k2", "start", F.explode("ranges").alias("r"))
    spans = spans.select("k1", "k2", F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b")).alias("s")).groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))
    row_type = packed.select("row").limit(0).toArrow().schema.field("row").type
    schema = StructType([packed.schema["row"], *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")], StructField("kept_sha256", StringType()), StructField("kept", BinaryType())])
    return packed.join(spans, ["k1", "k2"], "left").select("row", "text", "spans").mapInArrow(_strip(least, row_type), schema)


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with what repeats of 400 bytes take from them, as the contract has it."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
