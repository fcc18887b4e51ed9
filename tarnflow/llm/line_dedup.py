"""Cross-site boilerplate lines, found by how many distinct sites carry them.

HyperLogLog sketches of the sites of each line merge by aggregation. Lines whose estimate is
near the threshold are counted again, exactly; the rest are decided by the estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tarnflow.llm.jaccard_join import jaccard_components
from tarnflow.llm.storage import cut
from tarnflow.llm.textbytes import NOT_SPACE, U64, Lookup, byte_prefix, pieces, text_bytes


class Lines:
    """All lines of a batch of texts in order: row ``doc``, bytes ``begin``/``end``, ``size`` and ``hash`` without white space at the ends."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        breaks = np.flatnonzero(raw == 10)
        doc = np.concatenate((np.arange(len(offs) - 1), np.searchsorted(offs, breaks, "right") - 1))
        begin = np.concatenate((offs[:-1], breaks + 1))
        order = np.lexsort((begin, doc))
        self.doc, self.begin = doc[order], begin[order]
        last = np.append(self.doc[1:] != self.doc[:-1], True)
        self.end = np.where(last, offs[self.doc + 1], np.append(self.begin[1:], 0) - 1)
        solid = np.flatnonzero(NOT_SPACE[raw])
        lo, hi = np.searchsorted(solid, self.begin), np.searchsorted(solid, self.end)
        solid = np.append(solid, 0)
        blank = lo >= hi
        first = np.where(blank, self.begin, solid[lo])
        last = np.where(blank, self.begin, solid[np.maximum(hi, 1) - 1] + 1)
        self.size = last - first
        self.hash = byte_prefix(raw).hash(first, last)
        self.n = np.bincount(self.doc, minlength=len(offs) - 1)


def _line_sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        lines = Lines(*text_bytes(batch.column("text")))
        kept = np.flatnonzero(lines.size)
        sites = batch.column("site").dictionary_encode()
        code = np.asarray(sites.indices.fill_null(-1))[lines.doc[kept]]
        h = lines.hash[kept]
        order = np.lexsort((code, h))
        h, code = h[order], code[order]
        new = np.append(True, (h[1:] != h[:-1]) | (code[1:] != code[:-1])) if len(h) else np.zeros(0, bool)
        new &= code >= 0
        yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), sites.dictionary.take(pa.array(code[new]))], ["h", "site"])


def spread_lines(docs: DataFrame, *, text: str = "text", site: str = "source", min_sites: int = 10, lg_k: int = 12) -> DataFrame:
    """Hashes ``h`` of the non-blank lines that at least ``min_sites`` distinct sites carry; rows with a null site don't count."""
    source = docs.select(F.col(text).cast("string").alias("text"), F.col(site).cast("string").alias("site")).where("text is not null and site is not null")
    pairs = cut(source.mapInArrow(_line_sites, "h long, site string"), "line-sites")
    sketches = pairs.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("s"))
    margin = 6 * 1.04 / 2 ** (lg_k / 2)
    counted = sketches.select("h", F.hll_sketch_estimate("s").alias("n")).where(F.col("n") >= min_sites * (1 - margin) - 1)
    counted = cut(counted, "line-spread")
    sure = counted.where(F.col("n") > min_sites * (1 + margin) + 1).select("h")
    near = counted.where(F.col("n") <= min_sites * (1 + margin) + 1).select("h")
    exact = pairs.join(near, "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites).select("h")
    return cut(sure.union(exact), "spread-lines")


def _sent(lookup_of):
    """Batches with their lines and those to drop, which are on a list sent to the executors."""

    def run(batches: Iterator[pa.RecordBatch]):
        lookup = lookup_of()
        for batch in pieces(batches, "text"):
            raw, offs = text_bytes(batch.column("text"))
            lines = Lines(raw, offs)
            drop = np.zeros(len(lines.doc), bool)
            drop[lookup.find(lines.hash)[0]] = True
            drop &= lines.size > 0
            yield batch, raw, offs, lines, drop

    return run


def _listed(batches: Iterator[pa.RecordBatch]):
    """The same where the numbers of the lines to drop are in the column ``own``."""
    for batch in pieces(batches, "text"):
        raw, offs = text_bytes(batch.column("text"))
        lines = Lines(raw, offs)
        first = np.concatenate(([0], np.cumsum(lines.n)))
        drop = np.zeros(len(lines.doc), bool)
        for row, own in enumerate(batch.column("own").to_pylist()):
            drop[first[row] + np.asarray(own or [], np.int64)] = True
        yield batch, raw, offs, lines, drop


def _over_share(lines: Lines, drop: np.ndarray, n: int, max_share: float) -> np.ndarray:
    """Which of ``n`` texts have more than ``max_share`` of their bytes in lines to drop."""
    return np.bincount(lines.doc, lines.size * drop, n) > max_share * np.bincount(lines.doc, lines.size, n)


def _over(marked, max_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, lines, drop in marked(batches):
            at = pa.array(np.flatnonzero(_over_share(lines, drop, batch.num_rows, max_share)))
            yield pa.RecordBatch.from_arrays([batch.column("h").take(at), batch.column("text").take(at).cast(pa.string())], ["h", "text"])

    return run


def _remove(marked, copies_of, max_share: float, row_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = copies_of()
        for batch, raw, offs, lines, drop in marked(batches):
            exempt = _over_share(lines, drop, batch.num_rows, max_share)
            if copies is not None:
                exempt &= copies(batch)
            yield _without(batch, raw, lines, drop & ~exempt[lines.doc], row_type)

    return run


def _in_sent(sent):
    def of():
        lookup = Lookup(sent.value)

        def mask(batch: pa.RecordBatch) -> np.ndarray:
            found = np.zeros(batch.num_rows, bool)
            found[lookup.find(batch.column("h").to_numpy().view(U64))[0]] = True
            return found

        return mask

    return of


def _in_column():
    return lambda batch: np.asarray(batch.column("copy").fill_null(False).to_numpy(zero_copy_only=False), bool)


def _without(batch: pa.RecordBatch, raw, lines: Lines, drop: np.ndarray, row_type: pa.DataType) -> pa.RecordBatch:
    """The batch with the lines of ``drop`` taken out of its texts."""
    removed = np.bincount(lines.doc[drop], minlength=batch.num_rows)
    column = batch.column("text")
    texts = column.to_pylist() if removed.any() else None
    if texts is not None:
        first = np.concatenate(([0], np.cumsum(lines.n)))
        for i in np.flatnonzero(removed):
            own = np.arange(first[i], first[i + 1])
            own = own[~drop[own]]
            texts[i] = b"\n".join(raw[lines.begin[k] : lines.end[k]].tobytes() for k in own).decode()
        column = pa.array(texts, pa.string())
    return pa.RecordBatch.from_arrays([batch.column("row").cast(row_type), column.cast(pa.string()), pa.array(lines.n, pa.int64()), pa.array(removed, pa.int64())], ["row", "text", "n_lines", "n_removed"])


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        lines = Lines(*text_bytes(batch.column("text")))
        at = np.flatnonzero(lines.size)
        first = np.concatenate(([0], np.cumsum(lines.n)))
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(lines.doc[at])), pa.array(at - first[lines.doc[at]]), pa.array(lines.hash[at].view(np.int64))], ["key", "i", "h"])


def _copies(over: DataFrame, words_each: int, similarity: tuple[int, int]) -> DataFrame:
    """Hashes ``h`` of those texts that another row has too, or that are near duplicates of another one."""
    texts = cut(over.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text")), "over-texts")
    if texts.isEmpty():
        return texts.select("h")
    linked = jaccard_components(texts, doc_id="h", words_each=words_each, threshold=similarity).where("id <> component")
    linked = cut(linked.select(F.explode(F.array("id", "component")).alias("h")), "near-copies")
    return cut(texts.where("n > 1").select("h").union(linked).distinct(), "copies")


def remove_spread_lines(
    docs: DataFrame, *, text: str = "text", site: str = "source", min_sites: int = 10, max_share: float = 0.5, lg_k: int = 12, max_sent_lines: int = 4_000_000, similarity: tuple[int, int] | None = None, words_each: int = 5
) -> DataFrame:
    """Each document as ``row`` (struct of its other columns), ``text`` without cross-site lines, ``n_lines``, ``n_removed``.

    A line is what stands between line feeds; white space at its ends doesn't count when lines are
    compared. A document of which such lines hold more than ``max_share`` of the bytes may be a copy rather
    than a page with boilerplate. With ``similarity`` it stays as it is, for a near-duplicate operator to
    judge, only if it is shown to be one: another row has the same text, or runs of ``words_each`` words
    link it (as in ``jaccard_components`` at ``similarity``) to another document over that share. Without
    ``similarity`` every document over the share stays as it is. Null text
    stays null and counts as one blank line; rows with a null site add no site but lose lines too;
    repeated rows each give a row; empty tables give none. Other columns are only carried.

    Up to ``max_sent_lines`` hashes of such lines, and of copies (8 bytes each), are sent to every executor.
    Beyond, they are joined to the lines of the texts, or to the texts, by a shuffle.
    """
    spark = docs.sparkSession
    spread = spread_lines(docs, text=text, site=site, min_sites=min_sites, lg_k=lg_k)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others).alias("row"), F.col(text).cast("string").alias("text"))
    schema = StructType([packed.schema["row"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    row_type = packed.select("row").limit(0).toArrow().schema.field("row").type
    packed = packed.withColumn("h", F.xxhash64("text"))
    head = spread.limit(max_sent_lines + 1).toArrow()
    if head.num_rows <= max_sent_lines:
        sent = spark.sparkContext.broadcast(head["h"].to_numpy().view(U64))
        marked = _sent(lambda: Lookup(sent.value))
    else:
        keyed = packed.withColumn("key", F.sha2("text", 256))
        rows = keyed.where("text is not null").groupBy("key").agg(F.first("text").alias("text")).mapInArrow(_line_rows, "key string, i long, h long")
        own = rows.join(spread, "h", "left_semi").groupBy("key").agg(F.collect_set("i").alias("own"))
        packed, marked = keyed.join(own, "key", "left").select("row", "text", "h", "own"), _listed
    copies_of = lambda: None
    if similarity:
        copies = _copies(packed.drop("row").mapInArrow(_over(marked, max_share), "h long, text string"), words_each, similarity)
        found = copies.limit(max_sent_lines + 1).toArrow()
        if found.num_rows <= max_sent_lines:
            copies_of = _in_sent(spark.sparkContext.broadcast(found["h"].to_numpy().view(U64)))
        else:
            packed, copies_of = packed.join(copies.withColumn("copy", F.lit(True)), "h", "left"), _in_column
    return packed.mapInArrow(_remove(marked, copies_of, max_share, row_type), schema)


#: Near duplicates by runs of five words, as the pipeline's next stage joins them.
COPY_SIMILARITY = (80, 100)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without lines of ten sites or more, but for documents shown to be copies."""
    out = remove_spread_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), similarity=COPY_SIMILARITY)
    return out.select("row.doc_id", "n_lines", "n_removed", "text")


ORACLE_OP9 = r"""
WITH d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, i, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
spread AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
f AS (SELECT l.*, spread.k IS NOT NULL AS hit FROM l LEFT JOIN spread USING (k)),
o AS (SELECT text, count(*) AS n FROM d WHERE doc_id IN (SELECT doc_id FROM f GROUP BY doc_id HAVING sum(CASE WHEN hit THEN strlen(k) ELSE 0 END) > 0.5 * sum(strlen(k))) GROUP BY text),
w AS (SELECT text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM o),
g AS (SELECT DISTINCT text, array_to_string(ws[s : s + 4], ' ') AS sh FROM w, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS u(s) WHERE len(ws) > 0),
z AS (SELECT text, count(*) AS n FROM g GROUP BY text),
p AS (SELECT a.text AS x, b.text AS y, count(*) AS shared FROM g a JOIN g b ON a.sh = b.sh AND a.text <> b.text GROUP BY ALL),
copies AS (SELECT text FROM o WHERE n > 1 UNION SELECT x FROM p JOIN z ON z.text = x JOIN z AS q ON q.text = y WHERE 100 * shared >= 80 * (z.n + q.n - shared)),
c AS (SELECT doc_id FROM d WHERE text IN (SELECT text FROM copies))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit AND doc_id NOT IN (FROM c)) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (hit AND doc_id NOT IN (FROM c))), '') AS text
FROM f GROUP BY doc_id
"""
