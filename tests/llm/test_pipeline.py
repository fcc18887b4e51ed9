"""Stages of the pipeline against brute force on the smallest tables, and the whole run."""

import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F
from test_operators import brute_jaccard, brute_leaks

import corpus_pipeline
from tarnflow.llm import queries, stages, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", "en", "src1", 0), (9002, "", "en", "src1", 0), (None, "some text", None, "src2", 9)], table.schema)
    return table.unionByName(extra).withColumn("row", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("h", F.lit(2))


def rows(df):
    return df.collect()


def test_stages_keep_columns_and_empty_tables(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert stages.mixing(spark, docs.limit(0), SF).count() == 0


def test_toxicity_stage(spark, docs):
    scored = {(r.row.doc_id, r.text): r.score for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = collections.Counter((r.doc_id, r.text) for r in rows(stages.toxicity(spark, docs, SF)))
    assert kept == collections.Counter((r.doc_id, r.text) for r in rows(docs) if scored[r.doc_id, r.text] < 0.5)


def brute_lines(before):
    """Texts without lines of ten sites, but for texts shown to be copies among those that are mostly such lines."""
    sites = collections.defaultdict(set)
    trim = " \t\r\v\f"
    for r in before:
        for line in (r.text or "").split("\n"):
            if line.strip(trim) and r.source:
                sites[line.strip(trim)].add(r.source)
    spread = {x for x, s in sites.items() if len(s) >= 10}

    def spread_in(text):
        return [x.strip(trim) in spread for x in text.split("\n")]

    def over(text):
        keys = [x.strip(trim).encode() for x in text.split("\n")]
        return sum(len(k) for k, b in zip(keys, spread_in(text), strict=True) if b) > 0.5 * sum(map(len, keys))

    texts = collections.Counter(r.text for r in before if r.text is not None and over(r.text))
    numbered = list(enumerate(texts))
    near = {k: c for k, _, c in brute_jaccard(numbered, 5, 80, 100)}
    grouped = collections.Counter(near.values())
    copies = {t for k, t in numbered if texts[t] > 1 or grouped[near[k]] > 1}
    return [r.text if r.text is None or r.text in copies else "\n".join(x for x, bad in zip(r.text.split("\n"), spread_in(r.text), strict=True) if not bad) for r in before]


def test_line_stage(spark, docs):
    before = rows(docs)
    got = collections.Counter((r.doc_id, r.text, r.n_chars) for r in rows(stages.line_dedup(spark, docs, SF)))
    assert got == collections.Counter((r.doc_id, t, None if t is None else len(t)) for r, t in zip(before, brute_lines(before), strict=True))


def test_near_duplicate_stage(spark, docs):
    before = [(r.doc_id, r.text) for r in rows(docs)]
    keep = {i for i, _, c in brute_jaccard(before, 5, 80, 100) if i == c and i is not None}
    got = rows(stages.ngram_jaccard(spark, docs, SF))
    assert collections.Counter(r.doc_id for r in got) == collections.Counter([*keep, None])


def test_one_id_with_two_texts(spark, docs):
    """Each text of an id is a document of its own; repeated rows of one are one."""
    words = [[f"w{k}x{i}" for i in range(40)] for k in range(4)]
    texts = [(1, " ".join(words[0])), (1, " ".join(words[1])), (1, " ".join(words[1])), (2, " ".join(words[1])), (3, " ".join(words[2])), (3, None), (3, ""), (4, " ".join(words[0][:39]))]
    df = spark.createDataFrame([(i, t, "en", "s", 0, f"a{n}") for n, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, id string")
    got = sorted(((r.doc_id, r.text) for r in rows(stages.ngram_jaccard(spark, df, SF))), key=str)
    assert got == sorted([texts[0], texts[1], texts[4], (3, None), (3, "")], key=str)


def test_decontamination_stage(spark, docs):
    before = [(r.doc_id, r.text) for r in rows(docs)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [i for i, _, hit, _ in brute_leaks(before, items) if not hit]
    got = [r.doc_id for r in rows(stages.decontamination(spark, docs, SF))]
    assert collections.Counter(got) == collections.Counter(clean) and len(clean) < len(before)


def brute_mix(before):
    """How often each id is drawn from ``(doc_id, text, source)``."""
    n = collections.Counter(source for _, _, source in before)
    total = sum(k**0.5 for k in n.values())
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()

    def draw(u, mean):
        p = c = math.exp(-mean)
        k = 0
        while c <= u:
            k += 1
            p *= mean / k
            c += p
        return k

    expected = collections.Counter()
    for i, text, source in before:
        u = int(md5(f"17|{'' if i is None else i}|{md5(text or '')}|1")[:13], 16) / 16**13
        expected[i] += draw(u, len(before) * n[source] ** 0.5 / total / n[source])
    return +expected


def test_mixing_stage(spark, docs):
    expected = brute_mix([(r.doc_id, r.text, r.source) for r in rows(docs)])
    assert collections.Counter(r.doc_id for r in rows(stages.mixing(spark, docs, SF))) == expected


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
def test_run(spark, sf_dir):
    """The whole run against brute force of each stage on what the one before kept; scores are the operator's own."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = {r.row.doc_id: r.score for r in toxicity.toxicity(table, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    kept = [r for r in table.collect() if scored[r.doc_id] < 0.5]
    texts = {r.doc_id: t for r, t in zip(kept, brute_lines(kept), strict=True)}
    alone = {i for i, _, c in brute_jaccard(list(texts.items()), 5, 80, 100) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in brute_leaks([x for x in texts.items() if x[0] in alone], items) if not hit}
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"} == set(out.columns)
    got = rows(out)
    assert collections.Counter(r.doc_id for r in got) == brute_mix([(r.doc_id, texts[r.doc_id], r.source) for r in kept if r.doc_id in clean])
    assert all(r.text == texts[r.doc_id] for r in got) and len(clean) < len(alone) < len(kept) <= len(scored)


def test_toxicity_of_held_out_labels(spark):
    """Rank and precision on the labelled documents that the fit never saw; smaller tables hold too few of them."""
    sf_dir = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic is not None}
    held = [(r.score, r.predicted, toxic[r.doc_id]) for r in rows(queries.QUERIES["op7_toxicity"](spark, sf_dir)) if r.held_out and r.doc_id in toxic]
    bad, good = [x for x in held if x[2]], [x for x in held if not x[2]]
    assert bad and good
    above = sum((a[0] > b[0]) + (a[0] == b[0]) / 2 for a in bad for b in good) / len(bad) / len(good)
    assert above > 0.98
    assert sum(x[1] for x in good) <= 0.01 * len(good) and sum(x[1] for x in bad) >= 0.9 * len(bad)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_the_smallest_tables(spark, name):
    table = {"op1": "embeddings", "op2": "pages", "op3": "pages"}.get(name.split("_")[0], "documents")
    n = queries.QUERIES[name](spark, SF).count()
    if name.startswith("op8"):
        assert n == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
    elif not name.startswith("op10"):
        assert n == spark.read.parquet(f"{SF}/{table}.parquet").count()
