"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import chat_formatting as chat
from tarnflow.llm import decontamination as leaks
from tarnflow.llm import embedding_dedup, html_extraction, jaccard_join, line_dedup, source_mixing, suffix_dedup, toxicity, url_filter
from tarnflow.llm.components import connected_components
from tarnflow.llm.grouping import smallest_reachable

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, `key` string, h int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y", 1) for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def odd_docs(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(words, 400))
    near = text.split()
    near[200] = "changed"
    rows = [(1, text, "a"), (2, text, "b"), (2, text, "b"), (3, " ".join(near), "c"), (4, None, "a"), (5, "", None), (6, "one", "a"), (7, "one", "b"), (None, text, "a"), (8, "zz " * 30_000, "a"), (9, " ".join(rng.choice(words, 30)), None)]
    return docs_frame(spark, rows)


def empty(df):
    return df.limit(0)


@pytest.mark.parametrize("few", [400_000, 0, 150])
def test_components_match_brute_force(spark, few):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*pairs, (None, 4), (7, 7)], "a long, b long"), few).collect()}
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    a, b = np.array([(at[x], at[y]) for x, y in pairs if x != y]).T
    assert got == {x: nodes[k] for x, k in zip(nodes, smallest_reachable(len(nodes), a, b), strict=True)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_find_planted_pairs(spark):
    """Recall over pairs just above the threshold, in a crowd of unlike vectors; no pair below it links."""
    rng = np.random.default_rng(23)
    one = rng.standard_normal((1500, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    side = rng.standard_normal(one.shape)
    side -= (side * one).sum(1, keepdims=True) * one
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9005, 0.93, 1500)
    cosine[1200:] = rng.uniform(0.86, 0.8995, 300)  # these must not link
    two = cosine[:, None] * one + np.sqrt(1 - cosine**2)[:, None] * side
    crowd = rng.standard_normal((2000, 64))
    vectors = np.concatenate((one, two, crowd))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component) for r in embedding_dedup.near_duplicates(df).collect()}
    found = sum(got[1500 + k] == (1, k) and got[k] == (1, k) for k in range(1200))
    assert found >= 1180
    assert all(got[i] == (0, i) for i in [*range(1200, 1500), *range(2700, 5000)])


def brute_vectors(vectors):
    ok = {i: np.array(v, float) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.9]
    n = collections.Counter(x for p in links for x in p)
    at = {x: k for k, x in enumerate(ids)}
    low = smallest_reachable(len(ids), np.array([at[a] for a, _ in links], int), np.array([at[b] for _, b in links], int))
    return {i: (n[i], ids[low[at[i]]] if i in at else i) for i, _ in vectors}


@pytest.mark.parametrize(("kind", "block"), [("float", 512), ("float", 16), ("double", 512)])
def test_embeddings(spark, kind, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((8, 24))
    rows = []
    for k in range(400):
        v = base[k % 8] + rng.standard_normal(24) * (0.25 if k % 3 else 3)
        rows.append((k, [float(np.float32(x)) for x in v]))
    rows += [(400, rows[5][1]), (401, [2 * x for x in rows[5][1]]), (402, None), (403, []), (404, [0.0] * 24), (405, [float("nan")] + [1.0] * 23), (406, [None] + [1.0] * 23), (407, [1.0, 2.0]), (408, [-0.0, 0.0] + [1.0] * 22), (409, [0.0, -0.0] + [1.0] * 22)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, rep int, size int")
    got = {r.id: (r.n_links, r.component) for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    assert got == brute_vectors(rows)
    assert embedding_dedup.near_duplicates(empty(df)).count() == 0


def test_html_main_text():
    page = """<html><head><title>T</title><script>x("</p>")</script></head><body><header>Head</header><nav><a>Menu</a></nav>
    <div class="cookie-notice">We use cookies, a long notice that says nothing at all of note to readers.</div>
    <article><h1>Title &amp; more</h1><p>First   paragraph<br>goes on with <b>bold</b> words.<p>Short.</p><form><p>Sign up</p></form>
    <ul><li>One<li>Two</ul><aside>Side</aside></article><section id="comments"><p>Reader: a rather long comment that is not article text.</p></section><footer>&copy; me</footer>"""
    assert html_extraction.main_text(page) == "Title & more\nFirst paragraph goes on with bold words.\nShort.\nOne\nTwo"
    assert html_extraction.main_text(None) == "" == html_extraction.main_text("") == html_extraction.main_text("<nav>x</nav>")
    assert html_extraction.main_text("plain words") == "plain words"
    nested = """<main><div class="crumbs">Home</div><article class="post"><h1>A title</h1><p>Some text of the article, long enough to count.</p>
    <article class="comment"><p>A reader says quite a lot of things here as well.</p></article></article></main>"""
    assert html_extraction.main_text(nested) == "A title\nSome text of the article, long enough to count."
    bare = """<body><div id="ad12">Buy</div><div class="page"><h2>Head</h2><p>The first paragraph has enough words to be content.</p><table><tr><td>x<td>y</table>
    <p>And the second paragraph has enough words too.</p><p>End.</p></div><div class="links"><a>a</a> <a>b</a></div></body>"""
    assert html_extraction.main_text(bare) == "Head\nThe first paragraph has enough words to be content.\nx\ny\nAnd the second paragraph has enough words too.\nEnd."


def test_html_articles_that_are_not_the_whole_text():
    long = "<p>The main text of this page stands here, in many words, and goes on for a good while.</p>" * 4
    text = "\n".join(["The main text of this page stands here, in many words, and goes on for a good while."] * 4)
    card = "<article><p>A card of a few words.</p></article>"
    assert html_extraction.main_text(f"<body><div>{long}</div>{card}</body>").startswith(text)
    assert html_extraction.main_text(f"<main>{card}{long}</main>") == f"A card of a few words.\n{text}"
    parts = f"<body><article>{long}</article><article><p>A second article, shorter than the first.</p></article></body>"
    assert html_extraction.main_text(parts) == f"{text}\nA second article, shorter than the first."


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (2, None, None, None), (None, "u", "", "t")], "page_id long, url string, html string, text string")
    got = sorted((r.row.page_id or 0, r.row.text or "", r.text) for r in html_extraction.extract_main_text(df).collect())
    assert got == [(0, "t", ""), (1, "t", "a"), (1, "t", "a"), (2, "", "")]
    assert html_extraction.extract_main_text(empty(df)).count() == 0


def test_url_rules(spark):
    urls = ["http://A.example.com/en/7x?q", "http://example.com/en/8", "https://x.net/de/", "ftp://example.net/de/8#f", "http://notcom/en/", "http://com/en/", None, "", "no scheme", "http://", "http://a.org", "http://u@a.org/es/ü", "http://example.com/en/7", "http://example.com/en/7"]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string")
    rules = spark.createDataFrame([*url_filter.RULES, ("block", None, "/x"), ("allow", "com", "/en/")], "verdict string, host string, path string")

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")

    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge_urls(pages, empty(rules), default="block").collect()} == {"block"}
    assert url_filter.judge_urls(empty(pages), rules).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    blocks = url_filter.bloom_blocks(keys, 60)
    probe = keys.withColumn("block", F.pmod("key", F.lit(60))).join(blocks, "block")
    for i, mask in enumerate(url_filter._masks(F.col("key"))):
        probe = probe.where(F.col(f"w{i}").bitwiseAND(mask) == mask)
    assert probe.count() == 2000


def brute_leaks(docs, items):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        words = find(t)
        m = min(10, len(words))
        for s in range(len(words) - m + 1 if m else 0):
            windows[tuple(words[s : s + m])].add(str(i))
    out = []
    for i, t in docs:
        words, hit, named = find(t), set(), set()
        for m in {len(w) for w in windows}:
            for s in range(len(words) - m + 1):
                if (w := tuple(words[s : s + m])) in windows:
                    hit |= set(range(s, s + m))
                    named |= windows[w]
        out.append((i, len(words), len(hit), sorted(named)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_decontamination(spark, limit):
    rng = np.random.default_rng(4)
    words = np.array("a B c d é f7 g h".split())
    items = [(k, " ".join(rng.choice(words, n))) for k, n in enumerate([3, 12, 15, 1, 10, 9, 30])] + [(7, None), (8, ""), (9, "only!"), (9, "ONLY")]
    docs = [(k, " ".join(rng.choice(words, 60)) + " " + (items[k % 7][1] or "") + ", tail") for k in range(20)] + [(20, None), (21, ""), (21, ""), (22, "?!"), (23, "x only y"), (None, "only")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n_hit int, item string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in leaks.contamination(d, b, max_index_rows=limit).collect()), key=str)
    assert got == brute_leaks(docs, items)
    assert {r.n_hit for r in leaks.contamination(d, empty(b)).collect()} == {0}
    assert leaks.contamination(empty(d), b).count() == 0


def brute_repeats(docs, least):
    texts = [(t or "").encode() for _, t in docs]
    seen = collections.Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for (i, _), t in zip(docs, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - least + 1):
            if seen[t[s : s + least]] > 1:
                gone[s : s + least] = True
        kept = bytes(x for x, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [256, 1])
def test_repeats(spark, odd_docs, block):
    rng = np.random.default_rng(6)
    make = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared = make(120)
    docs = [(k, make(150) + shared[: 60 + 10 * (k % 7)] + make(100)) for k in range(20)] + [(50, "ab" * 300), (51, "x" * 40), (52, None), (53, ""), (54, make(90)), (None, make(40))]
    docs += [(55, docs[3][1]), (3, docs[3][1])]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in docs], "doc_id long, text string, spans string, n_removed int")
    out = suffix_dedup.remove_repeats(df, least=50, gram=12, block=block)
    got = sorted(((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()), key=str)
    assert got == brute_repeats(docs, 50)
    assert suffix_dedup.remove_repeats(empty(df)).count() == 0
    whole = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(odd_docs).collect()), key=str)
    assert got == brute_repeats(whole, 400)


def test_repeats_of_the_query(spark):
    """Every document of the smallest table, at the contract's 400 bytes."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in suffix_dedup.op5_suffix_array_dedup(spark, SF).collect()), key=str)
    assert got == brute_repeats(docs, 400) and any(0 < x[2] < x[1] for x in got)


def brute_jaccard(docs, m, num, den):
    sets = []
    for _, t in docs:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        sets.append({tuple(words[i : i + m]) for i in range(len(words) - m + 1)} if len(words) >= m else {tuple(words)} if words else set())
    linked = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if sets[a] and sets[b] and docs[a][0] is not None and docs[b][0] is not None and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    place = {k: p for p, k in enumerate(order)}
    low = smallest_reachable(len(docs), np.array([place[a] for a, _ in linked], int), np.array([place[b] for _, b in linked], int))
    return sorted(((docs[k][0], len(sets[k]), docs[order[low[place[k]]]][0]) for k in range(len(docs))), key=str)


@pytest.mark.parametrize(("m", "pair", "block"), [(3, (90, 100), 2048), (5, (80, 100), 2048), (5, (80, 100), 4)])
def test_jaccard(spark, odd_docs, m, pair, block):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(500)]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for c in range(6):
        base = list(rng.choice(vocabulary, 40 + 30 * c))
        for k in range(12):
            own = list(base)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(0, len(own))] = str(rng.choice(vocabulary))
            docs.append((100 + 20 * c + k, " ".join(own).upper() if k % 2 else " ".join(own)))
    df = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in docs], "doc_id long, text string, n int, part string, tokens string")
    got = sorted(((r.id, r.n_shingles, r.component) for r in jaccard_join.jaccard_components(df, words_each=m, threshold=pair, block=block).collect()), key=str)
    assert got == brute_jaccard(docs, m, *pair)
    assert jaccard_join.jaccard_components(empty(df)).count() == 0


def test_signature_tree_drops_no_pair():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, 60, replace=False), rng.integers(0, 1 << 60, k % 9).astype(np.uint64)))) for k in range(150)]
    sets += [np.unique(np.append(s[:-1], np.uint64(k))) for k, s in enumerate(sets[:40])]
    links = jaccard_join.link_sets(sets, np.arange(len(sets)), 9, 10)
    exact = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 9 * len(np.union1d(sets[a], sets[b]))]
    low = [smallest_reachable(len(sets), *np.array(x, int).reshape(-1, 2).T) for x in (links, exact)]
    assert set(map(tuple, map(sorted, links))) <= set(exact) and (low[0] == low[1]).all()


def test_toxicity_holds_out_and_ranks(spark):
    rng = np.random.default_rng(10)
    words = [f"word{k}" for k in range(300)]
    rows, marks = [], []
    for k in range(900):
        text = list(rng.choice(words, 60))
        bad = k % 6 == 0
        if bad:
            for w in rng.choice(["vilegit", "vilesno", "grumpf"], 3):
                text[rng.integers(0, 60)] = str(w)
        rows.append((k, " ".join(text), "en", "s", 0, "x", "y", 1))
        marks.append((k, 1, int(bad)))
    rows += [(900, None, "en", "s", 0, "x", "y", 1), (901, "", "en", "s", 0, "x", "y", 1), (901, "", "en", "s", 0, "x", "y", 1), (None, "vilegit", "en", "s", 0, "x", "y", 1), (902, "VILEGIT! " * 5000, "en", "s", 0, "x", "y", 1)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([*marks, (900, 1, None), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score").collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [(r.score >= 0.5, r.doc_id % 6 == 0) for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert {r.score >= 0.5 for r in out if r.doc_id in (900, 901)} == {False}
    assert toxicity.toxicity(empty(docs), labels).count() == 0
    assert toxicity.toxicity(docs, empty(labels)).count() == len(rows)


def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok <|\\im_end|> <|\\\\im_start|> <|other|> é 🙂"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", odd), (1, 2, "assistant", odd), (2, 0, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, None, "system", "x\ny"), (None, 0, "user", "word " * 20_000), (4, 0, "a\n<|im_end|>", "t")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, seq int, formatted string")
    turns = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(turns).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, own in by.items():
        own = sorted(own)
        said = "".join(x[3] for x in own if x[2] == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(said)
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        if c == 4:  # a role with a line feed is read back with what follows it as text: the same digest
            assert own == [(True, 0, "a\n<|im_end|>", "t")]
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
    firsts = [(r.conv_id, r.seq, r.first_token, len(r.input_ids)) for r in turns.collect()]
    for (c, s, at, n), (c2, s2, at2, _) in zip(firsts, firsts[1:], strict=False):
        assert c2 != c or (s2 == s + 1 and at2 == at + n)
    assert chat.unescape(chat.escape(odd)) == odd and "<|im_end|>" not in chat.escape(odd)
    assert chat.read_back(chat.format_chats(empty(df))).count() == 0


def test_ids_of_long_texts_are_those_of_the_whole():
    enc = chat.tokenizer(chat.VOCABULARY)
    rng = np.random.default_rng(4)
    unbroken = "".join(rng.choice(list("abcdefgh0123.,"), 50_000))
    for text in ("word " * 9_000, f"{'x' * 19_990}{' ' * 30}y" * 3, f"{'a  b\n\n c' * 5_000}", unbroken, f"{'x' * 19_999} {'\u3000' * 9}z {unbroken}"):
        assert chat.encode(enc, text) == enc.encode_ordinary(text)


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_spread_lines(spark, limit):
    rows = [(k, f"Menu\n  Home \nOwn line number {k} with a good deal of text of its own\r\n\nline{k % 3}\n", f"s{k % 7}") for k in range(40)]
    rows += [(100, "Menu", "s1"), (101, None, "s1"), (102, "", None), (103, "Menu\nMore than half of it is its own text", None), (None, "Menu\nalone but long enough to stay", "s2"), (7, rows[7][1], "s0")]
    df = docs_frame(spark, rows)
    sites = collections.defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\r\v\f") and s:
                sites[line.strip(" \t\r\v\f")].add(s)
    spread = {x for x, s in sites.items() if len(s) >= 4}

    def expect(text):
        if text is None:
            return None, 1, 0
        lines = text.split("\n")
        keys = [x.strip(" \t\r\v\f") for x in lines]
        size = lambda some: sum(len(x.encode()) for x in some)
        if size(k for k in keys if k in spread) > 0.5 * size(keys):
            return text, len(lines), 0
        kept = [x for x, k in zip(lines, keys, strict=True) if k not in spread]
        return "\n".join(kept), len(lines), len(lines) - len(kept)

    out = line_dedup.remove_spread_lines(df, min_sites=4, max_sent_lines=limit)
    got = sorted(((r.row.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    assert got == sorted(((i, *expect(t)) for i, t, _ in rows), key=str) and any(x[3] for x in got)
    assert line_dedup.remove_spread_lines(empty(df)).count() == 0


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_spread_lines_of_copies(spark, limit):
    """Over the share only copies keep their text; pages that are mostly boilerplate lose it."""
    menu = "a menu line that stands on every site"
    page = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"{menu}\nown {k}", f"s{k}") for k in range(6)]
    rows += [(k, page, f"s{k % 5}") for k in range(10, 15)] + [(20, f"{page}\nand one more", "s1"), (21, f"{menu}\n{menu}\nshort", "s2"), (22, None, "s3")]
    out = line_dedup.remove_spread_lines(docs_frame(spark, rows), min_sites=4, max_sent_lines=limit, similarity=(80, 100))
    got = {r.row.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    expected = {k: (f"own {k}", 2, 1) for k in range(6)} | {k: (page, 1, 0) for k in range(10, 15)}
    assert got == expected | {20: (f"{page}\nand one more", 2, 0), 21: ("short", 3, 2), 22: (None, 1, 0)}


def test_mixing(spark):
    rows = [(k, "t", "big" if k % 3 else f"small{k % 5}") for k in range(3000)] + [(5, "t", "big"), (None, None, None), (9999, "", None)]
    df = docs_frame(spark, rows).withColumn("copy", F.lit("clash"))
    means = {r.source: (r.n, r.mean) for r in source_mixing.mixing_means(df).collect()}
    total = sum(n**0.5 for n, _ in means.values())
    assert all(abs(m - len(rows) * n**0.5 / total / n) < 1e-9 for n, m in means.values())
    out = source_mixing.mix_sources(df).select(F.col("row.source").alias("s"), "row.doc_id", "copy", "shuffle_key").collect()
    count = collections.Counter(r.s for r in out)
    for s, (n, m) in means.items():
        assert abs(count[s] - n * m) < 6 * (n * m) ** 0.5 + 1
    again = source_mixing.mix_sources(df.repartition(3)).select(F.col("row.source").alias("s"), "row.doc_id", "copy", "shuffle_key").collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    heavy = source_mixing.mix_sources(df, weights={"small1": 1.0}, total=400_000).select("row.source").collect()
    assert {r.source for r in heavy} == {"small1"} and abs(len(heavy) - 400_000) < 6 * 400_000**0.5
    assert source_mixing.mix_sources(empty(df)).count() == 0
    with pytest.raises(ValueError):
        source_mixing.mix_sources(df, weights={})


def test_poisson_draws_follow_the_distribution(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    out = source_mixing.mix_sources(df, total=40_000)
    times = collections.Counter(r["count"] for r in out.groupBy("row.doc_id").count().collect())
    assert abs(times[2] / 20_000 - 2 * np.exp(-2)) < 0.02 and abs(times[1] / 20_000 - 2 * np.exp(-2)) < 0.02


def test_mixing_deals_repeated_and_null_ids_over_all_partitions(spark):
    """Rows without an id, rows that repeat and a source of nine tenths of the rows."""
    rows = [(None, f"text {k}", "large", 1) for k in range(20_000)] + [(7, "same", "large", 1)] * 20_000 + [(k, "x", f"s{k % 40}", 1) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mean int")
    out = source_mixing.mix_sources(df, total=44_000, temperature=1.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # partitions as they are dealt
    sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mean = sum(r["count"] for r in sizes) / len(sizes)
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1.3 * mean
    unlike = out.where("row.text like 'text%'").groupBy("row.text").count().count()
    assert 11_000 < unlike < 14_500  # about 1 - 1 / e of them are drawn at least once


def test_jaccard_takes_integer_ids_only(spark):
    df = spark.createDataFrame([("a", "one two three")], "doc_id string, text string")
    with pytest.raises(ValueError, match="integers"):
        jaccard_join.jaccard_components(df)


@pytest.mark.parametrize("times", [16, 1])
def test_jaccard_splits_large_components(spark, monkeypatch, times):
    """With either way to compare what is apart. A chain of template texts whose candidates hang together while few of them link; blocks of 16 sets."""
    rng = np.random.default_rng(8)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(300):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 9), replace=False):
            words[at] = f"v{rng.integers(0, 4)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "_TIMES", times)
    got = sorted((r.id, r.n_shingles, r.component) for r in jaccard_join.jaccard_components(df, block=16).collect())
    assert got == sorted(brute_jaccard(rows, 3, 90, 100))
