"""Near-duplicates, HTML extraction, URL filter and the pipeline."""

import itertools
import random
import re
import sys
import time

import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from corpusloom.llm import html_cut, minhash, urls

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("root", T.StringType()),
])
WORDS = [f"{a}{b}" for a in ("riv", "str", "po", "ban", "dri", "flo") for b in ("er", "eam", "ol", "k", "ed", "wing", "s")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), "x", "y") for i, t, s in rows], DOCS)


def prose(rng, n):
    return [rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n)]


def near_copy(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"edit{rng.randint(0, 10**9)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, chains, a large group, shared passages and odd rows."""
    rng = random.Random(8)
    texts = [" ".join(prose(rng, rng.randint(20, 300))) for _ in range(120)]
    passage = " ".join(prose(rng, 60))
    texts += [" ".join(prose(rng, 150)) + " " + passage for _ in range(40)]
    origin = prose(rng, 200)
    texts += [" ".join(near_copy(rng, origin, rng.randint(1, 8))) for _ in range(120)]
    chain = prose(rng, 250)
    for _ in range(15):
        chain = near_copy(rng, chain, 3)
        texts.append(" ".join(chain))
    texts += [texts[3]] * 30 + [texts[4].upper(), "one two three", "One two; three!", "one two three", "", "", "!!!", "???"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return rows + [(None, texts[7], "s"), (None, None, "s"), (8000, None, "s"), (9, texts[9], "s")]


def brute_classes(rows):
    sets = minhash.shingles([t or "" for _, t, _ in rows])
    seen = np.zeros(minhash.BUCKETS, np.int64)
    for h, _ in sets:
        np.add.at(seen, h >> np.uint32(32 - minhash.BUCKET_BITS), 1)
    bits = np.clip(np.rint(np.log2(1 + seen.sum() / np.maximum(seen, 1))), 1, minhash.BUCKET_BITS).astype(np.uint8)
    packed = [(h.tobytes(), b"" if (c == 1).all() else c.tobytes()) for h, c in sets]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a][1], rows[b][1]
        if x is not None and y is not None and root(a) != root(b):
            if x == y or minhash.similarity(packed[a], packed[b], bits) >= 0.8:
                parent[root(b)] = root(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return sorted((sorted(g, key=str) for g in groups.values()), key=str)


def test_classes_equal_brute_force(spark, corpus):
    got = minhash.near_duplicates(docs_of(spark, corpus).repartition(5)).collect()
    assert len(got) == len(corpus)
    by_class = {}
    nulls = [r for r in got if r.class_id is None]
    for r in got:
        if r.class_id is not None:
            by_class.setdefault(r.class_id, []).append(r)
    groups = [sorted([r.doc_id for r in g], key=str) for g in by_class.values()] + [[r.doc_id] for r in nulls]
    assert sorted(groups, key=str) == sorted(brute_classes(corpus), key=str)
    for class_id, rows in by_class.items():
        kept = [r for r in rows if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == class_id == min(r.doc_id for r in rows if r.doc_id is not None)
        assert all(r.class_size == len(rows) for r in rows)


def test_pivots_lose_no_link(spark, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "REMAINDER", 0)  # pivots until the last round, then the rest
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 2)
    got = minhash.near_duplicates(docs_of(spark, corpus)).collect()
    assert len({r.class_id for r in got if r.class_id is not None}) == len(brute_classes(corpus)) - 1


def test_bridge_between_members_of_two_pivots(spark, monkeypatch):
    """p1 - a - b - p2: only a and b join the two groups, and neither is a pivot."""
    for name, value in (("PIVOTS", 1), ("PIVOT_ROUNDS", 2), ("REMAINDER", 0), ("BLOCK_ROWS", 2)):
        monkeypatch.setattr(minhash, name, value, raising=False)
    rng = random.Random(5)
    words = [prose(rng, 200)]
    for step in range(3):  # four edits keep 176 of 196 shingles, eight are too many
        new = list(words[-1])
        for at in range(4):
            new[10 + 15 * (4 * step + at)] = f"edit{rng.randint(0, 10**9)}"
        words.append(new)
    p1, a, b, p2 = (" ".join(w) for w in words)
    other = [" ".join(prose(rng, 200)) for _ in range(20)]
    rows = [(i, t, "s") for i, t in enumerate([p1, p2, a, b, *other])]
    sets, _ = minhash.store(minhash.shingle_sets(docs_of(spark, rows).coalesce(1)))
    bits = minhash.bits_of_buckets(sets)
    # one bucket holds them all
    nodes = sets.selectExpr("row", "array(cast(7 as bigint)) as bands", "cast(length(hashes) as bigint) as size")
    linked = minhash.linked_texts(nodes, sets, bits, 0.8).collect()
    assert len(linked) == 4 and len({r.root for r in linked}) == 1


def test_links_among_many_equal_those_of_pairs():
    rng = random.Random(11)
    origin = prose(rng, 120) + ["same"] * 40
    texts = [" ".join(near_copy(rng, origin, rng.randint(0, 12)) + ["again and on it goes"] * rng.randint(0, 9)) for _ in range(70)]
    texts += [" ".join(prose(rng, 50)) for _ in range(10)] + ["x"]
    packed = [(h.tobytes(), b"" if (c == 1).all() else c.tobytes()) for h, c in minhash.shingles(texts)]
    bits = np.random.default_rng(1).integers(1, 19, minhash.BUCKETS).astype(np.uint8)
    got = minhash.links_among(packed, bits, 0.8)
    want = np.array([[a != b and minhash.similarity(packed[a], packed[b], bits) >= 0.8 for b in range(len(packed))]
                     for a in range(len(packed))])
    assert (got == want).all() and 100 < want.sum() < 4900


def test_one_per_class_keeps_columns(spark, corpus):
    df = docs_of(spark, corpus)
    out = minhash.one_per_class(df)
    rows = out.collect()
    assert out.columns == df.columns and len(rows) == len(brute_classes(corpus))
    assert sum(r.text is None for r in rows) == 2
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.one_per_class(df.limit(0)).count() == 0


def test_shingles_are_those_of_each_text_alone():
    rng = random.Random(3)
    texts = [" ".join(prose(rng, n)) for n in (0, 1, 4, 5, 6, 300)] + ["ÉTÉ été, a-b c", "", "x " * 5000]
    together = minhash.shingles(texts)
    for text, (h, c) in zip(texts, together, strict=True):
        own, n = minhash.shingles([text])[0]
        assert (h == own).all() and (c == n).all()
    assert (together[6][1] == 1).all() and len(together[0][0]) == 0 and together[8][1].tolist() == [4996]


def test_samples_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**32, 4000, dtype=np.uint64).astype(np.uint32))
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    ca, cb = rng.integers(1, 4, len(a)).astype(np.uint32), rng.integers(1, 4, len(b)).astype(np.uint32)
    x, y = dict(zip(a, ca, strict=True)), dict(zip(b, cb, strict=True))
    keys = set(x) | set(y)
    exact = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
    sampler = minhash.Sampler(1500, 9)
    start = np.array([0])
    same = (sampler.samples(a, ca.astype(float), start) == sampler.samples(b, cb.astype(float), start)).mean()
    assert abs(same - exact) < 0.05


def test_weights_do_not_fade_as_the_corpus_grows(spark):
    """Two million shingles that stand once, and some that stand in every or every fourth row."""
    rng = np.random.default_rng(4)
    hashes = rng.permutation(2**32 // 1999)[:2_000_064].astype(np.uint32) * np.uint32(1999)
    own, common = hashes[64:].reshape(200, -1), hashes[:64]
    rows = [(np.concatenate([own[i], common[:32], common[32:][: 32 * (i % 4 == 0)]]).tobytes(),) for i in range(200)]
    df = spark.createDataFrame([(bytearray(r[0]),) for r in rows], "hashes binary")
    bits, n = minhash.bits_of_buckets(df), 2_000_000 + 200 * 32 + 50 * 32
    for some, documents in ((own[:9].ravel(), 1), (common[:32], 200), (common[32:], 50)):
        assert abs(minhash.weights(some, None, bits).mean() - np.log2(n / documents)) < 0.8


def test_links_by_equal_weights_are_candidates(spark):
    """Equal sets of shingles with very different counts: weighted similarity about 0.35."""
    rng = random.Random(21)
    rows = []
    for i in range(20):
        passage = " ".join(prose(rng, 30)) + " "
        rows += [(2 * i, passage * 100, "s"), (2 * i + 1, passage * 35, "s")]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(20))


def test_set_samples_agree_as_often_as_sets_overlap():
    pool = np.unique(np.random.default_rng(1).integers(0, 2**32, 4000, dtype=np.uint64).astype(np.uint32))
    agree = []
    for n in range(0, 1500, 100):  # 900 of 1,100 shingles shared
        a, b = pool[n:n + 1000], pool[n + 100:n + 1100]
        agree.append((minhash.set_samples(a, np.array([0])) == minhash.set_samples(b, np.array([0]))).mean())
    assert abs(np.mean(agree) - 900 / 1100) < 0.03


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style></head><body>
<div id="cookie-notice">We use cookies, as everybody does; please accept them all.</div>
<header><h1>The Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="sidebar"><p>Read this other piece, please. It is long enough to be a paragraph of an article.</p></div>
<article><h1>A&nbsp;title</h1><!-- x --><p>First &amp; <b>bold</b> para,
with   text.<br>It goes on &#x41;.<p>Second, with a <a href=x>link</a>.<script>var t="</p>";</script>
<div class="ad">Buy now, it is cheap. Really.</div><p>Last one.</p></article>
<div class="comments"><article><p>Great post, I liked it a lot. Thanks, really.</p></article></div>
<form>Email <input name=e></form><footer>&copy; 2020 The Site. All rights reserved.</footer></body></html>"""
TEXT = "A title\n\nFirst & bold para, with text. It goes on A.\n\nSecond, with a link.\n\nLast one."


def test_extraction(spark):
    long = "<article>" + "<p>Some words, and a full stop.</p>" * 3000 + "</article>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>Loose text, with a sentence. And one more.</p>"),
            (1, "u", PAGE), (4, "x", long), (5, "y", "<a<a<b"), (6, "z", "<script>never closed <p>text</p>")]
    df = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = html_cut.extract(df).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == TEXT and [r.text for r in got if r.page_id == 1] == [TEXT] * 2
    assert by_id[2] == by_id[3] == by_id[6] == "" and by_id[None] == "Loose text, with a sentence. And one more."
    assert by_id[4].count("\n\n") == 2999 and all(r.n_chars == len(r.text) for r in got)
    assert html_cut.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", [
    "<div class='content-sidebar-wrap'><main>{}</main></div>", "<div class='content with-sidebar'>{}</div>",
    "<div id='page-no-header'><article>{}</article></div>", "<div class='search-page menu-open'><div role='main'>{}</div></div>",
])
def test_layout_names_do_not_empty_a_page(wrapper):
    body = "".join(f"<p>Paragraph {i} of the text, which is long enough. It goes on, as paragraphs do.</p>" for i in range(4))
    page = wrapper.format(body + "<div class='comments'><article><p>Nice, I liked it.</p></article></div>")
    got = html_cut.main_text(page, html_cut.PRIOR)
    assert got.count("Paragraph") == 4 and "Nice" not in got


def bare(page):
    """The page without article tags, classes, ids and roles."""
    page = re.sub(r"</?(?:article|main)\b[^>]*>", "", page)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*')", "", page)


@pytest.fixture(scope="module")
def learnt(spark):
    return html_cut.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_pages_without_names_are_judged_by_what_was_learnt(spark, learnt):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html]
    assert all(not any(b.content for b in html_cut.blocks(bare(page))) for page in pages)
    texts = [html_cut.main_text(page, learnt) for page in pages]
    same = sum(html_cut.main_text(bare(page), learnt) == text for page, text in zip(pages, texts, strict=True))
    assert same >= 0.95 * len(pages) and all(texts)


def test_the_cut_overturns_the_classifier():
    long = "<p>A paragraph of the text, which is long enough. It goes on, as paragraphs do, and ends.</p>"
    page = "<nav><a href=x>Home</a></nav>" + long * 3 + "<h5>So</h5>" + long * 3
    found = html_cut.blocks(page)
    odds = html_cut.log_odds(found, html_cut.PRIOR)
    kept = html_cut.min_cut(odds, html_cut.smoothness(found))
    assert found[4].text == "So" and odds[4] < 0 and kept[4]  # its neighbours keep it
    assert not kept[0] and kept[1:].all()


@pytest.mark.parametrize("page", [
    "<div>" * 90_000 + "</p>" * 90_000, "<svg>" * 200_000, "<div hidden>" * 90_000, "<div" * 200_000 + ">",
    "<div " + "a" * 1_000_000 + " b=c>x</div>",
])
def test_long_malformed_pages_take_linear_time(page):
    start = time.perf_counter()
    html_cut.main_text(page, html_cut.PRIOR)
    assert time.perf_counter() - start < 10


def test_upper_share_is_of_the_whole_block():
    for text in ("A" * 200 + "b" * 600, "Ä" * 200 + "b" * 600):
        block = html_cut.Block(text, 0, "p", 0, False, False)
        assert html_cut.features([block])[0][-1] == 0.25


def test_minimum_cut_against_all_labellings():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(kept, odds=odds, edges=edges):
            return sum(max(o, 0) if not k else max(-o, 0) for o, k in zip(odds, kept, strict=True)) + sum(
                c for a, b, c in edges if kept[a] != kept[b])

        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert abs(cost(html_cut.min_cut(odds, edges)) - best) < 1e-6


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    fit = []
    for rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append(rule)
    best = max(fit, key=len, default=None)
    return best, rules.get(best)


def test_urls(spark):
    some = [f"https://{h}.example.{t}/{p}/{i}{q}" for i, (h, t, p, q) in enumerate(itertools.product(
        ["www.a1", "bets-9", "m.x"], ["net", "com", "org"], ["en", "de", "fr"], ["", "?a=1&b=2", "#top"]))]
    odd = [None, "", "no scheme/net", "HTTP://NET/x", "http://net", "http://net?x=/", "ftp://x.NET/É#?/", "a://b://c.org/fr/",
           "http://example.net/en", "http://É.org/fr/x", "http://notnet/", "http://a.net/" + "1" * 30_000, some[0]]
    df = spark.createDataFrame([(i, u, "h", "r", 1.0) for i, u in enumerate(some + odd)],
                               "page_id long, url string, host string, rule string, f_length double")
    out = urls.judge_urls(df)
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(some + odd)
    for i, url in enumerate(some + odd):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
        assert (got[i].score is None) == (rule is not None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert urls.judge_urls(df.limit(0)).count() == 0
    lone = urls.judge_urls(df.filter("url like 'https://bets-9.example.com/en%'")).collect()
    assert {r.verdict for r in lone} == {"allow"}


def test_trees_follow_the_labels(spark):
    bad = [f"http://x{i}9-8{i}.example.com/p{i * 77}?a=1&b=2&c={i}" for i in range(60)]
    good = [f"https://www.site.example.com/text/about{'e' * (i % 9)}" for i in range(60)]
    rules = (("block", f"x{i}9-8{i}.example.com", "/") for i in range(0, 60, 2))
    fine = (("allow", "site.example.com", f"/text/about{'e' * k}") for k in (0, 2, 4))
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(df, [*rules, *fine]).collect()}
    assert all(got[i].verdict == "block" for i in range(60)) and all(got[i].verdict == "allow" for i in range(60, 120))


def test_pipeline(spark, tmp_path, corpus):
    rng = random.Random(2)
    rows = corpus + [(10_000 + i, " | ".join(prose(rng, 60)) + " ### !!!", "t") for i in range(60)]
    rows += [(20_000 + i, " ".join(prose(rng, 50)) + f" token = \"{rng.randrange(16**40):040x}\"", "t") for i in range(9)]
    docs_of(spark, rows).drop("row", "root").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("###" not in (t or "")), 0) for i, t, _ in rows if i], "doc_id long, quality int, toxic int"
                          ).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "minhash_near_dedup":
            unique = docs.count()
            assert unique == docs.select("text").filter("text is not null").distinct().count() + docs.filter("text is null").count()
        if name == "secret_scan":
            assert docs.filter("text like '%token = %'").count() == 0 and docs.filter("text like '%[SECRET]%'").count() == 9
    assert counts[0] >= counts[1] == counts[2]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.drop("sequence_id", "offset").collect())) == sorted(
        map(str, docs.drop("sequence_id", "offset").collect()))


def test_names():
    assert sys.modules["corpus_pipeline"].ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
