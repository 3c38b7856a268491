"""Neighbours, pages, quality and language operators against plain Python, on odd rows too."""

import collections
import math
import random

import numpy as np
import pytest
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import grams, html_text, language_id, neighbours, quality
from tracewell.llm.common import text_bytes

VECTORS = "vec_id long, embedding array<float>, id long, cell long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VECTORS)


def brute_nearest(rows, queries, k):
    out = set()
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    size = collections.Counter(len(v) for _, v in good).most_common(1)[0][0]
    good = [(i, v) for i, v in good if len(v) == size]
    for q, x in good:
        if q in queries:
            near = sorted({(float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in good if i != q})[:k]
            out |= {(q, n, i) for n, (_, i) in enumerate(near, 1)}
    return out


def test_nearest_is_exact_where_all_is_reranked(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "calibrate", lambda *_: 1.0)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # many copies of one vector
    rows += [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2004, [float("nan")] * 6), (2005, [float("inf")] * 6), (2006, [1.0, 2.0]), (None, [1.0] * 6), rows[7]]
    got = neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=5).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == brute_nearest(rows, set(range(0, 3000, 10)), 5)


def test_nearest_of_few_or_none(spark):
    assert neighbours.nearest(vectors(spark, []), F.lit(True)).count() == 0
    assert neighbours.nearest(vectors(spark, [(1, [1.0, 2.0])]), F.lit(True)).count() == 0
    got = neighbours.nearest(vectors(spark, [(1, [1.0]), (2, [3.0]), (3, [-1.0])]), F.col("vec_id") == 1).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 2.0), (2, 3, 2.0)]


@pytest.mark.parametrize("sample", [20_000, 400])
def test_recall_where_cells_are_pruned(spark, monkeypatch, sample):
    """Measured against brute force, with a sample that is the table and with one a fifth of it."""
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", sample)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    queries = {i for i, _ in rows if i % 20 == 0}
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()}
    want = {(q, i) for q, _, i in brute_nearest(rows, queries, 10)}
    assert len(got & want) >= 0.9 * len(want)


def test_clustered_vectors_need_few_entries(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 8
    rows = [(i, (centres[i % 40] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    books = neighbours.Codebooks(np.array([v for _, v in rows]), 16)
    assert neighbours.calibrate(books, np.array([v for _, v in rows]), 10) <= 0.2
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=10).collect()}
    want = {(q, i) for q, _, i in brute_nearest(rows, set(range(0, 3000, 50)), 10)}
    assert len(got & want) >= 0.9 * len(want)


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(2)
    books = neighbours.Codebooks(rng.normal(size=(200, 4)), 6)
    x = rng.normal(size=4)
    counts = {c: 1 for c in range(36)}
    order = books.traverse(x, counts, 36)
    a, b = (d[0] for d in books.distances(x[None, :]))
    sums = [a[c // 6] + b[c % 6] for c in order]
    assert sorted(order) == list(range(36)) and sums == sorted(sums)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Head</header><nav><ul><li><a href="/a">x</a><li>y</ul></nav><!-- <p>ad</p> --><div class="ad">AD</div>
<article class=post><h1>Ti &amp; tle</h1><p>One <b>two<br>three &eacute;&#39;&nbsp;x<p>Four</p>loose <i>te</i>xt<ul><li>a<li>b</ul>
<div id="comments"><p>no</p></div><aside>s</aside><div style="display: none">hid</div><form><p>f</p></form></article>
<div class="cookie-notice">c</div><footer>&copy; F</footer>"""


def test_blocks_of_a_page():
    blocks = [t for _, t, _ in html_text.Page(PAGE).blocks]
    assert blocks == ["Head", "x", "y", "AD", "Ti & tle", "One two three é' x", "Four", "loose text", "a", "b", "s", "c", "© F"]
    assert [(t, n) for _, t, n in html_text.Page("<p><a>one</a> two<p>three").blocks] == [("one two", 3), ("three", 0)]
    assert [t for _, t, _ in html_text.Page("<p>a<p>b</div></p>c").blocks] == ["a", "b", "c"]
    assert [t for _, t, _ in html_text.Page("<p class='comments-area'>a<p class=commentary>b<p id=Comments>c").blocks] == ["b"]
    assert html_text.Page("a < b & c <").blocks[0][1] == "a < b & c <"
    for odd in ("", "<", "<!--", "<p", "</", "<a href='x>y", "<script>never ends", "&#xD800;", "<" * 2000, "<p>" * 5000, "<div>x" * 2000):
        html_text.Page(odd)


def extracted(spark, pages):
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in html_text.extract_text(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    return got


def prose(i, n=12):
    return " ".join(f"word{i * 31 + k * k}" for k in range(n))


def test_site_branches_go_and_articles_stay(spark):
    body = lambda i: f"<body><article><h1>t{i}</h1><p>{prose(i)}</p><section class='sub'><p>Read our letter</p></section></article><footer>f</footer>"
    pages = [(i, f"http://a.example/{i}", body(i)) for i in range(30)]
    pages += [(100 + i, f"http://copy.example/{i}", f"<div class=ad>{i}</div><article><p>{prose(1, 40)}</p></article>") for i in range(30)]
    pages += [(200, "http://one.example/", body(5)), (201, None, None), (202, "http://[bad", ""), (200, "http://one.example/", body(5)), (203, "http://tie.example/", "<p>a</p><p>b</p>"), (204, "http://links.example/", "<div><a href=x>only</a></div>")]
    got = extracted(spark, pages)
    assert got[3] == [f"t3\n\n{prose(3)}"]
    assert got[105] == [prose(1, 40)]
    assert got[200] == [f"t5\n\n{prose(5)}"] * 2 and got[201] == [""] and got[202] == [""] and got[203] == ["a\n\nb"] and len(got[204]) == 1
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_menus_footers_and_sidebars_go_without_an_article(spark):
    """On a host of plain divisions, whose notices, adverts and menus differ from page to page."""

    def page(i):
        menu = "".join(f"<li><a href='/{k}'>entry {k} {i % 3}</a>" for k in range(5))
        text = "".join(f"<p>{prose(i * 7 + k, 30)}</p>" for k in range(4 + i % 3))
        return f"<div id=top><ul class=menu>{menu}</ul></div><div class=x1><div class=x2><h1>Title {i}</h1><p>Intro {i}</p>{text}</div><div class=x3>advert {i}</div></div><div class=x4>news {i}</div><div class=x5>All rights &copy;</div>"

    for n in (1, 2, 40):
        got = extracted(spark, [(i, f"http://divs.example/{i}", page(i)) for i in range(n)])
        for i in range(n):
            want = [f"Title {i}", f"Intro {i}", *(prose(i * 7 + k, 30) for k in range(4 + i % 3))]
            assert got[i] == ["\n\n".join(want)], (n, i)


def test_titles_and_odd_classes_of_an_article_stay(spark):
    page = lambda i: f"<article><header><h1>Title {i}</h1></header><p class='notice-board'>board {i}</p><p class='share-price'>price {i}</p><p>{prose(i, 40)}</p></article>"
    got = extracted(spark, [(i, f"http://b.example/{i}", page(i)) for i in range(12)])
    assert got[4] == [f"Title 4\n\nboard 4\n\nprice 4\n\n{prose(4, 40)}"]


def test_two_layouts_of_one_host(spark):
    a = lambda i: f"<div class=a><p>{prose(i, 40)}</p></div><div class=n>n{i}</div>"
    b = lambda i: "".join(f"<div class=b{k}><p>{prose(i + k, 20)}</p></div>" for k in range(8))
    got = extracted(spark, [(i, f"http://two.example/{i}", (a if i % 2 else b)(i)) for i in range(20)])
    assert got[3] == [prose(3, 40)] and got[4] == ["\n\n".join(prose(4 + k, 20) for k in range(8))]


def brute_trees(pages):
    """Importance and share of each (host, path), before they are drawn towards other sites'."""
    sites = collections.defaultdict(list)
    for url, source in pages:
        sites[html_text.host_of(url)].append(html_text.Page(source))
    out = {}
    for host, own in sites.items():
        m = max(2, len(own))
        per_page = [{(path, text): len(text) - links for path, text, links in page.blocks} for page in own]
        spread = collections.Counter(k for page in per_page for k in page)
        paths = {path[:i] for page in per_page for path, _ in page for i in range(len(path) + 1)} | {()}
        weight = lambda k: 1 - math.log(spread[k]) / math.log(m)  # noqa: B023, E731
        each = [sum(page.values()) for page in per_page]
        mean_weight = sum(n * (weight(k) + html_text.REPEATED) for page in per_page for k, n in page.items()) / max(1, sum(each))
        for path in paths:
            inside = [(k, n) for page in per_page for k, n in page.items() if k[0][: len(path)] == path]
            whole = mean_weight * sum(n for page, n in zip(per_page, each, strict=True) if any(k[0][: len(path)] == path for k in page))
            chars = sum(len(k[1]) for k, _ in inside)
            importance = sum(weight(k) for k, _ in inside) / len(inside) * sum(n for _, n in inside) / chars if inside else 0
            styles = collections.Counter(s for page in own for p, s in page.styles if p == path)
            if any(k[0] == path for k, _ in inside) and styles:
                total = sum(styles.values())
                entropy = sum(-c / total * math.log(c / total) for c in styles.values()) / math.log(max(2, total))
                importance = max(importance, entropy)
            share = sum(n * (weight(k) + html_text.REPEATED) for k, n in inside) / whole if whole else 0
            out[host, path] = importance, share
    return out


def test_importance_matches_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(html_text, "POOL", 0)
    rows = [(r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(f"http://mixed.example/{i}", f"<div>loose {i % 4}<p>{prose(i % 6)}</p>{'<p>same</p>' * (i % 3)}<a>link {i}</a></div>") for i in range(15)]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r.branch: (r.importance, r.share) for r in html_text.site_trees(df).collect()}
    want = {html_text.key_of(host, *path): v for (host, path), v in brute_trees(rows).items()}
    assert got.keys() == {k for k in want if k in got} and len(got) >= len(want) - sum(v == (0, 0) for v in want.values())
    for branch, pair in got.items():
        assert pair == pytest.approx(want[branch], abs=1e-9)


def test_each_page_of_the_table_has_its_article(spark, sf):
    """Every article paragraph of the small table comes out, and nothing else."""
    import html
    import re

    df = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    for r in df.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id].replace(" ", "") == "\n\n".join(p for p in parts if p).replace(" ", "")


def brute_kn(train, text, size):
    """Interpolated modified Kneser-Ney with dictionaries; returns bits."""
    pad = b"\n" * (size - 1)
    tables = {size: collections.Counter()}
    for t in train:
        b = pad + t
        for p in range(size - 1, len(b)):
            tables[size][b[p - size + 1 : p + 1]] += 1
    for k in range(size - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    discounts = {k: quality.KneserNey._discounts([sum(c == i for c in t.values()) for i in range(1, 5)]) for k, t in tables.items()}

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        lower = p(g[1:])
        mates = {x: c for x, c in tables[k].items() if x[:-1] == g[:-1]}
        if not mates:
            return lower
        d = lambda c: 0 if not c else discounts[k][min(c, 3) - 1]
        total = sum(mates.values())
        c = mates.get(g, 0)
        return (c - d(c)) / total + sum(map(d, mates.values())) / total * lower

    b = pad + text
    return -sum(math.log2(p(b[q - size + 1 : q + 1])) for q in range(size - 1, len(b)))


def test_kneser_ney_matches_dictionaries(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("aabc \né") for _ in range(n))
    train = [make(rng.randint(0, 60)) for _ in range(12)]
    texts = [make(rng.randint(0, 30)) for _ in range(20)] + ["zzz", None, ""]
    model = quality.KneserNey(spark.createDataFrame([(t,) for t in train], "text string"))
    df = spark.createDataFrame([(i, t, "en", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, perplexity double")
    for r in quality.perplexity(df, model).collect():
        raw = (texts[r.doc_id] or "").encode()
        want = 2 ** (brute_kn([t.encode() for t in train], raw, quality.SIZE) / len(raw)) if raw else None
        assert r.perplexity == (pytest.approx(want, rel=1e-5) if raw else None)


def test_probabilities_sum_to_one(spark):
    model = quality.KneserNey(spark.createDataFrame([("abcabcabd " * 5,)], "text string"))
    context = int.from_bytes(b"bcab", "big") << 8
    wanted = spark.range(256).select((F.col("id") + context).alias("gram"))
    total = model.probabilities(wanted).agg(F.sum(F.pow(F.lit(2.0), -F.col("bits").cast("double")))).first()[0]
    assert total == pytest.approx(1, abs=1e-4)


def test_scoring_in_shards_is_the_same(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    monkeypatch.setattr(quality, "SHARD_ROWS", 3000)
    many = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(one[i].perplexity == pytest.approx(many[i].perplexity) and one[i].keep == many[i].keep for i in one)


def test_quality_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.keep for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_quality_of_odd_rows(spark):
    rows = [(1, "plain text of some length that is here for the model to see", None), (2, None, "en"), (3, "", "en"), (None, "x y", "en"), (1, "plain text of some length that is here for the model to see", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, keep string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        got = quality.classify(docs, own).collect()
        assert len(got) == len(rows) and all(r.keep for r in got)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.doc_id for r in quality.trusted_ids(labels).collect()} == {1}


def brute_ppm(train, text, order):
    tables = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    pad = bytes([grams.PAD] * order)
    for t in train:
        b = pad + t
        for p in range(order, len(b)):
            for k in range(order + 1):
                tables[k][b[p - k : p]][b[p]] += 1
    b, bits = pad + text, 0.0
    for p in range(order, len(b)):
        gone = set()
        for k in range(order, -1, -1):
            seen = tables[k].get(b[p - k : p])
            rest = {x: n for x, n in (seen or {}).items() if x not in gone}
            if rest:
                total = sum(rest.values()) + len(rest)
                if b[p] in rest:
                    bits -= math.log2(rest[b[p]] / total)
                    break
                bits -= math.log2(len(rest) / total)
            gone |= set(seen or ())
        else:
            bits += math.log2(256 - len(gone))
    return bits


def test_code_lengths_match_dictionaries():
    rng = random.Random(6)
    make = lambda a: bytes(rng.choices(a, k=rng.randint(0, 14)))
    for _ in range(60):
        train, texts = [make(b"abc\n") for _ in range(4)], [make(b"abcd\n") for _ in range(3)]
        data = lambda ts: text_bytes(pa.array([t.decode() for t in ts]))
        model = language_id.Model({"x": grams.count_keys(grams.gram_keys(*data(train), language_id.ORDER + 1))})
        assert np.allclose(model.score(*data(texts))[:, 0], [brute_ppm(train, t, language_id.ORDER) for t in texts], atol=1e-4)


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs, language_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out(F.col("doc_id"))).collect()
    assert len(found) > 100 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 ...", "en"), (5, "", None), (None, "the dog", "en"), (1, "the cat and the dog", "en"), (6, "und die", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = language_id.train(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0
