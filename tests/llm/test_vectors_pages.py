"""Exact search and near-duplicates over vectors, and page extraction."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup as E
from tessera.llm import html_templates as H
from tessera.llm import topk_search as K


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(150, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1_000 + i, (base[i % 10] + rng.normal(size=24) * 0.08).tolist()) for i in range(60)]  # near copies
    rows += [(2_000 + i, base[0].tolist()) for i in range(40)]  # a hot group of copies
    rows += [(3_000, None), (3_001, [None] * 24), (3_002, [float("nan")] * 24), (3_003, [0.0] * 24), (3_004, [float("inf")] + [1.0] * 23),
             (3_005, [1.0, 2.0]), (3_006, [2.0, 4.0]), (3_007, []), (None, base[1].tolist()), (150, base[0].tolist()), (150, base[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    return rows, df.withColumn("label", F.lit(0)).withColumn("digest", F.lit("x")).withColumn("dim", F.lit("x")).withColumn("query", F.lit("x"))


def valid(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_top_k_equals_brute_force(vectors):
    rows, df = vectors
    known = {(i, tuple(np.floor(256 * np.array(v)).astype(int))) for i, v in rows if i is not None and valid(v)}
    want = []
    for q, qv in known:
        if q % 50 == 0:
            scored = sorted((-int(np.dot(qv, v)), i) for i, v in known if i != q and len(v) == len(qv))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    got = [tuple(r) for r in K.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert K.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = df.where("vec_id < 3 or vec_id = 50")
    assert K.top_k(few, F.col("vec_id") == 50).count() == 3


def test_top_k_of_large_components(spark):
    big = [(1, [4.0e8, -3.0e9]), (2, [1.0, 5.0e8]), (50, [2.0e4, 7.0])]
    df = spark.createDataFrame(big, "vec_id bigint, embedding array<double>")
    got = K.top_k(df, F.col("vec_id") == 50).collect()
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in big}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == sorted(
        ((i, sum(a * b for a, b in zip(ints[50], ints[i], strict=True))) for i in (1, 2)), key=lambda x: -x[1])


def test_embedding_duplicates_equal_brute_force(vectors):
    rows, df = vectors
    ok = [k for k, (_, v) in enumerate(rows) if valid(v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in ok}
    links = {k: [j for j in ok if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.95] for k in ok}
    label = {k: k for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for k in ok:
            low = min([label[k], *(label[j] for j in links[k])])
            changed |= low != label[k]
            label[k] = low
    want, members = [], {}
    for k, x in label.items():
        members.setdefault(x, []).append(k)
    for k, (i, _) in enumerate(rows):
        known = [rows[j][0] for j in members[label[k]] if rows[j][0] is not None]
        want.append((i, len(links.get(k, [])), min(known) if known else None))
    got = E.near_duplicates(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    found, all_links = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert found >= 0.9 * all_links and all(a[1] <= b[1] for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True))
    if found == all_links:
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert E.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables_find_the_links_of_the_given_vectors(spark, sf):
    """Through Hamming tables (not by comparing all pairs), against brute force."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    unit = np.stack([v / np.linalg.norm(v) for _, v in rows])
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    assert {r.layout.split()[1] for r in got.values()} == {"tables"}
    assert all(got[i].n_links <= n for (i, _), n in zip(rows, links, strict=True))
    assert sum(r.n_links for r in got.values()) >= 0.9 * links.sum()


def test_vectors_that_no_layout_separates_are_compared_exactly_and_named(spark):
    a, _ = shifted_pairs(8, 0.97, 300)
    rows = [(i, v.tolist()) for i, v in enumerate(a)]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    if {r.layout for r in got} == {"all pairs"}:
        assert sum(r.n_links for r in got) == int((a @ a.T >= 0.95).sum()) - len(a)
    else:
        assert sum(r.n_links for r in got) >= 0.95 * (int((a @ a.T >= 0.95).sum()) - len(a))


def test_recall_near_the_threshold():
    """Share of pairs at cosine 0.955 that meet in a table."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.955 * a + np.sqrt(1 - 0.955**2) * o
    mean, projection = E.learn_rotation(a)
    models = {64: (mean, projection, E.table_bits(projection.shape[1]))}
    met = (E.table_keys(a, models, 64) == E.table_keys(b, models, 64)).any(axis=1)
    assert met.mean() >= 0.9


def shifted_pairs(dim, shared, n, cosine=0.955):
    """n unit vectors with a shared direction (mean cosine ``shared``), and one at ``cosine`` to each."""
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(n, dim)) / np.sqrt(dim) * np.sqrt(1 - shared)
    a[:, 0] += np.sqrt(shared)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * o


SHAPES = [(64, 0.5), (64, 0.7), (64, 0.9), (24, 0), (20, 0), (16, 0), (8, 0)]


@pytest.mark.parametrize("dim,shared", SHAPES)
def test_recall_with_a_shared_direction_and_short_vectors(dim, shared):
    a, b = shifted_pairs(dim, shared, 4_000)
    models = {dim: E.choose_tables(a, 0.95, 100_000)}
    assert (E.table_keys(a, models, dim) == E.table_keys(b, models, dim)).any(axis=1).mean() >= 0.95


def test_links_with_a_shared_direction_and_short_vectors(spark):
    rows, want = [], 0
    for dim, shared in [(64, 0.7), (24, 0), (16, 0)]:
        both = np.concatenate(shifted_pairs(dim, shared, 400))
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(both)]
        want += int((both @ both.T >= 0.95).sum()) - len(both)
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert 0.95 * want <= got.agg(F.sum("n_links")).first()[0] <= want


# --- pages ------------------------------------------------------------------------------------


def page(n, rng, article=True):
    words = lambda k: " ".join(f"w{rng.randrange(999)}" for _ in range(k))
    paragraphs = [words(rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
    if rng.random() < 0.5:
        paragraphs.append("The same closing line on many pages.")
    body = "".join(f"<p>{p} &amp; more<br></p>\n" if i % 2 else f"<p><b>{p} &amp;</b>  more" for i, p in enumerate(paragraphs))
    title = words(4)
    inner = f"<h1>{title}</h1>{body}"
    main = f"<article>{inner}</article>" if article else f'<div class="box{n}"><div class="text7">{inner}</div></div>'
    html = (f'<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p><article>x</article>";</script></head><body>'
            f'<header><a href="/">Home</a></header><nav><ul><li>{words(2)}<li>{words(3)}</ul></nav><!-- ad {n} --><div class="cookie-notice">Accept?</div>'
            f'<div class=ad>{words(9)}</div>{main}<aside>{words(5)}</aside><section id="comments"><article><p>Nice {words(30)}</p></article></section>'
            f'<form><p>Name</p><input></form><footer>&copy; {words(6)}</footer>' + ("</body></html>" if n % 2 else ""))
    return html, "\n".join([title, *(f"{p} & more" for p in paragraphs)])


def test_extract(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for n in range(60):
        html, text = page(n, rng, article=n % 3 != 0)
        rows.append((n, f"https://user@{['a', 'b', 'c'][n % 3]}.example.org:80/x/{n}?q", html))
        want[n] = text
    rows += [(100, None, None), (101, "no address", ""), (102, "http://d.example/", "just text\n here &lt;b&gt;"), (0, rows[0][1], rows[0][2]),
             (103, "http://a.example.org/", "<p>broken <b"), (None, "http://z/", "<article><p>x<script>y</article>")]
    want |= {100: "", 101: "", 102: "just text here <b>"}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("old")).withColumn("host", F.lit("old"))
    got = H.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id in want:
            assert r.text == want[r.page_id], r.page_id
    assert H.extract(df.limit(0)).count() == 0


def test_templates_choose_the_articles_slot(spark):
    rng = random.Random(7)
    rows = [(n, "http://h.example/p", page(n, rng)[0], "h.example", n) for n in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, mark bigint")
    chosen = H.templates(H.tokens(df)).collect()
    elements, _ = H.parse(rows[0][2])
    path = next(e.path for e, _, _ in elements if e.tag == "article" and not e.outside)
    assert [(r.host, r.main_path) for r in chosen] == [("h.example", H._signed(path))]


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(9_999)}" for _ in range(n))


def test_constant_text_under_neutral_names_is_not_the_articles(spark):
    rng, rows, want = random.Random(8), [], {}
    for n in range(12):
        said = [sentence(rng, 40) for _ in range(3)]
        inside = "".join(f"<p>{x}</p>" for x in said)
        rows.append((n, "http://plain.example/p", f'<html><body><div class=x7><p>Buy our book</p><p>Read more</p><p>Read more</p></div>'
                     f'<div class=q1><div class=x9><p>By the desk of letters</p></div>{inside}</div></body></html>'))
        want[n] = "\n".join(said)
    # copies of one page: nothing tells the template from the article
    rows += [(100 + n, "http://copies.example/p", rows[0][2]) for n in range(5)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {n: got[n] for n in want} == want
    assert all(want[0] in got[100 + n] for n in range(5))


@pytest.mark.parametrize("pages", [1, 9])
def test_all_sibling_articles_and_no_tiny_named_block(spark, pages):
    """Within a page (one page of a host) and by the host's template."""
    rng, rows, want = random.Random(9), [], {}
    for n in range(pages):
        said = [sentence(rng, 30 + 9 * k) for k in range(3)]
        forms = [("siblings", "".join(f"<article><p>{x}</p></article>" for x in said)),
                 ("inside", "<main>" + "".join(f"<article class=k{k}><p>{x}</p></article>" for k, x in enumerate(said)) + "</main>"),
                 ("blocks", "".join(f"<div class=text><p>{x}</p></div>" for x in said)),
                 ("tiny", f"<div id=main-header><p>{sentence(rng, 2)}</p></div><div class=zz>" + "".join(f"<p>{x}</p>" for x in said) + "</div>")]
        for k, (form, html) in enumerate(forms):
            rows.append((10 * n + k, f"http://{form}.example/{n}", f"<html><body><nav>Menu</nav>{html}</body></html>"))
            want[10 * n + k] = said
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i, said in want.items():
        assert [line for line in got[i].split("\n") if line in said] == said, rows[i % 10]


def wrapped(body, said):
    """Pages whose article stands in something with a boilerplate word in its name, by name."""
    return {"has": f'<div class="content has-sidebar">{body}</div>', "no": f'<div id=page class="no-sidebar">{body}</div>',
            "layout": f'<main><div class="col-main sidebar-right-layout">{body}</div></main>', "form": f'<form id=aspnet>{body}</form>',
            "named": f'<div class="promo"><div class="q">{body}</div></div>', "header": f"<article><div><header><h1>{said}</h1></header>{body}</div></article>",
            "related": f'<article>{body}<section class="related-work"><p>{said}</p></section></article>',
            "social": f'<div class="social-page"><article>{body}</article></div>', "newsletter": f'<body class="newsletter"><article>{body}</article>'}


@pytest.mark.parametrize("pages", [1, 5])
def test_articles_in_wrappers_with_boilerplate_words_stay(spark, pages):
    rng, rows, want = random.Random(10), [], {}
    for n in range(pages):
        said = [sentence(rng, 40) for _ in range(3)]
        extra = sentence(rng, 6)
        around = ('<nav>Menu</nav><aside>Side</aside><div class="cookie-notice">Accept?</div>', '<div class="sidebar">Latest</div><footer>End</footer>')
        for k, (name, html) in enumerate(wrapped("".join(f"<p>{x}</p>" for x in said), extra).items()):
            rows.append((100 * n + k, f"http://{name}.example/{n}", f"<html><body>{around[0]}{html}{around[1]}</body></html>"))
            want[100 * n + k] = "\n".join([extra] * (name == "header") + said + [extra] * (name == "related"))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_boilerplate_that_holds_most_of_the_text_goes_if_there_is_an_article():
    rng = random.Random(11)
    talk = "".join(f"<article><p>{sentence(rng, 60)}</p></article>" for _ in range(5))
    assert H.main_text(f"<body><article><p>short piece</p></article><section id=comments>{talk}</section></body>", None) == "short piece"
    inside = f'<article><p>short piece</p><div class="comments-area">{talk}</div><div class="share-links">Share</div></article>'
    assert H.main_text(f"<body>{inside}</body>", None) == "short piece"


def test_parse_time_is_linear():
    import time

    for page in ("<div>" * 5_000 + "</p>" * 20_000, "<center>" * 20_000 + "<p>x" * 20_000, "<p>" + "<h1>" * 20_000 + "</h2>" * 20_000,
                 "<ul>" + "<li><b>x" * 30_000, "<table>" + "<tr><td>y" * 20_000, '<div class="ad">' * 3_000 + "x"):
        began = time.process_time()
        H.main_text(page, None)
        assert time.process_time() - began < 5, page[:20]


def test_templates_equal_brute_force(spark):
    """Occurrence vectors compared as such, page by page, instead of by signatures."""
    rng = random.Random(12)
    rows = []
    for host in "abc":
        for n in range(rng.randint(2, 9)):
            side = "".join(f"<div class=s{k}><p>fixed {k}</p></div>" for k in range(3) if rng.random() < 0.9)
            inside = "".join(f"<p>{sentence(rng, 20)}</p>" for _ in range(rng.randint(1, 4)))
            rows.append((len(rows), f"http://{host}.example/", f"<html><body>{side}<div class=zz>{inside}</div></body></html>", f"{host}.example", len(rows)))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, mark bigint")
    got = {r.host: (r.main_path, r.meaning, sorted(r.constant)) for r in H.templates(H.tokens(df)).collect()}
    want = {}
    for host in {r[3] for r in rows}:
        pages = [H.page_tokens(r[2]) for r in rows if r[3] == host]
        vector = {t: tuple(p[t][0] if t in p else 0 for p in pages) for p in pages for t in p}
        every = sum(p[0][1] for p in pages)
        best, constant, size = None, [], 0
        for t, v in vector.items():
            seen = sum(x > 0 for x in v)
            if t == 0 or seen < H.LEAST_PAGES:
                continue
            chars = sum(p[t][1] for p in pages if t in p)
            meaning = max(p[t][2] for p in pages if t in p)
            meant = meaning > 0 and chars >= H.MEANT_TEXT * every
            mates = sum(u == v for k, u in vector.items() if k != 0)
            if seen < H.SUPPORT * len(pages) or chars == 0 or not (max(v) == 1 and mates >= H.LEAST_TOKENS or meant):
                continue
            if meaning == H.TEXT:
                constant.append(t)
                size += chars
                continue
            big = chars >= H.MOST_TEXT * every
            depth = max(p[t][3] for p in pages if t in p)
            best = max(best or (), (meaning if meant else 0, int(big), depth if big else 0, chars, t))
        if best:
            want[host] = (best[4], best[0], [] if size >= H.MOST_TEXT * every else sorted(constant))
    assert got == want and got
