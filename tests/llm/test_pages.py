"""Main text, URL filter and quality classifier."""

import time

import fixtures
import numpy as np
import pytest
from placeloom.llm import html_text, quality_model, url_filter
from placeloom.session import materialize_with
from pyspark.sql import functions as F

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two  lines\n here", "one\ntwo lines here"),
        ("<body><nav><a>menu</a></nav><article><h1>T</h1><p>a <b>b</b>&nbsp;c<br>d</article><footer>f</footer>", "T\na b c d"),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>yes", "yes"),
        ("<div class='ad'><p>buy</p></div><div id=main><p>text &lt;here&gt; &#233;</p></div>", "text <here> é"),
        ("<article><p>kept</p><div class=comments><p>reader</p></div><aside>side</aside><form>f<input></form></article>", "kept"),
        ("<p>cut off &am", "cut off &am"),
        ("<p>cut off</p><p", "cut off"),
        ("<article><p>a</p><!-- <p>no</p> --><p>b", "a\nb"),
        ("<main><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></main>", "x\ny\n1\n2"),
        ("<p title='a > b'>quoted</p>", "quoted"),
        ("</p></div><p>stray", "stray"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_densest_part_without_marks():
    links = "".join(f"<li><a href=/{k}>Section number {k}</a></li>" for k in range(20))
    body = "".join(f"<p>{fixtures.prose(k, 40)}</p>" for k in range(6))
    page = f"<body><div><ul>{links}</ul></div><div class=x><h2>Head</h2>{body}</div><div>Imprint</div></body>"
    want = "\n".join(["Head", *[fixtures.prose(k, 40) for k in range(6)]])
    assert html_text.main_text(page) == want


def paragraphs(mark, count, size, link=""):
    return "".join(f"<p>{mark}{k} {link}{'x' * (size - len(mark) - len(str(k)))}</p>" for k in range(count))


@pytest.mark.parametrize("link", ["", "<a href=/n>inline</a>"])
@pytest.mark.parametrize("menu", ["", "<ul>" + "".join(f"<li><a href=/{k}>Topic number {k}</a>" for k in range(15)) + "</ul>"])
def test_article_in_unmarked_sections(menu, link):
    """Sections beside the densest one stay; lists of links and thin parts go."""
    sections = [paragraphs("a", 10, 500), "<h2>Next</h2>" + paragraphs("b", 5, 420, link), paragraphs("c", 4, 400)]
    teasers = "".join(f"<p><a href=/t{k}>teaser {'y' * 600}</a></p>" for k in range(3))
    body = "".join(f"<div>{x}</div>" for x in sections)
    got = html_text.main_text(f"<html><body>{menu}<div>{body}</div><div>{teasers}</div><div>Imprint</div></body>")
    marks = [line[:2] if line != "Next" else line for line in got.split("\n")]
    assert marks == [f"a{k}" for k in range(10)] + ["Next"] + [f"b{k}" for k in range(5)] + [f"c{k}" for k in range(4)]


def test_two_unmarked_sections_by_hand():
    """Path minimum 368, second section 400."""
    page = f"<html><body><div><div>{paragraphs('a', 10, 500)}</div><div>{paragraphs('b', 5, 400)}</div></div></body>"
    assert html_text.main_text(page).count("\n") == 14


def test_innermost_article_without_teasers():
    teasers = "".join(f"<div><h3>More</h3><p>teaser {k}</p></div>" for k in range(4))
    article = f"<article><p>Lead</p><div>{paragraphs('a', 6, 300)}</div></article>"
    second = f"<section>{paragraphs('s', 3, 300)}</section>"
    got = html_text.main_text(f"<main><h1>Title</h1>loose {'x' * 200}{article}{second}<div>{teasers}</div></main><p>{'z' * 900}</p>")
    want = ["Title", "l", "Lead", *["a"] * 6, *["s"] * 3]
    assert [line[:1] if "x" in line else line for line in got.split("\n")] == want


WRAPPERS = [
    "content has-sidebar", "layout-no-sidebar", "post has-comments", "has-header-image", "page-with-menu",
    "main side-by-side", "site-search-results", "sidebar-left", "header-fixed", "no-ads", "widget-area",
]


@pytest.mark.parametrize("mark", [f'div class="{c}"' for c in WRAPPERS] + ['form id="aspnetForm"', 'body class="menu-open"'])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_named_after_parts_keep_the_page(mark, inner):
    """A class that tells what a page has, or a form around everything, is no part beside the article."""
    tag = mark.split()[0]
    text = paragraphs("a", 4, 140)
    page = f"<body><{mark}><nav><a href=/>Home</a></nav><{inner}>{text}</{inner}><div class=comments><p>me too</p></div></{tag}></body>"
    assert html_text.main_text(page).count("\n") == 3 and len(html_text.main_text(page)) >= 560


@pytest.mark.parametrize("part", ["sidebar", "main-sidebar", "site-footer", "comments", "comment-list", "cookie-notice", "related-posts", "ad"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_marked_parts_go(part, inner):
    beside = f'<div class="{part}">' + paragraphs("z", 3, 120) + "</div>"
    for page in (f"<{inner}>{paragraphs('a', 5, 200)}</{inner}>{beside}", f"{beside}<{inner}>{paragraphs('a', 5, 200)}{beside}</{inner}>"):
        got = html_text.main_text(f"<body><div>{page}</div></body>")
        assert [line[0] for line in got.split("\n")] == ["a"] * 5


def test_comments_longer_than_the_article_go():
    comments = "".join(f"<li><article class=comment-body><p>z{'y' * 200}</p></article>" for _ in range(20))
    for inner in ("article", "div"):
        page = f"<body><{inner}>{paragraphs('a', 6, 300)}</{inner}><ol class='comment-list'>{comments}</ol></body>"
        assert [line[0] for line in html_text.main_text(page).split("\n")] == ["a"] * 6
    assert html_text.main_text("<nav><p>only a menu</p></nav>") == "only a menu"


def test_given_pages_without_their_article_marks():
    """Renaming the marks to plain blocks leaves all but a few of the same words."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    both = total = plain = 0
    for page in pages:
        if page:
            marked = html_text.main_text(page).split("\n")
            renamed = html_text.main_text(page.replace("<article", "<div").replace("</article>", "</div>")).split("\n")
            both += sum(len(x) for x in set(marked) & set(renamed))
            total, plain = total + sum(map(len, set(marked))), plain + sum(map(len, set(renamed)))
    assert both > 0.97 * total and both > 0.97 * plain


@pytest.mark.parametrize(
    "page",
    [
        '<p>a <b class="' + "x" * 1_000_000,
        "<p>a <b " + "x" * 1_000_000,
        "<p>a <b " + "x = " * 250_000,
        "<div>a" * 170_000,
        "<p><table><tr><td>" + "<div>a" * 150_000,
        "<b>a" * 250_000 + "</i>" * 250_000,
        "<p>a</section>" * 70_000,
        "<div>" * 80_000 + "<p>x" * 50_000,
        "<ul><li>a" * 110_000,
        "&" * 1_000_000,
        "a < b " * 160_000,
        "<!-- x" * 160_000,
        "<script>" * 120_000,
        "<b '>a" * 160_000,
    ],
    ids=range(14),
)
def test_a_megabyte_of_anything_is_read_once(page):
    """In time in proportion: a tenth of the page takes more than a thirtieth of the time."""

    def seconds(text):
        began = time.process_time()
        html_text.main_text(text)
        return time.process_time() - began

    assert seconds(page) < 10 + 30 * seconds(page[: len(page) // 10])


def test_long_and_deep_pages():
    assert len(html_text.main_text("<div>" * 5000 + "x" + "</div>" * 5000)) == 1
    many = "".join(f"<p>{k}</p>" for k in range(20000))
    assert html_text.main_text(many).count("\n") == 19999
    assert html_text.main_text('<p>a <b class="' + "x" * 200_000) == "a"


def test_extract_keeps_rows(spark):
    rows = [(1, "u", "<p>a"), (None, None, None), (1, "u", "<p>a")]
    pages = fixtures.with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = html_text.extract_text(pages)
    assert sorted((str(r.page_id), r.text) for r in got.collect()) == [("1", "a"), ("1", "a"), ("None", "")]
    assert html_text.extract_text(pages.limit(0)).collect() == []


@pytest.fixture(scope="module")
def fitted(spark):
    return url_filter.train(url_filter.default_labels(spark))


def test_url_parts_and_rules(spark, fitted):
    cases = {
        "http://a.NET/x": ("a.net", "/x", "net/", "block"),
        "https://b.example.net/en/1?q=/de/": ("b.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.com/de/a#b": ("example.com", "/de/a", "example.com/de/", "block"),
        "http://notexample.com/de/a": ("notexample.com", "/de/a", None, None),
        "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://x.net": ("x.net", "", None, None),
        "http://x.net?a": ("x.net", "", None, None),
        "a/b://c.org/fr/://d": ("c.org", "/fr/://d", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "http:///p": ("", "/p", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    urls = fixtures.with_clashes(spark.createDataFrame([(u,) for u in cases], "url string"))
    for r in url_filter.judge(urls, fitted, RULES).collect():
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))
    assert url_filter.judge(urls.limit(0), fitted, RULES).collect() == []


def plain_judgement(url):
    """Host, path, rule and its verdict of a url, step by step."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    ends = [rest.index(c) for c in "/?#" if c in rest]
    host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    stops = [tail.index(c) for c in "?#" if c in tail]
    path = tail[: min(stops, default=len(tail))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for verdict, rule in RULES:
        own, slash, part = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + part):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_five_thousand_urls_against_plain_rules(spark, fitted):
    rng = np.random.default_rng(8)
    pick = lambda values: values[rng.integers(len(values))]
    urls = []
    for _ in range(5000):
        host = pick(["", "www.", "A.B.", "x-", "ü."]) + pick(["example", "EXAMPLE", "other", "net", "org"]) + pick([".net", ".com", ".org", ".Net", ""])
        path = pick(["", "/", "/en/", "/de/", "/fr/", "/en", "//en/", "/EN/"]) + pick(["", "a.html", "1840/", "?q=/fr/", "#/de/", "://x.org/fr/"])
        urls.append(pick(["http://", "https://", "://", "", "a/b://", "://://"]) + host + path)
    rows = [(k, u) for k, u in enumerate(urls + [None, "", "://", "http:///", "http://?", "x"])]
    got = url_filter.judge(spark.createDataFrame(rows, "k long, url string"), fitted, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = plain_judgement(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert host or rule or r.verdict == "allow"


def test_url_model_scores_by_hand(spark, fitted):
    """The verdict is the logistic function of the weights of the hashed n-grams."""
    urls = spark.createDataFrame([("http://casino.example.com/en/1",), ("http://garden.example.com/en/1",)], "url string")
    made = url_filter.features(
        urls, url_filter.host_of(urls.url), url_filter.path_of(urls.url), url_filter.UrlModel()
    ).collect()
    judged = {r.url: r for r in url_filter.judge(urls, fitted, []).collect()}
    weights = fitted.coefficients.toArray()
    for r in made:
        score = float(weights[r["_url_features"].indices].sum() + fitted.intercept)
        assert judged[r.url].reject_probability == pytest.approx(1 / (1 + np.exp(-score)))
    assert [judged[u].verdict for u in sorted(judged)] == ["block", "allow"]


def test_url_model_after_an_observation(spark, fitted):
    """A session that has observed a write keeps objects that cannot be sent to executors."""
    materialize_with(spark.range(3), "seen", n=F.count(F.lit(1)))
    own = url_filter.train(url_filter.default_labels(spark))
    urls = spark.createDataFrame([("http://casino.example.com/en/1",)], "url string")
    assert [r.verdict for r in url_filter.judge(urls, own, []).collect()] == ["block"]


def test_url_model_on_unseen_hosts(spark, fitted):
    bad = ["mega-casino.example.com", "pills-cheap.example.org", "www.adult-zone.example.com", "bets-free.example.org"]
    good = ["www.rowing.example.com", "blog.letters.example.org", "m.hills.example.com", "archive.example.org"]
    urls = spark.createDataFrame([(f"http://{h}/en/{k}.html",) for k, h in enumerate(bad + good)], "url string")
    got = {r.host: r.verdict for r in url_filter.judge(urls, fitted, []).collect()}
    assert all(got[h] == "block" for h in bad) and all(got[h] == "allow" for h in good)


def rated(spark):
    rows, marks = [], []
    for k in range(300):
        grade = k % 3
        words = fixtures.prose(k, 40).split()
        extra = [["zz", "qq"], ["qq"], []][grade]
        rows.append((k, " ".join(words + extra * 3), "en", "s", 1))
        marks.append((k, grade))
    return fixtures.frame(spark, rows), spark.createDataFrame(marks, "doc_id long, grade int")


def test_ordinal_model_on_held_out_rows(spark):
    docs, ratings = rated(spark)
    seen = ratings.where("doc_id < 200")
    model = quality_model.train(docs, seen, seen.grade)
    assert (np.diff(model.thresholds) > 0).all()
    scored = quality_model.score(docs.where("doc_id >= 200"), model).collect()
    right = [round(r.expected_grade) == r.doc_id % 3 for r in scored]
    assert np.mean(right) > 0.85
    tails = [[r.tail_probability for r in scored if r.doc_id % 3 == g] for g in range(3)]
    assert np.mean(tails[0]) < np.mean(tails[1]) < np.mean(tails[2])


def test_ordinal_gradient_lowers_the_loss():
    rng = np.random.default_rng(1)
    text_of, number = np.repeat(np.arange(200), 5), rng.integers(0, 16, 1000)
    grades = (np.bincount(text_of, number == 3, 200) + np.bincount(text_of, number == 4, 200)).clip(0, 2).astype(np.int64)
    settings = quality_model.OrdinalSettings(bits=4, rounds=300)
    model = quality_model.fit(text_of, number, np.ones(1000), grades, settings)
    reach = model.reach(np.bincount(text_of, model.weights[number], 200))
    assert ((reach >= 0.5).sum(axis=1) == grades).mean() > 0.95


def plain_loss(weights, thresholds, text_of, number, value, grades, ridge):
    """Mean of the negative logarithms of the chances of the grades, one text at a time."""
    total = 0.0
    for k, grade in enumerate(grades):
        score = sum(weights[j] * v for t, j, v in zip(text_of, number, value) if t == k)
        below = [0.0, *[1 / (1 + np.exp(score - b)) for b in thresholds], 1.0]
        total -= np.log(below[grade + 1] - below[grade])
    return total / len(grades) + ridge / 2 * sum(w * w for w in weights)


def test_ordinal_fit_is_a_minimum_of_the_plain_loss():
    """Finite differences of a loss written apart are flat at the fitted weights and thresholds."""
    rng = np.random.default_rng(5)
    text_of, number = np.repeat(np.arange(60), 3), rng.integers(0, 8, 180)
    grades = np.minimum(np.bincount(text_of, number >= 5, 60).astype(int) + (rng.random(60) < 0.3), 2)
    settings = quality_model.OrdinalSettings(bits=3, rounds=4000, step=0.01, ridge=0.05)
    model = quality_model.fit(text_of, number, np.ones(180), grades, settings)
    params = np.concatenate([model.weights, model.thresholds])

    def loss(p):
        return plain_loss(p[:8], p[8:], text_of, number, np.ones(180), grades, 0.05)

    for k in range(len(params)):
        step = np.zeros(len(params))
        step[k] = 1e-4
        assert abs(loss(params + step) - loss(params - step)) / 2e-4 < 2e-3
        assert loss(params) < loss(params + 1000 * step) and loss(params) < loss(params - 1000 * step)


def test_ordinal_scores_by_hand(spark):
    docs, ratings = rated(spark)
    model = quality_model.train(docs, ratings.where("doc_id < 100"), ratings.grade)
    row = docs.where("doc_id = 200").first()
    got = quality_model.score(docs.where("doc_id = 200"), model).first()
    _, number, value = quality_model.features([row.text.encode()], model.bits)
    score = sum(model.weights[j] * v for j, v in zip(number.tolist(), value.astype("<f4").tolist()))
    reach = [1 - 1 / (1 + np.exp(score - b)) for b in model.thresholds]
    assert got.expected_grade == pytest.approx(sum(reach), abs=1e-4)


def test_ordinal_model_on_odd_rows(spark):
    docs, ratings = rated(spark)
    odd = spark.createDataFrame([(None, 1), (1, None), (0, 0), (0, 2)], "doc_id long, grade int")
    model = quality_model.train(docs, ratings.unionByName(odd), ratings.grade)
    scored = quality_model.score(fixtures.with_clashes(fixtures.frame(spark, fixtures.odd_documents())), model).collect()
    assert len(scored) == len(fixtures.odd_documents())
    assert not any(r.kept for r in scored if r.doc_id in (5, 6, 7))
    none = quality_model.train(docs, ratings.limit(0), ratings.grade)
    assert quality_model.score(docs, none).count() == 300
    assert quality_model.score(docs.limit(0), model).collect() == []
