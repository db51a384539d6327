"""Page text, URL rules and shards on small made pages, against plain Python."""

import time

import random

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.llm import html_text, ring_shards, url_filter

ARTICLE = "<article><h1>A title</h1><p>First words of it &amp; more<br>text<p>Second <b>bo</b>ld\n  block</article>"
PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Menu words here</a></li></ul></nav>'
    '<div class="ad">Buy these things now</div>{}<script>var t="</p> not text";</script><footer>&copy; somebody</footer></body></html>'
)
WANT = "A title First words of it & more text Second bold block"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (PAGE.replace("{}", ARTICLE), WANT),
        (PAGE.replace("{}", ARTICLE.replace("article", "section")), WANT),
        (PAGE.replace("{}", ARTICLE.replace("<p>Second", '<aside>See also this</aside><form>Your <input> mail</form><div class="cookie-notice">We use cookies</div><p>Second')), WANT),
        (PAGE.replace("{}", ARTICLE + '<section id="comments"><p>Great article, thank you so much for it</p></section>'), WANT),
        (PAGE.replace("{}", ARTICLE.replace("<p>Second", "<ul><li>one<li>two</ul><p>Second")), "A title First words of it & more text one two Second bold block"),
        (PAGE.replace("{}", "<header>Site name</header>" + ARTICLE.replace("<h1>", "<!-- x > y --><h1 data-x='a>b'>")), WANT),
        (PAGE.replace("{}", ""), ""), ("", ""), ("<p>a < b", "a < b"), ("no tags &lt;at all&gt;", "no tags <at all>"), ("<p>x<br/> y</p>", "x y"),
        ("<<<>>><p", "<<<>>>"), ("<p>a" * 3000, " ".join("a" * 3000)),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page, html_text.Weights()) == want


def test_extract_with_fitted_weights(spark):
    rows = [(k, f"http://h/{k}", PAGE.replace("{}", ARTICLE)) for k in range(5)] + [(5, None, None), (6, "u", ""), (6, "u", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = html_text.extract(pages).collect()
    want = [(k, f"http://h/{k}", WANT, len(WANT)) for k in range(5)] + [(5, None, "", 0), (6, "u", "", 0), (6, "u", "", 0)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert html_text.extract(pages.where("false")).count() == 0
    assert html_text.fit_weights(pages).tag("p") == html_text.LEAST_TAG


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def canonical(url):
    return f'<html><head><link href="{url}" rel="canonical"></head></html>'


def test_rules_and_aliases(spark):
    refresh = '<meta http-equiv="refresh" content="0; url=http://bad.net/fr/1?b=2&amp;a=1&amp;utm_source=x">'
    pages = [
        (1, "http://WWW.Example.com/en/1#x", "", "com", "www.example.com/en/", "allow"),
        (2, "https://m.example.com/en/1?x=1", None, "com", "example.com/en/", "block"),
        (3, "ftp://example.com/de/1", "", "com", "com/", "allow"),
        (4, "http://bad.net/fr/1?a=1&b=2", "", "net", "net/fr/", "block"),
        (5, "http://good.org/a", refresh, "org", None, "block"),  # redirects to a blocked page
        (6, "http://good.org/b", canonical("http://good.org/a"), "org", None, "block"),  # an alias of an alias
        (7, "http://good.com/c", canonical("//good.org/b"), "com", "com/", "allow"),  # its own rule comes first
        (8, "http://good.org/d/e", canonical("/f"), "org", None, "allow"), (9, None, "", None, None, "allow"), (10, "com/en/", "", None, None, "allow"),
        (11, "http://notexample.com", "", "com", None, "allow"), (11, "http://notexample.com", "", "com", None, "allow"),
        (12, "http://x.net?q=/es/", canonical("h#1"), "net", None, "allow"), (13, "http://good.org/a?utm_campaign=z#t", "", "org", None, "block"),
        (14, "http://net/es/", "", "net", "net/es/", "block"), (15, "://com/", "", "com", "com/", "allow"),
    ]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id bigint, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "a", "own")})
    got = url_filter.judge(df, RULES).collect()
    assert Counter((r.page_id, r.rule, r.verdict) for r in got) == Counter((p[0], p[4], p[5]) for p in pages)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[9].host, by[10].path, by[12].path) == ("www.example.com", "/en/1", "", "", "")
    assert by[6].alias_root == "bad.net/fr/1?a=1&b=2" and by[8].alias_root == "good.org/d/e" and by[3].alias_root is None
    assert url_filter.judge(df.where("false"), RULES).count() == 0


def test_one_address_with_a_third_of_all_pages_and_long_chains(spark):
    pages = spark.range(600).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") % 3 == 0, "http://hot.org/x").otherwise(F.concat(F.lit("http://c.org/"), F.col("id"))).alias("url"),
        F.when(F.col("id") % 3 == 0, F.lit(canonical("http://c.org/1"))).otherwise(
            F.concat(F.lit('<link rel=canonical href="http://c.org/'), F.col("id") + F.when(F.col("id") % 3 == 1, 1).otherwise(2), F.lit('">'))
        ).alias("html"),
    )
    got = url_filter.judge(pages, [("block", "c.org", "/599")]).collect()
    assert len(got) == 600 and {r.verdict for r in got} == {"block"}


def check_shards(rows, n, law="rows"):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards_of_odd_rows(odd_docs, odd_rows, no_docs):
    import zlib

    rows = ring_shards.shard_keys(odd_docs, ring_shards.Ring(4)).collect()
    check_shards(rows, 4)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert ring_shards.shard_keys(no_docs, ring_shards.Ring(4)).count() == 0


def test_shards_when_one_id_has_a_third_of_all_rows(spark):
    docs = spark.range(9001).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    check_shards(ring_shards.shard_keys(docs, ring_shards.Ring(40)).collect(), 40)


def test_overflow_goes_clockwise_and_growth_moves_little():
    rng = np.random.default_rng(4)
    keys = rng.integers(-(2**63), 2**63 - 1, 40_000, dtype=np.int64)

    def shards(n):
        ring = ring_shards.Ring(n)
        arc = ring.arc(keys)
        plan = sorted(ring.plan(dict(Counter(arc.tolist()))))
        out, k = np.zeros(len(keys), int), 0
        order = np.lexsort((keys, arc))
        starts = {a: i for i, a in reversed(list(enumerate(arc[order].tolist())))}
        for (a, rank, shard, _), after in zip(plan, [*plan[1:], (-1, 0, 0, 0)]):
            end = starts[a] + after[1] if after[0] == a else next((starts[x[0]] for x in plan[plan.index((a, rank, shard, _)) + 1 :] if x[0] != a), len(keys))
            out[order[starts[a] + rank : end]] = shard
        first = ring.owner[arc]
        return out, first

    a, home = shards(40)
    b, _ = shards(41)
    assert (a == home).mean() > 0.9  # most keys have room where the ring puts them
    assert (a != b).mean() < 0.2  # against 40 in 41 keys if they were dealt anew


@pytest.mark.parametrize(
    "page",
    [
        "<article class='post has-sidebar'><h1>Title</h1><p>{}</p></article>",
        "<main class='with-sidebar'><h1>Title</h1><p>{}</p></main>",
        "<main class='sidebar'><h1>Title</h1><p>{}</p></main>",
        "<div id='page' class='sidebar-right'><h1>Title</h1><p>{}</p></div>",
        "<div class='sidebar'><div><article><h1>Title</h1><p>{}</p></article></div></div>",
        "<div class='entry-header'><h1>Title</h1></div><p>{}</p>",
        "<section id='social-policy'><h1>Title</h1><p>{}</p></section>",
    ],
)
def test_names_of_wrappers_do_not_drop_the_article(page):
    words = " ".join(f"word{k}" for k in range(40))
    side = "<div class='widget-area'>side</div><div id='site-header'>top</div><ul class='shareButtons'><li>share</li></ul><div class='sidebar'>more</div>"
    for text in (page.format(words), side + page.format(words) + side):
        assert html_text.main_text(f"<html><body>{text}</body></html>", html_text.Weights()) == f"Title {words}"


def test_other_articles_beside_the_first_stay_out():
    page = (
        "<body><input class='search'><form id='aspnet'><article class='post has-sidebar'><p>own words here</p><article class='comment'><p>a comment</p></article>"
        "</article></form><div class='related'><article><p>a card</p></article></div></body>"
    )
    assert html_text.main_text(page, html_text.Weights()) == "own words here"
    assert html_text.main_text("<article style='display:none'><p>not to be seen</p></article>", html_text.Weights()) == ""


def test_many_rules(spark):
    """A hundred thousand rules, some hosts with thousands of them, against trying all rules."""
    rules = [("block" if k % 3 else "allow", f"h{k % 997}.example{'.org' if k % 2 else ''}", f"/{k % 50}/{k % 7}" if k % 5 else "/") for k in range(95_000)]
    rules += [("block", "big.net", f"/p{k}") for k in range(5_000)] + [("allow", "net", "/p1"), ("block", "org", "/p"), ("allow", "org", "/q")]
    urls = [f"https://{h}/{p}" for h in ("a.h5.example.org", "h6.example", "BIG.net", "x.y.big.net", "other.net", "org", "z.org") for p in ("", "5/5", "1/1x", "p17", "p4999/a?b", "p", "q/r")]
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls + [None, "no scheme"])], "page_id int, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    for k, url in enumerate(urls):
        host, _, path = url[8:].partition("/")
        host, path = host.lower(), ("/" + path).split("?")[0]
        fits = {(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)}
        best = min(fits, key=lambda f: (-len(f[0]), f[0], f[1]), default=(None, "allow"))
        assert got[k] == best, url
    assert got[len(urls)] == got[len(urls) + 1] == (None, "allow")


@pytest.mark.parametrize("page", [
    "<div class='ad'>" * 60_000 + "<article>hello there</article>", "<div>" * 60_000 + "</ul>" * 60_000, "<b><p>" * 80_000 + "</b>" * 80_000 + " end",
])
def test_time_grows_with_the_page_only(page):
    began = time.process_time()
    html_text.main_text(page, html_text.Weights())
    assert time.process_time() - began < 20  # seconds that a search through the open elements would exceed many times over


def test_run_is_the_best_of_all_runs():
    draw = random.Random(2)
    weights = html_text.Weights()
    for _ in range(300):
        page = "".join(draw.choice(["<p>", "</p>", "<div>", "</div>", "<td>", "one ", "two words ", "<nav>x", "</nav>", "<b>", "</b>", "<hr>"]) for _ in range(draw.randrange(1, 25)))
        seen = list(html_text.units(page))
        score = [
            (0 if beside else len(v.split())) if kind == "text" else -html_text.FENCE if kind == "fence" else 0 if beside else -weights.tag(v)
            for kind, v, beside, _ in seen
        ]
        best = max([sum(score[a:b]) for a in range(len(score)) for b in range(a + 1, len(score) + 1)], default=0)
        words = html_text.main_text(page, weights).split()
        runs = [
            [w for kind, v, beside, _ in seen[a:b] if kind == "text" and not beside for w in v.split()]
            for a in range(len(score)) for b in range(a + 1, len(score) + 1) if abs(sum(score[a:b]) - best) < 1e-9
        ]
        # blocks inside a run only part its words
        assert ("".join(words) in {"".join(r) for r in runs}) if best > 1e-9 else words == []
