import re
from html import unescape

from pyspark.sql import functions as F

from fraudloom.llm import html_text as H


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body>{body}</body></html>"


LONG = "This paragraph has enough words to be plain content of the page, more than the rest."


def test_regions():
    nav = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    want = f"Head & line\n\n{LONG}\n\nEnd."
    art = f"<h1>Head &amp; line</h1><p>{LONG}</p><p> End. </p>"
    for body in (
        f"{nav}<article>{art}</article><footer>&copy; all</footer>",
        f"<header>Site</header>{nav}<main>{art}</main><aside>More stories to read</aside>",
        f"<div id=menu>Home</div><div class='post-content'>{art}</div><div class='comments'><p>{LONG}</p></div><div class=sidebar>{LONG}</div>",
        f"<article>{art}<div class='ad'>Buy this thing now, it is good</div><form><label>Mail</label><input></form></article>",
        f"<div class='cookie-notice'><p>{LONG}</p></div><section>{art}</section>",
    ):
        assert H.main_text(page(body)) == want, body


def test_blocks_and_space():
    assert H.main_text("<p>a\n  b<br>c&nbsp;d</p><p><b>x<p>y") == "a b c d\n\nx\n\ny"
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("<p></p><script>x</script>") == ""
    assert H.main_text("just text &lt;here&gt; &#x41;") == "just text <here> A"
    assert H.main_text("<article><p>one<!-- hidden --> two</p></article") == "one two"
    assert H.main_text("<p>" + "word " * 50_000 + "</p>") == ("word " * 50_000).strip()
    assert H.main_text("<div>x" * 20_000).count("x") >= 0.6 * 20_000
    assert H.main_text("<section>" * 500 + "<p>x</p>" * 500).count("x") == 500
    assert H.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_smoothing():
    s = H.smooth([0.0, 0.0, 10.0, 0.0, 0.0])
    assert s[2] == max(s) and abs(s[1] - s[3]) < 1e-12 and H.smooth([5.0]) == [5.0]
    assert H.ratios([H.Line("abcd", 2), H.Line("ab", 0)]) == [2.0, 2.0]


def test_whole_table_against_the_template(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in H.query(spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for k, h in pages.items():
        art = re.search(r"<article>(.*?)(</article>|<footer>|$)", h, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x)))).strip() for x in re.split(r"</?(?:p|h1)>", art)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[k].text == want and got[k].n_chars == len(want)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, "<p>x</p>"), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in H.extract(df).collect()) == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("None", "x", 1)]
    assert H.extract(df.limit(0)).count() == 0


def test_nothing_of_the_article_is_lost():
    long, more = " ".join([LONG] * 6), " ".join([LONG] * 3)
    for body, want in (
        (f"<article><h1>Title</h1><p>Lead.</p><div class=body><p>{long}</p><p>{long}</p></div></article>", ["Title", "Lead.", long, long]),
        (f"<article><p>Intro</p><blockquote><p>{long}</p></blockquote><p>Rest</p></article>", ["Intro", long, "Rest"]),
        (f"<article><section><p>{long}</p></section><section><p>{more}</p></section></article>", [long, more]),
        (f"<article><p>{long}</p></article><article><p>{more}</p></article>", [long, more]),
        (f"<h1>Title</h1><article><p>{long}</p></article>", ["Title", long]),
        (f"<main><h1>Title</h1><article><p>{long}</p></article><p>After</p></main>", ["Title", long, "After"]),
        (f"<div><h1>T</h1><div class=text>{''.join(f'<p>{LONG}</p>' for _ in range(12))}</div></div>", ["T"] + [LONG] * 12),
        (f"<div><section><p>{long}</p></section><section><p>{more}</p></section></div>", [long, more]),
        (f"<div><p>In short.</p><table><tr><td>{long}</td></tr></table><p>Yes.</p></div>", ["In short.", long, "Yes."]),
        (f"<div><div>Plain text of other stories</div><div><article><p>{long}</p><p>b</p></article></div></div>", [long, "b"]),
    ):
        assert H.main_text(page(body)) == "\n\n".join(want), body


def test_names_alone_drop_nothing_of_an_article():
    long = " ".join([LONG] * 4)
    for body, want in (
        (f"<article><h1>T</h1><p>{long}</p><p class='side-effects'>Side effects are rare.</p></article>", ["T", long, "Side effects are rare."]),
        (f"<article><h1>T</h1><section id='share-prices'><p>{long}</p></section><p class='recommended-dose'>One a day.</p></article>", ["T", long, "One a day."]),
        (f"<article><header><h1>Title</h1></header><p>{long}</p></article>", ["Title", long]),
        (f"<article><div class='article-header'><h1>Title</h1></div><p>{long}</p></article>", ["Title", long]),
        (f"<form id=aspnetForm><nav>Home</nav><h1>T</h1><p>{long}</p><p>End.</p><label>Mail</label><input></form>", ["T", long, "End."]),
        (f"<form id=aspnetForm><article><p>{long}</p></article></form>", [long]),
        (f"<article><p>{long}</p></article><article><p>{LONG}</p></article>", [long, LONG]),
        (f"<div><a href=/>Home</a> | <a href=/n>News</a></div><p>{long}</p><p>Short.</p><p>{long}</p><div>(c) 2020</div>", [long, "Short.", long]),
        (f"<h1>T</h1><div>Home | News</div><p>{long}</p><h3>More</h3><ul><li><a href=/a>one story</a></li></ul>", ["T", long]),
        (f"<article><p>{long}</p><section><h2>Comments</h2></section></article><section class=comments><article><p>{long} No!</p></article></section>", [long, "Comments"]),
        (f"<div class='content-with-sidebar'><div class=text><p>{long}</p></div><div class='sidebar right'><p>{long} Or not.</p></div></div>", [long]),
        (f"<div class='page-wrapper comments'><main><p>{long}</p></main></div>", [long]),
        (f"<article><p>{long}</p><div class='share-links'><a href=/f>Share on one</a></div><div class='related-posts'><p>{long} Another.</p></div><p>End.</p></article>", [long, "End."]),
        (f"<article><p>{long}</p><section class='reader-comments'><p>{long} So they say.</p></section><div id='google_ads_top'>Buy this thing now, it is good</div><p class='newsletter-sales'>Sales rose.</p></article>", [long, "Sales rose."]),
        (f"<div class=left><h3>Popular</h3><ul><li><a href=/a>one story</a></li><li><a href=/b>other</a></li></ul></div><div><h1>T</h1><h2>Sub</h2><p>{long}</p></div>", ["T", "Sub", long]),
        (f"<div><p>{long}</p><ul><li>one thing to note</li><li>two</li></ul><p>{long}</p></div>", [long, "one thing to note", "two", long]),
    ):
        assert H.main_text(page(body)) == "\n\n".join(want), body


def test_templates_with_known_articles():
    """Pages put together from random paragraphs and boilerplate: the article comes back whole and alone."""
    import random

    r = random.Random(12)
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt".split()
    say = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b))).capitalize() + "."
    menu = lambda: "<ul>" + "".join(f"<li><a href=/{k}>{r.choice(words)}</a></li>" for k in range(r.randint(2, 9))) + "</ul>"
    for k in range(300):
        title, paras = say(3, 8), [say(*r.choice([(3, 6), (20, 60), (40, 120)])) for _ in range(r.randint(3, 12))]
        paras.insert(0, say(40, 120))
        body = "".join(r.choice([f"<p>{x}</p>", f"<p>\n  {x.replace(' ', '  ', 1)}</p>", f"<p><b>{x.split()[0]}</b> {' '.join(x.split()[1:])}</p>" if " " in x else f"<p>{x}"]) for x in paras)
        noise = [f"<div class='{c}'><p>{say(30, 90)}</p></div>" for c in r.sample(["comments", "sidebar", "ad", "cookie-notice", "related-posts", "newsletter signup", "comment-list"], 3)]
        art = r.choice([f"<article><h1>{title}</h1>{body}</article>", f"<main><article><header><h1>{title}</h1></header>{body}</article></main>",
                        f"<div class=story-text><h1>{title}</h1>{body}</div>", f"<h1>{title}</h1><div>{body}</div>", f"<section><h1>{title}</h1><section>{body}</section></section>"])
        html = page(r.choice([f"<nav>{menu()}</nav>", f"<div class=menu>{menu()}</div>", f"<header>Site {menu()}</header>"]) + noise[0] + art + noise[1] + noise[2] + r.choice(["<footer>(c) Site</footer>", f"<div id=footer>{menu()}</div>", ""]))
        assert H.main_text(html) == "\n\n".join([title, *paras]), html


def test_clusters_by_hand():
    """Ratio, smoothing and threshold worked out anew, on lines whose clusters are plain to see."""
    sizes = [(4, 4), (6, 4), (5, 6), (300, 2), (280, 4), (30, 2), (310, 2), (8, 6), (5, 6)]
    lines = [H.Line("x" * n, t) for n, t in sizes]
    x = [n / t for n, t in sizes]
    s = []
    for i in range(len(x)):
        w = [2.718281828459045 ** (-((i - j) ** 2) / 2) if abs(i - j) <= 3 else 0.0 for j in range(len(x))]
        s.append(sum(a * b for a, b in zip(w, x)) / sum(w))
    mean = sum(s) / len(s)
    dev = (sum((v - mean) ** 2 for v in s) / len(s)) ** 0.5
    assert H.content(lines) == [v >= mean - dev for v in s] == [False, False, True, True, True, True, True, True, False]
    assert [len(y.text) for y in H.select(lines)] == [300, 280, 30, 310]
