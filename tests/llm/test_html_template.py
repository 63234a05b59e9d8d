import re

from cuelog.llm.html_template import extract_text, layout_of, read_page
from cuelog.llm.queries import op3_html_extraction

SF = "/root/testdata/sf0.01"


def _page(k, body, host="a.example", extra=""):
    return (k, f"http://{host}/{k}", f"<html><head><title>t{k}</title><style>p{{}}</style></head><body class='has-sidebar'><div class=top><a href=/>Home</a></div>"
            f"<div class=mid><div class=txt>{body}</div><p>Read our terms</p></div>{extra}</body></html>")


def test_blocks():
    page = read_page("<p>a &amp; b<b>c<br>d<p>e</p><script>var x='</p>';</script><!-- <p>no</p> --><ul><li>f<li>g</ul>h<i>i</i>&nbsp;j<p cut")
    assert [b.text for b in page.blocks] == ["a & bc d", "e", "f", "g", "hi j"]
    assert read_page(None).blocks == [] and read_page("").blocks == []
    assert [b.text for b in read_page("1 < 2 <3 x &lt;p&gt;").blocks] == ["1 < 2 <3 x <p>"]


def test_parts_that_are_not_the_article():
    source = ("<header>H</header><nav>N</nav><div role=search>S</div><main><article><header><h1>T</h1></header><p>one</p><div class='ad-box'>A</div><aside>B</aside><p>two</p>"
              "<form>F</form><div class='commentList'><article>C</article></div><div class=\"comments\">D<div>E</div></div><p>three</p></article></main><div id=cookieNotice>K</div><footer>Z</footer>")
    assert [b.text for b in read_page(source).blocks] == ["T", "one", "two", "three"]


def test_self_closed_icons():
    blocks = lambda source: [b.text for b in read_page(source).blocks]
    assert blocks("<header><button><svg class='i' viewBox=\"0 > 1\"/></button></header><article><p>one <math/>two</p><p>a<svg ><path/><text>no</text></svg>b</p><SVG/><p>three</p></article>") == ["one two", "ab", "three"]
    assert blocks("<p>a<svg><path d='x'/></svg>b<svgx/>c</p>") == ["ab", "c"]


def test_articles_beside_and_inside_the_own_one():
    blocks = lambda source: [b.text for b in read_page(source).blocks]
    own = "<article class='post'><p>one</p><article class=comment><p>C</p></article><p>two</p></article>"
    assert blocks(f"{own}<article class='comment'>D</article><article class='teaser card'>E</article><article role=complementary>F</article>") == ["one", "two"]
    assert blocks("<article class='article comment'>D</article><article class='article'>own</article>") == ["own"]
    assert blocks("<article class='card'><h1>T</h1><p>one</p><article class='card'>E</article></article>") == ["T", "one"]
    assert blocks("<article class='post tag-promo category-ads'>one</article><article class='item'>two</article>") == ["one", "two"]
    assert blocks("<article class='post'>one</article><article>two</article>") == ["one", "two"]


def test_templates(spark):
    pages = [_page(k, f"<p>body {k} of the page {'word ' * (20 + k)}</p><p>more {k}</p>") for k in range(8)]
    pages += [(20, "http://b.example/1", "<p>only <a href=x>one</a> page here</p><p><a href=y>all link</a></p>"), (21, None, "<article>x</article>"), (22, "http://a.example/q", None), (None, "http://a.example/0", pages[0][2])]
    pages += [_page(40 + k, "<p>the same text</p>", "copies.example") for k in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 text", "'x' host")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(df).collect()}
    for k in range(8):
        text = f"body {k} of the page {'word ' * (20 + k)}".strip() + f"\n\nmore {k}"
        assert got[k] == (text, len(text))
    assert got[None] == got[0] and got[22] == ("", 0) and got[21] == ("x", 1)
    assert got[20][0] == "only one page here" and "the same text" in got[40][0]
    assert extract_text(df.limit(0)).count() == 0


def test_same_passage_in_every_article_of_a_host(spark):
    body = lambda k: f"<article><h1>Report</h1><p>body {k} of the page {'word ' * (20 + k)}</p><p>Licensed to all</p></article>"
    df = spark.createDataFrame([_page(k, body(k)) for k in range(8)], "page_id long, url string, html string")
    for r in extract_text(df).collect():
        assert r.text.split("\n\n") == ["Report", f"body {r.page_id} of the page {'word ' * (20 + r.page_id)}".strip(), "Licensed to all"]


def _extracted(spark, sources, host="n.example"):
    df = spark.createDataFrame([(k, f"https://{host}/{k}", s) for k, s in enumerate(sources)], "page_id long, url string, html string")
    return {r.page_id: r.text.split("\n\n") for r in extract_text(df).collect()}


def _prose(k, n=30):
    return " ".join(f"word{(k * 37 + i * i) % 101}" for i in range(n + k))


def test_layouts_of_one_host(spark):
    """Pages without an article element, in two layouts: each has a slot of its own, deduced."""
    post = lambda k: f"<body><div class=bar>Site {k}</div><div class=post><h1>Title {k}</h1><div class=txt><p>{_prose(k)}</p><p>end {k}</p></div></div><div class=more><p>other {k}</p></div>{'<div class=ad>A</div>' * (k % 2)}</body>"
    item = lambda k: f"<body><section class=shop><div class=price>{k} coins</div><div class=story><p>{_prose(k, 40)}</p></div></section></body>"
    assert layout_of(post(1)) == layout_of(post(2)) != layout_of(item(1)) == layout_of(item(2) + "<footer>f") and layout_of(None) == layout_of("")
    got = _extracted(spark, [post(k) if k % 3 else item(k) for k in range(18)])
    for k in range(18):
        assert got[k] == ([f"Title {k}", _prose(k), f"end {k}"] if k % 3 else [_prose(k, 40)])


def test_notices_inside_the_article(spark):
    """An element that says the same on all its pages goes, title and repeated sentences stay."""
    box = "<div class=x1><h3>Dear reader</h3><p>Tell your friends.</p></div>"
    page = lambda k: (f"<article><h1>Weekly report</h1>{box if k % 4 else ''}<p>{_prose(k)}</p><p>Licensed to all</p><h2>Sources</h2><ul>{f'<li>s{k}' * 2}</ul><div>All rights of this site reserved</div></article>")
    got = _extracted(spark, [page(k) for k in range(12)])
    for k in range(12):
        assert got[k] == ["Weekly report", _prose(k), "Licensed to all", "Sources", f"s{k}", f"s{k}"]


def test_copies_are_no_template(spark):
    page = f"<body><div class=a><h1>T</h1><div class=txt><p>{_prose(3)}</p></div></div><div class=b>and b</div></body>"
    copies = _extracted(spark, [page] * 6)
    assert all(t[:2] == ["T", _prose(3)] for t in copies.values())
    # six copies of one article on a host with others: its paragraphs are no template either
    own = lambda k: f"<article><h1>T{k}</h1><p>{_prose(k)}</p></article>"
    mixed = _extracted(spark, [own(3)] * 6 + [own(k) for k in range(4, 7)])
    assert all(mixed[k] == ["T3", _prose(3)] for k in range(6)) and mixed[7] == ["T5", _prose(5)]


def test_whole_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html
    for r in op3_html_extraction(spark, SF).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*$", "", inside))]
        assert r.text == "\n\n".join(b for b in blocks if b)
