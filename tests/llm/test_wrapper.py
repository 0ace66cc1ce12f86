from collections import Counter, defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import wrapper

SCHEMA = "page_id LONG, url STRING, html STRING, host STRING, part STRING, order STRING, text STRING, parts STRING"


def text(page):
    return wrapper.main_text(wrapper.Page(page), None)[0]


def induced(htmls):
    """The template of a host's pages, made in memory."""
    known, nodes, words = {}, defaultdict(lambda: [set(), 0, 0, None, None]), defaultdict(lambda: [set(), 0, 0])
    for h in htmls:
        for path, parent, label, key, times, chars, links in wrapper.statistics(wrapper.Page(h), known):
            x = nodes[path] if key is None else words[path, key]
            x[0].add(h)
            x[1] += times if key is None else chars
            x[2] += 1 if key is None else links
            if key is None:
                x[3:] = parent, label
    n = len(set(htmls))
    if n < 2:
        return None
    common, mass = wrapper.least(n), defaultdict(lambda: [0, 0])
    for (path, _), (pages, chars, links) in words.items():
        if len(pages) < common:
            mass[path][0] += chars
            mass[path][1] += links
    kept = [(path, x[3], x[4], x[1] / x[2], *mass[path]) for path, x in nodes.items() if len(x[0]) >= common]
    return wrapper.Template(kept, [key for (_, key), x in words.items() if len(x[0]) >= common])


def texts(htmls, template):
    return [wrapper.main_text(wrapper.Page(h), template)[0] for h in htmls]


def test_article_alone():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style><script>var a="</p><article>no</article>";</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <div class="ad banner">Buy</div><div class="cookie-notice">Cookies</div><aside>Side</aside><article><header><h1>A &amp; B&#33;</h1></header><p>One\n two<p>Thr<b>ee</b>&nbsp;four<br>five</p><ul><li>x<li>y</ul><form>Search</form>
    <table><tr><td>c1<td>c2</table><!-- hidden <p>no</p> --><div class="ads">No</div></article><section id="comments"><article class="comment">Nice!</article></section><footer>(c)</footer></body></html>"""
    assert text(page) == "A & B!\nOne two\nThree four\nfive\nx\ny\nc1\nc2"


def test_without_article():
    page = '<body><div id="menu">m</div><div class="post-content"><p>Body</p><div class="share">s</div></div><div class="sidebar">x</div></body>'
    assert text(page) == "Body"
    assert text("<body><nav>n</nav><p>Just <i>this</i></p><footer>f</footer>") == "Just this"


def test_odd_markup():
    for page in ("", "<", "<p", "<a href='x>y", "<!--", "<script>x", "</p></div>", "<" * 400, "<a b=c d e='f'"):
        assert isinstance(text(page), str)
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("<p>" * 3000 + "t") == "t"
    assert text(None) == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "text", "<li>", "<td>", "<table>", "</table>", "<article>", "</article>", "<", ">", "&amp;", "<!--", "-->", "<script>", "</script>"]), max_size=40))
def test_never_raises(parts):
    assert isinstance(text("".join(parts)), str)


def test_constant_nodes_are_template(spark):
    page = "<body><div>Our site</div><div><h2>{0}</h2><p>{0} text</p></div><span>All rights</span></body>"
    rows = [(k, f"http://h.example/{k}", page.format(f"w{k}"), *["x"] * 5) for k in range(9)] + [(100, None, "<p>a", *["x"] * 5), (None, "nonsense", None, *["x"] * 5), (7, "http://h.example/7", page.format("w7"), *["x"] * 5)]
    got = wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[k].text == f"w{k}\nw{k} text" and by[k].n_chars == len(by[k].text) and by[k].template_nodes > 0 for k in range(9))
    assert by[100].text == "a" and by[None].text == "" and by[None].n_chars == 0


def test_shared_articles_stay(spark):
    """Equal articles of one host are no template."""
    rows = [(k, "http://h/x", "<nav>n</nav><article><p>Same</p></article>", *["x"] * 5) for k in range(6)]
    assert {r.text for r in wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"Same"}


def test_empty_and_large_hosts(spark):
    assert wrapper.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(k, "http://one/", f"<body><div>Head</div><p>t{k}</p></body>", *["x"] * 5) for k in range(300)]
    assert {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {k: f"t{k}" for k in range(300)}


def normal(node):
    """(label, children in the order of their labels), siblings of one label made one."""
    groups = defaultdict(list)
    for k in node if isinstance(node, list) else [node]:
        for e in k.elements():
            groups[e.label()].append(e)
    return [(label, normal(groups[label])) for label in sorted(groups)]


def matching(a, b):
    """Simple tree matching of two lists of children, by its table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, (x, inner) in enumerate(a, 1):
        for j, (y, other) in enumerate(b, 1):
            pair = best[i - 1][j - 1] + 1 + matching(inner, other) if x == y else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], pair)
    return best[-1][-1]


TREES = st.recursive(st.sampled_from(["<p>x</p>", "<b>y</b>", "<i></i>", '<b class="k9">z</b>']), lambda inner: st.tuples(st.sampled_from(["div", "ul", "section"]), st.lists(inner, max_size=4)).map(lambda t: f"<{t[0]}>{''.join(t[1])}</{t[0]}>"), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(TREES, max_size=4), st.lists(TREES, max_size=4))
def test_alignment_is_simple_tree_matching(x, y):
    """What pages share by paths is the largest matching of their trees in normal form."""
    a, b = wrapper.parse("".join(x)), wrapper.parse("".join(y))
    known = {}
    shared = wrapper.aligned(a, known).keys() & wrapper.aligned(b, known).keys()
    assert len(shared) - 1 == matching(normal(a), normal(b))


def test_articles_without_marks():
    """The test pages with their articles and adverts as plain boxes: the template finds the same texts, the page alone does not."""
    rows = duckdb.sql("SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)), html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    hosts = defaultdict(list)
    for host, html in rows:
        hosts[host].append(html)
    found = Counter()
    for htmls in hosts.values():
        if len(set(htmls)) < 5:
            continue
        plain = [h.replace("<article>", '<div class="b2">').replace("</article>", "</div>").replace('class="ad"', 'class="a1"') for h in htmls]
        want = [wrapper.Page(h).plain for h in htmls]
        assert texts(htmls, induced(htmls)) == texts(plain, induced(plain)) == want
        found["template"] += len(want)
        found["alone"] += sum(text(h) == w for h, w in zip(plain, want, strict=True))
    assert found["template"] > 100 and found["alone"] < found["template"] / 10


def test_names_inside_articles():
    """What is named like furniture stays where it is a page's own, and goes where most pages have it; adverts go anyway."""
    page = '<article><h1>T{0}</h1><p>Words of {0} and more of them</p>{1}<div class="ad">Buy {0}</div></article>'
    own = page.format(0, '<div class="related-work"><p>Body part</p></div><section id="search">Found</section><p class="alert">Mind this</p>')
    assert text(own) == "T0\nWords of 0 and more of them\nBody part\nFound\nMind this"
    htmls = [own] + [page.format(k, f'<div class="related">See {k}</div>') for k in range(1, 8)]
    got = texts(htmls, induced(htmls))
    assert got[0].endswith("Body part\nFound\nMind this") and got[3] == "T3\nWords of 3 and more of them"


def test_menus_are_links(spark):
    """Boxes whose varying text is links are no content, whatever they are called, inside the content and out of it."""
    page = '<body><div class="m"><a href="/a">{0} one</a> <a href="/b">{0} two</a></div><div class="c"><h2>Title {0}</h2><p>Text of {0}, of some length</p><ul><li><a href="/x">{0} next page of this site</a></li></ul></div></body>'
    htmls = [page.format(f"w{k}") for k in range(6)]
    assert texts(htmls, induced(htmls)) == [f"Title w{k}\nText of w{k}, of some length" for k in range(6)]


def test_deep_and_wide_pages():
    """Depth and width without bounds, with stray ends."""
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    wide = "<body>" + "".join(f"<p>{k}<br></i>" for k in range(20_000)) + "</body>"
    assert text(deep) == "deep" and text(wide).count("\n") == 19_999
    htmls = [deep, deep.replace("deep", "other"), wide]
    assert texts(htmls, induced(htmls))[2].count("\n") == 19_999


def test_template_within_articles(spark):
    """A notice in every article of a host goes; articles that are copied but for a line stay."""
    page = "<body><nav>n</nav><article><h1>Title {0}</h1><p>{1}</p><p>Read our privacy terms</p></article></body>"
    rows = [(k, "http://h/x", page.format(k, f"words of page {k} " * 5), *["x"] * 5) for k in range(6)]
    got = {r.page_id: r for r in wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k].text == f"Title {k}\n" + " ".join([f"words of page {k}"] * 5) and got[k].template_nodes > 0 for k in range(6))
    rows = [(k, "http://h/x", page.format(k, "the same words " * 5), *["x"] * 5) for k in range(2)]
    assert all(r.text.startswith(f"Title {r.page_id}\nthe same words") and r.text.endswith("terms") for r in wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect())


def test_copies_are_no_template(spark):
    """Pages without marks that a host has twice or more keep their text, alone and among others."""
    page = "<body><div>Our site</div><div><p>{0}</p><p>more of {0}</p></div></body>"
    rows = [(k, "http://two/x", page.format("copy"), *["x"] * 5) for k in range(2)] + [(10 + k, "http://many/x", page.format("copy" if k < 30 else f"w{k}"), *["x"] * 5) for k in range(40)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == got[1] == "Our site\ncopy\nmore of copy"
    assert all(got[10 + k] == "{0}\nmore of {0}".format("copy" if k < 30 else f"w{k}") for k in range(40))


def test_template_nodes_may_be_absent_from_pages():
    """What most pages have is template on these, whichever page comes first."""
    htmls = [f"<body><div>Our site</div>{'' if k == absent else '<p>Old site closes soon</p>'}<div><p>w{k}</p></div>{'' if k == absent else '<span>All rights</span>'}</body>" for absent in (0, 3) for k in range(8)]
    for part in (htmls[:8], htmls[8:]):
        assert texts(part, induced(part)) == [f"w{k}" for k in range(8)]


def test_templates_do_not_depend_on_partitions(spark):
    """The same templates as in memory, in any number of parts."""
    rows = [(f"http://h{k % 3}/x", f"<body><div>Head {k % 3}</div><div class=c{k}><p>text {k} </p><p>more {k}</p></div></body>") for k in range(40)] * 2
    pages = spark.createDataFrame(rows, "host STRING, html STRING")
    want = {h: induced([x for g, x in rows if g == h]) for h in {r[0] for r in rows}}
    for parts in (1, 7):
        got = {r.host: wrapper.Template([tuple(n) for n in r.nodes], r.constants) for r in wrapper.induced(pages.repartition(parts)).collect()}
        assert got.keys() == want.keys()
        assert all((got[h].content, got[h].menus, got[h].constants) == (want[h].content, want[h].menus, want[h].constants) for h in want)


def test_names_of_articles_and_what_holds_them():
    """Whole names count, and neither an article nor what is around it is dropped for one name of several."""
    for page in ('<article class="post comments-open"><p>Body</p></article>', '<div class="page has-sidebar"><article>Body</article></div>', '<div class="layout no-menu"><div class="post">Body</div></div>', '<article class="post comments">Body</article>', '<div role="main" class="widget">Body</div>', '<div class="layout sidebar"><article>Body text</article></div><p>rest</p>'):
        assert text(f"<body>{page}<nav>n</nav></body>") in ("Body", "Body text"), page
    for page in ('<div class="site-footer">x</div>', '<div class="main-nav">x</div>', '<article class="comment">x</article>', '<section id="comments"><article>xxxxxxxxx</article></section>', '<div class="box sidebar">x</div>'):
        assert text(f"<body>{page}<p>Body</p></body>") == "Body", page
