from tessellate.llm import html_text as H

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p><p>no";</script></head><body><header><h1>Site</h1></header>'
        '<nav><ul><li>Menu<li>More</ul></nav><div class="ad banner">Buy</div><!-- hidden <p>x</p> --><article><h1>Ti&eacute;tle</h1>'
        '<p><b>One&nbsp;&amp; two<br>three  \n four<p>Fi<i>v</i>e</p><div class="comments"><p>Reader</p></div><form>Name <input></form></article>'
        '<aside class="sidebar">Side</aside><footer>&copy; foot</footer></body>')


def test_article_without_named_parts():
    assert H.main_text(PAGE) == "Tiétle One & two three four Five"
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("plain text") == "plain text"
    assert H.main_text("<p>a<p>b <b>c</b>d</p></div></p> <script>x") == "a b cd"
    assert H.main_text("<div><p>1 < 2 &lt; 3 &#x41; &bogus;</p>") == "1 < 2 < 3 A &bogus;"
    assert H.main_text('<p>a</p><a href="x>b</a><p>c') == "a b c" and H.main_text("<p>a</p><p class=\"cut") == "a"
    assert H.main_text('<div class="site-header">Top</div><p>a</p>') == "a"
    assert H.main_text('<article><div class="header"><h1>T</h1></div>a</article>') == "T a"
    long = "word " * 200_000
    assert H.main_text(f"<main><p>{long}</p></main>") == long.strip()
    assert H.main_text("<div>" * 3000 + "deep" + "</div>" * 2000) == "deep"


def test_unimportant_branches_go_by_their_site(spark):
    rows = []
    for i in range(40):
        html = f'<body><div class="top"><p>Welcome to the site</p><p>Call us</p></div><div class="text"><p>Story {i} unique words {i * 7}</p></div></body>'
        rows.append((i, f"http://big.org/{i}", html))
    rows += [(100, "http://small.org/", '<body><div class="top"><p>Alone</p></div></body>'), (101, None, None), (102, "x", ""), (0, "http://big.org/0", rows[0][2])]
    pages = spark.createDataFrame([r + ("n", "h") for r in rows], "page_id bigint, url string, html string, nodes string, host string")
    tree = [r.importance for r in H.site_tree(pages.selectExpr("html", "'h' as host").limit(40)).collect()]
    assert len(tree) == 3 and sum(x < H.THRESHOLD for x in tree) == 1
    out = {(r.page_id, r.text) for r in H.extract(pages).collect()}
    assert (3, "Story 3 unique words 21") in out and (100, "Alone") in out and (101, "") in out and (102, "") in out
    assert H.extract(pages).count() == len(rows) and H.extract(pages.limit(0)).count() == 0


def test_article_copied_all_over_a_site_stays(spark):
    html = "<body><nav>Menu</nav><article><p>The same article</p></article></body>"
    pages = spark.createDataFrame([(i, "http://copy.org/", html) for i in range(30)], "page_id bigint, url string, html string")
    assert {r.text for r in H.extract(pages).collect()} == {"The same article"}


def test_containers_of_copied_pages_stay(spark):
    inside = '<h1>Title</h1><div class="body"><p>First</p><ul><li>One</ul><table><tr><td>Cell</td></tr></table></div>'
    marked = f"<body><nav>Menu</nav><article>{inside}</article></body>"
    plain = f'<body><nav>Menu</nav><div class="a">{inside}</div><section><p>Second</p></section></body>'
    rows = [(i, "http://marked.org/", marked) for i in range(9)] + [(100 + i, "http://plain.org/", plain) for i in range(9)]
    # near copies: distinct pages of equal text, whose containers all are unimportant
    rows += [(200 + i, "http://near.org/", plain.replace("<nav>", f"<nav>{i}")) for i in range(9)]
    rows += [(300 + i, "http://near-marked.org/", marked.replace("<nav>", f"<nav>{i}")) for i in range(9)]
    # copies among others are no boilerplate of the others' branch
    rows += [(400 + i, "http://mixed.org/", f'<body><div class="b"><p>Story {max(0, i - 20)}</p></div></body>') for i in range(30)]
    out = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(out) == len(rows)
    assert {out[i] for i in (*range(9), *range(300, 309))} == {"Title First One Cell"}
    assert {out[i] for i in (*range(100, 109), *range(200, 209))} == {"Title First One Cell Second"}
    assert out[400] == "Story 0" and out[429] == "Story 9"


def test_copies_count_once_in_the_site_tree(spark):
    page = lambda i: (f'<body><div class="b"><p>Story {i}</p></div></body>', "h")
    once = [page(i) for i in range(10)]
    trees = [sorted((r.node, r.pages, r.importance) for r in H.site_tree(spark.createDataFrame(rows, "html string, host string")).collect())
             for rows in (once, once + [page(0)] * 23 + [page(3)] * 2)]
    assert trees[0] == trees[1] and trees[0][0][1] == 10


def test_names_never_take_the_article_or_what_it_lies_in():
    art = "<article><h1>T</h1><p>a</p></article>"
    for wrap in ('<div class="page no-sidebar">{}</div>', '<div class="has-sidebar">{}</div>', '<form id="aspnetForm">{}</form>',
                 '<div class="sidebar-right"><div class="nav">{}</div></div>', '<div class="cookie-banner">{}</div><div class="ad">Buy</div>'):
        assert H.main_text(f"<body><nav>Menu</nav>{wrap.format(art)}<footer>F</footer></body>") == "T a"
        assert H.main_text(f"<body>{wrap.format(art.replace('article', 'main'))}</body>") == "T a"
    # articles in named parts are not the article where there is another
    aside = '<aside><article><p>Related story that is much longer than the article</p></article></aside>'
    assert H.main_text(f"<body>{art}{aside}</body>") == "T a" == H.main_text(f"<body>{aside}{art}</body>")
    assert H.main_text(f'<body>{art}<section id="comments"><article class="comment"><p>Me too</p></article></section></body>') == "T a"
    assert H.main_text(f'<body><section id="comments"><article class="comment"><p>Me too</p></article></section>{art}</body>') == "T a"


def test_names_of_parts_and_of_other_things():
    kept = ["share-price", "search-results-of-the-study", "article-body", "has-sidebar", "no-sidebar", "commentary", "post", "content", "story", "readers", "main",
            "adventure", "navigationSystems", "footerless", "header", "side-effects", "related-work", "notice-of-award", "cookie-recipe"]
    gone = ["cookiebar", "commentlist", "reader-opinions", "top-nav-links", "ad", "ads", "adSlot", "sidebar", "rightSidebar", "social-links", "share", "share-buttons",
            "related-posts", "newsletter_form", "comment-17", "breadcrumbs", "login-box", "main-menu", "banner2"]
    assert [n for n in kept if H.names_a_part(n)] == [] and [n for n in gone if not H.names_a_part(n)] == []
    for n in kept:
        assert H.main_text(f'<article><p>a</p><div class="{n}"><p>b</p></div><p id="{n}">c</p></article>') == "a b c"
    for n in gone:
        assert H.main_text(f'<article><p>a</p><div class="x {n}"><p>b</p></div><p id="{n}">c</p></article>') == "a"


def _site(mark):
    """Pages without speaking names: what repeats from page to page is boilerplate,
    also inside the article."""
    o, c = ("<article>", "</article>") if mark else ('<div class="k3">', "</div>")
    return [f'<body><div class="k1"><p>Our great site</p><ul><li>One<li>Two</ul></div>{o}<h1>Story {i}</h1><div class="k4"><p>Text {i} of its own</p></div>'
            f'<div class="k5"><p>Tell your friends</p></div><div class="k6"><p>More {i * 3 % 40} words</p></div>{c}<div class="k2"><p>All rights kept</p></div></body>'
            for i in range(40)]


def test_the_tree_decides_with_and_without_marks(spark):
    rows = [(i + 100 * m, f"http://site{m}.org/{i}", h) for m in (0, 1) for i, h in enumerate(_site(m))]
    rows += [(1000 + m, f"http://alone{m}.org/", _site(m)[0]) for m in (0, 1)]
    out = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for m in (0, 1):
        for i in range(40):
            assert out[i + 100 * m] == f"Story {i} Text {i} of its own More {i * 3 % 40} words"
            assert H.main_text(rows[i + 40 * m][2]) != out[i + 100 * m]  # the tree left out
        assert "Tell your friends" in out[1000 + m]


def _brute_tree(pages):
    """Importance of every node, page by page and value by value."""
    from collections import Counter, defaultdict
    from math import log

    pages = list(dict.fromkeys(p or "" for p in pages))
    looks, texts, held = defaultdict(Counter), defaultdict(Counter), Counter()
    for page in pages:
        blocks, children = H.parse(page)
        for node, tags in children.items():
            if node:
                held[node] += 1
                looks[node][" ".join(dict.fromkeys(tags)), len(tags).bit_length()] += 1
        for node, text in {(n, b.text()) for b in blocks if b.text() for n in b.nodes()}:
            texts[node][text] += 1
    out = {}
    for node, m in held.items():
        base, n = log(max(m, 2)), sum(looks[node].values())
        look = -sum(c / n * log(c / n) for c in looks[node].values()) / base if m > 1 else 1.0
        t = texts[node]
        content = 0.0 if not t else 1 - sum(log(c) for c in t.values()) / (len(t) * base) if m > 1 else 1.0
        g = 0.9 ** len(looks[node])
        out[node] = (m, (1 - g) * look + g * content)
    return out


def test_tree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "HOLD", 50)
    sites = {"a": _site(0) + _site(0)[:7], "b": _site(1), "c": [PAGE, PAGE, None, "", "<div><p>x</p></div>"], "": ["<ul><li>a<li>b</ul>", "<ul><li>a</ul>"]}
    d = spark.createDataFrame([(h, p) for h, ps in sites.items() for p in ps], "host string, html string").repartition(5)
    got = {(r.host, r.node): (r.pages, r.importance) for r in H.site_tree(d).collect()}
    want = {(h, node): v for h, ps in sites.items() for node, v in _brute_tree(ps).items()}
    assert got.keys() == want.keys() and len(got) > 25
    for k in want:
        assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9
