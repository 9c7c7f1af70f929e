from quire.llm import html

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; x</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<article><h1>Title &eacute;</h1><p><b>One
 two.<br><p>Three <i>four</i>&nbsp;&lt;five&gt; <div class="share-bar">share me</div><ul><li>a<li>b</ul>
<form>mail</form><section id="comments"><article>I say</article></section><p>Six 1 < 2</article><aside>side</aside><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert html.main_text(PAGE) == "Title é\nOne two.\nThree four <five>\na\nb\nSix 1 < 2"


def test_without_article_and_malformed():
    assert html.main_text("") == "" and html.main_text("plain &amp; text") == "plain & text"
    assert html.main_text("<body><div id=nav>x</div><p>a</p>b<p class='x>y'>c</div></p>d<!-- open") == "a\nb\nc\nd"
    assert html.main_text("<main><p>m</main><p>other") == "m"
    assert html.main_text("<main><p>lead</p><article><p>body</p></article><p>tail</p></main><p>other") == "lead\nbody\ntail"
    assert html.main_text("<p>a<script>if (1 < 2) {") == "a"
    assert html.main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert html.main_text("<p>" * 3000 + "deep" + "<div>" * 3000) == "deep"
    html.main_text('<a title="' * 3000)


def test_names_inside_and_around_an_article():
    inside = "<article><div class='section-header'><h2>Part</h2></div><p class='related-work'>Earlier work says so.</p><p><a href=x>A source in full</a></p></article>"
    assert html.main_text(f"<body><div class='header'>Site</div>{inside}</body>") == "Part\nEarlier work says so.\nA source in full"
    links = "<ul class='related-posts'>" + "".join(f"<li><a href={i}>Post {i}</a>" for i in range(4)) + "</ul>"
    assert html.main_text(f"<article><p>Text of it.</p>{links}</article>") == "Text of it."
    for wrapper in ("layout has-sidebar", "overflow-hidden", "menu-open"):
        assert html.main_text(f"<div class='{wrapper}'><div class='sidebar'>side</div><article><p>kept</p></article></div>") == "kept"
    assert html.main_text("<article><p>it</p></article><div id='comments'><article><p>I say</p></article></div>") == "it"
    assert html.main_text("<div class='overflow-hidden'><p>no article here</p></div>") == "no article here"
    assert html.main_text("<p>a</p><div class='hidden'>b</div><div hidden>c</div><p style='display: none'>d</p>") == "a"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")


def texts(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    return got


def test_tree_removes_what_a_host_repeats(spark):
    def page(i, extra):
        return f"<body><div class=top>{extra}</div><div class=story><p>story {i} word{i}</p></div></body>"

    rows = [(i, "http://a.org/%d" % i, page(i, "Welcome to our site")) for i in range(8)]
    rows += [(100 + i, "http://b.org/%d" % i, page(i, f"unique {i}")) for i in range(8)]
    rows += [(200 + i, "http://c.org/%d" % i, page(1, "same page")) for i in range(8)]
    rows += [(300, None, None), (None, "http://a.org/x", ""), (0, "http://a.org/0", page(0, "Welcome to our site"))]
    pages = pages_of(spark, rows)
    got = texts(html.extract(pages))
    assert got[3][0].text == "story 3 word3" and len(got[0]) == 2
    assert got[103][0].text == "unique 3\nstory 3 word3"
    assert got[203][0].text == "same page\nstory 1 word1"
    assert got[300][0].text == "" and got[None][0].text == ""
    assert html.extract(pages.limit(0)).count() == 0


def test_tree_removes_a_menu_without_a_name(spark):
    """The tree, by what repeats, and no list of names: the same page alone keeps all of its texts."""
    words = "river stone letter morning window garden little yellow".split()

    def page(i):
        body = "".join(f"<p>{words[(i + k) % 8]} {i * 31 + k} says {words[(i * k) % 8]} {i}</p>" for k in range(2 + i % 4))
        return f"<body><div class=x1><div>Home</div><div>Prices and offers</div><div>About us</div></div><div class=x2>{body}<p>All pages end with this sentence.</p></div></body>"

    pages = pages_of(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(12)] + [(50, "http://alone.org/1", page(3))])
    got = texts(html.extract(pages))
    for i in range(12):
        assert "Home" not in got[i][0].text and "this sentence" not in got[i][0].text
        assert got[i][0].text.count("\n") == 1 + i % 4
    assert got[50][0].text.startswith("Home\nPrices") and got[50][0].text.endswith("this sentence.")


def test_evidence_grows_with_the_pages(spark):
    """Repetition weighs more the more pages show it, without a least number of pages."""
    def page(i):
        return f"<body><div class=x1>Prices and offers</div><div class=x2><p>story {i} of many</p></div></body>"

    kept = {}
    for n in (2, 3, 4, 6, 20):
        got = texts(html.extract(pages_of(spark, [(i, f"http://h{n}.org/{i}", page(i)) for i in range(n)])))
        kept[n] = "Prices" in got[0][0].text
        assert all(f"story {i} of many" in got[i][0].text for i in range(n))
    assert kept[2] and not kept[6] and not kept[20] and sorted(kept.values(), reverse=True) == list(kept.values())


def brute(pages, host_of):
    """The importances of paths and blocks by plain counting over whole pages, and each page's text by them."""
    from collections import Counter, defaultdict
    from math import log

    seen, read = defaultdict(set), {}
    for key, url, source in pages:
        read[key] = html.Page(source)
        styles, blocks, digest = read[key].features()
        seen[host_of(url)].add((digest, tuple(styles), tuple(blocks)))
    out = {}
    for key, url, _ in pages:
        own = seen[host_of(url)]
        count = {side: Counter(x for page in own for x in page[side]) for side in (1, 2)}
        m = Counter(p for (p, _), n in count[1].items() for _ in range(n))
        styles, repeated = {}, {}
        for p in m:
            runs = [n for (q, _), n in count[1].items() if q == p]
            spread = 1.0 if m[p] < 2 else -sum(n / m[p] * log(n / m[p], m[p]) for n in runs)
            sure = 1 - (1 - spread) * (m[p] - 1) / m[p]
            if sure < html.LISTED_STYLE:
                styles[p] = ((1 - html.GAMMA ** len(runs)) * sure, html.GAMMA ** len(runs))
        for (p, b), n in count[2].items():
            if n > 1 and (value := 1 - log(n) / log(m[p]) * (m[p] - 1) / m[p]) < html.LISTED_BLOCK:
                repeated[b] = value
        out[key] = read[key].text(styles, repeated)
    return out


def test_texts_match_plain_counting(spark):
    import random

    rnd = random.Random(2)
    pages = []
    for k in range(60):
        host = rnd.choice("aabbc")
        parts = [f"<div class=n{rnd.randint(0, 2)}>{rnd.choice(['Menu', 'Offers', 'About'])}</div>" for _ in range(rnd.randint(0, 3))]
        parts += [f"<section><p>{rnd.choice(['one', 'two', 'three'])} {rnd.randint(0, 9)}</p><ul><li><a href=x>{rnd.choice(['go', 'see'])}</a><li>item</ul></section>" for _ in range(rnd.randint(0, 4))]
        pages.append((k, f"http://{host}.org/{k}", f"<body>{''.join(parts)}<footer>f</footer></body>"))
    got = texts(html.extract(pages_of(spark, pages)))
    assert {k: v[0].text for k, v in got.items()} == brute(pages, lambda u: u[7])
