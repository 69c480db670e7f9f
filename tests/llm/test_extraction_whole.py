"""Cases of op6 that the given tables don't hold."""

import random

from sparkloom.llm import extraction


def test_deep_pages():
    for n in (100, 250, 3000):
        page = "<article><p>Before</p>" + "<div>" * n + "<nav>no</nav>deep" + "</div>" * n + "<p>After</p></article><p>outside</p>"
        assert extraction.main_text(page, set()) == "Before\n\ndeep\n\nAfter"
    rows = "".join(f"<tr><td>a{i}<td><p>b{i}" for i in range(300))
    blocks, tags = extraction.read(f"<div><article><table>{rows}</table><p>After</article></div>")
    assert {x.path for x in blocks} == {"/div/article/table/tr/td", "/div/article/table/tr/td/p", "/div/article/p"} and all(x.main for x in blocks)
    blocks, _ = extraction.read("<dl><dt>a<dd>b<dt>c<dd><p>d</dl><ul><li>x<ul><li>y<li>z</ul><li>w</ul>")
    assert [x.path for x in blocks] == ["/dl/dt", "/dl/dd", "/dl/dt", "/dl/dd/p", "/ul/li", "/ul/li/ul/li", "/ul/li/ul/li", "/ul/li"]


def _texts(spark, pages):
    rows = [(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    return [r.text for r in sorted(extraction.extract(df).collect())]


def test_boilerplate_inside_article(spark):
    pages = [("a.org", f"<nav>menu</nav><article><h1>Title {i}</h1><p>Text of page number {i}</p><p>Tell your friends about us</p></article>") for i in range(6)]
    assert _texts(spark, pages) == [f"Title {i}\n\nText of page number {i}" for i in range(6)]


def test_copies_are_no_template(spark):
    body = "".join(f"<p>Sentence {k} of a page that was copied in full.</p>" for k in range(8))
    copies = [("c.org", f"<div>{body}</div>")] * 3 + [("c.org", f"<div>{body}<p>{i}</p></div><footer>{i}</footer>") for i in range(3)]
    others = [("c.org", f"<div><p>Quite another text, number {i}</p></div>") for i in range(4)]
    got = _texts(spark, copies + others)
    want = "\n\n".join(f"Sentence {k} of a page that was copied in full." for k in range(8))
    assert got == [want] * 3 + [f"{want}\n\n{i}" for i in range(3)] + [f"Quite another text, number {i}" for i in range(4)]


def test_templates_of_a_large_host(spark):
    page = "<div class='t{t}'><p>Own text number {i} of this page</p><p>Line of template {t}</p></div>"
    assert _texts(spark, [("d.org", page.format(t=i % 8, i=i)) for i in range(48)]) == [f"Own text number {i} of this page" for i in range(48)]


def _story(i, n=3):
    return " ".join(f"Word{i}x{k} tells of case {i * 31 + k}." for k in range(6 * n))


def test_pages_without_article_and_with_misleading_classes(spark):
    menu = lambda i: "".join(f"<p><a href='/{k}'>Entry {i}-{k}</a></p>" for k in range(5))
    page = lambda i: f"<body class='page with-sidebar menu-open'><div class='x1'>{menu(i)}</div><div class='post no-comments'><p>{_story(i)}</p><p>More of {i} <span class='ad'>Buy <span>now</span></span>and on</p></div><div class='foot-note'>Read by all</div></body>"
    pages = [("m.org", page(i)) for i in range(6)]
    want = [f"{_story(i)}\n\nMore of {i} and on" for i in range(6)]
    assert _texts(spark, pages) == want
    # the template decides here: without slots and classes markup alone leaves menu and closing line in on every page
    assert [extraction.main_text(html, set()) == t for (_, html), t in zip(pages, want, strict=True)] == [False] * 6


def test_marks_that_say_nothing_of_the_text():
    for page in (
        "<body class='page with-sidebar'><article><p>Text</p></article></body>", "<article class='post no-comments'><p>Text</p></article>",
        "<div class='sidebar'><article><p>Text</p></article></div>", "<body class='menu'><p>Text</p></body>", "<div class='has-ad'><main>Text</main></div>",
    ):
        assert extraction.main_text(page, set()) == "Text"
    page = "<article><p>Text</p></article><section class='comments'><article class='comment'><p>First!</p></article></section>"
    assert extraction.main_text(page, set()) == "Text"
    for mark in ("ad", "post sponsored", "promo"):
        assert extraction.main_text(f"<p>One <span class='{mark}'>Buy now <i>cheap</i></span>two</p><p>Three <em class='{mark}'>open", set()) == "One two\n\nThree"
    assert extraction.main_text("<p>One <span class='related'>kept</span> <a class='ad'>gone</a><img class='ad'>two</p>", set()) == "One kept two"
    assert extraction.main_text("<div><span class='ad'>gone</div><p>kept</p>", set()) == "kept"


def test_references_in_an_article_stay(spark):
    page = "<article><p>{t}</p><ul><li><a href='/a'>Source {i}a</a></li><li><a href='/b'>Source {i}b</a></li></ul></article>"
    assert _texts(spark, [("r.org", page.format(t=_story(i), i=i)) for i in range(5)]) == [f"{_story(i)}\n\nSource {i}a\n\nSource {i}b" for i in range(5)]


def test_long_repeated_and_clashing_rows(spark):
    body = "".join(f"<p>Paragraph {i} of a very long page.</p>" for i in range(20_000))
    rows = [(1, "http://l.org/1", f"<article>{body}</article>", "a", 1, "x")] * 2 + [(None, None, "<p>no host</p>", "b", 2, "y"), (3, "http://l.org/3", None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, __host string, structure bigint, blocks string")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in extraction.extract(df).collect())
    long = "\n\n".join(f"Paragraph {i} of a very long page." for i in range(20_000))
    assert got == [(0, None, "no host", 7), (1, "http://l.org/1", long, len(long)), (1, "http://l.org/1", long, len(long)), (3, "http://l.org/3", "", 0)]
    assert extraction.extract(df.withColumnsRenamed({"page_id": "host", "url": "token"}), "host", "token").columns == ["host", "token", "text", "n_chars"]


def _plain(pages):
    """The same by a plain version: classes by the set of contents, slots by sums, page by page."""
    read = [extraction.read(html) for _, html in pages]
    keys = [[(x.path, x.text) for x in blocks] for blocks, _ in read]
    content = [tuple(k for k, x in zip(ks, blocks, strict=True) if not x.outside) for ks, (blocks, _) in zip(keys, read, strict=True)]
    out = []
    for (host, _), (blocks, tags), ks in zip(pages, read, keys, strict=True):
        keep = [True] * len(blocks)
        decided = [False] * len(blocks)
        mates = {c: j for j, ((h, _), c) in enumerate(zip(pages, content, strict=True)) if h == host}.values()  # one page of each content
        for group in (list(mates), [j for j in mates if set(read[j][1]) == set(tags)]):
            whole = len(group) == len(list(mates)) and group == list(mates)
            on = lambda k, g=group: frozenset(content[j] for j in g if k in keys[j])
            for i, x in enumerate(blocks):
                here = on(ks[i])
                if len(here) >= extraction.LEAST_PAGES and len(here) >= extraction.COVER * len(group):
                    counts = {c: n for j in group if ks[i] in keys[j] for c, n in [(content[j], keys[j].count(ks[i]))]}
                    mine = {k for j in group for k in keys[j] if {content[q]: keys[q].count(k) for q in group if k in keys[q]} == counts}
                    size = sum(0 if next(b for j in group for b, kk in zip(read[j][0], keys[j], strict=True) if kk == k).outside else len(k[1]) for k in mine)
                    rare = sorted(sum(len(k[1]) for k in set(c) if sum(k in keys[j] for j in mates) < extraction.LEAST_PAGES) for c in here)
                    if rare[0] >= extraction.DIFFER * (rare[0] + size):
                        keep[i] = False
                same = [(b, f) for j in group for b, f in zip(read[j][0], extraction.good(read[j][0]), strict=True) if b.path == x.path]
                n = len({content[j] for j in group if any(b.path == x.path for b in read[j][0])})
                if decided[i] or (whole and not (n >= extraction.LEAST_PAGES and n >= extraction.COVER * len(group))):
                    continue
                decided[i] = True
                size = sum(len(b.text) for b, _ in same)
                links = sum(0 if f and b.main else b.links for b, f in same)
                if not (2 * sum(len(b.text) for b, f in same if f) > size and (links < extraction.LINKED * size or n < extraction.LEAST_PAGES)):
                    keep[i] = False
        out.append("\n\n".join(x.text for x, k in zip(blocks, keep, strict=True) if k))
    return out


def test_against_a_plain_version(spark):
    r = random.Random(4)
    pages = []
    for i in range(40):
        bits = ["<nav>menu</nav>", "<p>Same line</p>", "<div class='sidebar'>Side</div>", "<p><a href='/'>Link to it</a></p>", "<article><h1>Head</h1></article>", "<footer>End</footer>", "<p>Say <span class='ad'>Buy</span>so</p>"]
        parts = [b for b in bits if r.random() < 0.6] + [f"<p>{_story(i, 1)}</p>"]
        r.shuffle(parts)
        pages.append((f"h{i % 3}.org", "<body>" + "".join(parts) + "</body>"))
    assert _texts(spark, pages) == _plain(pages)
