from sparkshelf.llm import wrapper as W

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">{nav}</a></li><li>b</ul></nav><!-- x --><div class="ad box">buy {nav}</div>
<article><header><h1>{title}</h1><span>by someone</span></header><p><b>First &amp; {n}.<br><p>Second&nbsp;{n} one
 line</p><ul><li>i {n}<li>ii {title}</ul><aside>see also</aside><form><p>mail</p></form><div class="share">share it</div><pre>co  de{n}</pre><p></p><section id="comments"><p>nice!</p></section></article>
<aside>side</aside><div class="cookie-notice">ok?</div><footer>&copy; {nav}</footer></body></html>"""
WANT = "{title}\n\nFirst & {n}.\n\nSecond {n} one line\n\ni {n}\n\nii {title}\n\nco de{n}"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, host string")


def test_article_alone(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(nav=f"n{i}", title=f"Title {i}", n=i), "x", "y") for i in range(14)]
    rows += [(50, None, PAGE.format(nav="q", title="Q", n=0), "x", "y"), (51, "http://h0.org/", None, "", ""), (52, "http://h0.org/", "", "", ""), rows[3], (None, "http://h1.org/x", "<p>a", "", ""), (53, "http://alone.org/", "plain <i>te</i>xt", "", "")]
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in W.extract(pages_of(spark, rows)).collect()), key=str)
    want = []
    for i, url, html, *_ in rows:
        n = {50: ("Q", 0)}.get(i, (f"Title {i}", i))
        text = WANT.format(title=n[0], n=n[1]) if html and "<article>" in html else {None: "a", 53: "plain text"}.get(i, "")
        want.append((i, url, text, len(text)))
    assert got == sorted(want, key=str)


def test_without_article_the_template_goes_and_slots_stay(spark):
    page = "<html><body><div class='top'>Welcome to our site</div><div class='text'><p>{a}</p><p>{b}</p></div><div class='end'>All rights reserved</div></body></html>"
    rows = [(i, "http://t.org/", page.format(a=f"story {i}", b=f"more {i}"), "", "") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in W.extract(pages_of(spark, rows)).collect()}
    assert got == {i: f"story {i}\n\nmore {i}" for i in range(8)}


def test_templates_decide_inside_an_article_and_out(spark):
    """From LOOSE pages of other articles on (the exemplar does not vote) constant blocks go, but for headings of an article; without templates they stay."""
    page = "<div><p>Site name</p><ul><li><a href=x>{i} one</a><li><a href=y>two {i}</a></ul></div><article><h1>Daily</h1><p>Notice to all</p><p>story {i}</p></article><p>tail {i}</p>"
    for tag in ("article", "div"):
        for n, kept in ((W.LOOSE, True), (W.LOOSE + 1, False), (6 * W.LOOSE, False)):
            rows = [(i, "http://f.org/", page.format(i=i).replace("article>", tag + ">"), "", "") for i in range(n)]
            got = {r["page_id"]: r["text"] for r in W.extract(pages_of(spark, rows)).collect()}
            inside = {i: ("Daily\n\n" if kept or tag == "article" else "") + ("Notice to all\n\n" if kept else "") + f"story {i}" for i in range(n)}
            around = {i: (f"Site name\n\n{i} one\n\ntwo {i}\n\n" if kept else "") + inside[i] + f"\n\ntail {i}" for i in range(n)}
            assert got == (inside if tag == "article" else around)
            if not kept:
                assert got != {r[0]: W.extract_page(r[2]) for r in rows}


def test_attributes_and_comments():
    for page, text in {
        "<p class=it's>hello</p>": "hello", "<p data-x='y>z</p><p>don't</p>": "z\n\ndon't", '<p title="a > b">c</p>': "c", "<p title='a > b' class=\"x\">c": "c", "<p>a</p><div hidden>b</div>": "a",
        "<article><div class='side-by-side'>a</div><div class=ad-hoc-analysis>b</div><p>See <span class='related'>related</span> work</article>": "a\n\nb\n\nSee related work",
        "<!-- c --!>a": "a", "<!-->a": "a", "<!DOCTYPE html [ <!ENTITY x 'y'> ]><p>a": "a", "<article class=post-related><p>a</article>": "a", "<p>a</p><div class='ad-box'>b</div><div id=comments>c</div>": "a",
        "<p>1 < 2 and 3 > 2</p>": "1 < 2 and 3 > 2", "<p a=1 b = 'x' c>t": "t",
    }.items():
        assert W.extract_page(page) == text, page


def test_copies_are_not_template(spark):
    rows = [(i, "http://c.org/", PAGE.format(nav="n", title="Same", n=1), "", "") for i in range(9)]
    assert {r["text"] for r in W.extract(pages_of(spark, rows)).collect()} == {WANT.format(title="Same", n=1)}


def test_empty(spark):
    assert W.extract(pages_of(spark, [])).count() == 0


def brute_match(a, b):
    """Size of the largest match of trees (label, kids) by trying all order-preserving pairings."""
    if a[0] != b[0]:
        return 0
    from functools import cache

    @cache
    def best(i, j):
        if i == len(a[1]) or j == len(b[1]):
            return 0
        return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + brute_match(a[1][i], b[1][j]))

    return 1 + best(0, 0)


def test_matching_against_brute_force():
    import random

    rng = random.Random(3)

    def tree(depth):
        return (rng.randrange(2) if depth < 3 else 0, tuple(tree(depth - 1) for _ in range(rng.randrange(4))) if depth else ())

    def flat(t, d=0):
        out = [(t[0], d)]
        for k in t[1]:
            out += flat(k, d + 1)
        return out

    for _ in range(60):
        a, b = tree(3), tree(3)
        fa, fb = flat(a), flat(b)
        pairs = W.match([x[0] for x in fa], [x[1] for x in fa], [x[0] for x in fb], [x[1] for x in fb])
        assert len(pairs) == brute_match(a, b)
        assert all(fa[i][0] == fb[j][0] for j, i in pairs.items())
        assert [i for _, i in sorted(pairs.items())] == sorted(pairs.values())


def test_strange_markup():
    for page in ("<", "<a", "<a href='x", "</p></div>", "<p><table><td>x<td>y<tr><td>z", "<div>" * 3000 + "deep", "a<br>b", "<!-- open", "<script>never", "&#0; &bogus; &lt;p&gt;", "<P>Up</P>"):
        W.extract_page(page)
    assert W.extract_page("<p>a<br>b &lt;i&gt; c") == "a b <i> c"
    assert W.extract_page("<P>Up<p>Down") == "Up\n\nDown"
    assert W.extract_page("<div>" * 3000 + "deep") == "deep"


def test_copies_with_other_menus_are_not_template(spark):
    rows = [(i, "http://m.org/", PAGE.format(nav=f"n{i}", title="Same", n=1), "", "") for i in range(3 * W.LOOSE * 5)]
    rows += [(100 + i, "http://m.org/", PAGE.format(nav="n", title=f"Other {i}", n=i), "", "") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in W.extract(pages_of(spark, rows)).collect()}
    assert got == {i: WANT.format(title="Same", n=1) for i in range(3 * W.LOOSE * 5)} | {100 + i: WANT.format(title=f"Other {i}", n=i) for i in range(2)}


def test_two_pages_are_no_template(spark):
    rows = [(i, "http://two.org/", f"<h1>Title {i}</h1><section><p>shared story</p></section>", "", "") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in W.extract(pages_of(spark, rows)).collect()}
    assert got == {i: f"Title {i}\n\nshared story" for i in range(2)}


def test_constant_siblings_of_one_label_go(spark):
    rows = [(i, "http://s.org/", f"<body><div>Site menu</div><div>story {i}</div>{f'<div>more {i}</div>' * (i % 3)}<div>All rights reserved</div></body>", "", "") for i in range(12)]
    rows += [(100 + i, "http://a.org/", f"<article><p>story {i}</p><p>Notice to all</p><p>more {i}</p></article>", "", "") for i in range(W.LOOSE * 5 + 1)]
    got = {r["page_id"]: r["text"] for r in W.extract(pages_of(spark, rows)).collect()}
    assert got == {i: "\n\n".join([f"story {i}", *[f"more {i}"] * (i % 3)]) for i in range(12)} | {100 + i: f"story {i}\n\nmore {i}" for i in range(W.LOOSE * 5 + 1)}


def test_boilerplate_that_one_page_lacks_goes_on_all_hosts(spark):
    rows = [(h * 100 + i, f"http://h{h}.org/", f"<p>story {h} {i}</p>" + ("<section>Footer</section>" if i else ""), "", "") for h in range(20) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in W.extract(pages_of(spark, rows)).collect()}
    assert got == {h * 100 + i: f"story {h} {i}" for h in range(20) for i in range(9)}


def test_headings_of_an_article_stay(spark):
    """Articles that name their sections alike keep those names, on every page."""
    page = "<nav>menu</nav><article><h1>Story {i}</h1><h2>Introduction</h2><p>it begins {i}</p><h2>Summary</h2><p>it ends {i}</p></article>"
    rows = [(i, "http://h.org/", page.format(i=i), "", "") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in W.extract(pages_of(spark, rows)).collect()}
    assert got == {i: f"Story {i}\n\nIntroduction\n\nit begins {i}\n\nSummary\n\nit ends {i}" for i in range(12)}


def test_pages_of_many_blocks_are_aligned_block_by_block(spark):
    """Constant siblings go from pages of any number of blocks, as they do from short ones."""
    rows = []
    for n in (20, 700):
        for i in range(W.LOOSE * 2 + 1):
            items = [f"<p>story {n} {i} {k}</p>" for k in range(n + i % 2)]
            rows.append((n * 100 + i, f"http://n{n}.org/", f"<body><p>Site menu</p>{''.join(items)}<p>All rights reserved</p></body>", "", ""))
    got = {r["page_id"]: r["text"] for r in W.extract(pages_of(spark, rows)).collect()}
    assert got == {n * 100 + i: "\n\n".join(f"story {n} {i} {k}" for k in range(n + i % 2)) for n in (20, 700) for i in range(W.LOOSE * 2 + 1)}


def test_wide_tables_and_classes_leave_the_match_as_it_is(monkeypatch):
    import random

    rng = random.Random(8)

    def tree():
        labels, depths, texts = [0], [0], [0]
        for _ in range(rng.randrange(40)):
            labels.append(rng.randrange(2))
            depths.append(rng.randint(1, min(depths[-1] + 1, 5)))
            texts.append(rng.randrange(4))
        return labels, depths, texts

    some = [(tree(), tree()) for _ in range(80)]
    found = []
    for wide, cells, many in ((W.WIDE, W.MOST_CELLS, W.MANY), (0, 0, 0), (6, 20, 0), (6, 20, W.MANY)):
        monkeypatch.setattr(W, "WIDE", wide)
        monkeypatch.setattr(W, "MOST_CELLS", cells)
        monkeypatch.setattr(W, "MANY", many)
        found.append([W.match(a[0], a[1], b[0], b[1], a[2], b[2]) for a, b in some])
    assert all(f == found[0] for f in found)
