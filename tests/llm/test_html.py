from weftline.llm import html_extract as H


def test_structures():
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var x='</p><article>no';</script></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>"
        "<div id='cookie-notice'>Cookies</div><!-- <p>hidden</p> --><article class=post><h1>A &lt;B&gt; &amp c</h1><p>One<br>two\n  three<p><b>Bold</b>text"
        "<div class='ad'>Buy</div><form><p>f</p></form><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><section class=comments><p>nice</p></section></article>"
        "<aside>Side</aside><footer>Foot</footer></body></html>"
    )
    want = "A <B> & c\n\nOne two three\n\nBoldtext\n\nx\n\ny\n\n1\n\n2"
    assert H.extract(page, {}) == want
    assert H.extract(page, H.rule_of(H.wrapper_of(page))) == want


def test_wrapper_alignment():
    a, b, c = (H.wrapper_of(f"<body><article><h1>{t}</h1>{p}</article><div class=x>same</div>{more}</body>") for t, p, more in (("u", "<p>1</p>", ""), ("v", "<p>1</p><p>2</p>", "<div class=y>z</div>"), ("w", "", "")))
    w = H.merged(H.merged(a, b), c)
    body = w[2][0]
    article, fixed, extra = body[2]
    assert [x[:2] for x in article[2]] == [["h1", ""], ["p", "*"]]  # repeated, and optional
    assert article[2][0][2][0][2] is None  # a slot
    assert fixed[1] == "" and fixed[2][0][2] is not None  # a constant text
    assert extra[1] == "?"
    assert H.canonical(H.merged(H.merged(b, a), c)) == H.canonical(w)


def test_template_text_beside_a_plain_body():
    pages = [f"<body><div class=hint>Read more here</div><div class=story><p>{'story ' * 30}{k}</p><p>{'more ' * 20}{k}</p></div></body>" for k in range(4)]
    w = None
    for p in pages:
        x = H.wrapper_of(p)
        w = x if w is None else H.merged(w, x)
    assert H.extract(pages[1], H.rule_of(w)) == ("story " * 30 + "1") + "\n\n" + ("more " * 20 + "1")


def test_broken_markup():
    for page, want in [("", ""), ("plain", "plain"), ("a < b", "a < b"), ("<p>x", "x"), ("<article>y<p", "y"), ("<script>z", ""), ("<a href='q>w", "w"), ("</p></div>k", "k"), ("<!-- open", "")]:
        assert H.extract(page, {}) == want
    deep = "<div>" * 3000 + "<p>in</p>"
    assert H.extract(deep, {}) == "in"


def test_query_shape(spark):
    rows = [(1, "http://a.x/1", "<article><p>One</p></article>"), (2, "http://a.x/2", None), (None, None, ""), (3, "http://a.x:80/3#q", "<article><p>Zwei ö</p></article>"), (3, "http://a.x:80/3#q", "<article><p>Zwei ö</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "'c' AS host", "'c' AS rule")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.main_text(df).collect()), key=str)
    assert got == sorted([(1, "One", 3), (2, "", 0), (None, "", 0), (3, "Zwei ö", 6), (3, "Zwei ö", 6)], key=str)
    assert H.main_text(df.limit(0)).count() == 0


def read(pages):
    """Every page read by the rule of all."""
    w = None
    for p in pages:
        x = H.wrapper_of(p)
        w = x if w is None else H.merged(w, x)
    rule = H.rule_of(H.canonical(w))
    return [H.extract(p, rule) for p in pages]


def prose(k, words=30):
    return " ".join(f"w{k}x{i}" for i in range(words))


def test_template_and_root_from_the_wrapper_where_pages_have_an_article():
    """Texts that every page repeats are no article text inside the article element either; prose beside the element is."""
    shared = [f"<body><article><h1>Title {k}</h1><p>{prose(k)}<p>{prose(k + 50)}<p>Send this page to a friend</p><div class=strip>Printed from example</div></article><div>{k}</div></body>" for k in range(5)]
    assert read(shared) == [f"Title {k}\n\n{prose(k)}\n\n{prose(k + 50)}" for k in range(5)]
    parted = [f"<body><article><p>{prose(k)}</p></article><div class=rest><p>{prose(k + 50)}</p></div><div class=date>day {k}</div></body>" for k in range(5)]
    assert read(parted) == [f"{prose(k)}\n\n{prose(k + 50)}" for k in range(5)]
    teaser = [f"<body><article><p>See {k}</p></article><div class=story><p>{prose(k, 200)}</p><p>{prose(k + 50, 200)}</p></div></body>" for k in range(5)]
    assert read(teaser) == [f"{prose(k, 200)}\n\n{prose(k + 50, 200)}" for k in range(5)]
    same = [f"<article><h1>One</h1><p>{prose(1)}<p>{prose(2)}<p>{prose(3)}<p>changed {k}</article>" for k in range(3)]
    assert read(same) == [f"One\n\n{prose(1)}\n\n{prose(2)}\n\n{prose(3)}\n\nchanged {k}" for k in range(3)]  # versions of one article


def test_texts_of_a_single_page_are_no_template():
    one = "<div><h1>T</h1><p>x</p></div>"
    assert read([one]) == ["T\n\nx"] and read([one, one, "<!-- c -->" + one]) == ["T\n\nx"] * 3
    pages = [f"<body><div class=hint>Read more here</div><div class=story><h1>Title {k}</h1><p>{prose(k)}</p>{'<blockquote>Said once</blockquote>' if k == 2 else ''}</div></body>" for k in range(5)]
    assert read(pages) == [f"Title {k}\n\n{prose(k)}" + ("\n\nSaid once" if k == 2 else "") for k in range(5)]


def test_ids_and_headings_do_not_name_blocks_inside_an_article():
    page = f"<article><h1>T</h1><h2 id=related-work>Related</h2><p class=notice-text>{prose(1)}</p><section id=discussion><p>{prose(2)}</p></section><div class=copyright-law>Law</div><div class=share-buttons>Share</div></article>"
    assert H.extract(page, {}) == f"T\n\nRelated\n\n{prose(1)}\n\n{prose(2)}\n\nLaw"
    assert read([page])[0] == H.extract(page, {})
    pages = [f"<article><h1>Title {k}</h1><p>{prose(k)}</p><div class=related>{'See ' + str(k)}</div>{'<section class=discussion><p>Only here</p></section>' if k == 1 else ''}</article>" for k in range(4)]
    assert read(pages) == [f"Title {k}\n\n{prose(k)}" + ("\n\nOnly here" if k == 1 else "") for k in range(4)]


def test_a_repeated_group_of_several_elements_meets_one_occurrence():
    many, one = (H.wrapper_of(f"<body><article>{''.join(f'<h2>{t}{k}</h2><p>{t}{k}x</p>' for k in range(n))}</article></body>") for t, n in (("a", 5), ("b", 1)))
    for w in (H.merged(many, one), H.merged(one, many)):
        (group,) = w[2][0][2][0][2]
        assert group[:2] == ["(h2 p)", "+"] and [x[:2] for x in group[2]] == [["h2", ""], ["p", ""]]
        assert group[2][0][2][0][2] is None  # a slot
    assert H.unflat(H.flat(w)) == w


def longest(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    return size[0][0]


def test_alignment_against_the_definition(monkeypatch):
    import random

    r = random.Random(3)
    for cells in (1 << 20, 4):
        monkeypatch.setattr(H, "CELLS", cells)
        for _ in range(300):
            a, b = (r.choices("pqrstuv", k=r.randint(0, 12)) for _ in range(2))
            got = H.matches(a, b)
            assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
            assert len(got) == longest(a, b) if cells > 4 else len(got) <= longest(a, b)


def test_deep_and_wide_pages():
    wide = "".join(f"<h2>a{k}</h2><p>x{k} {prose(k, 3)}</p>" for k in range(50_000))
    for page in ("<div>" * 10_000 + "<p>in</p>", "<div><p>a</p>" * 3000, "<ul><li>x" * 3000, wide, "".join(f"<div class=c{k}>a</div>" for k in range(20_000)), "".join(f"<div class=c{k * k % 20_011}>a</div><p>b" for k in range(8000))):
        w = H.merged(H.wrapper_of(page), H.wrapper_of(page + "<p>more</p>"))
        rule = H.rule_of(H.unflat(H.flat(H.canonical(w))))
        assert H.extract(page, rule)


def test_the_wrapper_decides(spark):
    """Without the wrapper the template's texts and blocks would stay, and the prose beside the root would go."""
    pages = [f"<body><article><h1>Title {k}</h1><p>{prose(k)}<p>Send this page to a friend</p></article><div class=rest><p>{prose(k + 50)}</p></div></body>" for k in range(5)]
    rows = spark.createDataFrame([(k, "http://h.x/" + str(k), p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.main_text(rows).collect()}
    assert got == {k: f"Title {k}\n\n{prose(k)}\n\n{prose(k + 50)}" for k in range(5)}
    assert all(H.extract(p, {}) != got[k] for k, p in enumerate(pages))
