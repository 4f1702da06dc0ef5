import pytest

from tidemark.llm import html


def page(title, paragraphs, comments=(), aside=True):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    talk = "".join(f'<article class="comment"><p>{c}</p></article>' for c in comments)
    side = "<aside><p>aside text</p></aside>" if aside else ""
    return (
        f"<!doctype html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body class='x'>"
        f"<header><a href='/'>Site</a></header><nav><ul><li>a<li>b</ul></nav><div id=cookie-notice>We use cookies</div><main><article><h1>{title}</h1>{body}"
        f"<form><input><p>subscribe</p></form></article>{side}<section class='comments'>{talk}</section></main><footer>&copy; x</footer></body></html>"
    )


def extracted_by(pages, page):
    wrapper = html.infer(pages)
    main = html.main_element(wrapper)
    if main is not None:
        main.main = True
    return html.extract(page, wrapper)


def test_whole_article_without_the_rest():
    found = html.extract(page("T &amp; U", ["one <b>t</b>wo<br>three", "a\n \tb&nbsp;c &lt;p&gt;"], ["great!"]))
    assert found == "T & U one two three a b c <p>"


@pytest.mark.parametrize("source", [None, "", "<", "<p", "</p></p>", "<article>", "<article", "x" * 100_000, "<p>" * 20_000, '<a title="x>text'])
def test_odd_pages(source):
    text = {"<": "<", "x" * 100_000: "x" * 100_000}.get(source, "")
    assert html.extract(source) == extracted_by([source, page("a", ["b"])], source) == (text if source != '<a title="x>text' else "text")


@pytest.mark.parametrize("odd", ['<svg class="i"/>', '<iframe src="x"/>', "<title-bar>bar</title-bar>", "<svg>drawn</svg>", "<script>var a='</article>'</script>", "<style-guide></style-guide>", "<iframe src=x>", "<object data=x>"])
def test_odd_elements_swallow_nothing(odd):
    found = html.extract(f"<body><article><p>T one {odd} two</p><p>three</p></article></body>")
    assert found.replace("bar ", "") == "T one two three"


def test_names_that_may_mean_something_else():
    body = '<div class="search-results"><p>A result is found here.</p></div><section class="social history"><p>The strike of the weavers began in May. It lasted.</p></section><p>We <span class="share">share</span> it</p>'
    assert html.extract(f"<article>{body}</article>") == "A result is found here. The strike of the weavers began in May. It lasted. We share it"
    assert html.extract('<article><p hidden>x</p><div style="color:red; display: none">y</div><p class="hidden-print">kept</p><div class="related-posts"><a href=x>More</a></div></article>') == "kept"
    assert html.extract('<article><p>a</p><div class="share"><a href=x>Share</a></div><div class="cookie-notice">b</div><ul class=comments><li>c</ul></article>') == "a"


def test_deep_and_wide_pages():
    assert html.extract("<article>" + "<div>" * 10_000 + "deep" + "</div>" * 10_000 + "<p>after</p></article><footer>f</footer>") == "deep after"
    wide = "<article>" + "<p>a</p><div>b</div>" * 25_000 + "</article>"
    assert extracted_by([wide, wide.replace("a</p>", "c</p>"), page("t", ["u"])], wide) == " ".join(["a b"] * 25_000)
    many = "<article>" + "".join(f"<div class='k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'>{i}</div>" for i in range(20_000)) + "</article>"
    assert extracted_by([many, page("t", ["u"]), many + "<p>x"], many) == " ".join(map(str, range(20_000)))


def test_unclosed_elements():
    assert html.extract("<body><article><h1>t</h1><p><b>x<br><p>y<ul><li>p<li>q</ul>z</article><footer>f</footer>") == "t x y p q z"


def test_wrapper_has_slots_options_and_repeats():
    wrapper = html.infer([page("a", ["x", "y"]), page("b", ["z"], aside=False), page("c", ["u", "v", "w"], ["k", "l"])])
    text = html.expression(wrapper)
    assert "( <p> #TEXT </p> )+" in text and "<h1> #TEXT </h1>" in text and "( <aside> <p> " in text and " </p> </aside> )?" in text
    assert "( <article comment> <p> #TEXT </p> </article> )+" in text
    assert html.main_element(wrapper).key == "article"


def as_regex(node):
    """A wrapper as a regular expression over the tokens of pattern_of()."""
    import re

    if not node.key:
        own = "T(?:0|%d);" % node.hash if node.hash else r"T\d+;"
    else:
        inner = "".join(map(as_regex, node.parts))
        own = f"<{re.escape(node.key)};(?:{inner})*>" if node.loose else f"<{re.escape(node.key)};{inner}>"
    mark = "*" if node.repeated and node.optional else "+" if node.repeated else "?" if node.optional else ""
    return f"(?:{own}){mark}"


def pattern_of(node):
    return f"<{node.key};{''.join(map(pattern_of, node.parts))}>" if node.key else f"T{node.hash};"


def test_wrappers_accept_every_page_they_are_made_of():
    import random
    import re

    rng = random.Random(3)

    def made(depth):
        return "".join(rng.choice([f"<p>{rng.choice('abc')}</p>", f"<div class={rng.choice('xy')}>{made(depth - 1) if depth else 'z'}</div>", "<h2>h</h2>", "t "]) for _ in range(rng.randint(0, 4)))

    for _ in range(300):
        pages = [f"<body>{made(2)}</body>" for _ in range(rng.randint(1, 5))]
        wrapper = html.infer(pages)
        for p in pages:
            assert re.fullmatch(as_regex(wrapper), pattern_of(html.tree(p))), (pages, html.expression(wrapper))


def best_alignment(x, y):
    """The most pairs of equal kinds in order, by trying all."""
    if not x or not y:
        return 0
    return max(best_alignment(x[1:], y), best_alignment(x, y[1:]), 1 + best_alignment(x[1:], y[1:]) if x[0] == y[0] else 0)


def test_alignment_as_by_trying_all():
    import random

    rng = random.Random(4)
    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 6))] for _ in range(2))
        out = html.matched([html.Element(k) for k in x], [html.Element(k) for k in y])
        assert sum(not e.optional for e in out) == best_alignment(x, y)
        assert len(out) == len(x) + len(y) - best_alignment(x, y)


def test_wrapper_finds_what_a_page_alone_does_not_tell():
    pages = [
        f"<body><div class='top'>The daily page</div><div class='story x'><h2>{t}</h2><div class=y>Read it in our shop.</div><p>{' '.join([t] * 60)}</p><div class='q'>label</div></div><div class='links'><p>m</p></div></body>"
        for t in "abcdef"
    ]
    wrapper = html.infer(pages)
    assert html.main_element(wrapper).key == "div story x"
    assert extracted_by(pages, pages[0]) == " ".join(["a"] * 61)
    assert html.extract(pages[0]) != extracted_by(pages, pages[0])  # without the other pages nothing is known to be the template's


def test_copies_of_a_page_keep_their_text():
    pages = [f"<body><article><h1>t</h1><p>same text</p><p>and more of it</p></article><footer>{n}</footer></body>" for n in range(9)]
    assert extracted_by(pages, pages[3]) == "t same text and more of it"


def test_other_template_on_the_host():
    shop = [f"<body><div id=main{n}><h1>{t}</h1><p>{t} is for sale</p></div></body>" for n, t in enumerate("abc")]
    blog = [page(t, [f"{t} {t}"] * 3) for t in "defghijk"]
    assert extracted_by(shop + blog, shop[0]) == "a a is for sale"
    assert extracted_by(shop + blog, blog[0]) == "d d d d d d d"


def test_rows(spark):
    rows = [(i, f"http://H.example/{i}", page(f"t{i}", [f"p{i}"] * 2), 1) for i in range(30)]
    rows += [(30, None, None, 2), (31, "no host", "<p>free", 3), (31, "no host", "<p>free", 3), (None, "http://h.example", "<div>a</div>", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = html.extracted(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in found.collect())
    assert got == sorted([(i, f"t{i} p{i} p{i}", len(f"t{i} p{i} p{i}")) for i in range(30)] + [(30, "", 0), (31, "free", 4), (31, "free", 4), (-1, "a", 1)])
    assert html.extracted(pages.limit(0)).count() == 0


def test_wrappers_too_large_to_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}/{i}", page(f"t{i}", [f"p{i}", "q"] * (i % 4))) for i in range(120)] + [(None, None, None), (3, "x", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    one = sorted(map(str, html.extracted(pages).collect()))
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html, "PART", 7)
    assert sorted(map(str, html.extracted(pages).collect())) == one and len(one) == 122
    assert html.extracted(pages.limit(0)).count() == 0
