import time

from prioscope.llm.html import extract, parse


def text_of(page):
    return "\n\n".join(t for t, _ in parse(page)[0])


def test_blocks_and_references():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two <b>x<p>three&nbsp;&#233;&lt;p&gt;</article><footer>f</footer>"
    assert text_of(page) == "A & B\n\none two x\n\nthree é<p>"


def test_boilerplate_goes():
    page = (
        '<body><header>top</header><div class="cookie-notice">we use</div><main><header><h1>Head</h1></header><p>Body <script>var t="</p>";</script>text</p>'
        '<aside>side</aside><form><p>mail</p></form><div id="comments"><p>nice</p></div><div class=ad>buy</div><ul><li>i<li>ii</ul><!-- <p>x</p> -->'
        '<div role="complementary">more</div></main><div class="sidebar">s</div></body>'
    )
    assert text_of(page) == "Head\n\nBody text\n\ni\n\nii"


def test_broken_pages():
    assert text_of("") == text_of("<article></article>") == "" and text_of("<") == "<"
    assert text_of("a < b <p>c") == "a < b\n\nc"
    assert text_of("</p></div>x<article><p>in<div>deep</article>out") == "in\n\ndeep"
    assert text_of("<article>" + "<div>" * 3000 + "x") == "x"
    assert text_of('<article><p title="a > b">q</p><script>never closed') == "q"


def test_templates_go_only_outside_the_article(spark):
    own = "<div><p>own text of page {0}</p></div>"
    rows = [(i, f"http://h.com/{i}", f"<body><div><p>welcome to our site</p></div>{own.format(i)}</body>") for i in range(30)]
    rows += [(100 + i, f"http://i.com/{i}", "<body><article><p>a copied article</p></article></body>") for i in range(30)]
    rows += [(200, None, None), (201, "http://h.com/", ""), (1, "http://h.com/1", rows[1][2])]
    pages = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, row int, text string")
    found = extract(pages).collect()
    assert len(found) == len(rows)
    texts = {r.page_id: r.text for r in found}
    assert all(texts[i] == f"own text of page {i}" for i in range(30))
    assert all(texts[100 + i] == "a copied article" for i in range(30))
    assert texts[200] == texts[201] == "" and all(r.n_chars == len(r.text) for r in found)
    assert extract(pages.where("false")).count() == 0


def test_deeply_nested_pages_take_linear_time():
    def seconds(levels):
        page = "".join(f"<div>word {i}" for i in range(levels)) + "</div>" * levels
        start = time.process_time()
        blocks, parents, hashes = parse(page)
        took = time.process_time() - start
        assert [i for _, i in blocks] == list(range(levels)) and parents == list(range(-1, levels - 1)) and len(set(hashes)) == levels
        return took

    seconds(1_000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.05)


def test_equal_subtrees_have_equal_hashes_and_only_those():
    first = parse("<div><p>a</p><p>b</p></div><div><p>a</p><p>b</p></div>")[2]
    assert first[:3] == first[3:] and len(set(first)) == 3
    other = parse("<div><p>b</p><p>a</p></div><section><p>a</p><p>b</p></section><div><p>ab</p></div><div></div>")[2]
    assert len({first[0], other[0], other[3], other[6]}) == 4 and other[-1] == 0


def test_template_far_above_a_block_deletes_it(spark):
    deep = "<div><section>" * 50 + "<p>menu of the site</p>" + "</section></div>" * 50
    rows = [(i, f"http://a.example/{i}", f"{deep}<div><p>own text {i}</p></div>") for i in range(20)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: f"own text {i}" for i in range(20)}


def test_templates_inside_articles_go_and_copies_of_articles_stay(spark):
    """Elements inside an article had no hash, so the counts decided nothing there."""
    letter = "<div><p>Get our weekly letter</p><p>Sign up here</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body><article><h1>Title {i}</h1><p>text {i} has many words of its own</p>{letter}<p>end {i} of an article</p></article></body>") for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", f"<article><h1>One title</h1><p>one text</p>{letter}<p>one end</p></article>") for i in range(20)]
    words = "a b c d e f g h i j k l m n o p q r s t".split()
    near = ["".join(f"<p>{w}{' changed' * (k == i)} and more</p>" for k, w in enumerate(words)) for i in range(20)]
    rows += [(200 + i, f"http://c.example/{i}", f"<article>{near[i]}</article>") for i in range(20)]
    rows += [(300 + i, f"http://d.example/{i}", f"<article><p>text {i}</p>{'<p>quoted</p>' * (i % 3 == 0)}</article>") for i in range(30)]
    rows += [(400, "http://a.example/only", f"<article>{letter}</article>")]
    texts = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(texts[i] == f"Title {i}\n\ntext {i} has many words of its own\n\nend {i} of an article" for i in range(20))
    assert all(texts[100 + i] == "One title\n\none text\n\nGet our weekly letter\n\nSign up here\n\none end" for i in range(20))
    assert all(texts[200 + i].count("and more") == 20 for i in range(20))
    assert all(texts[300 + i] == f"text {i}" + "\n\nquoted" * (i % 3 == 0) for i in range(30))
    assert texts[400] == "Get our weekly letter\n\nSign up here"


def test_a_template_around_an_article_leaves_it(spark):
    rows = [(i, f"http://a.example/{i}", f"<div>site name<article><p>text {i}</p></article></div>") for i in range(20)]
    rows += [(100 + i, f"http://a.example/{i}", f"<div>site name</div><p>bare {i}</p>") for i in range(20)]
    texts = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts == {**{i: f"text {i}" for i in range(20)}, **{100 + i: f"bare {i}" for i in range(20)}}
