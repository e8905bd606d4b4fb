from collections import Counter, defaultdict

from kgivm.llm import op5_html_extraction as op5
from kgivm.llm.op5_html_extraction import Page, extract

SF = "/root/testdata/sf0.01"

CASES = [
    ("", ""),
    ("<p>a &amp; b&nbsp;&lt;c&gt;\n d</p><p> </p><p>e", "a & b <c> d\ne"),
    ("<nav>menu</nav><article><h1>T</h1><p>x<b>y</b>z<p>two<div class='ad'>no</div></article><footer>f</footer>", "T\nxyz\ntwo"),
    ("<article><header><h1>H</h1></header><p>1<br>2</p><aside>s</aside><form><p>q</p></form><section id=comments><p>c</p></section></article>", "H\n1\n2"),
    ("<body><header>top</header><div class=cookie-notice>ok?</div><main><p>m</p></main></body>", "m"),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>c</p> --><p>yes", "yes"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>cut</p><p cla", "cut"),
    ("a < b <3 c", "a < b <3 c"),
    ("<article>" + "<div>" * 3000 + "deep", "deep"),
]


def test_pages():
    for source, want in CASES:
        assert Page(source).text(frozenset()) == want, source


def test_templates_go_and_copied_articles_stay(spark):
    box = "<section class='x'>Read our other stories</section>"
    rows = [(i, f"http://Host.example/{i}", f"<body><div>Site name</div><p>own {i}</p></body>", "x") for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", f"<article><p>same paragraph</p>{box}<p>own {i}</p></article>", "x") for i in range(20)]
    rows += [(200, None, None, "x"), (201, "http://c.example/", "<body><div>Site name</div></body>", "x"), (0, "http://Host.example/0", rows[0][2], "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(frame).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by_id[i].text == f"own {i}" and by_id[i].n_chars == len(f"own {i}") for i in range(20))
    assert all(by_id[100 + i].text == f"same paragraph\nown {i}" for i in range(20))
    assert (by_id[200].text, by_id[200].n_chars, by_id[201].text) == ("", 0, "Site name")
    assert extract(frame.limit(0)).count() == 0


def test_counts_equal_brute_force_and_change_pages(spark):
    """Per-host counts against a plain loop; templates delete subtrees of most pages, and no text of an article."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, r.html or "") for r in pages.collect()]
    stands, total = defaultdict(Counter), Counter()
    for url, source in {(u, s) for _, u, s in rows}:
        host = (url or "").split("://")[-1].split("/")[0].lower()
        page = Page(source)
        prints = page.prints()
        total[host] += 1
        stands[host].update({prints[i] - (1 << 63) for i in page.boxes(page.roots(set()))})
    often = lambda n, of: n >= op5.MIN_PAGES and 100 * n >= op5.MIN_PERCENT * of or n >= op5.FEW_PAGES and 100 * n >= op5.FEW_PERCENT * of
    want = {(h, x) for h, c in stands.items() for x, n in c.items() if often(n, total[h])}
    _, template = op5.template_counts(pages)
    assert {(r.host, r.hash) for r in template.collect()} == want
    got = {r.page_id: r for r in extract(pages).collect()}
    assert sum(r.n_template > 0 for r in got.values()) > 0
    for i, _, source in rows:
        assert got[i].text == Page(source).text(frozenset())


def test_templates_alone_clear_a_host(spark):
    """Menus, notices, footers and repeated boxes go by their counts, without a look at tags or words; on a host of four pages too."""
    def page(host, i):
        return f"<body><div><ul><li><a href=/a>Home</a></li><li>News of {host}</li></ul></div><div>We use biscuits</div><div><p>own text {i} of {host}</p><div><b>Write to us</b></div></div><div>All rights by {host}</div></body>"

    rows = [(100 * n + i, f"http://{h}/{i}", page(h, i), 1, 2) for n, (h, count) in enumerate((("a.example", 30), ("b.example", 4))) for i in range(count)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host int, content int")
    _, template = op5.template_counts(frame)
    hashes = defaultdict(set)
    for r in template.collect():
        hashes[r.host].add(r.hash + (1 << 63))
    for key, url, source, *_ in rows:
        host = url.split("/")[2]
        assert Page(source).text(frozenset(hashes[host]), lists=False) == f"own text {key % 100} of {host}"
    assert all(r.n_template >= 4 and r.n_chars == len(r.text) for r in extract(frame).collect())


def test_very_long_page(spark):
    source = "<article>" + "".join(f"<p>paragraph {i} &amp; more</p>" for i in range(60_000)) + "</article>"
    (r,) = extract(spark.createDataFrame([(1, "http://l.example/", source)], "page_id long, url string, html string")).collect()
    assert r.n_chars == len(r.text) and r.text.count("\n") == 59_999 and r.text.endswith("paragraph 59999 & more")
