"""Operators over pages."""

import datetime
import gzip
import hashlib
import zlib
from collections import Counter

import pytest

from imagelake.llm import htmltext, urlfilter, warc

LONG = "This is the first of the long paragraphs that we have in the text of the page, and it is here to be found by the reader who wants it, as it was said in the book that has been written about it all, and so on."


def pages():
    big = "<p>" + "word " * 60_000 + "</p>"
    same = "<html>" + "a" * 200 + "</html>"
    rows = [(i, f"http://h{i}.example.org/", f"<p>{i} " + "é" * i + "</p>") for i in range(20)]
    rows += [(20, "http://x/\r\nInjected: 1", same), (21, None, same), (22, "http://y/", same), (22, "http://y/", same), (None, "http://z/", same)]
    rows += [(23, "http://a/", None), (24, "http://a/", ""), (25, "http://a/", "short"), (26, "http://a/", "short"), (27, "http://b/", big), (28, "http://b/", big), (None, "http://c/", "c" * 150)]
    return rows


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in pages()], "page_id long, url string, html string, path string, digest int").repartition(3)
    out = warc.archive_round_trip(df, texts=True).collect()
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first = {}
    for i, _, h in pages():
        if len((h or "").encode()) >= 100 and i is not None:
            first[digest(h)] = min(first.get(digest(h), i), i)
    want = Counter()
    for i, _, h in pages():
        to = first.get(digest(h))
        revisit = to is not None and to != i
        want[i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", to if revisit else None, None if revisit else h or ""] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html) for r in out) == want
    assert {r.url for r in out if r.page_id == 20} == {"http://x/%0D%0AInjected:%201"}


def test_warc_normaliser_index(spark, tmp_path):
    records = [warc.page_record(i, f"http://p/{i}", b"payload %d" % i * 50, "0" * 64, None, False) for i in range(30)]
    (tmp_path / "mono.warc.gz").write_bytes(gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:])))
    paths = spark.createDataFrame([(f"file://{tmp_path}/mono.warc.gz",)], "path string")
    made = warc.normalise_archives(paths, f"file://{tmp_path}/out").collect()
    assert [r.records for r in made] == [30]
    index = warc.sidecar_index(spark, f"file://{tmp_path}/out").orderBy("offset").collect()
    assert len(index) == 30
    name = index[0].path.removeprefix("file://")
    assert name == made[0].path
    data = open(name, "rb").read()
    assert b"".join(zlib.decompress(data[r.offset : r.offset + r.length], 31) for r in index) == b"".join(records)
    assert gzip.decompress(data) == b"".join(records)  # still one valid stream
    lines = open(name + ".idx").read().splitlines()
    assert [x.split("\t")[0] for x in lines] == [str(r.offset) for r in index] and index[3].target == "http://p/3" and index[3].record_type == "response"


def test_warc_work_is_dealt_out(spark):
    """Archives are inflated, and records read, in as many tasks as there are shuffle partitions."""
    from imagelake.llm.common import scratch_path, table

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.createDataFrame([(i, "http://x/", f"page {i}" * 40) for i in range(200)], "page_id long, url string, html string").repartition(8)
    where = scratch_path(spark, "warc")
    mono = table(warc.write_archives(df, f"{where}/mono"), "archives")
    assert mono.count() == 8
    copies = warc.normalise_archives(mono, f"{where}/records")
    assert copies.rdd.getNumPartitions() == tasks
    assert sum(r.records for r in copies.collect()) == 208  # with a warcinfo record each
    rows = warc.read_archives(warc.sidecar_index(spark, f"{where}/records"))
    assert rows.rdd.getNumPartitions() == tasks and rows.count() == 200
    assert max(rows.rdd.glom().map(len).collect()) < 100


def test_warc_file_stays_if_written_twice(tmp_path):
    fs, folder = warc.store(f"file://{tmp_path}")
    for data in (b"abc", b"abc", b"abcd"):
        out = warc.Placed(fs, f"{folder}/x")
        out.write(data)
        out.close()
        assert (tmp_path / "x").read_bytes() == data and len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("cut", [10, 300])
def test_warc_damage_is_reported(cut):
    whole = gzip.compress(b"".join(warc.page_record(i, "http://p/", bytes(range(256)) * 9, "0" * 64, None, False) for i in range(9)))
    source = iter([whole[:-cut], b""])
    with pytest.raises(ValueError):
        list(warc.Records(warc.inflate(lambda n: next(source))))


def test_warc_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<p></p>", ""),
        ("<nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>Short <b>one</b>.<br>Next</p></article><footer>&copy; us</footer>", "Title & more Short one. Next"),
        ("<article><p>Text.</p><aside>Other</aside><form>Name <input></form><div class='ad box'>Buy</div><p>End</p></article>", "Text. End"),
        ("<article><p>A</p><script>var x='</p>';</script><!-- c --><style>p{}</style><p>B</p>", "A B"),
        ("<div class=ad>Unclosed <article><p>Text</p></article>", "Text"),
        ("<article><p>Text</p></article><section id=comments><article><p>I disagree</p></article></section>", "Text"),
        ("<main><p>a\n\t b</p><div class='cookie-notice'><p>We use cookies</p></div></main>", "a b"),
        (f"<div class=menu><a href=x>One</a></div><p>{LONG}</p><p>Short tail.</p><p>{LONG}</p><div><a href=x>Imprint</a></div>", f"{LONG} Short tail. {LONG}"),
        ("<article><p>1 &lt; 2 &#233; &#x41; &nbsp;x &am</p>", "1 < 2 é A x &am"),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article style="overflow:hidden" title="A hidden valley" data-id="menu-3"><p>Text</p></article>', "Text"),
        ("<article><div style='overflow:hidden'><p>A</p></div><div data-class=ad data-role='navigation'><p>B</p></div><div title=\"class='ad'\"><p>C</p></div></article>", "A B C"),
        ("<article><p>A</p><div HIDDEN><p>B</p></div><div aria-hidden = 'true'><p>C</p></div><div aria-hidden=false><p>D</p></div><div role=navigation><p>E</p></div></article>", "A D"),
        ('<article class="post tag-social"><p>Text</p></article>', "Text"),
        ('<article><p>A</p><section id="discussion"><h2 id="related-work">Discussion</h2><p>B</p></section></article>', "A Discussion B"),
        (f'<html class="no-sidebar"><body class="right-sidebar comments"><p>{LONG}</p><div class="menu"><a href=x>Menu</a></div></body></html>', LONG),
        (f'<div class="widget Blog"><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><div class="sidebar"><a href=x>Link</a> more</div></div>', f"Title {LONG} Short. {LONG}"),
        (f'<article><p>A</p><div class="related-work"><p>{LONG}</p><p>B</p></div><div class="share-this"><p>Share</p></div></article>', f"A {LONG} B"),
        (f'<article><p>A</p><div class="ad-slot"><p>{LONG}</p></div><ol class="comment-list"><li>{LONG}</ol></article><article class="comment"><p>{LONG}</p></article>', "A"),
    ],
)
def test_main_text_names(page, text):
    """Attributes are read by exact name, and words of class and id don't outweigh the text."""
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><title-card><p>A</p></title-card><button-row><p>B</p></button-row><head-line>C</head-line></article>", "A B C"),
        (f"<p>{LONG} © 2024 Somebody.</p><p>© 2024 Somebody, and all the rights are theirs.</p>", f"{LONG} © 2024 Somebody."),
        ('<article><script data-x="a<b">var x = "</p>";</script><p>A</p></article>', "A"),
        ("<article><p>A</p><script src=x /><p>B</p></article>", "A B"),
        ("<article><p>A</p></nav></div><p>B</p></article>", "A B"),
    ],
)
def test_main_text_tags(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("part", ["<div><section>", "<div></nav>", "<script ", "<script '", "<script \"", '<p title="', '<div class="menu">', "<title", "&amp", "<!", "<a b='", "</script "])
def test_main_text_is_linear(part):
    import time

    took = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        htmltext.main_text(part * n + "text")
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2


def plain_text(page):
    """The article's text by the standard library's parser, for pages whose article stands in an article element."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.parts, self.inside, self.away = [], [], 0, []

        def cut(self):
            self.blocks.append(" ".join("".join(self.parts).split()))
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag not in ("b", "i", "em", "strong", "a", "span", "code"):
                self.parts.append(" ") if tag == "br" else self.cut()
            self.inside += tag == "article"
            if tag in ("script", "style", "nav", "aside", "footer", "form") or tag == "div" and dict(attrs).get("class") in ("ad", "share", "comments"):
                self.away.append(tag)

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "em", "strong", "a", "span", "code"):
                self.cut()
            self.inside -= tag == "article"
            if self.away and self.away[-1] == tag:
                self.away.pop()

        def handle_data(self, data):
            if self.inside and not self.away:
                self.parts.append(data)

    parser = Parser()
    parser.feed(page)
    parser.cut()
    return " ".join(filter(None, parser.blocks))


def test_extract_equals_a_plain_parser(spark):
    """All pages of the sf0.01 table."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html or "" for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(pages).collect()}
    assert got == {i: (t, len(t)) for i, t in ((i, plain_text(h)) for i, h in html.items())} and any(t for t, _ in got.values())


def test_extract_of_an_empty_table(spark):
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_extract(spark):
    rows = [(1, "u", "<article><p>É ß</p></article>", "x"), (1, "u", "<article><p>É ß</p></article>", "x"), (None, None, None, None), (2, "v", "<article>" + "<p>word</p>" * 20_000, "y")]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert Counter((r.page_id, r.url, r.n_chars) for r in out) == Counter({(1, "u", 3): 2, (None, None, 0): 1, (2, "v", 99_999): 1})


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_url_filter(spark):
    entries = [
        ("d:example.org", "spam", day(10), "add"), ("d:example.org", "spam", day(20), "remove"), ("d:example.org", "spam", day(30), "add"),
        ("h:a.example.org", "allow", day(0), "add"), ("p:b.example.org/x", "malware", day(5), "add"), ("p:b.example.org/x", "malware", day(5), "remove"),
        ("p:b.example.org/x", "malware", day(6), "add"), (None, "spam", day(0), "add"), ("d:other", "spam", None, "add"), ("d:bad", "spam", day(0), "add"),
    ]
    cases = [
        (1, "http://www.example.org/", day(9), "none"), (2, "http://www.example.org/", day(10), "block"), (3, "https://u:p@EXAMPLE.org:80/", day(19), "block"),
        (4, "http://example.org", day(20), "none"), (5, "http://example.org", day(300), "block"), (6, "http://a.example.org/q", day(15), "allow"),
        (7, "http://b.example.org/x/y?z", day(5), "none"), (8, "http://b.example.org/x/y?z", day(6), "block"), (9, "http://b.example.org/xy", day(6), "none"),
        (10, None, day(15), "none"), (11, "not a url", day(15), "none"), (12, "http://example.org/", None, "none"), (13, "http://notexample.org/", day(15), "none"),
        (14, "http://very.bad./", day(1), "block"), (14, "http://very.bad./", day(1), "block"), (None, "http://bad/", day(1), "block"),
    ]
    captures = spark.createDataFrame([(i, u, d, "k", 1) for i, u, d, _ in cases], "page_id long, url string, fetch_date date, key string, salt int")
    listed = spark.createDataFrame(entries, "pattern string, category string, entry_date date, action string")
    out = urlfilter.url_filter(captures, listed).collect()
    assert Counter((r.page_id, r.verdict) for r in out) == Counter((i, v) for i, _, _, v in cases)
    assert urlfilter.url_filter(captures.limit(0), listed.limit(0)).count() == 0


def test_url_filter_categories(spark):
    """A pattern in several categories: entries of one leave those of the others active."""
    entries = [
        ("d:x.org", "malware", day(0), "add"), ("d:x.org", "spam", day(10), "add"), ("d:x.org", "spam", day(20), "remove"),
        ("d:y.org", "allow", day(0), "add"), ("d:y.org", "malware", day(0), "add"), ("d:y.org", "malware", day(5), "remove"),
        ("d:z.org", "adult", day(3), "remove"), ("d:z.org", "spam", day(3), "add"), ("d:z.org", "spam", day(3), "add"),
    ]
    cases = [
        ("x", 5, "block", "malware", 1), ("x", 15, "block", "spam", 2), ("x", 25, "block", "malware", 1),
        ("y", 0, "block", "malware", 2), ("y", 5, "allow", "allow", 1), ("z", 2, "none", None, 0), ("z", 3, "block", "spam", 1),
    ]
    captures = spark.createDataFrame([(i, f"http://{h}.org/", day(n)) for i, (h, n, *_) in enumerate(cases)], "page_id long, url string, fetch_date date")
    out = urlfilter.url_filter(captures, spark.createDataFrame(entries, "pattern string, category string, entry_date date, action string"))
    assert sorted((r.page_id, r.verdict, r.category, r.n_active) for r in out.collect()) == [(i, *c[2:]) for i, c in enumerate(cases)]


def test_url_filter_long_urls_and_addresses(spark):
    entries = [
        ("d:x.org", "spam", day(0), "add"), ("p:deep.org/" + "/".join("ab" * 20), "malware", day(0), "add"), ("p:deep.org/q", "adult", day(0), "add"),
        ("h:[2001:db8::1]", "malware", day(0), "add"), ("d:[::2]", "spam", day(0), "add"), ("p:[::3]/x", "spam", day(0), "add"),
    ]
    deep = "/".join("ab" * 20)
    cases = [
        ("http://deep.org/" + "s/" * 500_000, "none", 0), ("http://deep.org/q/" + "s/" * 500_000, "block", 1), ("http://deep.org/q" + "s" * 1_000_000, "none", 0),
        (f"http://deep.org/{deep}/more", "block", 1), (f"http://deep.org/{deep}x", "none", 0), (f"http://deep.org//{deep.replace('/', '//')}", "block", 1), ("http://deep.org/" + "/" * 1_000_000 + "q", "block", 1),
        ("http://" + "l." * 200_000 + "x.org/", "block", 1), ("http://[2001:DB8::1]:80/", "block", 1), ("http://u@[::2]/y", "block", 1), ("https://[::3]/x/y", "block", 1), ("http://[::4]/x", "none", 0),
    ]
    captures = spark.createDataFrame([(i, u, day(1)) for i, (u, *_) in enumerate(cases)], "page_id long, url string, fetch_date date")
    listed = spark.createDataFrame(entries, "pattern string, category string, entry_date date, action string")
    out = sorted((r.page_id, r.verdict, r.n_active) for r in urlfilter.url_filter(captures, listed).select("page_id", "verdict", "n_active").collect())
    assert out == [(i, *c[1:]) for i, c in enumerate(cases)]


PROSE = "It was the best of times and it was the worst of times, and there was nothing in it for us but to go on with the work that we had begun. " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><head><title>t</title><meta charset=utf-8><body><article><p>{PROSE}</p></article></body></html>", PROSE),
        (f"<html><head><title>t</title><style>p {{}}</style><article><p>{PROSE}</p></article>", PROSE),
        (f"<article><button>Share<p>{PROSE}</p></article>", PROSE),
        (f"<article><div><button>Share</div><p>{PROSE}</p><select><option>a</article>", PROSE),
        (f"<article><noscript><p>{PROSE}</p></article>", PROSE),
        (f"<article><noscript><p>Enable scripts.</p></noscript><p>{PROSE}</p><svg><text>x</text></svg></article>", PROSE),
        (f"<article><p>{PROSE}</p><section id=reply><h2>Reply</h2><p>{PROSE}</p></section></article>", PROSE + "Reply " + PROSE),
        (f"<article><p>{PROSE}</p><p><a href=x>A paragraph that is wholly one link, as some of them are in this paper.</a></p></article>", PROSE + "A paragraph that is wholly one link, as some of them are in this paper."),
        (f"<article><p>{PROSE}</p><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></article>", PROSE),
        (f"<article><p>{PROSE}</p><div id=comments><p>{PROSE}</p></div></article>", PROSE),
        ("<nav><a href=x>首页</a></nav><div><p>" + "他在那里住了很多年,后来又回到了故乡,写下了这本关于战争与和平的书。" * 12 + "</p></div>", "他在那里住了很多年,后来又回到了故乡,写下了这本关于战争与和平的书。" * 12),
        ("<ul><li><a href=x>Главная</a></li></ul><div><p>" + "Он жил там много лет, а потом вернулся домой и написал эту книгу. " * 8 + "</p></div>", "Он жил там много лет, а потом вернулся домой и написал эту книгу. " * 8),
        ("<p>a<script>var x = '<p>", ""), ("<p>" + "<button>" * 2000, ""), ("<noscript>" * 3000, ""),
    ],
)
def test_extraction_of_loose_markup(page, want):
    assert htmltext.main_text(page) == want.strip()
