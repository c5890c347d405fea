import random
import re

from chronoweave.llm import wrappers as W

PAGE = "<html><head><title>T</title><script>x='</p>'</script></head><body><nav><ul><li>m</li><li>n</li></ul></nav><article><h1>{0}</h1>{1}</article><footer>&copy; host</footer></body></html>"


def page(title, *paragraphs):
    return PAGE.format(title, "".join(f"<p>{p}</p>" for p in paragraphs))


def test_extracts_article_only():
    assert W.extract(page("A &amp; B", "one  two", "th<b>r</b>ee<br>x")) == "A & B\none two\nthree x"


def test_broken_and_odd_pages():
    assert W.extract(None) == W.extract("") == W.extract("<!-- only") == ""
    assert W.extract("<body><p>a &lt;b&gt;<p>c") == "a <b>\nc"
    assert W.extract('<div class="ad">no</div><p title="a>b">yes</p><aside>no</aside><form>no</form><div id="comments"><p>no</p></div>') == "yes"
    assert W.extract("plain text") == "plain text"


def test_fold_makes_groups():
    nodes, at = W.fold(["<p>", "#", "</p>", "<p>", "#", "</p>", "<h1>", "#", "</h1>"])
    assert nodes == ["(<p>#</p>)+", "<h1>", "#", "</h1>"] and at == [None, None, 2]


def test_alignment_is_union_free():
    a, _ = W.page_nodes(W.read_stream("<div><h1>x</h1><p>same</p><ul><li>1</li><li>2</li></ul></div>"))
    b, _ = W.page_nodes(W.read_stream("<div><h1>y</h1><p>same</p><hr><ul><li>1</li></ul></div>"))
    text = W.expression(W.align(a, b))
    assert text == "<div><h1>#</h1><p>=</p><hr>?<ul>(<li>#</li>)+</ul></div>"


def test_template_text_is_dropped(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div><b>Welcome to h</b></div><h2>t{i}</h2><p>text {i}</p><p>more {i}</p></body>") for i in range(30)]
    rows += [(100, None, None), (101, "http://h.example/0", rows[0][2]), (102, "not a url", "<p>x</p>")]
    got = {r["page_id"]: r["text"] for r in W.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "t3\ntext 3\nmore 3" and got[101] == got[0] and got[100] == "" and got[102] == "x"
    assert len(got) == 33


def test_empty_table(spark):
    assert W.extract_pages(spark.createDataFrame([], "page_id long, url string, html string, host string")).count() == 0


def test_copied_articles_stay_whole(spark):
    """30 copies of one article, 25 near copies, and 30 copies outside <article> among other pages."""
    same = page("Title", "one", "two")
    loose = "<body><h2>Head {0}</h2><blockquote>Quote {0}</blockquote><p>a {0}</p><p>b {0}</p></body>"
    rows = [(i, f"http://copies.example/{i}", same) for i in range(30)]
    rows += [(100 + i, f"http://near.example/{i}", page("Title", "one", f"two {i}")) for i in range(25)]
    rows += [(200 + i, f"http://mixed.example/{i}", loose.format("x")) for i in range(30)]
    rows += [(300 + i, f"http://mixed.example/o{i}", f"<body><h2>t{i}</h2><p>c {i}</p><p>d {i}</p></body>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in W.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(30)} == {"Title\none\ntwo"}
    assert all(got[100 + i] == f"Title\none\ntwo {i}" for i in range(25))
    assert {got[200 + i] for i in range(30)} == {"Head x\nQuote x\na x\nb x"}


def accepts(wrapper, symbols):
    """Whether the wrapper, read as a regular expression over symbols, matches the whole stream."""
    letters = W._Letters()
    one = lambda s: re.escape(letters[s])
    parts = []
    for x in wrapper:
        inner = re.findall(r"<[^>]*>|#", x.key[1:-2]) if x.key[0] == "(" else [x.key]
        parts.append(f"(?:{''.join(map(one, inner))}){'+' if x.key[0] == '(' else ''}".join(("(?:", ")?")) if x.optional else f"(?:{''.join(map(one, inner))}){'+' if x.key[0] == '(' else ''}")
    line = "".join(letters[s] for s in symbols)
    return re.fullmatch("".join(parts), line, re.S) is not None


def test_wrapper_accepts_every_page_it_was_made_of():
    """Against brute force: the inferred expression matches all streams, whatever order they are aligned in."""
    rnd = random.Random(2)
    blocks = ["<h2>{0}</h2>", "<p>{0}</p>", "<ul>" + "<li>{0}</li>" * 3 + "</ul>", "<div class=note><p>same</p></div>", "<hr>", "<p>{0}</p>" * 4]
    for _ in range(150):
        streams = [W.read_stream("<body><h1>t</h1>" + "".join(rnd.choice(blocks).format(rnd.randint(0, 9)) for _ in range(rnd.randint(0, 5))) + "</body>") for _ in range(rnd.randint(2, 5))]
        wrapper = W.page_nodes(streams[0])[0]
        for s in streams[1:]:
            wrapper = W.align(wrapper, W.page_nodes(s)[0])
        assert all(accepts(wrapper, s.symbols) for s in streams), W.expression(wrapper)


def test_small_hosts(spark):
    """Three pages are enough for what no mark-up names; two edited copies of one page share their article and keep it."""
    notice = "<body><div><b>All rights reserved by us</b></div><h2>t{0}</h2><p>text {0}</p><blockquote>more {0}</blockquote></body>"
    rows = [(i, f"http://small.example/{i}", notice.format(i)) for i in range(3)]
    near = "<body><h2>Head</h2><p>first</p><blockquote>second</blockquote><h3>third {0}</h3></body>"
    rows += [(10 + i, f"http://near.example/{i}", near.format(i)) for i in range(2)]
    got = {r["page_id"]: r["text"] for r in W.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == [f"t{i}\ntext {i}\nmore {i}" for i in range(3)]
    assert got[10] == "Head\nfirst\nsecond\nthird 0"
