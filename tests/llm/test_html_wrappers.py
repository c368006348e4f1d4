import html
import re

import pytest

from cliploom.llm import html_wrappers as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>x";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li>{menu}</ul></nav>
<div class="cookie-notice">We use cookies.</div>{promo}
<article><h1>{title}</h1>{body}<aside>Also read</aside><div class="ad">Buy</div></article>
<section class="comments"><p>First!</p></section><form><p>Mail</p></form><div id="sidebar"><p>Links</p></div><footer><p>&copy; me</p></footer></body></html>"""


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return {r.page_id: r.text for r in H.extract_pages(df).collect()}


def test_main_text_alone(spark):
    rows = [
        (1, "https://a.org/1", PAGE.format(menu="", promo="", title="One", body="<p>First &amp; <b>bold</b>\n text.<p>Second<br>line</p>")),
        (2, "https://A.org/2", PAGE.format(menu="<li>x</li>" * 5, promo='<div class="promo">Sale</div>', title="Two", body="<h2>H</h2><p>a</p><h2>I</h2><p>b</p><ul><li>c <a href=x>d</a></li><li>e</ul>")),
        (3, "https://a.org/3", PAGE.format(menu="", promo="", title="Three", body="")),
    ]
    assert texts(pages_of(spark, rows)) == {1: "One\nFirst & bold text.\nSecond line", 2: "Two\nH\na\nI\nb\nc d\ne", 3: "Three"}


def test_host_without_a_container(spark):
    """Fixed texts and link lists of the host go, what differs by page stays."""
    page = "<html><body><div class='top'>All about us</div><ul><li><a href=x>one</a><li><a href=y>two</a></ul><div><p>{}</p></div></body></html>"
    rows = [(i, f"http://b.org/{i}", page.format(f"Text number {i}.")) for i in range(5)]
    assert texts(pages_of(spark, rows)) == {i: f"Text number {i}." for i in range(5)}


def test_edges(spark):
    rows = [(1, None, None), (None, "not a url", ""), (2, "http://c.org", "<p>open <b>never closed"), (3, "http://c.org", "plain < text & more"), (3, "http://c.org", "plain < text & more"), (4, "http://d.org", "<div>" * 5000 + "deep"), (5, "http://e.org", "<article>" + "<p>x y</p>" * 20000)]
    out = H.extract_pages(pages_of(spark, rows).selectExpr("*", "1 AS host", "2 AS wrapper", "3 AS salt", "'t' AS text")).collect()
    assert len(out) == 7 and all(r.n_chars == len(r.text) for r in out)
    by = {(r.page_id, r.url): r.text for r in out}
    assert by[(1, None)] == "" and by[(None, "not a url")] == "" and by[(4, "http://d.org")] == "deep"
    assert by[(2, "http://c.org")] == "open never closed" and by[(3, "http://c.org")] == "plain < text & more"
    assert by[(5, "http://e.org")] == "\n".join(["x y"] * 20000)
    assert H.extract_pages(pages_of(spark, rows).limit(0)).count() == 0


def test_pages_against_plain_cutting(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = texts(df)
    for r in df.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1|h2|ul|li|div|blockquote)>", body))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("size", [0, 1 << 30])
def test_both_joins_agree(spark, size):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert sorted(map(tuple, H.extract_pages(df, broadcast_bytes=size).collect())) == sorted(map(tuple, H.extract_pages(df).collect()))


def test_alignment_makes_groups_optional_and_repeated():
    stream = lambda text: H.stream(H.parse(text))
    a = stream("<div><h2>x</h2><p>1</p><h2>y</h2><p>2</p></div>")
    b = stream("<div><h2>x</h2><p>1</p></div><hr><table><tr><td>z</td></tr></table>")
    flat = lambda parts: [(p[H.LABEL], p[H.KIND], flat(p[H.PARTS])) for p in parts]
    merged = flat(H.aligned(a, b))
    assert merged[0][0] == "div" and merged[1][:2] == ("table", "?")
    assert any(kind in "+*" and label == "(h2 p)" for label, kind, _ in merged[0][2])
    assert flat(H.aligned(stream("<p>a</p><p>b</p>"), stream("<p>c</p>"))) == [("p", "+", [("#", "1", [])])]


def test_deep_blocks_keep_their_labels_and_ends(spark):
    """Beyond a hundred open blocks, end tags close their own blocks and apart blocks stay apart."""
    deep = 150
    page = "<body><div><article><p>one {0}</p>" + "<div>" * deep + "<nav>menu</nav><div class='ad'>buy</div><p>two {0}</p>" + "</div>" * deep + "<p>three {0}</p></article></div><p>out</p></body>"
    assert texts(pages_of(spark, [(i, "http://f.org", page.format(i)) for i in range(3)])) == {i: f"one {i}\ntwo {i}\nthree {i}" for i in range(3)}
    far = "<div>" * 20_000 + "<nav>menu</nav>deep {}" + "</div>" * 20_000 + "<p>after {}</p>"
    assert texts(pages_of(spark, [(i, "http://g.org", far.format(i, i)) for i in range(3)])) == {i: f"deep {i}\nafter {i}" for i in range(3)}


def test_long_class_lists_count_to_their_end(spark):
    many = " ".join(f"utility{'abcdefghij'[i]} spacing" for i in range(10))
    page = f"<div class='{many} content'><p>Text {{}}</p><div class='{many} sidebar'>aside {{}}</div></div><p>out {{}}</p>"
    assert texts(pages_of(spark, [(i, "http://h.org", page.format(i, i, i)) for i in range(3)])) == {i: f"Text {i}" for i in range(3)}


def test_what_every_page_of_the_host_repeats_goes_from_the_container(spark):
    """A fixed notice and a list of links inside article go, though no class names them and pages differ in shape."""
    end = "<p>All rights belong to us.</p><ul><li><a href=x>more {0}</a></li><li><a href=y>most {0}</a></li></ul></article></body>"
    bodies = ["<p>a</p><p>b {0}</p>", "<h2>x {0}</h2><p>c</p><h2>y</h2><p>d</p>", "<p>e {0}</p><blockquote>q</blockquote>", "<p>see</p><ol><li><a href=z>f {0}</a></li></ol>"]
    rows = [(i, f"http://i.org/{i}", ("<body><article><h1>T{0}</h1>" + bodies[i % 4] + end).format(i)) for i in range(12)]
    plain = ["a\nb {}", "x {}\nc\ny\nd", "e {}\nq", "see\nf {}"]
    assert texts(pages_of(spark, rows)) == {i: f"T{i}\n" + plain[i % 4].format(i) for i in range(12)}


BLIND = """<div class='qa'><div class='qb'><a href=x>one {n}</a></div><div class='qb'><a href=y>two</a></div></div><div class='qc'>Fixed notice</div>
<div class='qd'><div class='qe'><div class='qf'>Title {n}</div>{body}<div class='qg'>Buy our things</div></div>
<div class='qh'><div class='qi'>said {n}</div></div></div><div class='qj'>word {n}</div><div class='qk'>All rights</div>"""


def blind_pages():
    body = lambda i: "".join(f"<div class='ql'>Paragraph {j} of page {i}, with enough words.</div>" for j in range(1 + i % 4))
    return {i: BLIND.format(n=i, body=body(i)) for i in range(12)}, {i: "\n".join([f"Title {i}", *(f"Paragraph {j} of page {i}, with enough words." for j in range(1 + i % 4))]) for i in range(12)}


def test_pages_without_telling_names(spark):
    """Only blocks with invented classes: the inferred wrapper alone finds the block and what is the host's own in it."""
    pages, want = blind_pages()
    assert texts(pages_of(spark, [(i, f"http://k.org/{i}", h) for i, h in pages.items()])) == want


def test_the_wrapper_decides(spark):
    """Without slots no text comes out, and slots of another host give another text."""
    pages, want = blind_pages()
    wrapper = []
    for page in pages.values():
        wrapper = H.aligned(wrapper, H.stream(H.parse(page))) if wrapper else H.stream(H.parse(page))
    level, main = H.main_block(wrapper)
    assert level == 0 and main[H.LABEL] == "div.qe"
    assert H.extract(pages[3], wrapper, level, main) == want[3]
    assert H.extract(pages[3], [], 0, None) == ""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert H.extract(r.html, [], 0, None) == ""


def test_a_hinted_block_without_mass_is_not_taken(spark):
    page = "<div class='content'>See {0}</div><div class='zz'><div class='zy'>Long text number {0} that goes on and on.</div><div class='zy'>And another paragraph {0}.</div></div>"
    rows = [(i, "http://l.org", page.format(i)) for i in range(6)]
    assert texts(pages_of(spark, rows)) == {i: f"Long text number {i} that goes on and on.\nAnd another paragraph {i}." for i in range(6)}


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(i, f"http://j.org/{i}", "<body><article><h1>T</h1><p>a</p></article></body>") for i in range(5)]
    assert texts(pages_of(spark, rows)) == dict.fromkeys(range(5), "T\na")


def test_headings_that_every_article_has_stay_above_text(spark):
    """Fixed headings stay where the page's own text is below them, and go where the host's own or nothing is."""
    page = "<body><article><h1>T{0}</h1><h2>Summary</h2><p>about {0}</p><h2>Method</h2><h3>Steps</h3><ol><li>do {0}</li></ol><h2>Terms</h2><p>All rights belong to us.</p><h2>Leave a word</h2></article></body>"
    rows = [(i, "http://m.org", page.format(i)) for i in range(5)]
    assert texts(pages_of(spark, rows)) == {i: f"T{i}\nSummary\nabout {i}\nMethod\nSteps\ndo {i}" for i in range(5)}


def test_compound_classes_mean_their_last_word(spark):
    page = "<body><article><p class='promotion-date'>On day {0}</p><section class='story comments-policy'><p>We say {0}</p></section><div class='ad-slot'>buy {0}</div><div class='box cookie-notice'>ok {0}</div><ul class='related-posts'><li>x {0}</li></ul></article></body>"
    rows = [(i, "http://n.org", page.format(i)) for i in range(5)]
    assert texts(pages_of(spark, rows)) == {i: f"On day {i}\nWe say {i}" for i in range(5)}


def test_a_form_around_the_page_is_its_frame(spark):
    for host, inner in (("o", "<div class='main'><p>Text {0}</p></div>"), ("p", "<nav>menu</nav><div class='zz'><h1>Title {0}</h1><p>Text {0}</p></div>")):
        page = "<body><form id='f'>" + inner + "</form><form><p>Mail {0}</p></form></body>"
        got = texts(pages_of(spark, [(i, f"http://{host}.org", page.format(i)) for i in range(5)]))
        assert got == {i: f"Text {i}" if host == "o" else f"Title {i}\nText {i}" for i in range(5)}
