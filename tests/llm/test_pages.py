"""WARC archives and HTML extraction."""

import base64
import hashlib
import io
import re
import time
from html.parser import HTMLParser
import uuid

import pytest

from spanguard.llm import html, warc
from spanguard.llm.common import shared_dir


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/\r\nx%20 ", "<p>one</p>", 1), (2, "http://b/", "<p>one</p>", 2), (3, None, None, 3), (4, "u", "", 4), (None, "u", "<p>one</p>", 5), (None, "u", "unique é", 6), (5, "u", "x" * 3_000_000, 7), (1, "http://a/", "<p>one</p>", 8), (6, "u", "other", 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def through(spark, rows, **kw):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return warc.read_archives(warc.write_archives(rows, folder, **kw), folder)


@pytest.mark.parametrize("size", [1, 1 << 20, 64 << 20])
def test_round_trip(spark, pages, size):
    got = through(spark, warc.to_records(pages), archive_bytes=size).collect()
    assert len(got) == 9 and all(r.error is None for r in got)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_bytes) for r in got if r.payload_digest == digest("<p>one</p>"))
    assert kinds == [(-1, "revisit", 1, 10), (1, "response", -1, 10), (1, "response", -1, 10), (2, "revisit", 1, 10)]
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 0) == [(3, "response", None), (4, "revisit", 3)]
    assert sorted(str(r.url) for r in got) == sorted(str(r.url) for r in pages.collect())
    for r in got:
        if r.record_type == "response":
            assert digest(bytes(r.payload).decode()) == r.payload_digest and len(r.payload) == r.payload_bytes


def test_least_bytes_and_empty_tables(spark, pages):
    assert {r.record_type for r in through(spark, warc.to_records(pages, least_bytes=1000)).collect()} == {"response"}
    assert through(spark, warc.to_records(pages.where("1 = 0"))).count() == 0


def test_archives_are_read_by_as_many_tasks(spark, pages):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write_archives(warc.to_records(pages).repartition(5, "page_id", "url"), folder, archive_bytes=1)
    assert warc.read_archives(manifest, folder).rdd.getNumPartitions() == manifest.count() > 4


def archive(records):
    out = io.BytesIO()
    out.close = lambda: None
    w = warc.ArchiveWriter(out)
    for r in records:
        w.add(r)
    w.close()
    return out.getvalue()


def record(i, text):
    return warc.record_bytes(i, "u", "response", text, len(text), base64.b32encode(hashlib.sha1(text).digest()).decode(), None)


def test_frames_and_dictionary():
    records = [record(i, b"<html><body>page number %d of the same kind</body></html>" % i * 20) for i in range(200)]
    data = archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert list(warc.read_frames(io.BytesIO(data), chunk=7)) == records
    assert list(warc.read_frames(io.BytesIO(b""))) == []


def test_damage_is_found():
    data = archive([record(i, b"some payload that is long enough %d" % i) for i in range(5)])
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(io.BytesIO(data[:-3])))
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(io.BytesIO(data + b"junkjunk")))
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(io.BytesIO(data + data)))  # a dictionary in the middle
    good = record(1, b"payload")
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good + b"x", good.replace(b"payload", b"pay1oad"), good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Date", b"WARC-Dart"), re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: 9x\r\n\r\nHTTP", good), b""):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_unstrict_reading_reports(spark, tmp_path):
    (tmp_path / "bad.warc.zst").write_bytes(archive([record(1, b"abc")])[:-2])
    manifest = spark.createDataFrame([(str(tmp_path / "bad.warc.zst"), 1)], "path string, records long")
    got = warc.read_archives(manifest, str(tmp_path), strict=False).collect()
    assert len(got) == 1 and got[0].error


# ---------------------------------------------------------------- html
TREE = html.trained_tree()
CASES = [
    ("<article><h1>T</h1><p>x<b>y</b>z<p>w &amp; v&nbsp;u<script>if(a<b)</script></article><footer>f</footer>", "T xyz w & v u"),
    ("<nav><a href='/'>home</a></nav><main><p>yes  \n yes</p><section id=\"comments\"><p>no</p></section></main>", "yes yes"),
    ('<article><p class="notice">n</p><p>ok</p><div class="ad">buy</div><aside>s</aside><form><p>f</p></form><p>a &lt; b</p></article>', "ok a < b"),
    ("<header>site</header><article><p>in<!-- c --> text<br>next</p></article><div class='sidebar'>x</div>", "in text next"),
    ("<article><p>cut &am", "cut &am"),
    ("", ""),
    (None, ""),
    ("<!-- only", ""),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_main_text(page, text):
    assert html.main_text(page, TREE) == text


def test_pages_without_a_main_element():
    long = "this is a paragraph of the story that goes on for a good while and has many words in it " * 2
    page = f"<div><a href=1>one</a> <a href=2>two</a></div><div><p>{long}</p><p>Short one.</p><p>{long}</p></div><div><a href=3>three</a></div>"
    assert html.main_text(page, TREE) == " ".join(f"{long} Short one. {long}".split())


LONG = "Rivers carry silt from the hills down to the plain, where farmers have used it for many hundreds of years."
HELD_OUT = [  # pages that the tree has not seen
    (f"<div class='layout no-sidebar'><article><h1>Silt</h1><p>{LONG}</p></article></div><footer>About us</footer>", f"Silt {LONG}"),
    (f"<article class='search result'><h2>One</h2><p>{LONG}</p></article>", f"One {LONG}"),
    (f"<form id='aspnetForm'><nav><a>Home</a></nav><main><p>{LONG}</p><p>End.</p></main></form>", f"{LONG} End."),
    (f"<article><p>One <svg class='i'/> two</p><p>{LONG}</p><svg><title>x</title></svg><p>three</p></article>", f"One two {LONG} three"),
    (f"<article><p>Before</p><canvas/><p>{LONG}</p><iframe src=x></iframe><p>after</p></article>", f"Before {LONG} after"),
    (f"<article><p>Press <button>here</p><p>{LONG}</p><p>then <button>no</button> stop</p></article>", f"Press {LONG} then stop"),
    ("<article><p>Let <math><mi>x</mi>=<mn>2</mn></math> be given.</p></article>", "Let x=2 be given."),
    (f"<article><p>{LONG}</p></article><article class='user-post'><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p><article><p>First!</p></article><p>Last line.</p></article>", f"{LONG} Last line."),
    (f"<div id=nav><a>a</a></div><div><h1>Rivers</h1><p>{LONG}</p><p>{LONG} {LONG}</p></div><div class=footer>Imprint and contact</div>", f"Rivers {LONG} {LONG} {LONG}"),
    (f"<article><h1>Silt</h1><p>{LONG}</p><div class='share-price'><p>The price of a share fell.</p></div><p>{LONG}</p></article>", f"Silt {LONG} The price of a share fell. {LONG}"),
    (f"<article><h1>Silt</h1><article class='part'><p>{LONG}</p><p>More.</p><p>{LONG}</p></article></article>", f"Silt {LONG} More. {LONG}"),
    (f"<div id='content-related'><h1>Silt</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", f"Silt {LONG} {LONG} {LONG}"),
    (f"<div class='ad-slot-2'>Buy now</div><main><p>{LONG}</p><div class='footer_links'>Imprint</div><p>End.</p></main>", f"{LONG} End."),
    (f"<td><a>x</a></td><td><a>y</a></td><p>{LONG} {LONG}</p><ul><li><a>More</a></li><li><a>Even more here</a></li></ul>", f"{LONG} {LONG}"),
]


@pytest.mark.parametrize(("page", "text"), HELD_OUT)
def test_held_out_pages(page, text):
    assert html.main_text(page, TREE) == text


class Plain(HTMLParser):
    """Text of the article by a tree of elements, with nothing of the operator's code."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.beside, self.out = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("script", "style", "form", "aside", "nav", "footer"):
            self.beside += 1
        if tag in ("p", "h1", "br", "li", "ul", "div", "td"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("script", "style", "form", "aside", "nav", "footer"):
            self.beside -= 1
        if tag in ("p", "h1", "br", "li", "ul", "div", "td"):
            self.out.append(" ")

    def handle_data(self, data):
        if self.inside > 0 and not self.beside:
            self.out.append(data)


def test_generated_pages_equal_a_plain_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(rows, ["page_id"]).collect()}
    for r in rows.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        assert got[r.page_id] == " ".join("".join(plain.out).split())


def test_labelled_rows_are_learnt():
    x, y = html.labelled_table()
    assert len(y) < 300 and (html.classify(TREE, x) == (y > 0)).mean() > 0.99
    asked = set()

    def walk(t):
        if len(t) > 1:
            asked.add(html.FEATURES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(TREE)
    assert {"words", "link_share"} <= asked and len(asked & {"words_before", "words_after", "link_share_before", "link_share_after"}) >= 3


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</p></section>" * 20_000, "<svg>" * 60_000, "<button>a" * 40_000, "<span class=ad>" * 30_000 + "</b>" * 60_000, "<a '>" * 60_000, "x < y " * 100_000, "<p class='a b'>word " * 30_000, "<" + "a" * 1_000_000, "<head>" * 100_000, '<a "> "' * 60_000, "<article><div class='ad'>" * 30_000])
def test_pages_take_linear_time(page):
    began = time.process_time()
    html.main_text(page, TREE)
    assert time.process_time() - began < 3


def test_odd_pages(pages):
    got = html.extract(pages, ["page_id", "payload"])
    assert got.count() == 9 and html.extract(pages.where("1 = 0"), ["page_id"]).count() == 0
