"""Operators 1, 7 and 8."""

import hashlib
import html as html_lib
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import op1_site_template as site
from quarry.llm import op7_bpe as bpe
from quarry.llm import op8_rendezvous as shards
from tests.conftest import SF001

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# -- 1: pages

def text_of(page):
    return site.main_text(site.parse(page), frozenset())[0]


@pytest.mark.parametrize("page, expected", [
    (None, ""), ("", ""), ("plain <b>te</b>xt &amp; more", "plain text & more"), ("cut off <a href='x", "cut off"),
    ("<p>a<p>b<br>c", "a b c"), ("<script>var t='</p>';</script><style>p{}</style><!-- x --><p>in</p>", "in"),
    ("<nav>n</nav><header>h</header><article><header><h1>T</h1></header><p>a&nbsp;&#233; <i>b</i>c</p></article><footer>f</footer>",
     "T aé bc".replace("aé", "a é")),
    ("<main><p>one</p><aside>no</aside><div class='cookie-notice'>no</div><form>no</form><div id=comments><p>no</p></div></main>rest", "one"),
    ("<body class=has-sidebar><div class='page with-sidebar'><article>yes</article><div class=sidebar>no</div></div>", "yes"),
    ("<div role=navigation>no</div><div hidden>no</div><div style='display: none'>no</div><p>yes</p>", "yes"),
    ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>", "a b c d e"),
    ("<article>a</article><section class=related><article>no</article></section>", "a"),
    ("</div></p></b>stray <noscript>no</noscript>end", "stray end"),
])
def test_main_text(page, expected):
    assert text_of(page) == expected


@pytest.mark.parametrize("page, expected", [
    ("<article class='post category-social tag-menu'><p>Body.</p></article>", "Body."),
    ("<article id='notice-of-meeting'><p>Body.</p></article>", "Body."),
    ("<article><h2 id='related-work'>Related work</h2><p>a</p><h2 id='social-impact'>Social impact</h2><p class='notice'>b</p>"
     "<section id='discussion'><p>c</p></section></article>", "Related work a Social impact b c"),
    ("<article><p>a</p><div class='related'><a href=x>other</a></div><div class='comments-area'>c</div></article>", "a"),
    ("<article><p>a</p><div class='related'><article>other</article></div></article>", "a"),
    ("<div class='two-column right-sidebar'><h1>T</h1><p>The whole body of it.</p><div class='sidebar'>s</div></div>",
     "T The whole body of it."),
    ("<div class='menu'><a href=a>one</a> <a href=b>two</a> <a href=c>three</a></div><p>b</p>", "b"),
    ("<p>Story.</p><div id='comments'><p>Longer than the story itself.</p></div>", "Story."),
    ("<div class='comments'><p>All of the text.</p></div>", "All of the text."),
    ("<div class='related'><main>All.</main></div>", "All."),
    ("<div class='related-pages'><main>All.</main></div><p>outside</p>", "All."),
    ("<div class='right-sidebar'><article>Body.</article></div><div>Longer text beside it.</div>", "Body."),
    ("<p>Story.</p><div class='related'><article>Longer than the story itself.</article></div>", "Story."),
    ("<p>b</p><p>long enough to be most of it</p><div class='site-menu'>no</div><div class='story-ad-free'>yes</div>",
     "b long enough to be most of it yes"),
])
def test_names_are_hints(page, expected):
    assert text_of(page) == expected


@pytest.mark.parametrize("page, expected", [
    ("<form id=f><nav>n</nav><main><p>Body.</p><label>Name</label><input value=x><button>Go</button>"
     "<select><option>o</select></main></form>", "Body."),
    ("<form role=main><p>Body.</p></form><footer>a footer that is longer than it</footer>", "Body."),
    ("<div role=form><article>Body.</article></div><footer>a footer that is longer than it</footer>", "Body."),
    ("<div role=dialog><h1>T</h1><p>All of the page's text.</p></div>", "T All of the page's text."),
    ("<form><h1>T</h1><p>All of the page's text.</p><label>Name</label></form>", "T All of the page's text."),
    ("<p>The text of the page.</p><form><label>Name</label><p>Sign up</p></form>", "The text of the page."),
    ("<div role=search><p>Search all of our pages</p></div><p>b</p>", "b"),
])
def test_a_form_around_the_page(page, expected):
    assert text_of(page) == expected


def test_a_named_box_inside_an_article_goes_if_it_recurs(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><p>Story {i}.</p><div class='newsletter'>Get our letter</div>"
             f"<div class='notice'>Only of {i}</div></article>") for i in range(5)]
    got = {r.page_id: r.text for r in site.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}. Only of {i}" for i in range(5)}


def test_pages_table_matches_a_plain_reading(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in site.op1_site_template_text(spark, SF001).collect()}
    rows = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        plain = re.sub(r"<(/?)(\w+)[^>]*>", lambda m: "" if m[2] == "b" else " ", inner)
        plain = " ".join(html_lib.unescape(plain).split())
        assert got[r.page_id] == (plain, len(plain))


def test_recurring_subtrees_go_and_articles_stay(spark):
    menu = "<div><span>Home</span> <span>About us</span></div>"
    copy = "<div><p>The same story, told on many pages.</p></div>"
    rows = [(i, f"http://Host.example/{i}", f"<body>{menu}<div><p>Story number {i}.</p></div>", "t", 1) for i in range(6)]
    rows += [(10 + i, f"http://copies.example/{i}", f"<body><p>{'x' * i}</p>{copy}" if i == 0 else f"<body>{copy}", "t", 1)
             for i in range(5)]
    rows += [(20, None, f"<body>{menu}<p>No host.</p>", "t", 1), (21, "http://one.example/", f"<body>{menu}<p>One page.</p>", "t", 1),
             (22, "http://one.example/", None, "t", 1), (23, "http://one.example/", "", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r for r in site.extract(pages).collect()}
    assert [got[i].text for i in range(6)] == [f"Story number {i}." for i in range(6)]
    assert all(got[i].n_recurring == 1 for i in range(6)) and got[0].host == 1
    assert all(got[10 + i].text == "The same story, told on many pages." for i in range(5))   # copies of one page
    assert got[20].text == "Home About us No host." and got[21].text == "Home About us One page."
    assert (got[22].text, got[22].n_chars, got[23].text) == ("", 0, "")
    assert site.extract(pages.limit(0)).count() == 0


def test_copies_do_not_hide_a_menu(spark):
    page = "<body><div><span>Home</span> <span>About us</span></div><p>Story {}.</p>"
    rows = [(i, "http://a.example/", page.format(min(i, 4))) for i in range(600)] + [(1000, "http://a.example/", None)]
    rows += [(2000 + i, f"http://a.example/{i}", "") for i in range(600)]
    got = {r.page_id: r.text for r in site.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "" if i >= 1000 else f"Story {min(i, 4)}." for i in got} and len(got) == 1201


def test_deep_and_long_pages():
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text_of("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)


# -- 7: BPE

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


TRICKY = ["", " ", "a", "  two  spaces\n\n\ttab ", "don't we'll I'VE", "café École naïve", "你好 \U0001f600\U0001f468‍\U0001f469",
          "x<|endoftext|> y<|endoftext|><|endoftext|>", "a b c\u0085d\x1ce", "12345 6.78 ١٢", "!!!???...", "a" * 3000,
          "ab" * 20000, "\x00\x01\x7f", "é ̀", "﻿bom �"]


def test_codec_equals_the_library(library):
    c = bpe.codec(VOCABULARY)
    for t in TRICKY:
        expected = library.encode(t, add_special_tokens=False).ids
        assert c.encode(t).tolist() == expected
        assert c.decode(expected) == library.decode(expected, skip_special_tokens=False)
    assert c.decode([0xff, 1]) == library.decode([0xff, 1], skip_special_tokens=False)     # malformed UTF-8


def test_codec_query_and_edges(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TRICKY)] + [(None, None, None), (1, "same", "y"), (1, "same", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((tuple(r) for r in bpe.digests(df, VOCABULARY).collect()), key=str)
    expected = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    assert bpe.digests(df.limit(0), VOCABULARY).count() == 0
    back = bpe.decode(bpe.encode(df.select("text"), VOCABULARY), VOCABULARY).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    c = bpe.Codec(VOCABULARY)
    text = " ".join(f"w{i % 37}x" for i in range(500))
    assert c.decode(c.encode(text)) == text and len(c.ids_of.__self__) <= 5


# -- 8: shards

def test_sharding(spark):
    rows = [(i, f"text {i % 40}" if i % 7 else None, "k", 1) for i in range(3000)] + [(None, "n", "k", 1)] * 5 + [(4, "", "k", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, bucket int")
    got = shards.shard_documents(df, 40).toPandas()
    assert len(got) == len(rows)
    for r, n in got.groupby("shard").slot:
        assert sorted(n) == list(range(len(n)))
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    assert all((r.size_, r.text_crc32) in texts[None if r.doc_id != r.doc_id else int(r.doc_id)]
               for r in got.rename(columns={"size": "size_"}).itertuples())
    assert set(got.law) == {"key"} and got.shard.between(0, 39).all()
    moved = got[got.shard != got.grown_shard]
    assert (moved.grown_shard == 40).all() and 30 < len(moved) < 130
    assert got[got.doc_id == 4].shard.nunique() == 1 and got[got.doc_id.isna()].shard.nunique() == 1
    fewer = shards.shard_documents(df, 39).toPandas().dropna().drop_duplicates("doc_id").set_index("doc_id")
    first = got.dropna().drop_duplicates("doc_id").set_index("doc_id")
    stays = first[first.shard < 39].index
    assert (fewer.shard[stays] == first.shard[stays]).all() and (fewer.grown_shard.sort_index() == first.shard.sort_index()).all()
    assert shards.shard_documents(df.limit(0), 40).count() == 0


def test_weights(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    sizes = {r.shard: r["count"] for r in shards.assign(df, "doc_id", [1.0, 3.0, 0.0, 2.0]).groupBy("shard").count().collect()}
    assert set(sizes) == {0, 1, 3}
    assert abs(sizes[1] / 20000 - 0.5) < 0.02 and abs(sizes[0] / 20000 - 1 / 6) < 0.02
    with pytest.raises(ValueError):
        shards.pick(F.col("doc_id"), [0.0])
