"""Operator 1: boxes that recur in many different articles of a host go, what
belongs to an article stays."""

from quarry.llm import op1_site_template as pages

LETTER = "<div><p>Sign up for our daily letter and never miss a story again.</p></div>"
SHARED = "<p>All quotations in this piece were checked against the printed edition of the year.</p>"
WORDS = "river stone market letter garden winter signal paper bridge morning copper window".split()


def article(k, extra="", n=40):
    body = " ".join(f"{WORDS[(k * 7 + i * (k + 3)) % 12]}{k}x{i}" for i in range(n))
    return f"<html><body><article><h1>Story {k}</h1><p>{body}</p>{extra}<p>end {k} {body[::-1]}</p></article></body></html>"


def texts(spark, rows, **more):
    df = spark.createDataFrame([(i, f"http://h{h}.org/{i}", x) for i, (h, x) in enumerate(rows)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in pages.extract(df, **more).collect()}


def test_recurrence_decides_inside_articles(spark):
    rows = [(1, article(k, LETTER)) for k in range(20)]
    on = texts(spark, rows)
    off = texts(spark, rows, min_pages=10 ** 6)                # recurrence switched off
    assert all("daily letter" in t for t in off.values())
    assert not any("daily letter" in t for t in on.values())
    assert all(f"Story {k}" in t and f"end {k}" in t for k, t in on.items())


def test_copies_of_one_story_keep_their_boxes(spark):
    rows = [(1, article(3, LETTER)) for _ in range(30)] + [(1, article(k)) for k in range(10, 30)]
    got = texts(spark, rows)
    assert all("daily letter" in got[i] for i in range(30))


def test_shared_passages_and_large_parts_stay(spark):
    rows = [(1, article(k, SHARED)) for k in range(20)]
    large = "<div><p>" + " ".join(f"syndicated body word{i}" for i in range(80)) + "</p></div>"
    rows += [(2, article(k, large)) for k in range(20)]
    rows += [(3, article(k, f"<blockquote>{'the same words quoted by all of them ' * 2}</blockquote>")) for k in range(20)]
    got = texts(spark, rows)
    assert all("printed edition" in got[i] for i in range(20))
    assert all("syndicated body" in got[20 + i] for i in range(20))
    assert all("quoted by all" in got[40 + i] for i in range(20))


def test_few_pages_prove_no_box(spark):
    got = texts(spark, [(1, article(k, LETTER)) for k in range(4)])
    assert all("daily letter" in t for t in got.values())


def test_boxes_whose_words_differ_go_by_their_name(spark):
    rows = []
    for k in range(12):
        rows.append((1, article(k, f"<div class='box-ad'>Buy {k} now cheap {k * 7}</div><section class='reader-comments'>I think {k} is odd {k}</section>"
                                   f"<div id='comments-wrapper'>me {k} too</div><section id='discussion'><p>We discuss result {k}.</p></section>")))
    for k, t in texts(spark, rows).items():
        assert "cheap" not in t and "is odd" not in t and f"me {k} too" not in t
        assert f"We discuss result {k}." in t
