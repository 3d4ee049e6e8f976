import html
import itertools
import os
import re
import time

import pytest

from ledgerline.llm import html_crf as hc


@pytest.fixture(scope="module")
def field():
    return hc.trained()


def text_of(page, field):
    return hc.main_text(page, field, hc.Names(field.names))


def test_best_tags_equal_all_tags_tried(field):
    names = hc.Names(field.names)
    for page in hc.invented_pages(40, 5):
        page = page.replace(hc.MARK, "")
        got = field.decode(hc.blocks_of(page, names)[:9])
        blocks = hc.blocks_of(page, names)[:9]  # anew: decoding counts the containers' text in their elements
        scores = field.scores(blocks, hc.outside_names(blocks, names.known))

        def total(tags):
            steps = sum(field.steps[int(blocks[i].element.parent is blocks[i - 1].element.parent)][tags[i - 1]][tags[i]] for i in range(1, len(tags)))
            return field.ends[0][tags[0]] + field.ends[1][tags[-1]] + steps + sum(s for s, t in zip(scores, tags) if t)

        assert total(got) >= max(map(total, itertools.product((0, 1), repeat=len(blocks)))) - 1e-9


def test_held_out_pages(field):
    names, wrong, blocks_seen = hc.Names(field.names), 0, 0
    for page in hc.invented_pages(250, 77):
        blocks, tags = hc.labelled(page, names)
        blocks_seen += len(blocks)
        wrong += sum(a != b for a, b in zip(field.decode(blocks), tags))
    assert blocks_seen > 5000 and wrong < 0.01 * blocks_seen


MAIN = ["The title of it", "A first paragraph with several words and a link in it, and an end.", "Short.", "one item", "another item", "Last & final words."]
BODY = f"<h1>{MAIN[0]}</h1><p>A first paragraph with several words and <a href=x>a link</a>\n in it,   and<br>an end.</p><p>{MAIN[2]}<ul><li>{MAIN[3]}<li>{MAIN[4]}</ul><p>Last &amp; final words.</p>"
PAGES = [
    f"<html><body><header><a href=/>My site</a></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><article>{BODY}</article><aside><h3>Related</h3><ul><li><a href=c>Other story</a></ul></aside><footer>&copy; 2020 My site. All rights reserved.</footer>",
    f"<body><div id=header><div class=logo>My site</div></div><div class='menu'><a href=a>Home</a> | <a href=b>News</a></div><div class='main-content'><div class='post'>{BODY}</div></div><div class='sidebar'><h3>Popular</h3><p>Some teaser text of another story, with words.</p></div><div id='footer'><p>Copyright 2020</p></div></body>",
    f"<body><div class='cookie-banner'><p>We use cookies to make this site better for you.</p><button>Accept all</button></div><main><article class='post'>{BODY}</article><section id='comments'><h2>2 comments</h2><article class='comment'><p>I think that this is a very good text, thanks for it.</p></article><form><label>Your comment</label><textarea>Write here</textarea><button>Send</button></form></section></main></body>",
    f"<body><div role=alert class=notice>Please enable scripts.</div><article>{BODY.replace('<ul>', '<div class=ad>Buy these shoes now, they are cheap.</div><ul>')}<div class='share'><a href=1>Share</a> <a href=2>Tweet</a></div></article><form class='newsletter'><p>Sign up for our newsletter</p><input name=mail><button>Subscribe</button></form><script>document.write('<p>no</p>')</script><style>p {{ }}</style><!-- <p>no</p> --></body>",
    f"<body class='has-sidebar'><div class='breadcrumbs'><a href=/>Home</a> &rsaquo; <a href=/n>News</a></div><main>{BODY}</main><div class='comment-list'><div class='comment'><b>Ann</b> <p>A long remark of a reader that goes on for a while, with many words.</p></div></div></body>",
]


@pytest.mark.parametrize("page", PAGES)
def test_pages_written_by_hand(field, page):
    assert text_of(page, field).split("\n") == MAIN


def test_broken_markup_and_references(field):
    names = hc.Names(field.names)
    texts = lambda page: [b.text for b in hc.blocks_of(page, names)]
    assert texts("<p>a < b &lt;i&gt; &amp &#65;&#x42; &nbsp; c<p>d") == ["a < b <i> & AB c", "d"]
    assert texts("a<div title='x>y'>b</div>c<div") == ["a", "b", "c"]
    assert texts("<p>a</div>b</p>c</p>") == ["a", "b", "c"]
    assert texts("a<!-- x --!>b<!---->c<!>d<?x?>e</ x>f<!-- g") == ["abcdef"]
    assert texts("<script>a</script >b<SCRIPT x>c</SCRIPT>d<title>e</titles></title>f<style>g") == ["b d f"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table><select><option>d<option>e</select>") == ["a", "b", "c", "d", "e"]
    assert texts("") == texts(" \n ") == []


def test_long_pages_take_linear_time(field):
    for page in ("<div>" * 200_000 + "a", "<p class=a>b" * 100_000, "<" * 500_000, "<a " * 300_000, "<!--" * 300_000, "<a b=\"" * 200_000, "<script>" * 200_000, "x " * 1_000_000, "</p>" * 200_000, "&amp" * 300_000, "<a b='>" * 200_001):
        began = time.time()
        text_of(page, field)
        assert time.time() - began < 20, page[:20]


SCHEMA = "page_id long, url string, html string, text string, n_chars string, tag int"


def test_articles_of_the_tables_and_awkward_rows(spark, field):
    folder = "/root/testdata/sf0.001"
    if os.path.isdir(folder):
        rows = {r.page_id: r for r in hc.op11_html_crf(spark, folder).collect()}
        for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
            article = re.search("<article>(.*)</article>", r.html, re.S)[1]
            blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1|article)>", article))
            want = "\n".join(filter(None, blocks))
            assert (rows[r.page_id].text, rows[r.page_id].n_chars, rows[r.page_id].url) == (want, len(want), r.url)
    odd = [(1, None, None), (None, "u", ""), (2, "u", PAGES[0]), (2, "u", PAGES[0]), (3, "u", "<nav>x"), (4, "u", "plain \U0001f600 text without any tags, but with an end."), (5, "u", "\0퟿<p>")]
    df = spark.createDataFrame([(*r, "t", "n", 1) for r in odd], SCHEMA)
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in hc.extract(df, field).collect())
    assert [g[0] for g in got] == [0, 1, 2, 2, 3, 4, 5] and got[2] == got[3] == (2, "u", "\n".join(MAIN), len("\n".join(MAIN)))
    assert got[0][2:] == got[1][2:] == ("", 0) and all(g[3] == len(g[2]) for g in got)
    assert hc.extract(df.limit(0), field).count() == 0
