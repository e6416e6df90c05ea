"""Features of whole blocks; labels and weights of the classifier; the cut decides."""

import re

import numpy as np
import pytest

from plumbline.llm import html_extraction as x

STORY = "Some sentence of the story goes on, and on."


def page(body="", article="", tail=""):
    p = lambda n: " ".join([STORY] * n)
    return f"<html><head><title>Head line of it | Site</title></head><body {body}><nav><ul><li><a href=/>Home</a></li></ul></nav><article {article}><h1>Head line of it</h1><p>{p(2)}</p><p>Short.</p><p>{p(3)}</p>{tail}</article><footer>c 2020 me.</footer></body></html>"


TEXT = "\n".join(["Head line of it", " ".join([STORY] * 2), "Short.", " ".join([STORY] * 3)])


def beta_of(pages):
    rows = []
    for p in pages:
        of = x.read(p)
        if (y := x.told(p, of)) is not None:
            rows.append(np.hstack([x.features(of), y[:, None]]))
    return x.learn(np.concatenate(rows))


def test_digits_late_in_a_block_count():
    of = x.read(f"<p>{'w' * 500}{'7' * 500}</p>")
    assert x.features(of)[0][5] == 0.5


@pytest.mark.parametrize("body, article", [('class="home has-sidebar"', ""), ('class="nav-open"', ""), ("", 'class="legal"')])
def test_no_class_empties_a_page(body, article):
    assert x.extract(page(body, article)) == TEXT


def test_unnamed_comments_and_controls_go():
    assert x.extract(page(tail=f"<div><h3>3 comments</h3><p>{STORY}</p></div><button>Send now</button>")) == TEXT


@pytest.mark.parametrize("tail", ['<div class="commentList"><p>{}</p></div>', '<div id="pageFooter"><p>{}</p></div>', '<div role="alert"><p>{}</p></div>', '<div style="display: none"><p>{}</p></div>', '<ins class="adsbygoogle"></ins><div class="adsbygoogle">{}</div>', '<div class="disqus_thread"><article class="comment"><p>{}</p></article></div>', '<aside><p>{}</p></aside>', '<form><p>{}</p></form>'])
def test_what_is_not_the_story_goes(tail):
    assert x.extract(page(tail=tail.format(STORY))) == TEXT
    assert x.extract(page(tail=tail.format(" ".join([STORY] * 12)))) == TEXT


def test_title_tells_the_story():
    p = page()
    of = x.read(p)
    assert [b.text for b, y in zip(of.blocks, x.told(p, of), strict=True) if y] == TEXT.split("\n")
    assert x.told(p.replace("Head line of it |", "Other |"), of) is None
    flat = re.sub("</?article *>", "", p)
    assert x.told(flat, x.read(flat)) is None


def test_classifier_and_edges_decide(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    beta = beta_of(pages)
    out = [x.extract(p, beta) for p in pages]
    assert sum(a != x.extract(p, -beta) for a, p in zip(out, pages, strict=True)) > len(pages) * 0.9
    # without the names of containers shape and edges still find the story
    blind = [re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", p).replace(' class="ad"', "") for p in pages]
    assert [x.extract(p, beta) for p in blind] == out
    listed = page(tail="<ul><li>first item of some</li><li>second</li></ul>").replace("<article >", "<div class=post>").replace("</article>", "</div>")
    assert x.extract(listed).endswith("first item of some\nsecond") and not x.extract(listed, smoothness=0.0).endswith("second")


def test_the_sample_is_bounded(spark):
    p = page(tail="<p>Some text of a story, and on.</p>" * 1500)
    seen = []
    learn = x.learn
    try:
        x.learn = lambda rows: seen.append(len(rows)) or learn(rows)
        x.train(spark.createDataFrame([(i, "u", p) for i in range(5)], "page_id long, url string, html string"), each=40)
    finally:
        x.learn = learn
    assert seen == [200]
