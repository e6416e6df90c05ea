import html
import random
import re

from plumbline.llm import html_extraction as x


def brute_cut(gain, links):
    n = len(gain)
    cost = lambda s: sum(max(v, 0) if not s[i] else max(-v, 0) for i, v in enumerate(gain)) + sum(c for i, j, c in links if s[i] != s[j])
    return min(cost([b >> i & 1 for i in range(n)]) for b in range(1 << n)), cost


def test_minimum_cut_against_all_labellings():
    rnd = random.Random(5)
    for _ in range(500):
        n = rnd.randint(1, 8)
        gain = [rnd.randint(-9, 9) for _ in range(n)]
        links = [(*sorted(rnd.sample(range(n), 2)), rnd.randint(0, 6)) for _ in range(rnd.randint(0, 12))] if n > 1 else []
        best, cost = brute_cut(gain, links)
        assert cost(x.source_side(gain, links)) == best


def test_pages_of_the_corpus(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in x.extract_pages(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|<br>|</?h1>", body)]
        assert got[p["page_id"]]["text"] == "\n".join(b for b in want if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_other_layouts():
    p = lambda n: " ".join(["Some sentence of the story goes on, and on."] * n)
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><header><a href=/>Home</a> <a href=/x>News</a></header>
    <div class="cookie-notice">We use cookies. <button>OK</button></div><div id="sidebar"><p>{p(2)}</p></div>
    <div class="post-content"><h2>Head &amp; line</h2><p>{p(3)}</p><div class="ad">Buy now!</div><p>Short.</p><ul><li>first &lt;item&gt;</li><li>second</li></ul><p>{p(4)}</p></div>
    <form><label>Mail</label><input></form><div id="comments"><p>{p(3)}</p></div><script>var a = "<p>x</p>";</script><footer><p>&copy; me</p></footer></body></html>"""
    assert x.extract(page) == "\n".join(["Head & line", p(3), "Short.", "first <item>", "second", p(4)])


def test_edges(spark):
    rows = [(1, "u", None), (1, "u", ""), (2, None, "<p"), (3, "u", "plain text only, without any tag at all."), (None, "u", "<article><p>a<p>b</article>" * 400), (4, "u", "</div></p><b>"), (5, "u", "<article>a &nbsp; b<br>c &#xD800; d</article>")]
    got = x.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == text[4] == "" and text[5] == "a b\nc � d" and text[None].count("\n") == 799
    assert x.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
