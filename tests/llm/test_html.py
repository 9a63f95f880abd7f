import html
import re

import pytest

from gridlark.llm import queries as Q
from gridlark.llm.html_text import extract_text, page_text

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("plain &lt; text &amp; <b>bold</b>ed", "plain < text & bolded"),
        ("<article><h1>T</h1><p>a\n b&nbsp;c<p>d<br>e<ul><li>x<li>y</ul></article><p>out", "T\na b c\nd\ne\nx\ny"),
        ("<body class='has-sidebar'><header>H</header><nav>N</nav><main><header><p>lead</p></header><p>m</p></main><footer>F", "m"),
        ("<article><header><h1>T</h1></header><p>m</p><footer>by</footer></article>", "T\nm"),
        ("<article><p>a</p><div class='comments'><p>c</div><div id=ad-1>ad</div><aside>s</aside><form><p>f</form><p>b</article>", "a\nb"),
        ("<div class='sidebar-layout'><nav>n</nav><article>in</article></div><div class=sidebar>s</div>", "in"),
        ("<p>a<script>if (a<b) '</p>'</script>b<style>p{}</style>c<!-- <p>x --> d<![CDATA[ q ]]>", "abc d"),
        ("<p hidden>x</p><p style='display: none'>y</p><p aria-hidden=true>z</p><div role=navigation>n</div><p>k", "k"),
        ('<a title="1 > 0">t</a> <img alt=">">u', "t u"),
        ("a < b <c", "a < b"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<article></article><p>rest", "rest"),
        ("<p>&copy; &#8364; &#x1F642; &unknown;", "© € 🙂 &unknown;"),
        ('<article><h2 id="related-work">R</h2><p id="social-history">s</p><p class="notice-board">n</p><div class="share-price">9</div></article>', "R\ns\nn\n9"),
        ('<article class="post comments-open"><p>a</p></article>', "a"),
        ('<main class="no-ads"><div class="post comment-enabled">b</div></main>', "b"),
        ('<article><p>a</p><article class="comment"><p>c</p></article><div class="commentList"><p>d</div><div id="adSlot_2">x</div></article>', "a"),
        ('<div class="ad-box">x</div><div class="cookie-notice">y</div><section class="related_posts">z</section><p>k', "k"),
        ('<main><p>long main text of the page</p><article><p>teaser</p></article></main>', "long main text of the page\nteaser"),
        ('<main><p>lead</p><article><p>the article itself</p></article></main>', "the article itself"),
        ('<div class="content with-sidebar"><p>t</p></div>', "t"),
        ('<div class="sidebar"><p>only</p></div>', "only"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_pages(source, text):
    assert page_text(source) == text


def frame(spark, pages):
    return spark.createDataFrame([(k, u, h, "clash") for k, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string")


def test_site_templates_go(spark):
    page = "<div><div><b>Buy now</b></div><div>{0} part</div></div><p>text {0}</p>"
    pages = [("http://a.example/x", page.format(k)) for k in range(8)] + [("http://b.example/", page.format(k)) for k in range(3)]
    pages += [(None, "<p>alone"), ("no url", None), ("http://A.example:80/z", page.format(9))]
    rows = extract_text(frame(spark, pages)).orderBy("page_id").collect()
    assert [r["text"] for r in rows[:8]] == [f"{k} part\ntext {k}" for k in range(8)]
    assert rows[8]["text"] == "Buy now\n0 part\ntext 0"
    assert [r["text"] for r in rows[11:]] == ["alone", "", "9 part\ntext 9"]
    assert extract_text(frame(spark, pages).limit(0)).count() == 0


def test_repeated_paragraphs_of_articles_stay(spark):
    pages = [("http://a.example/", f"<article><div class=box>Share me</div><p>common line</p><p>own {k}</p></article>") for k in range(9)]
    rows = extract_text(frame(spark, pages)).orderBy("page_id").collect()
    assert [r["text"] for r in rows] == [f"common line\nown {k}" for k in range(9)]


def test_query_equals_the_articles(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    rows = Q.op8_html_text(spark, DIR).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_templates_decide_where_no_article_does(spark):
    """Menus, bars and notes without telling tags or names, told by their recurrence alone; page by page other texts stay."""
    page = "<div><ul><li>Start<li>Shop<li>Us</ul></div><div><div>{0}<p>text of {0}</p><p>more of {0}</p></div><div><b>Call us today</b></div></div><div>All about it. <i>Imprint</i></div>"
    pages = [(f"http://{'abc'[k % 3]}.example/{k}", page.format(k)) for k in range(30)]
    rows = extract_text(frame(spark, pages)).orderBy("page_id").collect()
    assert [r["text"] for r in rows] == [f"{k}\ntext of {k}\nmore of {k}" for k in range(30)]
    single = extract_text(frame(spark, pages[:1])).collect()
    assert single[0]["text"].startswith("Start\nShop") and single[0]["text"].endswith("Imprint")


def test_repeated_rows_and_long_pages(spark):
    long = "<article>" + "".join(f"<p>{k}</p>" for k in range(20_000)) + "</article>"
    rows = extract_text(frame(spark, [("http://a.example/", long)] * 3)).collect()
    assert [r["text"] for r in rows] == ["\n".join(map(str, range(20_000)))] * 3
