"""Copies of a page, and lists that articles share, are no templates."""

import pytest

from gridlark.llm.html_text import extract_text


def texts(spark, sources):
    df = spark.createDataFrame([(k, "http://a.example/", s) for k, s in enumerate(sources)], "page_id long, url string, html string")
    return [r["text"] for r in extract_text(df).orderBy("page_id").collect()]


@pytest.mark.parametrize("open_,close", [("<article><div>", "</div></article>"), ("<main><div>", "</div></main>"), ("<div><div>", "</div></div>"), ("<article><div><span>", "</span></div></article>")])
def test_a_third_of_copies_keeps_its_text(spark, open_, close):
    menu = "<div><b>Menu</b></div>"
    bodies = ["<p>same</p><ul><li>x</ul>"] * 10 + [f"<p>own {k}</p>" for k in range(20)]
    expected = ["same\nx"] * 10 + [f"own {k}" for k in range(20)]
    assert texts(spark, [menu + open_ + b + close for b in bodies]) == expected


def test_shared_lists_of_articles_stay(spark):
    for tag in ("article", "main"):
        shared = "<div class=box>Share me</div><div><ul><li>a<li>b</ul><table><tr><td>c</table></div>"
        found = texts(spark, [f"<{tag}>{shared}<p>own {k}</p></{tag}>" for k in range(9)])
        assert found == [f"a\nb\nc\nown {k}" for k in range(9)]
