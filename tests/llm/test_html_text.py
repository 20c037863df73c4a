import html
import re

import pytest

from lanternfish.llm import html_text, queries


def plain(source):
    """The pages of the tables: the article's blocks, by regular expressions."""
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inside)
    found = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
    return "\n\n".join(x for x in found if x)


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.QUERIES["op2_html_text"](spark, sf).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)


LONG = "A sentence with quite some words in it, and a comma; it goes on. " * 6
LINKS = "".join(f'<li><a href="/{i}">entry {i}</a></li>' for i in range(20))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("just &amp; text", "just & text"),
        ("<article><p>a<p>b <b>c<br>d</b> &nbsp; e</article>", "a\n\nb c d e"),
        ("<nav>x</nav><main><h1>T</h1>one<div class='comments'><p>no</p></div><p>two</p></main><footer>f</footer>", "T\n\none\n\ntwo"),
        ("<article><header><h1>T</h1><p>by</p></header><p>x</p><script>'<p>'</script><form>f<p>g</form><!-- <p>n</p> --><aside>s</aside>y</article>", "T\n\nx\n\ny"),
        (f"<body><ul>{LINKS}</ul><div id=content><h2>H</h2><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar>{LONG}</div><div>{LINKS}</div></body>", f"H\n\n{LONG.strip()}\n\n{LONG.strip()}"),
        ("<article><p hidden>n</p><p style='display:none'>n</p>y <a href=x>z</a></article>", "y z"),
        ("<aside>x<article><p>y", "y"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2\n\n3"),
        ("<article>a < b &lt; c</article>", "a < b < c"),
        ('<article><h2 id="search">Search</h2><section data-id="related">kept</section><p title="a hidden gem">gem</p><p data-hidden="1">too</p></article>', "Search\n\nkept\n\ngem\n\ntoo"),
        ("<article><p HIDDEN=''>n</p><p aria-hidden='true'>n</p><div class='x related-posts'>n</div><p style=\"color:red; display : none\">n</p>y</article>", "y"),
        ("<div><" * 3000 + "x", None),
    ],
)
def test_cases(source, want):
    got = "\n\n".join(html_text.main_blocks(source))
    assert want is None or got == want


def test_without_marks(spark):
    """The pages of the tables with their article and main tags taken away: densities alone find the same text."""
    rows = [(r.page_id, re.sub(r"</?(article|main)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", r.html), plain(r.html)) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert all("<article" not in source for _, source, _ in rows)
    same = sum("\n\n".join(html_text.main_blocks(source)) == want for _, source, want in rows)
    assert same == len(rows)


def test_very_long_page():
    body = "".join(f"<p>{LONG}{i}</p>" for i in range(4000))
    found = html_text.main_blocks(f"<body><ul>{LINKS}</ul><div>{body}</div><footer>f</footer></body>")
    assert found == [f"{LONG}{i}" for i in range(4000)]


def test_edges(spark):
    pages = spark.createDataFrame([(1, None, "u", 7), (1, "<p>x</p>", None, 8), (1, "<p>x</p>", None, 8)], "page_id long, html string, url string, text int")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert html_text.extract(pages.limit(0)).count() == 0
