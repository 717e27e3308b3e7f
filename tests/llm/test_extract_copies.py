"""Copies of a page, or of its article, are no template of themselves."""

from sievewright.llm import extract


def test_copies(spark):
    page = "<nav>menu</nav><article><h1>Title</h1><p>One</p><p>Two</p></article><p>seen {}</p>"
    rows = [(i, f"http://copies.a/?q={i}", page.format(0)) for i in range(4)]
    rows += [(10 + i, f"http://boiler.a/{i}", ("<div>" * (i % 2) + page).format(i)) for i in range(4)]
    rows += [(20 + i, None, page.format(0)) for i in range(3)] + [(25, "odd", page.replace("One", "Other").format(0))]
    site = "<article><p>Our site</p><p>Text {}</p></article>"
    rows += [(30 + i, f"http://site.a/{i}", site.format(i)) for i in range(4)] + [(40 + i, f"http://site.a/0?{i}", site.format(0)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in extract.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Title\nOne\nTwo" for i in (0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22)) and got[25] == "Title\nOther\nTwo"
    assert [got[i] for i in (30, 31, 32, 33)] == [f"Text {i}" for i in range(4)] and {got[40 + i] for i in range(5)} == {"Text 0"}
