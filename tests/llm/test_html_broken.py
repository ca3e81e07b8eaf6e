import time

from finquarry.llm.html_extract import extract_text, fit_extractor, leaf_blocks


def texts(html):
    return [b.text for b in leaf_blocks(html)]


def test_unclosed_elements_keep_the_text():
    for tag in ("object", "select", "svg", "iframe", "noscript", "template", "textarea"):
        assert texts(f"<article><p>one</p><{tag} data=x><p>two</p></article><p>tail</p>") == ["one", "two", "tail"], tag
        assert texts(f"<p>one</p><{tag}>x<{tag}>y</{tag}>z</{tag}><p>two</p>") == ["one", "two"], tag
        assert texts(f"<p>one</p><{tag}>x<{tag}>y</{tag}>z<p>two</p>") == ["one", "z", "two"], tag
    assert texts("<p>a</p><script>b</p><p>c") == ["a"] and texts("<p>a<script>if (a</b) c</SCRIPT x>d") == ["ad"]


def test_broken_quotes_comments_and_signs():
    assert texts("<p title=it's>one</p><p>two's</p>") == ["one", "two's"]
    assert texts("<p title=\"a>b\">one<p class='x>two</p><p>three") == ["one", "two", "three"]
    assert texts("a < b and c <3 <p>d <a href='x") == ["a < b and c <3", "d <a href='x"]
    assert texts("<p>a<!-- b --><!doctype x>c<!-- never ends <p>d") == ["ac"] and texts("<!x") == ["<!x"]


def test_deep_pages_close_only_what_they_opened():
    deep = "<article><p>first</p>" + "<div>" * 900 + "<article>deep</article>" + "</div>" * 900 + "<p>last</p></article><p>out</p>"
    got = leaf_blocks(deep)
    assert [b.text for b in got] == ["first", "deep", "last", "out"] and "article" in got[2].tags and "article" not in got[3].tags


def test_linear_time():
    for piece in ("<a title='x ", "<a title=\"x ", "<a ", "<!--", "<svg>", "<svg></svg", "<script>", "<object data='", "</p", "<", "=' ", "<p a=", "<div>", "<p><b>"):
        start = time.time()
        leaf_blocks(piece * 60_000)
        assert time.time() - start < 8, piece


def test_clashing_columns_and_odd_rows(spark):
    rows = [(1, "u", "<article><p>" + "word " * 60 + "</p></article>", 5, "t"), (None, None, None, None, None), (2, "u", "<p>é" * 3, 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")
    got = {r.page_id: r for r in extract_text(df, fit_extractor(df)).collect()}
    assert got[None].text == "" and got[1].n_chars == len(got[1].text) > 200 and got[1].asDict().keys() == {"page_id", "url", "text", "n_chars"}
