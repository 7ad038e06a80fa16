import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, uid long, row string, kept boolean"
PAGES = "page_id long, url string, html string, host string, low string, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with the operators' own names."""
    long = "word another third " * 3000
    rows = [
        (1, "one two three four", "en", "a"), (1, "one two three four", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "  \n\t ", "de", "b"), (None, "no id here", "en", "b"),
        (None, None, None, None), (5, long, "en", "a"), (6, "ONE two\x0bthree four", "en", None), (7, "é ü ñ 漢字 😀 word", "fr", ""), (8, "x", "en", "a"), (9, "one two three four five", "en", "c"),
    ]
    return spark.createDataFrame([(*r, None, 0.5, 7, "r", True) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_pages(spark):
    rows = [
        (1, "http://A.Example.net/en/x?q#f", "<p>One</p>"), (2, "http://a.example.net/en/x", "<p>One</p>"), (3, None, None), (4, "no scheme", ""), (5, "http://example.com", "<nav>x</nav><p>A &amp; B<br>c"),
        (6, "http://example.com/de/y", "<p>One</p>"), (6, "http://example.com/de/y", "<p>One</p>"), (None, "http://x.org/fr/", "<p>One</p>"), (7, "http://net/", "<div class='ad'>buy</div><article><h1>T</h1><p>a<p>b</article>tail"),
        (8, "http://evilnet/a", "text " * 50_000), (9, "http://x.net", "<script>if(a<b){'</p>'}</script><p>ok</p>"), (10, "://\n/p", "<p"),
    ]
    return spark.createDataFrame([(*r, "h", "l", "k") for r in rows], PAGES)


@pytest.fixture(scope="session")
def no_pages(spark):
    return spark.createDataFrame([], PAGES)
