import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracegrid.llm import ann, archive, registry, styletree, urlfilter

# style trees


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header>site</header><nav><ul><li><a href=x>menu</a></ul></nav>
    <div class="cookie-notice">accept</div><!-- <p>no</p> --><article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>
       text<br>goes on<p>Two&nbsp;x<form><input value=1>no</form><ul><li>a<li>b</ul><aside>side</aside><div class="comments"><p>reader</p></div></article><footer>&copy; x</footer></body>"""
    assert styletree.main_text(page) == "Title & more\nOne bold text goes on\nTwo x\na\nb"
    assert styletree.main_text(None) == styletree.main_text("") == styletree.main_text("  ") == ""
    assert styletree.main_text("<p>plain") == "plain" and styletree.main_text("a < b") == "a < b"


def test_headers_of_articles_stay():
    assert styletree.main_text("<div class=header>a</div><main><div class='entry-header'><h1>b</h1></div><header>c</header><div class='ad header'>d</div>e</main>") == "b\nc\ne"


@pytest.mark.parametrize("piece", ["<a", "<!", '<a "', "<a '", "<", "<!--", "<p ", "</", "&", "<script", "<b>", "<div>", "<p>x", "<div>x", "<ul><li>x"])
def test_broken_pages_take_no_long_time(piece):
    import time

    began = time.process_time()
    styletree.style_nodes(piece * 20_000)
    styletree.main_text(piece * 20_000)
    assert time.process_time() - began < 20


def test_low_branches_leave():
    page = "<body><div class=x1><p>same</p></div><div class=x2><p>new</p></div></body>"
    nodes = styletree.style_nodes(page)
    assert "body/div.x1" in nodes and styletree.main_text(page, frozenset(["body/div.x1"])) == "new"


def test_tree_finds_repeated_branches(spark):
    """A branch without a telling name is the same on all pages of a host, or one of few texts; the other differs."""
    page = "<html><body><div><div class=qa>{}</div><div class=qb><p>{}</p></div></div></body></html>"
    rows = [(i, f"http://{'big' if i % 4 else 'small' + str(i)}.example/x", page.format("Always this line", f"Text number {i}")) for i in range(160)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in styletree.extract_text(df).collect()}
    assert got == {i: f"Text number {i}" for i in range(160)}
    hosts = df.selectExpr("'h' AS host", "html")
    seen = {r.node: r.importance for r in styletree.importance(hosts).collect()}
    assert seen["html/body/div/div.qa"] == 0.0 and seen["html/body/div/div.qb"] == pytest.approx(1.0)


def test_copies_and_fixed_headings_stay(spark):
    """A host of copies, one of copies and unique pages (with and without article), and one with the same heading in every article."""
    article = "<html><body><nav>menu</nav><article><h2>{}</h2><p>{}</p></article></body></html>"
    plain = "<html><body><div class=qa>Always this line</div><div class=qb><p>{}</p></div></body></html>"
    rows = [("copies", article.format("Same", "One text"), "Same\nOne text")] * 80
    for i in range(300):
        n = i if i >= 216 else 0
        rows += [("mixed", article.format("Head", f"Text {n}"), f"Head\nText {n}"), ("plain", plain.format(f"Text {n}"), f"Text {n}")]
    rows += [("fixed", article.format("Abstract", f"Number {i}"), f"Abstract\nNumber {i}") for i in range(80)]
    df = spark.createDataFrame([(i, f"http://{h}.example/{i}", p) for i, (h, p, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in styletree.extract_text(df).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(rows)}


@pytest.mark.parametrize("depth", [3, 64, 100, 5000])
def test_names_tell_at_any_depth(depth):
    """Noise and main elements far below the depth at which style paths end."""
    deep = lambda x: f"<body>{'<div>' * depth}{x}{'</div>' * depth}</body>"
    assert styletree.main_text(deep("<nav>menu</nav><p>kept</p><div class=advert>buy</div><form>f</form>")) == "kept"
    assert styletree.main_text(deep("<p>out</p><article><p>kept</p><footer>f</footer></article>") + "<p>out</p>") == "kept"
    assert styletree.main_text(f"<nav>{'<div>' * depth}menu{'</div>' * depth}</nav><p>kept</p>") == "kept"


@pytest.mark.parametrize("depth", [3, 62, 63, 64, 65, 80, 200])
def test_entropy_tells_at_any_depth(spark, depth):
    """The same section on every page and one that differs, without telling names, far down in the page."""
    deep = lambda x: f"<body>{'<div>' * depth}{x}{'</div>' * depth}</body>"
    pages = [deep(f"<section><h2>Same line on every page</h2></section><section class=x><p>Text number {i} of the page</p></section>") for i in range(60)]
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in styletree.extract_text(df).collect()} == {i: f"Text number {i} of the page" for i in range(60)}


def test_nodes_differ_below_a_digest():
    leaves = [leaf for leaf, _ in styletree.blocks_of("<div>" * 100 + "<section>a</section><aside2>b</aside2>" + "<div>" * 70 + "c")]
    assert len(set(leaves)) == 3 and all(len(styletree.branch(leaf)) <= styletree.DEEPEST + 1 and len(leaf) < 500 for leaf in leaves)


def test_names_of_inline_elements():
    page = "<p>One <span class='advert'>Buy <span>now</span> <b>this</b></span>two<a class=share href=x>Share</a> three.</p>"
    assert styletree.main_text(page) == "One two three."
    assert styletree.main_text("<p>a <span class=promo>b</p><p>c</p>") == "a\nc"
    assert styletree.main_text("<div>a <span class=promo><div>b</div></span> c</div>") == "a\nc"
    assert styletree.main_text("<pre>x <span class='comment'># y</span></pre>") == "x # y"
    assert styletree.main_text("<article><p><span class=header>T</span> a</p></article>") == "T a"


def test_names_leave_through_the_tree(spark):
    """What names tell are branches of the tree: without its low branches they stay in the page."""
    page = "<body><nav>menu {0}</nav><article><p>Text {0}</p></article><footer>f {0}</footer></body>"
    df = spark.createDataFrame([(i, f"http://h{i % 3}.example/{i}", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.text for r in styletree.extract_text(df).collect()} == {f"Text {i}" for i in range(12)}
    none = spark.createDataFrame([], "host string, template long, low array<string>")
    assert {r.text for r in styletree.extract_text(df, none).collect()} == {f"menu {i}\nText {i}\nf {i}" for i in range(12)}


def test_importance_goes_up(spark):
    """A branch leaves only if all below it are low: an element with one fixed child stays around its other child."""
    page = "<body><div class=a><p class=x>Fixed</p><p class=y>Text {0}</p></div><div class=b><ul><li>Fixed</li></ul></div></body>"
    df = spark.createDataFrame([("h", page.format(i)) for i in range(64)], "host string, html string")
    seen = {r.node: r.importance for r in styletree.importance(df).collect()}
    assert seen["body/div.a"] == seen["body/div.a/p.y"] == seen["body"] == pytest.approx(1.0)
    assert seen["body/div.a/p.x"] == seen["body/div.b"] == 0.0


def test_style_trees_against_brute_force(spark):
    """Random pages without telling names: entropies, branches and texts by plain loops."""
    import math
    import random

    rng = random.Random(4)
    rows = []
    for i in range(240):
        parts = [f"<div class=k{k}>{rng.choice(['same', f'text {i}', f'few {i % 3}'] if k != 2 else ['same'])}<p>{'fixed' if k % 2 else f'own {i} {k}'}</p></div>" for k in range(5) if rng.random() < 0.8]
        rows.append((i, f"http://h{i % 4}.example/", f"<body>{''.join(parts)}</body>"))
    leaf_digests, all_digests, pages_of = defaultdict(list), defaultdict(list), {}
    for i, url, page in rows:
        host = url.split("/")[2]
        pages_of[i] = (host, styletree.style_nodes(page))
        for node, digest in pages_of[i][1].items():
            leaf_digests[host, node].append(digest)
            all_digests[node].append(digest)

    def entropy(x):
        m = len(x)
        return -sum(x.count(d) / m * math.log(x.count(d) / m) for d in set(x)) / math.log(m) if m > 1 else 1.0

    own = {(h, n): (len(x) * entropy(x) + styletree.LEAN * (entropy(all_digests[n]) if len(all_digests[n]) >= styletree.LEAN else 1.0)) / (len(x) + styletree.LEAN) for (h, n), x in leaf_digests.items()}
    branch = {(h, n): max(v for (g, k), v in own.items() if g == h and (k == n or k.startswith(f"{n}/"))) for h, n in own}
    low = {(h, n) for (h, n), v in branch.items() if v < styletree.LOW and (len(leaf_digests[h, n]) >= styletree.LEAST or len(all_digests[n]) >= styletree.LEAST)}
    told = {i: styletree.main_text(page, frozenset(n for h, n in low if h == pages_of[i][0])) for i, _, page in rows}
    assert {r.page_id: r.text for r in styletree.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == told
    assert low and any("same" not in t for t in told.values())


def extracted(spark, pages):
    """Texts of pages (host, html), in order."""
    df = spark.createDataFrame([(i, f"http://{h}.example/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in styletree.extract_text(df).collect()}
    return [got[i] for i in range(len(pages))]


def test_named_nodes_have_entropies(spark):
    """Nodes are in the tree whatever their names, with the importance that their counts give."""
    page = "<body><nav><ul><li>menu</ul></nav><article><h2>Head</h2><p>Text {0}</p></article><div class=comments><p>Reader {0}</p></div><div class=x>Fixed</div></body>"
    assert {"body/nav/ul/li", "body/nav/ul/li/#", "body/article/p/#", "body/div.comments/p/#", "body/div.x/#"} <= set(styletree.style_nodes(page.format(1)))
    df = spark.createDataFrame([("h", page.format(i)) for i in range(64)], "host string, html string")
    seen = {r.node: r.importance for r in styletree.importance(df).collect()}
    assert seen["body/nav"] == seen["body/article/h2"] == seen["body/div.x"] == 0.0
    assert seen["body/article"] == seen["body/div.comments"] == pytest.approx(1.0)
    assert extracted(spark, [("h", page.format(i)) for i in range(64)]) == [f"Head\nText {i}" for i in range(64)]


def test_tree_overrules_names_of_noise(spark):
    """Names of noise around all text of a host's pages are accidents; those beside other text, and those of comments, are not."""
    shapes = {
        "article": ("<div class=share><nav>menu</nav><article><p>Text {0}</p><div class=comments>Reader {0}</div></article></div><p class=x>Fixed</p><div class=related>See {0}</div>", "Text {0}"),
        "layout": ("<div class='wrap has-sidebar'><header>Site</header><div class=x>Fixed</div><div><p>Longer text {0}</p></div><div class=comments>Reader {0} says a lot more</div></div><div class=promo>Buy {0}</div>", "Longer text {0}"),
        "nested": ("<div class=social><div class=toolbar><p>Text {0}</p></div><nav>menu</nav></div>", "Text {0}"),
        "own": ("<article class='post comments-open'><p>Text {0}</p><footer>f</footer></article>", "Text {0}"),
        "beside": ("<p>Text {0}</p><div class=share>Much longer text than the other one {0}</div>", "Text {0}"),
        "pictures": ("<article><img src=x></article><div class=comments>Reader {0}</div><nav>menu</nav><footer>Foot {0}</footer>", ""),
    }
    pages = [(host, f"<body>{page.format(i)}</body>", text.format(i)) for host, (page, text) in shapes.items() for i in range(60)]
    assert extracted(spark, [p[:2] for p in pages]) == [p[2] for p in pages]


def test_few_pages_lean_on_all_hosts_for_claims(spark):
    page = "<body><div class={1}><p>Text {0}</p></div><nav>menu</nav></body>"
    pages = [(f"h{i % 10}", page.format(i, "share")) for i in range(60)] + [(f"g{i % 10}", page.format(i, "toolbar")) for i in range(20)]
    assert extracted(spark, pages) == [f"Text {i}" for i in range(60)] + [""] * 20


def test_tree_overrules_names_of_main(spark):
    """A main element that is the same on all pages does not rule out what differs; it stays, as does one that differs."""
    pages = [("box", f"<body><article>About</article><div class=a><p>Text {i}</p></div><div class=b>Fixed</div></body>", f"About\nText {i}") for i in range(60)]
    pages += [("real", f"<body><article>Text {i}</article><div class=a><p>Other {i}</p></div></body>", f"Text {i}") for i in range(60)]
    pages += [("near", f"<body><article>One text</article><div class=ad>Buy {i}</div><div class=b>Fixed</div></body>", "One text") for i in range(60)]
    assert extracted(spark, [p[:2] for p in pages]) == [p[2] for p in pages]


def test_claims_against_brute_force(spark):
    """Random pages with names: entropies, claims and texts by plain loops over pages."""
    import math
    import random

    rng = random.Random(7)
    kinds = [("div class=x", "div"), ("article", "article"), ("nav", "nav"), ("div class=share", "div"), ("div class='comments'", "div"), ("section class=has-sidebar", "section"), ("div class=y", "div")]

    def piece(host, i, depth):
        k, n = rng.choice(host), rng.random()
        (start, end), inner = kinds[k], piece(host, i, depth + 1) if depth < 3 and n < 0.6 else ""
        return f"<{start}><p>{'same' if k in (2, 6) or n < 0.3 else f'text {i} {depth}'}</p>{inner}</{end}>"

    of = [[0, 1, 2, 3], [3, 4, 5], [2, 3, 5], [0, 2, 6], [1, 3, 5], [3, 2, 4]]
    rows = [(i % 6, f"<body>{''.join(piece(of[i % 6], i, 0) for _ in range(rng.choice([1, 1, 2])))}</body>") for i in range(600)]
    different = sorted(set(rows))
    digests, everywhere, chars = defaultdict(list), defaultdict(list), Counter()
    for host, page in different:
        for node, digest in styletree.style_nodes(page).items():
            digests[host, node].append(digest)
            everywhere[node].append(digest)
        for leaf, text in styletree.blocks_of(page):
            chars[host, styletree.branch(leaf)[-1]] += len(text)

    def entropy(x):
        return -sum(n / len(x) * math.log(n / len(x)) for n in Counter(x).values()) / math.log(len(x)) if len(x) > 1 else 1.0

    every = {n: entropy(x) if len(x) >= styletree.LEAN else 1.0 for n, x in everywhere.items()}
    own = {(h, n): (len(x) * entropy(x) + styletree.LEAN * every[n]) / (len(x) + styletree.LEAN) for (h, n), x in digests.items()}
    low = {(h, n) for h, n in own if max(v for (g, k), v in own.items() if g == h and (k == n or k.startswith(f"{n}/"))) < styletree.LOW and min(styletree.LEAST, len(everywhere[n])) == styletree.LEAST}
    shown, needed, mains = Counter(), Counter(), {}
    for host, page in different:
        gone = {n for h, n in low if h == host}
        noise, needs, mains[host, page] = styletree.needed_claims(sorted({x for x, _ in styletree.blocks_of(page)}), gone, {n: c for (h, n), c in chars.items() if h == host})
        shown.update((host, x) for x in noise)
        needed.update((host, x) for x in needs)

    def fails(host, claim):
        m, k = (sum(n for (_, x), n in c.items() if x == claim) for c in (shown, needed))
        return (needed[host, claim] + styletree.LEAN * (k / m if m >= styletree.LEAN else 0)) / (shown[host, claim] + styletree.LEAN) >= styletree.FAILS

    failed = {x for x in shown if fails(*x)}
    told = [styletree.main_text(page, frozenset([*(n for h, n in low if h == host), *(x for h, x in shown if h == host and (h, x) not in failed), *mains[host, page]])) for host, page in rows]
    assert extracted(spark, [(f"h{host}", page) for host, page in rows]) == told
    by_names = [styletree.main_text(page) for _, page in rows]
    assert low and failed and len(failed) < len(shown) and sum(a != b for a, b in zip(told, by_names)) > 60


def test_article_of_generated_pages(spark, small):
    rows = registry.op7_style_tree(spark, small).collect()
    for r in rows:
        assert r.n_chars == len(r.text) and "menu" not in r.text and not r.text.startswith("\n")


def test_style_tree_edges(spark, odd_pages, no_pages):
    got = styletree.extract_text(odd_pages).collect()
    text = defaultdict(list)
    for r in got:
        text[r.page_id].append(r.text)
    assert len(got) == 12 and text[3] == [""] and text[5] == ["A & B c"] and text[7] == ["T\na\nb"] and text[9] == ["ok"] and text[6] == ["One", "One"]
    assert len(text[8][0]) == 5 * 50_000 - 1 and styletree.extract_text(no_pages).count() == 0


# archives


def test_archive(spark, odd_pages, no_pages, tmp_path):
    rows = odd_pages.collect()
    got = archive.archived_pages(odd_pages).collect()
    assert len(got) == len(rows)
    first = {}
    for r in sorted(rows, key=lambda r: (r.page_id is None, r.page_id or 0)):
        first.setdefault((r.html or "").encode(), r.page_id)
    for r in got:
        page = next(p for p in rows if p.page_id == r.page_id)
        data = (page.html or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type == "response" and r.refers_to is None) or (r.record_type == "revisit" and r.refers_to == first[data])
    assert sum(r.record_type == "response" for r in got) == len(first)
    assert archive.archived_pages(no_pages).count() == 0
    assert {r.record_type for r in archive.archived_pages(odd_pages, 100).collect() if r.payload_bytes < 100} == {"response"}


def test_archive_round_trip(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    archive.write_archive(pages, str(tmp_path / "w"))
    html = {r.page_id: r.html.encode() for r in pages.collect()}
    for r in archive.record_bytes(archive.read_archive(spark, str(tmp_path / "w"))).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        body = body[: int(fields["Content-Length"])]
        assert head.startswith(b"WARC/1.1\r\n") and bytes(r.record)[len(head) + 4 + len(body) :] == b"\r\n\r\n"
        page = int(fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">"))
        payload = body.partition(b"\r\n\r\n")[2]
        assert payload == (html[page] if fields["WARC-Type"] == "response" else b"") and bytes(r.payload) == html[page]


def test_archive_notices_damage(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet").limit(5)
    archive.write_archive(pages, str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w/payloads"))
    stored.selectExpr("key", "encode('other', 'UTF-8') AS payload").write.parquet(str(tmp_path / "x/payloads"))
    spark.read.parquet(str(tmp_path / "w/headers")).write.parquet(str(tmp_path / "x/headers"))
    with pytest.raises(PySparkException):
        archive.read_archive(spark, str(tmp_path / "x")).collect()


def test_parsed_records(spark, odd_pages, tmp_path):
    """Bytes parse back to what made them, with any url and payload; damaged bytes fail."""
    rows = [(1, "http://é.example/漢", "a\r\n\r\nb"), (2, "http://x/\r\nWARC-Type: revisit", "WARC/1.1\r\n\r\n"), (3, None, "\u00ff\x00\r\n\r\n"), (4, "u", ""), (5, "v", ""), (6, "w", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive.write_archive(pages, str(tmp_path / "w"))
    made = archive.record_bytes(archive.archived_records(spark, str(tmp_path / "w")))
    got = {int(r.header.split("<urn:page:")[1].split(">")[0]): r for r in archive.parsed_records(made).collect()}
    assert {r.header for r in got.values()} == {r.header for r in made.collect()}
    assert {i: bytes(got[i].payload).decode() for i in (1, 2, 3, 4, 6)} == {i: h for i, _, h in rows if i != 5}
    assert "WARC-Type: revisit" in got[5].header and bytes(got[5].payload) == b"" and got[5].http.startswith("HTTP/1.1 200 OK\r\n")
    for broken in ("substring(record, 1, length(record) - 1)", "concat(substring(record, 1, length(record) - 5), encode('!', 'UTF-8'), substring(record, -4, 4))", "substring(record, 2)", "encode('', 'UTF-8')"):
        with pytest.raises(PySparkException):
            archive.parsed_records(made.filter("header LIKE '%WARC-Type: response%' AND length(payload) > 0").selectExpr(f"{broken} AS record")).collect()


def test_stored_payloads_meet_headers_without_an_exchange(spark, small, tmp_path):
    archive.write_archive(spark.read.parquet(f"{small}/pages.parquet"), str(tmp_path / "w"))
    carrying = archive.archived_records(spark, str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = carrying._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_archive_against_sql(spark, small, duck, same):
    same(registry.op8_archive(spark, small), duck, registry.ORACLE_SQL["op8_archive"])


def test_archive_leaves_no_tables(spark, small):
    from tracegrid.functions.shared import release

    rows = registry.op8_archive(spark, small)
    assert rows.count() > 0 and [t.name for t in spark.catalog.listTables() if t.name.startswith("store_")] == []
    release(spark)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("store_")] == []


def test_copies_of_a_payload_become_one_before_the_exchange(spark, tmp_path, monkeypatch):
    seen = {}
    real = archive._bucketed

    def kept(spark, path, schema, buckets, fill=None):
        if path.endswith("/payloads") and fill is not None:
            seen["plan"] = fill._jdf.queryExecution().executedPlan().toString()
        return real(spark, path, schema, buckets, fill)

    monkeypatch.setattr(archive, "_bucketed", kept)
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "IF(id % 4 = 0, concat('own ', id), repeat('the same page ', 500)) AS html")
    archive.write_archive(pages, f"file://{tmp_path}/a")
    plan = seen["plan"]
    assert plan.count("Exchange") == 1 and "partial_first" in plan[plan.index("Exchange") :]
    back = archive.archived_records(spark, f"file://{tmp_path}/a")
    assert back.count() == 400 and back.filter("octet_length(payload) > 0").count() == 101


# url filters


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark, odd_pages, no_pages):
    got = sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(odd_pages).collect())))
    assert got == sorted(map(str, ((r.page_id, *brute(r.url, urlfilter.RULES)) for r in odd_pages.collect())))
    assert urlfilter.filter_urls(no_pages).count() == 0
    empty = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in urlfilter.filter_urls(odd_pages, empty).collect()} == {"allow"}


def test_control_characters_in_hosts(spark):
    """No label of a host passes for the end of another, whatever it holds."""
    hosts = ["net\x01a", "a.net\x01", "a\x01.net", "\x01net", "net", "a.net", "net\x02", "net\x02\x03a", "net\x00", "x\x02\x03.net", ".net", "net.", "a..net", "", "x.net\x01a"]
    rules = [("block", "net", "/"), ("allow", "net\x01a", "/"), ("block", "net\x02\x03a", "/x")]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.filter_urls(df, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(repr((i, *brute(u, rules))) for i, u in enumerate(urls))


def test_long_paths_and_hosts_over_many_ranges(spark):
    """Keys that agree in more characters than decide their range."""
    long = "s" * 300
    rules = [("block", "net", "/"), ("allow", "net", f"/{long}/a"), ("allow", f"{long}.net", "/")]
    urls = [f"http://h.net/{long}/{c}/{i}" for c in "ab" for i in range(300)] + [f"http://w.{long}.net/{i % 7}" for i in range(300)] + [f"http://net/{long}/a/{i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    got = urlfilter.filter_urls(df, spark.createDataFrame(rules, "verdict string, host string, path string"), range_rows=100).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i, *brute(u, rules)) for i, u in enumerate(urls))


def test_nested_rules_over_many_ranges(spark):
    hosts = ["net", "a.net", "b.a.net", "xa.net", "c.b.a.net", "org", "a.org"]
    rules = [("block", "net", "/"), ("allow", "a.net", "/x"), ("block", "b.a.net", "/x/y"), ("allow", "b.a.net", "/x"), ("block", "org", "/x/"), ("allow", "net", "/x/y/z")]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x", "/x/", "/x/y", "/x/y/z", "/q?x", "/xx#y")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 40)], "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = urlfilter.filter_urls(df, table, range_rows=100).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i, *brute(u, rules)) for i, u in enumerate(urls * 40))


def test_copies_of_one_url_span_ranges(spark):
    """One key holds most rows: bounds repeat it, its rows are dealt to several ranges, and rules reach each of them."""
    rules = [("block", "net", "/"), ("allow", "hot.net", "/x")]
    urls = ["http://www.hot.net/x/y"] * 900 + [f"http://h{i}.net/x" for i in range(60)] + [None] * 40
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    keyed = df.select(F.concat(urlfilter.host_key(urlfilter.host_of(F.col("url"))), urlfilter.path_of(F.col("url"))).alias("key"))
    bounds = urlfilter.range_bounds(keyed, 10, 1000)
    assert len(bounds) == 9 and Counter(bounds).most_common(1)[0][1] > 5
    got = urlfilter.filter_urls(df, spark.createDataFrame(rules, "verdict string, host string, path string"), range_rows=100).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i, *brute(u, rules)) for i, u in enumerate(urls))


def test_urls_against_sql(spark, small, duck, same):
    same(registry.op10_url_filter(spark, small), duck, registry.ORACLE_SQL["op10_url_filter"])


# nearest neighbours


def test_nearest_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 24)).astype(np.float32)
    x[100:140] = x[0]  # copies of a query
    x[200:230] *= 1e-6
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(600, None), (620, [0.0] * 24), (640, [float("nan")] * 24), (660, [float("inf")] + [1.0] * 23), (680, [1.0] * 7), (None, [1.0] * 24), (700, []), (720, [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), query_block=7, candidate_block=64).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    wide = x.astype(np.float64)
    for q in range(0, 500, 20):
        score = ann.inner(np.repeat(wide[q : q + 1], 500, axis=0), wide)
        order = sorted((i for i in range(500) if i != q), key=lambda i: (-score[i], i))[:20]
        assert sorted(got[q]) == [(k + 1, i, score[i]) for k, i in enumerate(order)]
    assert set(got) == set(range(0, 500, 20))


def test_nearest_of_repeated_ids(spark):
    """Rows that share an id, with equal and with other vectors, against rows numbered by hand."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    ids = [i % 90 for i in range(300)]
    for a, b in ((0, 90), (0, 180), (20, 110), (1, 91)):
        x[b] = x[a]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<float>")
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), query_block=7, candidate_block=64).collect())
    told, wide = Counter(), x.astype(np.float64)
    for q in (n for n in range(300) if ids[n] % 20 == 0):
        score = ann.inner(np.repeat(wide[q : q + 1], 300, axis=0), wide)
        order = sorted((n for n in range(300) if n != q), key=lambda n: (-score[n], ids[n]))[:20]
        told.update((ids[q], k + 1, ids[n], score[n]) for k, n in enumerate(order))
    assert got == told


def test_nearest_of_tiny_and_huge_vectors(spark):
    """Components that are subnormal, or whose products leave the range of doubles."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6))
    x[:30] *= 5e-324 / np.abs(x[:30]).max() * 3
    x[30:60] *= 1e-170
    x[60:80] *= 1e160
    x[(x == 0).all(axis=1), 0] = 5e-324
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), candidate_block=50).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in range(0, 120, 20):
        with np.errstate(all="ignore"):
            score = np.nan_to_num(ann.inner(np.repeat(x[q : q + 1], 120, axis=0), x), nan=np.inf, posinf=np.inf, neginf=-np.inf)
        order = sorted((i for i in range(120) if i != q), key=lambda i: (-score[i], i))[:20]
        assert sorted(got[q]) == [(k + 1, i, score[i]) for k, i in enumerate(order)]


def test_nearest_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in sorted(ann.nearest(df, df.filter("vec_id = 0")).collect())] == [(1, 1), (2, 2)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_against_sql(spark, small, duck, same):
    same(registry.op4_nearest(spark, small), duck, registry.ORACLE_SQL["op4_nearest"])
