import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import htmldoc, robots, text, urls

TOK = text.Tokenizer()


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


def test_tokens(spark):
    cases = {"Machine Learning, ROCKS!! 42 times.": ["machine", "learning", "rocks", "42", "times"], "a b I": [], "": [], "x" * 41: [], "snake_case été": ["snake_case", "été"]}
    for raw, want in cases.items():
        assert one(spark, raw, TOK.tokens) == want == TOK.python(raw)
    assert one(spark, None, TOK.tokens) == []
    assert text.Tokenizer(lowercase=False, stop_words=None, min_length=1).python("The A") == ["The", "A"]


def test_clean_visits_only_what_may_change(spark):
    df = spark.createDataFrame([(1, "plain"), (2, "caf&eacute; &amp; ﬁn"), (3, None), (4, "été")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in text.clean(df, "text").collect()} == {1: "plain", 2: "café & fin", 3: None, 4: "été"}
    assert TOK.python("caf&eacute; ﬁn") == ["café", "fin"]


def test_positions(spark):
    df = spark.createDataFrame([(1, "machine  learning é machine")], "doc_id long, text string")
    got = [(r.term, r.position) for r in TOK.stream(df).orderBy("position").collect()]
    assert got == [("machine", 0), ("learning", 9), ("machine", 20)]


def test_fingerprint(spark):
    def python(t):
        return " ".join(filter(None, (w.strip(text.FINGERPRINT_STRIP) for w in t.lower().split() if w not in text.FINGERPRINT_WORDS)))

    for raw in ("The cat,  sat (on) THE mat.", "the, end", "", "  \n", "...", "a an"):
        assert one(spark, raw, text.fingerprint) == python(raw)
        assert one(spark, raw, text.content_hash) == hashlib.sha256(python(raw).encode()).hexdigest()


def test_snippet(spark):
    s = one(spark, "x" * 300 + " Machine learning " + "y" * 300, lambda c: text.snippet(c, ["machine", "mach"], 100))
    assert s["text"].startswith("...") and s["text"].endswith("...") and len(s["text"]) == 106
    assert "<mark>Mach</mark>ine" in s["highlighted"]
    s = one(spark, "nothing here", lambda c: text.snippet(c, ["zebra"], 5))
    assert s["text"] == s["highlighted"] == "nothing here"
    assert one(spark, "aXbxc", lambda c: text.positions_of(c, "x")) == [1, 3]


def test_normalize():
    n = urls.normalize
    assert n("../wool", "https://shop.test/yarn/blue/")["url"] == "https://shop.test/yarn/wool"
    assert n("//cdn.test/x", "https://shop.test/")["url"] == "https://cdn.test/x"
    assert n("https://shop.test/s?size=9&colour=red&size=10")["url"] == "https://shop.test/s?colour=red&size=10&size=9"
    assert n("HTTP://me@Shop.TEST:80//yarn//blue;v=1?utm_medium=mail&Ref=y&empty=#top")["url"] == "http://shop.test/yarn/blue"
    assert n("https://shop.test:444")["url"] == "https://shop.test:444/"
    for bad in (None, "", "ftp://x/", "mailto:a@b", "https://", "javascript:void(0)"):
        assert n(bad) is None


def test_normalize_native_agrees(spark):
    cases = ["https://shop.test/?size=9&colour=red", "http://Shop.test:80//yarn//blue?utm_source=x#f", "https://e.com:8443/p?x=1&ref=2", "https://e.com", "https://e.com/a;p?c=&d=1", "ftp://x/"]
    df = spark.createDataFrame([(c,) for c in cases], "url string")
    got = [r.n for r in df.select(urls.normalize_native(F.col("url")).alias("n")).collect()]
    assert got == [(urls.normalize(c) or {"url": None})["url"] for c in cases]


@pytest.mark.parametrize(("host", "blocked"), [("localhost", True), ("127.0.0.1", True), ("10.1.2.3", True), ("169.254.169.254", True), ("8.8.8.8", False), ("x.internal", True), ("", True), ("example.com", False), ("224.0.0.1", True)])
def test_host_guard(spark, host, blocked):
    assert urls.is_blocked_host(host) is blocked
    assert one(spark, host, urls.blocked_name) is blocked


def test_safe_host():
    assert urls.is_safe_public_host("Example.com", ["example.COM"]) and not urls.is_safe_public_host("other.com", ["example.com"])


def test_robots(spark):
    body = "# file\r\nUser-agent: Other\nUser-agent: Quarry # both\nAllow: /a/open\nDisallow: /a\nCrawl-delay: 9\n\nUser-agent: *\nDisallow: /b?x\nCrawl-delay: 1.5\n"
    files = [("One.example", body), ("two.example", "User-agent: *\nDisallow:\nCrawl-delay: soon"), ("three.example", None), ("four.example", "Disallow: /x\nUser-agent: nobody\nDisallow: /"), ("five.example", "User-agent: *\nDisallow: *")]
    files = spark.createDataFrame(files, "host string, body string")
    own = robots.rules(files, "QuarryBot/2.0").cache()
    others = robots.rules(files, "Visitor").cache()
    urls_ = [f"https://{h}.example{p}" for h, p in (("one", "/a/open/1"), ("ONE", "/a/x"), ("one", "/b?x=1"), ("one", ""), ("two", "/a"), ("three", "/a"), ("four", "/x"), ("five", ""), ("none", "/a"))]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls_)], "i int, url string")
    said = {r.i: (r.allowed, r.crawl_delay) for r in robots.decide(df, own).collect()}
    assert said == {0: (True, 1.5), 1: (False, 1.5), 2: (True, 1.5), 3: (True, 1.5), 4: (True, None), 5: (True, None), 6: (True, None), 7: (False, None), 8: (True, None)}
    assert {r.i for r in robots.decide(df, others).where("NOT allowed").collect()} == {2, 7}
    assert {r.host: r.delay for r in robots.delays(own, 3.0).collect()} == {"one.example": 1.5, "two.example": 3.0, "three.example": 3.0, "four.example": 3.0, "five.example": 3.0}
    assert robots.decide(df.limit(0), own).count() == 0


def test_html():
    page = """<html lang="en"><head><title> A  &amp; B </title><meta name="description" content="Short"><meta property="article:published_time" content="2024-01-01">
    <link rel="canonical" href="/canon"></head><body><nav><a href="/n?utm_source=x">N</a></nav><main><h1>Head</h1><p>One<script>bad()</script> two<h2></h2><h3>Sub</h3></main><a href="mailto:x">m</a><a href="/n">again</a></body></html>"""
    d = htmldoc.extract_document(page, "https://e.com/p")
    assert d["title"] == "A & B" and d["description"] == "Short" and d["canonical_url"] == "https://e.com/canon"
    assert d["body"] == "Head One two Sub" and d["headings"] == ["Head", "Sub"] and d["links"] == ["https://e.com/n"]
    assert d["language"] == "en" and d["published_at"] == "2024-01-01"
    empty = htmldoc.extract_document(None, "https://e.com/")
    assert empty["title"] == "" and empty["body"] == "" and empty["links"] == []


def test_references_need_their_semicolon(spark):
    """A title that was cut inside a reference keeps what is left of it, in the parser as in the native form."""
    page = "<title>a &amp;&amp b &lt c &ampx; &#65; &#66 &eacute;</title><article><h1>d &&amp</h1><p>R&amp;D<a href='/x?a=1&copy=2&amp;b=3'>x</a></article>"
    d = htmldoc.extract_document(page, "https://e.com/")
    assert d["title"] == "a &&amp b &lt c &ampx; A &#66 é" and d["headings"] == ["d &&amp"] and d["body"] == "d &&amp R&D x"
    assert d["links"] == ["https://e.com/x?a=1&b=3&copy=2"]
    assert one(spark, "<title>a &amp;&amp</title>", htmldoc.title) == htmldoc.extract_document("<title>a &amp;&amp</title>", "")["title"] == "a &&amp"


def test_python_gets_portions_and_only_what_may_change(spark):
    import re
    import unicodedata

    import pyarrow as pa

    from quarry.session import portions

    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "html": ["x" * 100, None, "y" * 900, "z" * 5000, "", "é" * 400, "w"]})
    parts = list(portions(batch, ["html"], 1000))
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist() and max(len(p) for p in parts) < 7
    sizes = [[len((t or "").encode()) for t in p.column("html").to_pylist()] for p in parts]
    assert len(parts) == 3 and all(sum(x) <= 1000 + max(x) for x in sizes)
    assert list(portions(batch.slice(0, 0), ["html"])) == []
    rows = [(c, f"ab{chr(c)}z") for c in [*range(0x500), 0x2160, 0xFB01, 0x1D400]] + [(-1, "a & b"), (-2, "&x"), (-3, "&#1"), (-4, ""), (-5, "a\n\nb&"), (-6, "é" * 100_000), (-7, None)]
    hit = {r.id for r in spark.createDataFrame(rows, "id long, t string").where(text.may_change(F.col("t"))).collect()}
    assert all(i in hit for i, t in rows if t is not None and unicodedata.normalize("NFKC", t) != t or re.search("&[#A-Za-z]", t or ""))
    assert not hit & {0x41, 0xE9, 0x17E, -1, -4, -5, -6, -7}


def test_pages_and_their_urls_share_one_python_worker(spark):
    """A task that needs a second worker for the URLs' normal form needs twice the memory."""
    from quarry.plans.queries import QUERIES
    from tests.compare import SF

    plan = QUERIES["document_links"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "MapInPandas" not in plan
    pages = spark.createDataFrame([(1, "HTTP://E.com:80//a?utm_source=x", "<a href=b>"), (2, "no url", None)], "page_id long, url string, html string")
    assert sorted(map(tuple, htmldoc.extract(pages, normal="n").select("page_id", "n", "links").collect())) == [(1, "http://e.com/a", ["http://e.com/b"]), (2, None, [])]
