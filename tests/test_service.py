"""Composite searches, ingest, the crawl as a whole, and what goes with them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import robots
from quarry.operators import crawl, evaluate, ingest, search, service, store
from quarry.operators.index import Index
from quarry.sources import tables
from quarry.sources.settings import CrawlJob, Settings
from quarry.streaming import requests

DOCS = [(1, "red wool and blue wool", "Wool", "https://shop.test/wool"), (2, "blue paint", "Blue paint", "https://shop.test/paint"), (3, "green tea", "Tea", "https://shop.test/tea"), (70_000, "wool tea", "", "https://shop.test/x")]


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark.createDataFrame(DOCS, "doc_id long, text string, title string, url string"), positions=True).persisted()


def test_search_pages(spark, index):
    rows = service.search_page(index, " wool ", 1, 1).collect()
    assert [(r.doc_id, r.total, r.page, r.page_size, r.highlighted) for r in rows] == [(1, 2, 1, 1, "<mark>Wool</mark>")]
    assert rows[0].explanation["final"] == rows[0].score and rows[0].matched_terms == ["wool"]
    assert [r.doc_id for r in service.search_page(index, "wool", 2, 1).collect()] == [70_000] and service.search_page(index, "wool", 3, 1).count() == 0
    with pytest.raises(ValueError):
        service.search_page(index, "  ")
    hybrid = service.hybrid_page(index, "blue wool").collect()
    assert hybrid[0].doc_id in (1, 2) and {"bm25", "semantic", "final"} == set(hybrid[0].explanation) and hybrid[0].total == len(hybrid) == 4
    assert {r.doc_id: r.matched_terms for r in hybrid}[3] == []
    plain = service.plain_page(index, "blue").collect()
    assert {r.doc_id for r in plain} == {1, 2} and {r.snippet for r in plain} == {"Wool", "Blue paint"}


def test_rank_many_equals_rank(spark, index):
    queries = spark.createDataFrame([(1, ["blue", "wool", "blue"]), (2, ["tea"]), (3, [])], "query_id long, terms array<string>")
    many = {(r.query_id, r.doc_id): r.final for r in search.rank_many(index, queries).collect()}
    one = {(q, r.doc_id): r.final for q, text in ((1, "blue wool blue"), (2, "tea")) for r in search.rank(index, text).collect()}
    assert many.keys() == one.keys() and all(abs(many[k] - one[k]) < 1e-12 for k in one)
    qrels = spark.createDataFrame([(1, 1), (2, 3)], "query_id long, doc_id long")
    rows = {r.method: r for r in evaluate.compare(index, spark.createDataFrame([(1, "blue wool blue"), (2, "tea")], "query_id long, query string"), qrels).collect()}
    assert set(rows) == {"bm25", "ranking"} and rows["ranking"].r_at_10 == 1.0 and rows["bm25"].average_latency_ms > 0


def test_index_snapshot_and_positions(spark, index):
    assert {r.doc_id: r.positions for r in index.matched_positions(["wool", "blue"]).collect()} == {1: [4, 13, 18], 2: [0], 70_000: [0]}
    lines = index.to_json()
    assert lines.where("value LIKE '%\"term\":\"wool\"%'").count() == 2  # one a range of ids
    back = Index.from_json(lines)
    assert sorted(map(tuple, back.postings.select("term", "doc_id", "tf", "positions").collect())) == sorted(map(tuple, index.postings.select("term", "doc_id", "tf", "positions").collect()))
    assert sorted(map(tuple, back.documents.collect())) == sorted(map(tuple, index.documents.collect()))
    bare = Index.from_json(Index.build(spark.createDataFrame(DOCS[:1], "doc_id long, text string, title string, url string")).to_json())
    assert "positions" not in bare.postings.columns and bare.stats().first().num_terms == 3


def test_signals(spark):
    row = spark.range(1).select(search.clamped_ratio(F.lit(3.0), F.lit(2.0)).alias("a"), search.clamped_ratio(F.lit(-1.0), F.lit(2.0)).alias("b"), search.clamped_ratio(F.lit(1.0), F.lit(0.0)).alias("c"), search.signal_json(F.lit(0.5), F.lit(2)).alias("d"), search.signal_json(F.lit(0.5)).alias("e")).first()
    assert tuple(row) == (1.0, 0.0, 0.0, '{"score":0.5,"raw":2.0}', '{"score":0.5}')


def test_ingest(spark, index):
    none = lambda name: spark.createDataFrame([], tables.SCHEMAS[name])
    schema = "seq long, url string, canonical_url string, title string, description string, body string, language string, links array<string>"
    first = [(1, "u1", " https://a.test/1 ", "One", "d", "body one", "en", ["x", " y ", "x", ""]), (2, "https://b.test:8080/2", None, None, None, None, None, []), (3, None, " ", "lost", "", "", "", None)]
    one = ingest.index_pages(none("documents"), none("document_links"), none("domains"), spark.createDataFrame(first, schema), "2024-01-01", Index.build(spark.createDataFrame([], "doc_id long, text string, title string, url string")))
    assert tuple(one.counts().first()) == (2, 0, 0, 1)
    assert {r.host for r in one.domains.collect()} == {"a.test", "b.test:8080"}
    assert sorted((r.document_id, r.target_url) for r in one.links.collect()) == [(1, "x"), (1, "y")]
    assert one.index.stats().first().num_documents == 2 and one.documents.columns and set(one.documents.columns) == {c.split()[0] for c in tables.SCHEMAS["documents"].split(", ")}
    again = [(1, "u1", "https://a.test/1", "One", "", "body one", "en", ["z"]), (2, "u1", "https://a.test/1", "One", "", "body two", "en", []), (3, "u1", "https://a.test/1", "One", "", "body two", "en", ["w"]), (4, "n", "https://c.test/", "N", "", "new", "en", ["q"])]
    two = ingest.index_pages(one.documents, one.links, one.domains, spark.createDataFrame(again, schema), "2024-01-02", one.index)
    assert tuple(two.counts().first()) == (1, 1, 2, 0)
    docs = {r.canonical_url: r for r in two.documents.collect()}
    assert docs["https://a.test/1"].body == "body two" and docs["https://a.test/1"].doc_id == 1 and docs["https://c.test/"].doc_id == 3
    assert sorted((r.document_id, r.target_url) for r in two.links.collect()) == [(1, "x"), (1, "y"), (3, "q")]  # the page that changed had no links
    assert {r.doc_id for r in search.BM25().score(two.index, "body").collect()} == {1}
    assert service.rebuilt(two.documents).stats().first().num_documents == 3
    assert tuple(ingest.index_pages(none("documents"), none("document_links"), none("domains"), spark.createDataFrame([], schema), "2024-01-01").counts().first()) == (0, 0, 0, 0)


def test_walk(spark):
    pages = [("https://a.test/", 200, "h", "A", "a", ["https://a.test/1", "https://b.test/", "https://a.test/private", "https://localhost/", "https://a.test/gone", "https://a.test/2"])]
    pages += [("https://a.test/1", 200, "h", "", "text", ["https://a.test/", "https://a.test/3"]), ("https://a.test/2", 200, "h" * 50, "T", "t", []), ("https://a.test/3", 200, "h", "T", "t", ["https://a.test/4"])]
    pages += [("https://a.test/private", 200, "h", "P", "p", []), ("https://b.test/", 200, "h", "B", "b", []), ("https://a.test/4", 200, "h", "T", "t", []), ("https://a.test/empty", 200, "h", "", " ", [])]
    pages = spark.createDataFrame(pages, "url string, status int, html string, title string, body string, links array<string>")
    seeds = spark.createDataFrame([("https://a.test/", 0), ("https://a.test/empty", 1), ("https://c.test/", 2)], "url string, seq int")
    hosts = spark.createDataFrame([("a.test",)], "host string")
    rules = robots.rules(spark.createDataFrame([("a.test", "User-agent: *\nDisallow: /private")], "host string, body string"), "q").cache()
    got = {r.url[14:]: (r.depth, r.outcome) for r in crawl.walk(pages, seeds, 2, 100, hosts, rules, max_bytes=20).collect()}
    assert got == {"/": (0, "fetched"), "/empty": (0, "skipped"), "/1": (1, "fetched"), "/private": (1, "skipped"), "/gone": (1, "failed"), "/2": (1, "too_large"), "/3": (2, "fetched")}
    few = {r.url for r in crawl.walk(pages, seeds, 2, 2, hosts, rules).where("outcome = 'fetched'").collect()}
    assert few == {"https://a.test/", "https://a.test/1"}
    first, rest = crawl.frontier_pop(spark.createDataFrame([("u", 1, 0), ("v", 0, 9), ("w", 0, 2)], "url string, depth int, seq int"), 2)
    assert [r.url for r in first.collect()] == ["w", "v"] and [r.url for r in rest.collect()] == ["u"]
    events = spark.createDataFrame([("fetched", "2024-01-01 00:00:00", 10), ("failed", "2024-01-01 00:00:30", 5)], "outcome string, at string, bytes long")
    assert tuple(crawl.statistics(events).first()) == (1, 1, 0, 10, 30.0, 2.0)
    assert crawl.statistics(events.limit(0)).first().pages_per_minute == 0.0


def test_vectors_jobs_and_percentiles(spark):
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    new = search.vectors_upsert(v, spark.createDataFrame([(2, [9.0]), (3, [3.0])], v.schema))
    assert {r.vec_id: r.embedding[0] for r in new.collect()} == {1: 1.0, 2: 9.0, 3: 3.0}
    assert search.vectors_remove(new, spark.createDataFrame([(1,), (8,)], "vec_id long")).count() == 2 and search.vectors_get(new, spark.createDataFrame([(3,)], "vec_id long")).count() == 1
    job = CrawlJob.load(Settings(max_pages=7), '{"max_depth": 5, "seed_urls": ["https://no.test"], "other": 1}', max_depth=1, seed_urls=("https://B.test/x", "https://a.test/"))
    assert job == CrawlJob(("https://B.test/x", "https://a.test/"), ("a.test", "b.test"), 5, 7, 1.0)
    values = spark.createDataFrame([(x,) for x in [5, 1, 1, 1, 9, 7, 3, None]], "x int")
    assert {r.p: r.value for r in evaluate.percentiles(values, "x", (0.0, 0.5, 1.0)).collect()} == {0.0: 1, 0.5: 3, 1.0: 9}
    keys = spark.createDataFrame([(f"https://long-host-name.test/path/{i:03}",) for i in range(50)], "canonical_url string")
    known = spark.createDataFrame([("https://long-host-name.test/path/007", 40)], "canonical_url string, doc_id long")
    ids = {r.canonical_url[-3:]: r.doc_id for r in store.assign_doc_ids(known, keys).collect()}
    assert ids == {f"{i:03}": 40 if i == 7 else 41 + i - (i > 7) for i in range(50)}


def test_sync_log(spark, tmp_path):
    sync = requests.sync_batch(str(tmp_path / "log"))
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, url string, title string")
    sync(batch([(1, "old words", "", ""), (2, "kept words", "", "")]), 0)
    sync(batch([(1, "new text", "", "")]), 1)
    sync(batch([(1, "new text", "", "")]), 1)  # an epoch that runs again
    got = requests.synced_index(spark, str(tmp_path / "log"))
    assert sorted((r.term, r.doc_id) for r in got.postings.collect()) == [("kept", 2), ("new", 1), ("text", 1), ("words", 2)]
    assert got.stats().first().num_documents == 2


def test_an_id_for_each_page_of_a_url(spark):
    known = spark.createDataFrame([("b", 2), ("b", 4), ("x", 9)], "canonical_url string, doc_id long")
    pages = spark.createDataFrame([(u,) for u in "cabbbcd"], "canonical_url string")
    assert sorted(map(tuple, store.assign_doc_ids(known, pages, each=True).collect())) == [("a", 10), ("b", 2), ("b", 4), ("b", 11), ("c", 12), ("c", 13), ("d", 14)]
    assert sorted(map(tuple, store.assign_doc_ids(known, pages).collect())) == [("a", 10), ("b", 2), ("b", 4), ("c", 11), ("d", 12)]


def test_pages_of_one_url_are_versions_of_its_documents(spark, tmp_path):
    """Two stored pages and a new one under one URL, and two new ones under another: each page counts, as in the SQL."""
    from quarry.plans.oracles import ORACLE_SQL
    from quarry.plans.queries import QUERIES
    from tests.compare import norm

    page = lambda t, b: f"<html><title>{t}</title><body><article>{b}</article></body></html>"
    rows = [(2, "https://a.test/x", page("T", "same")), (6, "https://a.test/x", page("U", "same")), (3, "https://a.test/x", page("T", "same")), (1, "https://b.test/y", page("Y &amp;&amp", "one")), (5, "https://b.test/y", page("Y", "one")), (4, "https://c.test/", page("C", "c"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name, n in (("assign_doc_ids", 6), ("exists_by_hash", 4), ("ingest_counts", 1), ("ingest_documents", 14), ("page_body", 6)):
        got = QUERIES[name](spark, str(tmp_path))
        cur = con.execute(ORACLE_SQL[name])
        at = [[c[0] for c in cur.description].index(c) for c in got.columns]
        want = sorted(repr([norm(r[i]) for i in at]) for r in cur.fetchall())
        assert sorted(repr([norm(x) for x in r]) for r in got.collect()) == want and len(want) == n, name
