import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import crawl, evaluate, search, store
from quarry.operators.index import Index
from quarry.streaming import requests

# The quality corpus and its judgements.
CORPUS = [
    (1, "https://example.com/ml-intro", "Introduction to Machine Learning", "Machine learning is a field of computer science that gives computers the ability to learn without being explicitly programmed."),
    (2, "https://example.com/deep-learning", "Deep Learning Foundations", "Deep learning is a subset of machine learning that uses neural networks with many layers to model complex patterns."),
    (3, "https://example.com/transformers", "Transformers in NLP", "The transformer architecture underpins modern natural language processing models."),
    (4, "https://example.com/databases", "Relational Databases", "A relational database stores data in tables queried with SQL."),
    (5, "https://example.com/sql-tuning", "SQL Performance Tuning", "Indexing, statistics and query rewriting improve the performance of SQL workloads."),
    (6, "https://example.com/cooking", "Cooking Pasta", "Pasta recipes, Italian cuisine and beginner-friendly cooking guides."),
    (7, "https://example.com/python-intro", "Python for Data Science", "Python is widely used for data science thanks to numpy, pandas and scikit-learn."),
    (8, "https://example.com/vector-search", "Vector Search Primer", "Vector search embeds documents into a high-dimensional space and retrieves nearest neighbours based on similarity."),
    (9, "https://example.com/embeddings", "Embedding Models", "Embedding models project text into dense vectors that capture semantics."),
    (10, "https://example.com/ranking", "Learning to Rank", "Learning to rank trains a model to combine BM25 scores, link authority and freshness signals."),
]
JUDGED = [("machine learning", (1, 2)), ("deep learning neural networks", (2, 1)), ("transformer nlp", (3, 9)), ("sql database", (4, 5)), ("vector embeddings", (8, 9)), ("cooking pasta", (6,)), ("python data science", (7, 1)), ("learning to rank", (10,))]


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark.createDataFrame(CORPUS, "doc_id long, url string, title string, text string"), positions=True).persisted()


def test_bm25_formula(index):
    got = {r.doc_id: r for r in search.BM25().score(index, "machine machine learning").collect()}
    assert set(got) == {1, 2, 10} and got[1].matched_terms == ["learning", "machine"]
    lengths = {r.doc_id: r.doc_length for r in index.documents.collect()}
    avg = sum(lengths.values()) / 10

    def part(df, tf, dl):
        return math.log((10 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    assert got[2].bm25 == pytest.approx(part(2, 1, lengths[2]) + part(3, 2, lengths[2]))
    for bad in ({"k1": -1}, {"b": 2}):
        with pytest.raises(ValueError):
            search.BM25(**bad)
    assert search.BM25().score(index, "the !!").count() == 0


def test_quality_numbers(spark, index):
    queries = spark.createDataFrame([(i, t) for i, (q, _) in enumerate(JUDGED) for t in index.tokenizer.python(q)], "query_id long, term string")
    run = evaluate.ranked(search.BM25().score_many(index, queries), "bm25")
    qrels = spark.createDataFrame([(i, d) for i, (_, rel) in enumerate(JUDGED) for d in rel], "query_id long, doc_id long")
    m = evaluate.macro(evaluate.per_query(run, qrels)).first()
    assert [round(m[c], 3) for c in ("p_at_5", "p_at_10", "r_at_10", "mrr", "ndcg_at_5", "ndcg_at_10")] == [0.3, 0.15, 0.875, 1.0, 0.883, 0.883]


def test_ranking(index):
    r = search.page(search.rank(index, "machine learning"), "final", 10).collect()
    assert r[0].doc_id == 1 and r[0].title_score == 1.0 and r[0].freshness_score == 0.5
    assert r[0].explanation["final"] == pytest.approx(r[0].bm25 + 1.5 + 0.5 * r[0].url_score + 0.15 + 0.3 * r[0].quality_score)
    only = search.rank(index, "machine learning", search.RankingConfig.bm25_only())
    assert "title_score" not in only.columns and set(only.first().explanation) == {"bm25", "final"}
    assert search.rank(index, "learning", signals={"freshness": F.lit(1.0)}).first().freshness_score == 1.0


def test_pages(index):
    hits = search.BM25().score(index, "learning")
    assert search.page(hits, "bm25", 0).count() == 0
    assert [r.doc_id for r in search.page(hits, "bm25", 1, 1).collect()] == [r.doc_id for r in search.page(hits, "bm25", 3).collect()][1:2]
    with pytest.raises(ValueError):
        search.page(hits, "bm25", 1, -1)


def test_hybrid_returns_documents_without_similarity(index):
    assert search.hybrid(index, "!!!", 10).count() == 10
    top = search.hybrid(index, "cooking pasta", 3, 0, search.HybridConfig(1.0, 0.5, 0.5)).collect()
    assert top[0].doc_id == 6 and top[0].bm25 == 1.0
    assert search.hybrid(index, "x", 10, -1).count() == 0


def test_index_edits(spark, index, tmp_path):
    less = index.remove(spark.createDataFrame([(1,), (99,)], "doc_id long"))
    assert less.documents.count() == 9
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame(CORPUS[:1], "doc_id long, url string, title string, text string"))
    more = less.add(spark.createDataFrame(CORPUS[:1], "doc_id long, url string, title string, text string"))
    assert more.stats().first() == index.stats().first()
    index.save(str(tmp_path / "snap"))
    back = Index.load(spark, str(tmp_path / "snap"))
    assert sorted(map(repr, back.postings.collect())) == sorted(map(repr, index.postings.collect()))
    empty = Index.build(spark.createDataFrame([], "doc_id long, text string")).stats().first()
    assert empty.num_documents == 0 and empty.avg_document_length == 0.0


def test_suggestions_and_retrieval(spark, index):
    assert [r.suggestion for r in search.suggestions(index, "deep lea").collect()] == ["deep lea learn", "deep lea learning"]
    docs = spark.createDataFrame(CORPUS, "doc_id long, url string, title string, text string")
    rows = search.retrieve(index, "pasta", docs).collect()
    assert rows[0].highlighted.startswith("<mark>Pasta</mark>")


def test_cosine_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 4)) for r in search.vector_topk(df, 2).collect()]
    assert got == [(3, 0.7071), (1, 0.0)]


def test_store(spark):
    pages = spark.createDataFrame([("u1", "T", "Body one"), ("u2", "T", "Body two"), ("u3", "T3", "x")], "canonical_url string, title string, body string")
    from quarry.functions.text import content_hash

    stored = pages.where("canonical_url <> 'u3'").withColumn("content_hash", content_hash(F.col("body"))).withColumn("doc_id", F.when(F.col("canonical_url") == "u1", 5).otherwise(9))
    assert {r.canonical_url: r.outcome for r in store.outcomes(stored, pages.withColumn("body", F.when(F.col("canonical_url") == "u2", "changed").otherwise(F.col("body")))).collect()} == {"u1": "duplicate", "u2": "updated", "u3": "inserted"}
    assert {r.canonical_url: r.doc_id for r in store.assign_doc_ids(stored, pages).collect()} == {"u1": 5, "u2": 9, "u3": 10}
    links = spark.createDataFrame([(1, "a", "old", 0), (2, "b", "old", 0)], "document_id long, target_url string, anchor_text string, position int")
    new = spark.createDataFrame([(1, " c ", "x" * 600, 0), (1, "c", "later", 1), (1, " ", "no", 2)], links.schema)
    got = {(r.document_id, r.target_url): len(r.anchor_text) for r in store.replace_links(links, new).collect()}
    assert got == {(1, "c"): 500, (2, "b"): 3}


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "source string, target string")
    got = {r.url: r.depth for r in crawl.bfs(edges, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    front = spark.createDataFrame([("a", 0, 0)], "url string, depth int, seq int")
    assert crawl.frontier_push(front, spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("b", 1, 3)], front.schema)).count() == 2


def test_rate_limit_is_greedy(spark):
    rows = [(i, 1, float(t)) for i, t in enumerate((0, 10, 20, 61, 65))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t double").withColumn("ts", F.timestamp_seconds("t"))
    got = [r.allowed for r in requests.rate_limit(df, 2).orderBy("event_id").collect()]
    assert got == [True, True, False, True, False]


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("limited", requests.rate_limit_stream(stream, 1), "append"), ("windows", requests.window_counts(stream, "1 day"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, requests.rate_limit(src, 1).collect()))
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 1000


def test_percentiles(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    assert {r.p: r.value for r in evaluate.percentiles(df, "v").collect()} == {0.5: 50.0, 0.95: 95.0, 0.99: 99.0}


def test_page_queries_read_any_html(spark, tmp_path):
    """Links of every form are resolved, and the body is found wherever the page keeps it."""
    from quarry.plans.queries import QUERIES

    links = "<nav><a href='a/b.html'>1</a><a href='../x'>2</a><a href='?page=2'>3</a><a href='//h.org/y'>4</a><a href=/z>5</a><a href='mailto:a@b.c'>6</a></nav>"
    pages = [
        (1, "https://e.com/d/p", f"<title>T</title><body>{links}<main><p>In main</p></main></body>"),
        (2, "https://e.com/q", "<body><div role='main'>In role</div><p>out</p></body>"),
        (3, "https://e.com/r", "<body><p>In body</p></body>"),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    want = ["https://e.com/d/a/b.html", "https://e.com/x", "https://e.com/d/p?page=2", "https://h.org/y", "https://e.com/z"]
    assert [r.target for r in sorted(run("page_links"), key=lambda r: r.position)] == want
    assert {(r.source, r.target) for r in run("link_graph")} == {("https://e.com/d/p", x) for x in want}
    assert [r.targets for r in run("document_links")] == [" ".join(sorted(want))]
    assert {r.page_id: r.body for r in run("page_body")} == {1: "In main", 2: "In role", 3: "In body"}


def test_full_queries_and_judgements_without_ranks(spark, tmp_path):
    """A document found by a late term alone is ranked, and a relevant document beyond rank 40 counts as the miss that it is."""
    from quarry.plans.queries import QUERIES

    passage = "alpha bravo charlie delta echo"
    docs = [(1, "echo"), (2, passage + " filler" * 400)] + [(k, "alpha bravo charlie delta echo".replace(" ", " x ")) for k in range(3, 53)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, passage), (8, "echo"), (9, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = QUERIES["bm25_multi_query"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in run} == {7, 8} and [r.doc_id for r in run if r.query_id == 8 and r.rank == 1] == [1]
    rows = {r.query_id: r for r in QUERIES["precision_recall"](spark, str(tmp_path)).join(QUERIES["ndcg"](spark, str(tmp_path)), "query_id").collect()}
    assert set(rows) == {7, 8} and rows[7].r_at_10 == rows[7].ndcg_at_10 == 0.0
    assert rows[8].p_at_10 == rows[8].ndcg_at_10 == 1.0 and rows[8].r_at_10 == pytest.approx(10 / 52, abs=1e-6)
    assert 0.5 < QUERIES["mrr"](spark, str(tmp_path)).first().mrr < 0.5 + 1 / 80


def test_snapshot_lines_and_crawled_links(spark, tmp_path):
    import hashlib

    from quarry.plans.queries import QUERIES

    spark.createDataFrame([(1, "alpha bravo alpha")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pages = [(1, "https://e.com/a", "<a href='b'>b</a>"), (30, "https://e.com/b", "<a href=c>c</a>"), (31, "https://e.com/c", ""), (32, "https://e.com/lone", "<a href='a'>a</a>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = QUERIES["snapshot_digest"](spark, str(tmp_path)).collect()
    assert sorted((r.term or "", r.doc_id or 0) for r in rows) == [("", 1), ("alpha", 0), ("bravo", 0)]
    line = '{"term":"alpha","postings":[{"doc_id":1,"tf":2}]}'
    assert [r.line_sha256 for r in rows if r.term == "alpha"] == [hashlib.sha256(line.encode()).hexdigest()]
    assert {r.url: r.depth for r in QUERIES["crawl_bfs"](spark, str(tmp_path)).collect()} == {"https://e.com/a": 0, "https://e.com/b": 1, "https://e.com/c": 2}


def test_judged_looks_at_what_the_whole_run_would(spark):
    """The first ten and the best relevant hit give the figures of the whole run, with ties and with the best far below."""
    hits = [(q, d, float((d * 7 + q) % 13)) for q in range(4) for d in range(60)]
    hits = spark.createDataFrame(hits, "query_id long, doc_id long, bm25 double")
    qrels = spark.createDataFrame([(0, 3), (0, 59), (1, 11), (1, 99), (2, 25), (2, 26), (3, 77)], "query_id long, doc_id long")
    whole = evaluate.ranked(hits, "bm25")
    few = evaluate.judged(hits, "bm25", qrels)
    assert few.count() <= 44 and few.exceptAll(whole).count() == 0
    rows = lambda run: sorted(map(tuple, evaluate.per_query(run, qrels).collect()))
    assert rows(few) == rows(whole)


def test_holders_find_every_passage(spark):
    docs = [(1, "one two three four"), (2, "someone two threefold"), (3, "two"), (4, "one  two three"), (5, ""), (6, None), (7, "über-wide one two three, on"), (8, "!?")]
    items = [(10, "one two three"), (11, "two"), (12, "ne two three"), (13, "e t"), (14, "?"), (15, "two three f"), (16, "wide one two three, on")]
    want = sorted((q, d) for q, p in items for d, t in docs if t and p in t)
    got = evaluate.holders(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, passage string"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 15


def test_dealt_indexes_are_equal_and_weights_need_no_sort(spark, index):
    docs = spark.createDataFrame(CORPUS, "doc_id long, url string, title string, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = Index.build(docs)
    for column in ("term", "doc_id"):
        assert rows(Index.build(docs, dealt=column).postings.select("term", "doc_id", "tf")) == rows(plain.postings.select("term", "doc_id", "tf"))
    dealt = Index.build(docs, dealt="term")
    want = search.tfidf(plain).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("weight").alias("m"), F.sum("weight").alias("s"))
    got = search.tfidf_by_document(dealt)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and plan.count("REPARTITION_BY_COL") == 2  # both uses are one exchange
    assert [pytest.approx(x) for x in rows(want)] == rows(got)
    lines = dealt.json_lines()
    assert {r.term for r in lines.where("doc_id IS NULL").collect()} == {r.term for r in plain.vocabulary().collect()} and lines.where("term IS NULL").count() == 10
    odd = Index.from_json(Index.build(spark.createDataFrame([(1, "a word", 'has "postings":[ in it', "u")], "doc_id long, text string, title string, url string"), dealt="term").to_json())
    assert odd.documents.first().title == 'has "postings":[ in it' and odd.postings.count() == 1
