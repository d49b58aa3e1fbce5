import datetime

import pytest

from quarry.sources import corpora, settings, tables


def test_settings():
    s = settings.Settings.load({"BM25_K1": "1.5", "SEED_URLS": "a, b"}, page_size=20)
    assert (s.bm25_k1, s.seed_urls, s.page_size, s.bm25_b) == (1.5, ("a", "b"), 20, 0.75)
    assert settings.page_request("q", 3, 10) == ("q", 10, 20)
    for bad in (("", 1, 10), ("q", 0, 10), ("q", 1, 51), ("x" * 300, 1, 10)):
        with pytest.raises(ValueError):
            settings.page_request(*bad)
    assert settings.page_request("x" * 300, check_length=False)[2] == 0


def test_tables(spark, tmp_path):
    path = str(tmp_path)
    tables.init(spark, path)
    now = datetime.datetime(2024, 1, 1)
    for k, status in enumerate(("running", "done")):
        tables.append(spark.createDataFrame([("j", "", "", 1, 1, 0.0, status, k, 0, now + datetime.timedelta(k))], tables.SCHEMAS["crawl_jobs"]), path, "crawl_jobs")
    assert tables.jobs(spark, path).first().status == "done"
    assert tables.read(spark, path, "documents").count() == 0
    tables.init(spark, path)
    assert tables.read(spark, path, "crawl_jobs").count() == 2


def test_synthetic(spark):
    rows = corpora.synthetic(spark, 3, ["a", "b", "c", "d"], 3).collect()
    assert [r.text for r in rows] == ["b c d", "c a c", "d c b"]
