"""The pipeline's stages against brute force on a small corpus."""

import random

import corpus_pipeline as P
from quarry.llm import fm_dedup, jaccard_join


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(900)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(60)
    rows = [(i, make(rng.randint(30, 80)), "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(10)]  # exact copies
    rows += [(200 + i, rows[20 + i][1] + " extra", "en", "s2", 0) for i in range(5)]  # near copies
    rows += [(300 + i, make(40) + " " + passage + " " + make(40), "en", "s3", 0) for i in range(6)]
    rows += [(400 + i, "you idiot moron scum " + make(40), "en", "s0", 0) for i in range(30)]
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (None, "no id", "en", "s1", 5), (0, rows[0][1], "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int(400 <= r[0] < 430)) for r in rows if r[0] is not None and r[0] != 500], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert 4 <= len(P.STAGES) <= 5
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        if i < len(P.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append([tuple(r)[:2] for r in docs.collect()])
    clean = [r[:2] for r in rows if r[0] is None or not 400 <= r[0] < 430]
    assert sorted(map(repr, seen[0])) == sorted(map(repr, clean))
    comps = jaccard_join.brute_force(clean, 5, 80)
    firsts = {d for d, n, c in comps if n and d == c and d is not None}  # the row without id is linked with nothing
    assert sorted(d for d, t in seen[1] if d is not None and t) == sorted(firsts)
    cut = {d: k for (d, t), (_, _, k) in zip(seen[1], fm_dedup.brute_force(seen[1], 13))}
    assert {d: " ".join((t or "").split()) for d, t in seen[2]} == cut
    assert 300 in cut and passage in cut[300] and passage not in cut[301]
    ids = [d for d, _ in seen[3]]
    assert set(ids) <= {d for d, t in seen[2] if t} and max(map(ids.count, set(ids))) <= 3
    assert sorted(map(repr, (d for d, _ in seen[4]))) == sorted(map(repr, ids))
    assert P.run(spark, str(tmp_path)).count() == len(ids)


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
