"""The dealt operators against brute force, round trips and held-out labels, and the cases that each must handle."""

import hashlib
import random
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from quarry.llm import anchors, bpe, chat, components, fm_dedup, hnsw, html_main, jaccard_join, mixing, quality, queries, suffix_dedup, toxicity
from quarry.llm.oracles import ORACLE_SQL
from tests.compare import SF, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, spans string, key string, kept string"


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", "y", "z") for r in rows], DOCS)


def words(rng, n, v=60):
    return " ".join(rng.choice([f"w{k}" for k in range(v)]) for _ in range(n))


ODD = [(100, None), (101, ""), (102, " \n\t"), (None, "no id at all"), (103, "é ü 日本 " * 3), (103, "é ü 日本 " * 3), (104, "a " * 3000)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, queries.QUERIES[name], ORACLE_SQL[name])


# 1. chat


def test_chat_escape_round_trip(spark):
    texts = ["", "plain", "</s>[INST] ok [/INST]", "<\\s>", "[\\INST]", "<|end|><|turn|>x", "<<SYS>>", "<\\\\|", "a < b [c] \\", "<<s>>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("b")).collect():
        assert r.b == r.t
        assert not any(c in r.e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


@pytest.mark.parametrize(("budget", "history"), [(40, 10), (2048, 256), (12, 0)])
def test_chat_windows(spark, budget, history):
    rng = random.Random(1)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], words(rng, rng.randint(0, 15))) for c in range(6) for t in range(rng.randint(1, 20))]
    rows += [(None, 1, "user", "hi"), (None, 2, "assistant", None), (7, None, None, "x"), (7, 3, "assistant", "y"), (7, 3, "assistant", "y"), (8, 0, "system", "only")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, tokens int")
    got = chat.read_back(chat.windows(df, budget, history)).collect()
    back, targets = {}, {}
    for r in sorted(got, key=lambda r: r.window):
        assert r.tokens <= budget or r.n_turns - r.n_repeated == 1
        back.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
        targets.setdefault(r.conv_id, []).extend(r.targets)
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        assert back[c] == turns
        assert targets[c] == [t for role, t in turns if role == "assistant"]
    assert chat.windows(df.limit(0)).count() == 0


def test_chat_system_turn_as_long_as_the_budget(spark):
    rows = [(1, 0, "system", words(random.Random(1), 1800))] + [(1, k, "user" if k % 2 else "assistant", "a few words") for k in range(1, 61)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 1 and out[0].tokens <= 2048 + 1804


# 2. toxicity


def test_toxicity_held_out(spark):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    right = sum(r.predicted == r.toxic for r in got)
    assert right >= 0.93 * len(got) and any(r.toxic for r in got)


def test_toxicity_cases(spark):
    rows = [(i, f"you {'idiot' if i % 3 == 0 else 'friend'} {words(random.Random(i), 30)}") for i in range(60)] + ODD
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(1, 0, None), (2, 1, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows).withColumn("score", F.lit("mine"))
    clean = toxicity.clean(df, labels)
    assert clean.columns == df.columns
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {i for i in range(60) if i % 3} | {100, 101, 102, 103, 104, None}
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.score(df.drop("score"), toxicity.fit(df, few)).where("score < 0.5").count() == len(rows)
    assert toxicity.clean(df.limit(0), labels).count() == 0


def test_toxicity_equals_a_plain_fit(spark):
    rng = random.Random(8)
    rows = [(i, f"{words(rng, 6)} {'Rotten ' * (i % 3 == 0)}{words(rng, 5)} é") for i in range(40)]
    labels = {i: int(i % 3 == 0) for i in range(30)}
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, rows).drop("score"), toxicity.fit(docs(spark, rows), table, kept=200, rounds=50)).collect()}

    def grams(t):  # the definition, character by character
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        out = set()
        for n in (3, 4, 5, 6):
            for i in range(len(t) - n + 1):
                h = 0
                for c in t[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
                out.add((h * 0xD6E8FEB86659FD93 % 2**64) >> 44)
        return out

    sets = {i: grams(t) for i, t in rows}
    n = [sum(y == c for y in labels.values()) for c in (0, 1)]
    p = np.ones((2, 1 << 20))
    for i, y in labels.items():
        p[y, list(sets[i])] += 1
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    pooled = p.sum(0) / sum(n)
    surely = np.abs(p[1] / n[1] - p[0] / n[0]) / np.sqrt(pooled * (1 - np.minimum(pooled, 0.999999)) * (1 / n[0] + 1 / n[1]) + 1e-12)
    chosen = np.sort(np.argsort(-surely, kind="stable")[:200])
    value = ratio[chosen] / pooled[chosen] ** 0.25
    x = np.array([[value[k] if b in sets[i] else 0.0 for k, b in enumerate(chosen)] for i in labels])
    y = np.array(list(labels.values()))
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    step = 4 / (1 + 4 * float((weight * (x**2).sum(1)).sum()) + 1e-4)
    w, b, w0, b0 = np.zeros(200), 0.0, np.zeros(200), 0.0
    for i in range(50):
        m = i / (i + 3)
        u, c = w + m * (w - w0), b + m * (b - b0)
        g = weight * (1 / (1 + np.exp(-(x @ u + c))) - y)
        w0, b0, w, b = w, b, u - step * (x.T @ g + 1e-4 * u), c - step * g.sum()
    b = min(b, toxicity.NO_FEATURES)
    for i, t in rows:
        z = b + sum(w[k] * value[k] for k, bucket in enumerate(chosen) if bucket in sets[i])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-4


def test_toxicity_of_very_long_texts(monkeypatch):
    text = "".join(random.Random(1).choice("abc é") for _ in range(5000))
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "CHUNK", 97)
    assert np.array_equal(toxicity.features(text), whole)


# 3. Jaccard join


def jaccard_rows(seed):
    rng = random.Random(seed)
    rows = list(ODD) + [(504, "a b c d"), (505, "a B c d e"), (506, "A b C")]
    for _ in range(12):
        base = words(rng, rng.randint(3, 90), 400).split()
        for _ in range(rng.randint(1, 9)):
            other = base[:]
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = rng.choice("xyz")
            rows.append((rng.randint(0, 400), "\t".join(other)))
            base = other if rng.random() < 0.5 else base
    return rows + rows[8:15]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_equals_brute_force(spark, n, percent):
    rows = jaccard_rows(n)
    got = jaccard_join.near_duplicates(docs(spark, rows), n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, jaccard_join.brute_force(rows, n, percent)))


def test_jaccard_regions_are_split_and_still_exact(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "REGION", 600)
    rng = random.Random(4)
    base = words(rng, 60, 400).split()
    rows = []
    for i in range(80):
        other = base[:]
        for _ in range(rng.randint(0, 4)):
            other[rng.randrange(60)] = rng.choice("pqrstuv")
        rows.append((i, " ".join(other)))
    got = jaccard_join.near_duplicates(docs(spark, rows), 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(jaccard_join.brute_force(rows, 4, 85))


def test_jaccard_sketches_never_hide_a_link():
    rng = np.random.default_rng(9)
    base = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 40, 64, 65, 700, 3000)]
    sets = [np.unique(np.concatenate((b[rng.random(len(b)) > drop], rng.integers(0, 2**63, extra).astype(np.uint64)))) for b in base for drop in (0, 0.05, 0.1, 0.3) for extra in (0, 1, 60)]
    sets = [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in sets])
    sketches = jaccard_join.Sketches([jaccard_join.sketch(s) for s in sets], sizes, 80)
    i, j = np.triu_indices(len(sets), 1)
    allowed = sketches.may_link(i, j)
    overlap = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    linked = 100 * overlap >= 80 * (sizes[i] + sizes[j] - overlap)
    assert linked.any() and allowed[linked].all() and allowed.mean() < 0.5


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_linked_sets_share_one_of_their_rarest_shingles(percent):
    rng = np.random.default_rng(percent)
    counts = rng.integers(0, 4, 1 << jaccard_join.BUCKETS).astype(np.uint32)  # many ties
    for _ in range(2000):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64))))
        inter = len(np.intersect1d(a, b))
        if 0 < inter < max(len(a), len(b)) and 100 * inter >= percent * (len(a) + len(b) - inter):
            assert len(np.intersect1d(jaccard_join.rarest(a, percent, counts), jaccard_join.rarest(b, percent, counts)))



def test_jaccard_large_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SKETCHES", 7)
    rows = jaccard_rows(6)
    got = jaccard_join.near_duplicates(docs(spark, rows), 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, jaccard_join.brute_force(rows, 4, 85)))


def test_region_links_with_many_sets():
    rng = np.random.default_rng(3)
    bases = [np.unique(rng.integers(0, 10**6, 80)) for _ in range(3)]
    sets = []
    for _ in range(600):
        b = bases[rng.integers(3)]
        b = b[rng.random(len(b)) > rng.random() * 0.12]
        sets.append(np.unique(np.concatenate((b, rng.integers(0, 10**6, rng.integers(0, 8))))).astype(np.uint64))
    got = jaccard_join.region_links(sets, 85)
    plain = [set(s.tolist()) for s in sets]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got.tolist() == [find(i) for i in range(len(sets))]


def test_representatives(spark):
    rows = [(i, t) for i, (_, t) in enumerate(jaccard_rows(5))]
    rows += rows[20:25]
    df = docs(spark, rows)
    out = jaccard_join.representatives(df, 5, 80)
    assert out.columns == df.columns
    want = {}
    for (d, _), (_, n, comp) in zip(rows, jaccard_join.brute_force(rows, 5, 80)):
        if n and comp is not None:
            want[comp] = comp
    got = out.where("length(trim(translate(text, '\n\t', '  '))) > 0 AND doc_id IS NOT NULL").collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert jaccard_join.representatives(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


# 4. quality


def test_quality_order_does_not_change_the_verdict(spark):
    rng = random.Random(2)
    rows = ODD + [(1, words(rng, 80, 5000)), (2, "*** " * 60), (3, "same line here\n" * 30), (4, words(rng, 80, 5000) + " # # # # # # # # # # # # # #"), (5, "one two three " * 60)]
    rows += [(6, words(rng, 80, 5000).upper().replace("W", "WORDS")), (7, " ".join(str(rng.randint(1000, 9999)) for _ in range(80))), (8, " ".join(rng.sample([f"w{k}" for k in range(14)] * 5, 60)))]
    rows += [(9, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000)))]
    rows = [(i, t.translate(str.maketrans("0123456789", "abcdefghij")) if i in (1, 4, 6, 9) else t) for i, t in rows]
    rows = [(i, t.upper() if i == 6 else t) for i, t in rows]
    rows.append((1, rows[7][1]))  # a very long text, a repeated row  # a very long text, a repeated row
    df = docs(spark, rows).withColumn("n_words", F.lit("clash")).drop("n_words")
    orders = [list(quality.RULES), list(quality.RULES)[::-1]]
    got = [sorted(r.doc_id for r in df.withColumn("ok", F.expr(quality.cascade(o, "text"))).where("ok").collect()) for o in orders]
    base = quality.with_base(df)
    by_column = [sorted(r.doc_id for r in base.where(quality.cascade(o, given=quality.BASE)).collect()) for o in orders]
    assert got[0] == got[1] == by_column[0] == by_column[1] == [1, 1, 9]
    assert sorted(r.doc_id for r in quality.judge(df).where("kept").collect()) == [1, 1, 9]
    planned = quality.plan(df.limit(0))
    assert [r for r, _, _ in planned] == list(quality.RULES)  # nothing rejects anything: ties keep the order
    planned = {r.name: (cost, share) for r, cost, share in quality.plan(df, given=quality.BASE)}
    assert planned["few_words"][1] > 0 and all(c > 0 for c, _ in planned.values())
    f = {r.doc_id: r for r in base.collect()}
    assert f[5].n_repeat_words == 180 and f[3].n_dup_lines == 29 and f[2].n_symbols == 180 and f[100].n_words == 0


def test_quality_sample_comes_from_all_partitions(spark):
    df = spark.range(20_000, numPartitions=10).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    got = [int(r.text[2:]) for r in quality.sampled(df, rows=300).collect()]
    assert 200 < len(got) < 400 and len({i // 2000 for i in got}) == 10
    same_rows = df.where("doc_id = 7").crossJoin(spark.range(1000)).drop("id")
    assert quality.sampled(same_rows, rows=300).count() <= 1


# 5. and 7. exact substrings


def passages(seed, make, low, high):
    rng = random.Random(seed)
    shared = [make(rng, rng.randint(low, high)) for _ in range(6)]
    return rng, shared


@pytest.mark.parametrize("length", [20, 61])
def test_suffix_dedup_equals_brute_force(spark, length):
    def letters(rng, n):
        return "".join(rng.choice("abcdefgh éü\n") for _ in range(n))

    rng, shared = passages(length, letters, length - 5, length * 4)
    rows = ODD + [(3, "a" * 300), (4, "ab" * 200)] + [(i, letters(rng, rng.randint(0, 200)) + rng.choice(shared) + letters(rng, rng.randint(0, 50)) + rng.choice(shared)[rng.randint(0, 9) :]) for i in range(50)]
    rows += rows[9:14] + [rows[20]] * 5
    got = suffix_dedup.deduplicated(docs(spark, rows), length).collect()
    want = [(d, *w) for (d, _), w in zip(rows, suffix_dedup.brute_force([(t or "").encode() for _, t in rows], length))]
    assert sorted(repr((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept))) for r in got) == sorted(map(repr, want))
    assert suffix_dedup.deduplicated(docs(spark, rows[:1]).limit(0)).count() == 0


def test_runs_of_long_texts_do_not_depend_on_their_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    documents = [rng.integers(0, 5, n).astype(np.uint64) for n in (0, 12, 13, 14, 400, 3000)]

    def windows():
        return {(int(r.row[k]), w, int(r.anchor[k]), int(r.key[k])) for r in anchors.runs(documents, 13, 5) for k in range(len(r.row)) for w in range(int(r.first[k]), int(r.last[k]) + 1)}

    whole = windows()
    assert len(whole) == sum(max(0, len(d) - 12) for d in documents)
    for piece in (1, 50, 997):
        monkeypatch.setattr(anchors, "PIECE", piece)
        assert windows() == whole


def test_batches_fall_into_parts_without_loss(monkeypatch):
    texts = ["a" * 5, None, "", "é" * 9, "b" * 100, "", "c", "d", None]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["k", "text"])
    for bytes_ in (1, 2, 23, 10**6):
        monkeypatch.setattr(anchors, "TEXTS", bytes_)
        parts = [p.column(1).to_pylist() for p in anchors.in_parts(b, 1)]
        assert [t for p in parts for t in p] == texts
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= bytes_ for p in parts)
    assert not list(anchors.in_parts(b.slice(0, 0), 1))


def test_substrings_of_a_text_longer_than_a_piece(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**7)}" for _ in range(300_000))
    assert len(long) > anchors.PIECE
    tail = " ".join(long.split()[-200:])
    df = docs(spark, [(1, long), (2, tail), (3, "short " + tail)])
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.deduplicated(df).collect()}
    assert got == {1: (len(tail) + 1, 1), 2: (len(tail), 1), 3: (len(tail) + 1, 1)} or got[2] == (len(tail), 1) and got[3][0] in (len(tail), len(tail) + 1)
    words_ = {r.doc_id: (r.n_words, r.n_removed) for r in fm_dedup.deduplicated(df).collect()}
    assert words_ == {1: (300_000, 0), 2: (200, 200), 3: (201, 200)}


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(100):
        strings = [np.array([rng.randint(0, 2) for _ in range(rng.randint(0, 9))], np.int32) for _ in range(rng.randint(1, 6))]
        with tempfile.TemporaryDirectory() as folder:
            sid, size, lcp = suffix_dedup.suffix_order(strings, folder)
        want = sorted(((tuple(s[len(s) - k :].tolist()), i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)), key=lambda x: [(1, c) for c in x[0]] + [(0, x[1])])
        assert list(zip(sid.tolist(), size.tolist())) == [(i, k) for _, i, k in want]
        for r in range(1, len(want)):
            a, b = want[r - 1][0], want[r][0]
            assert lcp[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("length", [3, 13])
def test_fm_dedup_equals_brute_force(spark, length):
    rng, shared = passages(length, words, length - 1, length * 4)
    rows = ODD + [(8, "a " * 40), (9, "a b " * 30), (None, shared[0])] + [(rng.randint(0, 50), words(rng, rng.randint(0, 40)) + "\n" + rng.choice(shared) + "  " + words(rng, rng.randint(0, 15)) + "\t" + rng.choice(shared)) for _ in range(60)]
    rows += rows[9:15] + [rows[20]] * 5
    df = docs(spark, rows)
    got = fm_dedup.deduplicated(df, length).collect()
    want = [(d, *w) for (d, _), w in zip(rows, fm_dedup.brute_force(rows, length))]
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got) == sorted(map(repr, want))
    clean = fm_dedup.cleaned(df, length)
    assert clean.columns == df.columns
    assert sorted(repr((r.doc_id, " ".join((r.text or "").encode().decode().split(" ")) if False else b" ".join((r.text or "").encode().split()).decode())) for r in clean.collect()) == sorted(repr((d, k)) for d, _, _, k in want)
    assert fm_dedup.cleaned(df.limit(0)).count() == 0


# 6. nearest neighbours


@pytest.mark.parametrize(("shift", "scale"), [(0, 1), (1e6, 1), (0, 1e30), (0, 1e-100), (-3e8, 1e3)])
def test_hnsw_recall_of_any_finite_vectors(spark, monkeypatch, shift, scale):
    monkeypatch.setattr(hnsw, "SHARD", 400)
    monkeypatch.setattr(hnsw, "BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, ((rng.normal(size=12) + shift) * scale).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in hnsw.search(df, F.col("vec_id") % 20 == 0, 10).collect()}
    want = {(q, i) for q, _, i, _ in hnsw.brute_force(rows, set(range(0, 1000, 20)), 10)}
    assert len(want) == 500 and len(got & want) >= 0.95 * len(want)


def test_hnsw(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[rng.integers(30)] + 0.3 * rng.normal(size=8)).tolist()) for i in range(3000)]
    rows += [(4000 + i, [1.0] * 8) for i in range(200)] + [(5000, None), (5100, []), (5200, [0.0] * 8), (5300, [1.0] * 7 + [None]), (5400, [float("nan")] * 8), (5500, [float("inf")] * 8), (None, [1.0] * 8), (5600, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in hnsw.search(df, F.col("vec_id") % 100 == 0, 10).collect()]
    want = hnsw.brute_force(rows, {i for i, _ in rows if i is not None and i % 100 == 0}, 10)
    assert len(got) == len(want)
    assert len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want}) >= 0.9 * len(want)
    exact = {(q, i): s for q, _, i, s in hnsw.brute_force(rows, {q for q, *_ in got}, 10**6)}
    assert all(exact[q, i] == s for q, _, i, s in got)
    assert [g for g in got if g[0] == 4000] == [w for w in want if w[0] == 4000]
    assert hnsw.search(df.limit(0), F.lit(True)).count() == 0


def test_hnsw_every_query_meets_every_shard(spark, monkeypatch):
    """Several shards, lengths and parts in one task: each query block finds its own graph."""
    monkeypatch.setattr(hnsw, "SHARD", 125)
    monkeypatch.setattr(hnsw, "BLOCK", 10)
    monkeypatch.setattr(hnsw, "BLOCKS", 2)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3 if i % 40 < 10 else 12).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in hnsw.search(df, F.col("vec_id") % 20 == 0, 10).collect()]
    want = hnsw.brute_force(rows, set(range(0, 1000, 20)), 10)
    assert sorted(g[:2] for g in got) == sorted(w[:2] for w in want)
    assert len(set(got) & set(want)) >= 0.99 * len(want)


@pytest.mark.parametrize(("groups", "spread", "ef"), [(150, 1e-3, 96), (1, 1, 12)])
def test_hnsw_recall_is_measured(spark, groups, spread, ef):
    """Clusters that one way down misses, and a search that starts with too few candidates for its vectors."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(groups, 64))
    rows = [(i, (middles[i % groups] + spread * rng.normal(size=64)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in hnsw.search(df, F.col("vec_id") % 101 == 0, 10, ef).collect()}
    want = {(q, i) for q, _, i, _ in hnsw.brute_force(rows, set(range(0, 6000, 101)), 10)}
    assert len(want) == 600 and len(got & want) >= 0.95 * len(want)


# 8. mixing


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(0, 40)), ("a", "b", "c", None)[min(3, rng.randint(0, 8))]) for i in range(800)] + [(*r, "odd") for r in ODD] + [(1, "same row", "a")] * 3
    df = docs(spark, rows)
    out = mixing.mix(df).collect()
    total = sum(r.size for r in out)
    size, taken, target = {}, {}, {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.epochs
        target[r.source] = r.target
        assert 0 <= r.epochs <= 3
    assert all(target[s] <= 3 * size[s] + 1e-6 for s in size) and sum(target.values()) == pytest.approx(total)
    longest = max(r.size for r in out)
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in size)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)
    copies = mixing.repeated_documents(df)
    assert copies.columns == df.columns and copies.count() == sum(r.epochs for r in out)
    order = [r.finish for r in mixing.mixed(df).collect()]
    assert order == sorted(order)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.repeated_documents(df.limit(0)).count() == 0


# 9. BPE


def test_bpe_equals_tiktoken(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteBPE(path, public_tokenizers.PATTERN)
    rng = random.Random(7)
    alphabets = [" \na\t", " \n a.", "\x0b\x1c \xa0 a²½_1\0", "ab", "aeinstr ", "éèàüß aei", "日本語中文字 a", "0123456789 ", ".,!?-=*# ", "a", "it's we'll I'd "]
    texts = ["".join(rng.choice(rng.choice(alphabets)) if rng.random() < 0.2 else rng.choice(a) for _ in range(rng.randint(0, 60))) for _ in range(3000) for a in [rng.choice(alphabets)]]
    texts += ["a" * 20_000, "<|endoftext|>", "ab" * 5000]
    for t in texts:
        assert own.encode(t) == enc.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()
    rows = [(i, t) for i, t in enumerate(texts[:50])] + ODD
    got = bpe.decode(bpe.encode(docs(spark, rows), path, public_tokenizers.PATTERN), path).collect()
    assert sorted(repr((r.doc_id, bytes(r.decoded))) for r in got) == sorted(repr((d, (t or "").encode())) for d, t in rows)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def _tiktoken(pattern):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query_digests(spark):
    _, enc = _tiktoken(public_tokenizers.PATTERN)
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array(enc.encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = queries.op9_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_bpe_of_other_patterns():
    for pattern in (r"\S+|\s+", r"[^ ]+ ?| ", r"\w+|\W+"):
        path, enc = _tiktoken(pattern)
        own = bpe.ByteBPE(path, pattern)
        for text in ("a  plain text, with words", " lead and trail ", "it's 12 o'clock", ""):
            assert own.encode(text) == enc.encode_ordinary(text)


# 10. HTML


def test_html_cases(spark):
    article = "<article><h1>T &amp; x</h1><p>One\n two<p>Short.<br>line</article>"
    shell = "<html><head><title>t</title><style>p</style></head><body><nav><ul><li>Menu</li></ul></nav><div class='cookie-notice'>We use cookies, many of them, for a long text that is longer than the article</div>{}<section id=comments><p>A reader says a lot of things here</p></section><form><p>Search now</p></form><aside>Side</aside><script>var a='<p>x</p>'</script><footer>&copy; foot</footer></body></html>"
    want = "T & x\n\nOne two\n\nShort. line"
    assert html_main.main_text(shell.format(article)) == want
    assert html_main.main_text(shell.format(article.replace("</article>", "<div class='ad'>Buy</div></article>"))) == want
    long = "<div><p>" + "A long paragraph of text. " * 9 + "</p><p>" + "And another one. " * 9 + "</p></div>"
    assert html_main.main_text(shell.format(long)) == ("A long paragraph of text. " * 9).strip() + "\n\n" + ("And another one. " * 9).strip()
    for empty in (None, "", "<html></html>", "<!-- x", "<script>"):
        assert html_main.main_text(empty) == ""
    assert html_main.main_text("<p>a < b <") == "a < b <"
    df = spark.createDataFrame([(1, "u", shell.format(article), "x"), (1, "u", shell.format(article), "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert [r.text for r in html_main.extract(df).orderBy(F.col("page_id").desc()).collect()] == [want, want, ""]
    assert html_main.extract(df.limit(0)).count() == 0


def test_html_planted_articles():
    rng = random.Random(4)
    prose = lambda low, high: " ".join(f"{words(rng, rng.randint(6, 14), 900).capitalize()}." for _ in range(rng.randint(low, high)))
    for _ in range(60):
        blocks = [prose(3, 6) for _ in range(rng.randint(3, 7))]
        blocks[0] = words(rng, 5, 900)
        body = f"<h1>{blocks[0]}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p class='text'>{}</p>", "<blockquote><p>{}</p></blockquote>", "<p>{}"]).format(b.replace(" ", rng.choice([" ", "\n", "  "]))) for b in blocks[1:])
        where = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='story'>{}</div>", "<div><div id='x1'>{}</div></div>"]).format(body)
        menu = "<nav><ul>" + "".join(f"<li><a href='/{k}'>{words(rng, 2)}</a></li>" for k in range(rng.randint(2, 30))) + "</ul></nav>"
        side = rng.choice(["<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<section id='comments'>{}</section>", "<form>{}</form>", ""]).format(f"<p>{prose(1, 2)}</p>")
        page = f"<html><head><title>{words(rng, 3)}</title><script>var x = '<p>no</p>';</script></head><body><header>{words(rng, 4)}</header>{menu}{where}{side}<footer>{prose(1, 1)}</footer></body></html>"
        assert html_main.main_text(page) == "\n\n".join(blocks), page


def test_html_hostile_markup_takes_linear_time():
    import time

    for page in ("<a " * 200_000, "<!" * 200_000, "<a '>' " * 60_000, '<a "' * 60_001, "<a '>" * 60_000, "<p>x" * 30_000, "<div>" * 30_000, "<article>" * 20_000 + "</div>" * 20_000):
        began = time.process_time()
        html_main.main_text(page)
        assert time.process_time() - began < 10
    assert html_main.main_text('<p title="a > b">One</p><p title="never closed>Two</p>') == "One\n\nTwo"


def test_html_articles_in_main():
    assert html_main.main_text("<main><article><h1>T</h1><p>One</p></article></main>") == "T\n\nOne"
    assert html_main.main_text("<main><h1>T</h1><article><p>One</p></article><article><p>Two</p></article></main><p>out</p>") == "T\n\nOne\n\nTwo"
    assert html_main.main_text("<main><article><p>One</p><article><p>A reader's comment</p></article><p>Two</p></article></main>") == "One\n\nTwo"


def test_html_unclosed_furniture():
    for page, want in (
        ("<article><p>One</p><p class='ad'>Buy<p>Two</p><p>Three</p></article>", "One|Two|Three"),
        ("<article><ul><li>One<li class='share'>Share<li>Two</ul><p>Three</p></article>", "One|Two|Three"),
        ("<article><dl><dt>One<dd class='ad'>Buy<dt>Two<dd>Three</dl></article>", "One|Two|Three"),
        ("<article><table><tr><td>One<td class='ad'>Buy<td>Two<tr class='ad'><td>Buy<tr><td>Three</table></article>", "One|Two|Three"),
        ("<main><section><p>One</p><div class='ad'>Buy</section><p>Two</p></main>", "One|Two"),
        ("<main><p>One <select><option>A<option class='ad'>B</select></p><p>Two</p></main>", "One|Two"),
        ("<main><p>One <span class='ad'>Buy <span>now</span> or never</span> and two</p></main>", "One|and two"),
        ("<main><div class='ad'>Buy<article><p>One</p></article><p>Two</p></main>", "One|Two"),
        ("<article><p>One</p><article><p>Two</p></body>", "One|Two"),
        ("<div><article><p>One</p></div><p>Two</p></article></div>", "One|Two"),
        ("<html><head><title>T</title><body><p>One</p>", "One"),
    ):
        assert html_main.main_text(page).split("\n\n") == want.split("|"), page


def test_html_judges_containers():
    long, ad = "A long paragraph of text. " * 20, "<div class='ad'>Buy</div>"
    body = long.strip()
    for page, want in (
        (f"<h1>Title</h1>{ad}<p>{long}</p>{ad}<p>The end.</p>", ["Title", body, "The end."]),
        (f"<div><h1>Title</h1>{ad}<div><p>{long}</p>{ad}<ul><li>A</li></ul><form>x</form><div>B<p>C</p></div></div></div>", ["Title", body, "A", "B", "C"]),
        (f"<div><div>{long}</div>{ad}<div>Short</div></div>", [body, "Short"]),
        (f"<div><p>Links</p><p>More</p></div>{ad}<div><p>{long}</p>{ad}<p>The end.</p></div>{ad}<div><p>Imprint</p></div>", [body, "The end."]),
        (f"<div><div>By me</div><div><p>{long}</p>{ad}<p>The end.</p></div></div>", ["By me", body, "The end."]),
        (f"<div><p>{long}</p>{ad}<p>The end.</p></div><article><p>A card</p></article>", [body, "The end."]),
        (f"<div><p>{'More of it. ' * 3}</p></div><article><p>{long}</p>{ad}<p>The end.</p></article>", [body, "The end."]),
    ):
        assert html_main.main_text(page).split("\n\n") == want, page


def test_html_names_are_whole_tokens():
    text = "A paragraph of text that is long enough to be most of it."
    for page, want in (
        (f"<article><h2 id='related-work'>One</h2><h2 id='search'>Two</h2><p><a id='share'>Three</a> {text}</p></article>", ["One", "Two", f"Three {text}"]),
        (f"<article><p>{text}</p><section id='share-prices'><p>One</p></section></article>", [text, "One"]),
        (f"<div class='content has-sidebar'><p>{text}</p></div>", [text]),
        (f"<div class='no-sidebar'><p>{text}</p><p class='search-results'>One</p></div>", [text, "One"]),
        (f"<article class='post has-comments'><p>{text}</p></article>", [text]),
        (f"<article><p>One</p><div class='widget'><p>{text}</p></div></article>", ["One", text]),
        (f"<div class='widget'><article><p>{text}</p></article></div><p>out</p>", [text]),
        (f"<form><p>{text}</p></form>", [text]),
        (f"<article><article><p>{text}</p></article><article><p>One</p></article></article>", [text, "One"]),
        (f"<article><p title='the hidden part'>{text}</p><p data-x='an id=ad'>One</p></article>", [text, "One"]),
        (f"<article><p>{text}</p><div class='left cookie-bar'>Buy</div><ul id='related-posts'><li>Buy</ul><p hidden>Buy</p><p role=search>Buy</p></article>", [text]),
    ):
        assert html_main.main_text(page).split("\n\n") == want, page


def test_html_on_the_pages(spark):
    from quarry.functions.htmldoc import body

    rows = queries.op10_html(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", body(F.col("html")).alias("plain")), "page_id").collect()
    assert rows and all(r.text.replace("\n\n", " ") == r.plain and r.n_chars == len(r.text) for r in rows)


def test_empty_tables_have_schemas(spark):
    assert isinstance(html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).schema, T.StructType)
