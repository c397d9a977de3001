"""Sharding, mixing, search, classifiers and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.llm import filters, language, mixing, quality, sharding, topk

SF = "/root/testdata/sf0.001"


def test_differencing():
    rng = random.Random(3)
    for n, k in ((0, 4), (1, 4), (7, 3), (200, 8)):
        sizes = {i: rng.randint(0, 1000) for i in range(n)}
        placed = sharding.karmarkar_karp(sizes, k)
        assert set(placed) == set(sizes)
        sums = [sum(sizes[i] for i in sizes if placed[i] == s) for s in range(k)]
        assert n < 200 or max(sums) - min(sums) <= 5
    two = sharding.karmarkar_karp({0: 8, 1: 7, 2: 6, 3: 5, 4: 4}, 2)
    assert sorted(sum(s for i, s in enumerate((8, 7, 6, 5, 4)) if two[i] == k) for k in (0, 1)) == [14, 16]


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "same text", f"{'é' * rng.randint(0, 50)}{i}"]), 9) for i in range(400)] + [(3, "twice", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, slot long").repartition(3)
    got = sharding.shard_by_bytes(df, shards=8).collect()
    assert len(got) == len(rows)
    by_text, sums = {}, [0] * 8
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for r in got:
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
        sums[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    largest = max(sum(size(t) for _, t, _ in rows if (t or "") == x) for x in ("", "same text"))
    assert max(sums) - min(sums) <= max(largest, 60)
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None, "tiny"] if i % 9 else ["a"]), rng.choice([None, "", "one two\x0bthree", "w " * rng.randint(1, 30)])) for i in range(300)]
    rows = [r for r in rows if r[1] != "tiny"] + [(1000, "tiny", "just three words"), (1000, "tiny", "just three words"), (None, "a", "no id here")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit(7)).repartition(4)
    got = mixing.mix(df, cells=16).collect()
    assert len(got) == len(rows)
    names, total = {}, sum(r["size"] for r in got)
    keyed = df.select("doc_id", F.col("source").alias("s"), F.xxhash64("text").alias("text_hash")).distinct()
    for r in keyed.collect():
        names[r["doc_id"], r["text_hash"]] = r["s"]
    per = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        t = per.setdefault(names[r["doc_id"], r["text_hash"]], [0, 0.0, r["source_size"]])
        t[0] += r["taken"]
        t[1] = r["target"]
    for taken, target, size in per.values():
        assert taken == int(target) and target <= 3 * size + 1e-9
    assert sum(t[1] for t in per.values()) == pytest.approx(total)
    assert per["tiny"][1] == 3 * per["tiny"][2]
    again = {tuple(r) for r in mixing.mix(df.repartition(7), cells=64).collect()}
    assert again == {tuple(r) for r in got}
    copies = mixing.apply_mix(df, cells=16)
    assert copies.columns == df.columns and copies.where("source = 'tiny'").count() == 6
    assert mixing.mix(df.limit(0)).count() == 0


def test_quality_moves_the_fraction(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * 10) for i in range(400)], "doc_id long, source string, text string")
    weights = spark.createDataFrame([(i, 20.0 if i % 4 < 2 else 0.05) for i in range(400)], "doc_id long, quality double")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(df, quality=weights).collect()}
    picked = [i for i in got if i % 2 == 0 and got[i]]
    assert sum(i % 4 < 2 for i in picked) > 0.7 * len(picked)


def test_topk(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(301, None, 1), (302, [1.0] * 11 + [None], 1), (303, [float("nan")] + [1.0] * 11, 1), (320, [float("inf")] * 12, 1), (None, [1.0] * 12, 1), (340, [1.0, 2.0], 1), (341, [2.0, 1.0], 1), (360, [], 1), (7, x[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    v = topk.quantized(df)
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 20 = 0"), k=5, vector_block=64, query_block=6).collect()))
    ok = [(i, np.floor(64 * np.array(e, float))) for i, e, _ in rows if i is not None and e is not None and all(c is not None and np.isfinite(c) for c in e)]
    want = []
    for q, a in {i: a for i, a in ok if i % 20 == 0}.items():
        s = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:5]
        want += [(q, r + 1, i, -s_) for r, (s_, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = lambda k: F.crc32(k.cast("string").cast("binary")) % 4 == 2
    rows, share = quality.training_rows(docs, labels, keep=lambda k: ~held(k))
    scored = quality.score(docs.withColumn("score", F.lit("clash")), quality.train(rows, share))
    seen = scored.join(labels, "doc_id").where(held(F.col("doc_id"))).collect()
    good, bad = ([r["score"] for r in seen if r["quality"] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9 and np.mean([g >= 0.7 for g in good]) > 0.9
    odd = quality.score(spark.createDataFrame([(1, None), (2, ""), (None, "x" * 300000)], "doc_id long, text string"), quality.train(rows, share)).collect()
    assert len(odd) == 3 and all(0 <= r["score"] <= 1 for r in odd)
    none, share = quality.training_rows(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs.limit(3), quality.train(none, share)).collect()} == {0.5}


def test_language(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages"))
    model = language.train(language.sample(docs))
    got = language.identify_documents(docs, model, carry=["doc_id"]).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert np.mean([r["lang"] == r["true"] for r in got]) > 0.97 and np.mean([r["kept"] for r in got]) > 0.98
    web = language.identify_pages(pages, model, carry=["page_id", "url"])
    assert web.count() == pages.count() and web.columns == ["page_id", "url", "lang", "p", "kept"]
    odd = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "12 34 !?", None), (4, "The and of thing that with", None), (4, "The and of thing that with", None)], "doc_id long, text string, source string")
    rows = sorted((r["doc_id"], r["lang"], r["kept"]) for r in language.identify_documents(odd, model, carry=["doc_id"]).collect())
    assert rows == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True)]
    bad = spark.createDataFrame([(1, None, None), (2, "not a url", "<html lang='de'>Der die und das ist")], "page_id long, url string, html string")
    assert language.identify_pages(bad, model, carry=["page_id"]).count() == 2
    assert language.identify_documents(odd.limit(0), model, carry=["doc_id"]).count() == 0
    assert language.identify_documents(odd, language.train([]), carry=["doc_id"]).where("kept").count() == 0


def test_language_of_unspaced_text_with_digits(spark):
    plain = "今日は天気がとても良いので公園まで歩きました。そこで友達と会って昼ご飯を食べました。"
    model = language.train([("ja", plain), ("en", "the weather was good today and we walked to the park to have lunch there")])
    dated = "今日は2024年の公園です。友達と会って昼ご飯を食べました。とても良い天気でした。"
    long = plain * 4000  # 160,000 characters without a blank or a digit
    identify = lambda rows: sorted((r["doc_id"], r["lang"], r["kept"]) for r in language.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), model, carry=["doc_id"]).collect())
    assert identify([(1, dated, None), (2, "<b>we-walked-to-the-park1</b>", None), (3, "2024", None)]) == [(1, "ja", True), (2, "en", True), (3, "und", False)]
    assert identify([(4, long, None)]) == [(4, "ja", True)]


def test_all_labelled_languages_are_told(spark):
    rng = random.Random(4)
    rows = []
    for i in range(36):  # the later a language, the rarer
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        rows += [(100 * i + j, " ".join(rng.choice(own) for _ in range(15)), f"l{i:02}", None) for j in range(2 + (36 - i) // 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    samples = language.sample(df)
    assert sorted({name for name, _ in samples}) == [f"l{i:02}" for i in range(36)] and len(samples) == len(rows)
    got = language.identify_documents(df, language.train(samples), carry=["doc_id"]).collect()
    assert {r["doc_id"]: r["lang"] for r in got} == {r[0]: r[2] for r in rows} and all(r["kept"] for r in got)
    with pytest.raises(ValueError, match="35 languages"):
        language.sample(df, languages=35)


def test_top_k_of_repeated_query_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-20, 20, 6).astype(float).tolist()) for i in range(300)]
    rows += [(i, (np.array(rows[i][1]) * 9 + j).tolist()) for i in (5, 6) for j in range(6)]  # a query's own rows score highest
    df = spark.createDataFrame(rows, "vec_id long, q array<double>").coalesce(1)
    queries = df.where("vec_id in (5, 6)")
    got = [tuple(r) for r in topk.top_k(df, queries, k=2).collect()]
    want = []
    for i in (5, 6):
        q = min(v for n, v in rows if n == i)
        best = sorted((-int(np.dot(v, q)), n) for n, v in rows if n != i)[:2]
        want += [(i, r, n, -s) for r, (s, n) in enumerate(best, 1)]
    assert sorted(got) == want


def test_page_parts(spark):
    f = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    assert f(language.host_of, "https://u:p@www.Example.DE:80/x") == "www.example.de" and f(language.declared_in, "<!doctype html><HTML class=a LANG='Pt-BR'>") == "pt"
    assert language.page_text("<html><script>no</script><p>a &amp; b</p><!-- c --></html>").split() == ["a", "&", "b"]


def test_dropping_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "d"), (None, "d")], "doc_id long, text string")
    gone = spark.createDataFrame([(3,), (None,)], "doc_id long")
    assert sorted(str(r["doc_id"]) for r in filters.without(df, gone).collect()) == ["1", "2", "2", "None", "None"]
    assert sorted(str(r["doc_id"]) for r in filters.without(df, gone, once=True).collect()) == ["1", "2", "None", "None"]


def test_pipeline_decides_by_row(spark):
    import corpus_pipeline as cp

    a, b, c = ("The %s and of thing that with %s or the people of this place have been there for a long time" % w for w in (("first", "one"), ("river", "mill"), ("winter", "lamp")))
    rows = [(i, f"{a} {b} {i}", "en", "s") for i in range(100, 110)] + [(1, a, "en", "s"), (1, "12 34", "en", "s"), (None, "?!", "en", "s"), (None, b, "en", "s"), (None, b, "en", "s"), (2, b, "en", "t"), (3, a, "en", "s"), (3, c, "en", "s"), (3, c, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    small = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.where("doc_id is null or doc_id < 100").collect()), key=str)
    known = cp.language_id(spark, docs, SF)
    assert small(known) == sorted([(1, a), (None, b), (None, b), (2, b), (3, a), (3, c), (3, c)], key=str)
    assert small(cp.near_duplicates(spark, known, SF)) == [(1, a), (2, b), (3, c)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    sys_docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = sys_docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == sys_docs.columns, name
        out.write.parquet(str(tmp_path / name.replace("/", "-")))
        last, docs = docs, spark.read.parquet(str(tmp_path / name.replace("/", "-")))
        if name == "language ID":
            assert docs.count() >= 0.98 * last.count()
        if name == "n-gram Jaccard join":
            from tests.llm.test_text_operators import linked

            rows = [tuple(r) for r in last.select("doc_id", "text").collect()]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({c for _, _, c in linked(rows, 5, 80)})
        if name == "benchmark decontamination":
            from tests.llm.test_text_operators import hits

            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert not any(hits(r["text"], items)[4] for r in docs.collect()) and docs.count() > 0.9 * last.count()
    final = cp.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    assert [r["doc_id"] for r in final] == sorted(r["doc_id"] for r in docs.collect())
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(final, final[1:], strict=False))
