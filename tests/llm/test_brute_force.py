"""Operators without SQL against plain second implementations."""

import heapq
import math
import random
import re
import time
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagmill.llm import filters, language, mixing, quality, sharding, topk
from tagmill.llm.q_quality import held_out, op3_quality_classifier
from tagmill.llm.q_sharding import op4_sharding

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def plain_scores(model, texts):
    """Quality scores block by block from the model's dictionaries and weights."""
    import zstandard as z

    made = {}
    for label in ("good", "bad"):
        made[label] = z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(model[label]), write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for text in texts:
        data, sizes = (text or "").encode(), {}
        for label, c in made.items():
            sizes[label] = sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024))
        d = (sizes["bad"] - sizes["good"]) / (sizes["bad"] + sizes["good"]) if data else 0.0
        n = math.log(1 + len(data)) / 10
        total = 0.0
        for x, c, s, w in zip((1.0, d, d * n, d * n * n), model["centre"], model["scale"], model["w"], strict=True):
            total += (x - c) / s * w
        out.append((1 / (1 + math.exp(-total)), d))
    return out


def test_quality_is_the_plain_score(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = quality.train(*quality.training_rows(docs.select("doc_id", "text"), labels, keep=lambda k: ~held_out(k)))
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: p for r, p in zip(rows, plain_scores(model, [r["text"] for r in rows]), strict=True)}
    got = op3_quality_classifier(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]][0], abs=1e-9) and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    told = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    good, bad = ([want[i] for i, y in told.items() if y == label and i in want] for label in (1, 0))
    for part, least in ((0, 0.95), (1, 0.95)):  # the score, and the compressed-size difference alone
        assert np.mean([(g[part] > b[part]) + 0.5 * (g[part] == b[part]) for g in good for b in bad]) > least


def test_quality_trains_on_whole_texts(spark):
    # what tells the labels apart stands at the end of long texts only
    rng = random.Random(1)
    say = lambda words, k: " ".join(rng.choice(words) for _ in range(k))
    common, good, bad = (["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)] for _ in range(3))
    rows = [(i, i % 2, say(common, 6000) + say(good if i % 2 else bad, 300)) for i in range(40)]
    model = quality.train(rows)
    scores = [s for s, _ in plain_scores(model, [say(good if i % 2 else bad, 80) for i in range(20)])]
    assert min(scores[1::2]) > max(scores[::2])


def test_quality_of_few_and_odd_labels(spark):
    docs = spark.createDataFrame([(1, "good words here", 0), (2, "### bad $$$", 0), (2, "other text", 0), (3, None, 0), (None, "x", 0)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 7), (None, 1)], "doc_id long, quality int")
    rows, share = quality.training_rows(docs, labels)
    assert sorted((k, y) for k, y, _ in rows) == [(1, 1), (2, 0)] and share == 0.5
    got = quality.score(docs, quality.train(rows, share)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.training_rows(docs, labels, class_bytes=5)[0] == []
    assert quality.score(docs.limit(0), quality.train(rows, share)).count() == 0


def plain_differencing(sizes, k):
    """Largest differencing over lists of members."""
    heap = [(-size, n, [(size, [item])] + [(0, [])] * (k - 1)) for n, (item, size) in enumerate(sorted(sizes.items()))]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        sums = sorted([(a[i][0] + b[k - 1 - i][0], a[i][1] + b[k - 1 - i][1]) for i in range(k)], key=lambda p: -p[0])
        spread = sums[0][0] - sums[-1][0]
        heapq.heappush(heap, (-spread, n, [(s - sums[-1][0], m) for s, m in sums]))
        n += 1
    return {item: shard for shard, (_, members) in enumerate(heap[0][2] if heap else []) for item in members}


def test_sharding_is_plain_differencing(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64(body), F.lit(1 << 16)).alias("bin")).collect()
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in rows}
    bins = {}
    for r in rows:
        bins[r["bin"]] = bins.get(r["bin"], 0) + size[r["doc_id"]]
    want = plain_differencing(bins, 8)
    got = {r["doc_id"]: r for r in op4_sharding(spark, SF).collect()}
    assert len(got) == len(rows) and all(got[r["doc_id"]]["shard"] == want[r["bin"]] for r in rows)
    by_shard = {}
    for r in got.values():
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == size[r["doc_id"]]
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    total = [sum(r["size"] for r in got.values() if r["shard"] == s) for s in range(8)]
    assert max(total) - min(total) <= max(bins.values())


def test_sharding_of_null_ids_and_equal_texts(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (None, None, 3), (4, "", 4), (4, "long " * 999, 5), (5, "b", 6)], "doc_id long, text string, shard int")
    got = sharding.shard_by_bytes(df, shards=3).collect()
    assert len(got) == 6 and len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"a")}) == 1
    assert {r["size"] for r in got if r["text_crc32"] == 0} == {1}
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def plain_languages(model, rows, accept=0.5):
    """(language, p, kept) of (host, suffix, declared, text) by walking every table."""
    names = model["names"]
    k = len(names)
    posteriors = []
    for _, _, _, text in rows:
        text = re.sub(r"[0-9]+", " ", text or "")
        logs = [-math.inf] * k + [math.log(0.001)]
        if re.search(r"[^\W\d_]", text):
            data = f" {text.lower()} ".encode()
            grams = [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(len(data) - 2)]
            for j in range(k):
                logs[j] = math.log(0.999) - math.log(k) + sum(float(model["table"][g, j]) for g in grams) / 3
            logs[k] += -16 * math.log(2) * len(grams) / 3
        top = max(logs)
        w = [math.exp(x - top) for x in logs]
        posteriors.append([round(x / sum(w) * 1e6) for x in w])
    add = lambda vectors: [sum(v[j] for v in vectors) for j in range(k)]
    world = add(posteriors) if rows else [0] * k
    base = [(world[j] + 1e6) / (sum(world) + k * 1e6) for j in range(k)]
    group = lambda key: {x: add([p for r, p in zip(rows, posteriors, strict=True) if key(r) == x]) for x in {key(r) for r in rows}}
    hosts, suffixes = group(lambda r: (r[0], r[1])), group(lambda r: r[1])
    told = {d: add([p for r, p in zip(rows, posteriors, strict=True) if r[2] == d]) for d in names}
    out = []
    for (host, suffix, declared, _), p in zip(rows, posteriors, strict=True):
        s = [(suffixes[suffix][j] - p[j]) / 1e6 for j in range(k)]
        prior = [(s[j] + 20 * base[j]) / (sum(s) + 20) for j in range(k)]
        h = [(hosts[host, suffix][j] - p[j]) / 1e6 for j in range(k)]
        prior = [(h[j] + 5 * prior[j]) / (sum(h) + 5) for j in range(k)]
        says = [1.0] * k
        if declared in names:
            said = [0.8 if names[j] == declared else 0.2 / max(k - 1, 1) for j in range(k)]
            says = [(told[declared][j] / 1e6 + 5 * said[j]) / (sum(told[d][j] for d in names) / 1e6 + 5) for j in range(k)]
        w = [p[j] * prior[j] * k * says[j] for j in range(k)] + [float(p[k])]
        best = max(range(k + 1), key=lambda j: (w[j], [*names, "und"][j]))
        share = round(w[best] / sum(w), 6)
        out.append(([*names, "und"][best], share, best < k and share >= accept))
    return out


@pytest.mark.parametrize("broadcast_hosts", [50_000, 0])
def test_language_is_plain_fusion(spark, broadcast_hosts):
    docs, pages = table(spark, "documents"), table(spark, "pages")
    model = language.train(language.sample(docs.where("doc_id % 2 = 0")))
    rest = docs.where("doc_id % 2 = 1")
    rows = rest.select("doc_id", "source", "text", "lang").collect()
    want = plain_languages(model, [(r["source"], None, None, r["text"]) for r in rows])
    got = {r["doc_id"]: r for r in language.identify_documents(rest, model, carry=["doc_id"], broadcast_hosts=broadcast_hosts).collect()}
    assert len(got) == len(rows)
    for r, (lang, p, kept) in zip(rows, want, strict=True):
        own = got[r["doc_id"]]
        assert (own["lang"], own["kept"]) == (lang, kept) and own["p"] == pytest.approx(p, abs=2e-4)
    assert np.mean([got[r["doc_id"]]["lang"] == r["lang"] for r in rows]) > 0.95  # texts the model has not seen
    rows = pages.select("page_id", "html", language.host_of(F.col("url")).alias("host"), language.declared_in(F.col("html")).alias("declared")).collect()
    want = plain_languages(model, [(r["host"], None if r["host"] is None else r["host"].split(".")[-1], r["declared"], language.page_text(r["html"] or "")) for r in rows])
    got = {r["page_id"]: r for r in language.identify_pages(pages, model, carry=["page_id"], broadcast_hosts=broadcast_hosts).collect()}
    for r, (lang, p, kept) in zip(rows, want, strict=True):
        own = got[r["page_id"]]
        assert (own["lang"], own["kept"]) == (lang, kept) and own["p"] == pytest.approx(p, abs=2e-4)


def test_language_carries_columns_of_any_name(spark):
    model = language.train([("en", "the weather was good and we walked to the park"), ("de", "das wetter war gut und wir gingen in den park")])
    df = spark.createDataFrame([(1, "h", "x", "n", None, "s", "the good park"), (None, None, None, None, 5, None, None)], "doc_id long, host string, host_ string, none string, w int, source string, text string")
    carry = ["doc_id", "host", "host_", "none", "w"]
    got = language.identify_documents(df, model, carry=carry)
    assert got.columns == [*carry, "lang", "p", "kept"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows[0][:6] == (1, "h", "x", "n", None, "en") and rows[1][:6] == (None, None, None, None, 5, "und")
    with pytest.raises(ValueError):
        language.identify_documents(df.withColumn("p", F.lit(1)), model, carry=["p"])


def test_page_text_equals_the_pattern_and_is_linear():
    drop = re.compile(r"(?is)<(script|style|nav|header|footer|aside|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(3)
    bits = ["<script>", "</script >", "<SCRIPT x='1'", "</nav>", "<nav>", "<!--", "-->", "<p>", "</p>", "a", " ", "<", ">", "<header-x>", "b\n", "</scriptx>"]
    for _ in range(3000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert language.page_text(html) == drop.sub(" ", html), html
    began = time.time()
    for bad in ("<script", "<!--", "<nav>", "<", "</script "):
        language.page_text(bad * 200_000)
    assert time.time() - began < 20


def test_helpers_meet_no_other_columns(spark):
    rows = [(i, f"word{i} " * (i + 1), "s", i, i, i, i, str(i), True) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, k_ int, h_ int, at_ int, row_ string, gone_ boolean")
    mixed = mixing.apply_mix(docs.withColumnsRenamed({"gone_": "copy_"}))
    assert mixed.columns == [c if c != "gone_" else "copy_" for c in docs.columns] and mixed.count() > 0
    left = filters.without(docs, docs.where("doc_id < 5").select("doc_id"), once=True)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == list(range(5, 12))
    key = docs.where("doc_id = 3").select(filters.row_key(docs).alias("x"))
    assert filters.without_rows(docs, key).count() == 11


def test_lists_are_read_as_far_as_needed():
    rng = np.random.default_rng(5)
    spread = np.floor(64 * rng.normal(size=(2048, 32)))
    # a few vectors point the query's way: reading stops early
    centre = np.floor(64 * rng.normal(size=32)) * 3
    near = np.floor(rng.normal(size=(2048, 32)) * 2)
    near[:30] += centre
    for vectors, queries, most in ((spread, spread[:64], 0.95), (near, np.tile(centre, (8, 1)), 0.3)):
        lists, reads = topk.Lists(vectors), topk.Reads()
        own = np.zeros((len(queries), len(vectors)), bool)
        found = topk.search_block(lists, queries, np.full(len(queries), -np.inf), 20, own, reads)
        for q, places in zip(queries, found, strict=True):
            scores = vectors @ q
            assert set(np.flatnonzero(scores > np.sort(scores)[-20])) <= set(places.tolist())
        assert reads.read <= most * reads.all and reads.resolved < 0.2 * len(queries) * len(vectors)


def test_search_is_cheap_in_cpu():
    rng = np.random.default_rng(7)
    vectors = np.floor(8 * rng.normal(size=(8192, 64)))
    queries = vectors[:256]
    shared = types.SimpleNamespace(value={64: (np.arange(256), queries)})
    rows = [pa.RecordBatch.from_arrays([pa.array(np.arange(8192)), pa.array(list(vectors))], ["vec_id", "q"])]
    took, spin = [], []
    for _ in range(3):
        began = time.thread_time()
        sum(range(1_000_000))
        spin.append(time.thread_time() - began)
        began = time.process_time()
        (found,) = topk._searcher(shared, 20, topk.VECTOR_BLOCK)(rows)
        took.append(time.process_time() - began)
    # two million pairs: 0.7 s by adding value after value, where a million numbers are summed in 20 ms
    assert min(took) < 25 * min(spin), (took, spin)
    scores = queries @ vectors.T
    scores[np.arange(256), np.arange(256)] = -np.inf
    assert found.column(2).to_numpy().reshape(256, 20).tolist() == np.sort(scores, axis=1)[:, :-21:-1].tolist()
