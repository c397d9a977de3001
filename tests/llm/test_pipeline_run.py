"""run() of the pipeline against plain implementations of its five stages."""

import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tagmill.llm import language, q_mixing
from tagmill.llm.q_token_files import tokenizer_path
from tests.llm.test_brute_force import plain_languages
from tests.llm.test_text_operators import linked

SF = "/root/testdata/sf0.001"


def cut(text, items, n=10, drop_share=0.5):
    """The text without the words of benchmark windows; None if it goes."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    small = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    lower = lambda t: pattern.findall(small(t))
    own, hit = lower(text), set()
    for item in items:
        w = lower(item)
        size = min(n, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i : i + size]) in grams:
                hit |= set(range(i, i + size))
    if not hit:
        return text
    if len(hit) >= drop_share * len(own):
        return None
    spans, out, at = [m.span() for m in pattern.finditer(small(text))], "", 0
    for i in sorted(hit):
        if i - 1 in hit:
            at = spans[i][1]
        else:
            out, at = out + text[at : spans[i][0]], spans[i][1]
    return out + text[at:]


def plain_run(docs, items, labels, model):
    """(doc_id, n_tokens, crc) of rows (doc_id, text, source) with distinct ids, in order."""
    from tokenizers import Tokenizer

    told = plain_languages(model, [(s, None, None, t) for _, t, s in docs])
    docs = [d for d, (_, _, kept) in zip(docs, told, strict=True) if kept]
    firsts = {c for _, _, c in linked([(i, t) for i, t, _ in docs], 5, 80)}
    docs = [(i, cut(t, items), s) for i, t, s in docs if i in firsts]
    docs = [d for d in docs if d[1] is not None]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs], "source": pa.array([d[2] for d in docs], pa.string())}))
    con.register("labels", labels)
    copies = {r[0]: math.floor(r[1] / r[2] + 0.5) for r in con.sql(f"SELECT doc_id, taken, size FROM ({q_mixing.SQL}) WHERE taken > 0").fetchall()}
    tokenizer, out = Tokenizer.from_file(tokenizer_path()), []
    for i, t, _ in sorted(docs):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        out += [(i, len(ids), zlib.crc32(ids.tobytes()))] * copies.get(i, 0)
    return out


@pytest.fixture
def folder(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    words = " ".join(docs.first()["text"].split()[:40])
    extra = spark.createDataFrame(
        [(90001, words + " " + " ".join(item.split()[:15]) + " " + words, "en", "s", 1), (90002, item, "en", "s", 1), (90003, None, "en", None, 0), (90004, "", "en", "s", 0), (90005, "12 34", "en", "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    all_docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).unionByName(extra)
    all_docs = all_docs.select("*", F.lit("x").alias("row_"), F.lit(1).alias("k_"), F.lit(2).alias("copies"), F.lit(3).alias("hits_"))
    all_docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_run_is_the_plain_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.train(language.sample(docs))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["text"]]
    want = plain_run(rows, items, spark.read.parquet(f"{folder}/labels.parquet").toArrow(), model)
    got = sorted(cp.run(spark, folder).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert 90002 not in {r["doc_id"] for r in got}


def test_run_of_empty_tables_and_null_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy_ int"
    some = "The %s and of thing that with the people of this place have been there for a long time %s"
    for name, rows in (("empty", []), ("odd", [(None, some % ("river", "one two"), "en", "s", None, 1), (None, some % ("mill", "far away"), "en", None, None, 1), (3, some % ("lamp", "x y z"), None, "s", 1, None)] * 2)):
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        got = cp.run(spark, str(folder)).collect()
        # the mix takes all of the null source, and part of the other
        assert len({r["ids_crc32"] for r in got}) in (range(2, 4) if rows else [0]) and {r["doc_id"] for r in got} <= {r[0] for r in rows}
