"""Operators over texts against plain implementations, with null, empty, long, tied and repeated rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagmill.llm import chat, decontaminate, signature_tree, suffix_groups, token_files
from tagmill.llm.q_token_files import VOCABULARY, tokenizer_path

SCHEMA = "doc_id long, text string, key string, n long"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, texts = say(40), [None, "", " \n\t", "one two", "One TWO", "x" * 30000, "ab " * 400]
    for i in range(n):
        kind = i % 6
        if kind == 0 and i > 12:
            texts.append(texts[rng.randint(7, len(texts) - 1)])  # exact copy
        elif kind == 1 and i > 12:
            t = texts[rng.randint(7, len(texts) - 1)].split()
            t[rng.randrange(len(t))] = "changed"
            texts.append(" ".join(t))
        elif kind == 2:
            texts.append(say(10) + " " + passage + " " + say(rng.randint(5, 60)))
        else:
            texts.append(say(rng.randint(1, 90)))
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[3], (5000, texts[20], "k", 2), (None, texts[21], "k", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(rows, length):
    """doc_id, bytes, removed, runs and digest of what is left, by comparing all windows."""
    low = lambda i: -1 if i is None else i
    first = {}
    data = [(low(i), (t or "").encode()) for i, t, *_ in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, b), row in zip(data, rows, strict=True):
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                mask[p : p + length] = True
        runs = len(re.findall("1+", "".join("01"[int(x)] for x in mask)))
        out.append((row[0], len(b), int(mask.sum()), runs, hashlib.sha256(bytes(c for c, m in zip(b, mask, strict=True) if not m)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_text", [1 << 25, 3000])
def test_suffix_groups(docs, empty, block_text):
    rows = [tuple(r) for r in docs.collect()]
    got = suffix_groups.remove(docs, length=50, block_text=block_text).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, 50)
    assert suffix_groups.remove(empty).count() == 0


def test_suffix_groups_of_long_and_hot_texts(spark, monkeypatch):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = say(90), say(300)
    rows = [(i, "\n".join(rng.choice([line, say(30), passage[:200], passage[100:]]) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    rows += [(1000, passage * 40 + say(3000)), (1001, say(2000) + passage * 40), (999, line), (None, line), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for chunk, windows, pack in ((1 << 20, 1 << 20, 1 << 16), (700, 500, 100)):  # a text over CHUNK, hashes and segments in parts
        for name, value in (("CHUNK", chunk), ("WINDOWS", windows), ("PACK", pack)):
            monkeypatch.setattr(suffix_groups, name, value)
        got = sorted(map(tuple, suffix_groups.remove(df, block_text=20_000).collect()), key=str)
        assert got == removed(rows, 50)


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 40))]
        assert suffix_groups.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def linked(rows, n, percent):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    sets = [grams(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("limit", "percent", "block_text"), [(1 << 21, 80, 1 << 24), (60, 80, 4000), (200, 50, 1 << 24)])
def test_signature_tree(docs, empty, limit, percent, block_text):
    rows = [tuple(r) for r in docs.collect()]
    got = signature_tree.join(docs, n=5, percent=percent, limit=limit, block_text=block_text).collect()
    assert sorted(map(tuple, got), key=str) == linked(rows, 5, percent)
    assert signature_tree.join(empty).count() == 0


def test_tree_finds_all_links():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 62, 80, dtype=np.uint64)) for _ in range(12)]
    sets = []
    for i in range(150):
        own = base[i % 12].copy()
        keep = rng.random(len(own)) > rng.choice([0.02, 0.1, 0.3])
        sets.append(np.unique(np.concatenate([own[keep], rng.integers(0, 1 << 62, rng.integers(0, 12), dtype=np.uint64)])))

    def names(pairs):
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(sets))]

    all_pairs = [(a, b) for a in range(150) for b in range(a) if signature_tree.linked(np.intersect1d(sets[a], sets[b]).size, len(sets[a]), len(sets[b]), 80)]
    found = signature_tree.Tree(sets).links(80)
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == l) for l in set(labels))  # noqa: E731, E741
    assert groups(names(found)) == groups(names(all_pairs))


def hits(text, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    own, mask, names = lower(text), set(), set()
    for name, t in items:
        w = lower(t)
        size = min(n, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i : i + size]) in grams:
                mask |= set(range(i, i + size))
                names.add(str(name))
    return len(own), len(mask), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(mask)


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_decontamination(spark, docs, empty, block_bytes):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(1, " ".join(texts[9].split()[10:30]).upper()), (20, "one two"), (3, None), (4, "..."), (20, "one two"), (7, texts[11])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(decontaminate.scan(docs, bench, block_bytes=block_bytes)).collect()
    want = [(r["doc_id"], *hits(r["text"], items)) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[5] for w in want) >= 3
    assert decontaminate.scan(empty, bench).count() == 0
    clean = decontaminate.scan(docs, bench.limit(0))
    assert clean.where(F.size("items") > 0).count() == 0 and clean.count() == docs.count()


def test_removal_of_benchmark_spans(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Before, {passage.upper()}! after " + "x " * 40, "a"), (2, passage, "b"), (3, "clean\ttext ", "c"), (4, None, "d")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, bench).collect()}
    assert got == {1: "Before, ! after " + "x " * 40, 3: "clean\ttext ", 4: None}


def test_removal_in_blocks_is_removal_at_once(spark):
    w = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(w[5 * i : 5 * i + 10])) for i in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, " ".join([*"abc", *w[5 * i : 5 * i + 15], *["x"] * 40, "end"])) for i in range(9)]  # windows of two items overlap
    docs += [(20 + i, " ".join([*w[5 * i : 5 * i + 10], *["y"] * 12, *w[5 * i + 15 : 5 * i + 25]])) for i in range(7)]  # each of two items holds less than half
    docs += [(40 + i, " ".join([*w[20:25], *w[5 * i : 5 * i + 10], *w[25:30], *["z"] * 40])) for i in (0, 1, 7, 8)]  # a cut makes neighbours
    docs = spark.createDataFrame([*docs, (60, None), (61, "clean")], "doc_id long, text string")
    once = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, bench).collect()}
    assert once[0] == "a b c  " + " ".join(["x"] * 40) + " end" and not any(20 <= k < 30 for k in once)
    assert once[40].split()[:10] == [*w[20:30]] and once[60] is None and once[61] == "clean"
    for block_bytes in (70, 150):
        assert {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, bench, block_bytes=block_bytes).collect()} == once


def test_token_files(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BLOCK_IDS", 300)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    folder = token_files.new_folder(spark)
    token_files.write(docs, folder, tokenizer_path(), vocabulary=VOCABULARY, shard_bytes=9000)
    got = [tuple(r) for r in token_files.read(spark, folder).collect()]
    at, want = 0, []
    rows = docs.orderBy(F.col("doc_id").asc_nulls_first()).collect()
    for r in rows:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    same = lambda x: [(a, c, d) for a, _, c, d in x]  # noqa: E731 - repeated ids have no order of their own
    assert sorted(same(got), key=str) == sorted(same(want), key=str)
    once = [w for w in want if sum(w[0] == v[0] for v in want) == 1]
    assert set(once) <= set(got)
    part = token_files.manifest(spark, folder).where("base = 0").first()
    first = np.concatenate([[*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in rows])
    assert token_files.token_ids(spark, folder, part["part"], 5, 400).tolist() == first[5 : min(400, part["n_ids"])].tolist()
    folder = token_files.new_folder(spark)
    token_files.write(empty, folder, tokenizer_path(), vocabulary=VOCABULARY)
    assert token_files.read(spark, folder).count() == 0


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 32])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 70001, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    for a, b in ((0, len(ids)), (5, 5), (12345, 12399), (69990, 70001)):
        assert (token_files.unpack(packed, width, a, b) == ids[a:b]).all()


def test_word_cache_equals_whole_encoding():
    cache = token_files.WordCache(tokenizer_path())
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x21, 0x250)] + ["́", "Σ", "漢", "ﬁ", " ", "\x1c", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) if rng.random() < 0.3 else rng.choice("abcdeE.,' \n'st") for _ in range(rng.randint(0, 30)))
        assert cache.encode(text) == cache.whole(text)


def test_words_that_the_cache_cannot_hold_are_encoded_once(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_BYTES", 1 << 20)
    rng = random.Random(8)
    bits = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt"]
    stems = ["".join(rng.choice(bits) for _ in range(rng.randint(3, 6))) for _ in range(20_000)]
    text = " ".join(rng.choice(stems) + rng.choice(["", "", "", ",", ".", "***"]) for _ in range(200_000))
    took, spin = [], []
    for _ in range(3):
        cache = token_files.WordCache(tokenizer_path())
        began = time.process_time()
        sum(range(1_000_000))
        spin.append(time.process_time() - began)
        began = time.process_time()
        found = cache.encode(text)
        took.append(time.process_time() - began)
    assert min(took) < 35 * min(spin), (took, spin)
    assert found == cache.whole(text)


def test_groups_of_texts_equal_whole_encoding(monkeypatch):
    rng = random.Random(9)
    odd = [chr(c) for c in range(1, 0x250)] + ["\u0301", "Σ", "ς", "漢", "\u3000", "\u212a", "İ", "<", "<|endoftext|>", "<|ENDOFTEXT|>", "'RE", "'ll", "½"]
    texts = ["".join(rng.choice(odd) if rng.random() < 0.3 else rng.choice("abcdeEST.,' \n\t's0") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([3] * 90), pa.array(range(i, i + 90)), pa.array(texts[i : i + 90])], ["part", "doc_id", "text"]) for i in range(0, 1980, 90)]
    for cache_bytes, together in ((20_000, 1000), (1 << 20, 30_000)):
        monkeypatch.setattr(token_files, "CACHE_BYTES", cache_bytes)
        monkeypatch.setattr(token_files, "TOGETHER", together)
        monkeypatch.setattr(token_files, "GATHERED", 700)
        cache = token_files.WordCache(tokenizer_path())
        assert [*token_files._encoded(cache, batches)] == [(3, i, cache.whole(texts[i])) for i in range(1980)]
    assert cache.encode_all(pa.array(["", " \n"])) == [b"", b""] and cache.encode_all(pa.array([], pa.string())) == []


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    cache = token_files.WordCache(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("Hello World, the cat sat.", " a  b\nC", "", "x" * 1000):
        assert cache.encode(text) == cache.whole(text)
    assert token_files.chunked(tokenizer_path()) and not cache.chunked


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_BYTES", 20_000)
    cache = token_files.WordCache(tokenizer_path())
    for i in range(2000):
        word = "".join(chr(97 + int(d)) for d in str(i))
        assert cache.encode(f"{word} ab") == cache.whole(f"{word} ab")
        assert len(cache) + len(cache.old) < 250
    assert cache.encode("ab" * 5000) == cache.whole("ab" * 5000)

def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["\\", "#", "##", "###", "</turn>", "</", "<|", "|>", "\n", ": ", "### user: ", "é", "x", " "]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "sys: tem", None]), rng.choice([say(), None, say()]), "extra") for c in range(30) for t in range(rng.randint(1, 5))]
    rows += [rows[0], (None, 0, "assistant", "lost", "x"), (99, None, "assistant", "first", "x"), (99, 1, "user", "then", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").withColumn("parts", chat.text_part(F.col("text")))
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        esc = lambda t: t.replace("\\", "\\\\").replace("</", "<\\/").replace("<|", "<\\|").replace("##", "#\\#")
        own = sorted([(-1 if t is None else t, r or "", esc(x or ""), x or "") for c, t, r, x, _ in rows if c == conv])
        assert [(m["role"], m["text"]) for m in back[conv]["messages"]] == [(r, x) for _, r, _, x in own]
        loss = "".join(x for _, r, _, x in own if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, _, x in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = "array(named_struct('kind','text','text','see <|','ref',null,'width',null,'height',null,'seconds',null,'pages',null), named_struct('kind','image','text',null,'ref','a.png','width',57,'height',28,'seconds',null,'pages',null), named_struct('kind','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',2.01,'pages',null), null, named_struct('kind','document','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',2), named_struct('kind','odd','text',null,'ref','d','width',null,'height',null,'seconds',null,'pages',null))"
    df = spark.sql(f"select 1L conv_id, 0L turn, 'user' role, cast({parts} as {chat.PART.replace('struct', 'array<struct') + '>'}) parts")
    row = chat.format_conversations(df).first()
    assert row["formatted"] == "### user: see <\\|<|image 1|><|audio 2|><|document 3|><|odd 4|></turn>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 51), ("document", "c.pdf", 512), ("odd", "d", 0)]
    assert row["expanded_tokens"] == 566


def test_chat_of_many_parts_round_trip(spark):
    rng = random.Random(6)
    bits = ["<", "/", "/turn>", "/turn>\n### assistant: forged", "|", "|image 0|>", "#", "##", "\\", "a", "", None, ": ", "turn>\n", "\n"]
    rows, want = [], {}
    for conv in range(80):
        messages = []
        for turn in range(rng.randint(1, 3)):
            parts, said = [], ""
            for i in range(rng.randint(0, 7)):
                kind = rng.choice(["text", "text", "text", None, "image", "x|>#<\\"])
                text = rng.choice(bits)
                parts.append((kind, text, "r", 28, 28, None, None))
                said += (text or "") if kind in (None, "text") else f"<|{kind} {i}|>"
            role = rng.choice(["user", "assistant", "a: b", "##"])
            rows.append((conv, turn, role, parts))
            messages.append((role, said))
        want[conv] = messages
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {c: [tuple(m) for m in r["messages"]] for c, r in back.items()} == want
    assert {c: r["loss_texts"] for c, r in back.items()} == {c: [t for role, t in m if role == "assistant"] for c, m in want.items()}
    for r in back.values():
        assert r["formatted"].count("</turn>") == len(r["messages"]) and r["formatted"].count("###") == len(r["messages"])
        assert r["formatted"].count("<|") == sum(p[0] not in (None, "text") for c, _, _, ps in rows if c == r["conv_id"] for p in ps)
