"""Benchmark decontamination by hashed n-gram windows.

Words are maximal runs of ASCII digits, ASCII letters (lower-cased) and all characters
from U+0080. The items' windows of ``n`` words (an item of fewer words is one window)
form a hash set that is broadcast in blocks of a fixed size: the usual benchmark is one
block, a larger one costs one more scan of the documents for each block. Documents are
scanned once a block, without a shuffle: words become ids of the block's vocabulary,
window hashes are looked up, and hits are verified word by word.

With several blocks each document carries its hits so far from scan to scan, always of
the original text, so the blocks together decide as one would.

Defined cases: null or wordless texts have no words, no hits; null items and items
without words have no window; repeated items count once by id, different texts under
one id all count; repeated documents each give a row; a null item id is named "null"; a
very long text is one row, with the memory of its words; empty tables give no rows or no
hits; other columns, whatever their names, are kept by ``remove`` and ignored by ``scan``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tagmill.llm.common import lean, text_batches
from tagmill.llm.filters import free_name

N = 10
#: Bytes of item text in a broadcast block; its windows take about ten times that.
BLOCK_BYTES = 8 << 20
_KEEP = bytes(c if (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80) else 0x20 for c in range(256))
RUNS = ArrayType(ArrayType(IntegerType()))


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 bytes."""
    return (text or "").encode().lower().translate(_KEEP).split()


class Windows:
    """Hash set of a block's windows: a window is its place in the items' words, in order of hashes, by length."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.names, texts = [name for name, _ in items], []
        for _, text in items:
            own = words(text)
            texts.append(np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for w in own), np.int32, len(own)))
        length = np.array([len(t) for t in texts], np.int64)
        self.words = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        self.starts = np.cumsum(length) - length
        self.by_size = {}
        for size in sorted({min(n, x) for x in length.tolist() if x}):
            own = [t for t in range(len(texts)) if min(n, length[t]) == size]
            at = np.concatenate([self.starts[t] + np.arange(length[t] - size + 1) for t in own])
            hashes = np.concatenate([window_hashes(texts[t], size) for t in own])
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = (hashes[order], at[order])

    @classmethod
    def of(cls, state: dict) -> "Windows":
        """From the plain state that is broadcast."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def search(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words of a text are hit, and the items that have a window in it."""
        ids = np.fromiter((self.vocab.get(w, 0) for w in found), np.int32, len(found))
        edge, items = np.zeros(len(ids) + 1, np.int32), set()
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, (hashes, at) in self.by_size.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            own = window_hashes(ids, size)[starts]
            first, last = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for s, lo, hi in zip(*(x[first < last].tolist() for x in (starts, first, last)), strict=True):
                same = at[lo:hi][(self.words[at[lo:hi, None] + np.arange(size)] == ids[s : s + size]).all(axis=1)]
                if len(same):
                    edge[s] += 1
                    edge[s + size] -= 1
                    items.update(self.names[t] for t in np.unique(np.searchsorted(self.starts, same, "right") - 1).tolist())
        return np.cumsum(edge[:-1]) > 0, items


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each window of ``size`` word ids."""
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + len(out)].astype(np.uint64)
    return out


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the maximal true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many blocks of about ``block_bytes`` the items make, and the blocks, fetched one at a time."""
    named = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    return n, ([tuple(r) for r in named.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == b).collect()] for b in range(n))


def _searched(rows: DataFrame, items: DataFrame, text: str, hits: str, named: str, n: int, item: str, item_text: str, block_bytes: int) -> DataFrame:
    """``rows`` with two more columns: runs of hit words (``hits``) and the items found (``named``), of all blocks."""
    spark = rows.sparkSession
    text_batches(spark)
    at_text = rows.columns.index(text)
    schema = StructType([*rows.schema.fields, StructField(hits, RUNS), StructField(named, ArrayType(StringType()))])
    out = rows
    for k, block in enumerate(_blocks(items, item, item_text, block_bytes)[1]):
        shared = spark.sparkContext.broadcast(vars(Windows(block, n)))

        def search(batches, shared=shared, first=k == 0):
            windows = Windows.of(shared.value)
            for batch in batches:
                columns = batch.columns if first else batch.columns[:-2]
                before = [([], [])] * batch.num_rows if first else list(zip(batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist(), strict=True))
                hit, names = [], []
                for value, (told, known) in zip(columns[at_text], before, strict=True):
                    found = words(value.as_py())
                    mask, own = windows.search(found)
                    if own:
                        for a, b in told:
                            mask[a:b] = True
                        told, known = runs(mask), sorted(own.union(known))
                    hit.append(told)
                    names.append(known)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hit, pa.list_(pa.list_(pa.int32()))), pa.array(names, pa.list_(pa.string()))], schema.names)

        out = out.mapInArrow(lean(search), schema)
    return out


def scan(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, runs of hit words and the items hit, a row per document."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = _searched(rows, items, "text", "hit_runs", "items", n, item, item_text, block_bytes)

    def count(batches):
        for batch in batches:
            n_words = pa.array([len(words(t.as_py())) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_words, batch.column(2), batch.column(3)], ["doc_id", "n_words", "hit_runs", "items"])

    return found.mapInArrow(count, "doc_id long, n_words long, hit_runs array<array<int>>, items array<string>")


def report(scanned: DataFrame) -> DataFrame:
    """Counts and item digest of a scan."""
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return scanned.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_runs") > 0).alias("contaminated"))


def remove(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, drop_share: float = 0.5, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Documents without the hit spans; those whose hit words reach ``drop_share`` go whole.

    Texts without a hit stay as they are, byte for byte. A removed span reaches from its
    first word to the end of its last one.
    """
    names, at_text = docs.columns, docs.columns.index(text)
    hits, named = free_name("hits_", docs), free_name("items_", docs)
    found = _searched(docs, items, text, hits, named, n, item, item_text, block_bytes)

    def cut(batches):
        import regex

        pattern = regex.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")
        for batch in batches:
            columns, told = batch.columns[:-2], batch.columns[-2].to_pylist()
            keep, texts = [], []
            for value, own in zip(columns[at_text], told, strict=True):
                value = value.as_py()
                if own:
                    spans = [m.span() for m in pattern.finditer(value)]
                    keep.append(sum(b - a for a, b in own) < drop_share * len(spans))
                    ends, pieces = 0, []
                    for a, b in own:
                        pieces.append(value[ends : spans[a][0]])
                        ends = spans[b - 1][1]
                    value = "".join([*pieces, value[ends:]])
                else:
                    keep.append(True)
                texts.append(value)
            columns[at_text] = pa.array(texts, columns[at_text].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(cut, docs.schema)
