"""Token ids as fixed-width bit-packed blocks.

A shard is a range of documents in ascending id order; its file is a Parquet table of
blocks, written by Spark's committer (so a lost task leaves nothing) to the cluster's
shared folder. A block holds ``width`` bits an id, least significant bit first, where
``width`` is the least that holds the vocabulary, with the place of its first id in
the shard and, as arrays, the ids and token counts of the documents that start in it.
Documents never straddle blocks; a block closes at ``BLOCK_IDS`` ids, so a reader finds
id t by the block offsets and the bit t * width inside, without reading what is before.

Where the tokenizer's normaliser, pre-tokenizer and model are the known ones (CHUNKED) for
which encoding white-space-free chunks apart gives the ids of the whole text, texts are
split in groups of TOGETHER bytes; each distinct chunk of a group is cut into words once,
words not remembered from groups before go through the tokenizer's merges together, and
the ids are put in place by number. With any other tokenizer every text is encoded whole.

Defined cases: null text is empty and holds the end id only; a very long text is one
block of its own, with the memory that takes; documents go by id (nulls
first), then text hash, repeated rows all stay; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm.common import arrow_rows, kept, lean, settle_table, shared_folder

END_ID = 2
BLOCK_IDS = 1 << 17
#: Bytes of words and their ids that a worker remembers in each of two generations, about.
CACHE_BYTES = 12 << 20
#: Bytes of an entry besides its characters and ids.
ENTRY_BYTES = 180
#: New words that are encoded at once.
WORDS = 1 << 14
#: Bytes of texts whose chunks are encoded together, about, and chunks whose ids are put in place at once.
TOGETHER, GATHERED = 8 << 20, 1 << 17
#: Bytes of text a shard has, about.
SHARD_BYTES = 32 << 20
BLOCKS = "part int, block int, first long, n_ids long, width int, doc_ids array<long>, counts array<int>, packed binary"


def bit_width(vocabulary: int) -> int:
    """Least bits that hold ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids at ``width`` bits each, least significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for i in range(0, len(ids), 1 << 15):  # a multiple of eight ids, so that pieces end on bytes
        bits = (ids[i : i + (1 << 15), None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unpack(packed: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, reading only the bytes that hold them."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", stop - start, start * width // 8).astype(np.uint32)
    first = start * width
    raw = np.frombuffer(packed, np.uint8, -(-stop * width // 8) - first // 8, first // 8)
    bits = np.unpackbits(raw, bitorder="little")[first % 8 :][: (stop - start) * width].reshape(-1, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


#: The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on.
_PRINTABLE = [b for r in ((0x21, 0x7F), (0xA1, 0xAD), (0xAE, 0x100)) for b in range(*r)]
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


#: The parts of a tokenizer for which chunks between white space can be encoded apart.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: And of its model; added tokens have to hold a "<" and no white space, and to be found before normalising.
CHUNKED_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def chunked(path: str) -> bool:
    """Whether chunks between white space can be encoded apart by the tokenizer of a file."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    added = [t["content"] for t in told["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or "<" not in t["content"] or t["content"].split() != [t["content"]]]
    return not added and all(told[k] == v for k, v in CHUNKED.items()) and all(told["model"].get(k) == v for k, v in CHUNKED_MODEL.items())


#: Words of chunks below U+0250 in lower case (some have theirs above), as the pattern of CHUNKED finds them there.
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u02af\u2c65\u2c66", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^ \n{_LETTERS}{_DIGITS}]+")
#: Chunks that are encoded whole: "<" may begin an added token, the others may change their form when normalised.
_OTHER = re.compile("[<\u0130\u0250-\U0010ffff]")
#: Bytes in the byte-level alphabet; blanks and line ends stay between words.
_BYTES = "".join(chr(b if chr(b) in " \n" else _ALPHABET.get(b, b)) for b in range(256))


class WordCache(dict):
    """Ids of words, as little-endian 32-bit bytes, encoded on first sight.

    Two generations of words are held; with the older one its words are forgotten.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores
        from tokenizers import Tokenizer

        self.path, self.tokenizer, self.old, self.held = path, Tokenizer.from_file(path), {}, 0
        self.chunked = chunked(path)
        if self.chunked:
            with open(path, encoding="utf-8") as file:
                told = json.load(file)
            # the same merges, for words given in the byte-level alphabet
            self.merges = Tokenizer.from_str(json.dumps(told | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            vocabulary = told["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # only the last id of a word has the suffix
            self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @staticmethod
    def of_worker(path: str) -> "WordCache":
        """The cache that this Python worker keeps from task to task."""
        held = kept("words", lambda: {})
        if path not in held:
            held.clear()
            held[path] = WordCache(path)
        return held[path]

    def known(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words, and of chunks that go whole."""
        out = {word: ids for seen in (self, self.old) for word in words & seen.keys() if (ids := seen[word])}
        new = list(words - out.keys())
        for at in range(0, len(new), WORDS):
            part = {word: self.whole(word) for word in new[at : at + WORDS] if _OTHER.search(word)}
            plain = [word for word in new[at : at + WORDS] if word not in part]
            part.update(zip(plain, self._merged(plain), strict=True))
            out |= part
            cost = sum(map(len, part.values())) + 2 * sum(map(len, part)) + ENTRY_BYTES * len(part)
            if self.held + cost > CACHE_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            if cost <= CACHE_BYTES:  # texts without blanks are no words to remember
                self.update(part)
                self.held += cost
        return out

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words, which the tokenizer neither changes nor splits."""
        joined = codecs.charmap_decode(" ".join(words).encode(), "strict", _BYTES)[0]
        ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = [0, *(4 * np.flatnonzero(self.last[ids]) + 4).tolist()]
        ids = ids.tobytes()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts. The tokenizer drops white space and splits at it, so chunks are encoded apart, each once.

        Arrow also splits at U+001C to U+001F, which the tokenizer doesn't; such texts are encoded whole.
        """
        if not self.chunked:
            return [self.whole(text) for text in texts.to_pylist()]
        apart = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        chunks, codes, at = self._split(pc.if_else(apart, "", texts))
        ids, starts, lengths = self._chunks(chunks)
        del chunks
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        found = np.empty(ends[-1], "<u4")
        for i in range(0, len(codes), GATHERED):
            code = codes[i : i + GATHERED]
            n = lengths[code]
            found[ends[i] : ends[i + len(code)]] = ids[np.repeat(starts[code] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        ends = ends[at].tolist()
        out = [found[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.whole(texts[i].as_py())
        return out

    @staticmethod
    def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct chunks, their numbers in order, and where those of each text begin (and the last end)."""
        lower = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))  # the tokenizer lower-cases, but for its added tokens
        split = pc.utf8_split_whitespace(lower)
        chunks = split.flatten().dictionary_encode()
        return chunks.dictionary, chunks.indices.to_numpy(), split.offsets.to_numpy()

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks without white space, and where those of each begin and how many there are."""
        other = pc.match_substring_regex(chunks, _OTHER.pattern)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], pc.if_else(other, "", chunks)), "\n")[0].as_py()
        lines = _WORD.sub(r"\g<0> ", joined.lower())
        words, more, other = lines.split(), chunks.filter(other).to_pylist(), other.to_numpy(zero_copy_only=False)
        known = self.known({*words, *more})
        found = list(map(known.__getitem__, words + more))
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        # words of each line, of which the last has no line end
        line = np.frombuffer(f"{lines}\n".encode(), np.uint8)
        first = np.concatenate([[0], np.cumsum(line == ord(" "))[line == ord("\n")]])[: len(chunks) + 1]
        last = first[1:].copy()
        first = first[:-1]
        first[other] = len(words) + np.arange(len(more))
        last[other] = first[other] + 1
        return np.frombuffer(b"".join(found), "<u4"), ends[first], ends[last] - ends[first]


def _encoded(cache: WordCache, batches):
    """Part, id and ids of each document of Arrow batches."""

    def encode():
        part, name, text = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
        return zip(part.to_pylist(), name.to_pylist(), cache.encode_all(text), strict=True)

    held, size = [], 0
    for batch in batches:
        if held and size + batch.column(2).nbytes > TOGETHER:
            yield from encode()
            held, size = [], 0
        held.append(batch)
        size += batch.column(2).nbytes
    if held:
        yield from encode()


def write(docs: DataFrame, folder: str, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", vocabulary: int, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode, close each document with ``end_id`` and write the shards of ``docs`` to ``folder``."""
    width = bit_width(max(vocabulary, end_id + 1))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def encode(batches):
        cache, part, block, first = WordCache.of_worker(tokenizer_path), None, 0, 0
        ids, names, counts, held = [], [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def close():
            packed = pack(np.frombuffer(b"".join(ids), "<u4"), width)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([width], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([packed], pa.binary())],
                ["part", "block", "first", "n_ids", "width", "doc_ids", "counts", "packed"],
            )

        for p, name, own in _encoded(cache, batches):
            part = p
            ids += own, end
            names.append(name)
            counts.append(len(own) // 4 + 1)
            held += len(own) // 4 + 1
            if held >= BLOCK_IDS:
                yield close()
                block, first = block + 1, first + held
                ids, names, counts, held = [], [], [], 0
        if names:
            yield close()

    with arrow_rows(docs.sparkSession):
        rows.mapInArrow(lean(encode, keep="words"), BLOCKS).write.parquet(folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """part, n_ids and the ids of all parts before it (``base``)."""
    blocks = spark.read.schema(BLOCKS).parquet(folder).select("part", "n_ids")
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row a shard
    base, out = 0, []
    for part, n in parts:
        out.append((part, n, base))
        base += n
    return spark.createDataFrame(out, "part int, n_ids long, base long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of ``folder``."""
    base = manifest(spark, folder).select("part", "base")
    blocks = spark.read.schema(BLOCKS).parquet(folder).join(F.broadcast(base), "part").select("base", "first", "width", "doc_ids", "counts", "packed")

    def check(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(row["counts"])
                ids = unpack(row["packed"], row["width"], 0, int(ends[-1])).astype("<u4")
                starts = ends - row["counts"]
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"] + row["first"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # written at once, as only few blocks may be in a batch
    with arrow_rows(spark, 8):
        return settle_table(blocks.mapInArrow(lean(check), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_ids(spark: SparkSession, folder: str, part: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard by random access: only blocks that hold them are read."""
    rows = spark.read.schema(BLOCKS).parquet(folder).where((F.col("part") == part) & (F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start)).orderBy("first").collect()
    pieces = [unpack(r["packed"], r["width"], max(0, start - r["first"]), min(r["n_ids"], stop - r["first"])) for r in rows]
    return np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
