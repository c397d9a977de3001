"""BAM as a Spark data source in plain Python: BGZF blocks and records by zlib and struct.

The path may be a list, a folder or a pattern. Each file is a partition: records have no
mark that tells where one starts, so a file without an index cannot be entered midway.
``id`` is the file's number above the record's (ID_BITS bits), so it is unique over all
files of a read. ``bam_fields`` prunes columns, ``tag_whitelist`` picks tags.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tagmill.sources.files import expand, store_of

#: Bits of an id that hold a record's number in its file.
ID_BITS = 40
_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
FIELDS = {"id": "bigint", "qname": "string", "flag": "int", "chrom": "string", "pos": "int", "mapq": "int", "cigar": "string", "seq": "string", "qual": "binary", "mate_chrom": "string", "mate_pos": "int", "tlen": "int", "is_read1": "boolean", "is_read2": "boolean", "is_reverse": "boolean", "tags": "map<string,string>"}
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FORMATS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def inflate(stream) -> Iterator[bytes]:
    """Contents of the BGZF blocks of a binary stream."""
    while head := stream.read(18):
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        size = struct.unpack_from("<H", head, 16)[0] + 1
        body = stream.read(size - 18)
        yield zlib.decompress(body[:-8], -15)


class _Bytes:
    """Reads exact numbers of bytes from an iterator of chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            chunk = next(self.chunks, None)
            if chunk is None:
                break
            parts.append(chunk)
            have += len(chunk)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]


def _tags(data: bytes) -> dict[str, str]:
    out, i = {}, 0
    while i + 3 <= len(data):
        name, kind = data[i : i + 2].decode(), chr(data[i + 2])
        i += 3
        if kind in "ZH":
            end = data.index(0, i)
            out[name], i = data[i:end].decode(), end + 1
        elif kind == "A":
            out[name], i = chr(data[i]), i + 1
        elif kind == "B":
            sub, n = chr(data[i]), struct.unpack_from("<i", data, i + 1)[0]
            values = struct.unpack_from(f"<{n}{_FORMATS[sub]}", data, i + 5)
            out[name], i = ",".join(map(str, values)), i + 5 + n * _SIZES[sub]
        else:
            out[name], i = str(struct.unpack_from(f"<{_FORMATS[kind]}", data, i)[0]), i + _SIZES[kind]
    return out


def records(stream) -> Iterator[dict]:
    """Alignments of a BAM stream."""
    source = _Bytes(inflate(stream))
    if source.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    source.take(struct.unpack("<i", source.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", source.take(4))[0]):
        names.append(source.take(struct.unpack("<i", source.take(4))[0])[:-1].decode())
        source.take(4)
    number = 0
    while head := source.take(4):
        data = source.take(struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate_ref, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32
        qname = data[at : at + l_name - 1].decode()
        at += l_name
        cigar = "".join(f"{c >> 4}{_OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", data, at)) or None
        at += 4 * n_cigar
        packed = data[at : at + (l_seq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq] or None
        at += len(packed)
        qual = data[at : at + l_seq]
        chrom = names[ref] if ref >= 0 else None
        yield {
            "id": number, "qname": qname, "flag": flag, "chrom": chrom, "pos": pos, "mapq": mapq, "cigar": cigar, "seq": seq,
            "qual": None if qual[:1] in (b"", b"\xff") else qual, "mate_chrom": names[mate_ref] if mate_ref >= 0 else None, "mate_pos": mate_pos, "tlen": tlen,
            "is_read1": bool(flag & 64), "is_read2": bool(flag & 128), "is_reverse": bool(flag & 16), "tags": _tags(data[at + l_seq :]),
        }
        number += 1


class BamDataSource(DataSource):
    """``spark.read.format("bam").option("path", ...)``; options bam_fields and tag_whitelist are comma lists."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def _fields(self) -> list[str]:
        return [f.strip() for f in self.options.get("bam_fields", ",".join(FIELDS)).split(",")]

    def _wanted(self) -> list[str]:
        return [t.strip() for t in self.options.get("tag_whitelist", "").split(",") if t.strip()]

    def schema(self) -> str:
        return ", ".join([f"`{f}` {FIELDS[f]}" for f in self._fields()] + [f"`{t}` string" for t in self._wanted()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return BamReader(self.options["path"], self._fields(), self._wanted())


class BamReader(DataSourceReader):
    def __init__(self, path: str, fields: list[str], wanted: list[str]):
        self.path, self.fields, self.wanted = path, fields, wanted

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, path)) for i, (path, _) in enumerate(expand(self.path, ".bam"))]

    def read(self, partition: InputPartition):
        number, path = partition.value
        store, inner = store_of(path)
        with store.open_input_stream(inner, compression=None) as stream:
            for r in records(stream):
                if r["id"] >> ID_BITS:
                    raise ValueError(f"over 2**{ID_BITS} records in {path}")
                r["id"] |= number << ID_BITS
                yield tuple([r[f] for f in self.fields] + [r["tags"].get(t) for t in self.wanted])
