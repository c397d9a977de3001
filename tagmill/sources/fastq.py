"""FASTQ as a Spark data source: plain files are split, a record belongs to the part it starts in.

A record is four lines. The only line that starts with an at sign and has a plus line two
lines on is a header (a sequence never starts with a plus), so a part finds its first
record by itself. Gzipped files are one part each and are read as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tagmill.sources.files import expand, store_of

SPLIT = 64 << 20
BATCH = 4096
CHUNK = 1 << 20


def _lines(stream, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """Offset and text of each line."""
    held = b""
    while chunk := stream.read(CHUNK):
        *whole, held = (held + chunk).split(b"\n")
        for line in whole:
            yield at, line.rstrip(b"\r")
            at += len(line) + 1
    if held:
        yield at, held.rstrip(b"\r")


def records(lines: Iterator[tuple[int, bytes]], end: int | None, *, search: bool) -> Iterator[tuple[str, str, str]]:
    """name, seq, qual of the records that start before ``end``; ``search`` looks for the first header."""
    held: list[tuple[int, bytes]] = []
    while True:
        while len(held) < 4 and (line := next(lines, None)) is not None:
            if line[1] or held:  # blank lines between records are skipped
                held.append(line)
        while held and not held[-1][1] and len(held) < 4:
            held.pop()
        if not held:
            return
        if search and not (held[0][1].startswith(b"@") and len(held) > 2 and held[2][1].startswith(b"+")):
            held.pop(0)
            continue
        search = False
        if end is not None and held[0][0] >= end:
            return
        if len(held) < 4 or not held[0][1].startswith(b"@") or not held[2][1].startswith(b"+"):
            raise ValueError(f"no complete record at byte {held[0][0]}")
        yield held[0][1][1:].decode(), held[1][1].decode(), held[3][1].decode()
        held = []


class FastqDataSource(DataSource):
    """``spark.read.format("fastq").load(path)``: name, seq, qual."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "name string, seq string, qual string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqReader(self.options["path"], int(self.options.get("split_bytes", SPLIT)))


class FastqReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in expand(self.path):
            if path.endswith(".gz"):
                out.append(InputPartition((path, 0, None)))
            else:
                out += [InputPartition((path, a, min(a + self.split, size))) for a in range(0, size, self.split)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition):
        if partition.value is None:
            return
        path, start, end = partition.value
        store, inner = store_of(path)
        if end is None:
            with store.open_input_stream(inner, compression="gzip") as stream:
                yield from _batches(records(_lines(stream), None, search=False))
            return
        with store.open_input_file(inner) as stream:
            stream.seek(max(start - 1, 0))
            lines = _lines(stream, max(start - 1, 0))
            if start:
                next(lines, None)  # the line before belongs to another part
            yield from _batches(records(lines, end, search=start > 0))


def _batches(rows: Iterator[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["name", "seq", "qual"])
