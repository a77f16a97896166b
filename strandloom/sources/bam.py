"""BAM files as a Spark data source: one partition per range of compressed blocks.

    spark.dataSource.register(BamSource)
    spark.read.format("strandloom_bam").load(path)

A task finds the first block and the first record of its range by itself, so neither an
index nor a pass over the file is needed. Records belong to the range in which they begin.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 8 << 20
SCHEMA = "aln_id long, qname string, flag int, chrom string, t long, cigar string, seq string"

# Fixed values of the format: codes of bases and operations, the fixed part of a record.
_BASES = "=ACMGRSVTWYHKDBN"
_OPERATIONS = "MIDNSHP=X"
_RECORD = struct.Struct("<iiiBBHHHiiii")
_PAIRS = np.array([list((a + b).encode()) for a in _BASES for b in _BASES], np.uint8)
#: Records in a row that have to look right where a range is entered.
CHAIN = 12
_ROWS = 5_000


def open_file(path: str) -> BinaryIO:
    """A file by its path, local or with a scheme that Arrow knows."""
    if "://" not in path:
        return open(path, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _block(f: BinaryIO, at: int) -> tuple[bytes, int] | None:
    """The data of the block at ``at`` and where the next one begins; None at the file's end."""
    f.seek(at)
    head = f.read(12)
    if len(head) < 12:
        return None
    if head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError(f"no block at {at}")
    (extra_size,) = struct.unpack_from("<H", head, 10)
    extra, i, size = f.read(extra_size), 0, None
    while i + 4 <= len(extra):
        (length,) = struct.unpack_from("<H", extra, i + 2)
        if extra[i : i + 2] == b"BC" and length == 2:
            (size,) = struct.unpack_from("<H", extra, i + 4)
        i += 4 + length
    if size is None:
        raise ValueError(f"no block size at {at}")
    rest = f.read(size + 1 - 12 - extra_size)
    if len(rest) < size + 1 - 12 - extra_size:
        raise ValueError(f"the file ends within the block at {at}")
    return zlib.decompress(rest[:-8], -15), at + size + 1


def _first_block(f: BinaryIO, start: int, end: int) -> int | None:
    """The first block that begins within [start, end): one that can be read, as can the next."""
    f.seek(start)
    window, i = f.read(min(end - start, 1 << 17) + 4), -1
    while (i := window.find(b"\x1f\x8b\x08\x04", i + 1)) >= 0:
        if start + i >= end:
            return None
        try:
            _, after = _block(f, start + i)
            _block(f, after)
            return start + i
        except (ValueError, zlib.error, struct.error):
            continue
    return None


class _Stream:
    """Uncompressed data from one block on, block by block."""

    def __init__(self, f: BinaryIO, at: int) -> None:
        self.f, self.next, self.data, self.begins, self.places = f, at, bytearray(), [], []

    def more(self) -> bool:
        got = _block(self.f, self.next)
        if got is None:
            return False
        self.begins.append(len(self.data))
        self.places.append(self.next)
        self.data += got[0]
        self.next = got[1]
        return True

    def need(self, size: int) -> bool:
        while len(self.data) < size:
            if not self.more():
                return False
        return True


def read_header(f: BinaryIO) -> tuple[list[tuple[str, int]], int, int]:
    """Sequences with their lengths, and the block and the place in it where records begin."""
    s = _Stream(f, 0)
    if not s.need(12) or s.data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    (text,) = struct.unpack_from("<i", s.data, 4)
    s.need(12 + text)
    (count,) = struct.unpack_from("<i", s.data, 8 + text)
    at, found = 12 + text, []
    for _ in range(count):
        s.need(at + 4)
        (name,) = struct.unpack_from("<i", s.data, at)
        s.need(at + 8 + name)
        found.append((s.data[at + 4 : at + 3 + name].decode(), struct.unpack_from("<i", s.data, at + 4 + name)[0]))
        at += 8 + name
    # A place at a block's end is one at the beginning of the next.
    i = int(np.searchsorted(s.begins, at, side="right")) - 1
    if at == len(s.data):
        return found, s.next, 0
    return found, s.places[i], at - s.begins[i]


def _looks_right(data: bytearray, at: int, sequences: int) -> int | None:
    """The size of the record at ``at``, if it can be one; 0 where its fixed part isn't all there."""
    if at + 36 > len(data):
        return 0
    size, ref, pos, name, _, _, cigar, _, bases, mate, mate_pos, _ = _RECORD.unpack_from(data, at)
    if not (-1 <= ref < sequences and -1 <= mate < sequences and pos >= -1 and mate_pos >= -1 and name >= 1 and bases >= 0):
        return None
    if size < 32 + name + 4 * cigar + (bases + 1) // 2 + bases or size > 1 << 29:
        return None
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] != 0 or any(not 33 <= c <= 126 for c in text[:-1])):
        return None
    return size + 4


def _first_record(s: _Stream, limit: int, sequences: int) -> int | None:
    """Where the first record of a range begins: a chain of records follows from it."""
    for start in range(limit):
        at, seen = start, 0
        while seen < CHAIN:
            s.need(at + 36 + 256)
            size = _looks_right(s.data, at, sequences)
            if size is None:
                break
            if size == 0:
                if at != len(s.data):  # neither a record nor the end of the file
                    size = None
                break
            at += size
            seen += 1
        if size is not None and (seen or start == len(s.data)):
            return start
    return None


def _cigar(data: bytearray, at: int, count: int) -> str:
    return "".join(f"{x >> 4}{_OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{count}I", data, at)) or "*"


def _long_cigar(data: bytearray, at: int, end: int) -> str | None:
    """The CIGAR of more than 65,535 operations, which stands in a tag."""
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    while at + 3 <= end:
        tag, kind = bytes(data[at : at + 2]), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            at = data.index(0, at) + 1
        elif kind == "B":
            inner, (count,) = chr(data[at]), struct.unpack_from("<i", data, at + 1)
            if tag == b"CG":
                return _cigar(data, at + 5, count)
            at += 5 + count * sizes[inner]
        else:
            at += sizes[kind]
    return None


def _record(data: bytearray, at: int, names: list[str]) -> tuple:
    size, ref, pos, name, _, _, cigar, flag, bases, _, _, _ = _RECORD.unpack_from(data, at)
    i = at + 36 + name
    operations = _cigar(data, i, cigar)
    i += 4 * cigar
    packed = np.frombuffer(bytes(data[i : i + (bases + 1) // 2]), np.uint8)
    if cigar == 2 and operations.startswith(f"{bases}S") and operations.endswith("N"):
        operations = _long_cigar(data, i + (bases + 1) // 2 + bases, at + 4 + size) or operations
    seq = _PAIRS[packed].tobytes()[:bases].decode() or "*"
    return data[at + 36 : at + 35 + name].decode(), flag, names[ref] if ref >= 0 else "*", pos, operations, seq


def read_records(f: BinaryIO, start: int, end: int) -> Iterator[tuple]:
    """Records that begin in blocks within [start, end); the first field is the place in the file."""
    sequences, block, inner = read_header(f)
    names = [n for n, _ in sequences]
    if end <= block:
        return
    enters = start > block
    first = _first_block(f, start, end) if enters else block
    if first is None:
        return
    s = _Stream(f, first)
    while s.next < end and s.more():
        pass
    limit = len(s.data)
    at = _first_record(s, limit, len(names)) if enters else inner
    while at is not None and at < limit and s.need(at + 4):
        (size,) = struct.unpack_from("<i", s.data, at)
        if not s.need(at + 4 + size):
            raise ValueError("the file ends within a record")
        i = int(np.searchsorted(s.begins, at, side="right")) - 1
        yield (s.places[i] << 16) + at - s.begins[i], *_record(s.data, at, names)
        at += 4 + size


@dataclass
class _Range(InputPartition):
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[_Range]:
        with open_file(self.path) as f:
            f.seek(0, 2)
            size = f.tell()
        return [_Range(i, min(i + self.split, size)) for i in range(0, size, self.split)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        with open_file(self.path) as f:
            for r in read_records(f, partition.start, partition.end):
                rows.append(r)
                if len(rows) == _ROWS:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class BamSource(DataSource):
    """Options: ``path`` and ``split``, the bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "strandloom_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))
