"""Capture files as tables: pcap (either byte order, micro- or nanoseconds) and pcapng.

``read`` goes through Spark's own file reader, so it opens whatever Spark can open and
spreads files over tasks (a file must be under 2 GB there). ``PcapSource`` is a data source,
``spark.read.format("pcap")`` and ``readStream``, for folders that all executors share; it
reads files of any size packet by packet.

``ord`` is the arrival order over all files: the number of the file in its upper bits, that of
the packet in its lower ``PACKET_BITS``. So it never repeats, and flows run on from one file to
the next. ``file`` is the name.
"""

from __future__ import annotations

import glob
import io
import os
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from netlens import catalog

SCHEMA = "ord long, ts_us long, dlt string, caplen int, pkt binary, file string"
PACKET_BITS = 36


def parse(data: bytes | BinaryIO) -> Iterator[tuple[int, str | None, int, bytes]]:
    """(ts_us, link type, captured length, bytes) of each packet, read one after the other; a damaged tail ends the file."""
    f = io.BytesIO(data) if isinstance(data, bytes | bytearray | memoryview) else data
    magic = f.read(4)
    if magic == b"\x0a\x0d\x0d\x0a":
        yield from _ng(f)
        return
    kinds = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
    if magic not in kinds:
        raise ValueError("not a capture file")
    end, per_us = kinds[magic]
    head = f.read(20)
    if len(head) < 20:
        return
    name = catalog.DLT.get(struct.unpack_from(f"{end}I", head, 16)[0] & 0x0FFFFFFF)
    record = struct.Struct(f"{end}IIII")
    while len(head := f.read(16)) == 16:
        sec, frac, n, _ = record.unpack(head)
        data = f.read(n)
        if len(data) < n:
            return
        yield sec * 1_000_000 + frac // per_us, name, n, data


def _ng(f: BinaryIO) -> Iterator[tuple[int, str | None, int, bytes]]:
    """Blocks of a pcapng file whose first four bytes have been read."""
    end, links, kind = "<", [], b"\x0a\x0d\x0d\x0a"
    while len(kind) == 4:
        raw = f.read(4)
        if kind == b"\x0a\x0d\x0d\x0a":
            order = f.read(4)
            end, links = "<" if order == b"\x4d\x3c\x2b\x1a" else ">", []
        else:
            order = b""
        if len(raw) < 4:
            return
        size, code = struct.unpack(f"{end}I", raw)[0], struct.unpack(f"{end}I", kind)[0]
        if size < 12:
            return
        b = kind + raw + order + f.read(size - 8 - len(order))
        if len(b) < size:
            return
        if code == 1:
            link, resolution, o = struct.unpack_from(f"{end}H", b, 8)[0], 6, 16
            while o + 4 <= size - 4:
                option, n = struct.unpack_from(f"{end}HH", b, o)
                if option == 0:
                    break
                if option == 9:
                    resolution = b[o + 4]
                o += 4 + n + -n % 4
            links.append((catalog.DLT.get(link), 2 ** (resolution & 0x7F) if resolution & 0x80 else 10**resolution))
        elif code == 6 and size >= 32:
            which, high, low, n, _ = struct.unpack_from(f"{end}IIIII", b, 8)
            name, unit = links[which] if which < len(links) else (None, 10**6)
            yield (high << 32 | low) * 1_000_000 // unit, name, n, b[28 : 28 + n]
        elif code == 3 and links:
            n = min(struct.unpack_from(f"{end}I", b, 8)[0], size - 16)
            yield 0, links[0][0], n, b[12 : 12 + n]
        kind = f.read(4)


def _record(ts: int, b: bytes) -> bytes:
    return struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(b), len(b)) + b


def build(packets: list[tuple[int, bytes]], link: int = 1) -> bytes:
    """A pcap file of (ts_us, bytes)."""
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, link) + b"".join(_record(ts, b) for ts, b in packets)


def _batch(rows: list[tuple], file: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([file] * len(rows), pa.string())], ["ord", "ts_us", "dlt", "caplen", "pkt", "file"])


def _batches(data: bytes | BinaryIO, number: int, file: str) -> Iterator[pa.RecordBatch]:
    """Packets of a file in batches of bounded rows and bytes; ``ord`` has the number of the file above that of the packet."""
    rows, size = [], 0
    for i, r in enumerate(parse(data)):
        rows.append((number << PACKET_BITS | i, *r))
        size += r[2] + 64
        if len(rows) == 4096 or size > 4 << 20:
            yield _batch(rows, file)
            rows, size = [], 0
    if rows:
        yield _batch(rows, file)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all capture files under a path, opened by Spark's own reader; files are numbered in the order of their names."""
    files = spark.read.format("binaryFile").load(path)
    numbers = {r.path: k for k, r in enumerate(sorted(files.select("path").distinct().collect()))}  # names only, which the driver lists anyway
    shared = spark.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batches(content, shared.value[name], name)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _listed(path: str) -> list[str]:
    """Capture files of a folder or pattern; hidden ones and those still being written (by Spark's convention) are left out."""
    names = glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)
    return sorted(n for n in names if os.path.isfile(n) and not os.path.basename(n).startswith(("_", ".")))


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


def _opened(partition: _File) -> Iterator[pa.RecordBatch]:
    if partition.path:
        with open(partition.path, "rb") as f:  # buffered: a file of any size is read packet by packet
            yield from _batches(f, partition.number, partition.path)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_File(n, k) for k, n in enumerate(_listed(self.path))] or [_File("", 0)]

    def read(self, partition):
        yield from _opened(partition)


class _Stream(DataSourceStreamReader):
    """New files of a folder, each a partition, in the order in which they came there.

    Files are ordered by the time of their last change of inode (which moving a file into the
    folder sets, whatever its name and age) and name, so new files come last and an offset is
    a count and the name of the last file. If files were removed or changed, the name of the
    last one no longer agrees, and the stream stops with an error instead of losing packets.
    """

    def __init__(self, path: str):
        self.path = path

    def _names(self) -> list[str]:
        return [n for _, n in sorted((os.stat(n).st_ctime_ns, n) for n in _listed(self.path))]

    def initialOffset(self):
        return {"files": 0, "last": ""}

    def latestOffset(self):
        names = self._names()
        return {"files": len(names), "last": names[-1] if names else ""}

    def partitions(self, start, end):
        names = self._names()
        for offset in (start, end):
            if offset["files"] and names[offset["files"] - 1 : offset["files"]] != [offset["last"]]:
                raise ValueError(f"files of {self.path} were removed or changed while they were streamed")
        return [_File(names[k], k) for k in range(start["files"], end["files"])]

    def read(self, partition):
        yield from _opened(partition)

    def commit(self, end):
        pass


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str, name: str):
        self.temporary, self.name = temporary, name


class _Writer(DataSourceArrowWriter):
    """One file per partition, named in the order of partitions; files appear when all are written."""

    def __init__(self, path: str, link: int, overwrite: bool):
        self.path, self.link, self.overwrite = path, link, overwrite
        os.makedirs(path, exist_ok=True)
        self.first = 0 if overwrite else len(_listed(path))  # files that are added come after those that are there

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        number = TaskContext.get().partitionId()
        temporary = os.path.join(self.path, f".part-{number:05d}-{uuid.uuid4().hex}.pcap")
        with open(temporary, "wb") as f:
            f.write(build([], self.link))
            for batch in iterator:
                times, packets = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ts_us", "pkt"))
                for ts, b in zip(times, packets, strict=True):
                    f.write(_record(ts or 0, b or b""))
        return _Written(temporary, f"part-{self.first + number:05d}.pcap")

    def commit(self, messages) -> None:
        if self.overwrite:
            for n in _listed(self.path):
                os.remove(n)
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.name):
            os.replace(m.temporary, os.path.join(self.path, m.name))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class PcapSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _Stream(self.options["path"])

    def writer(self, schema, overwrite):
        """Packets (ts_us, pkt, ...) of one link type, given by number as option ``link`` (1: Ethernet), in the order of the partition."""
        return _Writer(self.options["path"], int(self.options.get("link", "1")), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)
