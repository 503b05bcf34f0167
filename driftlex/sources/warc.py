"""Records of WARC and WET archives, gzipped or not, as a Python data source.

A partition is a range of an archive's bytes. It has the records whose gzip
member, or without compression whose head, begins in the range: a reader looks
for the first such place behind the range's start and goes on until one lies
behind its end. So a large archive is read by many tasks, and a task holds no
more than a record at a time. Files are opened through Arrow's file systems.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftlex.functions import text as T

SCHEMA = "file string, rec_type string, uri string, lang string, content_type string, payload string"
_ARROW = pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")])
#: Bytes of a partition, of a read, and of rows that are handed on at once.
SPLIT_BYTES, READ_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 4 << 20
GZIP = b"\x1f\x8b\x08"
HEAD = re.compile(rb"WARC/[0-9.]+\r?\n")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there."""
    return pafs.FileSystem.from_uri(path) if re.match("[a-z][a-z0-9+.-]+:", path) else (pafs.LocalFileSystem(), path)


class _Member(io.RawIOBase):
    """What one gzip member holds; ``end`` is the place behind it in the file, once it is read up."""

    def __init__(self, file, at: int):
        self.file, self.at, self.end = file, at, None
        self.inflate, self.ready = zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.ready and self.end is None:
            self.file.seek(self.at)
            raw = self.inflate.unconsumed_tail or self.file.read(READ_BYTES)
            if not self.inflate.unconsumed_tail:
                self.at += len(raw)
            if not raw:
                raise EOFError("a gzip member is cut off")
            self.ready = self.inflate.decompress(raw, READ_BYTES)
            if self.inflate.eof:
                self.end = self.at - len(self.inflate.unused_data)
        n = min(len(into), len(self.ready))
        into[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def _is_member(file, at: int) -> bool:
    """Whether a gzip member that holds a record begins at a place, and not just bytes that look like one."""
    file.seek(at)
    try:
        return zlib.decompressobj(31).decompress(file.read(4096), 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _is_head(file, at: int) -> bool:
    """Whether a record begins at a place: a head, and behind its payload another one or the file's end."""
    file.seek(at)
    if not HEAD.match(file.read(32)):
        return False
    file.seek(at)
    head, size = _head(file)
    if "warc-type" not in head:
        return False
    file.seek(file.tell() + size)
    rest = file.read(64).lstrip(b"\r\n")
    return not rest or HEAD.match(rest) is not None


def _next(file, at: int, zipped: bool, size: int) -> int | None:
    """The first place from ``at`` on where a record begins."""
    mark, there = (GZIP, _is_member) if zipped else (b"WARC/", _is_head)
    while at < size:
        file.seek(at)
        raw = file.read(READ_BYTES + len(mark) - 1)
        i = raw.find(mark)
        while i >= 0:
            if there(file, at + i):
                return at + i
            i = raw.find(mark, i + 1)
        at += READ_BYTES
    return None


def _head(stream) -> tuple[dict[str, str], int]:
    """Headers of the record that the stream stands at, and the length of its payload."""
    head: dict[str, str] = {}
    stream.readline()
    while line := stream.readline().strip():
        k, _, v = line.decode("utf-8", "replace").partition(":")
        head[k.strip().lower()] = v.strip()
    return head, int(head.get("content-length") or 0)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of the records of a stream of bytes that can be peeked into."""
    while True:
        while stream.peek(1)[:1] in (b"\r", b"\n"):
            stream.read(1)
        if not stream.peek(1):
            return
        head, size = _head(stream)
        yield head, stream.read(size)


def _http(payload: bytes) -> tuple[str, bytes]:
    head, _, body = payload.partition(b"\r\n\r\n")
    kind = next((x.partition(b":")[2].strip().decode("latin-1") for x in head.split(b"\r\n") if x.lower().startswith(b"content-type:")), "")
    return kind, body


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    size: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        """Ranges of the files of a folder, of one file, or of those that a pattern in the last part of the path names."""
        fs, path = _opened(self.path)
        if any(c in path for c in "*?"):
            folder, _, name = path.rpartition("/")
            fits = re.compile(re.escape(name).replace(r"\*", ".*").replace(r"\?", "."))
            found = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if fits.fullmatch(f.base_name)]
        else:
            one = fs.get_file_info(path)
            if one.type == pafs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            found = [one] if one.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        head = self.path[: len(self.path) - len(path)]
        own = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))
        return [Range(head + p, a, min(a + self.split, n), n) for p, n in own for a in range(0, n, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, path = _opened(partition.file)
        rows: list[tuple] = []
        held = 0
        with fs.open_input_file(path) as native, io.BufferedReader(native, READ_BYTES) as file:
            for head, payload in self._records(file, partition):
                kind, content = head.get("warc-type", ""), head.get("content-type", "")
                if kind == "response":
                    content, payload = _http(payload)
                rows.append((partition.file, kind, head.get("warc-target-uri"), head.get("warc-identified-content-language"), content, payload.decode("utf-8", "replace")))
                held += len(payload)
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=_ARROW)

    @staticmethod
    def _records(file, own: Range) -> Iterator[tuple[dict[str, str], bytes]]:
        zipped = file.read(2) == GZIP[:2]
        at = _next(file, own.start, zipped, own.size)
        while at is not None and at < own.end:
            if zipped:
                member = _Member(file, at)
                yield from records(io.BufferedReader(member, READ_BYTES))
                at = _next(file, member.end, True, own.size) if member.end is not None else None
            else:
                file.seek(at)
                head, size = _head(file)
                body = file.tell()
                yield head, file.read(size)
                at = _next(file, body + size, False, own.size)


class ArchiveSource(DataSource):
    """``spark.read.format("warc").load(path)``; the option ``split`` has the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))


def read_archives(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """One row for each record of a file, a folder or a pattern; archives are read in ranges of ``split`` bytes."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("warc").option("split", split).load(path)


def write_archives(pages: DataFrame, path: str, uri: Column, payload: Column, kind: str = "response", content_type: str = "text/html") -> None:
    """Rows as archives of gzip members, one a task, in a new folder; a response has an HTTP head."""
    rows = pages.select(uri.cast("string").alias("uri"), payload.cast("string").alias("payload"))

    def run(batches):
        from pyspark import TaskContext

        fs, folder = _opened(path)
        task = TaskContext.get()
        name, n = f"{folder}/part-{task.partitionId():05d}.warc.gz", 0
        held = f"{folder}/.part-{task.partitionId():05d}-{task.attemptNumber()}"
        with fs.open_output_stream(held, compression=None) as out:
            for batch in batches:
                for u, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    body = (text or "").encode()
                    if kind == "response":
                        body = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\n\r\n".encode() + body
                    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {u or ''}\r\nContent-Type: {'application/http' if kind == 'response' else content_type}\r\nContent-Length: {len(body)}\r\n\r\n"
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(squeeze.compress(head.encode() + body + b"\r\n\r\n") + squeeze.flush())
                    n += 1
        fs.move(held, name)  # whole or not at all, whichever attempt ends
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])

    fs, folder = _opened(path)
    fs.create_dir(folder)
    rows.mapInArrow(run, "name string, n long").agg(F.sum("n")).collect()


def english_text(rows: DataFrame) -> DataFrame:
    """Extracted texts that are not blank, in English or of no named language."""
    lang = F.col("lang").isNull() | F.array_contains(F.split(F.regexp_replace(F.lower("lang"), " ", ""), ","), "eng")
    return rows.where((F.col("rec_type") == "conversion") & lang & (T.clean("payload") != ""))


def page_text(content_type: Column, payload: Column) -> Column:
    """Text of a page or plain file; null for other content."""
    return F.when(content_type.contains("html"), T.html_text(payload)).when(content_type.contains("text/plain"), payload)
