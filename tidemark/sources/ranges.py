"""ZIP archives read by ranges: the directory from an archive's tail, then only the bytes of the entries that are wanted.

Archives are rows (archive, size, modified); their directories are read in tasks, a few hundred bytes from the tail and then
the directory block by block. Each entry is a row of its own, so that entries are dealt out to tasks whatever archive they
are in; what reads an entry gets an iterator of inflated blocks, and never holds the entry.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from struct import unpack

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read, and inflated, at once.
BLOCK = 1 << 20
#: Compressed bytes that a task is given, about.
SHARE = 64 << 20
ENTRY = "archive string, archive_size long, modified timestamp, ordinal int, name string, size long, compressed long, method int, encrypted boolean, checksum long, at long, error string"


class Broken(Exception):
    """An archive or entry is not what it says; the code tells in what way."""


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, size, modified) of the files of a folder; no content is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("archive"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def store_of(uri: str):
    """(file system, path) of a file or folder of any store."""
    from pyarrow import fs

    local = re.match(r"file:/+", uri)
    if local or uri.startswith("/"):
        return fs.LocalFileSystem(), "/" + uri[local.end() if local else 1 :]
    return fs.FileSystem.from_uri(uri)


class Ranges:
    """A file of any store by ranges, pinned: of another size or time than when it was listed, it is not read."""

    def __init__(self, uri: str, size: int | None = None, modified=None):
        store, path = store_of(uri)
        info = store.get_file_info(path)
        if size is not None and info.size != size or modified is not None and info.mtime is not None and abs(info.mtime.timestamp() - modified.timestamp()) >= 1:
            raise Broken("integrity_mismatch")
        self.file, self.size = store.open_input_file(path), info.size

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def blocks(self, at: int, until: int | None = None) -> Iterator[bytes]:
        until = self.size if until is None else until
        while at < until and (block := self.read(at, min(BLOCK, until - at))):
            at += len(block)
            yield block


class Bytes(Ranges):
    """The same of bytes at hand."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


def directory_of(file: Ranges) -> Iterator[dict]:
    """The entries by an archive's directory. The end record's comment has to end the file, and the directory the record."""
    tail = file.read(max(0, file.size - 65_557), 65_557)
    end = tail.rfind(b"PK\5\6")
    if file.read(0, 4) not in (b"PK\3\4", b"PK\5\6") or end < 0 or len(tail) < end + 22 or end + 22 + unpack("<H", tail[end + 20 : end + 22])[0] != len(tail):
        raise Broken("invalid_archive")
    disk, first_disk, here, n, size, at = unpack("<4H2I", tail[end + 4 : end + 20])
    stop = file.size - len(tail) + end
    if n == 0xFFFF or 0xFFFFFFFF in (size, at):  # the wide form stands before, and a pointer to it
        pointer = file.read(stop - 20, 20) if stop >= 20 else b""
        stop = unpack("<Q", pointer[8:16])[0] if pointer[:4] == b"PK\6\7" else 0
        wide = file.read(stop, 56)
        if wide[:4] != b"PK\6\6" or len(wide) < 56:
            raise Broken("invalid_archive")
        disk, first_disk, here, n, size, at = unpack("<2I4Q", wide[16:56])
    if disk or first_disk or here != n or at + size != stop:
        raise Broken("invalid_archive")
    blocks, data = file.blocks(at, stop), b""
    for ordinal in range(n):
        while len(data) < 46 or len(data) < 46 + sum(unpack("<3H", data[28:34])):
            more = next(blocks, None)
            if more is None:
                raise Broken("invalid_archive")
            data += more
        flags, method = unpack("<2H", data[8:12])
        checksum, compressed, plain, a, b, c = unpack("<3I3H", data[16:34])
        where = unpack("<I", data[42:46])[0]
        if data[:4] != b"PK\1\2":
            raise Broken("invalid_archive")
        name, extra = data[46 : 46 + a], data[46 + a : 46 + a + b]
        while len(extra) >= 4:
            kind, length = unpack("<2H", extra[:4])
            if kind == 1:
                wide = [extra[k : k + 8] for k in range(4, 4 + length, 8)]
                values = [unpack("<Q", wide.pop(0))[0] if v == 0xFFFFFFFF and wide and len(wide[0]) == 8 else v for v in (plain, compressed, where)]
                plain, compressed, where = values
            extra = extra[4 + length :]
        try:
            name = name.decode("utf-8" if flags & 0x800 else "cp437")
        except UnicodeDecodeError:
            raise Broken("invalid_archive") from None
        yield {"ordinal": ordinal, "name": name, "size": plain, "compressed": compressed, "method": method, "encrypted": bool(flags & 1), "checksum": checksum, "at": where}
        data = data[46 + a + b + c :]
    if data or next(blocks, None):
        raise Broken("invalid_archive")


def inflated(file: Ranges, entry: dict) -> Iterator[bytes]:
    """An entry's bytes, block by block. At the end the size and checksum have to be those of the directory, and all of the
    compressed bytes used; no more than the size is ever given out.
    """
    head = file.read(entry["at"], 30)
    if len(head) < 30 or head[:4] != b"PK\3\4" or entry["method"] not in (0, 8):
        raise Broken("integrity_mismatch")
    at = entry["at"] + 30 + sum(unpack("<2H", head[26:30]))
    if at + entry["compressed"] > file.size:
        raise Broken("integrity_mismatch")
    total = checksum = 0
    inflate = zlib.decompressobj(-15) if entry["method"] == 8 else None
    for block in file.blocks(at, at + entry["compressed"]):
        while block:
            if inflate is None:
                out, block = block, b""
            elif inflate.eof:
                raise Broken("integrity_mismatch")
            else:
                try:
                    out, block = inflate.decompress(block, BLOCK), inflate.unconsumed_tail
                except zlib.error:
                    raise Broken("integrity_mismatch") from None
                if inflate.unused_data:
                    raise Broken("integrity_mismatch")
            total, checksum = total + len(out), zlib.crc32(out, checksum)
            if total > entry["size"]:
                raise Broken("integrity_mismatch")
            if out:
                yield out
    while inflate is not None and not inflate.eof:
        out = inflate.decompress(inflate.unconsumed_tail, BLOCK)
        total, checksum = total + len(out), zlib.crc32(out, checksum)
        if not out or total > entry["size"]:
            raise Broken("integrity_mismatch")
        yield out
    if total != entry["size"] or checksum != entry["checksum"]:
        raise Broken("integrity_mismatch")


def directory(archives: DataFrame) -> DataFrame:
    """A row of ENTRY for each entry of each archive (archive, size, modified); nothing is inflated.

    An archive that is none, or not the one that was listed, has one row with an error; an empty one has no row. Repeated
    archives have their rows each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(ENTRY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, rows = {"archive": row["archive"], "archive_size": row["size"], "modified": row["modified"]}, []
                try:
                    for entry in directory_of(Ranges(row["archive"], row["size"], row["modified"])):
                        rows.append(own | entry)
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows = []
                except Broken as error:
                    rows.append(own | {"error": str(error)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return archives.select("archive", "size", "modified").mapInArrow(run, ENTRY)


def dealt(entries: DataFrame) -> DataFrame:
    """entries, dealt out so that each task has about SHARE compressed bytes, and an entry is in one task."""
    total = entries.agg(F.sum("compressed")).first()[0] or 0
    return entries.repartition(int(total // SHARE) + 1, "archive", "ordinal")


def read_entries(entries: DataFrame, parse: Callable[[Iterator[bytes], dict], Iterator[pa.RecordBatch]], schema: str, failed: Callable[[dict, str], pa.RecordBatch]) -> DataFrame:
    """What parse makes of each entry (rows of ENTRY), from its inflated blocks as they are read. An entry that turns out to
    be broken has the rows made so far, and then the one of `failed`; what follows has to judge an entry by all its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                try:
                    blocks = inflated(Ranges(entry["archive"], entry["archive_size"], entry["modified"]), entry)
                    yield from parse(blocks, entry)
                    for _ in blocks:  # what a parser leaves is read too: the checksum is of all
                        pass
                except Broken as error:
                    yield failed(entry, str(error))

    return dealt(entries).mapInArrow(run, schema)


def read_bytes(entries: DataFrame) -> DataFrame:
    """(archive, ordinal, name, block, content, error): each entry's bytes, in blocks numbered from 0."""
    names = ("archive", "ordinal", "name", "block", "content", "error")
    kinds = pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.string()), strict=True)))

    def row(entry: dict, k: int | None, content: bytes | None, error: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"archive": entry["archive"], "ordinal": entry["ordinal"], "name": entry["name"], "block": k, "content": content, "error": error}], schema=kinds)

    def parse(blocks: Iterator[bytes], entry: dict) -> Iterator[pa.RecordBatch]:
        for k, block in enumerate(blocks):
            yield row(entry, k, block, None)

    return read_entries(entries, parse, "archive string, ordinal int, name string, block int, content binary, error string", lambda e, code: row(e, None, None, code))
