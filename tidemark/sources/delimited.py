"""Comma-separated records on splits: a large file is read by many tasks, quoted line ends included.

Where a split begins, a task can't tell whether it is within quotes. So each split is first run through from all four states
of the format's machine, which is to look at its quotes only; the driver follows the states from split to split (a row a
split); then each split is read from its own state, and gives out the records that begin in it. Records are judged by their
raw bytes before anything is made of them, so that no task holds more than a block and a record within the ceiling.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import Broken, Ranges, list_archives

# Bytes of a record's fields, of a header's, and of a record as it stands.
MAX_RECORD, MAX_HEADER = 2 << 20, 16 << 10
MAX_RAW = 2 * MAX_RECORD + 65_536
SPLIT = 32 << 20
#: At the start of a field, within one, within quotes, and after a quote there that ends it or is the first of two.
START, FIELD, QUOTED, QUOTE = range(4)
_OPENING, _ENDING = re.compile(rb'[,\r\n]"'), re.compile(rb'[\r\n]|,"')
_BOM = b"\xef\xbb\xbf"


def advance(data: bytes, state: int) -> int:
    """The state after data."""
    at = 0
    while at < len(data):
        if state == QUOTED:
            at = data.find(b'"', at) + 1
            if not at:
                return QUOTED
            state = QUOTE
        elif state == QUOTE:
            sign = data[at : at + 1]
            at, state = at + 1, QUOTED if sign == b'"' else START if sign in b",\r\n" else FIELD
        elif state == START and data[at : at + 1] == b'"':
            at, state = at + 1, QUOTED
        elif found := _OPENING.search(data, at):
            at, state = found.end(), QUOTED
        else:
            return START if data[-1:] in (b",", b"\r", b"\n") else FIELD
    return state


def record_end(data: bytes, at: int, state: int) -> tuple[int, int]:
    """(where the record that `at` is in ends, or -1, and the state after data)."""
    while at < len(data):
        if state == QUOTED:
            at = data.find(b'"', at) + 1
            if not at:
                return -1, QUOTED
            state = QUOTE
        elif state == QUOTE:
            sign = data[at : at + 1]
            if sign in b"\r\n":
                return at, START
            at, state = at + 1, QUOTED if sign == b'"' else START if sign == b"," else FIELD
        elif state == START and data[at : at + 1] == b'"':
            at, state = at + 1, QUOTED
        elif not (found := _ENDING.search(data, at)):
            return -1, START if data[-1:] == b"," else FIELD
        elif len(found[0]) == 1:
            return found.start(), START
        else:
            at, state = found.end(), QUOTED
    return -1, state


def records(blocks: Iterable[bytes], at: int = 0, state: int = START, until: int | None = None, inside: bool = False) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, bytes, error) of the records that begin before `until` (all), empty lines left out. inside: the first byte is
    of a record that began before. One beyond MAX_RAW has no bytes and resource_limit; one that ends within quotes invalid_record.
    """
    blocks, data, start, pos, over = iter(blocks), b"", 0, 0, None
    while True:
        end, state = record_end(data, pos, state)
        if end < 0:
            if not inside and over is None and len(data) - start > MAX_RAW:
                over = at + start
            drop = len(data) if inside or over is not None else start
            at, data, start = at + drop, data[drop:], 0
            pos, more = len(data), next(blocks, None)
            if more is not None:
                data += more
                continue
            if over is not None:
                yield over, None, "resource_limit"
            elif data and not inside:
                yield at, data, "invalid_record" if state == QUOTED else None
            return
        if over is not None:
            yield over, None, "resource_limit"
        elif not inside and end - start > MAX_RAW:
            yield at + start, None, "resource_limit"
        elif not inside and end > start:
            yield at + start, data[start:end], None
        inside, over, start, pos = False, None, end + 1, end + 1
        if until is not None and at + start >= until:
            return


def fields_of(record: bytes) -> list[str] | None:
    """A record's fields, or null where it is no UTF-8."""
    try:
        return next(csv.reader(io.StringIO(record.decode(), newline="")))
    except (UnicodeDecodeError, csv.Error, StopIteration):
        return None


def header_of(file: Ranges) -> tuple[int, int, list[str]]:
    """(where the text begins, where the header begins, its names). Broken if there is none or it is too long."""
    begin = 3 if file.read(0, 3) == _BOM else 0
    at, record, error = next(records(file.blocks(begin), begin), (0, None, None))
    names = None if record is None else fields_of(record)
    if error == "resource_limit" or names is not None and sum(len(n.encode()) for n in names) > MAX_HEADER:
        raise Broken("resource_limit")
    if names is None:
        raise Broken("invalid_schema")
    return begin, at, names


def splits(files: DataFrame, size: int) -> list[dict]:
    """(archive, size, modified, at, begin, header_at, header, state, error), a row for each split of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = {"header": None, "begin": 0, "header_at": 0, "ends": None, "error": None}
                try:
                    file = Ranges(row["archive"], row["size"], row["modified"])
                    if row["at"] == 0:
                        out["begin"], out["header_at"], out["header"] = header_of(file)
                    begin = 3 if file.read(0, 3) == _BOM else 0
                    states = [START, FIELD, QUOTED, QUOTE]
                    for block in file.blocks(max(row["at"], begin), row["at"] + size if row["at"] + size < file.size else file.size):
                        after = {s: advance(block, s) for s in set(states)}
                        states = [after[s] for s in states]
                    out["ends"] = states
                except Broken as error:
                    out["error"] = str(error)
                yield pa.RecordBatch.from_pylist([row | out], schema=kinds)

    kinds = pa.schema(
        [("archive", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("at", pa.int64()), ("header", pa.list_(pa.string())), ("begin", pa.int64()),
         ("header_at", pa.int64()), ("ends", pa.list_(pa.int32())), ("error", pa.string())]
    )
    each = files.select("archive", "size", "modified", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("at"))
    n = files.agg(F.sum(F.col("size") / size)).first()[0] or 0
    told = each.repartition(int(n) + 1, "archive", "at").mapInArrow(run, "archive string, size long, modified timestamp, at long, header array<string>, begin long, header_at long, ends array<int>, error string")
    out, state, first = [], START, None
    for r in sorted((r.asDict() for r in told.collect()), key=lambda r: (r["archive"], r["at"])):
        if r["at"] == 0:
            state, first = START, r
        out.append(r | {"state": state, "header": first["header"], "begin": first["begin"], "header_at": first["header_at"], "error": r["error"] or first["error"]})
        state = r["ends"][state] if r["ends"] else START
    return out


def read_records(spark: SparkSession, path: str, columns: tuple[str, ...], needed: tuple[str, ...], split: int = SPLIT) -> DataFrame:
    """(archive, offset, columns, record_bytes, malformed, exact): a row for each record of the files at path but their headers.

    Columns go by the names of a file's header, and are null where it does not have them; a file without those needed, or
    without a header within its limit, is a ValueError. record_bytes: of the fields; of a record beyond MAX_RAW, more than
    MAX_RECORD. malformed: of another width than the header, no UTF-8, or ending within quotes. exact: the header is
    just `needed`. Empty lines are no records, an empty folder gives none.
    """
    rows = splits(list_archives(spark, path), split)
    for r in rows:
        if r["at"] == 0 and r["error"]:
            raise ValueError(f"{r['error']}: header of {r['archive']}")
        if r["at"] == 0 and (missing := [c for c in needed if c not in r["header"]]):
            raise ValueError(f"unsupported_format_version: {r['archive']} has no {missing}")
        if r["error"]:
            raise ValueError(f"{r['error']}: {r['archive']}")
    plan = spark.createDataFrame(
        [[r[c] for c in ("archive", "size", "modified", "at", "state", "begin", "header_at", "header")] for r in rows],
        "archive string, size long, modified timestamp, at long, state int, begin long, header_at long, header array<string>",
    )
    kinds = pa.schema([("archive", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in columns], ("record_bytes", pa.int64()), ("malformed", pa.bool_()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(MAX_RAW)
        for batch in batches:
            for r in batch.to_pylist():
                out, held = [], 0
                file, names, at = Ranges(r["archive"], r["size"], r["modified"]), r["header"], max(r["at"], r["begin"])
                place = {c: names.index(c) for c in columns if c in names}
                inside = at > r["begin"] and not (r["state"] == START and file.read(at - 1, 1) in (b"\r", b"\n"))
                for offset, record, error in records(file.blocks(at), at, r["state"], r["at"] + split, inside) if at < r["at"] + split else ():
                    if offset == r["header_at"]:
                        continue
                    fields = None if record is None else fields_of(record)
                    good = fields is not None and len(fields) == len(names) and error is None
                    size = MAX_RAW if record is None else sum(len(x.encode()) for x in fields or ())
                    values = {c: fields[k] for c, k in place.items()} if good else dict.fromkeys(place)
                    if not good and fields:  # what is there is told, for a reader of errors
                        values = {c: fields[k] if k < len(fields) else None for c, k in place.items()}
                    out.append({"archive": r["archive"], "offset": offset, "record_bytes": size, "malformed": not good, "exact": names == list(needed), **values})
                    held += size
                    if len(out) == 1000 or held > 4 * MAX_RAW:
                        yield pa.RecordBatch.from_pylist(out, schema=kinds)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    schema = f"archive string, offset long, {', '.join(f'`{c}` string' for c in columns)}, record_bytes long, malformed boolean, exact boolean"
    return plan.repartition(max(1, len(rows)), "archive", "at").mapInArrow(run, schema)
