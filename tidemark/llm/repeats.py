"""Removal of repeated passages, exact to the byte: a distributed merge sort of suffixes.

A byte goes if a string of SPAN bytes that covers it starts at another place too, in the same or another text. Strings
are looked up by their anchors (see suffixes); all strings about one anchor make up its piece. Texts are worked on
once each, with how many rows have them. Four steps, each over all rows:

1. Anchors whose run of bytes stands nowhere else (told by counts of its hash) are out: none of their strings can
   stand elsewhere.
2. The pieces of all others are sorted in runs, front-coded, exchanged by anchor, and merged with a loser tree that
   starts each comparison after the prefix known to be common. Equal ones are repeats.
3. What is left are the strings at the edges of repeated passages: those of pieces that stand alone at an anchor that
   others have too, and of one of each kind of these. They are sorted and merged in the same way, string by string.
4. The places found are gathered by text, and the bytes that they cover removed.

An anchor that very many texts share is dealt out by piece, then by string, instead, and equal pieces of a task are one
entry of its run, so that no task gets the rows of a large group together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, suffixes
from .suffixes import SPAN

#: Bytes of text that anchors are looked for in at once; longer texts are read in slices.
SLICE = 1 << 20
#: Keys of a run, and keys that one merge gets on average.
RUN, PART = 50_000, 150_000
#: Pieces of one anchor from which they are dealt out one by one.
HOT = 50_000
#: Strings of an anchor that are dealt out together start within so many bytes of each other.
STEP = 16

_SPANS = "array<struct<lo:int,n:int>>"


def _span_rows(ids: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(id, spans) by id: lo .. lo + n - 1, what touches joined. Spans do not overlap."""
    order = np.lexsort((lo, ids))
    ids, lo, n = ids[order], lo[order], n[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (lo[1:] != lo[:-1] + n[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n, at) if len(at) else n
    ids, lo = ids[at], lo[at]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else at
    spans = pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(total, pa.int32())], names=["lo", "n"])
    ends = pa.array(np.append(first, len(ids)), pa.int32())
    return pa.array(ids[first], pa.int64()), pa.ListArray.from_arrays(ends, spans)


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """Rows of two kinds. With gram: an anchor, or the first of several of this task whose pieces are equal byte by byte
    (seen: how many rows of the corpus these stand for). With spans: where the strings of those several start.
    """

    def found(ids: list[int], copies: list[int], offsets: list[int], slices: list[bytes]) -> Iterator[pa.RecordBatch]:
        a = suffixes.anchors(slices)
        if not len(a.lo):
            return
        ids_, lo, seen = np.array(ids)[a.text], a.lo + np.array(offsets)[a.text], np.array(copies)[a.text]
        order = np.lexsort((a.whole, a.gram))
        new = np.ones(len(order), bool)
        new[1:] = (a.gram[order][1:] != a.gram[order][:-1]) | (a.whole[order][1:] != a.whole[order][:-1])

        def piece(k: int) -> bytes:
            return slices[a.text[k]][a.lo[k] : a.lo[k] + a.n[k] + SPAN - 1]

        for k in np.flatnonzero(~new).tolist():  # equal hashes are not enough
            new[k] = piece(order[k]) != piece(order[k - 1])
        at = np.flatnonzero(new)
        one, several = order[at], np.diff(np.append(at, len(order)))
        columns = [
            pa.array(a.gram[one].view(np.int64)),
            pa.array(np.add.reduceat(seen[order], at)),
            pa.array(ids_[one], pa.int64()),
            pa.array((a.at[one] - a.lo[one]).astype(np.int8)),
            pa.array(lo[one], pa.int32()),
            pa.array(a.n[one].astype(np.int8)),
        ]
        names = ["gram", "seen", "id", "before", "lo", "n"]
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(at), kind)], names=[*names, "spans"])
        settled = order[np.repeat(several > 1, several)]
        if len(settled):
            who, spans = _span_rows(ids_[settled], lo[settled], a.n[settled])
            blank = [pa.nulls(len(who), c.type) for c in columns]
            blank[2] = who
            yield pa.RecordBatch.from_arrays([*blank, spans.cast(kind)], names=[*names, "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, offsets, slices, size = [], [], [], [], 0
        for batch in common.slices(batches):
            for k, n, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = common.utf8(text)
                for at in range(0, max(1, len(data) - SPAN + 1), SLICE):
                    ids.append(k)
                    copies.append(n)
                    offsets.append(at)
                    slices.append(data[at : at + SLICE + SPAN - 1])
                    size += len(slices[-1])
                    if size >= SLICE:
                        yield from found(ids, copies, offsets, slices)
                        ids, copies, offsets, slices, size = [], [], [], [], 0
        yield from found(ids, copies, offsets, slices)

    schema = f"gram long, seen long, id long, before byte, lo int, n byte, spans {_SPANS}"
    return texts.select("id", "n", "text").mapInArrow(run, schema)


def _packed(part: list[int], keys: list[bytes], ids: list[int], places: list[int], weights: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """A run for each part of these keys."""
    if not keys:
        return
    where, who, places_ = np.array(part), np.array(ids, np.int64), np.array(places, np.int64)
    order = np.argsort(where, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(where[order]) != 0)), len(order))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = order[a:b]
        run = suffixes.make_run([keys[k] for k in own.tolist()], who[own], places_[own], None if weights is None else np.array(weights)[own])
        yield pa.RecordBatch.from_arrays([pa.array([int(where[own[0]])], pa.int64()), pa.array([run.pack()], pa.binary())], names=["part", "run"])


def _piece_runs(texts: DataFrame, parts: int) -> DataFrame:
    """(part, run binary): front-coded sorted runs of the pieces of each text's open anchors, dealt out by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[int] = []
        keys: list[bytes] = []
        ids: list[int] = []
        places: list[int] = []
        weights: list[int] = []
        for batch in common.slices(batches):
            for k, text, open_ in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = common.utf8(text)
                for a in open_:
                    lo, n, dealt = a["lo"], a["n"], a["total"] >= HOT
                    key = suffixes.piece_key(data[lo : lo + n + SPAN - 1], a["before"], n, dealt)
                    keys.append(key)
                    ids.append(k)
                    places.append(lo)
                    weights.append(a["seen"])
                    part.append(zlib.crc32(key) % parts if dealt else a["gram"] % 0x1FFFFFFFFFFFFFFF % parts)
                if len(keys) >= RUN:
                    yield from _packed(part, keys, ids, places, weights)
                    part, keys, ids, places, weights = [], [], [], [], []
        yield from _packed(part, keys, ids, places, weights)

    return texts.select("id", "text", "open").mapInArrow(run, "part long, run binary")


def _sorted_out(runs: DataFrame) -> DataFrame:
    """Rows of two kinds. With spans: where the strings of repeated pieces start. With gram: a piece that stands alone, or
    the first of a repeated kind that one that stands alone may share strings with.
    """
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int32())]))

    def run(table: pa.Table) -> pa.Table:
        found = suffixes.sorted_out([suffixes.Run.unpack(x) for x in table.column("run").to_pylist()])
        again, left = found.kind != suffixes.ALONE, found.kind != suffixes.REPEATED
        who, spans = _span_rows(found.ids[again], found.lo[again], found.n[again])
        open_ = {
            "gram": pa.array(found.gram[left]),
            "alone": pa.array(found.kind[left] == suffixes.ALONE),
            "before": pa.array(found.before[left].astype(np.int8)),
            "lo": pa.array(found.lo[left].astype(np.int32)),
            "n": pa.array(found.n[left].astype(np.int8)),
        }
        blank = {name: pa.nulls(len(who), x.type) for name, x in open_.items()}
        one = pa.table({"id": who, "spans": spans.cast(kind), **blank})
        two = pa.table({"id": found.ids[left], "spans": pa.nulls(int(left.sum()), kind), **open_})
        return pa.concat_tables([one, two])

    return runs.groupBy("part").applyInArrow(run, f"id long, spans {_SPANS}, gram long, alone boolean, before byte, lo int, n byte")


def _string_runs(texts: DataFrame, parts: int) -> DataFrame:
    """(part, run binary): front-coded sorted runs of the strings of each text's open pieces, dealt out by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[int] = []
        keys: list[bytes] = []
        ids: list[int] = []
        places: list[int] = []
        for batch in common.slices(batches):
            for k, text, open_ in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = common.utf8(text)
                for a in open_:
                    at, lo, n = a["before"], a["lo"], a["n"]
                    own = suffixes.keys_of(data[lo : lo + n + SPAN - 1], at, n)
                    keys += own
                    ids += [k] * n
                    places += range(lo, lo + n)
                    if a["total"] >= HOT:
                        part += [zlib.crc32(x) * 0x9E3779B1 % 0xFFFFFFFB % parts for x in own]
                    else:
                        part += [(a["gram"] ^ (at - j) // STEP * 0x9E3779B97F4A7C15) % 0x1FFFFFFFFFFFFFFF % parts for j in range(n)]
                    if len(keys) >= RUN:
                        yield from _packed(part, keys, ids, places)
                        part, keys, ids, places = [], [], [], []
        yield from _packed(part, keys, ids, places)

    return texts.select("id", "text", "open").mapInArrow(run, "part long, run binary")


def _merged(runs: DataFrame) -> DataFrame:
    """(id, spans) of the keys that occur more than once among the runs of a part."""

    def run(table: pa.Table) -> pa.Table:
        ids, places = suffixes.repeated([suffixes.Run.unpack(x) for x in table.column("run").to_pylist()])
        who, spans = _span_rows(ids, places, np.ones(len(ids), np.int64))
        return pa.table({"id": who, "spans": spans})

    return runs.groupBy("part").applyInArrow(run, f"id long, spans {_SPANS}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, removed array<struct<start,end>>, kept binary) for each row of docs.

    removed: the maximal runs of bytes that go, in order, end exclusive; kept: the other bytes of the UTF-8 text, which
    may part a character. Null and empty texts, and those under SPAN bytes, lose nothing. Rows of equal texts are each
    other's repeats; repeated rows and null ids give a row each, an empty table none; other columns are left out.
    """
    scratch = common.Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"), common.text_key(text_col).alias("key"))
    # Each text's number, and how many rows have it. The texts themselves are not kept: a step that needs them reads
    # the input again and exchanges each text once, by its key.
    numbered = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())
    numbered = scratch.write("numbered", numbered)
    distinct = rows.groupBy("key").agg(F.first("text").alias("text"))

    def texts_with(wanted: DataFrame) -> DataFrame:
        return distinct.join(numbered.join(wanted, "id"), "key")

    def gathered(pieces: DataFrame, *names: str) -> DataFrame:
        return pieces.groupBy("id").agg(F.collect_list(F.struct(*names)).alias("open"))

    found = scratch.write("anchors", _anchor_rows(distinct.join(numbered, "key")))
    anchors = found.where(F.col("gram").isNotNull()).drop("spans")
    grams = anchors.groupBy("gram").agg(F.sum("seen").alias("seen"), F.count("*").alias("total")).where(F.col("seen") > 1)
    grams = scratch.write("grams", grams.select("gram", "total"))
    shared = scratch.write("shared", common.spread_join(anchors, grams, "gram", grams.withColumnRenamed("total", "n"), "id"))
    within = scratch.write("within", found.where(F.col("gram").isNull()).select("id", "spans"))
    scratch.drop("anchors", "grams")

    parts = 1 + shared.count() // PART
    wanted = gathered(shared, "before", "lo", "n", "gram", "seen", "total")
    pieces = scratch.write("pieces", _sorted_out(_piece_runs(texts_with(wanted), parts)))
    scratch.drop("shared")
    left = pieces.where(F.col("gram").isNotNull()).drop("spans")
    grams = left.groupBy("gram").agg(F.count_if("alone").alias("alone"), F.count("*").alias("total"), F.sum("n").alias("strings"))
    grams = scratch.write("grams", grams.where((F.col("alone") > 0) & (F.col("total") > 1)))
    open_ = common.spread_join(left, grams.select("gram", "total"), "gram", grams.select("gram", F.col("total").alias("n")), "id")
    parts = 1 + (grams.agg(F.sum("strings")).first()[0] or 0) // PART
    merged = scratch.write("merged", _merged(_string_runs(texts_with(gathered(open_, "before", "lo", "n", "gram", "total")), parts)))

    spans = pieces.where(F.col("gram").isNull()).select("id", "spans").unionByName(within).unionByName(merged)
    spans = spans.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    gone = scratch.write("gone", numbered.join(spans, "id").select("key", "spans"))
    scratch.drop("pieces", "within", "merged", "grams")

    def cut(x: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": x["row"], "n_bytes": [], "removed": [], "kept": []}
        for text, each in zip(x["text"], x["spans"], strict=True):
            data, gone, kept, at = common.utf8(text), [], [], 0
            for lo, n in sorted((s["lo"], s["n"]) for s in each or ()):
                end = lo + n + SPAN - 1
                if gone and lo <= gone[-1]["end"]:
                    gone[-1]["end"] = max(end, gone[-1]["end"])
                else:
                    gone.append({"start": lo, "end": end})
            for g in gone:
                kept.append(data[at : g["start"]])
                at = g["end"]
            out["n_bytes"].append(len(data))
            out["removed"].append(gone)
            out["kept"].append(b"".join([*kept, data[at:]]))
        return out

    schema = f"{common.ddl(rows, 'row', 'id')}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    each = common.spread_join(rows, gone, "key", numbered.select("key", "n"), "row", "left")
    return common.map_batches(each.select("row", "text", "spans"), schema, cut)
