"""Sources that read by ranges, splits and blocks, against plain readers."""

import csv
import io
import json
import random
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.sources import archives, delimited, ranges, scripts


def write_zip(path, entries, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, body in entries.items():
            with z.open(name, "w", force_zip64=len(body) > 1000) as f:
                f.write(body)


def test_entries_by_range(spark, tmp_path):
    draw = random.Random(1)
    bodies = {f"data/tweets-part{k}.js": bytes(draw.choices(b"abc[]{}", k=draw.choice((0, 10, 3_000_000)))) for k in range(6)}
    write_zip(tmp_path / "a.zip", bodies)
    write_zip(tmp_path / "b c.zip", {"x.txt": b"stored", "é.csv": b""}, zipfile.ZIP_STORED)
    (tmp_path / "none.zip").write_bytes(b"PK\3\4 but no more")
    listed = ranges.directory(ranges.list_archives(spark, str(tmp_path)))
    rows = listed.collect()
    assert {r["name"] for r in rows} == {*bodies, "x.txt", "é.csv", None} and [r["archive"][-8:] for r in rows if r["error"] == "invalid_archive"] == ["none.zip"]
    read = {}
    for r in ranges.read_bytes(listed.where("error IS NULL")).collect():
        assert r["error"] is None
        read.setdefault(r["name"], {})[r["block"]] = r["content"]
    joined = {n: b"".join(b[k] for k in sorted(b)) for n, b in read.items()}
    assert joined == {n: b for n, b in (bodies | {"x.txt": b"stored"}).items() if b}
    assert max(len(c) for b in read.values() for c in b.values()) <= ranges.BLOCK


def test_damaged_entries_are_told(spark, tmp_path):
    body = b"window.YTD.tweets.part0 = [" + b",".join(b'{"id": %d}' % k for k in range(50_000)) + b"]"
    whole = tmp_path / "z.zip"
    write_zip(whole, {"data/tweets.js": body}, zipfile.ZIP_STORED)
    good = whole.read_bytes()

    def errors(data):
        whole.write_bytes(data)
        entries = ranges.directory(ranges.list_archives(spark, str(whole)))
        return {r["error"] for r in archives.js_elements_by_range(entries.where("error IS NULL")).collect()} | {r["error"] for r in entries.collect()}

    assert errors(good) == {None}
    at = good.index(b"12345")
    assert errors(good[:at] + b"9" + good[at + 1 :]) == {None, "integrity_mismatch"}
    directory = good.rindex(b"PK\1\2")
    for field in (16, 20, 24, 42):  # checksum, compressed and plain size, place
        assert errors(good[: directory + field] + b"\7\7" + good[directory + field + 2 :]) & {"integrity_mismatch", "invalid_archive"}
    assert errors(good + b" ") == {"invalid_archive"} and errors(good[:-1]) == {"invalid_archive"}
    # A file that has changed since it was listed is not read.
    whole.write_bytes(good)
    entries = ranges.directory(ranges.list_archives(spark, str(whole)))
    listed = spark.createDataFrame(entries.collect(), entries.schema)
    whole.write_bytes(good + b" ")
    assert [r["error"] for r in ranges.read_bytes(listed).collect()] == ["integrity_mismatch"]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400))
def test_any_bytes_are_an_archive_or_broken(data):
    for wrapped in (data, b"PK\3\4" + data + b"PK\5\6" + data[:18].ljust(18, b"\0")):
        try:
            for entry in ranges.directory_of(ranges.Bytes(wrapped)):
                b"".join(ranges.inflated(ranges.Bytes(wrapped), entry))
        except ranges.Broken:
            pass


def test_an_archive_larger_than_a_worker(spark, tmp_path):
    """550 MB of members, in a worker that may take 200 MB more than it has."""
    body = b"window.YTD.tweets.part0 = [" + (b'{"a": "' + b"x" * 1000 + b'"},') * 270_000 + b'{"a": 1}]'
    write_zip(tmp_path / "large.zip", {"data/tweets-part0.js": body, "data/tweets-part1.js": body})
    del body

    def parse(blocks, entry):
        import resource

        import pyarrow as pa

        soft = resource.getrlimit(resource.RLIMIT_AS)
        used = int(re.search(r"VmSize:\s+(\d+)", open("/proc/self/status").read())[1]) << 10
        resource.setrlimit(resource.RLIMIT_AS, (used + (200 << 20), soft[1]))
        try:
            n = sum(e[3] is None for e in scripts.elements(blocks))
        finally:
            resource.setrlimit(resource.RLIMIT_AS, soft)
        yield pa.RecordBatch.from_pydict({"name": [entry["name"]], "n": [n]})

    entries = ranges.directory(ranges.list_archives(spark, str(tmp_path)))
    found = ranges.read_entries(entries, parse, "name string, n long", None).collect()
    assert [r["n"] for r in found] == [270_001] * 2


# Records ----------------------------------------------------------------------------------------------------------------

CELLS = st.text(alphabet='ab,"\n\ré ', max_size=6)


def table_of(rows, ends):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=ends).writerows(rows)
    return out.getvalue().encode()


def split_at(data, size):
    """The records of each split, read from the state that the splits before end in."""
    out, state = [], delimited.START
    for at in range(0, len(data), size):
        inside = at > 0 and not (state == delimited.START and data[at - 1 : at] in (b"\r", b"\n"))
        blocks = [data[k : k + 3] for k in range(at, len(data), 3)]
        out += delimited.records(blocks, at, state, at + size, inside)
        state = delimited.advance(data[at : at + size], state)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(CELLS, min_size=1, max_size=3), max_size=6), st.sampled_from(["\n", "\r\n", "\r"]), st.integers(1, 40))
def test_splits_are_the_whole(rows, ends, size):
    data = table_of(rows, ends)
    whole = list(delimited.records([data]))
    assert split_at(data, size) == whole
    wanted = [r for r in csv.reader(io.StringIO(data.decode(), newline="")) if r]
    assert [delimited.fields_of(r) for _, r, _ in whole] == wanted


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(b'",\n\rx'[c % 5] for c in b)), st.integers(1, 20))
def test_splits_of_any_quotes(data, size):
    assert split_at(data, size) == list(delimited.records([data]))


def test_raw_ceiling(monkeypatch):
    monkeypatch.setattr(delimited, "MAX_RAW", 50)
    data = b'a,b\n"' + b"x\n" * 40 + b'",1\nc,d\n' + b"y" * 51 + b"\n" + b"z" * 50 + b'\n"open'
    found = [(at, r, e) for at, r, e in delimited.records([data[k : k + 7] for k in range(0, len(data), 7)])]
    assert [(r, e) for _, r, e in found] == [(b"a,b", None), (None, "resource_limit"), (b"c,d", None), (None, "resource_limit"), (b"z" * 50, None), (b'"open', "invalid_record")]
    assert [data[at : at + 1] for at, _, _ in found] == [b"a", b'"', b"c", b"y", b"z", b'"']


@pytest.mark.parametrize("split", [301, 1 << 20])
def test_csv_on_splits(spark, tmp_path, split):
    draw = random.Random(2)
    rows = [[f"a{k}", "", "2020-01-02T03:04:05Z", "s", f"t1_{k}", "".join(draw.choices('xy,"\n\ré', k=draw.randint(1, 9)))] for k in range(60)]
    for name, part in (("1.csv", rows[:40]), ("2.csv", rows[40:])):
        (tmp_path / name).write_bytes("\ufeff".encode() + table_of([archives.COMMENTS, *part], "\r\n"))
    found = archives.read_csv(spark, str(tmp_path), "comments", split)
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == found.count() == 60 and all(got[r[0]]["body"] == r[5] and not got[r[0]]["malformed"] and got[r[0]]["format_confidence"] == "confirmed" for r in rows)
    (tmp_path / "3.csv").write_text("id,date\n")
    with pytest.raises(ValueError, match="unsupported_format_version"):
        archives.read_csv(spark, str(tmp_path), "comments", split)
    (tmp_path / "3.csv").write_text(",".join([*archives.COMMENTS, "x" * 17_000]))
    with pytest.raises(ValueError, match="resource_limit"):
        archives.read_csv(spark, str(tmp_path), "comments", split)


# Arrays -----------------------------------------------------------------------------------------------------------------

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(alphabet='a"\\[]{},é\n', max_size=6), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=2), v, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, max_size=5), st.integers(1, 30), st.sampled_from(["", ";", " ;\n"]), st.booleans())
def test_elements_in_blocks(values, size, end, plain):
    body = ("\ufeff window.YTD.note_tweet.part12 = [" + " , ".join(json.dumps(v, ensure_ascii=plain) for v in values) + "\n]" + end).encode()
    found = list(scripts.elements(body[k : k + size] for k in range(0, len(body), size)))
    assert [(d, k, e) for d, k, _, e in found] == [("note_tweet", k, None) for k in range(len(values))]
    assert [json.loads(t) for _, _, t, _ in found] == values


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("", ["malformed_wrapper"]), ("alert(1)", ["malformed_wrapper"]), ("x" * 5000 + "=[", ["malformed_wrapper"]), ("[1", [None, "malformed_record"][1:]),
        ("[1,]", [None, "malformed_record"]), ("[,1]", ["malformed_record"]), ("[1,,2]", [None, "malformed_record"]), ("[1 2]", ["malformed_record"]), ("[1}", ["malformed_record"]),
        ("[1] x", [None, "malformed_wrapper"]), ("[1];;", [None, "malformed_wrapper"]), ("[]", []), ("[ ]\n;", []), ('["a]', ["malformed_record"]),
        ("[" + "[" * 63 + "]" * 63 + ",1]", [None, None]), ("[" + "[" * 64 + "]" * 64 + ",1]", ["resource_limit", None]),
        ('["' + "x" * (4 << 20) + '",1]', ["resource_limit", None]), ('["\udcff"]', ["malformed_record"]),
    ],
)
def test_faults_of_arrays(body, wanted):
    head = "window.YTD.tweets.part0 =" if body.startswith("[") else ""
    data = (head + body).encode("utf-8", "surrogateescape")
    for size in (5, 1 << 20):
        assert [e[3] for e in scripts.elements(data[k : k + size] for k in range(0, len(data), size))] == wanted
