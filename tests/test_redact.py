"""Redaction of records, archives as a sink, and admission of scans."""

import hashlib
import json
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import redact
from tidemark.operators import review, store
from tidemark.sources import packages, ranges

TWEET = {
    "tweet": {
        "id": 1234567, "id_str": "1234567", "full_text": "@someone hello 1234567", "lang": "en", "in_reply_to_status_id": 7654321, "in_reply_to_status_id_str": "7654321",
        "in_reply_to_user_id_str": None, "in_reply_to_screen_name": "someone", "source": "<a href=\"https://a.example/1234567\">app</a>",
        "entities": {"user_mentions": [{"screen_name": "someone", "name": "Some One", "id_str": "998877", "id": 998877}], "urls": [{"url": "https://t.example/x", "indices": [1, 2]}], "hashtags": []},
        "edit_info": {"initial": {"editTweetIds": ["1234567", "1234568"], "editsRemaining": "5"}},
    }
}


def token(kind, value):
    return hashlib.sha256(f"s::{kind}::{value}".encode()).hexdigest()


def ident(value):
    return str(int(token("x_id", value)[:15], 16))


def test_tweets_are_redacted(spark):
    """Ids map alike wherever they stand and keep their type; what is not named stays; nothing of the source is left."""
    note = {"noteTweet": {"noteTweetId": "55555", "core": {"text": "long 1234567", "mentions": []}, "createdAt": "now"}}
    old = {"id": "1234567", "text": "x", "created_at": "then", "other": "998877"}
    rows = [(1, json.dumps(TWEET), "a"), (2, json.dumps(old), "b"), (3, None, None), (4, "[1]", "c"), (5, "{", "d"), (6, "{}", "e"), (1, json.dumps(TWEET), "a")]
    frame = spark.createDataFrame(rows, "place int, record string, id string")
    out = redact.records(frame, "s::")
    assert out.columns == frame.columns
    got = out.collect()
    read = [json.loads(r["record"]) if r["record"] else None for r in got]
    own = read[0]["tweet"]
    assert got[0] == got[6] and [r["id"] for r in got] == [r[2] for r in rows] and read[2:5] == [None, None, None]
    assert own["id_str"] == ident("1234567") == str(own["id"]) and own["in_reply_to_status_id"] == int(ident("7654321")) and own["in_reply_to_user_id_str"] is None
    assert own["edit_info"] == {"initial": {"editTweetIds": [ident("1234567"), ident("1234568")], "editsRemaining": "5"}} and own["lang"] == "en"
    assert own["entities"]["user_mentions"] == [{"screen_name": "user_" + token("handle", "someone")[:8], "name": "Synthetic User", "id_str": ident("998877"), "id": int(ident("998877"))}]
    assert own["entities"]["urls"] == [{"url": redact.HOST + token("url", "https://t.example/x")[:12], "indices": [1, 2]}]
    assert own["full_text"] == f"@user_{token('handle', 'reply')[:8]} synthetic reply 1"
    assert read[1] == {"id": int(ident("1234567")), "text": "Synthetic classic tweet 2", "created_at": "then"}
    for secret in ("1234567", "7654321", "998877", "someone", "Some One", "t.example", "a.example"):
        assert all(secret not in (r["record"] or "") for r in got[:5])
    notes = redact.records(spark.createDataFrame([(9, json.dumps(note))], "place int, record string"), "s::", "note").collect()
    assert json.loads(notes[0]["record"]) == {"noteTweet": {"noteTweetId": ident("55555"), "core": {"text": "Synthetic long-form note body 9.", "mentions": []}, "createdAt": "now"}}
    assert redact.records(frame.limit(0), "s::").collect() == []


trees = st.recursive(
    st.none() | st.booleans() | st.integers(10**9, 10**12) | st.sampled_from(["https://h.example/secret", "plain"]),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["id", "id_str", "entities", "urls", "url", "user_mentions", "edit_info", "z"]), x, max_size=4),
    max_leaves=20,
)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from(["id", "in_reply_to_status_id", "entities", "z"]), trees))
def test_any_tree_keeps_its_form(tree):
    """Whatever stands where, members stay, lists keep their length, and no address is left."""

    def form(x):
        return {k: form(v) for k, v in x.items()} if isinstance(x, dict) else [form(v) for v in x] if isinstance(x, list) else None

    redactor = redact.Redactor("s::")
    out = redactor.rewrite(tree, {"entities": {"urls": {"url": redactor.url}}, "z": None})
    assert form(out) == form(tree) and "h.example" not in json.dumps(out)
    assert redactor.rewrite(tree, {"entities": {"urls": {"url": redactor.url}}, "z": None}) == out


def test_account_manifest(spark):
    text = '{"userName": "me", "displayName" :"Me, too", "accountId":"42", "size": "7"}'
    (got,) = spark.createDataFrame([(text,)], "t string").select(redact.account_manifest(F.col("t"))).first()
    assert json.loads(got) == {"userName": "redacted_user", "displayName": "Redacted User", "accountId": "0000000000000000001", "size": "7"}


def test_archives_written_are_read(spark, tmp_path):
    """Entries of several blocks, in order, by this library's reader and by a plain one; equal rows give equal bytes."""
    draw = random.Random(4)
    rows, want = [], {}
    for archive in ("a.zip", "b c.zip", "\u00e9.zip"):
        for ordinal in range(4):
            blocks = [bytes(draw.choices(b"abcdef", k=draw.choice((0, 5, 70_000)))) for _ in range(draw.choice((1, 3)))]
            rows += [(archive, ordinal, f"data/part{ordinal}.js", k, b or None) for k, b in enumerate(blocks)]
            want[archive, f"data/part{ordinal}.js"] = b"".join(blocks)
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, packages.SCHEMA).repartition(5)
    for folder in ("one", "two", "one"):  # the last one replaces
        packages.write_archives(frame, f"file://{tmp_path}/{folder}")
    listed = ranges.directory(ranges.list_archives(spark, f"file://{tmp_path}/one/*.zip")).collect()
    assert all(r["error"] is None for r in listed) and len(listed) == len(want)
    for name in ("a.zip", "b c.zip", "\u00e9.zip"):
        with zipfile.ZipFile(tmp_path / "one" / name) as z:
            assert z.testzip() is None and {(name, n): z.read(n) for n in z.namelist()} == {k: v for k, v in want.items() if k[0] == name}
            assert z.namelist() == sorted(z.namelist())
        data = (tmp_path / "one" / name).read_bytes()
        assert data == (tmp_path / "two" / name).read_bytes()
        (row,) = packages.read_manifest(spark, f"file://{tmp_path}/two").where(f"archive = '{name}'").collect()
        assert (row["entries"], row["size"], row["sha256"]) == (4, len(data), hashlib.sha256(data).hexdigest())
    assert not [p for p in (tmp_path / "one").iterdir() if p.name.startswith("_pending")]
    packages.write_archives(frame.limit(0), f"file://{tmp_path}/none")
    assert not list((tmp_path / "none").glob("*.zip"))


def test_a_failed_run_leaves_no_archive(spark, tmp_path):
    rows = [("good.zip", 0, "x", 0, b"1"), ("../bad.zip", 0, "x", 0, b"1")]
    with pytest.raises(Exception, match="no name of a file"):
        packages.write_archives(spark.createDataFrame(rows, packages.SCHEMA), f"file://{tmp_path}/out")
    assert not list(tmp_path.rglob("*.zip"))


def test_admissions_by_rule(spark):
    """Each rule alone, the order of rules, and two requests of one user."""
    imports = [("t", 1, 10, "x", "ready"), ("t", 1, 11, "reddit", "ready"), ("t", 1, 12, "x", "parsing"), ("t", 2, 20, "x", "ready"), ("t", 3, 30, "x", None), ("t", 4, 40, "x", "ready")]
    rights = [("t", 1, 1, None), ("t", 2, 1, 0), ("t", 3, 1, 1), ("t", 4, 2, 1), ("u", 5, 2, 1)]
    scans = [("t", 4, "running"), ("t", 4, "queued"), ("t", 1, "failed"), ("u", 1, "running")]
    asked = {
        "a": (1, [10], 5, None), "b": (1, [10], 4, None), "c": (1, [10, 10], 0, "INVALID_ARCHIVE_IMPORT_IDS"), "d": (1, [], 0, "INVALID_ARCHIVE_IMPORT_IDS"), "e": (1, None, 0, "INVALID_ARCHIVE_IMPORT_IDS"),
        "f": (1, [10, None], 0, "INVALID_ARCHIVE_IMPORT_IDS"), "g": (2, [20], 0, "ENTITLEMENT_REQUIRED"), "h": (5, [20], 0, "ENTITLEMENT_REQUIRED"), "i": (1, [10, 20], 0, "RESOURCE_NOT_FOUND"),
        "j": (1, [10, 12], 0, "IMPORTS_NOT_READY"), "k": (3, [30], 0, "IMPORTS_NOT_READY"), "l": (1, [10, 11], 0, "PLATFORM_LIMIT_EXCEEDED"), "m": (4, [40], 0, "SCAN_ALREADY_RUNNING"), "n": (1, [99], 0, "RESOURCE_NOT_FOUND"),
    }
    requests = spark.createDataFrame([(k, "t", u, ids, at) for k, (u, ids, at, _) in asked.items()], "request_id string, tenant_id string, user_id int, import_ids array<int>, created_at int")
    tables = [
        spark.createDataFrame(imports, "tenant_id string, user_id int, import_id int, platform string, status string"),
        spark.createDataFrame(rights, "tenant_id string, user_id int, platform_limit int, rescans_remaining int"),
        spark.createDataFrame(scans, "tenant_id string, user_id int, status string"),
    ]
    got = {r["request_id"]: r["error_code"] for r in review.admissions(requests, *tables).collect()}
    assert got == {k: v[3] for k, v in asked.items()} | {"a": "SCAN_ALREADY_RUNNING"}
    assert review.admissions(requests.limit(0), *tables).collect() == []


def test_owned_imports_of_odd_payloads(spark):
    rows = [(1, '{"import_id": "7"}', "running", "w"), (2, '{"import_id": 7}', "running", "v"), (3, None, "running", "w"), (4, "{", "running", "w"), (5, '{"import_id": "x"}', "running", "w"), (6, '{"import_id": 7}', "pending", "w")]
    items = spark.createDataFrame(rows, "id int, payload string, status string, lease_owner string")
    imports = spark.createDataFrame([(7, "a"), (8, "b")], "import_id long, name string")
    assert [tuple(r) for r in store.owned_imports(items, imports, F.lit("w")).select("id", "import_id", "name").collect()] == [(1, 7, "a")]
