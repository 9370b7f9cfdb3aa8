"""Archives to records, and the rules on keyed tables and queues."""

import datetime
import hashlib
import io
import json
import random
import unicodedata
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import hashing, text
from tidemark.operators import scan, store
from tidemark.sources import archives, sinks


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


def test_archive_rules(spark):
    good = zipped(**{"posts.csv": "id\n1", "readme.txt": "x"})
    files = {
        "good": good,
        "tail": good + b"!",
        "none": b"no archive",
        "path": zipped(**{"posts.csv": "", "../up": ""}),
        "mixed": zipped(**{"posts.csv": "", "data/tweets.js": ""}),
        "other": zipped(**{"data/tweets.js": ""}),
        "empty": zipped(**{"a.txt": ""}),
        "nested": zipped(**{"posts.csv": "", "b.zip": ""}),
        "bomb": zipped(**{"posts.csv": "0" * 3_000_000}),
    }
    frame = spark.createDataFrame(list(files.items()), "archive string, content binary")
    got = {r.archive: r.error for r in archives.archive_errors(archives.zip_entries(frame), "reddit").collect()}
    assert got == {
        "good": None, "tail": "invalid_archive", "none": "invalid_archive", "path": "unsafe_path", "mixed": "ambiguous_archive",
        "other": "platform_mismatch", "empty": "unsupported_archive", "nested": "nested_archive", "bomb": "resource_limit",
    }
    parts = spark.createDataFrame([("p", zipped(**{"data/tweets-part0.js": "", "data/tweets-part2.js": ""}))], "archive string, content binary")
    assert archives.archive_errors(archives.zip_entries(parts), "x").first().error == "missing_shard"


def test_csv_records(spark, tmp_path):
    path = tmp_path / "comments.csv"
    lines = [
        "﻿id,permalink,date,extra,subreddit,parent,body",
        'a1,https://r/r/s/comments/p1/t/a1/,2020-01-02 03:04:05 UTC,x,s,t3_p1,"He said ""hi"",\r\nthen left"',
        "a2,,2020-01-02T03:04:05Z,x,s,t1_b,[deleted]",
        "a3,,yesterday,x,s,t1_b,text",
        "A4,,2020-01-02T03:04:05Z,x,s,t1_b,text",
        "a5,https://r/r/s/comments/p1/t/zz/,2020-01-02T03:04:05Z,x,s,t1_b,text",
        "a6,,2020-01-02T03:04:05Z,x,s,b,text",
        "a7,,2020-01-02T03:04:05Z,x,s,t1_b,  ",
        "a8,,2020-01-02T03:04:05Z,x,s,t1_b,[removed]",
    ]
    path.write_text("\n".join(lines) + "\n", newline="")
    got = {r.source_id: r for r in archives.csv_records(archives.read_csv(spark, str(path), "comments"), "comments").collect()}
    assert got["a1"].body == 'He said "hi",\nthen left' and got["a1"].error is None and got["a1"].parent_id == "p1"
    assert (got["a2"].state, got["a2"].body) == ("deleted", None) and got["a8"].state == "removed"
    assert [got[k].error for k in ("a3", "A4", "a5", "a6", "a7")] == ["invalid_record"] * 5 and got["a1"].format_confidence == "compatible"


def test_posts_need_text_and_width(spark, tmp_path):
    path = tmp_path / "posts.csv"
    lines = [
        ",".join(archives.POSTS),
        "a1,/r/s/comments/a1/t/,2020-01-02T03:04:05Z,s,Title,,Body",
        "a2,/r/s/comments/a2/t/,2020-01-02T03:04:05Z,s, ,,Body",
        "a3,/r/s/comments/a3/t/,2020-01-02T03:04:05Z,s,Title,,  ",
        "a4,/r/s/comments/other/t/,2020-01-02T03:04:05Z,s,Title,,Body",
        "a5,/r/s/comments/a5/t/,2020-01-02T03:04:05Z,s,[deleted by user],,",
        "a6,/r/s/comments/a6/t/,2020-01-02T03:04:05Z,s,Title",
    ]
    path.write_text("\n".join(lines) + "\n", newline="")
    got = {r.source_id: r for r in archives.csv_records(archives.read_csv(spark, str(path), "posts"), "posts").collect()}
    assert got["a1"].error is None and (got["a1"].title, got["a1"].body, got["a1"].format_confidence) == ("Title", "Body", "provisional")
    assert [got[k].error for k in ("a2", "a3", "a4", "a6")] == ["invalid_record"] * 4
    assert (got["a5"].state, got["a5"].error, got["a5"].title) == ("deleted", None, None)


def test_tweets(spark):
    at = '"created_at": "Wed Oct 10 20:19:24 +0000 2018"'
    body = f"""window.YTD.tweets.part0 = [
      {{"tweet": {{"id_str": "18446744073709551615", "full_text": "a &amp;amp; b", {at}}}}},
      {{"id_str": "2", "id": "3", "full_text": "x", {at}}},
      {{"tweet": {{"id_str": "4", "full_text": "RT @who: said", {at}}}}},
      {{"tweet": {{"id_str": "5", "full_text": "r", "in_reply_to_status_id_str": "4", {at}}}}},
      {{"tweet": {{"id_str": "6", "full_text": "q", "entities": {{"urls": [{{"expanded_url": "https://x.com/u/status/77?s=1"}}]}}, {at}}}}},
      {{"tweet": {{"id_str": "7", "full_text": "d", "created_at": "Thu Oct 10 20:19:24 +0000 2018"}}}},
      {{"tweet": {{"id_str": "8", "full_text": "see  https://t.co/a now", "entities": {{"urls": [{{"url": "https://t.co/a", "expanded_url": "https://x.com/u/status/77"}}]}}, {at}}}}},
      {{"tweet": {{"id_str": "9", "full_text": "r", "in_reply_to_status_id": 4, "entities": {{"urls": [{{"url": "t", "expanded_url": "https://x.com/u/status/77"}}]}}, {at}}}}},
      {{"tweet": {{"id_str": "10", "full_text": "", {at}}}}},
      {{"tweet": {{"id_str": "11", "full_text": "e", "edit_control": {{"edit_tweet_ids": []}}, {at}}}}},
      {{"tweet": {{"id_str": "12", "full_text": "e", "edit_control": {{"edit_tweet_ids": ["1", "12"]}}, {at}}}}}
    ];"""
    gone = f"""window.YTD.deleted_tweets.part0 = [ {{"tweet": {{"id_str": "20", "full_text": "RT @who: said", {at}}}}} ]"""
    entries = spark.createDataFrame([("z", "data/tweets.js", body.encode()), ("z", "d.js", gone.encode()), ("z", "bad.js", b"alert(1)")], "archive string, name string, content binary")
    elements = archives.js_elements(entries)
    assert elements.where("error = 'malformed_wrapper'").count() == 1
    got = {r.revision: r for r in archives.tweets(elements).collect()}
    assert got["18446744073709551615"].body == "a &amp; b" and got["18446744073709551615"].created_at == datetime.datetime(2018, 10, 10, 20, 19, 24)
    assert [got[k].error for k in ("2", "7", "10", "11", "12")] == ["invalid_record", "invalid_record", "invalid_record", "invalid_edit_chain", None]
    assert (got["4"].kind, got["4"].body, got["4"].authorship) == ("repost", "said", "reshared")
    assert (got["5"].kind, got["5"].parent_id, got["5"].relation_confidence) == ("reply", "4", "explicit")
    assert (got["6"].kind, got["6"].quoted_id) == ("post", None)  # a link without its token in the text
    assert (got["8"].kind, got["8"].quoted_id, got["8"].body) == ("quote", "77", "see now")
    assert (got["9"].kind, got["9"].quoted_id, got["9"].parent_id) == ("reply", None, "4")
    assert (got["20"].state, got["20"].kind, got["20"].body, got["20"].error) == ("deleted", "post", None, None)
    assert (got["12"].logical_id, got["12"].chain) == ("1", ["1", "12"])


def test_resolution(spark):
    rows = [("1", ["1", "2"]), ("2", ["1", "2"]), ("3", ["3", "4"]), ("5", ["5"])]
    kept, errors = store.edit_chains(spark.createDataFrame(rows, "revision string, chain array<string>"))
    assert sorted(r.revision for r in kept.collect()) == ["2", "5"]
    assert [(r.head, r.error) for r in errors.collect()] == [("3", "edit_chain_incomplete")]
    copies = [("a", "active", 1), ("a", "deleted", 2), ("b", "active", 1), ("b", "active", 2), ("c", "deleted", 1), ("c", "active", 2), ("d", "active", 1), ("d", "active", 2), ("d", "deleted", 3)]
    got = {r.revision: (r.state, r.conflict) for r in store.duplicate_revisions(spark.createDataFrame(copies, "revision string, state string, ordinal int"), ["revision"]).collect()}
    assert got == {"a": ("deleted", False), "b": ("active", True), "c": ("deleted", False), "d": ("deleted", True)}
    posts = spark.createDataFrame([("1", "active", 5, "Long te…"), ("2", "active", 6, "None…"), ("3", "active", 7, "short")], "revision string, state string, created_at int, body string")
    notes = spark.createDataFrame([(5, "Long text here"), (5, "Other"), (6, "No")], "created_at int, text string")
    got = {r.revision: (r.body, r.text_format, r.error) for r in store.join_notes(posts, notes).collect()}
    assert got == {"1": ("Long text here", "long_form", None), "2": ("None…", "plain", "ambiguous_note_join"), "3": ("short", "plain", None)}


def test_keyed_tables(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, revision int")
    new = spark.createDataFrame([(2, "x", 1), (3, "y", 1), (3, "z", 2)], "k int, v string, revision int")
    assert sorted(r.k for r in store.insert_ignore(table, new, ["k"]).collect()) == [1, 2, 3]
    assert sorted((r.k, r.v) for r in store.upsert(table, new, ["k"], F.col("revision")).collect()) == [(1, "a"), (2, "x"), (3, "z")]
    tried = spark.createDataFrame([(1, "n", 0), (2, "n", 5)], "k int, v string, expected_revision int")
    done, conflicts = store.revise(table, tried, ["k"])
    assert sorted((r.k, r.v, r.revision) for r in done.collect()) == [(1, "n", 1), (2, "b", 0)] and [r.k for r in conflicts.collect()] == [2]
    assert [r.k for r in store.violations(new, ["k"]).collect()] == [3]


def closure(tables, foreign, gone):
    """What goes with `gone`, row by row."""
    found = {(t, r) for t, keys in gone.items() for r in tables[t] if r[0] in keys}
    while True:
        more = {(child, r) for child, k, parent, j in foreign for r in tables[child] if r[k] is not None and any(p == parent and q[j] == r[k] for p, q in found)} - found
        if not more:
            return found
        found |= more


def test_cascade_over_circles_and_diamonds(spark):
    draw = random.Random(4)
    tables = {t: [(k, draw.choice([None, *range(30)]), draw.choice([None, *range(30)])) for k in range(30)] for t in "abc"}
    # a points to itself, b to a by two ways, c to b and a, a to c: a circle.
    foreign = [("a", 1, "a", 0), ("b", 1, "a", 0), ("b", 2, "a", 0), ("c", 1, "b", 0), ("c", 2, "a", 0), ("a", 2, "c", 0)]
    names = ["k", "x", "y"]
    frames = {t: (spark.createDataFrame(rows, "k int, x int, y int"), ["k"]) for t, rows in tables.items()}
    keys = [(c, [names[k]], p, [names[j]]) for c, k, p, j in foreign]
    for gone in ({"a": {3}}, {"b": {1, 2}, "c": {5}}, {"a": {99}}):
        out, left = store.cascade(frames, keys, {t: spark.createDataFrame([(k,) for k in ks], "k int") for t, ks in gone.items()})
        found = closure(tables, foreign, gone)
        assert left == 0
        for t, rows in tables.items():
            assert {tuple(r) for r in out[t].collect()} == {r for r in rows if (t, r) not in found}


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=3), v, max_size=3), max_leaves=10)


def test_canonical_json(spark):
    values = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(JSON)
    def draw(value):
        values.append(value)

    draw()
    whole = [v for v in values if json.dumps(v, ensure_ascii=False).encode("utf-8", "ignore").decode() == json.dumps(v, ensure_ascii=False)]
    rows = [(k, json.dumps(v, indent=1)) for k, v in enumerate(whole)] + [(-1, "no json"), (-2, None), (-3, "NaN"), (-4, "[" * 100_000), (-5, '{"a":1,"a":2}')]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k int, x string").select("k", hashing.canonical_json(F.col("x")).alias("c")).collect()}
    assert all(got[k] == json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for k, v in enumerate(whole)) and len(whole) > 50
    assert [got[-k] for k in range(1, 6)] == [None] * 4 + ['{"a":2}']
    assert hashing.table_hash({"b": [1], "a": "é"}) == hashlib.sha256('{"a":"é","b":[1]}'.encode()).hexdigest()


def test_trims_of_long_white_space_take_linear_time(spark):
    import time

    blanks = "\u3000 \n\t" * 250_000
    frame = spark.createDataFrame([(f"a{blanks}b",), (blanks,), (f"{blanks}x{blanks}",), (None,)], "t string")
    start = time.perf_counter()
    got = [r.t for r in frame.select(text.trim(F.col("t")).alias("t")).collect()]
    assert got == [f"a{blanks}b", "", "x", None]
    assert [r.t for r in frame.select(text.minimize(F.col("t")).alias("t")).collect()] == ["a\n b", "", "x", None]
    assert time.perf_counter() - start < 20


def test_claims_go_by_platform(spark):
    rows = [(1, "x", "f", 2, 1, "running"), (1, "x", "f", 1, 2, "ready"), (1, "reddit", "f", 9, 3, "running"), (2, "x", "f", 9, 4, "queued"), (1, "reddit", "f", 10, 5, "failed"), (1, "reddit", "f", 10, 6, "queued"), (None, "x", None, 1, 7, "queued"), (None, "x", None, 1, 8, "queued")]
    frame = spark.createDataFrame(rows, "tenant_id int, platform string, fingerprint string, claimed_at int, id int, status string")
    assert {r.id: r.outcome for r in store.fingerprint_claims(frame).collect()} == {1: "duplicate", 2: "claimed", 3: "claimed", 4: "claimed", 6: "busy", 7: "claimed", 8: "busy"}


def test_duplicates_are_finished_whole(spark):
    imports = spark.createDataFrame([(1, 1, None, "ready", "a", "f", None, 0), (1, 2, 1, "running", None, "f", None, 0), (1, 3, 9, "running", None, "g", None, 0)], "tenant_id int, import_id int, holder_id int, status string, format string, fingerprint string, finished_at timestamp, record_count long")
    links = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 2, 6)], "tenant_id int, import_id int, content_id int")
    out, all_links, staging = store.finish_duplicates(imports, links, F.to_timestamp(F.lit("2020-01-01")), links.select("tenant_id", "import_id"))
    got = {r.import_id: (r.status, r.format, r.fingerprint, r.finished_at is not None, r.record_count) for r in out.collect()}
    assert got == {1: ("ready", "a", "f", False, 2), 2: ("ready", "a", None, True, 2), 3: ("running", None, "g", False, 0)}
    assert all_links.count() == 4 and {r.import_id for r in staging.collect()} == {1}


def test_imports_without_a_holder_are_not_sent_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(store, "LINKS", 100, raising=False)
    imports = spark.range(1, 401).selectExpr("1 AS tenant_id", "id AS import_id", "CASE WHEN id % 8 = 0 THEN id - 1 END AS holder_id", "'running' AS status", "id AS format", "'f' AS fingerprint", "timestamp '2019-01-01' AS finished_at", "0L AS record_count")
    links = spark.range(1200).selectExpr("1 AS tenant_id", "id % 400 + 1 AS import_id", "id div 400 + id % 2 AS content_id")
    out, all_links, _ = store.finish_duplicates(imports, links, F.to_timestamp(F.lit("2020-01-01")))
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [line for line in plan if "Join LeftOuter" in line and "holder_id" in line]
    own = {k: {n + (k - 1) % 2 for n in range(3)} for k in range(1, 401)}
    wanted = {k: len(own[k] | own[k - 1]) if k % 8 == 0 else 3 for k in own}
    assert {r.import_id: (r.record_count, r.status, r.format) for r in out.collect()} == {k: (n, *(("ready", k - 1) if k % 8 == 0 else ("running", k))) for k, n in wanted.items()}
    assert all_links.count() == sum(wanted.values())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n!。é👨‍👩‍👧", max_size=60), st.integers(1, 12))
def test_segments_lose_nothing(body, most):
    parts = text.segments_of(body, most)
    assert "".join(parts) == body and all(parts)
    assert len(body) > most or parts == [body] * bool(body)


def test_minimize(spark):
    cases = {
        "<p>One</p><p>Two &amp;lt;b&gt;</p>": "One\nTwo",
        "a&#233;&#x41;&#bad;&#66;": "aéA&#bad;&#66;",
        "see http://x.y/z now  \t ok": "see <url> now ok",
        "a\r\n\n\n b <br/>c": "a\nb\nc",
        "é": unicodedata.normalize("NFC", "é"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.m for r in rows.select("t", text.minimize(F.col("t")).alias("m")).collect()}
    assert got["a&#233;&#x41;&#bad;&#66;"] == "aéA&#bad;&#66;" and got["é"] == "é"
    assert got["see http://x.y/z now  \t ok"] == "see <url> now ok" and got["a\r\n\n\n b <br/>c"].split("\n")[-1] == "c"


def test_hmac_and_screening(spark):
    import hashlib
    import hmac

    row = spark.createDataFrame([("msg",)], "m string").select(hashing.hmac_sha256(b"k" * 70, F.col("m")).alias("h")).first()
    assert bytes(row.h) == hmac.new(b"k" * 70, b"msg", hashlib.sha256).digest()
    posts = spark.createDataFrame([(1, "hello"), (2, "  "), (3, "bye")], "post_id int, text string")
    answers = spark.createDataFrame([(1, "hate", 0.1), (1, "drug_use", float("nan")), (3, "hate", 0.2)], "post_id int, concern string, score double")
    hits = scan.screen_hits(scan.screen_plan(posts, ["hate", "drug_use", "other"]), answers).where("escalates").collect()
    assert sorted((r.post_id, r.concern) for r in hits) == [(1, "drug_use"), (3, "drug_use"), (3, "hate")]
    scores = spark.createDataFrame([(1, "hate", 0.85), (1, "negativity", 0.9), (1, "drug_use", 0.5), (2, "hate", 0.2)], "post_id int, concern string, score double")
    assert [(r.post_id, r.concern) for r in scan.primary_concern(scores).collect()] == [(1, "hate")]


def test_unknown_suite(spark):
    with pytest.raises(ValueError):
        archives.gold_cases(spark, "/nowhere", "other")


def test_strict_answers(spark):
    good = '{"schemaVersion": "1", "results": [{"itemIndex": 0, "decision": "no_flag", "risk": "none", "category": null, "confidence": 1, "reasons": [], "evidence": []}]}'
    cases = {
        good: None, f" {good} \n": None, "": "SCAN_OUTPUT_JSON", good + "x": "SCAN_OUTPUT_JSON", good.replace("1,", "NaN,", 1): "SCAN_OUTPUT_JSON",
        f"```{good}```": "SCAN_OUTPUT_JSON", "[]": "SCAN_OUTPUT_SCHEMA", good.replace('"risk": "none", ', ""): "SCAN_OUTPUT_SCHEMA", good.replace("{", '{"x": 1, ', 1): "SCAN_OUTPUT_SCHEMA",
        good.replace("0,", '"0",', 1): "SCAN_OUTPUT_SCHEMA", "[" * 5000: "SCAN_OUTPUT_JSON", good.replace('"category": null, ', ""): None,
        good.replace("itemIndex", "item_index"): "SCAN_OUTPUT_SCHEMA", good.replace("0,", "-1,", 1): "SCAN_OUTPUT_SCHEMA", good.replace(": 1,", ": true,"): "SCAN_OUTPUT_SCHEMA",
        good.replace(": 1,", ": 1e999,"): "SCAN_OUTPUT_JSON", good.replace('"none"', r'"\ud800"'): "SCAN_OUTPUT_JSON", "\u00a0" + good: None,
        good.replace('"none"', '"low", "risk": "none"'): None,
    }
    found = scan.parse_answers(spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string")).collect()
    assert {r.raw: r.error for r in found} == cases | {None: "SCAN_OUTPUT_JSON"}
    assert all((r.answer is None) == (r.error is not None) for r in found)


def test_numbers_are_decoded_like_one_by_one():
    def plainly(x):
        while (at := x.find("&#")) >= 0:
            end = x.find(";", at)
            found = text._character(x[at + 2 : end]) if end >= 0 else None
            if found is None:
                return x
            x = x[:at] + found + x[end + 1 :]
        return x

    for x in ("&#38;#65;&#66;", "&&#35;65;!", "a&#38;#38;#67;", "&#x41;&#;&#66;", "&#38;&#35;65;", "&#1114112;", "no", "&#65", "&#38;#38;#35;68;"):
        assert text._decode_numbers(x) == plainly(x)
    assert text._decode_numbers("&#65;" * 200_000) == "A" * 200_000


def test_packing_with_a_second_cost(spark):
    rows = [(k, 10, 5 if k % 3 else 30) for k in range(60)]
    items = spark.createDataFrame([("s", *r) for r in rows], "scan string, id int, tokens long, other long").repartition(4)
    got = {r.id: (r.batch_ordinal, r.item_index) for r in scan.pack(items, "scan", ["id"], max_items=8, max_tokens=1000, base=0, per_item=0, max_output=8, out=1, also=("other", 50)).collect()}
    batch, index, total, wanted = 0, 0, 0, {}
    for k, _, n in rows:
        if index and (index >= 8 or total + n > 50):
            batch, index, total = batch + 1, 0, 0
        wanted[k] = (batch, index)
        index, total = index + 1, total + n
    assert got == wanted


def test_canonical_numbers_and_texts(spark):
    numbers = {0.0: "0.0", 1.0: "1.0", 0.5: "0.5", 0.001: "0.001", 0.00012: "0.00012", 0.0005: "0.0005", 0.00001: "0.00001", 0.000001: "1e-6", 0.00000125: "1.25e-6"}
    got = spark.createDataFrame([(k,) for k in numbers], "x double").select("x", hashing.json_number(F.col("x")).alias("j")).collect()
    assert {r.x: r.j for r in got} == numbers
    texts = {'a"b': '"a\\"b"', "\\u000B": '"\\\\u000B"', "\x0b\x1f\x01": '"\\u000b\\u001f\\u0001"', "\\\x0b": '"\\\\\\u000b"', "é\n[x]": '"é\\n[x]"', "": '""', None: "null"}
    got = spark.createDataFrame([(k,) for k in texts], "x string").select("x", hashing.json_text(F.col("x")).alias("j")).collect()
    assert {r.x: r.j for r in got} == texts


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "flags")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], "id long, v string")
    sinks.append(one, path, ["id"])
    sinks.append(spark.createDataFrame([(2, "new"), (3, "c"), (None, "m")], "id long, v string"), path, ["id"])
    got = sorted(((r.id, r.v) for r in spark.read.parquet(path).collect()), key=repr)
    assert got == [(1, "a"), (2, "b"), (3, "c"), (None, "m"), (None, "n")]
    sinks.append(one.limit(0), path, ["id"])
    sinks.write_report(one.where("id = 1").withColumn("n", F.lit(None).cast("int")), str(tmp_path / "report"))
    assert [line for f in (tmp_path / "report").glob("*.json") for line in f.read_text().splitlines()] == ['{"id":1,"v":"a","n":null}']
    assert spark.read.parquet(path).count() == 5


def test_ended_imports_free_staging(spark):
    imports = spark.createDataFrame([(1, 1, "parsing", None, "f"), (1, 2, "ready", None, "g"), (2, 1, "parsing", None, "h")], "tenant_id int, import_id int, status string, error_code string, fingerprint string")
    staged = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (2, 1, "z")], "tenant_id int, import_id int, row string")
    ended = spark.createDataFrame([(1, 1, "failed", "e"), (1, 2, "failed", "e")], "tenant_id int, import_id int, status string, error_code string")
    out, left = store.end_imports(imports, staged, ended, F.current_timestamp())
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "failed", "e", None), (1, 2, "ready", None, "g"), (2, 1, "parsing", None, "h")]
    assert [r.row for r in left.collect()] == ["z"]


def test_exit_codes_and_scan_checks(spark):
    from tidemark.operators import evaluate

    rows = spark.createDataFrame([(False, 1, ["x"]), (True, 1, ["x"]), (True, 0, ["x"]), (True, 0, [])], "c boolean, p int, f array<string>")
    assert [r[0] for r in rows.select(evaluate.exit_code(F.col("c"), F.col("p"), F.col("f"))).collect()] == [11, 12, 10, 0]
    scans = spark.createDataFrame([("queued", "complete", 100), ("lost", "none", -1), (None, None, None)], "status string, phase string, progress int")
    assert [r.broken for r in store.broken_checks(scans, store.scan_checks()).collect()] == [[], ["status", "phase", "progress"], []]
