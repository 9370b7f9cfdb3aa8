"""Operators across texts, against SQL or brute force."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, common, components, decontam, neardup, pii, quality, queries, repeats, suffixes, urls

N_ODD = 10


# URL filters ---------------------------------------------------------------------------------------------------------


def test_urls_like_sql(spark, data, same_as_sql):
    same_as_sql(queries.op1_url_filter(spark, data), queries.ORACLE_SQL["op1_url_filter"], data)


def test_aliases_share_decisions(spark):
    pages = [
        (1, "http://bad.net/x", None),
        (2, "http://A.com/1", None),
        (3, "http://b.com/2?q", None),
        (4, "http://c.org/fr/ok", None),
        (5, "http://d.com/", None),
        (6, None, None),
        (7, "no scheme", None),
        (8, "http://EXAMPLE.net/en/", None),
        (8, "http://EXAMPLE.net/en/", None),
        (None, "http://www.example.com/de/a#b", None),
        (9, "https://alone.example/", None),
    ]
    links = [
        ("http://a.com/1", "http://bad.net/x"),
        ("http://b.com/2?q", "http://a.com/1"),
        ("http://d.com/", "http://bad.net/y"),
        ("http://d.com/", "http://c.org/fr/ok"),
        (None, "http://a.com/1"),
        ("http://a.com/1", "http://a.com/1"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = urls.judge(frame, spark.createDataFrame(links, "source string, target string"), queries.OP1_RULES).collect()
    assert len(got) == len(pages)
    by = {r.id: r for r in got}
    assert (by[1].rule, by[1].verdict) == ("net/", "block")
    assert (by[2].host, by[2].rule, by[2].verdict) == ("a.com", None, "block")
    assert by[3].verdict == "block" and by[3].component == by[2].component
    assert (by[4].rule, by[4].verdict, by[5].verdict) == ("org/fr/", "allow", "allow")
    assert (by[6].host, by[6].path, by[6].verdict) == ("", "", "allow")
    assert (by[7].host, by[7].rule) == ("", None)
    assert (by[8].rule, by[8].verdict) == ("example.net/en/", "allow")
    assert (by[None].rule, by[None].verdict) == ("example.com/de/", "block")
    assert by[9].component is None and by[9].verdict == "allow"
    nothing = spark.createDataFrame([], "source string, target string")
    assert urls.judge(frame, nothing, []).where("verdict = 'block'").count() == 0
    assert urls.judge(frame.limit(0), nothing, queries.OP1_RULES).collect() == []


def test_links_of_html(spark):
    page = "http://h.com/a/b?c#d"
    html = """<LINK REL=canonical href='/z?x=1&amp;y=2'><link rel="stylesheet" href="s"><meta http-equiv="Refresh" content="0; URL=q.html">
      <link rel="alternate canonical" href="//o.org/"><meta name=refresh content="url=no">
      <link rel="canonical" data-href="/wrong" href="/right"><link rel=canonical title="a > b href='/no'" href='/yes' href='/second'>"""
    got = urls.html_links(spark.createDataFrame([(page, html), (None, html), (page, None), (page, "")], "url string, html string"))
    assert sorted(r.target for r in got.collect()) == ["http://h.com/a/q.html", "http://h.com/right", "http://h.com/yes", "http://h.com/z?x=1&y=2", "http://o.org/"]


def test_links_of_hostile_pages(spark):
    """Megabytes in a tag, closed or not, in quotes or not, many tags in one, and many quoted values."""
    link, n = '<link rel=canonical href="/a">', 1_000_000
    pages = {
        "closed": f"<meta name=x {'a' * n}>{link}", "open": f"{link}<meta name=x {'a' * n}", "quoted": f"<meta x='{'>' * n}'>{link}", "quote": f"{link}<meta x='{'a' * n}",
        "tags": f"{link}{'<meta ' * (n // 6)}", "blanks": f"<meta a{' ' * n}>{link}", "values": f"<meta {'b=' * 3}{chr(34) * 2 * 100_000}>{link}", "many": f"<meta {'b=' + chr(39) * 2 + ' '}{('c=' + chr(34) * 2 + ' ') * 100_000}>{link}",
        "path": link,
    }
    rows = [(f"http://{k}.org/" + ("p" * n if k == "path" else ""), v) for k, v in pages.items()]
    got = urls.html_links(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted(r.target for r in got) == sorted(f"http://{k}.org/a" for k in pages)


@pytest.mark.parametrize("seed", range(3))
def test_components_like_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 260)]
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    frame = spark.createDataFrame([*edges, *edges[:5], (None, 3), (7, None)], "a int, b int")
    got = components.connected_components(frame).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for n in parent} and len(got) == len(parent)
    assert components.connected_components(frame.limit(0)).collect() == []


# Near duplicates -----------------------------------------------------------------------------------------------------


def similar_by_brute_force(texts, least=0.8):
    """Pairs of ids of different texts that are so similar, in plain Python: sets of word tuples, counted and weighed."""
    bags = {}
    for k, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        bags[k] = collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
    frequency = collections.Counter(s for bag in bags.values() for s in bag)
    rarest = len(texts) / neardup.DEEP
    weight = {s: 1 + math.log((len(texts) + 1) / ((n if n > rarest else rarest) + 1)) for s, n in frequency.items()}
    total = {k: sum(n * weight[s] for s, n in bag.items()) for k, bag in bags.items()}
    holders = collections.defaultdict(list)
    for k, bag in bags.items():
        for s in bag:
            holders[s].append(k)
    shared = collections.Counter()
    for s, ids in holders.items():
        for i, j in itertools.combinations(ids, 2):
            shared[i, j] += min(bags[i][s], bags[j][s]) * weight[s]
    return {p for p, w in shared.items() if texts[p[0]] != texts[p[1]] and w / (total[p[0]] + total[p[1]] - w) >= least}


def classes_by_brute_force(texts):
    """Least id of each id's class, by all pairs."""
    least = {k: k for k in texts}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    first = {}
    equal = {(first.setdefault(t, k), k) for k, t in texts.items()}
    for i, j in similar_by_brute_force(texts) | equal:
        x, y = sorted((find(i), find(j)))
        least[y] = x
    return {k: find(k) for k in texts}


def test_near_duplicates_like_brute_force(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in queries.op3_near_duplicates(spark, data).collect()}
    assert got == classes_by_brute_force(texts)
    assert len(set(got.values())) < len(got)
    kept = neardup.deduplicate(spark.read.parquet(f"{data}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_links_that_bands_miss_are_few(spark, data):
    """Recall of links and classes on a larger table, against all pairs in plain Python."""
    folder = data.replace("0.001", "0.01")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in queries.op3_near_duplicates(spark, folder).collect()}
    pairs = similar_by_brute_force(texts)
    assert len(pairs) >= 10
    assert np.mean([got[i] == got[j] for i, j in pairs]) > 0.995
    wanted = classes_by_brute_force(texts)
    assert all(wanted[k] == wanted[c] for k, c in got.items())  # no class joins what is not linked


def test_frequencies_are_exact(spark, monkeypatch):
    """Blocks of a few texts, over several tasks, give the same table as counting everything."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12))) for _ in range(900)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    from tidemark.llm import shingles

    words = [t.split() for t in texts]
    counts = collections.Counter()
    for w in words:
        counts.update({" ".join(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else ())
    deep = 40
    monkeypatch.setattr(neardup, "DEEP", deep)
    got = neardup.document_frequencies(docs, 2)
    wanted = {s: n for s, n in counts.items() if n > len(texts) / deep}
    hashes, ends = shingles.word_hashes(list(counts))
    for s, a, b in zip(counts, ends[:-1], ends[1:], strict=True):
        n = wanted.get(s, len(texts) / deep)
        assert abs(got.of(shingles.shingle_hashes(hashes[a:b], 2))[0] - (1 + math.log((len(texts) + 1) / (n + 1)))) < 1e-5
    assert len(got.shingles) == len(wanted)


def test_no_frequent_shingle_is_left_out(spark, monkeypatch):
    """Long documents over few words: more frequent shingles than the table once held, all with their own frequency."""
    monkeypatch.setattr(neardup, "TABLE", 100, raising=False)
    rng = random.Random(4)
    words = [[f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 300))] for _ in range(200)]
    counts = collections.Counter()
    for w in words:
        counts.update({" ".join(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else ())
    got = neardup.document_frequencies(spark.createDataFrame([(" ".join(w),) for w in words], "text string").repartition(3), 2)
    from tidemark.llm import shingles

    hashes, ends = shingles.word_hashes(list(counts))
    assert len(got.shingles) == len(counts) > 700
    for n, a, b in zip(counts.values(), ends[:-1], ends[1:], strict=True):
        assert abs(got.of(shingles.shingle_hashes(hashes[a:b], 2))[0] - (1 + math.log(201 / (n + 1)))) < 1e-5


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    a = (hashes[:350], np.ones(350, np.float32))
    b = (hashes[50:], rng.choice(np.array([1, 2], np.float32), 350))
    true = neardup.weighted_jaccard(a, b)
    same = neardup.bands(*a, n_bands=2000, rows=1) == neardup.bands(*b, n_bands=2000, rows=1)
    assert abs(same.mean() - true) < 0.05


def test_near_duplicates_of_odd_texts(odd, none):
    got = neardup.cluster(odd).collect()
    assert len(got) == N_ODD
    assert {r.class_rows for r in got if r.id == 1} == {3}
    assert all(r.class_rows in (1, 3) for r in got)
    empty = {r.class_id for r in got if r.id in (2, 3)}
    assert len(empty) == 1
    assert neardup.cluster(none).collect() == []
    out = neardup.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == len({r.class_id for r in got})
    assert neardup.deduplicate(none).collect() == []


def test_chain_of_versions_is_one_class(spark):
    words = [f"w{k}" for k in range(300)]
    versions = [" ".join(f"new{j}" if j < 6 * k else w for j, w in enumerate(words)) for k in range(8)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(versions)], "doc_id long, text string")
    assert {r.class_id for r in neardup.cluster(docs).collect()} == {0}


# Decontamination -----------------------------------------------------------------------------------------------------


def test_decontamination_like_sql(spark, data, same_as_sql):
    for folder in (data, data.replace("0.001", "0.01")):
        same_as_sql(queries.op4_decontamination(spark, folder), decontam.ORACLE_SQL, folder)


def test_windows_of_items(spark):
    items = [(1, "a b c d e f g h i j k"), (2, "X y"), (3, ""), (4, None), (5, "y x y"), (None, "q"), (2, "X y")]
    docs = [
        (1, "zero A,b;c d e f g h i j end"),
        (2, "b c d e f g h i j k"),
        (3, "a b c d e f g h i"),
        (4, "x y x y x y"),
        (5, None),
        (6, ""),
        (None, "q q"),
        (None, "q q"),
    ]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find(d, i).select("id", "n_words", decontam.hit_words("hits").alias("n"), "items").collect()
    by = {r.id: (r.n_words, r.n, r["items"]) for r in got}
    assert by[1] == (12, 10, ["1"]) and by[2] == (10, 10, ["1"]) and by[3] == (9, 0, None)
    assert by[4] == (6, 6, ["2", "5"]) and by[5] == (0, 0, None) and by[6] == (0, 0, None)
    assert len([r for r in got if r.id is None]) == 2 and by[None][1] == 2
    assert decontam.find(d.limit(0), i).collect() == []
    assert decontam.find(d, i.limit(0)).where("hits is not null").count() == 0
    assert sorted((r.doc_id for r in decontam.remove(d, i).collect())) == [3, 5, 6]


def test_decontamination_uses_no_python(spark, data):
    plan = queries.op4_decontamination(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_decontamination_of_odd_texts(odd, none, spark):
    items = spark.createDataFrame([(1, "the lazy dog and runs into the deep green forest")], "item_id long, text string")
    got = decontam.find(odd, items).collect()
    assert len(got) == N_ODD and sum(r.hits is not None for r in got) == 3
    assert decontam.remove(odd, items).columns == odd.columns and decontam.remove(odd, items).count() == N_ODD - 3
    assert decontam.remove(none, items).collect() == []
    named = odd.withColumn("_decontam_key", F.lit("mine")).withColumn("row", F.lit(7))
    assert {(r["_decontam_key"], r.row) for r in decontam.remove(named, items).collect()} == {("mine", 7)}


def test_hot_keys_are_dealt_out_whole(spark):
    """A join dealt out by hash gives the plain join's rows, of all kinds of joins."""
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"))
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("3", 4), ("none", 5)], "k string, v int")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left", "left_anti", "left_semi"):
        got = common.spread_join(rows, side, "k", counts, "id", how)
        wanted = rows.join(side, "k", how)
        assert got.columns == wanted.columns
        assert sorted(got.collect(), key=str) == sorted(wanted.collect(), key=str)


# Repeats -------------------------------------------------------------------------------------------------------------


def cut_by_brute_force(datas):
    span, seen = suffixes.SPAN, {}
    for d in datas:
        for k in range(len(d) - span + 1):
            seen[d[k : k + span]] = seen.get(d[k : k + span], 0) + 1
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - span + 1):
            if seen[d[k : k + span]] > 1:
                gone[k : k + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out.append((len(d), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def held_against_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(repeats.remove_repeats(docs).collect(), key=lambda r: r.id)
    wanted = cut_by_brute_force([common.utf8(t) for t in texts])
    assert len(got) == len(texts)
    for r, w in zip(got, wanted, strict=True):
        assert (r.n_bytes, [(g["start"], g["end"]) for g in r.removed], bytes(r.kept)) == w


def test_repeats_query_like_brute_force(spark, data):
    """All columns of the query, over all documents."""
    texts = {r.doc_id: common.utf8(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    wanted = dict(zip(texts, cut_by_brute_force(list(texts.values())), strict=True))
    got = queries.op10_repeats(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        size, spans, kept = wanted[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (size, sum(b - a for a, b in spans), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert sum(r.n_spans for r in got) > 20


def test_repeats_at_the_edges(spark, monkeypatch):
    rng = random.Random(2)

    def prose(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage, other = prose(700), prose(900)
    texts = [
        None,
        "",
        prose(199),
        passage[:200],
        prose(50) + passage[:199] + "!",
        prose(31) + passage[100:420] + prose(77),
        prose(3) + passage[300:] + prose(5) + passage[:350],
        "é" * 150 + other,
        other[:450] + "?" + other[450:],
        "ab" * 400,
        "x" * 1000,
        "x" * 250 + "y",
        other[200:401] + prose(10) + other[200:401],
        *[prose(20) + passage[250:500] + prose(20) for _ in range(12)],
    ]
    held_against_brute_force(spark, texts)
    # Slices, runs and parts of a few rows, and every anchor a hot one.
    monkeypatch.setattr(repeats, "SLICE", 300)
    monkeypatch.setattr(repeats, "RUN", 50)
    monkeypatch.setattr(repeats, "PART", 40)
    held_against_brute_force(spark, texts)
    monkeypatch.setattr(repeats, "HOT", 1)
    held_against_brute_force(spark, texts)


def test_repeats_of_odd_texts(odd, none):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == N_ODD and all(r.n_bytes == len(bytes(r.kept)) + sum(g["end"] - g["start"] for g in r.removed) for r in got)
    assert repeats.remove_repeats(none).collect() == []


def test_merge_gives_order_and_prefixes():
    rng = random.Random(4)
    for k in range(60):
        keys = [[bytes(rng.choice(b"ab") if j % 9 == 0 else 97 for j in range(suffixes.KEY)) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 7))]
        runs = [suffixes.Run.unpack(suffixes.make_run(x, np.arange(len(x)) + 100 * i, np.arange(len(x))).pack()) for i, x in enumerate(keys) if x]
        if not runs:
            continue
        sources = [[s for _, s in r.strings()] for r in runs]
        at, out = [0] * len(runs), []
        for run, share, told in suffixes.merge(runs):
            key = sources[run][at[run]]
            assert told == key
            at[run] += 1
            last = out[-1] if out else b""
            assert share == next((j for j, (x, y) in enumerate(zip(key, last, strict=False)) if x != y), len(last))
            out.append(key)
        assert out == sorted(s for x in sources for s in x)
        flat = [x for own in keys for x in own]
        assert len(suffixes.repeated(runs)[0]) == sum(flat.count(x) > 1 for x in flat)


# The pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_is_its_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = quality.train(docs)
    texts = {r.doc_id: r for r in docs.collect() if model.scorer.score(r.text) >= quality.KEEP}
    least = classes_by_brute_force({k: r.text or "" for k, r in texts.items()})
    texts = {k: r for k, r in texts.items() if least[k] == k}
    items = [common.words_of(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = common.words_of(text)
        return not any(tuple(words[k : k + n]) in windows for n in sizes for k in range(len(words) - n + 1))

    texts = {k: r for k, r in texts.items() if clean(r.text)}
    left = spark.createDataFrame(list(texts.values()), docs.schema)
    spans = pii.train(left)
    enc = bpe.encoding(queries.rank_file(), queries.split_pattern())
    got = corpus_pipeline.run(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text = pii.redact_text(texts[r.doc_id].text, spans)
        assert list(r.ids) == enc.encode_ordinary(text or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert (r.lang, r.source) == (texts[r.doc_id].lang, texts[r.doc_id].source)
    assert 0 < len(got) < docs.count()


def test_stages_keep_the_columns(spark, data, odd, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
        assert stage(spark, docs.limit(0), data).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == N_ODD
