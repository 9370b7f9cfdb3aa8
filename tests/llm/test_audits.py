"""Operators 11 to 13: filter audit, whitening, toxicity."""

import collections
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audit, queries, toxicity, whitening

LABELS = "doc_id long, quality int, toxic int"


def test_audit_like_sql(spark, data, same_as_sql):
    same_as_sql(queries.op11_filter_audit(spark, data), queries.ORACLE_SQL["op11_filter_audit"], data)


def audited_plainly(docs, labels):
    """Every order applied to every document, filter by filter."""
    import re

    rows = []
    for k, (doc_id, text, part) in enumerate(docs):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = any(d is not None and doc_id is not None and d < doc_id and (t or "") == text for d, t, _ in docs)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": same,
        }
        good, toxic = (any(r[0] == doc_id and doc_id is not None and r[j] == 1 for r in labels) for j in (1, 2))
        rows.append((part or "", fails, good, toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, now = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                shapley[f] += len(gone)
                out.append([part, "".join(order), step, len(now), len(gone), sum(r[1][f] for r in own) - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone), f])
                left = now
        for r in out:
            if r[0] == part:
                r[-1] = shapley[r[-1]]
    return sorted(map(tuple, out))


def audited(docs, labels):
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return sorted(tuple(r[n] for n in names) for r in audit.audit(audit.flagged(docs, labels), "ABCDE", ("good", "toxic")).collect())


def test_audit_like_every_order_applied(spark):
    prose = " ".join(f"w{k}" for k in range(60))
    docs = [
        (1, prose, "a"), (2, prose, "a"), (2, prose, "b"), (3, prose + " #", "a"), (4, "ABC " * 60, "a"), (5, "x y", None), (None, prose, ""),
        (None, None, None), (6, None, "b"), (7, "", "b"), (8, "a b c", "b"), (9, "é" * 19 + "É" + "A", "b"), (10, "w " * 100, "a"), (11, "A$B", "a"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, None), (4, None, 1), (None, 1, 1), (10, 1, 0), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, key int")
    assert audited(frame, spark.createDataFrame(labels, LABELS)) == audited_plainly(docs, labels)


def test_audit_of_a_text_that_half_of_all_rows_have(spark):
    draw = np.random.default_rng(3)
    docs = [(int(k), "same text" if draw.random() < 0.5 else f"text {k % 1900}", "hot" if draw.random() < 0.4 else f"s{k % 5}") for k in draw.permutation(5000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    first = {}
    for k, t, _ in docs:
        first[t] = min(k, first.get(t, k))
    got = {r["part"]: r["removed"] for r in audit.audit(audit.flagged(frame, spark.createDataFrame([], LABELS)), "ABCDE").where("filter_order = 'EABCD' AND step = 1").collect()}
    assert got == {p: sum(k > first[t] for k, t, q in docs if q == p) for p in {d[2] for d in docs}}


def test_audit_of_odd_texts(odd, none, spark):
    labels = spark.createDataFrame([], LABELS)
    got = audited(odd, labels)
    assert got == audited_plainly([(r.doc_id, r.text, r.source) for r in odd.collect()], [])
    assert audited(none, labels) == []


# Whitening --------------------------------------------------------------------------------------------------------------


def whitened_plainly(vectors, k):
    """n, deviations, eigenvectors and their values, in whole numbers and numpy's own decomposition."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))) for r in x]
    centred = (x * n - sums).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, deviation, centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def held_against(rows, wanted, k):
    n, deviation, coordinates, explained = wanted
    got = {(r["id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(deviation) * k and {r["n"] for r in rows} <= {n}
    for j in range(1, k + 1):
        each = np.array([got[i, j]["whitened"] for i in range(len(deviation))])
        sign = np.sign(each @ coordinates[:, j - 1])
        assert np.abs(each * sign - coordinates[:, j - 1]).max() < 1e-7
        assert all(abs(got[i, j]["explained"] / explained[j - 1] - 1) < 1e-9 for i in range(len(deviation)))
    assert [got[i, 1]["deviation"] for i in range(len(deviation))] == deviation
    assert all(r["identity_error"] <= 1e-8 for r in rows)


def test_whitening_of_the_table_like_numpy(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").where("embedding IS NOT NULL").orderBy("vec_id").collect()
    found = [r.asDict() | {"id": r["vec_id"]} for r in queries.op12_whitening(spark, data).collect()]
    place = {r["vec_id"]: k for k, r in enumerate(rows)}
    held_against([f | {"id": place[f["id"]]} for f in found], whitened_plainly([r["embedding"] for r in rows], 8), 8)


@pytest.mark.parametrize("size, most, k", [(3, 8, 3), (130, 8, 8), (1, 2, 1)])
def test_whitening_of_drawn_vectors(spark, size, most, k):
    draw = np.random.default_rng(size)
    scales = np.linspace(4, 1, size)
    vectors = (draw.normal(size=(700, size)) * scales + 300).astype(np.float32)
    rows = [(i, v.tolist(), None) for i, v in enumerate(vectors)]
    bad = [(-1, None, 0), (-2, [None] + [1.0] * (size - 1), 0), (-3, [float("nan")] * size, 0), (-4, [float("-inf")] * size, 0), (-5, [1.0] * (size + 1), 0), (-6, [], 0)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, id int").repartition(5)
    held_against([r.asDict() for r in whitening.whiten(frame, most).collect()], whitened_plainly(vectors, k), k)


def test_whitening_without_vectors_and_of_equal_or_flat_ones(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect() == []
    # Two dimensions that vary as one have a single component; a row without an id has its rows too.
    found = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (None, [1.0, 2.0]), (1, [2.0, 4.0])], schema)).collect()
    assert [(r["id"], r["component"]) for r in sorted(found, key=lambda r: (r["id"] or 0, r["whitened"]))] == [(None, 1), (1, 1), (1, 1)]
    assert abs(found[0]["explained"] - 1) < 1e-12


def test_whitening_of_deviations_beyond_a_double(spark):
    vectors = [[k / 2, float(k * k % 97), 900.0 * (k == 1500)] for k in range(3000)]
    found = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), 3).collect()
    wanted = whitened_plainly(vectors, 3)
    assert max(wanted[1]) > 1 << 62 and max(wanted[1]) < 1 << 63
    held_against([r.asDict() for r in found], wanted, 3)


# Toxicity ---------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op13_toxicity(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").collect()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in got.items())
    told = {y: [got[r.doc_id].predicted for r in labels if r.toxic == y and got[r.doc_id].held_out] for y in (0, 1)}
    assert np.mean(told[1]) >= 0.93 and np.mean(told[0]) <= 0.05


def test_toxicity_learns_no_held_out_label(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    models = [toxicity.train(docs.where(~out), labels.withColumn("toxic", F.when(out, x).otherwise(F.col("toxic"))).where(~out)) for x in (0, 1)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias


def test_toxicity_risk_goes_down_and_stays_true(spark):
    """The trained risk on drawn words against that of the best weights of one word."""
    draw = np.random.default_rng(5)

    def row(toxic, yes):
        words = {int(w) for w in draw.integers(0, 50, 12)} | ({60 + int(draw.integers(0, 3))} if toxic else set())
        return yes, np.array(sorted(words)), np.ones(len(words), int)

    rows = [row(True, True) for _ in range(200)] + [row(k % 5 == 0, False) for k in range(1000)]
    model = toxicity.learn(rows, 0.2)
    weights = dict(zip(model.slots, model.weights, strict=True))

    def says(slots):
        return model.bias + sum(weights.get(s, 0.0) * np.log(2) for s in slots) > np.log(0.3 / 0.7)

    assert np.mean([says(row(True, True)[1]) for _ in range(300)]) > 0.99 and np.mean([says(row(False, False)[1]) for _ in range(300)]) < 0.01


def test_toxicity_features_are_those_of_each_word(monkeypatch):
    """Against one word at a time, in pieces of several sizes."""
    draw = np.random.default_rng(8)
    texts = [" ".join("".join(draw.choice(list("abé"), draw.integers(1, 9))) for _ in range(draw.integers(0, 40))) for _ in range(30)] + [None, "", "x" * 300, "a b " * 90]

    def plainly(text):
        found = collections.Counter()
        for w in set((text or "").encode().split()):
            _, h = toxicity.word_hashes(b" " + w + b" ")
            for n, x in enumerate(h[0].tolist()):
                if n == 0 or len(w) >= toxicity.BEGINNINGS[n - 1]:
                    found[(((x ^ (toxicity.WHOLE if n == 0 else 0)) * int(toxicity._MIX)) % (1 << 64)) >> 44] += 1
        return found

    for piece in (50, 400, 1 << 20):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        text, slots, counts = toxicity.features(texts)
        for k, t in enumerate(texts):
            assert dict(zip(slots[text == k].tolist(), counts[text == k].tolist(), strict=True)) == plainly(t)


def test_toxicity_of_odd_texts(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["id"] in (2, 3, 4, 6)}) == 1
    assert toxicity.score(none, model).collect() == []
    for docs, told in ((none, labels), (odd, labels.where("false"))):
        quiet = toxicity.train(docs, told)
        assert all(r["score"] < 0.01 for r in toxicity.score(odd, quiet).collect())
