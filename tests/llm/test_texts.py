"""Operators on single texts, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, common, langid, license, media, pii, quality, queries, weak

N_ODD = 10


def texts_of(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


# Language ------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark, data):
    got = queries.op2_language(spark, data.replace("0.001", "0.01")).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(data.replace("0.001", "0.01") + "/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in judged]) > 0.9
    assert {r.lang_pred for r in got} <= set(langs.values()) - {None} | {"und"}
    # The same by brute force: a compressor made anew for each text and language, from the sample's dictionaries.
    import zstandard

    docs = spark.read.parquet(data.replace("0.001", "0.01") + "/documents.parquet")
    model = langid.train(spark.createDataFrame([(r.text, r.lang) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1], "text string, lang string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got[:150]:
        if r.lang_pred != "und":
            data_ = langid.plain(texts[r.doc_id])
            sizes = []
            for lang, words in model.dictionaries:
                known = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                sizes.append((len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress(data_)), lang))
            assert dict((b, a) for a, b in sizes)[r.lang_pred] == min(sizes)[0]


def test_no_more_languages_than_stated(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([("one", "a"), ("two", "b"), ("three", "c")], "text string, lang string"))


def test_language_of_odd_texts(odd, none):
    model = langid.train(odd)
    got = langid.identify(odd, model).collect()
    assert len(got) == N_ODD
    assert all(r.lang_pred == "und" and r.score == 0 and not r.accepted for r in got if r.id in (2, 3, 4, 6))
    assert langid.identify(none, model).collect() == []
    nothing = langid.train(none)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_language_rejects_narrow_margins(spark):
    a, b = "alpha beta gamma delta " * 20, "uno dos tres cuatro cinco " * 20
    model = langid.train(spark.createDataFrame([(a, "x"), (b, "y")], "text string, lang string"))
    assert langid.classify("alpha beta gamma delta alpha gamma", model)[0] == "x"
    mixed = langid.classify("zzz qqq", model)
    assert mixed[1] < langid.MARGIN


def test_language_of_only_short_or_long_texts(spark):
    rng = np.random.default_rng(3)
    vocabulary = {x: ["".join(rng.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(40)] for x in ("short", "long", "usual")}

    def texts(x, n, words):
        return [(" ".join(rng.choice(vocabulary[x], words)), x) for _ in range(n)]

    rows = texts("short", 300, 8) + texts("long", 20, 2000) + texts("usual", 300, 100) + [("az", "tiny"), ("12", "none")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    sizes = {lang: len(d) for lang, d in model.dictionaries}
    assert min(sizes[x] for x in vocabulary) > 5000
    assert sizes["tiny"] > 0 and sizes["none"] == 0
    again = langid.train(spark.createDataFrame(rows[::-1] * 2, "text string, lang string").repartition(5))
    assert dict(again.dictionaries) == dict(model.dictionaries)
    for x in vocabulary:
        assert all(langid.classify(t, model)[0] == x for t, _ in texts(x, 20, 10))


# Personal data -------------------------------------------------------------------------------------------------------


def plain_spans(text):
    """The contract's patterns, straight."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.-+0145 ()é٣\n", max_size=60) | st.text(alphabet="0123456789..", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data_query(spark, data):
    texts = texts_of(spark, data)
    for r in queries.op5_personal_data(spark, data).collect():
        base = plain_spans(texts[r.doc_id])
        told = ",".join(":".join(map(str, s)) for s in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert {":".join(map(str, s)) for s in base} <= set(spans) and len(spans) == len(base) + r.n_added


def test_personal_data_of_odd_texts(odd, none):
    model = pii.train(odd)
    assert len(pii.find(odd, model).collect()) == N_ODD
    assert pii.find(none, pii.train(none)).collect() == []
    out = pii.redact(odd, model)
    assert out.columns == odd.columns and out.count() == N_ODD
    assert [r.text for r in out.where("doc_id = 2").collect()] == [None]


def test_redaction_replaces_spans():
    model = pii.Model(weak.fit(np.empty((0, pii.N_LABELLERS), int), np.empty(0)), np.r_[np.zeros(pii.DIMENSIONS), -50])
    assert pii.redact_text("Mail a.b@c.org or +1 415 555 0199 now", model) == "Mail [EMAIL] or [PHONE] now"


def test_added_spans_are_those_planted(spark):
    """Secrets and phones in other forms are found, numbers that fail the card checksum are not; held-out texts."""
    rng = np.random.default_rng(8)

    def text(k):
        filler = " ".join(f"word{x}" for x in rng.integers(0, 50, 12))
        secret = "".join(rng.choice(list("0123456789abcdef"), 40))
        digits = "".join(map(str, rng.integers(0, 10, 16)))
        digits = digits if not pii.luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1) % 10)
        good = "4111111111111111"
        return [f'{filler} token = "{secret}" {filler}', f"{filler} call (415) 555-{k % 9000 + 1000} {filler}", f"{filler} {digits} {filler}", f"{filler} card {good} {filler} mail a{k}@b.org"][k % 4]

    rows = [(k, text(k)) for k in range(800)]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    held_out = [(k, text(k)) for k in range(1000, 1400)]
    got = {r.id: [a.kind for a in r.added] for r in pii.find(spark.createDataFrame(held_out, "doc_id long, text string"), model).collect()}
    for k in got:
        assert got[k] == [["secret"], ["phone"], [], []][k % 4]


def test_long_digits_take_linear_time():
    import time

    start = time.time()
    for t in ("1" * 500_000, "1." * 250_000, "+1" + " " * 500_000, "a@" * 200_000, "A" * 500_000, "1 " * 250_000):
        base = pii.base_spans(t)
        pii.candidates(t, base)
    assert time.time() - start < 30


def test_candidates_touch_no_base_span():
    text = "x 10.0.0.1 y +1 415 555 0199 4111 1111 1111 1111 token=" + "ab12" * 12 + " 123-45-6789"
    base = pii.base_spans(text)
    for _, a, b in pii.candidates(text, base):
        assert all(b <= x or a >= y for _, x, y in base)
    assert pii.candidates("123-45-6789", [("ip", 0, 11), ("card", 1, 2)]) == []


def test_votes_weigh_labellers():
    """Two labellers that agree with the truth outweigh one that votes at random."""
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) for p in (0.95, 0.9, 0.5)], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak.fit(patterns, counts)
    right, good, blind = model.reliability()
    assert right > 0.85 and good > 0.8 and 0.4 < blind < 0.6
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.9


# Tokens --------------------------------------------------------------------------------------------------------------


def test_tokens_are_those_of_the_whole_text(spark, data):
    enc = bpe.encoding(queries.rank_file(), queries.split_pattern())
    texts = texts_of(spark, data)
    for r in queries.op6_byte_bpe(spark, data).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 1.'\n\té東s", max_size=80), st.integers(1, 9))
def test_cuts_change_no_token(text, most):
    enc = bpe.encoding(queries.rank_file(), queries.split_pattern())
    cut = list(bpe.pieces(text, most))
    assert "".join(cut) == text
    assert [x for p in cut for x in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab  \n\n\t\u3000漢字١é's!", max_size=120), st.integers(1, 5))
def test_matches_encoded_one_by_one_are_the_whole(text, most):
    ranks, pattern = queries.rank_file(), queries.split_pattern()
    assert bpe.encode_text(text, ranks, pattern, most) == bpe.encoding(ranks, pattern).encode_ordinary(text)


@pytest.mark.parametrize("unit", [" ", "a", "漢", "\n", "1", "!", "\u3000", " \t", "漢字かな、", "é"])
def test_very_long_runs(unit):
    """2 million characters without a safe boundary: no crash, and what the library says where it can answer."""
    ranks, pattern = queries.rank_file(), queries.split_pattern()
    enc, text = bpe.encoding(ranks, pattern), (unit * 2_000_000)[:2_000_000]
    ids = bpe.encode_text(text, ranks, pattern)
    assert enc.decode_bytes(ids) == text.encode()
    part = text[:150_000]
    if unit.strip():
        assert bpe.encode_text(part, ranks, pattern) == enc.encode_ordinary(part)


def test_tokens_of_odd_texts(odd, none):
    ranks, pattern = queries.rank_file(), queries.split_pattern()
    got = bpe.decode(bpe.encode(odd, ranks, pattern), ranks, pattern).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted(common.utf8(r.text) for r in odd.collect())
    assert bpe.decode(bpe.encode(none, ranks, pattern), ranks, pattern).collect() == []


def test_tokens_and_bytes_in_one_step(spark, odd, none, data):
    """A task's ranks are held by one Python worker; the rows are those of the two steps."""
    ranks, pattern = queries.rank_file(), queries.split_pattern()
    rows = lambda d: sorted(map(repr, d.select("id", "ids", "decoded").collect()))
    assert rows(bpe.encode_decode(odd, ranks, pattern)) == rows(bpe.decode(bpe.encode(odd, ranks, pattern), ranks, pattern))
    assert bpe.encode_decode(none, ranks, pattern).collect() == []
    docs = common.table(spark, data, "documents")
    for out in (queries.op6_byte_bpe(spark, data), corpus_pipeline.bpe_stage(spark, docs, data)):
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


# Batches -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("length", [20_000, 200_000])
def test_python_steps_hold_few_bytes_at_once(spark, length):
    """However long the texts are: without a limit a slice of 256 of them would be 5 and 51 MB."""
    docs = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), length).alias("text"))
    got = common.map_batches(docs, "n long", lambda x: {"n": [sum(map(len, x["text"]))]}).collect()
    assert sum(r.n for r in got) == 300 * length
    assert max(r.n for r in got) <= common.BATCH + length


def test_a_limit_of_the_session_stays(spark):
    before = spark.conf.get(common.BATCH_SETTING, None)
    spark.conf.set(common.BATCH_SETTING, "12345678")
    try:
        common.map_batches(spark.range(3), "n long", lambda x: {"n": x["id"]}).collect()
        assert spark.conf.get(common.BATCH_SETTING) == "12345678"
    finally:
        spark.conf.unset(common.BATCH_SETTING)
        if before is not None:
            spark.conf.set(common.BATCH_SETTING, before)


# Quality -------------------------------------------------------------------------------------------------------------


def test_quality_finds_the_labels(spark, data):
    folder = data.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op7_quality(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.quality is not None}
    assert len(got) == 1000
    good = [got[k].keep for k, q in labels.items() if q == 1 and k in got]
    bad = [got[k].keep for k, q in labels.items() if q == 0 and k in got]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_accuracies_are_estimated(spark, data):
    """The chances that EM finds without labels are those that the labels give, class by class; and the posteriors are
    those of a plain EM.
    """
    folder = data.replace("0.001", "0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet")).labellers
    votes = {k: quality.votes_of(t) for k, t in texts.items()}
    no = model.priors[:-1] / model.priors[:-1].sum()
    for j in range(len(quality.LABELLERS)):
        for q, told in ((1, model.chances[j, -1, 0]), (0, no @ model.chances[j, :-1, 0])):
            cast = [votes[k][j] for k, y in labels.items() if y == q and k in votes and votes[k][j] >= 0]
            if len(cast) > 30:
                assert abs(np.mean(cast) - told) < 0.15
    plain = plain_em(list(votes.values()), quality.KINDS)
    assert np.allclose(plain, model.posterior(np.array(list(votes.values()))), atol=1e-3)


def plain_em(votes, kinds, rounds=500):
    """The same model row by row, in plain Python."""
    classes = len(kinds) + 1
    belief = []
    for v in votes:
        cast = [x for x in v if x >= 0]
        yes = (sum(cast) / len(cast) if cast else 0.5) * 0.9 + 0.05
        spoken = [sum(v[j] == 0 for j in k) + 0.1 for k in kinds]
        belief.append([(1 - yes) * s / sum(spoken) for s in spoken] + [yes])
    for _ in range(rounds):
        priors = [sum(b[c] for b in belief) / len(votes) for c in range(classes)]
        chance = {}
        for j in range(len(votes[0])):
            for c in range(classes):
                n = [1 + sum(b[c] for v, b in zip(votes, belief, strict=True) if v[j] == x) for x in (0, 1)]
                chance[j, c] = (n[0] / sum(n), n[1] / sum(n))
        before, belief = belief, []
        for v in votes:
            p = [priors[c] * np.prod([chance[j, c][x] for j, x in enumerate(v) if x >= 0]) for c in range(classes)]
            belief.append([x / sum(p) for x in p])
        if max(abs(a - b) for x, y in zip(before, belief, strict=True) for a, b in zip(x, y, strict=True)) < 1e-6:
            break
    return [b[-1] for b in belief]


def test_scorer_is_its_plain_twin(spark, data):
    """Slots, learning and scores against plain Python; and the scorer sees texts alone, whatever labellers would say."""
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(40).collect()] + ["", "ab", None, "a a a b a"]

    def plain_slots(text):
        data, words, out = (text or "").encode(), common.words_of(text), {}
        runs = [data[k] << 16 | data[k + 1] << 8 | data[k + 2] for k in range(len(data) - 2)]
        far = []
        for k, w in enumerate(words):
            before = [j for j in range(k) if words[j] == w]
            far.append((1 << 24) + min((k - before[-1]).bit_length() if before else quality.FAR, quality.FAR))
        for own in (runs, far):
            for x in own:
                slot = (x * 0x9E3779B1 & 0xFFFFFFFF) >> 16
                out[slot] = out.get(slot, 0.0) + 1 / len(own)
        return out

    each = [plain_slots(t) for t in texts]
    for t, want in zip(texts, each, strict=True):
        slots, parts = quality.hashed(t)
        assert slots.tolist() == sorted(want) and np.allclose(parts, [want[k] for k in sorted(want)])
    labels = np.array([k % 3 / 2 for k in range(len(texts))])
    got = quality.train_scorer([quality.hashed(t) for t in texts], labels, epochs=5)
    share = [0.5 / labels.sum() if y > 0.5 else 0.5 / (1 - labels).sum() for y in labels]
    w, gw, bias, gb = {}, {}, 0.0, 1e-10
    for _ in range(5):
        error = []
        for own, y, c in zip(each, labels, share, strict=True):
            margin = bias + sum(w.get(k, 0.0) * v for k, v in own.items())
            error.append((1 / (1 + np.exp(-margin)) - y) * c)
        grad = {k: 1e-6 * v for k, v in w.items()}
        for own, e in zip(each, error, strict=True):
            for k, v in own.items():
                grad[k] = grad.get(k, 0.0) + e * v
        for k, g in grad.items():
            gw[k] = gw.get(k, 1e-10) + g * g
            w[k] = w.get(k, 0.0) - g / gw[k] ** 0.5
        gb += sum(error) ** 2
        bias -= 0.3 * sum(error) / gb**0.5
    assert abs(bias - got.bias) < 1e-6 and np.allclose([w[k] for k in sorted(w)], got.weights[sorted(w)], atol=1e-4)
    for t, own in zip(texts, each, strict=True):
        assert abs(got.score(t) - 1 / (1 + np.exp(-bias - sum(w[k] * v for k, v in own.items())))) < 1e-4


def test_quality_of_odd_texts(odd, none):
    model = quality.train(odd)
    assert len(quality.judge(odd, model).collect()) == N_ODD
    assert quality.keep_good(odd, model).columns == odd.columns
    assert quality.judge(none, quality.train(none)).collect() == []
    assert quality.keep_good(none, quality.train(none)).collect() == []


# Transport streams ---------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 2**32 - 1))
def test_streams_round_trip(blocks, seed):
    payload = np.random.default_rng(seed).integers(0, 256, blocks * media.BLOCK, dtype=np.uint8).tobytes()
    ts = media.mux(payload)
    found = media.demux(ts)
    assert len(ts) % media.PACKET == 0 and found.data == payload
    assert not (found.counter_errors or found.table_errors or found.sync_errors)
    assert [u[0] for u in found.units] == [k * media.UNIT * media.BLOCK * media.CLOCK // media.RATE for k in range(len(found.units))]
    assert all(u[1] for u in found.units) and found.clocks == [u[0] for u in found.units]


def read_plainly(ts):
    """(payload, timestamps, clocks) by another reader: all packets by PID first, then sections and elementary packets."""
    by = {}
    for k in range(0, len(ts), 188):
        p = ts[k : k + 188]
        head = int.from_bytes(p[:4], "big")
        assert head >> 24 == 0x47 and head >> 4 & 1
        pid, body, field = head >> 8 & 0x1FFF, p[4:], b""
        if head >> 5 & 1:
            field, body = body[1 : 1 + body[0]], body[1 + body[0] :]
        by.setdefault(pid, []).append((head >> 22 & 1, head & 15, field, body))
    for each in by.values():
        assert [c for _, c, _, _ in each] == [k % 16 for k in range(len(each))]
    pmt = {int.from_bytes(b[11:13], "big") & 0x1FFF for _, _, _, b in by[0]}
    pid = {int.from_bytes(b[14:16], "big") & 0x1FFF for q in pmt for _, _, _, b in by[q]}
    assert len(pmt) == len(pid) == 1
    units, clocks = [], []
    for start, _, field, body in by[pid.pop()]:
        if start:
            units.append(b"")
            assert field[0] == 0x50
            clocks.append(int.from_bytes(field[1:7], "big") >> 15)
        units[-1] += body
    stamps = []
    for u in units:
        bits = "".join(f"{x:08b}" for x in u[9:14])
        stamps.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
        assert len(u) == 6 + int.from_bytes(u[4:6], "big")
    return b"".join(u[9 + u[8] :] for u in units), stamps, clocks


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 200), st.integers(0, 2**32 - 1))
def test_streams_read_by_another_reader(blocks, seed):
    payload = np.random.default_rng(seed).integers(0, 256, blocks * 576, dtype=np.uint8).tobytes()
    got, stamps, clocks = read_plainly(media.mux(payload))
    found = media.demux(media.mux(payload))
    assert got == payload and stamps == clocks == [u[0] for u in found.units] == found.clocks


def test_any_access_unit_is_a_start():
    """A reader that comes in at a later unit's tables gets the rest of the payload."""
    payload = np.random.default_rng(2).integers(0, 256, 3 * media.UNIT * 576, dtype=np.uint8).tobytes()
    ts = media.mux(payload)
    starts = [k for k in range(0, len(ts), 188) if ts[k + 1 : k + 3] == b"\x40\x00"]
    assert len(starts) == 3
    assert [media.demux(ts[k:]).data for k in starts] == [payload[k * media.UNIT * 576 :] for k in range(3)]


def test_damage_is_counted():
    ts = media.mux(bytes(range(256)) * 9)
    lost = ts[: 5 * media.PACKET] + ts[6 * media.PACKET :]
    assert media.demux(lost).counter_errors == 1
    bad = bytearray(ts)
    bad[10] ^= 1
    assert media.demux(bytes(bad)).table_errors >= 1
    bad = bytearray(ts)
    bad[3 * media.PACKET] = 0
    assert media.demux(bytes(bad)).sync_errors == 1
    assert media.demux(b"").data == b"" and media.demux(ts[:100]).sync_errors == 1
    with pytest.raises(ValueError):
        media.mux(b"x")


def test_table_checksum():
    """The checksum of the standard's test string."""
    assert media.mpeg_crc(b"123456789") == 0x0376E6E7


def test_streams_query(spark, data, odd, none):
    texts = texts_of(spark, data)
    for r in queries.op8_transport_stream(spark, data).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        ts = media.mux(payload)
        assert r.media_sha256 == hashlib.sha256(ts).hexdigest() and r.media_bytes == len(ts)
        stamps = [k * media.UNIT * 576 * 90_000 // 48_000 for k in range(-(-len(payload) // (media.UNIT * 576)))]
        told = dict(x.split("=") for x in r.feature.split(";"))
        samples = np.frombuffer(payload, np.uint8)
        assert [int(told[k]) for k in ("units", "random_access", "clocks", "pts_sum", "last_pts", "errors", "packets", "distinct")] == [
            *[len(stamps)] * 3, sum(stamps), stamps[-1], 0, len(ts) // 188, len(set(payload))
        ]
        assert abs(float(told["mean"]) - samples.mean()) < 1e-5 and abs(float(told["deviation"]) - samples.std()) < 1e-5
    assert media.read_streams(media.write_streams(odd)).count() == N_ODD
    assert media.read_streams(media.write_streams(none)).collect() == []


# Licenses ------------------------------------------------------------------------------------------------------------


def test_license_query_like_sql(spark, data, same_as_sql):
    for folder in (data, data.replace("0.001", "0.01")):
        same_as_sql(queries.op9_license_scan(spark, folder), queries.ORACLE_SQL["op9_license_scan"], folder)


def test_license_of_odd_texts(odd, none):
    assert license.scan(odd).count() == N_ODD
    assert license.scan(none).collect() == []
    assert license.scan(odd, templates={}, phrases={}).count() == N_ODD


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdefgh"), min_size=1), min_size=1, max_size=5), st.sets(st.sampled_from("abcdefgh")), st.floats(0.3, 1.0))
def test_prefix_filters_lose_nothing(sets, block, threshold):
    named = {str(k): frozenset(x.encode() for x in s) for k, s in enumerate(sets)}
    words = frozenset(x.encode() for x in block)
    index = license.Index(named, {b"a": 5, b"b": 1}, threshold)
    wanted = [(k, len(words & s) / len(s)) for k, s in sorted(named.items()) if len(words & s) >= license.needed(len(s), threshold)]
    assert index.match(words) == wanted


def license_labels(spark, *texts):
    """The labels chosen for each text."""
    rows = [(k, t) for k, t in enumerate(texts)]
    found = license.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("id").collect()
    return [{queries.OP9_LABELS[c] for c in r.chosen} for r in found]


def test_every_window_over_the_threshold_matches(spark):
    """Against all windows of every template, of texts drawn from the templates' own words."""
    import random

    draw, words = random.Random(6), {n: [w.decode() for w in common.words_of(t)] for n, t in license.TEMPLATES.items()}
    texts = ["This work is licensed under the GNU Public License, version 2", license.TEMPLATES["gpl-header"].replace("General Public", "GPL General")]
    for _ in range(150):
        own = words[draw.choice(sorted(words))]
        body = [w for w in own if draw.random() > draw.choice((0, 0.1, 0.25))]
        for _ in range(draw.randint(0, 6)):
            body.insert(draw.randint(0, len(body)), draw.choice(("and", "x", "license", "version")))
        texts.append(" ".join([*["so"] * draw.randint(0, 9), *body, "end"]))
    rows = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("id").collect()
    for r, t in zip(rows, texts, strict=True):
        own, wanted = [w.decode() for w in common.words_of(t)], {}
        for n, template in words.items():
            some = set(template)
            most = max((len(some & set(own[k : k + 2 * len(template)])) for k in range(len(own))), default=0)
            if most >= (len(some) if len(some) < 10 else 0.8 * len(some)):
                wanted[n] = most / len(some)
        got = {}
        for m in r.matches:
            got[m.label] = max(m.containment, got.get(m.label, 0))
        assert got == wanted, t
    assert {m.label for m in rows[0].matches} >= {"gpl-2.0"} and {m.label for m in rows[1].matches} >= {"gpl-header"}


def test_wrapped_license_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not"
    grant = "# Permission is hereby granted, free of charge, to any\n# person obtaining a copy\n# of this software and"
    filler = "\n".join(f"line {k} of the text" for k in range(300))
    found = license_labels(spark, bsd, mpl, grant, f"{filler}\n{bsd}\n{filler}\n{mpl}", bsd.replace("\n", "\r\n\r\n"), filler)
    assert found == [{"bsd"}, {"mpl"}, {"mit"}, {"bsd", "mpl"}, {"bsd"}, set()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdxyz"), max_size=30), st.integers(1, 8), st.integers(1, 4))
def test_windows_are_those_of_brute_force(letters, length, least):
    words, template = [x.encode() for x in letters], frozenset((b"a", b"b", b"c", b"d"))
    fits = {k: n for k in range(len(words)) if (n := len(template.intersection(words[k : k + length]))) >= least}
    got = license.windows(words, template, length, least)
    assert bool(got) == bool(fits) and all(fits[k] == n for k, n in got)
    assert max((n for _, n in got), default=0) == max(fits.values(), default=0)


def test_license_templates_are_told_apart(spark):
    other = ["Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0.", "Released under the Apache License"]
    other += ["Released under the GNU General Public License", "Released under the Apache License by MIT researchers"]
    other += ["This work is licensed under the Eclipse Public License, version 2", "This work has been released into the public"]
    found = license_labels(spark, *other)
    assert found == [{"cc-by"}, {"cc-by-nc"}, set(), set(), {"mit"}, {"epl"}, set()]  # the last but two has all words of a notice
    fsf = "you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."
    long = [f"# This program is free software; {fsf.format(x)}".replace("terms of", "terms of\n#") for x in ("General", "Lesser General", "Affero General")]
    assert license_labels(spark, *long) == [{"gpl"}, {"lgpl"}, {"agpl"}]
    kept = ["Licensed under the Apache License, version 2.0", "Released under the terms of the MIT License", "This work is licensed under the GNU General Public Licence, version 2"]
    assert license_labels(spark, *kept) == [{"apache"}, {"mit"}, {"gpl"}]
    scattered = " and so on ".join("released under the sun is all that MIT and others say of any license".split())
    assert license_labels(spark, scattered * 9) == [set()]
