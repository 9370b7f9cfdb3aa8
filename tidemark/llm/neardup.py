"""Near duplicates by improved consistent weighted sampling over TF-IDF word shingles.

Each distinct text is a weighted set: its five-word shingles, weighted by count and by inverse document frequency.
HASHES consistent weighted samples of it agree between two texts as often as their weighted Jaccard similarity; they
are banded, texts that share a band are candidates, and candidates are linked if their exact weighted Jaccard
similarity reaches the threshold. Classes are the connected components of links.

Candidates are verified in rounds that follow the links found: first each text against the most connected text that
it shares a band with, then each band's texts against that band's most connected text. Pairs already in one class need
no check, so a large group of copies costs a check or two a text. The texts of bands that still hold several classes
are joined by their rarest shingles, with bounds that no pair over the threshold can miss; so no link between different
classes goes unchecked, and no band's pairs are all made.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles
from .components import connected_components

WORDS, THRESHOLD = 5, 0.8
#: 16 bands of 4 samples: at similarity 0.8 a pair shares none with a chance of 1 in 5,000.
BANDS, ROWS = 16, 4
#: Shingles of more than one in DEEP documents have their own document frequency; rarer ones all count as that rare.
DEEP = 400
#: Texts and shingles that a task counts at once.
BLOCK = (4096, 1 << 22)
#: Ratio of the steps of size by which texts meet in the last round.
STEP = 1.1


@dataclass(frozen=True)
class Weights:
    """Inverse document frequency, 1 + ln((documents + 1) / (frequency + 1)): of frequent shingles (sorted), of others."""

    shingles: np.ndarray
    weights: np.ndarray
    other: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(hashes), self.other, np.float32)
        at = np.minimum(np.searchsorted(self.shingles, hashes), len(self.shingles) - 1)
        return np.where(self.shingles[at] == hashes, self.weights[at], np.float32(self.other)).astype(np.float32)


def _idf(frequency: np.ndarray, documents: int) -> np.ndarray:
    return (1 + np.log((documents + 1) / (frequency + 1))).astype(np.float32)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, different shingles, in how many of these texts each is) of a task's texts, some thousands at once."""
    each: list[np.ndarray] = []
    texts = total = 0

    def counted() -> tuple[int, np.ndarray, np.ndarray]:
        hashes, n = np.unique(np.concatenate([np.empty(0, np.uint64), *each]), return_counts=True)
        return texts, hashes, n

    for batch in common.slices(batches):
        hashes, ends = shingles.word_hashes(batch.column(0).to_pylist())
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            each.append(np.unique(shingles.shingle_hashes(hashes[a:b], size)))
            texts, total = texts + 1, total + len(each[-1])
            if texts >= BLOCK[0] or total >= BLOCK[1]:
                yield counted()
                each, texts, total = [], 0, 0
    if texts:
        yield counted()


def document_frequencies(docs: DataFrame, size: int, text_col: str = "text") -> Weights:
    """Exact frequencies, over all rows, of all shingles of more than one in DEEP of them.

    A block of texts tells its shingles of at least one in 4 DEEP of its texts. What a shingle has in blocks that do not
    tell it is less than one in 4 DEEP of all texts, so one of more than one in DEEP is told of three quarters of these at
    least; these are counted again in all texts. Fewer than 4/3 DEEP times the different shingles of a mean document are:
    their number follows the length of documents, not how many there are, and none is left out.
    """
    column = docs.select(F.col(text_col).alias("text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, hashes, n in _blocks(batches, size):
            some = n >= texts / (4 * DEEP)
            names = pa.array([None, *hashes[some].view(np.int64).tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.append(texts, n[some]), pa.int64())], names=["shingle", "n"])

    sums = common.map_arrow(column, told, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    sums = common.Scratch(docs.sparkSession).write("shingles", sums)
    documents = sums.where(F.col("shingle").isNull()).agg(F.sum("n")).first()[0] or 0
    some = sums.where(F.col("shingle").isNotNull() & (F.col("n") >= 0.75 * documents / DEEP))
    # Columns of numbers, not rows: eight bytes a shingle.
    found = some.select("shingle").toArrow().column("shingle").to_numpy().view(np.uint64)
    looked_for = docs.sparkSession.sparkContext.broadcast(np.sort(found))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = looked_for.value
        n = np.zeros(len(table), np.int64)
        for _, hashes, k in _blocks(batches, size):
            at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
            same = table[at] == hashes
            n[at[same]] += k[same]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["at", "n"])

    exact = np.zeros(len(looked_for.value), np.int64)
    if len(exact):
        all_counts = common.map_arrow(column, counts, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        exact[all_counts.column("at").to_numpy()] = all_counts.column("n").to_numpy()
    own = exact > documents / DEEP
    return Weights(looked_for.value[own], _idf(exact[own], documents), float(_idf(np.array(documents / DEEP), documents)))


def vector(words: np.ndarray, size: int, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle hashes, their weights) of one text's words."""
    hashes, counts = np.unique(shingles.shingle_hashes(words, size), return_counts=True)
    return hashes, counts.astype(np.float32) * weights.of(hashes)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least weights by sum of greatest; 0 if both are empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    return shared / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - shared)


@functools.lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """65,536 draws each of r (Gamma(2,1)), 1/r and log c (c of Gamma(2,1)): a hash's bits choose among them."""
    u = np.random.Generator(np.random.PCG64(20240229)).random((4, 1 << 16))
    r = -np.log((1 - u[0]) * (1 - u[1]))
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(-np.log((1 - u[2]) * (1 - u[3]))).astype(np.float32)


def bands(hashes: np.ndarray, weights: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash for each band of the consistent weighted samples of a non-empty weighted set."""
    r_of, inverse_of, c_of = _draws()
    k = n_bands * rows
    seeds = shingles.mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    best = np.full(k, np.inf, np.float32)
    picked = np.zeros(k, np.uint64)
    log_w = np.log(weights)
    for start in range(0, len(hashes), 4096):  # bounded memory for very long texts
        h, lw = hashes[start : start + 4096], log_w[start : start + 4096]
        x = (h[None, :] ^ seeds[:, None]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        bits = np.ascontiguousarray(x).view(np.uint16).reshape(k, len(h), 4)
        g, c, beta = bits[:, :, 1], bits[:, :, 2], bits[:, :, 3].astype(np.float32) * np.float32(1 / 65536)
        r = r_of[g]
        t = np.floor(lw[None, :] * inverse_of[g] + beta)
        score = c_of[c] - r * (t - beta + np.float32(1))
        at = score.argmin(axis=1)
        low = score[np.arange(k), at]
        better = low < best
        best[better] = low[better]
        sample = shingles.mix(h[at] ^ (t[np.arange(k), at].astype(np.int64).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
        picked[better] = sample[better]
    out = np.zeros(n_bands, np.uint64)
    for j in range(rows):
        out = shingles.mix(out * np.uint64(31) + picked.reshape(n_bands, rows)[:, j] + np.uint64(j))
    return shingles.mix(out + np.arange(n_bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sign(docs: DataFrame, size: int, shared) -> DataFrame:
    """(key, bands array<long>) for each text with words."""

    def run(x: dict[str, list]) -> dict[str, list]:
        hashes, ends = shingles.word_hashes(x["text"])
        keys, out = [], []
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if b > a:
                keys.append(x["key"][k])
                out.append(bands(*vector(hashes[a:b], size, shared.value)).view(np.int64).tolist())
        return {"key": keys, "bands": out}

    return common.map_batches(docs, "key binary, bands array<long>", run)


def _verify(pairs: DataFrame, texts: DataFrame, size: int, shared, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold. What is exchanged are texts, which are smaller than
    their vectors; those are made where a pair is compared. a may stand in very many pairs.
    """
    two = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("bt")), "b")
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    both = common.spread_join(two, texts.select(F.col("key").alias("a"), F.col("text").alias("at")), "a", counts, "b")

    def run(x: dict[str, list]) -> dict[str, list]:
        one = {k: t for k, t in zip(x["a"], x["at"], strict=True)}  # of few rows many have the same text
        names = list(one)
        hashes, ends = shingles.word_hashes([*one.values(), *x["bt"]])
        each = [vector(hashes[a:b], size, shared.value) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        of = dict(zip(names, each, strict=False))
        found = [weighted_jaccard(of[k], v) for k, v in zip(x["a"], each[len(names) :], strict=True)]
        keep = [k for k, s in enumerate(found) if s >= threshold]
        return {"a": [x["a"][k] for k in keep], "b": [x["b"][k] for k in keep], "similarity": [found[k] for k in keep]}

    return common.map_batches(both.select("a", "b", "at", "bt"), "a binary, b binary, similarity double", run)


def _close(left: DataFrame, texts: DataFrame, size: int, shared, threshold: float, scratch: common.Scratch) -> DataFrame:
    """(a, b): the pairs of texts (key, class) of different classes whose similarity can reach the threshold.

    A pair over it has threshold / (1 + threshold) of both weights together in common; so with shingles ordered by
    rarity, what follows its first common one in either text, with this one, has to weigh as much. Texts meet by that
    shingle and by size, in steps of STEP; the one of less weight looks for sizes from its own on, as far as the bound
    lets it at that shingle: where most of it is its own, it looks for none. Shingles that no other text has are no use.
    """
    left = scratch.write("left", left.join(texts, "key").select(F.monotonically_increasing_id().alias("id"), "key", "class", "text"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            hashes, ends = shingles.word_hashes(batch.column(1).to_pylist())
            each = [np.unique(shingles.shingle_hashes(hashes[a:b], size)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            ids = np.repeat(batch.column(0).to_numpy(), [len(h) for h in each])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.empty(0, np.uint64), *each]).view(np.int64))], names=["id", "shingle"])

    rows = scratch.write("rows", common.map_arrow(left.select("id", "text"), named, "id long, shingle long"))
    counts = scratch.write("counts", rows.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    common_ = common.spread_join(rows, counts, "shingle", counts, "id").groupBy("id").agg(F.collect_list(F.struct("shingle", "n")).alias("known"))
    kinds = pa.schema([("key", pa.binary()), ("class", pa.binary()), ("shingle", pa.int64()), ("size", pa.float64()), ("rest", pa.float64())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            # What is known of shingles stays in arrays of numbers: as lists of rows it would be many times the texts.
            known, ends_of = batch.column(3).flatten(), batch.column(3).offsets.to_numpy()
            named_, n_of = known.field("shingle").to_numpy().view(np.uint64), known.field("n").to_numpy()
            hashes, ends = shingles.word_hashes(batch.column(2).to_pylist())
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                h, w = vector(hashes[a:b], size, shared.value)
                w, n = w.astype(np.float64), np.ones(len(h), np.int64)
                mine = slice(ends_of[k] - ends_of[0], ends_of[k + 1] - ends_of[0])
                n[np.searchsorted(h, named_[mine])] = n_of[mine]
                order = np.lexsort((h, n))
                before = np.cumsum(w[order]) - w[order]
                total = w.sum()
                use = np.flatnonzero((n[order] > 1) & (before <= (1 - threshold + 1e-6) * total))
                same = pa.array(np.full(len(use), k))
                columns = [batch.column(0).take(same), batch.column(1).take(same), h[order][use].view(np.int64), np.full(len(use), total), total - before[use]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) if isinstance(c, np.ndarray) else c.cast(t.type) for c, t in zip(columns, kinds, strict=True)], schema=kinds)

    each = left.join(common_, "id").select("key", "class", "text", "known")
    stand = scratch.write("prefixes", common.map_arrow(each, prefixes, "key binary, class binary, shingle long, size double, rest double"))
    scratch.drop("rows", "counts", "left")
    share = threshold / (1 + threshold) - 1e-6

    def step(weight: F.Column) -> F.Column:
        return F.floor(F.log(weight) / math.log(STEP)).cast("int")

    most = F.least(F.col("size") / (threshold - 1e-6), F.col("rest") / share - F.col("size")) * (1 + 1e-9)
    seek = stand.where(most >= F.col("size")).select(
        F.col("key").alias("a"),
        F.col("class").alias("ca"),
        "shingle",
        F.col("size").alias("sa"),
        F.col("rest").alias("ra"),
        F.explode(F.sequence(step(F.col("size")), step(most))).alias("step"),
    )
    stand = stand.select(F.col("key").alias("b"), F.col("class").alias("cb"), "shingle", F.col("size").alias("sb"), F.col("rest").alias("rb"), step(F.col("size")).alias("step"))
    least = share * (F.col("sa") + F.col("sb"))
    larger = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    found = seek.join(stand, ["shingle", "step"]).where(larger & (F.col("ca") != F.col("cb")) & (F.col("ra") >= least) & (F.col("rb") >= least))
    return found.select("a", "b")


def text_key(text_col: str) -> F.Column:
    return F.substring(common.text_key(text_col), 1, 16)


def classes(
    docs: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, text_col: str = "text", scratch: common.Scratch | None = None
) -> DataFrame:
    """(key, class, links) for each distinct text that is linked to another: class is the least key of its component,
    links the number of verified links found at it. Texts are named by text_key.
    """
    spark = docs.sparkSession
    scratch = scratch or common.Scratch(spark)
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(document_frequencies(texts, size))

    # Of the texts only keys and bands are kept; a text stands in as many rows as it has bands only once it shares one.
    signed = scratch.write("signed", _sign(texts.groupBy("key").agg(F.first("text").alias("text")), size, shared))
    sizes = signed.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = scratch.write("sizes", sizes)
    placed = signed.select("key", F.explode("bands").alias("band"))
    members = scratch.write("members", common.spread_join(placed, sizes, "band", sizes, "key"))
    # How many texts a text shares its bands with: the text that most others are copies of comes first.
    weight = members.groupBy("key").agg(F.sum(F.col("n") - 1).alias("weight"))
    weight = scratch.write("weight", weight.select("key", F.struct(-F.col("weight"), "key").alias("rank")))
    members = scratch.write("ranked", members.join(weight, "key").select("band", "key", "rank"))
    of_band = scratch.write("of_band", members.groupBy("band").agg(F.count("*").alias("n")))
    scratch.drop("signed", "sizes", "members")

    # The texts of these, once each, for the comparisons.
    once = texts.groupBy("key").agg(F.first("text").alias("text"))  # before the join, so that copies are combined in their tasks
    texts = scratch.write("texts", once.join(weight.select("key"), "key", "left_semi"))
    empty = spark.createDataFrame([], "a binary, b binary, similarity double")
    links, tested, of = empty, empty.select("a", "b"), None

    for turn in range(3):
        now = members.withColumn("class", F.col("key"))
        if of is not None:
            now = members.join(of.select(F.col("node").alias("key"), "component"), "key", "left")
            now = now.select("band", "key", "rank", F.coalesce("component", "key").alias("class"))
        spread = now.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.min(F.struct("rank", "key", "class")).alias("head"))
        open_ = scratch.write("open", spread.where(F.col("x") != F.col("y")).select("band", "head"))
        if turn < 2:
            pairs = common.spread_join(now, open_, "band", of_band, "key").where(F.col("class") != F.col("head.class"))
            if turn == 0:
                pairs = pairs.groupBy("key").agg(F.min("head").alias("head"))
            pairs = pairs.select(F.col("head.key").alias("a"), F.col("key").alias("b"))
        else:
            left = common.spread_join(now, open_.select("band"), "band", of_band, "key").select("key", "class").distinct()
            pairs = _close(left, texts, size, shared, threshold, scratch)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = scratch.write(f"pairs{turn}", pairs.join(tested, ["a", "b"], "left_anti"))
        scratch.drop("open", "prefixes")
        if pairs.isEmpty():
            continue
        found = scratch.write(f"links{turn}", _verify(pairs, texts, size, shared, threshold))
        links, tested = links.unionByName(found), tested.unionByName(pairs)
        of = connected_components(links, scratch=scratch)
    if of is None:
        return spark.createDataFrame([], "key binary, class binary, links long")
    ends = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    out = scratch.write("classes", of.select(F.col("node").alias("key"), F.col("component").alias("class")).join(ends, "key"))
    scratch.drop(*[name for name in scratch.paths if name != "classes"])
    return out


def cluster(
    docs: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, class_id, class_rows, class_texts, links) for each row of docs.

    class_id: the least id of the rows in the class; class_rows and class_texts: how many rows and different texts it
    has; links: verified links found at the row's text. Rows of equal texts are always in one class, texts without
    words only with their equals; a null text counts as empty. Repeated rows give a row each, null ids a row with
    whatever id their class has; an empty table gives none. Other columns are left out.
    """
    scratch = common.Scratch(docs.sparkSession)
    of = classes(docs, size, threshold, text_col, scratch)
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    by_text = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    by_text = scratch.write("by_text", by_text.join(of, "key", "left").withColumn("class", F.coalesce("class", "key")))
    by_class = by_text.groupBy("class").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("class_rows"), F.count("*").alias("class_texts")
    )
    by_class = scratch.write("by_class", by_class)
    named = common.spread_join(by_text.drop("n"), by_class, "class", by_class.select("class", F.col("class_texts").alias("n")), "key")
    named = named.select("key", "class_id", "class_rows", "class_texts", F.coalesce("links", F.lit(0)).alias("links"))
    named = scratch.write("named", named)
    scratch.drop("classes", "by_class")
    out = common.spread_join(rows, named, "key", by_text.select("key", "n"), "id")
    return out.select("id", "class_id", "class_rows", "class_texts", "links")


def deduplicate(
    docs: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of docs for each class, with all its columns: that of the least id (null ids last; of equal ids any).

    Null and empty texts are one class, texts without words one with their equals; repeated rows leave one; an empty
    table stays empty; columns of any name stay.
    """
    scratch = common.Scratch(docs.sparkSession)
    of = classes(docs, size, threshold, text_col, scratch)
    keyed = docs.select(common.as_rows(docs).alias("row"), text_key(text_col).alias("key"), F.col(id_col).alias("id"))
    # How many rows have a text's least id is counted here, so that repeated rows are known before any row is joined.
    by_id = keyed.groupBy("key", "id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "n")).alias("least"))
    by_text = by_text.join(of.select("key", "class"), "key", "left").withColumn("class", F.coalesce("class", "key"))
    # The text of each class with the least id, and that id. Rows meet it by both, so that copies of a text do not
    # come together.
    first = by_text.groupBy("class").agg(F.min(F.struct("least.null", "least.id", "key", "least.n")).alias("m"))
    first = scratch.write("first", first.select(F.col("m.key").alias("key"), F.col("m.id").alias("id"), F.col("m.n").alias("n")))
    scratch.drop("classes")
    kept = keyed.alias("k").join(first.alias("f"), (F.col("k.key") == F.col("f.key")) & F.col("k.id").eqNullSafe(F.col("f.id")), "left_semi")
    if not first.where(F.col("n") > 1).isEmpty():  # rows of equal texts and ids
        kept = kept.dropDuplicates(["key"])
    return kept.select("row.*")
