"""Toxicity by positive-unlabelled learning: confirmed toxic texts against texts of which nothing is known.

A few linear classifiers, each on a sample of its own and trained in a task of its own, minimise the non-negative risk
(Kiryo et al., 2017): with p the share of toxic texts, the risk of the unlabelled as negatives less p times that of the
positives as negatives estimates the risk on true negatives; where it falls below zero, which only overfitting can do, the
step goes the other way. A text is its different words; a feature is a word or the beginning of one, and its value a
damped count of the words that have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Features are hashed to so many slots (a power of two); beginnings of words have so many bytes.
SLOTS, BEGINNINGS = 1 << 20, (4, 5, 6, 7)
#: Sets words apart from beginnings that are spelt alike.
WHOLE = 0x5A5A5
#: Classifiers, and the texts of each kind that all of them learn from at most (but for chance, see `sample`).
MEMBERS, POSITIVES, UNLABELLED = 3, 6_000, 12_000
#: A feature counts that so many positives of a member have.
LEAST = 2
#: The share of toxic texts where no labels of both kinds tell it.
PRIOR = 0.1
EPOCHS, RATE, DECAY, SMOOTHING = 80, 0.03, 1e-3, 0.3


#: Bytes of texts that are hashed at once, by sums of powers of an odd number, modulo 2**64, that any run of bytes' hash follows from.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX, _APART = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where the words of data begin, and for each its hash and those of its beginnings, 0 where it is shorter). data: words
    parted by blanks, with one at both ends.
    """
    a = np.frombuffer(data, np.uint8)
    word = a != 32
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(~word[1:] & word[:-1]) + 1
    powers = np.full(len(a), _BASE, np.uint64).cumprod(dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), (a * powers).cumsum(dtype=np.uint64)])
    back = np.full(len(a), pow(_BASE, -1, 1 << 64), np.uint64).cumprod(dtype=np.uint64)[starts]
    columns = [(sums[ends] - sums[starts]) * back]
    for n in BEGINNINGS:
        columns.append(np.where(ends - starts >= n, (sums[np.minimum(starts + n, len(a))] - sums[starts]) * back, np.uint64(0)))
    return starts, np.stack(columns, axis=1)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, count), in this order: for each text the slots of its different words and of their beginnings, and
    how many of its words have them.
    """
    of: list[np.ndarray] = [np.zeros(0, np.int64)]
    hashes: list[np.ndarray] = [np.zeros((0, 1 + len(BEGINNINGS)), np.uint64)]
    group: list[bytes] = []
    begins: list[int] = []
    first = size = 0

    def hash_group() -> None:
        starts, found = word_hashes(b" " + b" ".join(group) + b" ")
        of.append(first + np.searchsorted(np.array(begins), starts, side="right") - 1)
        hashes.append(found)

    for k, text in enumerate(texts):
        data = common.utf8(text).translate(common.WORD_BYTES)
        if group and size + len(data) > PIECE:
            hash_group()
            group, begins, size, first = [], [], 0, k
        while len(data) > PIECE:  # a text of its own, cut between words
            cut = data.rfind(b" ", 0, PIECE) + 1 or data.find(b" ") + 1 or len(data)
            starts, found = word_hashes(b" " + data[:cut] + b" ")
            of.append(np.full(len(starts), k))
            hashes.append(found)
            data = data[cut:]
        begins.append(1 + size)
        group.append(data)
        size += len(data) + 1
    if group:
        hash_group()
    text, each = np.concatenate(of).astype(np.int64), np.concatenate(hashes)
    _, once = np.unique(each[:, 0] * _MIX + text.astype(np.uint64) * _APART, return_index=True)
    text, each = text[once], each[once]
    pairs = []
    for n in range(each.shape[1]):
        has = each[:, n] != 0
        slot = ((each[has, n] ^ np.uint64(WHOLE if n == 0 else 0)) * _MIX) >> np.uint64(64 - SLOTS.bit_length() + 1)
        pairs.append(text[has] * SLOTS + slot.astype(np.int64))
    pairs, counts = np.unique(np.concatenate(pairs), return_counts=True)
    return pairs // SLOTS, pairs % SLOTS, counts


@dataclass(frozen=True)
class Classifier:
    """The weights of slots (in order) and the bias: of one member, or the mean of all."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def learn(rows: list[tuple[bool, np.ndarray, np.ndarray]], prior: float) -> Classifier:
    """A classifier of (positive, slots, counts). Without positives or others it says no to everything."""
    yes = np.array([r[0] for r in rows], bool)
    nothing = Classifier(np.zeros(0, np.int64), np.zeros(0), -50.0)
    if yes.all() or not yes.any():
        return nothing
    slots = np.concatenate([r[1] for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    value = np.log1p(np.concatenate([r[2] for r in rows]))
    n_yes, n_all = int(yes.sum()), int((~yes).sum())
    has_yes, has_all = np.bincount(slots[yes[at]], minlength=SLOTS), np.bincount(slots[~yes[at]], minlength=SLOTS)
    # A feature's scale: how much more often positives have it than others; one that speaks for no is of no use.
    scale = np.log((has_yes + SMOOTHING) / (n_yes + 2 * SMOOTHING)) - np.log((has_all + SMOOTHING) / (n_all + 2 * SMOOTHING))
    chosen = np.flatnonzero((has_yes >= LEAST) & (scale > 0))
    place = np.full(SLOTS, -1)
    place[chosen] = np.arange(len(chosen))
    some = place[slots] >= 0
    at, column, value = at[some], place[slots[some]], value[some] * scale[slots[some]]
    w, bias = np.zeros(len(chosen)), np.log(prior / (1 - prior))
    first, second, first_b, second_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        margin = np.bincount(at, value * w[column], len(rows)) + bias
        up, loss_no = sigmoid(margin), np.logaddexp(0, margin)
        negative = loss_no[~yes].mean() - prior * loss_no[yes].mean()
        as_no = np.where(yes, -prior * up / n_yes, up / n_all)  # the gradient of `negative`
        pull = np.where(yes, prior * (up - 1) / n_yes, 0.0) + as_no if negative >= 0 else -as_no
        grad, grad_b = np.bincount(column, value * pull[at], len(w)) + DECAY * w, pull.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        first_b, second_b = 0.9 * first_b + 0.1 * grad_b, 0.999 * second_b + 0.001 * grad_b**2
        rate, unbias = RATE / (1 - 0.9**step), 1 - 0.999**step
        w = w - rate * first / (np.sqrt(second / unbias) + 1e-8)
        bias = bias - rate * first_b / (np.sqrt(second_b / unbias) + 1e-8)
    return Classifier(chosen, w * scale[chosen], float(bias))


def sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """About `most` rows, or all if they are fewer: those of small hashes of all columns."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(1 << 32)) < int((1 << 32) * most / n))


def class_prior(labels: DataFrame) -> float:
    """The share of toxic rows among labelled ones, or PRIOR where one of both kinds is missing."""
    n, yes = labels.agg(F.count("toxic"), F.count_if(F.col("toxic") == 1)).first()
    return yes / n if 0 < yes < n else PRIOR


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """The mean of the members' classifiers.

    labels: (doc_id, toxic); rows of a label 1 are confirmed, and an id's text is toxic if any row says so. Unlabelled are
    texts of docs whatever their label, which negatives give nothing but to the prior. Both samples are bounded, as stated
    above; the members part the unlabelled ones and share the positives. Null and empty texts have no features and
    are learnt from as such; null ids have no label; no docs or no positives give a classifier that says no to everything.
    """
    prior = class_prior(labels) if prior is None else prior
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scratch = common.Scratch(docs.sparkSession)
    # So few ids that they can be sent to all tasks, and texts need no exchange to be found.
    toxic = scratch.write("toxic", labels.where("toxic = 1").select(F.col("doc_id").alias("id")).distinct())
    toxic = sample(toxic, POSITIVES, 4)
    positives = scratch.write("positives", rows.join(F.broadcast(toxic), "id", "left_semi"))
    members = F.sequence(F.lit(0), F.lit(MEMBERS - 1))
    one = sample(positives, POSITIVES, 1).select(F.lit(True).alias("yes"), F.explode(members).alias("member"), "text")
    other = sample(rows, UNLABELLED, 2).select(F.lit(False).alias("yes"), F.pmod(F.xxhash64("id", "text", F.lit(3)), F.lit(MEMBERS)).cast("int").alias("member"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            text, slots, counts = features(batch.column(2).to_pylist())
            ends = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
            columns = [batch.column(0), batch.column(1), *[pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (slots, counts)]]
            yield pa.RecordBatch.from_arrays(columns, names=["yes", "member", "slots", "counts"])

    encoded = one.unionByName(other).mapInArrow(encode, "yes boolean, member int, slots array<long>, counts array<long>")

    def fit(group: pa.Table) -> pa.Table:
        each = zip(group["yes"].to_pylist(), group["slots"], group["counts"], strict=True)
        found = learn([(y, s.values.to_numpy(), c.values.to_numpy()) for y, s, c in each], prior)
        return pa.table({"slots": pa.array([found.slots], pa.list_(pa.int64())), "weights": pa.array([found.weights], pa.list_(pa.float64())), "bias": [found.bias]})

    told = encoded.groupBy("member").applyInArrow(fit, "slots array<long>, weights array<double>, bias double").collect()
    scratch.drop("positives", "toxic")
    total = np.zeros(SLOTS)
    for r in told:
        total[r["slots"]] += np.array(r["weights"]) / len(told)
    slots = np.flatnonzero(total)
    return Classifier(slots, total[slots], float(np.mean([r["bias"] for r in told])) if told else -50.0)


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row, 0 to 1, of whole texts and nothing else. Null and empty texts have the bias alone; equal
    texts equal scores; repeated rows and null ids a row each; an empty table none; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(SLOTS)
        weights[shared.value.slots] = shared.value.weights
        for batch in common.slices(batches):
            text, slots, counts = features(batch.column(1).to_pylist())
            # By text and slot in order, so that equal texts add up alike.
            margins = np.bincount(text, np.log1p(counts) * weights[slots], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(shared.value.bias + margins))], names=["id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{common.ddl(docs, id_col, 'id')}, score double")
