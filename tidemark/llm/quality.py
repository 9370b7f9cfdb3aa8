"""Quality classifier from weak labels: heuristic labellers, EM, and a linear scorer of hashed
character trigrams and gaps between equal words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, weak

#: Bound of the training sample: the text of least hash in each of SLOTS slots, whatever its length.
SLOTS = 3000
#: Dimensions of the scorer.
DIMENSIONS = 1 << 16
#: Words that stood this many bits of words ago or never before have the same gap.
FAR = 8
#: Documents whose score is below this are rejected.
KEEP = 0.4

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for was with are be this by from or on as at it an a he have not you "
    "der die und das den von zu mit ist des dem auf für im nicht ein eine als auch sich "
    "le la les des et en un une du que est pour dans qui par sur au pas avec plus "
    "el los las del y por con para una se su al lo como más de".encode().split()
)
_PLAIN = bytes(range(128, 256)) + b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\t\r.,;:'\"()-?"
_UPPER, _LOWER = common.UPPER.encode(), common.LOWER.encode()


def _vote(value: float, yes: bool, no: bool) -> int:
    return 1 if yes else 0 if no else -1


def symbol_share(text: str, data: bytes, words: list[bytes]) -> int:
    """Signs outside plain prose, as a share of all bytes."""
    share = len(data.translate(None, _PLAIN)) / max(1, len(data))
    return _vote(share, share < 0.01, share > 0.04)


def function_words(text: str, data: bytes, words: list[bytes]) -> int:
    """Function words as a share of all words."""
    if len(words) < 20:
        return -1
    share = sum(w in FUNCTION_WORDS for w in words) / len(words)
    return _vote(share, share > 0.15, share < 0.05)


def word_length(text: str, data: bytes, words: list[bytes]) -> int:
    mean = sum(map(len, words)) / len(words) if words else 0.0
    return _vote(mean, 3 <= mean <= 9, mean < 2 or mean > 14)


def capitals(text: str, data: bytes, words: list[bytes]) -> int:
    """Upper-case letters as a share of cased ones, within ASCII."""
    if len(words) < 3:
        return -1
    upper = len(data) - len(data.translate(None, _UPPER))
    share = upper / max(1, upper + len(data) - len(data.translate(None, _LOWER)))
    return _vote(share, share < 0.15, share > 0.4)


def variety(text: str, data: bytes, words: list[bytes]) -> int:
    """Different words as a share of all, the mean over every fifty words: the same measure for texts of any length."""
    if len(words) < 30:
        return -1
    share = sum(len(set(words[k : k + 50])) for k in range(0, len(words), 50)) / len(words)
    return _vote(share, share > 0.6, share < 0.4)


def sentence_ends(text: str, data: bytes, words: list[bytes]) -> int:
    """Sentence ends by words."""
    if len(words) < 30:
        return -1
    share = (data.count(b". ") + data.count(b".\n") + data.count(b"? ") + data.endswith(b".")) / len(words)
    return _vote(share, 0.01 < share < 0.3, share < 0.004)


def separators(text: str, data: bytes, words: list[bytes]) -> int:
    """Bars, exclamations and the like by words: lists and shouting rather than prose."""
    share = (data.count(b"|") + data.count(b"!") + data.count(b"#") + data.count(b"*")) / max(1, len(words))
    return _vote(share, share < 0.03, share > 0.2)


def repeats(text: str, data: bytes, words: list[bytes]) -> int:
    """Words that are the same as the word before, as a share of all."""
    if len(words) < 10:
        return -1
    share = sum(map(bytes.__eq__, words, words[1:])) / len(words)
    return _vote(share, share < 0.05, share > 0.15)


LABELLERS = (symbol_share, function_words, word_length, capitals, variety, sentence_ends, separators, repeats)
#: Texts fail by their characters or by their words: the labellers that look for each.
KINDS = tuple(tuple(LABELLERS.index(f) for f in k) for k in ((symbol_share, word_length, capitals, separators), (function_words, variety, sentence_ends, repeats)))


def votes_of(text: str | None) -> list[int]:
    """Each labeller's vote: 1 good, 0 bad, -1 none. Without words none votes."""
    data, words = common.utf8(text), common.words_of(text)
    return [f(text, data, words) for f in LABELLERS] if words else [-1] * len(LABELLERS)


def gaps(words: list[bytes]) -> np.ndarray:
    """For each word the bits of how many words ago it stood last, at most FAR: the repetition within a text, whatever
    the words are.
    """
    last: dict[bytes, int] = {}
    out = np.empty(len(words), np.uint32)
    for k, w in enumerate(words):
        out[k] = min((k - last.get(w, -(1 << FAR))).bit_length(), FAR)
        last[w] = k
    return out


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values), each slot once: the slot of each run of three bytes, case and signs included, an equal part of 1;
    and that of each word's gap, an equal part of another 1. Nothing but the text counts, no labeller's vote.
    """
    data = common.utf8(text)
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    runs = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) if len(a) > 2 else np.empty(0, np.uint32)
    far = gaps(common.words_of(text)) + np.uint32(1 << 24)
    slots, inverse = np.unique((np.concatenate([runs, far]) * np.uint32(0x9E3779B1)) >> np.uint32(16), return_inverse=True)
    parts = np.concatenate([np.full(len(x), 1 / max(1, len(x))) for x in (runs, far)])
    return slots.astype(np.int64), np.bincount(inverse, parts, len(slots))


@dataclass(frozen=True)
class Scorer:
    """weights by slot; a text's margin is bias + the sum of its slots' weights by their values."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """0 to 1; texts with fewer than three bytes and no words have the bias alone."""
        slots, values = hashed(text)
        margin = self.bias + float(self.weights[slots] @ values)
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def train_scorer(
    hashes: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 150, rate: float = 1.0, decay: float = 1e-6
) -> Scorer:
    """Logistic regression on soft labels by AdaGrad, over texts as hashed gives them; both classes count equally."""
    if not hashes:
        return Scorer(np.zeros(DIMENSIONS, np.float32), 0.0)
    row = np.repeat(np.arange(len(hashes)), [len(slots) for slots, _ in hashes])
    column, value = (np.concatenate(x) for x in zip(*hashes, strict=True))
    weight = np.where(labels > 0.5, 0.5 / max(labels.sum(), 1e-9), 0.5 / max((1 - labels).sum(), 1e-9))
    w, bias, gw, gb = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS, 1e-10), 1e-10
    for _ in range(epochs):
        margin = bias + np.bincount(row, w[column] * value, len(hashes))
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels) * weight
        grad = np.bincount(column, error[row] * value, DIMENSIONS) + decay * w
        gw, gb = gw + grad * grad, gb + error.sum() ** 2
        w, bias = w - rate * grad / np.sqrt(gw), bias - 0.3 * error.sum() / np.sqrt(gb)
    return Scorer(w.astype(np.float32), float(bias))


@dataclass(frozen=True)
class Model:
    labellers: weak.VoteModel
    scorer: Scorer


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Votes on all of docs give the labellers' accuracies; the scorer learns posteriors of the bounded sample.

    Null texts are left out, empty ones have no votes and are not learnt from; repeated rows count as often as they stand
    and are learnt from once; an empty table gives a model that knows nothing.
    """
    rows = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    voted = common.map_batches(rows, "votes array<int>", lambda x: {"votes": [votes_of(t) for t in x["text"]]})
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    votes = np.array([p["votes"] for p in patterns], int).reshape(-1, len(LABELLERS))
    model = weak.fit(votes, np.array([p["n"] for p in patterns]), kinds=KINDS)
    keyed = rows.select("text", F.xxhash64("text", F.lit(7)).alias("h")).where(F.length("text") > 0)
    least = keyed.groupBy(F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.min("h").alias("h"))
    sample = keyed.join(F.broadcast(least.select("h")), "h", "left_semi").dropDuplicates(["h"])

    # Only slots and votes of the sample reach the driver: at most DIMENSIONS numbers a text, however long it is.
    def learnt(x: dict[str, list]) -> dict[str, list]:
        each = [hashed(t) for t in x["text"]]
        return {"h": x["h"], "slots": [s.tolist() for s, _ in each], "parts": [v.tolist() for _, v in each], "votes": [votes_of(t) for t in x["text"]]}

    sample = common.map_batches(sample.select("text", "h"), "h long, slots array<int>, parts array<double>, votes array<int>", learnt)
    found = sample.orderBy("h").collect()
    labels = model.posterior(np.array([r["votes"] for r in found], int).reshape(-1, len(LABELLERS)))
    return Model(model, train_scorer([(np.array(r["slots"], np.int64), np.array(r["parts"])) for r in found], labels))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, keep, posterior) for each row: the scorer's, whether it reaches KEEP, and the labellers' own.

    A null or empty text has only the scorer's bias and no votes. Repeated rows and null ids give a row each, an empty
    table none; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(x: dict[str, list]) -> dict[str, list]:
        voted = [votes_of(t) for t in x[text_col]]
        scores = [shared.value.scorer.score(t) for t in x[text_col]]
        votes = np.array(voted, int).reshape(-1, len(LABELLERS))
        return {
            "id": x[id_col],
            "score": scores,
            "keep": [s >= KEEP for s in scores],
            "posterior": shared.value.labellers.posterior(votes).tolist(),
        }

    return common.map_batches(
        docs.select(id_col, text_col), f"{common.ddl(docs, id_col, 'id')}, score double, keep boolean, posterior double", run
    )


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches KEEP.

    A null or empty text has only the scorer's bias, so that all such rows stay or go together, as repeated rows do; an
    empty table stays empty; columns of any name stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in common.slices(batches):
            scores = [shared.value.scorer.score(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([s >= KEEP for s in scores], pa.bool_()))

    return common.map_arrow(docs, run, docs.schema)
