"""Personal data by weak supervision: labellers vote on candidate spans, EM weighs them, a span classifier decides.

Base spans follow fixed rules and are always reported. Candidates are looked for with looser rules; regular-expression,
gazetteer, context and checksum labellers vote on each; the votes' reliabilities are estimated by
expectation-maximisation from the counts of all vote patterns of the corpus. A logistic classifier learns the posteriors
of a bounded sample of spans from what they are made of and what is around them (shape, characters, words), not from
the votes, and decides on the candidates.
"""

from __future__ import annotations

import bisect
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, weak

#: Kinds of base spans, then those that only the method finds, in the order of reports.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "secret")
#: A candidate counts as personal data from this score on.
ACCEPT = 0.5
#: Bound of the training sample of the classifier: the span of least hash in each of SLOTS slots. Its dimensions.
SLOTS, DIMENSIONS = 20_000, 1 << 12

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser forms.
_OPEN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+", re.I)
_OPEN_PHONE = re.compile(r"(?<![\w+])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)", re.ASCII)
_ACCOUNT = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2}\d{2}[A-Z0-9]{11,30})(?![\w-])", re.ASCII)
_SECRET = re.compile(r"(?<![\w+/=-])[A-Za-z0-9_+/-]{20,}={0,2}(?![\w+/=-])", re.ASCII)
_DIGIT = re.compile("[0-9]")

#: Fixed values. Gazetteers: endings of mail domains; beginnings of keys; lengths of account numbers by country.
ENDINGS = frozenset(
    "com org net edu gov mil int io ai app dev info biz me tv co name pro xyz online site cloud "
    "ar at au be br ca ch cl cn cz de dk es eu fi fr gr hk hu ie il in it jp kr mx nl no nz pe pl pt ro ru se sg tr tw ua uk us za".split()
)
BEGINNINGS = (
    "AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "pk_live_", "rk_live_",
    "xoxb-", "xoxp-", "xoxa-", "xapp-", "AIza", "ya29.", "eyJ", "SG.", "npm_", "pypi-", "hf_", "dop_v1_", "shpat_", "AGE-SECRET-KEY",
)
IBAN = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22,
    "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24,
}
#: Words near a span that speak for a kind.
CUES = {
    "email": frozenset("email e-mail mail contact write correo courriel mailto".split()),
    "ip": frozenset("ip host address server from login adresse direccion".split()),
    "card": frozenset("card visa mastercard amex credit debit payment pay karte carte tarjeta".split()),
    "phone": frozenset("phone tel call mobile fax cell telephone telefon handy telefono anruf".split()),
    "account": frozenset("ssn social security account iban number konto compte cuenta".split()),
    "secret": frozenset("token secret key password passwd pwd api apikey api-key aws bearer credential passwort".split()),
}
_WORD = re.compile(r"[A-Za-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """What the pattern [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ matches, leftmost first, in linear time: a match
    can only stand around an @, and what fails at one @ fails from every start before it.
    """
    out, start = [], 0
    while (at := text.find("@", start)) >= 0:
        before = text[start:at]
        name = len(before) - len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if name else None
        if found:
            out.append((at - name, found.end()))
        start = found.end() if found else at + 1
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    """What the pattern [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+) matches, with parts of at most 255, in linear time: of numbers
    joined by dots, each four from the first on.
    """
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        start, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            end = start + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in own):
                out.append((start, end))
            start = end + 1
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start, in characters. Matches that fail their kind's test are dropped."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", a, b) for a, b in _addresses(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans by the looser rules that overlap no base span nor an earlier candidate."""
    found: list[tuple[str, int, int]] = []
    low = "(at" in (t := text.lower()) or "[at" in t or "( at" in t or "[ at" in t
    if low:
        found += [("email", *m.span()) for m in _OPEN_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in _CARD.finditer(text):
            if 13 <= sum(c.isdigit() for c in m[0]) <= 19:
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _OPEN_PHONE.finditer(text)]
        found += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
        found += [("secret", *m.span()) for m in _SECRET.finditer(text) if _DIGIT.search(m[0]) and not m[0].isdigit()]
    taken = sorted((a, b) for _, a, b in base)
    starts, reach, far = [a for a, _ in taken], [], 0
    for _, end in taken:
        far = max(far, end)
        reach.append(far)
    out, last = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))):
        at = bisect.bisect_left(starts, b)  # base spans that start before its end
        if (at and reach[at - 1] > a) or last > a:
            continue
        out.append((kind, a, b))
        last = b
    return out


def _shape(kind: str, span: str) -> int:
    """Regular-expression labeller: the strict form of a kind."""
    if kind == "secret":
        mixed = bool(re.search("[a-z]", span)) + bool(re.search("[A-Z]", span)) + bool(_DIGIT.search(span))
        return int(len(re.findall("[0-9]", span)) >= 4 and (mixed == 3 or bool(re.fullmatch("[0-9a-f]{24,}", span))))
    if kind == "email":
        return int("." in span or "dot" in span.lower())
    if kind == "card":
        return int(16 <= sum(c.isdigit() for c in span) <= 19)
    return 1


def _gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return int(re.split(r"[^a-z]+", span.lower())[-1] in ENDINGS)
    if kind == "secret":
        return 1 if span.startswith(BEGINNINGS) else -1
    if kind == "phone":
        return 0 if re.match(r"\D*(?:000|[01]\d\d)", span) and not span.startswith("+") else 1
    if kind == "card":  # first digits that card issuers use
        return -1 if re.match(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)", span) else 0
    if kind == "account":
        return int(IBAN.get(span[:2]) == len(span)) if span[0].isalpha() else int(not re.match("000|666|9", span))
    return -1


def _context(kind: str, before: str) -> int:
    near = {w.lower() for w in _WORD.findall(before)}
    if near & CUES[kind]:
        return 1
    return 0 if any(near & c for k, c in CUES.items() if k != kind) else -1


def _checksum(kind: str, span: str) -> int:
    if kind == "card":
        return int(luhn("".join(c for c in span if c.isdigit())))
    if kind == "ip":
        return 1
    if kind == "account" and span[0].isalpha():
        return int(int("".join(str(int(c, 36)) for c in span[4:] + span[:4])) % 97 == 1)
    return -1


def _edges(before: str, after: str) -> int:
    """Whether the span stands by itself."""
    return int(not before[-1:].isalnum() and not after[:1].isalnum())


def votes_on(text: str, span: tuple[str, int, int]) -> list[int]:
    kind, a, b = span
    inside, before = text[a:b], text[max(0, a - 40) : a]
    return [_shape(kind, inside), _gazetteer(kind, inside), _context(kind, before), _checksum(kind, inside), _edges(before, text[b : b + 1])]


N_LABELLERS = 5


_CLASSES = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})


def features(text: str, span: tuple[str, int, int]) -> list[int]:
    """The dimensions that a span has: its kind, length, runs of three characters by class, what it begins with, how many
    different characters it has, whether its digits pass the card checksum, and the words and characters around it.
    """
    kind, a, b = span
    inside = text[a:b]
    shape = f"^{inside.translate(_CLASSES)}$"
    names = [kind, f"length {min((b - a) // 4, 12)}", f"different {min(len(set(inside)) // 3, 8)}", f"begins {inside[:2]}"]
    names += [f"shape {shape[k : k + 3]}" for k in range(len(shape) - 2)]
    digits = [c for c in inside if c in "0123456789"]
    names.append(f"digits {min(len(digits), 20)} of {sum(c.isalpha() for c in inside) > 0}")
    if kind == "card":
        names.append(f"checksum {luhn(''.join(digits))}")
    names += [f"before {w.lower()}" for w in _WORD.findall(text[max(0, a - 40) : a])[-3:]]
    names += [f"after {w.lower()}" for w in _WORD.findall(text[b : b + 20])[:1]]
    names.append(f"beside {text[max(0, a - 1) : a].translate(_CLASSES)}|{text[b : b + 1].translate(_CLASSES)}")
    return sorted({zlib.crc32(f"{kind} {n}".encode("utf-8", "surrogatepass")) % DIMENSIONS for n in names})


@dataclass(frozen=True)
class Model:
    """weights: of DIMENSIONS, then the constant."""

    labellers: weak.VoteModel
    weights: np.ndarray

    def score(self, dimensions: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[dimensions].sum() + self.weights[-1], -50, 50))))


def _fit_classifier(rows: list[list[int]], labels: np.ndarray, epochs: int = 200, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad."""
    w, past = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    column = np.concatenate([np.array([*r, DIMENSIONS]) for r in rows])
    for _ in range(epochs):
        margin = np.bincount(row, w[column], len(rows))
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels) / len(rows)
        grad = np.bincount(column, error[row], DIMENSIONS + 1) + decay * w
        past += grad * grad
        w -= 0.3 * grad / np.sqrt(past)
    return w


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Votes on the base spans and candidates of all of docs, and a classifier of the sample of them; without any, a model
    that accepts none. Null and empty texts have no spans, repeated rows count as often as they stand.
    """

    def run(x: dict[str, list]) -> dict[str, list]:
        counts: dict[tuple[int, ...], int] = {}
        least: dict[int, tuple[int, list[int], list[int]]] = {}
        for t in x[text_col]:
            if t:
                base = base_spans(t)
                for s in base + candidates(t, base):
                    votes = votes_on(t, s)
                    counts[tuple(votes)] = counts.get(tuple(votes), 0) + 1
                    about = t[max(0, s[1] - 40) : s[2] + 20].encode("utf-8", "surrogatepass")
                    h = zlib.crc32(about) << 31 ^ zlib.crc32(about[::-1])
                    if (slot := h % SLOTS) not in least or h < least[slot][0]:
                        least[slot] = h, votes, features(t, s)
        n = len(counts)
        return {
            "votes": [*map(list, counts), *(v for _, v, _ in least.values())],
            "n": [*counts.values(), *[0] * len(least)],
            "slot": [*[None] * n, *least],
            "span": [*[None] * n, *({"h": h, "votes": v, "dimensions": d} for h, v, d in least.values())],
        }

    schema = "votes array<int>, n long, slot int, span struct<h:long,votes:array<int>,dimensions:array<int>>"
    rows = common.Scratch(docs.sparkSession).write("spans", common.map_batches(docs.select(text_col), schema, run))
    patterns = rows.where(F.col("slot").isNull()).groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    if not patterns:
        weights = np.zeros(DIMENSIONS + 1)
        weights[-1] = -50
        return Model(weak.fit(np.empty((0, N_LABELLERS), int), np.empty(0)), weights)
    labellers = weak.fit(np.array([r["votes"] for r in patterns], int), np.array([r["n"] for r in patterns], float))
    sample = rows.where(F.col("slot").isNotNull()).groupBy("slot").agg(F.min("span").alias("span")).select("span.*").orderBy("h").collect()
    labels = labellers.posterior(np.array([r["votes"] for r in sample], int))
    return Model(labellers, _fit_classifier([r["dimensions"] for r in sample], labels))


def spans_of(text: str | None, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """(base spans, accepted candidates with their scores)."""
    base = base_spans(text)
    rest = candidates(text, base) if text else []
    if not rest:
        return base, []
    return base, [(*s, p) for s in rest if (p := model.score(features(text, s))) >= ACCEPT]


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base array<struct<kind,start,end>>, added array<struct<kind,start,end,score>>) for each row.

    Offsets are characters (code points), end exclusive; base is in report order, added by start. A null text counts as
    empty. Repeated rows and null ids give a row each, an empty table none; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(x: dict[str, list]) -> dict[str, list]:
        found = [spans_of(t, shared.value) for t in x[text_col]]
        return {
            "id": x[id_col],
            "base": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b] for b, _ in found],
            "added": [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in c] for _, c in found],
        }

    span = "kind:string,start:long,end:long"
    schema = f"{common.ddl(docs, id_col, 'id')}, base array<struct<{span}>>, added array<struct<{span},score:double>>"
    return common.map_batches(docs.select(id_col, text_col), schema, run)


def redact_text(text: str | None, model: Model) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest is named."""
    if not text:
        return text
    base, added = spans_of(text, model)
    out, at = [], 0
    for kind, a, b in sorted([*base, *(s[:3] for s in added)], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with the spans of text_col replaced by their kinds; all columns and rows stay, whatever their names; null
    texts stay null, empty ones empty, and repeated rows are treated alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(common.ddl(docs, c) for c in docs.columns)
    return common.map_batches(docs, schema, lambda x: x | {text_col: [redact_text(t, shared.value) for t in x[text_col]]})
