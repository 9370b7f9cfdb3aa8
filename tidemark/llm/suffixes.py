"""Sorted runs of suffixes: anchors that texts share, front coding, and merging that knows common prefixes.

A string of SPAN bytes is looked up by its anchor: of its runs of GRAM bytes, the one of least hash, the leftmost of
equal ones. Equal strings have equal anchors at equal places, so a string can only stand elsewhere if its anchor's run
does. What is sorted are suffixes that start at anchors: the run, how far before the anchor the string starts, the rest
of the string after the run, and what is before the anchor, read backwards. Two such keys are equal exactly if the
strings are; strings about one anchor have long common prefixes, which front coding leaves out.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPAN, GRAM = 200, 120
#: Strings of a text that share an anchor; no more than this.
WINDOW = SPAN - GRAM + 1
#: Length of a key.
KEY = SPAN + 1

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(200)).integers(1, 1 << 63, 256, dtype=np.uint64)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes of data, wherever they stand."""
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    m = len(data) - GRAM + 1
    h = (sums[GRAM:] - sums[:m]) * down[:m]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


@dataclass
class Anchors:
    """By anchor: text (its number), at (the run's place in it), lo and n (its strings start at lo .. lo + n - 1), the
    run's hash, and a hash of all bytes of its strings together.
    """

    text: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    gram: np.ndarray
    whole: np.ndarray


def anchors(texts: list[bytes]) -> Anchors:
    """The anchors of all texts. Texts under SPAN bytes have none."""
    long = [k for k, t in enumerate(texts) if len(t) >= SPAN]
    none = np.empty(0, np.int64)
    if not long:
        return Anchors(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    data = b"".join(texts[k] for k in long)
    sizes = np.array([len(texts[k]) for k in long])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    h = _gram_hashes(np.frombuffer(data, np.uint8))
    # The place breaks ties, so that the leftmost of equal hashes is the least.
    ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    rows = np.append(ranked, np.full(-len(h) % WINDOW, 2**64 - 1, np.uint64)).reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - SPAN + 1
    least = np.minimum(behind[:count], ahead[WINDOW - 1 : WINDOW - 1 + count])
    place = np.concatenate([np.arange(a, b - SPAN + 1) for a, b in zip(starts[:-1], starts[1:], strict=True)])
    at = (least[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)
    begins = np.flatnonzero(first)
    lo, n, at = place[begins], np.diff(np.append(begins, len(place))), at[begins]
    inside = np.searchsorted(starts, lo, side="right") - 1
    digests = b"".join(
        hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(lo.tolist(), (lo + n + SPAN - 1).tolist(), strict=True)
    )
    base = starts[inside]
    return Anchors(np.array(long)[inside], at - base, lo - base, n, h[at], np.frombuffer(digests, np.uint64))


def keys_of(piece: bytes, at: int, n: int) -> list[bytes]:
    """Sort keys of the n strings that start at 0 .. n - 1 of piece, whose anchor is at `at`."""
    head, after, before = piece[at : at + GRAM], at + GRAM, piece[:at][::-1]
    return [head + bytes([at - k]) + piece[after : k + SPAN] + before[: at - k] for k in range(n)]


#: Length of a piece's key.
PIECE = SPAN - 1 + WINDOW + 2
#: In a piece's key, beside how far before the anchor it starts: the anchor's pieces are dealt out to several tasks.
DEALT = 128


def piece_key(piece: bytes, at: int, n: int, dealt: bool) -> bytes:
    """Sort key of a whole piece, the bytes of the n strings about the anchor at `at`; filled up to one length. Two are
    equal exactly if the pieces are.
    """
    head = piece[at : at + GRAM] + bytes([at + DEALT * dealt, n])
    return (head + piece[at + GRAM :] + piece[:at][::-1]).ljust(PIECE, b"\0")


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of equally long strings of which `known` bytes are known to agree."""
    x, y = a[known:], b[known:]
    if x == y:
        return len(a)
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return len(a) - (differ.bit_length() + 7) // 8


def front_code(ordered: list[bytes]) -> tuple[np.ndarray, bytes]:
    """(common prefix of each string with the one before it, the rests joined). Strings are of one length, sorted, distinct."""
    rows = np.frombuffer(b"".join(ordered), np.uint8).reshape(-1, len(ordered[0]))
    shared = np.zeros(len(ordered), np.uint16)
    for a in range(1, len(rows), 8192):
        b = min(a + 8192, len(rows))
        shared[a:b] = (rows[a:b] != rows[a - 1 : b - 1]).argmax(axis=1)
    return shared, b"".join([s[k:] for s, k in zip(ordered, shared.tolist(), strict=True)])


@dataclass
class Run:
    """Distinct sorted keys of one length, front-coded; counts: entries of each; weights: how many occurrences these stand
    for; ids and places: of all entries, in order.
    """

    width: int
    shared: np.ndarray
    rests: bytes
    counts: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    places: np.ndarray

    def strings(self) -> Iterator[tuple[int, bytes]]:
        """(common prefix with the string before, string), in order."""
        last, at, rests = b"", 0, self.rests
        for k in self.shared.tolist():
            to = at + self.width - k
            last = last[:k] + rests[at:to]
            at = to
            yield k, last

    def pack(self) -> bytes:
        import zstandard

        ids, of = np.unique(self.ids, return_inverse=True)
        parts = [
            self.shared.astype("<u2").tobytes(),
            self.rests,
            self.counts.astype("<u4").tobytes(),
            self.weights.astype("<i8").tobytes(),
            ids.astype("<i8").tobytes(),
            of.astype("<u4").tobytes(),
            self.places.astype("<u4").tobytes(),
        ]
        return struct.pack("<8q", self.width, *map(len, parts)) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @staticmethod
    def unpack(data: bytes) -> Run:
        import zstandard

        width, *sizes = struct.unpack("<8q", data[:64])
        body = zstandard.ZstdDecompressor().decompress(data[64:], max_output_size=max(1, sum(sizes)))
        parts, at = [], 0
        for size in sizes:
            parts.append(body[at : at + size])
            at += size
        shared, counts, of, places = np.frombuffer(parts[0], "<u2"), np.frombuffer(parts[2], "<u4"), np.frombuffer(parts[5], "<u4"), np.frombuffer(parts[6], "<u4")
        return Run(width, shared, parts[1], counts, np.frombuffer(parts[3], "<i8"), np.frombuffer(parts[4], "<i8")[of], places)


def make_run(keys: list[bytes], ids: np.ndarray, places: np.ndarray, weights: np.ndarray | None = None) -> Run:
    """Sorts keys; ids, places and weights (else 1) belong to them."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    distinct: list[bytes] = []
    starts: list[int] = []
    last = None
    for n, k in enumerate(order):
        if keys[k] != last:
            last = keys[k]
            distinct.append(last)
            starts.append(n)
    shared, rests = front_code(distinct)
    at = np.array(order, np.int64)
    weight = np.ones(len(keys), np.int64) if weights is None else np.asarray(weights, np.int64)[at]
    counts = np.diff(np.append(starts, len(order))).astype(np.uint32)
    return Run(len(keys[0]), shared, rests, counts, np.add.reduceat(weight, starts), ids[at], places[at])


def merge(runs: list[Run]) -> Iterator[tuple[int, int, bytes]]:
    """(run, common prefix with the key before, key) for all keys of all runs in order, by a loser tree.

    Each node keeps the loser of its match and that loser's common prefix with the winner, which is the key given out
    last. Of two keys the one that shares more with that key comes first; only if both share equally much are they
    compared, and from there on. A run's next key brings its prefix from front coding.
    """
    size = 1
    while size < len(runs):
        size *= 2
    sources = [r.strings() for r in runs]
    now: list[bytes | None] = [None] * size
    loser, shares = [0] * size, [-1] * size

    def first(k: int) -> int:
        """The prefix that run k's first key shares with nothing, or -1 if it has no keys."""
        found = next(sources[k], None) if k < len(runs) else None
        if found is None:
            return -1
        now[k] = found[1]
        return 0

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, first(node - size)
        (a, x), (b, y) = build(2 * node), build(2 * node + 1)
        if x == y == 0:
            x_, y_ = now[a], now[b]
            same = common_prefix(x_, y_, 0)
            if x_ <= y_:
                y = same
            else:
                a, b, y = b, a, same
                x = 0
        elif x < y:
            a, x, b, y = b, y, a, x
        loser[node], shares[node] = b, y
        return a, x

    winner, share = build(1)
    while share >= 0:
        yield winner, share, now[winner]
        found = next(sources[winner], None)
        if found is None:
            share, mine = -1, None
        else:
            share, mine = found
        now[winner] = mine
        node = (winner + size) >> 1
        while node:
            theirs = shares[node]
            if theirs > share:
                winner, loser[node] = loser[node], winner
                share, shares[node] = theirs, share
            elif theirs == share and share >= 0:
                a, b = now[winner], now[loser[node]]
                same = common_prefix(a, b, share)
                if a > b:
                    winner, loser[node] = loser[node], winner
                shares[node] = same
            node >>= 1


def repeated(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, places) of all entries of the keys that occur more than once in the runs together."""
    marks = [(r.weights > 1).tolist() for r in runs]
    at = [-1] * len(runs)
    last = -1
    for run, share, key in merge(runs):
        at[run] += 1
        if share == len(key):
            marks[run][at[run]] = True
            marks[last][at[last]] = True
        last = run
    picked = [np.repeat(np.array(m, bool), r.counts) for m, r in zip(marks, runs, strict=True)]
    ids = np.concatenate([np.empty(0, np.int64), *(r.ids[p] for r, p in zip(runs, picked, strict=True))])
    return ids, np.concatenate([np.empty(0, np.int64), *(r.places[p] for r, p in zip(runs, picked, strict=True))]).astype(np.int64)


@dataclass
class Pieces:
    """By entry of merged runs of pieces: id, lo, n (its strings start at lo .. lo + n - 1), before (how far before the
    anchor it starts), kind (REPEATED, its FIRST entry, or ALONE) and a hash of the anchor's run of bytes.
    """

    ids: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    before: np.ndarray
    kind: np.ndarray
    gram: np.ndarray


REPEATED, FIRST, ALONE = 0, 1, 2


def sorted_out(runs: list[Run]) -> Pieces:
    """Which pieces occur more than once in the runs together. Where no piece of an anchor stands alone, and all of them
    are here, none is marked FIRST, since nothing is left to look for.
    """
    kinds = [np.zeros(len(r.counts), np.uint8) for r in runs]
    heads = [np.zeros((len(r.counts), 2), np.uint8) for r in runs]
    grams = [np.zeros(len(r.counts), np.int64) for r in runs]
    at = [-1] * len(runs)
    group: list[tuple[int, int, bool]] = []  # (run, key's number there, alone) of the different keys of an anchor
    gram, dealt = 0, False

    def close() -> None:
        some = dealt or any(alone for _, _, alone in group)
        for run, k, alone in group:
            kinds[run][k] = ALONE if alone else FIRST if some else REPEATED
        group.clear()

    for run, share, key in merge(runs):
        at[run] += 1
        if share < GRAM:
            close()
            gram, dealt = int.from_bytes(hashlib.blake2b(key[:GRAM], digest_size=8).digest(), "little", signed=True), key[GRAM] >= DEALT
        heads[run][at[run]] = key[GRAM] & (DEALT - 1), key[GRAM + 1]
        grams[run][at[run]] = gram
        if share == len(key):
            group[-1] = (*group[-1][:2], False)
        else:
            group.append((run, at[run], runs[run].weights[at[run]] == 1))
    close()

    def entries(of: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([np.repeat(x, r.counts) for x, r in zip(of, runs, strict=True)])

    kind = entries(kinds)
    firsts = np.concatenate([np.isin(np.arange(len(r.ids)), np.cumsum(r.counts) - r.counts) for r in runs])
    kind[(kind == FIRST) & ~firsts] = REPEATED  # one entry is enough
    ids, lo = np.concatenate([r.ids for r in runs]), np.concatenate([r.places for r in runs]).astype(np.int64)
    return Pieces(ids, lo, entries([h[:, 1] for h in heads]).astype(np.int64), entries([h[:, 0] for h in heads]).astype(np.int64), kind, entries(grams))
