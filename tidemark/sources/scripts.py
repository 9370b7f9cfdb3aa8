"""Script-wrapped arrays, `window.YTD.<dataset>.partN = [ ... ]`, element by element from blocks of bytes.

No more than one element and one block is held, whatever the file's size; brackets and quotes are found by regular
expressions, and each element is then checked by a JSON parser.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

# Levels of nesting with the array itself, bytes of an element, bytes before and after the array.
MAX_NESTING, MAX_ELEMENT, MAX_WRAPPER = 64, 4 << 20, 4096
_HEAD = re.compile(rb"(?:\xef\xbb\xbf)?\s*window\.YTD\.(\w+)\.part[0-9]+\s*=\s*\[")
_OUTSIDE, _INSIDE = re.compile(rb'["\[\]{},]'), re.compile(rb'["\\]')


def _pieces(blocks: Iterator[bytes], data: bytes) -> Iterator[tuple[bytes | None, int, bytes]]:
    """(element, nesting, what ended it) of what is between commas at the array's level; the element is None if it is beyond
    MAX_ELEMENT. What ended the last is `]` (then the rest of the block comes as a piece of its own) or nothing.
    """
    at = depth = deepest = size = 0
    parts: list[bytes] = []
    quoted = escaped = False
    while True:
        start, end = at, b""
        while at < len(data):
            if escaped:
                at, escaped = at + 1, False
                continue
            found = (_INSIDE if quoted else _OUTSIDE).search(data, at)
            if not found:
                at = len(data)
                break
            at, sign = found.end(), found[0]
            if quoted:
                quoted, escaped = sign != b'"', sign == b"\\"
            elif sign == b'"':
                quoted = True
            elif sign in b"[{":
                depth += 1
                deepest = max(deepest, depth)
            elif not depth:
                end = sign
                break
            elif sign in b"]}":
                depth -= 1
        piece = data[start : at - len(end)]
        piece = piece if size else piece.lstrip()
        size += len(piece)
        if size <= MAX_ELEMENT:
            parts.append(piece)
        else:
            parts.clear()
        if end:
            yield b"".join(parts) if size <= MAX_ELEMENT else None, deepest, end
            if end == b"]":
                yield data[at:], 0, b""
                return
            size = deepest = 0
            parts.clear()
        else:
            data, at = next(blocks, None), 0
            if data is None:
                yield b"".join(parts) if size <= MAX_ELEMENT else None, deepest, b""
                return


def elements(blocks: Iterable[bytes]) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(dataset, ordinal, element, error). An element that is too long or nested too deeply is resource_limit, and the next
    ones follow; one that is no JSON, or is missing, is malformed_record and the last. Before and after the array there may
    be only the wrapper and one semicolon, else malformed_wrapper.
    """
    blocks, head = iter(blocks), b""
    while not (found := _HEAD.match(head)):
        more = next(blocks, None)
        if more is None or len(head) > MAX_WRAPPER:
            yield "", 0, None, "malformed_wrapper"
            return
        head += more
    if found.end() > MAX_WRAPPER:
        yield "", 0, None, "malformed_wrapper"
        return
    dataset, pieces = found[1].decode(), _pieces(blocks, head[found.end() :])
    for k, (element, nesting, end) in enumerate(pieces):
        if end == b"]" and not k and element == b"":
            break
        if element is None or nesting >= MAX_NESTING:
            yield dataset, k, None, "resource_limit"
        else:
            try:
                text = element.decode().strip()
                json.loads(text)
            except (ValueError, RecursionError):
                text = None
            if text is None or end not in (b",", b"]"):
                yield dataset, k, None, "malformed_record"
                return
            yield dataset, k, text, None
        if end == b"]":
            break
        if end != b",":
            yield dataset, k + 1, None, "malformed_record"
            return
    else:
        return
    rest = next(pieces)[0]
    for more in blocks:
        rest = rest.strip() + more
        if len(rest.strip()) > MAX_WRAPPER:
            break
    if rest.strip() not in (b"", b";"):
        yield dataset, k + 1, None, "malformed_wrapper"
