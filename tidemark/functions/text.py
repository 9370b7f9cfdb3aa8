"""Text functions on columns. Built-in expressions throughout; Arrow UDFs only for what Spark cannot say.

Each names its text once: Spark puts what a name stands for in its place, and where a Python function is among it also
where this makes it run several times. So a condition on a text that goes to Python is looked at there."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Named entities in the order in which they are replaced, so that &amp;lt; decodes twice.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))
#: Those of archive imports, in order.
IMPORT_ENTITIES = (*ENTITIES[:-1], ("&nbsp;", "\u00a0"), ("&eacute;", "é"))
_NUMBER = re.compile(r"\+?[0-9]+")
_HEX = re.compile(r"\+?[0-9a-fA-F]+")


def _character(body: str) -> str | None:
    """The character that a numeric entity names, or none."""
    base, digits = (16, body[1:]) if body[:1] in ("x", "X") else (10, body)
    if not (_HEX if base == 16 else _NUMBER).fullmatch(digits):
        return None
    code = int(digits, base) if len(digits) < 4000 else 1 << 32
    return None if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


def _decode_numbers(text: str) -> str:
    """Numeric entities from the first on, each up to the next semicolon; the first that is no character ends it all. What
    is decoded may begin the next one.
    """
    at, out, done = text.find("&#"), [], 0
    while at >= 0:
        if at > done:
            out.append(text[done:at])
        body = at + 2
        while True:
            end = text.find(";", body)
            found = _character(text[body:end]) if end >= 0 else None
            if found is None:
                return "".join([*out, "&#", text[body:]])
            done = end + 1
            if found == "&" and text[done : done + 1] == "#":
                body = done + 1
            elif found == "#" and out and out[-1].endswith("&"):
                out[-1] = out[-1][:-1]
                body = done
            else:
                break
        out.append(found)
        at = text.find("&#", done)
    return "".join([*out, text[done:]])


#: Texts that are Python's at once, of a batch of thousands.
_TEXTS = 256


def _changed(texts: pa.Array, needs: pa.Array, change) -> pa.Array:
    """texts, those that need it changed; the others never become Python's."""
    needs, parts = pc.fill_null(needs, False), []
    for at in range(0, len(texts), _TEXTS):
        some, need = texts.slice(at, _TEXTS), needs.slice(at, _TEXTS)
        new = pa.array([change(x) for x in some.filter(need).to_pylist()], texts.type)
        parts.append(pc.replace_with_mask(some, need, new) if len(new) else some)
    return pa.concat_arrays(parts) if parts else texts


@F.arrow_udf(StringType())
def _numeric_entities(s: pa.Array) -> pa.Array:
    return _changed(s, pc.match_substring(s, "&#"), _decode_numbers)


@F.arrow_udf(StringType())
def _nfc(s: pa.Array) -> pa.Array:
    return _changed(s, pc.not_equal(pc.binary_length(s), pc.utf8_length(s)), lambda x: unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Unicode NFC."""
    return _nfc(text)


def decode_entities(text: Column, numeric: bool = True, entities: tuple = ENTITIES) -> Column:
    for name, value in entities:
        text = F.replace(text, F.lit(name), F.lit(value))
    return _numeric_entities(text) if numeric else text


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends; Spark's own trims blanks only. A run of white space is looked at once."""
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")


def scalar_length(text: Column) -> Column:
    return F.length(text)


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?:https?://|www\.)\S*", "<url>")


def strip_tags(text: Column) -> Column:
    """Line breaks and ends of blocks become line feeds; other tags go, an unclosed one with the rest of the text."""
    text = F.regexp_replace(text, r"<(?:br|BR|Br)/?>|<(?:br|BR) />", "\n")
    text = F.regexp_replace(text, r"</(?:p|div|li|tr|h[1-4]|blockquote|pre|section|article)>", "\n")
    return F.regexp_replace(text, r"<[^>]*(?:>|\z)", "")


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]", "")


def squeeze(text: Column) -> Column:
    """Runs of blanks and tabs become a blank; blank lines go, others lose what white space they end with."""
    lines = F.split(F.regexp_replace(text, r"[ \t]+", " "), "\n", -1)
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)(?<!\s)\s++$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def minimize(text: Column, numeric: bool = True, compose: bool = True) -> Column:
    """Plain text of markup: entities, tags, controls, URLs, NFC, white space, in this order. Null stays null."""
    out = mask_urls(drop_controls(strip_tags(decode_entities(text, numeric))))
    return trim(squeeze(nfc(out) if compose else out))


def estimate_tokens(text: Column) -> Column:
    """A token for four characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def import_text(text: Column, entities: bool) -> Column:
    """Text of an archive record: line ends become line feeds, entities (if so wished) are decoded, NFC."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    return nfc(decode_entities(text, False, IMPORT_ENTITIES) if entities else text)


def evidence_passages(text: Column) -> Column:
    """Pieces after sentence ends and line feeds, trimmed, of at most 160 characters, that have a letter or digit."""
    pieces = F.transform(F.split(text, r"(?<=[.!?\n。！？])"), trim)
    parts = F.flatten(F.transform(pieces, _passages_of))
    return F.filter(parts, lambda x: F.regexp_count(x, F.lit(r"[\p{L}\p{N}]")) > 0)


def _passages_of(piece: Column) -> Column:
    """A piece cut after the last white space within 160 characters, again and again."""
    return F.regexp_extract_all(piece, F.lit(r"(?Us)(\S.{0,159}(?=\s|$)|\S.{0,159})"), F.lit(1))


def whole_text_evidence(text: Column) -> Column:
    """The trimmed text, or if longer its first 160 characters without trailing white space."""
    whole = trim(text)
    return F.when(F.length(whole) <= 160, whole).otherwise(F.regexp_replace(F.left(whole, F.lit(160)), r"(?U)\s+$", ""))


def tags(evidence: Column) -> Column:
    """The first three pieces between bars, trimmed and not empty, of 40 characters at most."""
    pieces = F.filter(F.transform(F.split(evidence, r"\|", -1), trim), lambda x: x != "")
    return F.coalesce(F.transform(F.slice(pieces, 1, 3), lambda x: F.left(x, F.lit(40))), F.array().cast("array<string>"))


def why_flagged(category: Column) -> Column:
    name = F.replace(F.coalesce(category, F.lit("other")), F.lit("_"), F.lit("-"))
    return F.concat(F.lit("Matches your "), name, F.lit(" review concern."))


def summary_of(summaries: Column) -> Column:
    return F.array_join(summaries, "; ")


def evidence_of(texts: Column) -> Column:
    return F.array_join(texts, " | ")


def contact(raw: Column) -> Column:
    """struct(kind, value) of an e-mail address (lower-cased) or a phone number (E.164, of the US by default), or null."""
    whole = trim(raw)
    mail = F.lower(whole)
    digits = F.regexp_replace(whole, r"[^0-9]", "")
    size = F.length(digits)
    phone = (
        F.when(F.startswith(whole, F.lit("+")) & size.between(8, 15), F.concat(F.lit("+"), digits))
        .when(size == 10, F.concat(F.lit("+1"), digits))
        .when((size == 11) & F.startswith(digits, F.lit("1")), F.concat(F.lit("+"), digits))
    )
    is_mail = F.coalesce(mail.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"), F.lit(False))
    is_phone = F.coalesce(whole.rlike(r"^\+?[0-9().\s-]+$"), F.lit(False)) & phone.isNotNull()
    return F.when(is_mail, F.struct(F.lit("email").alias("kind"), mail.alias("value"))).when(
        is_phone, F.struct(F.lit("phone").alias("kind"), phone.alias("value"))
    )


def safe_path(name: Column) -> Column:
    """Whether an archive entry's name can be taken: relative, at most 512 bytes and eight parts, none empty or dots."""
    parts = F.split(name, "/", -1)
    return (
        (name != "")
        & (F.octet_length(name) <= 512)
        & ~name.rlike(r"^/|[\\:\x00]")
        & (F.size(parts) <= 8)
        & F.forall(parts, lambda p: ~p.isin("", ".", ".."))
    )


# Segments --------------------------------------------------------------------------------------------------------------

_SENTENCE = re.compile("[.!?。！？]")


def _graphemes_within(text: str, most: int) -> int:
    """Characters of the whole graphemes within the first `most` characters; of the first one at least."""
    import regex

    end = 0
    for m in regex.finditer(r"\X", text):
        if end and m.end() > most:
            break
        end = m.end()
        if end >= most:
            break
    return end


def _cut(text: str, most: int) -> int:
    """Where to part a text longer than `most`: after the last blank line, sentence or before the last white space there."""
    window = text[:most]
    if (at := window.rfind("\n\n")) >= 0:
        return at + 2
    if ends := list(_SENTENCE.finditer(window)):
        end = ends[-1].end()
        return end + (text[end : end + 1] == " ")
    at = max((k for k, c in enumerate(window) if c.isspace()), default=0)
    while at and text[at - 1].isspace() and text[at - 1] != "\n":
        at -= 1
    return at or _graphemes_within(text, most)


def segments_of(text: str, most: int) -> list[str]:
    """Parts of about `most` characters (a blank after a sentence may be one more); joined, they are the text."""
    out = []
    while len(text) > most:
        at = _cut(text, most)
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text else out


def segments(text: Column, most: int, budget: int | None = None) -> Column:
    """array<string>. budget: tokens of a segment beyond which it is parted again, into pieces of four characters a token.
    An empty text has none.
    """
    smaller = most if budget is None else min(most, budget * 4)

    @F.arrow_udf(ArrayType(StringType()))
    def cut(s: pa.Array) -> pa.Array:
        def parts(x: str | None) -> list[str] | None:
            if x is None:
                return None
            first = segments_of(x, most)
            return [p for y in first for p in (segments_of(y, smaller) if budget is not None and (len(y) + 3) // 4 > budget else [y])]

        kind = pa.list_(s.type)
        each = [pa.array([parts(x) for x in s.slice(at, _TEXTS).to_pylist()], kind) for at in range(0, len(s), _TEXTS)]
        return pa.concat_arrays(each) if each else pa.array([], kind)

    return cut(text)
