"""Digests and message authentication on columns."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def sha256_hex(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 as binary: two digests, the padded keys being constants of the plan."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256))


def big_endian(x: Column, size: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), size * 2, "0"))


def uuid_bytes(x: Column) -> Column:
    return F.unhex(F.replace(x, F.lit("-"), F.lit("")))


def batch_id(key_id: str, key: bytes, scan: Column, ordinal: Column, prompt_sha256: bytes, items: Column) -> Column:
    """key_id and the hex HMAC over the scan, the batch's ordinal, the prompt and each item's (hmac, segment).

    items: array<struct<content_hmac binary, segment_ordinal>> in order of the batch.
    """
    each = F.array_join(F.transform(items, lambda i: F.concat(F.hex(i["content_hmac"]), F.hex(big_endian(i["segment_ordinal"])))), "")
    message = F.concat(uuid_bytes(scan), big_endian(ordinal), F.lit(bytearray(prompt_sha256)), F.unhex(each))
    return F.concat(F.lit(f"{key_id}."), F.lower(F.hex(hmac_sha256(key, message))))


def content_hash(hmac: Column, text: Column) -> Column:
    return F.coalesce(hmac, F.unhex(sha256_hex(text)))


def name_digest(name: Column) -> Column:
    return F.left(sha256_hex(name), F.lit(32))


def stub_byte(index: Column, text: Column) -> Column:
    """First byte of the digest of "index:text"."""
    return F.conv(F.left(sha256_hex(F.concat_ws(":", index.cast("string"), text)), F.lit(2)), 16, 10).cast("int")


def pool_offset(value: Column, size: Column) -> Column:
    """The digest's first eight bytes as an unsigned integer, modulo size."""
    return (F.conv(F.left(sha256_hex(value), F.lit(16)), 16, 10).cast("decimal(20,0)") % size.cast("decimal(20,0)")).cast("long")


def pseudonym(salt: str, kind: str, value: Column, size: int = 12) -> Column:
    return F.left(F.sha2(F.concat(F.lit(f"{salt}{kind}::"), value).cast("binary"), 256), F.lit(size))


#: Control characters that two writers of JSON escape with digits of another case.
_UPPER_ESCAPES = (*"BEF", *(f"1{d}" for d in "ABCDEF"))


def json_text(x: Column) -> Column:
    """A text as JSON, with lower-case digits in escapes; null is null."""
    out = F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    for digits in _UPPER_ESCAPES:
        code = digits.rjust(4, "0")
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    return F.when(x.isNull(), "null").otherwise(out)


def json_number(x: Column) -> Column:
    """A real number of 0 up to 1,000 in its shortest form: with a point, and with an exponent only below 0.00001."""
    plain, small = x.cast("double").cast("string"), (x > 0) & (x < 0.001)
    digits = F.replace(F.regexp_replace(F.regexp_extract(plain, r"^([^E]*)", 1), r"\.0$", ""), F.lit("."), F.lit(""))
    power = F.regexp_extract(plain, r"E-(\d+)$", 1).cast("int")
    point = F.concat(F.lit("0."), F.repeat(F.lit("0"), power - 1), digits)
    short = F.concat(F.regexp_replace(F.regexp_extract(plain, r"^([^E]*)", 1), r"\.0$", ""), F.lit("e-"), power.cast("string"))
    return F.when(small & (x < 0.00001), short).when(small, point).otherwise(plain)


def json_list(items: Column, each) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, each), ","), F.lit("]"))


def json_object(**fields: Column) -> Column:
    """Members in order of their names; the values are JSON already."""
    parts = [F.concat(F.lit(f'"{name}":'), fields[name]) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_results(results: Column) -> Column:
    """Results of a batch (those of scan.ANSWER) as JSON: in order of item_index, members in order of their names."""

    def one(r: Column) -> Column:
        return json_object(
            category=json_text(r["category"]),
            confidence=json_number(r["confidence"]),
            decision=json_text(r["decision"]),
            evidence=json_list(r["evidence"], lambda e: json_object(supportsReasonCode=json_text(e["supports_reason_code"]), text=json_text(e["text"]))),
            itemIndex=r["item_index"].cast("string"),
            reasons=json_list(r["reasons"], lambda x: json_object(code=json_text(x["code"]), summary=json_text(x["summary"]))),
            risk=json_text(r["risk"]),
        )

    places = F.array_sort(F.transform(results, lambda r, k: F.struct(r["item_index"].alias("at"), k.alias("k"))))
    return json_list(F.transform(places, lambda p: F.get(results, p["k"])), one)


def request_hash(**fields: Column) -> Column:
    """SHA-256 of a request's JSON, members in order of their names; the values are JSON already."""
    return sha256_hex(json_object(**fields))


def _canonical(x: str) -> str | None:
    try:
        return json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """A text of JSON of any shape in its canonical form: members by code points of their names, at every level, no blanks,
    the shortest form of numbers, nothing escaped that need not be. Of equal names the last counts. What is no JSON is null.
    """
    return x.map(_canonical, na_action="ignore")


def content_identity(key: bytes, tenant: Column, record: Column) -> Column:
    """HMAC-SHA-256 in hex over the tenant's bytes and a record's canonical JSON; null where either is."""
    return F.lower(F.hex(hmac_sha256(key, F.concat(tenant.cast("binary"), canonical_json(record).cast("binary")))))


def table_hash(value: object) -> str:
    """SHA-256 in hex of the canonical JSON of a fixed table of the policy: another table, another hash."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
