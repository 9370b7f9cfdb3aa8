"""Redaction: names, ids and addresses become tokens, bodies are replaced; records keep their form.

Tokens depend on the salt, the kind and the value alone, so references hold after redaction, whatever task or run they are
made in, and no map of ids is kept.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing

#: Beginnings and lengths of tokens by kind (others: no beginning, 12 digits); an X id is a number.
FORMS = {"reddit_id": ("", 7), "reddit_post": ("", 7), "subreddit": ("r_", 8), "handle": ("user_", 8)}
#: Bodies and titles that tell a deletion.
KEPT = ("[deleted]", "[removed]", "[deleted by user]")
#: The host of redacted addresses, and members of an account's manifest with what they become.
HOST = "https://example.invalid/"
ACCOUNT = {"userName": "redacted_user", "displayName": "Redacted User", "accountId": "0000000000000000001"}


def token(salt: str, kind: str, value: Column) -> Column:
    """The token of a value; null is null."""
    if kind == "x_id":
        return F.conv(hashing.pseudonym(salt, kind, value, 15), 16, 10)
    start, size = FORMS.get(kind, ("", 12))
    return F.concat(F.lit(start), hashing.pseudonym(salt, kind, value, size))


def url(salt: str, value: Column) -> Column:
    """An address; null and empty ones stay."""
    return F.when(value == "", value).otherwise(F.concat(F.lit(HOST), token(salt, "url", value)))


def comments(rows: DataFrame, salt: str, place: Column) -> DataFrame:
    """Comment records (id, permalink, date, subreddit, link, parent, body) redacted; place numbers the bodies.

    Null and empty ids, parents and addresses stay as they are; a null body is replaced like any other. Other columns, and
    their names, stay.
    """
    body = F.when(F.col("body").isin(*KEPT), F.col("body")).otherwise(F.concat(F.lit("Synthetic comment body "), place.cast("string"), F.lit(".")))
    new = {
        "id": token(salt, "reddit_id", F.col("id")),
        "permalink": url(salt, F.col("permalink")),
        "subreddit": token(salt, "subreddit", F.col("subreddit")),
        "link": url(salt, F.col("link")),
        "parent": F.when(F.col("parent") == "", F.col("parent")).otherwise(token(salt, "reddit_id", F.col("parent"))),
        "body": body,
    }
    return rows.withColumns(new)


def account_manifest(text: Column) -> Column:
    """An account's manifest with its names and number replaced."""
    for member, value in ACCOUNT.items():
        text = F.regexp_replace(text, rf'"{member}"\s*:\s*"[^"]*"', f'"{member}" : "{value}"')
    return text


class Redactor:
    """Rewrites a record's tree by a table of rules: by member a rule (a function of the value), or a table of rules for an
    object or for each object of a list. Members without a rule stay, but for addresses in them.
    """

    def __init__(self, salt: str):
        self.salt = salt
        mention = {"screen_name": self.handle, "name": lambda v: "Synthetic User", "id_str": self.ident, "id": self.ident}
        address = {"url": self.url, "expanded_url": self.url}
        edits = {"editTweetIds": self.ident, "edit_tweet_ids": self.ident}
        references = [f"{who}_id{form}" for who in ("in_reply_to_status", "quoted_status", "in_reply_to_user") for form in ("", "_str")]
        self.tweet_rules = {
            "id": self.ident, "id_str": self.ident, "in_reply_to_screen_name": self.handle, **dict.fromkeys(references, self.ident),
            "entities": {"user_mentions": mention, "urls": address}, "edit_info": {"initial": edits, **edits}, "edit_control": {"initial": edits, **edits},
        }

    def token(self, kind: str, value: str) -> str:
        digest = hashlib.sha256(f"{self.salt}{kind}::{value}".encode("utf-8", "surrogatepass")).hexdigest()
        if kind == "x_id":
            return str(int(digest[:15], 16))
        start, size = FORMS.get(kind, ("", 12))
        return start + digest[:size]

    def ident(self, value: Any) -> Any:
        """A number stays a number and a text a text; null, empty and zero stay; of a list each."""
        if isinstance(value, list):
            return [self.ident(v) for v in value]
        new = self.token("x_id", str(value)) if value else value
        return int(new) if value and isinstance(value, int) else new

    def handle(self, value: Any) -> Any:
        return self.token("handle", value) if value else value

    def url(self, value: Any) -> Any:
        return HOST + self.token("url", value) if value else value

    def rewrite(self, value: Any, rules: dict | Callable | None) -> Any:
        if callable(rules):
            return rules(value)
        if isinstance(value, list):
            return [self.rewrite(v, rules) for v in value]
        if isinstance(value, dict):
            return {k: self.rewrite(v, (rules or {}).get(k)) for k, v in value.items()}
        return self.url(value) if isinstance(value, str) and "://" in value else value

    def tweet(self, row: dict, place: int) -> dict:
        """A row {"tweet": {...}}, or a tweet of the old form by itself, of which only id, text and date stay."""
        if "tweet" not in row:
            return {"id": int(self.token("x_id", str(row.get("id")))), "text": f"Synthetic classic tweet {place}", "created_at": row.get("created_at")}
        own = row["tweet"]
        said = own.get("full_text") or own.get("text") or ""
        out = self.rewrite({k: v for k, v in own.items() if k not in ("full_text", "text")}, self.tweet_rules)
        if said.startswith("@"):
            out["full_text"] = f"@{self.handle('reply')} synthetic reply {place}"
        elif said.startswith("RT @"):
            out["full_text"] = f"RT @{self.handle('rt')}: synthetic retweet {place}"
        else:
            out["full_text"] = f"Synthetic tweet body {place}"
        if "text" in own:
            out["text"] = f"Synthetic classic tweet {place}"
        return {"tweet": out}

    def note(self, row: dict, place: int) -> dict:
        own = row.get("noteTweet", row)
        core = {"text": lambda v: f"Synthetic long-form note body {place}."}
        return {"noteTweet": self.rewrite(own, {"noteTweetId": self.ident, "core": core})}


def records(rows: DataFrame, salt: str, kind: str = "tweet", record_col: str = "record", place_col: str = "place") -> DataFrame:
    """rows with the record (JSON of a tweet's or note's row) redacted. A null record, and one that is no JSON object, is
    null: nothing of it can be told apart. All other columns stay, whatever their names; no rows give none.
    """
    at, of = rows.columns.index(record_col), rows.columns.index(place_col)

    def run(batches):
        import pyarrow as pa

        redactor = Redactor(salt)
        change = getattr(redactor, kind)

        def one(text: str | None, place: int) -> str | None:
            try:
                row = json.loads(text or "")
                return json.dumps(change(row, place), ensure_ascii=False, separators=(",", ":")) if isinstance(row, dict) else None
            except (ValueError, AttributeError, TypeError, RecursionError):
                return None

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                new = [one(t, p) for t, p in zip(part.column(at).to_pylist(), part.column(of).to_pylist(), strict=True)]
                columns = [pa.array(new, part.schema.field(at).type) if j == at else c for j, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return rows.mapInArrow(run, rows.schema)
