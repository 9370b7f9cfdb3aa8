"""Post archives as tables: files to entries, entries to records. Errors are codes in a column, never exceptions.

What is read block by block is in `ranges` (ZIP), `delimited` (records) and `scripts` (arrays); what follows (which entries
count, limits, order of parts, what records mean) are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, text
from . import delimited, ranges, scripts

# Limits of archives.
MAX_ARCHIVE, MAX_ENTRIES, MAX_SELECTED, MAX_ENTRY, MAX_TOTAL, MAX_RATIO, MAX_TOTAL_RATIO = 2 << 30, 100_000, 4_096, 128 << 20, 512 << 20, 200, 100
MAX_FIELD = 1 << 20
REDDIT = r"^(?:posts|comments|statistics|checkfile)\.csv$"
X = r"^data/(?:manifest|tweets|tweet|note-tweet|deleted-tweets|tweets?-part[0-9]{1,4}|tweets/[0-9]{4}_(?:0[1-9]|1[0-2]))\.js$"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, size, modified, content) of all files of a folder, from whatever store Spark reads."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("archive"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content"
    )


def zip_entries(files: DataFrame) -> DataFrame:
    """(archive, ordinal, name, size, compressed, method, encrypted, content, error) of each entry of each ZIP at hand
    (archive, content), for archives that are small; `ranges` reads others.

    Names that no platform allows are listed without content. A file that is no ZIP, or has bytes after its end record's
    comment, gives one row with invalid_archive; an entry whose size or checksum is wrong integrity_mismatch.
    """
    wanted = f"{REDDIT}|{X}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        allowed = re.compile(wanted)

        def one(row: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = ranges.Bytes(content)
                try:
                    listed = list(ranges.directory_of(file))
                except ranges.Broken as error:
                    yield one({"archive": archive, "error": str(error)})
                    continue
                mine = [e for e in listed if allowed.match(e["name"])]
                # By the directory alone: an archive beyond the limits is listed, and nothing of it inflated.
                fits = len(listed) <= MAX_ENTRIES and len(mine) <= MAX_SELECTED and sum(e["size"] for e in mine) <= MAX_TOTAL
                fits &= all(e["size"] <= MAX_ENTRY and e["size"] // max(e["compressed"], 1) <= MAX_RATIO for e in mine)
                for e in listed:
                    row = {"archive": archive, **e, "content": None, "error": None}
                    if fits and allowed.match(e["name"]) and not e["encrypted"]:
                        try:
                            row["content"] = b"".join(ranges.inflated(file, e))
                        except ranges.Broken as error:
                            row["error"] = str(error)
                    yield one(row)

    kinds = pa.schema(
        [("archive", pa.string()), ("ordinal", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("compressed", pa.int64()), ("method", pa.int32()), ("encrypted", pa.bool_()), ("content", pa.binary()), ("error", pa.string())]
    )
    return files.select("archive", "content").mapInArrow(
        run, "archive string, ordinal int, name string, size long, compressed long, method int, encrypted boolean, content binary, error string"
    )


def part_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^data/tweets?-part([0-9]{1,4})\.js$", 1).try_cast("int")


def archive_errors(entries: DataFrame, platform: str) -> DataFrame:
    """(archive, error): the first rule that an archive breaks, or null. platform: reddit or x."""
    name, mine, other = F.col("name"), REDDIT if platform == "reddit" else X, X if platform == "reddit" else REDDIT
    own = F.coalesce(name.rlike(mine), F.lit(False))
    theirs = F.coalesce(name.rlike(other), F.lit(False))
    part = part_number(name)
    facts = entries.groupBy("archive").agg(
        F.max("error").alias("error"),
        F.count("*").alias("n"),
        F.bool_or(F.coalesce(~text.safe_path(name), F.lit(False))).alias("unsafe"),
        (F.count("*") > F.countDistinct(text.nfc(name))).alias("twice"),
        F.bool_or(name.rlike(r"(?i)\.zip$")).alias("nested"),
        F.bool_or(own).alias("mine"),
        F.bool_or(theirs).alias("theirs"),
        F.bool_or(F.col("encrypted")).alias("locked"),
        F.bool_or(own & ~F.col("method").isin(0, 8)).alias("odd_method"),
        F.count_if(own).alias("selected"),
        F.max(F.when(own, F.col("size"))).alias("largest"),
        F.sum(F.when(own, F.col("size"))).alias("total"),
        F.max(F.when(own, F.expr("size div greatest(compressed, 1)"))).alias("ratio"),
        F.sum(F.when(own, F.col("compressed"))).alias("packed"),
        F.count(part).alias("parts"),
        F.countDistinct(part).alias("part_kinds"),
        F.max(part).alias("last_part"),
        F.min(part).alias("first_part"),
    )
    c = F.col
    rules = [
        (c("error") == "invalid_archive", "invalid_archive"),
        (c("n") > MAX_ENTRIES, "resource_limit"),
        (c("unsafe"), "unsafe_path"),
        (c("nested"), "nested_archive"),
        (c("twice"), "duplicate_entry"),
        (c("mine") & c("theirs"), "ambiguous_archive"),
        (c("theirs"), "platform_mismatch"),
        (~c("mine"), "unsupported_archive"),
        (c("locked"), "encrypted_archive"),
        (c("odd_method"), "unsupported_compression"),
        ((c("selected") > MAX_SELECTED) | (c("largest") > MAX_ENTRY) | (c("total") > MAX_TOTAL), "resource_limit"),
        ((c("ratio") > MAX_RATIO) | (F.expr("total div greatest(packed, 1)") > MAX_TOTAL_RATIO), "resource_limit"),
        ((c("parts") > 1) & ~((c("first_part") == 0) & (c("last_part") == c("parts") - 1) & (c("part_kinds") == c("parts"))), "missing_shard"),
        (c("error").isNotNull(), "integrity_mismatch"),
    ]
    from ..operators.scan import first_error

    return facts.select("archive", first_error(rules).alias("error"))


# Comma-separated records ------------------------------------------------------------------------------------------------

_ID = r"^[a-z0-9]{1,20}$"
# The columns of both files.
COMMENTS = ("id", "permalink", "date", "subreddit", "parent", "body")
POSTS = ("id", "permalink", "date", "subreddit", "title", "url", "body")


def read_csv(spark: SparkSession, path: str, kind: str, split: int = delimited.SPLIT) -> DataFrame:
    """(id, permalink, created, parent, title, body, record_bytes, malformed, format_confidence) of comments or posts files.

    Files are read in splits, see `delimited`. Columns go by name, whatever their order; a byte order mark is skipped;
    quotes are doubled; records may span lines. A record of another width is malformed. format_confidence: confirmed for
    exactly the columns of comments, compatible for others of comments, provisional for posts.
    """
    rows = delimited.read_records(spark, path, tuple(dict.fromkeys(COMMENTS + POSTS)), COMMENTS if kind == "comments" else POSTS, split)
    return _of_kind(rows, kind)


def _of_kind(rows: DataFrame, kind: str) -> DataFrame:
    confidence = F.when(F.col("exact"), "confirmed").otherwise("compatible") if kind == "comments" else F.lit("provisional")
    return rows.select("id", "permalink", F.col("date").alias("created"), "parent", "title", "body", "record_bytes", "malformed", confidence.alias("format_confidence"))


def csv_records(rows: DataFrame, kind: str) -> DataFrame:
    """(source_id, created_at, state, title, body, parent_id, format_confidence, error) of read_csv's rows.

    A permalink's id is its last part for comments, and the part after `comments` for posts; one without that part names
    none. What is deleted or removed has no text; what is active has to have some.
    """
    parts = F.filter(F.split(F.coalesce("permalink", F.lit("")), "/"), lambda p: p != "")
    at_comments = F.array_position(parts, "comments").cast("int")
    linked = F.when(at_comments > 0, F.get(parts, at_comments) if kind == "posts" else F.get(parts, F.size(parts) - 1))
    body, title = F.coalesce("body", F.lit("")), F.coalesce("title", F.lit(""))
    deleted = (body == "[deleted]") | title.isin("[deleted]", "[deleted by user]")
    removed = (body == "[removed]") | (title == "[removed]")
    state = F.when(deleted, "deleted").when(removed, "removed").otherwise("active")
    active = state == "active"
    parent = F.coalesce("parent", F.lit(""))
    at = scalars.archive_time(F.col("created"))
    rules = [
        (F.col("record_bytes") > delimited.MAX_RECORD, "resource_limit"),
        (F.col("malformed"), "invalid_record"),
        (~F.coalesce(F.col("id").rlike(_ID), F.lit(False)), "invalid_record"),
        (F.coalesce(linked != F.col("id"), F.lit(False)), "invalid_record"),
        (active & ((F.octet_length(body) > MAX_FIELD) | (F.octet_length(title) > MAX_FIELD)), "resource_limit"),
        (active & (text.trim(body) == ""), "invalid_record"),
        (F.lit(kind == "posts") & active & (text.trim(title) == ""), "invalid_record"),
        (F.lit(kind == "comments") & ~parent.rlike(r"^t[13]_[a-z0-9]{1,20}$"), "invalid_record"),
        (at.isNull(), "invalid_record"),
    ]
    from ..operators.scan import first_error

    return rows.select(
        F.col("id").alias("source_id"),
        at.alias("created_at"),
        state.alias("state"),
        F.when(active & F.lit(kind == "posts"), text.import_text(title, False)).alias("title"),
        F.when(active, text.import_text(body, False)).alias("body"),
        F.when(F.lit(kind == "comments") & (parent != ""), F.substring(parent, 4, 20)).alias("parent_id"),
        "format_confidence",
        first_error(rules).alias("error"),
    )


# Script-wrapped arrays --------------------------------------------------------------------------------------------------


_ELEMENTS = ("archive", "name", "dataset", "ordinal", "element", "error")
_ELEMENTS_SCHEMA = "archive string, name string, dataset string, ordinal int, element string, error string"


def _batches(archive: str, name: str, found: Iterator[tuple[str, int, str | None, str | None]]) -> Iterator[pa.RecordBatch]:
    """Rows of elements, some thousands of them or some megabytes at once."""
    kinds = pa.schema(list(zip(_ELEMENTS, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)))
    rows, held = [], 0
    for e in found:
        rows.append(dict(zip(_ELEMENTS, (archive, name, *e), strict=True)))
        held += len(e[2] or "")
        if len(rows) == 1000 or held > scripts.MAX_ELEMENT:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def js_elements(entries: DataFrame) -> DataFrame:
    """(archive, name, dataset, ordinal, element, error) of entries with content: a row for each element of each array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, name, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield from _batches(archive, name, scripts.elements([content or b""]))

    return entries.select("archive", "name", "content").mapInArrow(run, _ELEMENTS_SCHEMA)


def js_elements_by_range(entries: DataFrame) -> DataFrame:
    """The same of entries listed by `ranges.directory`, inflated and parsed block by block. An entry whose size or checksum
    is wrong has, after its elements, a row with integrity_mismatch: none of them count.
    """

    def parse(blocks: Iterator[bytes], entry: dict) -> Iterator[pa.RecordBatch]:
        return _batches(entry["archive"], entry["name"], scripts.elements(blocks))

    def failed(entry: dict, code: str) -> pa.RecordBatch:
        return next(_batches(entry["archive"], entry["name"], iter([("", 0, None, code)])))

    return ranges.read_entries(entries, parse, _ELEMENTS_SCHEMA, failed)


def status_id(url: Column) -> Column:
    """The digits after the last /status/ of an address of the two hosts, or null."""
    rest = F.regexp_extract(url, r"^https://(?:x|twitter)\.com/(.*)$", 1)
    parts = F.split(rest, "/status/", -1)
    found = F.split(F.element_at(parts, -1), r"[?#/]", -1)[0]
    return F.when((F.size(parts) > 1) & found.rlike(r"^[0-9]+$"), found)


def tweets(elements: DataFrame) -> DataFrame:
    """(archive, name, ordinal, revision, logical_id, created_at, state, kind, authorship, body, parent_id, quoted_id,
    relation_confidence, chain, error) of elements of tweets and deleted tweets. Ids stay strings: they are unsigned 64-bit
    numbers.

    What is deleted has no text, and can be a reply but no repost. A repost is neither a reply nor a quote; only what is no
    reply can be a quote, and of exactly one other status; its link goes from its text, and white space there becomes
    single blanks.
    """
    inner = F.coalesce(F.get_json_object("element", "$.tweet"), F.col("element"))
    rows = elements.where(F.col("dataset").isin("tweets", "tweet", "deleted_tweets")).select("archive", "name", "ordinal", "dataset", "error", inner.alias("tweet"))

    def get(path: str) -> Column:
        return F.get_json_object("tweet", f"$.{path}")

    digits = r"^[0-9]+$"
    own, number = get("id_str"), get("id")
    revision = F.coalesce(own, number)
    deleted = F.col("dataset") == "deleted_tweets"
    body = F.when(~deleted, text.import_text(F.coalesce(get("full_text"), get("text")), True))
    listed = F.coalesce(get("edit_control.edit_tweet_ids"), get("edit_control.editTweetIds"), get("editControl.edit_tweet_ids"), get("editControl.editTweetIds"))
    chain = F.from_json(listed, "array<string>")
    bad_chain = listed.isNotNull() & ~F.coalesce(F.forall(chain, lambda x: F.coalesce(x.rlike(digits), F.lit(False))) & F.array_contains(chain, revision), F.lit(False))
    reply = F.coalesce(get("in_reply_to_status_id_str"), get("in_reply_to_status_id"))
    repost = ~deleted & (F.coalesce(F.startswith(body, F.lit("RT @")), F.lit(False)) | get("retweeted_status").isNotNull())
    links = F.from_json(get("entities.urls"), "array<struct<url:string,expanded_url:string>>")
    links = F.transform(links, lambda u: F.struct(u["url"].alias("token"), status_id(u["expanded_url"]).alias("id")))
    others = F.filter(links, lambda u: u["token"].isNotNull() & u["id"].isNotNull() & (u["id"] != revision))
    can_quote = ~repost & reply.isNull() & (F.size(F.array_distinct(F.transform(others, lambda u: u["id"]))) == 1)
    quoted = F.when(can_quote, F.get(others, F.lit(0))["id"])
    without_link = text.trim(F.regexp_replace(F.replace(body, F.element_at(others, -1)["token"], F.lit("")), r"(?U)\s+", " "))
    reposted = F.when(F.startswith(body, F.lit("RT @")), F.regexp_replace(body, r"(?Us)^RT @[^:]*:\s*", "")).otherwise(body)
    kind = F.when(repost, "repost").when(reply.isNotNull(), "reply").when(quoted.isNotNull(), "quote").otherwise("post")
    at = scalars.tweet_time(get("created_at"))
    rules = [
        (F.col("error").isNotNull(), "invalid_record"),
        (~F.coalesce(revision.rlike(digits), F.lit(False)), "invalid_record"),
        (own.isNotNull() & number.isNotNull() & (own != number), "invalid_record"),
        (at.isNull(), "invalid_record"),
        (bad_chain, "invalid_edit_chain"),
        (~deleted & body.isNull(), "invalid_record"),
        (F.octet_length(F.coalesce(get("full_text"), get("text"))) > MAX_FIELD, "resource_limit"),
        (~deleted & (body == ""), "invalid_record"),
        (reply.isNotNull() & ~reply.rlike(digits), "invalid_record"),
    ]
    from ..operators.scan import first_error

    chain = F.coalesce(chain, F.array(revision))
    return rows.select(
        "archive",
        "name",
        "ordinal",
        revision.alias("revision"),
        F.get(chain, F.lit(0)).alias("logical_id"),
        at.alias("created_at"),
        F.when(deleted, "deleted").otherwise("active").alias("state"),
        kind.alias("kind"),
        F.when(repost, "reshared").otherwise("owner_authored").alias("authorship"),
        F.when(repost, reposted).when(quoted.isNotNull(), without_link).otherwise(body).alias("body"),
        F.when(~repost, reply).alias("parent_id"),
        quoted.alias("quoted_id"),
        F.when(~repost & reply.isNotNull(), "explicit").when(quoted.isNotNull(), "heuristic").otherwise("none").alias("relation_confidence"),
        chain.alias("chain"),
        first_error(rules).alias("error"),
    )


def notes(elements: DataFrame) -> DataFrame:
    """(archive, created_at, text) of long-form notes."""
    inner = F.coalesce(F.get_json_object("element", "$.noteTweet"), F.get_json_object("element", "$.note_tweet"), F.col("element"))
    body = F.coalesce(F.get_json_object(inner, "$.core.text"), F.get_json_object(inner, "$.note.text"), F.get_json_object(inner, "$.text"))
    return elements.where("dataset = 'note_tweet'").select(
        "archive", scalars.archive_time(F.get_json_object(inner, "$.createdAt")).alias("created_at"), text.import_text(body, True).alias("text")
    )


# Evaluation -------------------------------------------------------------------------------------------------------------

GOLD = """case_id string, slice string, input string, expect_invariant_failure boolean, score_decisions boolean,
 expect struct<decisions:map<string,string>,risk_at_least:map<string,string>,category:map<string,string>,authorship:map<string,string>>"""


def gold_cases(spark: SparkSession, folder: str, suite: str) -> DataFrame:
    """Cases of the core or edge suite, or of all; blank lines are skipped."""
    if suite not in ("core", "edge", "all"):
        raise ValueError(f"no suite named {suite}")
    paths = [f"{folder}/scan-v1.{s}.jsonl" for s in (("core", "edge") if suite == "all" else (suite,))]
    return spark.read.schema(GOLD).json(paths)


def replay_bodies(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """(case_id, body, matches): recorded answers; matches: whether the digest is that of the index."""
    files = spark.read.option("wholetext", True).text(folder).withColumn("_path", F.input_file_name())
    files = files.withColumn("case_id", F.regexp_extract("_path", r"([^/]+)\.response\.json$", 1)).where("case_id <> ''")
    digest = F.sha2(F.col("value").cast("binary"), 256)
    return index.join(files, "case_id", "left").select("case_id", F.col("value").alias("body"), F.coalesce(digest == F.col("response_sha256"), F.lit(False)).alias("matches"))
