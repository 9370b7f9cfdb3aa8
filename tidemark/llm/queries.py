"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, common, decontam, langid, license, media, neardup, pii, quality, repeats, toxicity, urls, whitening


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


OP1_RULES = [
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    links = common.checkpointed(urls.html_links(pages))
    return urls.judge(pages, links, OP1_RULES).withColumnRenamed("id", "page_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")

    def held_out(doc_id: F.Column) -> F.Column:
        """A null id is not held out."""
        return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))

    found = langid.identify(docs, langid.train(docs.where(~held_out(F.col("doc_id")))))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "accepted")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = decontam.hit_words(F.col("hits"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))

    def order(kind: F.Column) -> F.Column:
        return F.array_position(F.array(*map(F.lit, pii.KINDS)), kind)

    def listed(spans: F.Column) -> F.Column:
        by = F.transform(spans, lambda s: F.struct(order(s["kind"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(by), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    plain = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(
        F.col("id").alias("doc_id"),
        *map(count, pii.BASE_KINDS),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", plain)).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    tokens = bpe.encode_decode(docs, rank_file(), split_pattern())
    return tokens.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs)).withColumnRenamed("id", "doc_id")


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.write_streams(common.table(spark, sf_dir, "documents"))
    read = media.read_streams(stored)
    units = F.col("units")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("units="), F.size(units)),
        F.concat(F.lit("random_access="), F.size(F.filter(units, lambda u: u["random_access"]))),
        F.concat(F.lit("clocks="), F.size("clocks")),
        F.concat(F.lit("pts_sum="), F.aggregate(units, F.lit(0).cast("long"), lambda n, u: n + u["pts"])),
        F.concat(F.lit("last_pts="), F.try_element_at(units, F.lit(-1))["pts"]),
        F.concat(F.lit("packets="), "packets"),
        F.concat(F.lit("errors="), F.col("counter_errors") + F.col("table_errors") + F.col("sync_errors")),
        F.concat(F.lit("mean="), F.format_string("%.6f", "mean")),
        F.concat(F.lit("deviation="), F.format_string("%.6f", "deviation")),
        F.concat(F.lit("distinct="), "distinct_samples"),
    )
    return read.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


#: Template label -> the label that the query reports for it.
OP9_LABELS = {
    "agpl-header": "agpl",
    "apache-header": "apache",
    "apache-2.0": "apache",
    "bsd": "bsd",
    "bsd-conditions": "bsd",
    "cc0": "cc0",
    "cc-by-4.0": "cc-by",
    "cc-by-nc-4.0": "cc-by-nc",
    "agpl-notice": "agpl",
    "epl-notice": "epl",
    "lgpl-3-header": "lgpl",
    "lgpl-notice": "lgpl",
    "mpl-notice": "mpl",
    "gpl-header": "gpl",
    "gpl-2.0": "gpl",
    "gpl-3.0": "gpl",
    "isc": "isc",
    "lgpl-header": "lgpl",
    "mit-permission": "mit",
    "mit-grant": "mit",
    "mit-notice": "mit",
    "mpl-2.0": "mpl",
    "public-domain": "public-domain",
    "unlicense": "public-domain",
}


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(common.table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    labels = F.create_map(*[F.lit(x) for pair in OP9_LABELS.items() for x in pair])
    own = F.transform("matches", lambda m: F.element_at(labels, m["label"]))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.array_distinct(own))), ",").alias("labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("chosen", lambda c: F.element_at(labels, c)))), ",").alias("chosen"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(common.table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.flagged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return audit.audit(rows, "ABCDE", ("good", "toxic"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")

    def held_out(doc_id: F.Column) -> F.Column:
        """A null id is not held out."""
        return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))

    found = toxicity.score(docs, toxicity.train(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id")))))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP1_SQL = r"""
WITH RECURSIVE
p AS (SELECT page_id, url, html FROM pages),
tag AS (SELECT url AS source, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b(?:((?:"[^"]*"|''[^'']*''|[^"''>])*)>|.*)', 1)) AS tag FROM p),
att AS (
  SELECT source, list_transform(regexp_extract_all(tag, pat, 1), lambda x: lower(x)) AS k,
         list_transform(list_zip(regexp_extract_all(tag, pat, 2), regexp_extract_all(tag, pat, 3), regexp_extract_all(tag, pat, 4)), lambda x: x[1] || x[2] || x[3]) AS v
  FROM tag, (SELECT '([^\s"''>/=]+)(?:\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+)))?' AS pat)),
val AS (SELECT source, coalesce(v[list_position(k, 'rel')], '') AS rel, coalesce(v[list_position(k, 'href')], '') AS href,
               coalesce(v[list_position(k, 'http-equiv')], '') AS equiv, coalesce(v[list_position(k, 'content')], '') AS content FROM att),
lnk AS (
  SELECT source, replace(trim(CASE
    WHEN list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN href
    WHEN lower(equiv) = 'refresh' THEN regexp_extract(content, '(?i)url\s*=\s*[''"]?([^''"\s]+)', 1) END), '&amp;', '&') AS target FROM val),
urls AS (
  SELECT source, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN 'http://' || regexp_extract(source, '://([^/?#]*)', 1) || target
    ELSE 'http://' || regexp_extract(source, '://([^/?#]*)', 1)
      || coalesce(nullif(regexp_extract(source, '://[^/?#]*(/[^?#]*/|/)', 1), ''), '/') || target END AS target
  FROM lnk WHERE target <> '' AND source IS NOT NULL),
one AS (SELECT url FROM p UNION SELECT source FROM urls UNION SELECT target FROM urls),
parts AS (
  SELECT url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         regexp_extract(url, '^[^#]*?(\?[^#]*)', 1) AS query FROM one),
rules(h, t, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT url, arg_max(h || t, length(h || t)) AS rule, arg_max(v, length(h || t)) AS own
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY url),
n AS (SELECT parts.url, host, path, CASE WHEN contains(parts.url, '://') THEN host || path || query END AS node, rule, own FROM parts LEFT JOIN fits USING (url)),
e AS (SELECT a.node AS a, b.node AS b FROM urls JOIN n a ON a.url = source JOIN n b ON b.url = target),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
class AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
says AS (SELECT component, bool_or(own = 'allow') AS allows, bool_or(own = 'block') AS blocks FROM class JOIN n USING (node) GROUP BY component)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(own, CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' ELSE 'allow' END) AS verdict, class.component
FROM p LEFT JOIN n ON n.url = p.url LEFT JOIN class USING (node) LEFT JOIN says ON says.component = class.component
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language": op2_language,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_decontamination": op4_decontamination,
    "op5_personal_data": op5_personal_data,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality": op7_quality,
    "op8_transport_stream": op8_transport_stream,
    "op9_license_scan": op9_license_scan,
    "op10_repeats": op10_repeats,
    "op11_filter_audit": op11_filter_audit,
    "op12_whitening": op12_whitening,
    "op13_toxicity": op13_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op4_decontamination": decontam.ORACLE_SQL,
    "op9_license_scan": license.oracle_sql(OP9_LABELS),
    "op11_filter_audit": audit.ORACLE_SQL,
}
