"""The registered queries of the library and their SQL. Domain tables are views of the test tables, the same on both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, redact, scalars, text
from ..operators import evaluate, review, scan, store
from . import catalog

KEY = b"example-key-of-the-tests"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "stub_scan_flags"


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def content_items(spark: SparkSession, folder: str) -> DataFrame:
    """documents as posts: the source is the tenant."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.col("source").alias("tenant"),
        F.when(F.col("doc_id") % 2 == 0, "reddit").otherwise("x").alias("platform"),
        F.when(F.col("doc_id") % 5 == 0, "amplified").otherwise("authored").alias("authorship"),
        F.col("text").alias("body"),
    )


def flags_of(spark: SparkSession, folder: str) -> DataFrame:
    """documents as flags."""
    k = F.col("doc_id")
    return table(spark, folder, "documents").select(
        F.col("source").alias("tenant"),
        k.alias("flag_id"),
        F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "none"))), (k % 4 + 1).cast("int")).alias("risk"),
        F.when(k % 7 < 5, "open").otherwise("resolved").alias("status"),
        F.timestamp_seconds(k % 50 * 86400).alias("created_at"),
        F.when(k % 11 == 0, F.timestamp_seconds(F.lit(0))).alias("hidden_at"),
        F.when(k % 13 == 0, F.timestamp_seconds(F.lit(0))).alias("purged_at"),
    )


_FLAGS_SQL = """
flags AS (
  SELECT source AS tenant, doc_id AS flag_id, ['high', 'medium', 'low', 'none'][doc_id % 4 + 1] AS risk,
         CASE WHEN doc_id % 7 < 5 THEN 'open' ELSE 'resolved' END AS status, doc_id % 50 AS day, doc_id % 11 = 0 OR doc_id % 13 = 0 AS hidden,
         CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS risk_key
  FROM documents)"""

_MINIMAL = r"""
regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(nfc_normalize(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    replace(replace(replace(replace(replace(replace(replace({0}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '),
    '<(?:br|BR|Br)/?>|<(?:br|BR) />', chr(10), 'g'),
    '</(?:p|div|li|tr|h[1-4]|blockquote|pre|section|article)>', chr(10), 'g'),
    '<[^>]*(?:>|\z)', '', 'g'),
    '[\x00-\x08\x0B-\x1F\x7F-\x{{9F}}]', '', 'g'),
    '(?:https?://|www\.)[^\s\p{{Z}}\x{{85}}]*', '<url>', 'g')),
  '[ \t]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '[\s\p{{Z}}]+$', '')), lambda x: x <> ''), chr(10)), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"""


@query(f"SELECT page_id, {_MINIMAL.format('html')} AS body FROM pages")
def minimize_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.minimize(F.col("html")).alias("body"))


@query("SELECT doc_id, ((length(text) + 3) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("""
SELECT doc_id, source AS tenant, 'flag' AS decision, 'low' AS risk, 'hate' AS category, 0.75 AS confidence,
       'hateful_or_dehumanizing_content' AS reason_code, left(text, 8) AS evidence
FROM documents WHERE ('0x' || left(sha256('0:' || text), 2))::INT % 2 = 1 AND strlen(text) >= 8""")
def stub_scan_flags(spark, folder):
    rows = content_items(spark, folder).select("doc_id", "tenant", F.col("body").alias("text")).withColumn("item_index", F.lit(0))
    found = scan.stub_results(rows, ["hate", "negativity"]).where("decision = 'flag'")
    return found.select("doc_id", "tenant", "decision", "risk", "category", "confidence", "reason_code", "evidence")


@query(f"""WITH {_FLAGS_SQL}
SELECT tenant, count(*) AS n_all, count(*) FILTER (risk = 'high') AS n_high, count(*) FILTER (risk = 'medium') AS n_medium,
       count(*) FILTER (risk = 'low') AS n_low FROM flags WHERE NOT hidden AND status = 'open' GROUP BY tenant""")
def flag_counts_by_risk(spark, folder):
    return review.risk_counts(flags_of(spark, folder), ["tenant"])


@query(f"""WITH {_FLAGS_SQL}
SELECT tenant, count(*) AS flagged_count, CASE min(doc_key) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS level
FROM (SELECT *, list_position(['high', 'medium', 'low', 'none'], risk) - 1 AS doc_key FROM flags) WHERE NOT hidden AND status = 'open' GROUP BY tenant""")
def top_risk_per_tenant(spark, folder):
    return review.highest_open_risk(flags_of(spark, folder), ["tenant"])


@query(f"""WITH {_FLAGS_SQL}
SELECT tenant, flag_id, risk, place::INT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY risk_key, day DESC, flag_id) AS place FROM flags WHERE NOT hidden AND status = 'open' AND flag_id > 20)
WHERE place <= 51""")
def review_page(spark, folder):
    page = review.review_list(flags_of(spark, folder), ["tenant"], status="open", cursor=F.lit(20))
    return page.select("tenant", "flag_id", "risk", "place")


@query(f"""WITH {_FLAGS_SQL},
head AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY risk_key, day DESC, flag_id) AS place FROM flags WHERE NOT hidden AND status = 'open'),
level AS (SELECT tenant, count(*) AS n, min(list_position(['high', 'medium', 'low', 'none'], risk)) AS k FROM head GROUP BY tenant),
preview AS (SELECT tenant, string_agg(flag_id::VARCHAR, ',' ORDER BY place) AS p FROM head WHERE place <= 3 GROUP BY tenant)
SELECT t.tenant, coalesce(n, 0)::BIGINT AS flagged_count, ['high', 'medium', 'low', 'none'][coalesce(k, 4)] AS level,
       [320, 245, 180, 0][coalesce(k, 4)]::INT AS gauge, coalesce(p, '') AS preview
FROM (SELECT DISTINCT source AS tenant FROM documents) t LEFT JOIN level ON level.tenant = t.tenant LEFT JOIN preview ON preview.tenant = t.tenant""")
def dashboard_summary(spark, folder):
    scans = table(spark, folder, "documents").select(F.col("source").alias("tenant"))
    out = review.dashboard(scans, flags_of(spark, folder), ["tenant"])
    return out.withColumn("preview", F.array_join(F.col("preview").cast("array<string>"), ","))


def imports_of(spark: SparkSession, folder: str) -> DataFrame:
    """documents as archive imports: the text is the archive, the source the tenant."""
    k = F.col("doc_id")
    return table(spark, folder, "documents").select(
        F.col("source").alias("tenant_id"),
        F.when(k % 3 == 0, "x").otherwise("reddit").alias("platform"),
        k.alias("id"),
        hashing.sha256_hex(F.col("text")).alias("fingerprint"),
        F.timestamp_seconds(k % 50 * 86400).alias("claimed_at"),
        F.when(k % 9 == 0, "failed").when(k % 4 == 0, "ready").otherwise("running").alias("status"),
    )


@query("""
WITH i AS (SELECT source, doc_id % 3 = 0 AS x, doc_id, sha256(text) AS f, doc_id % 50 AS day, CASE WHEN doc_id % 4 = 0 THEN 'ready' ELSE 'running' END AS status FROM documents WHERE doc_id % 9 > 0)
SELECT source AS tenant, doc_id, CASE WHEN row_number() OVER w = 1 THEN 'claimed' WHEN first_value(status) OVER w = 'ready' THEN 'duplicate' ELSE 'busy' END AS outcome
FROM i WINDOW w AS (PARTITION BY source, x, f ORDER BY day, doc_id)""")
def import_dedupe(spark, folder):
    return store.fingerprint_claims(imports_of(spark, folder)).select(F.col("tenant_id").alias("tenant"), F.col("id").alias("doc_id"), "outcome")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS body FROM conversations GROUP BY conv_id")
def latest_revision(spark, folder):
    rows = table(spark, folder, "conversations")
    return store.latest(rows, ["conv_id"], F.col("turn").desc()).select("conv_id", "turn", "role", F.col("text").alias("body"))


@query("""
WITH r AS (SELECT conv_id, role, turn, turn % 3 = 2 AS deleted, min(CASE WHEN turn % 3 = 2 THEN turn END) OVER (PARTITION BY conv_id, role) AS first_deleted FROM conversations)
SELECT conv_id, role, CASE WHEN max(first_deleted) IS NOT NULL THEN 'deleted' ELSE 'active' END AS state,
       count(*) FILTER (NOT deleted AND (first_deleted IS NULL OR turn < first_deleted)) > 1 AS conflict FROM r GROUP BY conv_id, role""")
def revision_conflicts(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "role", F.col("turn").alias("ordinal"), F.when(F.col("turn") % 3 == 2, "deleted").otherwise("active").alias("state"))
    return store.duplicate_revisions(rows, ["conv_id", "role"])


_SCANS = """(SELECT o_orderkey AS scan_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'running' ELSE 'queued' END AS status,
 o_orderdate AS created_at, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS finished_at FROM orders)"""


def scans_of(spark: SparkSession, folder: str) -> DataFrame:
    """orders as scans of customers."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("scan_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "running").otherwise("queued").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("finished_at"),
    )


@query(f"""SELECT user_id, scan_id, status FROM {_SCANS} QUALIFY row_number() OVER (
  PARTITION BY user_id ORDER BY CASE WHEN status IN ('queued', 'running') THEN 0 ELSE 1 END, created_at DESC, scan_id DESC) = 1""")
def current_scan(spark, folder):
    active = F.when(F.col("status").isin("queued", "running"), 0).otherwise(1)
    return store.latest(scans_of(spark, folder), ["user_id"], active, F.col("created_at").desc(), F.col("scan_id").desc()).select("user_id", "scan_id", "status")


@query(f"""SELECT user_id, scan_id FROM {_SCANS} WHERE status = 'succeeded' QUALIFY row_number() OVER (
  PARTITION BY user_id ORDER BY finished_at DESC NULLS LAST, created_at DESC, scan_id DESC) = 1""")
def latest_succeeded_scan(spark, folder):
    rows = scans_of(spark, folder).where("status = 'succeeded'")
    return store.latest(rows, ["user_id"], F.col("finished_at").desc_nulls_last(), F.col("created_at").desc(), F.col("scan_id").desc()).select("user_id", "scan_id")


@query("SELECT c_custkey AS user_id, 'free_beta' AS product FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus <> 'F')")
def grant_backfill_anti(spark, folder):
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    live = table(spark, folder, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("user_id"))
    return store.backfill(users, live, "free_beta")


@query("""
SELECT c_custkey AS user_id, coalesce(n, 0)::BIGINT AS used, CASE WHEN c_custkey % 10 > 0 THEN greatest(12 - coalesce(n, 0), 0)::BIGINT END AS remaining
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def usage_remaining(spark, folder):
    grants = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 10 > 0, F.lit(12)).cast("long").alias("quota"))
    usages = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"))
    return review.remaining(grants, usages, "user_id", "quota").select("user_id", "used", "remaining")


@query("""
SELECT source AS tenant, lang, count(DISTINCT doc_id % 2) AS platforms, count(DISTINCT doc_id % 2) <= 1 AS within FROM documents GROUP BY ALL""")
def platform_limit_check(spark, folder):
    rows = content_items(spark, folder).join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    return review.platform_limit(rows, ["tenant", "lang"], 1)


_CONCERNS_SQL = "[" + ", ".join(f"'{c}'" for c in (*catalog.CONCERNS, "unknown")) + "]"


def concerns_of(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's orders as a list of concerns in order of the orders, with repeats and unknown ones."""
    names = F.array(*map(F.lit, (*catalog.CONCERNS, "unknown")))
    each = F.struct("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 11 + 1).cast("int")).alias("c"))
    rows = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.array_sort(F.collect_list(each)).alias("x"))
    return rows.select("user_id", F.transform("x", lambda e: e["c"]).alias("concerns"))


@query(f"""
SELECT user_id, array_to_string(list_filter({_CONCERNS_SQL}[1:10], lambda x: list_contains(v, x)), ',') AS concerns
FROM (SELECT o_custkey AS user_id, list({_CONCERNS_SQL}[o_orderkey % 11 + 1]) AS v FROM orders GROUP BY o_custkey)""")
def policy_canonical_order(spark, folder):
    return concerns_of(spark, folder).select("user_id", F.array_join(scalars.in_order(F.col("concerns"), catalog.CONCERNS), ",").alias("concerns"))


_STEP_SQL = ", ".join(f"'{c}'" for c in catalog.STEP_CONCERNS)


@query(f"""
WITH e AS (SELECT o_custkey AS user_id, o_orderkey * 10 AS k, {_CONCERNS_SQL}[o_orderkey % 11 + 1] AS c FROM orders),
x AS (SELECT user_id, k, c FROM e WHERE c <> 'drinking_drugs' UNION ALL SELECT user_id, k + 1, 'underage_drinking' FROM e WHERE c = 'drinking_drugs'
      UNION ALL SELECT user_id, k + 2, 'drug_use' FROM e WHERE c = 'drinking_drugs'),
d AS (SELECT user_id, c, min(k) AS k FROM x WHERE c IN ({_STEP_SQL}) GROUP BY user_id, c)
SELECT u.user_id, coalesce(string_agg(d.c, ',' ORDER BY d.k), '') AS concerns FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN d USING (user_id) GROUP BY u.user_id""")
def concern_expansion(spark, folder):
    return concerns_of(spark, folder).select("user_id", F.array_join(scalars.migrated_concerns(F.col("concerns")), ",").alias("concerns"))


@query("""
WITH RECURSIVE i AS (
  SELECT source AS tenant, doc_id, (length(text) + 3) // 4 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
p AS (
  SELECT tenant, doc_id, r, 0 AS b, 0 AS k, 2500 + tokens + 24 AS total FROM i WHERE r = 1
  UNION ALL
  SELECT i.tenant, i.doc_id, i.r, CASE WHEN p.k + 1 >= 16 OR total + tokens + 24 > 12000 THEN b + 1 ELSE b END,
         CASE WHEN p.k + 1 >= 16 OR total + tokens + 24 > 12000 THEN 0 ELSE p.k + 1 END,
         CASE WHEN p.k + 1 >= 16 OR total + tokens + 24 > 12000 THEN 2500 ELSE total END + tokens + 24
  FROM p JOIN i ON i.tenant IS NOT DISTINCT FROM p.tenant AND i.r = p.r + 1)
SELECT doc_id, tenant, b::INT AS batch_ordinal, k::INT AS item_index FROM p""")
def pack_batches(spark, folder):
    rows = content_items(spark, folder).select("doc_id", "tenant", text.estimate_tokens(F.col("body")).alias("tokens"))
    return scan.pack(rows, "tenant", ["doc_id"]).select("doc_id", "tenant", "batch_ordinal", "item_index")


@query()
def scan_documents(spark, folder):
    """The whole flow with segments; its parts are held against SQL one by one."""
    rows = content_items(spark, folder).select("tenant", "doc_id", "body")
    return scan.scan_stub(rows, "tenant", ["doc_id"], ["hate", "negativity"]).select("tenant", "doc_id", "risk", "category", "confidence")


_RANKED = "CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'low' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'medium' ELSE 'none' END END"


@query(f"""
WITH s AS (SELECT l_orderkey AS id, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS o, {_RANKED} AS risk, l_discount AS confidence, l_linestatus AS category, 'c' || l_suppkey % 3 AS code FROM lineitem),
k AS (SELECT *, CASE risk WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END AS rank FROM s),
w AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank DESC, confidence DESC, o) = 1),
r AS (SELECT w.id, k.code, min(k.o) AS o FROM w JOIN k ON k.id = w.id AND k.category = w.category GROUP BY w.id, k.code),
t AS (SELECT id, string_agg(code, ',' ORDER BY o, code) AS reasons FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, code) <= 3) GROUP BY id)
SELECT w.id, risk <> 'none' AS flagged, risk, CASE WHEN risk <> 'none' THEN category END AS category, confidence, CASE WHEN risk <> 'none' THEN reasons ELSE '' END AS reasons FROM w JOIN t ON t.id = w.id""")
def rollup_segments(spark, folder):
    line = table(spark, folder, "lineitem")
    none = F.array().cast("array<struct<text:string,supports:string>>")
    rows = line.select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("segment_ordinal"),
        F.lit("flag").alias("decision"),
        F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "low").when(F.col("l_linenumber") % 2 == 0, "medium").otherwise("none").alias("risk"),
        F.col("l_linestatus").alias("category"),
        F.col("l_discount").alias("confidence"),
        F.array(F.struct(F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")).alias("code"), F.lit("").alias("summary"))).alias("reasons"),
        none.alias("evidence"),
    )
    out = scan.roll_up(rows, ["id"])
    codes = F.array_join(F.coalesce(F.transform("reasons", lambda r: r["code"]), F.array().cast("array<string>")), ",")
    return out.select("id", "flagged", "risk", "category", "confidence", codes.alias("reasons"))


@query("""
SELECT doc_id, CASE WHEN text = '' AND doc_id % 12 IN (9, 10, 11) THEN 'SCAN_OUTPUT_TEXT_LIMIT' ELSE CASE doc_id % 12
  WHEN 1 THEN 'SCAN_DECISION_FIELDS' WHEN 2 THEN 'SCAN_DECISION_FIELDS' WHEN 3 THEN 'SCAN_CATEGORY_NOT_SELECTED' WHEN 4 THEN 'SCAN_CATEGORY_NOT_SELECTED'
  WHEN 5 THEN 'SCAN_DECISION_FIELDS' WHEN 6 THEN 'SCAN_REASON_CATEGORY' WHEN 7 THEN 'SCAN_OUTPUT_TEXT_LIMIT' WHEN 8 THEN 'SCAN_EVIDENCE_NOT_SUBSTRING'
  WHEN 9 THEN CASE WHEN doc_id % 5 = 0 THEN 'SCAN_AMPLIFIED_ATTRIBUTION' END WHEN 10 THEN 'SCAN_OUTPUT_SCHEMA' END END AS error
FROM documents""")
def validate_output_codes(spark, folder):
    """Answers that break one rule each, by number of the document."""
    rows = content_items(spark, folder).withColumnRenamed("body", "text")
    k = F.col("doc_id") % 12
    reason = F.struct(
        F.when(k == 6, "sustained_hostility").otherwise("targeted_harassment").alias("code"),
        F.when(k == 7, F.repeat(F.lit("x"), 241)).when(k == 9, "What You WROTE here").otherwise("Targets someone.").alias("summary"),
    )
    proof = F.struct(F.when(k == 8, F.concat(F.left("text", F.lit(4)), F.lit("☃nowhere"))).otherwise(F.left("text", F.lit(4))).alias("text"), F.lit("targeted_harassment").alias("supports"))
    no_reason, no_proof = F.array().cast("array<struct<code:string,summary:string>>"), F.array().cast("array<struct<text:string,supports:string>>")
    rows = (
        rows.withColumn("decision", F.when(k.isin(0, 1), "no_flag").otherwise("flag"))
        .withColumn("risk", F.when(k == 0, "none").when(k.isin(1, 11), "low").when(k == 2, "none").otherwise("high"))
        .withColumn("category", F.when(k.isin(0, 1), None).when(k == 3, "other").when(k == 4, "drug_use").otherwise("hate"))
        .withColumn("confidence", F.when(k == 10, F.lit(float("nan"))).otherwise(0.5))
        .withColumn("reasons", F.when(k.isin(0, 1, 5), no_reason).otherwise(F.array(reason)))
        .withColumn("evidence", F.when(k.isin(0, 1), no_proof).otherwise(F.array(proof)))
    )
    return rows.select("doc_id", scan.result_error(["hate", "negativity", "other"]).alias("error"))


def cases_of(spark: SparkSession, folder: str) -> DataFrame:
    """labels as cases: toxic is what is expected, the stub's flag what was said, quality the slice."""
    said = stub_scan_flags(spark, folder).select("doc_id", F.lit(True).alias("said"))
    rows = table(spark, folder, "labels").where("toxic IS NOT NULL AND quality IS NOT NULL").join(said, "doc_id", "left")
    return rows.select(
        "doc_id",
        F.when(F.col("quality") == 1, "core").otherwise("edge").alias("slice"),
        (F.col("toxic") == 1).alias("expected"),
        F.coalesce("said", F.lit(False)).alias("predicted"),
    )


_CASES_SQL = """
said AS (SELECT doc_id FROM documents WHERE ('0x' || left(sha256('0:' || text), 2))::INT % 2 = 1 AND strlen(text) >= 8),
c AS (SELECT quality = 1 AS core, toxic = 1 AS e, doc_id IN (SELECT doc_id FROM said WHERE doc_id IS NOT NULL) AS p FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL),
m AS (SELECT count(*) FILTER (core AND e AND p) AS core_tp, count(*) FILTER (core AND e AND NOT p) AS core_fn, count(*) FILTER (core AND NOT e AND p) AS core_fp,
             count(*) FILTER (core AND NOT e AND NOT p) AS core_tn, count(*) FILTER (NOT core AND e AND p) AS edge_tp, count(*) FILTER (NOT core AND e AND NOT p) AS edge_fn FROM c)"""


@query(f"WITH {_CASES_SQL} SELECT * FROM m")
def confusion_matrix(spark, folder):
    return evaluate.confusion(cases_of(spark, folder))


@query(f"""WITH {_CASES_SQL},
r AS (SELECT core_tp / nullif(core_tp + core_fn, 0) AS core_recall, core_tp / nullif(core_tp + core_fp, 0) AS core_precision, edge_tp / nullif(edge_tp + edge_fn, 0) AS edge_recall FROM m)
SELECT *, array_to_string(list_filter([CASE WHEN coalesce(core_recall, 0) < 0.92 THEN 'core_recall' END, CASE WHEN coalesce(core_precision, 0) < 0.88 THEN 'core_precision' END,
  CASE WHEN coalesce(edge_recall, 0) < 0.85 THEN 'edge_recall' END], lambda x: x IS NOT NULL), ',') AS failures FROM r""")
def eval_gates(spark, folder):
    out = evaluate.gates(evaluate.ratios(evaluate.confusion(cases_of(spark, folder))))
    return out.select("core_recall", "core_precision", "edge_recall", F.array_join("failures", ",").alias("failures"))


@query("""
SELECT count(a.h) AS baseline, count(b.h) AS candidate, count(*) FILTER (a.h IS DISTINCT FROM b.h) AS different, count(*) FILTER (a.h IS DISTINCT FROM b.h) = 0 AS equal
FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 > 0) a
FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 13 > 0) b USING (doc_id)""")
def compare_reports(spark, folder):
    docs = table(spark, folder, "documents")
    one = docs.where("doc_id % 10 > 0").select(F.col("doc_id").alias("case_id"), hashing.sha256_hex(F.col("text")).alias("hash"))
    body = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    two = docs.where("doc_id % 13 > 0").select(F.col("doc_id").alias("case_id"), hashing.sha256_hex(body).alias("hash"))
    return evaluate.compare(one, two)


def work_items(spark: SparkSession, folder: str) -> DataFrame:
    """events as work items: type is the kind, user the tenant."""
    k = F.col("event_id")
    return table(spark, folder, "events").select(
        k.alias("id"),
        F.col("event_type").alias("kind"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("run_after"),
        F.col("user_id").alias("tenant_id"),
        F.get_json_object("props", "$.k").cast("int").alias("priority"),
        F.when(k % 3 == 0, "running").otherwise("pending").alias("status"),
        (k % 4).cast("int").alias("attempt_count"),
        F.lit(3).alias("max_attempts"),
        F.when(k % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("lease_expires_at"),
        F.when(k % 5 == 0, F.col("ts")).alias("cancel_requested_at"),
    )


@query("""
SELECT event_type AS kind, event_id AS id, (props->>'$.k')::INT AS priority FROM events WHERE event_id % 3 > 0 AND event_id % 4 < 3 AND event_id % 5 > 0
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (props->>'$.k')::INT DESC NULLS LAST, ts, event_id) = 1""")
def queue_claim_order(spark, folder):
    now = F.to_timestamp(F.lit("2100-01-01 00:00:00"))
    return store.claim_order(work_items(spark, folder), now, ["kind"]).select("kind", "id", "priority")


@query("""
SELECT event_id AS id, CASE WHEN event_id % 3 > 0 AND event_id % 4 >= 3 THEN 'failed'
  WHEN event_id % 3 > 0 THEN 'pending' WHEN event_id % 15 = 0 THEN 'cancelled' WHEN event_id % 4 >= 3 THEN 'failed' ELSE 'pending' END AS new_status FROM events""")
def queue_sweep(spark, folder):
    return store.sweep(work_items(spark, folder), F.to_timestamp(F.lit("2100-01-01 00:00:00"))).select("id", "new_status")


@query("""
SELECT event_type AS kind, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY event_type""")
def retention_sweep(spark, folder):
    rows = table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("created_at"))
    now = rows.agg(F.max("created_at")).first()[0]
    content = spark.createDataFrame([], "body string, title string, deletion_pending_at timestamp, purged_at timestamp")
    left, _ = store.retention(rows, content, F.lit(now))
    return left.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("kept"))


@query("""
SELECT o_orderkey AS content_id, CASE WHEN NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-12-31' AND o_orderkey % 4 > 0) THEN o_orderpriority END AS body,
       CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-12-31' THEN TIMESTAMP '1996-01-01' END AS purged_at FROM orders""")
def scrubbed_content(spark, folder):
    """orders as content: filled ones are pending deletion since their date, one in four was purged before."""
    content = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("content_id"), F.col("o_orderpriority").alias("body"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deletion_pending_at"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("purged_at"),
    )
    keys = spark.createDataFrame([], "created_at timestamp")
    _, out = store.retention(keys, content, F.to_timestamp(F.lit("1996-01-01 00:00:00")))
    return out.select("content_id", "body", "purged_at")


@query("""
WITH RECURSIVE s AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey = 3), c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3),
o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM c)),
l AS (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT k FROM o) OR l_suppkey IN (SELECT k FROM s))
SELECT 'nation' AS name, (SELECT count(*) FROM nation) - 1 AS rows, 0 AS left_over UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier) - (SELECT count(*) FROM s), 0
UNION ALL SELECT 'customer', (SELECT count(*) FROM customer) - (SELECT count(*) FROM c), 0 UNION ALL SELECT 'orders', (SELECT count(*) FROM orders) - (SELECT count(*) FROM o), 0
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem) - (SELECT n FROM l), 0""")
def cascaded_deletions(spark, folder):
    """A nation goes, and with it suppliers, customers, their orders, and the lines of either."""
    keys = {"nation": ["n_nationkey"], "supplier": ["s_suppkey"], "customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_suppkey"]}
    foreign = [
        ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]), ("customer", ["c_nationkey"], "nation", ["n_nationkey"]), ("orders", ["o_custkey"], "customer", ["c_custkey"]),
        ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]), ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]),
    ]
    tables = {name: (table(spark, folder, name), key) for name, key in keys.items()}
    out, left = store.cascade(tables, foreign, {"nation": tables["nation"][0].where("n_nationkey = 3").select("n_nationkey")})
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(left).alias("left_over")) for name, rows in out.items()]
    return reduce(DataFrame.unionByName, counts)


@query("""
WITH e AS (SELECT event_type AS kind, isodow(ts) <= 5 AND hour(ts) IN (1, 2, 3, 6, 7, 8, 9) AS peak, 1000 + event_id % 500 AS tokens, event_id % 2000 AS hits, event_id % 97 AS output FROM events)
SELECT kind, peak, count(*) AS calls, round(sum(CASE WHEN peak THEN 1.0 ELSE 0.5 END * ((tokens - least(hits, tokens)) * 0.30 + least(hits, tokens) * 0.006 + output * 1.20) / 1000000), 6)::DOUBLE AS cost
FROM e GROUP BY kind, peak""")
def cost_by_peak(spark, folder):
    k = F.col("event_id")
    cost = scalars.cost(1000 + k % 500, k % 2000, k % 97, F.col("ts"))
    rows = table(spark, folder, "events").groupBy(F.col("event_type").alias("kind"), scalars.is_peak(F.col("ts")).alias("peak"))
    return rows.agg(F.count("*").alias("calls"), F.round(F.sum(cost), 6).alias("cost"))


@query(f"""
WITH s AS (SELECT user_id, status FROM {_SCANS} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, scan_id DESC) = 1)
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 17 = 0 THEN 'welcome' WHEN c_custkey % 5 = 0 THEN 'onboarding'
  WHEN c_custkey % 3 = 0 OR status IS NULL THEN 'awaiting_import' WHEN status <> 'succeeded' THEN 'scanning'
  WHEN c_acctbal > 0 THEN 'app' ELSE 'awaiting_import' END AS gate
FROM customer LEFT JOIN s ON s.user_id = c_custkey""")
def lifecycle_gate(spark, folder):
    last = store.latest(scans_of(spark, folder), ["user_id"], F.col("created_at").desc(), F.col("scan_id").desc()).select("user_id", "status")
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal").join(last, "user_id", "left")
    k = F.col("user_id")
    ready = F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("reddit")))
    wanted = F.array(F.lit("reddit"), F.lit("x"), F.lit("tiktok"))
    gate = scalars.lifecycle_gate(k % 17 != 0, F.when(k % 5 != 0, "completed").otherwise("in_progress"), wanted, ready, F.col("status"), F.col("c_acctbal") > 0)
    return users.select("user_id", gate.alias("gate"))


@query(r"""
SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(coalesce(text, ''), '|'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '')[1:3],
  lambda x: left(x, 40)), ';') AS tags FROM documents""")
def evidence_tags(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", F.array_join(text.tags(F.col("text")), ";").alias("tags"))


@query("""
SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' WHEN 1 THEN '+1415' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0') END AS contact FROM customer""")
def contact_normalize(spark, folder):
    k = F.col("c_custkey")
    digits = F.lpad((k % 10_000_000).cast("string"), 7, "0")
    mail = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.com "))
    phone = F.concat(F.lit("(415) "), F.left(digits, F.lit(3)), F.lit("-"), F.right(digits, F.lit(4)))
    raw = F.when(k % 3 == 0, mail).when(k % 3 == 1, phone).otherwise("not a contact")
    return table(spark, folder, "customer").select(k.alias("user_id"), text.contact(raw)["value"].alias("contact"))


@query("SELECT c_custkey AS user_id, left(sha256('salt:user::' || c_name), 12) AS token FROM customer")
def pseudonymize(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), hashing.pseudonym("salt:", "user", F.col("c_name")).alias("token"))


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in KEY.ljust(64, b"\0")).hex()


@query(f"""
SELECT doc_id, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(text)))) AS hmac FROM documents""")
def batch_hmac(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", F.lower(F.hex(hashing.hmac_sha256(KEY, F.col("text")))).alias("hmac"))


@query("""
SELECT o_custkey AS user_id, o_orderkey AS grant_id FROM orders WHERE o_orderstatus <> 'P' AND (o_orderkey % 4 = 0 OR o_orderdate > TIMESTAMP '1996-01-01')
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def active_grant(spark, folder):
    """orders as grants: pending ones are revoked, one in four has no end."""
    grants = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("grant_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate")).alias("valid_until"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("revoked_at"),
    )
    return store.active_grants(grants, ["user_id"], F.to_timestamp(F.lit("1996-01-01 00:00:00"))).select("user_id", "grant_id")


def links_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(content, links, imports): parts are content, order lines link it to orders, which are imports of no tenant but one."""
    tenant = F.lit(1).alias("tenant_id")
    platform = F.when(F.col("p_partkey") % 3 == 0, "x").when(F.col("p_partkey") % 3 == 1, "reddit").otherwise("tiktok").alias("platform")
    content = table(spark, folder, "part").select(tenant, F.col("p_partkey").alias("content_id"), platform)
    links = table(spark, folder, "lineitem").select(tenant, F.col("l_orderkey").alias("import_id"), F.col("l_partkey").alias("content_id"))
    status = F.when(F.col("o_orderkey") % 10 == 1, "ready").otherwise("failed").alias("status")
    imports = table(spark, folder, "orders").select(tenant, F.col("o_orderkey").alias("import_id"), status)
    return content, links, imports


@query("""
SELECT p_partkey AS content_id, CASE p_partkey % 3 WHEN 0 THEN 'x' ELSE 'reddit' END AS platform FROM part
WHERE p_partkey % 3 < 2 AND p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 10 = 1)""")
def selected_content(spark, folder):
    return store.selected_content(*links_of(spark, folder)).select("content_id", "platform")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS i, l_partkey AS c FROM lineitem),
a AS (SELECT i, c FROM l UNION SELECT o_orderkey, c FROM orders JOIN l ON i = o_orderkey - 2 WHERE o_orderkey % 7 = 0)
SELECT o_orderkey AS import_id, coalesce(n, 0)::BIGINT AS record_count, CASE WHEN o_orderkey % 7 = 0 AND h THEN (o_orderkey - 2) % 2 ELSE o_orderkey % 2 END::BIGINT AS format,
       CASE WHEN o_orderkey % 7 = 0 AND h OR o_orderkey % 10 = 1 THEN 'ready' ELSE 'failed' END AS status, NOT (o_orderkey % 7 = 0 AND h) AS held
FROM (SELECT *, o_orderkey - 2 IN (SELECT o_orderkey FROM orders) AS h FROM orders) LEFT JOIN (SELECT i, count(*) AS n FROM a GROUP BY i) ON i = o_orderkey""")
def finish_duplicates(spark, folder):
    """One order in seven is a duplicate import of the order two before it."""
    key = F.col("import_id")
    _, links, imports = links_of(spark, folder)
    imports = imports.withColumn("holder_id", F.when(key % 7 == 0, key - 2)).withColumn("format", key % 2).withColumn("record_count", F.lit(0).cast("long"))
    imports = imports.withColumn("fingerprint", F.lit("f")).withColumn("finished_at", F.lit(None).cast("timestamp"))
    out, _, _ = store.finish_duplicates(imports, links, F.to_timestamp(F.lit("2020-01-01 00:00:00")))
    return out.select("import_id", "record_count", "format", "status", F.col("fingerprint").isNotNull().alias("held"))


@query("""
SELECT o_orderkey AS import_id, o_orderdate AS purge_after FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND o_orderkey % 3 > 0 ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def due_purges(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("import_id"), F.col("o_orderdate").alias("purge_after"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("raw_purged_at")
    )
    return store.due_purges(rows, F.to_timestamp(F.lit("1996-01-01 00:00:00"))).select("import_id", "purge_after")


@query("""
SELECT o_custkey AS user_id, o_orderkey AS import_id, place::INT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderkey > 100) WHERE place <= 6""")
def import_page(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("import_id"), F.col("o_orderdate").alias("created_at"))
    return review.import_list(rows, ["user_id"], cursor=F.lit(100), limit=5).select("user_id", "import_id", "place")


@query("""
WITH RECURSIVE r AS (
  SELECT user_id AS u, event_type AS t, event_id AS id, ts, (props->>'$.k')::INT % 2 AS h, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS done,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT u, t, id, n, h, done, ts + INTERVAL 2 HOUR AS until, 'fresh' AS outcome FROM r WHERE n = 1
  UNION ALL
  SELECT q.u, q.t, q.id, q.n, CASE WHEN q.o = 'fresh' THEN q.nh ELSE q.h END, CASE WHEN q.o = 'fresh' THEN q.nd ELSE q.done END, CASE WHEN q.o = 'fresh' THEN q.ts + INTERVAL 2 HOUR ELSE q.until END, q.o
  FROM (SELECT r.u, r.t, r.id, r.n, r.ts, r.h AS nh, r.done AS nd, s.h, s.done, s.until,
          CASE WHEN s.h <> r.h THEN 'conflict' WHEN s.done <= r.ts THEN 'replay' WHEN s.until > r.ts THEN 'in_progress' ELSE 'fresh' END AS o
        FROM s JOIN r ON r.u = s.u AND r.t = s.t AND r.n = s.n + 1) q)
SELECT id AS request_id, outcome FROM s""")
def idempotency_claims(spark, folder):
    """events as requests of a user by type; one in three is answered after an hour, the lock holds for two."""
    requests = table(spark, folder, "events").select(
        "user_id",
        "event_type",
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("at"),
        (F.get_json_object("props", "$.k").cast("int") % 2).cast("string").alias("hash"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("done_at"),
    )
    return store.idempotency(requests, ["user_id", "event_type"], 7200).select("request_id", "outcome")


@query("""
WITH RECURSIVE i AS (
  SELECT source AS tenant, doc_id, (length(text) + 3) // 4 + 4 AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
p AS (
  SELECT tenant, doc_id, r, 0 AS b, 0 AS k, c AS state, c + 3000 AS request FROM i WHERE r = 1
  UNION ALL
  SELECT tenant, doc_id, r, CASE WHEN full_ THEN b + 1 ELSE b END, CASE WHEN full_ THEN 0 ELSE k + 1 END,
         CASE WHEN full_ THEN c ELSE state + c END, CASE WHEN full_ THEN c + 3000 ELSE request + c + 3000 END
  FROM (SELECT i.tenant, i.doc_id, i.r, b, k, state, request, c, p.k + 1 >= 8 OR state + c > 20000 OR request + c + 3000 > 48000 AS full_
        FROM p JOIN i ON i.tenant IS NOT DISTINCT FROM p.tenant AND i.r = p.r + 1))
SELECT doc_id, tenant, b::INT AS batch_ordinal, k::INT AS item_index FROM p""")
def pack_screen_batches(spark, folder):
    rows = content_items(spark, folder).select("doc_id", "tenant", F.col("body").alias("text"))
    return scan.screen_batches(rows, "tenant", ["doc_id"], question_tokens=3000).select("doc_id", "tenant", "batch_ordinal", "item_index")


def screened(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, hits, confirmed): documents as posts of two concerns; what is answered follows from the number."""
    k = F.col("post_id")
    posts = table(spark, folder, "documents").select(F.col("doc_id").alias("post_id"), "text")
    plan = scan.screen_plan(posts.withColumnRenamed("post_id", "id"), ["hate", "drug_use"], "id")
    answers = plan.select("post_id", "concern", F.when(k % 7 > 0, (k % 20) / 100.0 + F.when(F.col("concern") == "hate", 0.05).otherwise(0.0)).alias("score"))
    hits = scan.screen_hits(plan, answers)
    told = hits.select("post_id", "concern", F.when(k % 11 > 0, (k % 9) / 10.0 + F.when(F.col("concern") == "hate", 0.05).otherwise(0.1)).alias("score"))
    return posts, hits, scan.confirmations(hits, told)


@query(r"""
WITH p AS (SELECT doc_id AS id, c AS concern, CASE c WHEN 'hate' THEN 0 ELSE 1 END AS place FROM documents, (VALUES ('hate'), ('drug_use')) v(c) WHERE regexp_replace(text, '[\s\p{Z}]', '', 'g') <> ''),
h AS (SELECT *, CASE WHEN id % 7 > 0 THEN (id % 20) / 100.0::DOUBLE + CASE concern WHEN 'hate' THEN 0.05 ELSE 0.0 END ELSE 1.0 END AS s FROM p),
c AS (SELECT id, concern, place, CASE WHEN id % 11 > 0 THEN (id % 9) / 10.0::DOUBLE + CASE concern WHEN 'hate' THEN 0.05 ELSE 0.1 END END AS t FROM h WHERE s >= 0.15),
e AS (SELECT id, bool_or(t IS NULL) AS failed, max(t) AS best FROM c GROUP BY id),
f AS (SELECT id, arg_min(concern, place) AS concern, arg_min(t, place) AS t FROM c JOIN e USING (id) WHERE NOT failed AND t >= 0.3 AND t >= best - 0.1 - 1e-12 GROUP BY id),
m AS (SELECT id, max(s) AS top FROM h GROUP BY id)
SELECT doc_id AS post_id, CASE WHEN NOT coalesce(failed, false) THEN CASE WHEN f.concern IS NOT NULL THEN 'flag' ELSE 'no_flag' END END AS decision, f.concern AS category,
       round(coalesce(f.t, 1.0 - coalesce(top, 0.0)), 9)::DOUBLE AS confidence, CASE f.concern WHEN 'drug_use' THEN 'risky_drug_use' END AS reason_code,
       CASE WHEN failed THEN 'SCAN_CONFIRM_MISSING' END AS error
FROM documents LEFT JOIN e ON e.id = doc_id LEFT JOIN f ON f.id = doc_id LEFT JOIN m ON m.id = doc_id""")
def screen_documents(spark, folder):
    """Screening in two stages, over all documents, with one result for each."""
    posts, hits, confirmed = screened(spark, folder)
    out = scan.screen_results(posts, hits, scan.primary_concern(confirmed), confirmed)
    return out.withColumn("confidence", F.round("confidence", 9))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'SCAN_OUTPUT_JSON' WHEN 2 THEN 'SCAN_OUTPUT_JSON' WHEN 3 THEN 'SCAN_OUTPUT_SCHEMA' WHEN 4 THEN 'SCAN_OUTPUT_SCHEMA' END AS error,
       CASE WHEN doc_id % 6 IN (0, 5) THEN left(text, 30) END AS quote FROM documents""")
def parsed_answers(spark, folder):
    """Recorded answers about documents, most with a fault: trailing text, a code fence, a key too many, a key missing."""
    k = F.col("doc_id") % 6
    result = F.struct(
        F.lit(0).alias("itemIndex"), F.lit("flag").alias("decision"), F.lit("low").alias("risk"), F.lit("hate").alias("category"), F.lit(0.5).alias("confidence"),
        F.array(F.struct(F.lit("c").alias("code"), F.lit("s").alias("summary"))).alias("reasons"),
        F.array(F.struct(F.left("text", F.lit(30)).alias("text"), F.lit("c").alias("supportsReasonCode"))).alias("evidence"),
    )
    good = F.to_json(F.struct(F.lit("1").alias("schemaVersion"), F.array(result).alias("results")))
    raw = (
        F.when(k == 1, F.concat(good, F.lit(" and more")))
        .when(k == 2, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(k == 3, F.regexp_replace(good, "^[{]", '{"note":1,'))
        .when(k == 4, F.regexp_replace(good, '"risk":"low",', ""))
        .when(k == 5, F.concat(F.lit(" \n"), good, F.lit("\n")))
        .otherwise(good)
    )
    out = scan.parse_answers(table(spark, folder, "documents").select("doc_id", raw.alias("raw")))
    return out.select("doc_id", "error", F.col("answer.results")[0]["evidence"][0]["text"].alias("quote"))


@query("""
WITH r AS (SELECT l_orderkey AS b, l_linenumber - CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 2 THEN 2 ELSE 1 END AS i FROM lineitem WHERE NOT (l_orderkey % 3 = 0)),
f AS (SELECT b, count(*) AS n, count(DISTINCT i) AS d, min(i) AS lo, max(i) AS hi FROM r GROUP BY b),
s AS (SELECT l_orderkey AS b, count(*) AS size FROM lineitem GROUP BY l_orderkey)
SELECT s.b AS batch, coalesce(n = size AND d = size AND lo = 0 AND hi = size - 1, false) AS ok FROM s LEFT JOIN f ON f.b = s.b""")
def batch_completeness(spark, folder):
    """Order lines as results of orders: some have an index twice, some orders have none at all."""
    line, key = table(spark, folder, "lineitem"), F.col("l_orderkey")
    sizes = line.groupBy(key.alias("batch")).agg(F.count("*").alias("batch_items"))
    shift = F.when((key % 5 == 0) & (F.col("l_linenumber") == 2), 2).otherwise(1)
    results = line.where(key % 3 != 0).select(key.alias("batch"), (F.col("l_linenumber") - shift).alias("item_index"))
    return scan.index_errors(sizes, results, ["batch"])


@query("""
SELECT doc_id AS flag_id, CASE WHEN doc_id % 2 = 0 THEN 'Reddit' ELSE 'X' END AS platform_label, strftime(TIMESTAMP '1970-01-01' + to_days((doc_id % 50)::INT), '%b %-d, %Y') AS date,
       CASE WHEN doc_id % 3 = 0 THEN 'drug_use' ELSE 'other' END AS category, CASE WHEN doc_id % 3 = 0 THEN 'Matches your drug-use review concern.' ELSE 'Matches your other review concern.' END AS why_flagged,
       CASE WHEN doc_id % 7 < 5 THEN 'open' ELSE 'resolved' END AS status FROM documents""")
def flag_detail(spark, folder):
    k = F.col("doc_id")
    flags = content_items(spark, folder).select(
        k.alias("flag_id"), "platform", "body", F.timestamp_seconds(k % 50 * 86400).alias("created_at"), F.when(k % 3 == 0, "drug_use").alias("category"),
        F.lit("a|b").alias("evidence"), F.lit(None).cast("string").alias("reason_summary"), F.when(k % 7 < 5, "open").otherwise("closed").alias("status"),
    )
    return review.flag_cards(flags).select("flag_id", "platform_label", "date", "category", "why_flagged", "status")


@query("""
WITH a AS (SELECT l_partkey AS f, arg_min(CASE WHEN l_returnflag = 'R' THEN 'resolved' ELSE 'closed' END, l_orderkey * 10 + l_linenumber) AS s FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS flag_id, CASE WHEN p_partkey % 4 = 0 THEN 'snoozed' ELSE coalesce(s, 'open') END AS status FROM part LEFT JOIN a ON f = p_partkey""")
def reviewed_flags(spark, folder):
    """parts as flags, order lines as actions on them: the first action counts, on open flags only. Lines of one part, order
    and number are told apart by their place in the table, so that of equal ones the first counts, as in SQL.
    """
    flags = table(spark, folder, "part").select(F.col("p_partkey").alias("flag_id"), F.when(F.col("p_partkey") % 4 == 0, "snoozed").otherwise("open").alias("status"))
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    actions = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("flag_id"), F.lit("review").alias("action"), F.when(F.col("l_returnflag") == "R", "resolved").otherwise("closed").alias("new_status"),
        order.alias("created_at"), F.struct("_metadata.file_path", "_metadata.row_index").alias("action_id"),
    )
    return store.first_reviews(flags, actions).select("flag_id", "status")


@query("""
SELECT o_orderkey AS flag_id, o_orderkey % 6 = 0 OR o_custkey % 5 = 0 AS hidden FROM orders""")
def hidden_flags(spark, folder):
    """customers as content, one in five deleted; orders as their flags, one in six hidden before."""
    content = table(spark, folder, "customer").select(F.col("c_custkey").alias("content_id"), F.lit(None).cast("timestamp").alias("purged_at"))
    then, now = (F.to_timestamp(F.lit(x)) for x in ("1995-01-01 00:00:00", "1996-01-01 00:00:00"))
    flags = table(spark, folder, "orders").select(F.col("o_orderkey").alias("flag_id"), F.col("o_custkey").alias("content_id"), F.when(F.col("o_orderkey") % 6 == 0, then).alias("hidden_at"))
    _, out = store.hide_content(content, flags, content.where("content_id % 5 = 0"), now)
    return out.select("flag_id", F.col("hidden_at").isNotNull().alias("hidden"))


@query("""
SELECT 'orders' AS kind, count(*) AS rows FROM orders WHERE o_custkey % 10 > 0 OR o_custkey % 20 = 0
UNION ALL SELECT 'customers', count(*) FROM customer WHERE c_custkey % 10 > 0 OR c_custkey % 20 = 0""")
def deletions_replayed(spark, folder):
    """One customer in ten is deleted, half of them before the restore point."""
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("tenant_id"))
    at = F.when(F.col("tenant_id") % 20 == 0, "1995-01-01 00:00:00").otherwise("1997-01-01 00:00:00")
    markers = users.where("tenant_id % 10 = 0").withColumn("deleted_at", F.to_timestamp(at))
    tables = {"orders": table(spark, folder, "orders").select(F.col("o_custkey").alias("tenant_id")), "customers": users}
    left = store.replay_deletions(markers, F.to_timestamp(F.lit("1996-01-01 00:00:00")), tables)
    one, two = (t.agg(F.lit(name).alias("kind"), F.count("*").alias("rows")) for name, t in left.items())
    return one.unionByName(two)


@query("""
SELECT source AS tenant, sum(n)::BIGINT AS calls, max(n) AS most_calls, sum(i)::BIGINT AS input_tokens, sum(c)::BIGINT AS cached_tokens, sum(o)::BIGINT AS output_tokens
FROM (SELECT source, n_chars % 7 AS batch, count(*) AS n, sum((length(text) + 3) // 4) AS i, sum(doc_id % 31) AS c, sum(doc_id % 17) AS o FROM documents GROUP BY ALL) GROUP BY source""")
def usage_by_tenant(spark, folder):
    k = F.col("doc_id")
    calls = table(spark, folder, "documents").select(
        F.col("source").alias("tenant"), (F.col("n_chars") % 7).alias("batch"), text.estimate_tokens(F.col("text")).alias("input_tokens"), (k % 31).alias("cached_tokens"), (k % 17).alias("output_tokens")
    )
    return evaluate.usage(calls, ["tenant"], ["batch"])


@query("""
SELECT count(*) FILTER (doc_id % 5 = 0 AND doc_id % 3 > 0) / nullif(count(*) FILTER (doc_id % 5 = 0), 0) AS amplified_accuracy, count(*) FILTER (doc_id % 50 = 1) / nullif(count(*), 0) AS failure_rate FROM documents""")
def evaluation_rates(spark, folder):
    k = F.col("doc_id")
    return evaluate.rates(table(spark, folder, "documents").select((k % 5 == 0).alias("amplified"), (k % 3 > 0).alias("wording_ok"), (k % 50 == 1).alias("failed")))


@query("""
SELECT source AS tenant, count(*) FILTER (contains(text, 'the')) AS findings FROM documents GROUP BY source""")
def privacy_findings(spark, folder):
    rows = table(spark, folder, "documents").select(F.col("source").alias("tenant"), F.col("text").alias("payload"), F.lit("the").alias("source_id"))
    return evaluate.privacy_findings(rows, ["tenant"])


@query("""
SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_partkey <= l_suppkey THEN 'a' ELSE 'b' END
  WHEN l_linenumber % 2 <> l_suppkey % 2 THEN CASE WHEN l_linenumber % 2 > l_suppkey % 2 THEN 'a' ELSE 'b' END
  WHEN l_discount <> l_tax THEN CASE WHEN l_discount < l_tax THEN 'a' ELSE 'b' END
  WHEN l_partkey <= l_suppkey THEN 'a' ELSE 'b' END AS winner FROM lineitem""")
def report_winner(spark, folder):
    """Order lines as pairs of reports."""
    a = F.struct((F.col("l_linenumber") % 2).alias("recall"), F.col("l_discount").alias("cost"), F.col("l_partkey").alias("hash"), F.col("l_partkey").alias("prompt_hash"))
    b = F.struct((F.col("l_suppkey") % 2).alias("recall"), F.col("l_tax").alias("cost"), F.col("l_suppkey").alias("hash"), F.col("l_suppkey").alias("prompt_hash"))
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), a.alias("a"), b.alias("b"))
    return rows.select("id", "line", evaluate.winner(rows, F.col("id") % 3 == 0).alias("winner"))


@query("""
SELECT c_custkey AS user_id, CASE c_custkey % 12 WHEN 0 THEN 'ONBOARDING_INVALID_ENUM' WHEN 1 THEN 'ONBOARDING_DUPLICATE_ENUM' WHEN 2 THEN 'ONBOARDING_PLATFORM_DISABLED'
  WHEN 3 THEN 'ONBOARDING_STEP' WHEN 4 THEN 'ONBOARDING_STATUS' WHEN 5 THEN 'ONBOARDING_INCOMPLETE' WHEN 6 THEN 'ONBOARDING_STATUS' WHEN 9 THEN 'ONBOARDING_INCOMPLETE' END AS error FROM customer""")
def onboarding_errors(spark, folder):
    """Questionnaires of customers that break one rule each, by number."""
    k = F.col("c_custkey") % 12

    def listed(*values: str) -> F.Column:
        return F.array(*map(F.lit, values)).cast("array<string>")

    coming = F.when(k == 0, listed("rush", "party", "rush")).when(k == 7, listed()).otherwise(listed("rush", "internships"))
    concerns = F.when(k == 1, listed("hate", "hate", "none")).when(k == 7, listed()).otherwise(listed("hate"))
    platforms = F.when(k == 2, listed("x", "tiktok", "x")).when(k == 7, listed()).otherwise(listed("x", "reddit"))
    step = F.when(k == 3, 4).when(k.isin(4, 7), 1).when(k == 5, 2).otherwise(3)
    status = F.when(k.isin(4, 7), "not_started").when(k == 6, "done").when(k == 8, "in_progress").otherwise("completed")
    error = scalars.onboarding_error(coming, concerns, platforms, step, status, ~k.isin(7), F.when(k == 9, "2020-01-01").otherwise(catalog.DISCLOSURE))
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), error.alias("error"))


@query("""
SELECT event_id AS id, concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'status' END, CASE WHEN event_id % 4 = 3 THEN 'attempt_count' END, CASE WHEN event_id % 5 = 0 THEN 'max_attempts' END) AS broken FROM events""")
def constraint_violations(spark, folder):
    k = F.col("id")
    items = work_items(spark, folder).withColumn("status", F.when(k % 7 == 0, "waiting").otherwise(F.col("status")))
    items = items.withColumn("attempt_count", F.when(k % 4 == 3, -1).otherwise(F.col("attempt_count"))).withColumn("max_attempts", F.when(k % 5 == 0, 0).when(k % 5 > 1, 3))
    return store.broken_checks(items, store.work_item_checks()).select("id", F.array_join("broken", ",").alias("broken"))


@query("""
SELECT doc_id, sha256('{"action":"review","expectedStatus":' || coalesce('"' || lang || '"', 'null') || ',"flagId":"' || doc_id || '"}') AS hash FROM documents""")
def request_hashes(spark, folder):
    """documents as requests to review them."""
    parts = {"expectedStatus": hashing.json_text(F.col("lang")), "flagId": hashing.json_text(F.col("doc_id").cast("string")), "action": hashing.json_text(F.lit("review"))}
    return table(spark, folder, "documents").select("doc_id", hashing.request_hash(**parts).alias("hash"))


@query("""
SELECT doc_id, sha256('[{"category":null,"confidence":' || (doc_id % 100 / 128.0::DOUBLE)::VARCHAR || ',"decision":"no_flag","evidence":[],"itemIndex":0,"reasons":[],"risk":"none"},'
  || '{"category":"hate","confidence":0.5,"decision":"flag","evidence":[{"supportsReasonCode":"c","text":' || coalesce(to_json(text)::VARCHAR, 'null')
  || '}],"itemIndex":1,"reasons":[{"code":"c","summary":"s"}],"risk":"low"}]') AS hash FROM documents""")
def result_hashes(spark, folder):
    """Two results for each document, given in the wrong order."""
    flag = "struct<category:string,confidence:double,decision:string,evidence:array<struct<supports_reason_code:string,text:string>>,item_index:bigint,reasons:array<struct<code:string,summary:string>>,risk:string>"
    proof = F.array(F.struct(F.lit("c").alias("supports_reason_code"), F.col("text").alias("text")))
    second = F.struct(F.lit("hate"), F.lit(0.5), F.lit("flag"), proof, F.lit(1), F.array(F.struct(F.lit("c"), F.lit("s"))), F.lit("low")).cast(flag)
    first = F.struct(F.lit(None), F.col("doc_id") % 100 / 128.0, F.lit("no_flag"), F.array(), F.lit(0), F.array(), F.lit("none")).cast(flag)
    return table(spark, folder, "documents").select("doc_id", F.sha2(hashing.canonical_results(F.array(second, first)).cast("binary"), 256).alias("hash"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'risky_drug_use' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'targeted_harassment' END END AS reason,
       CASE doc_id % 4 WHEN 0 THEN 'only' WHEN 1 THEN 'b' WHEN 2 THEN NULL ELSE 'whole' END AS evidence FROM documents""")
def screening_choices(spark, folder):
    """Reasons and evidence that are chosen for documents, by number."""
    k = F.col("doc_id")
    concern = F.when(k % 3 == 0, "drug_use").when(k % 3 == 1, "hate").otherwise("unknown")
    reason = scan.chosen_reason(concern, F.when(k % 2 == 0, "targeted_harassment").otherwise("targeted_insult"))
    two = F.array(F.lit("a"), F.lit("b"))
    passages = F.when(k % 4 == 0, F.array(F.lit("only"))).when(k % 4 == 3, F.array().cast("array<string>")).otherwise(two)
    evidence = scan.chosen_evidence(passages, F.lit("whole"), F.when(k % 4 == 1, "s1").otherwise("s2"))
    return table(spark, folder, "documents").select("doc_id", reason.alias("reason"), evidence.alias("evidence"))


@query("""
SELECT doc_id, CASE WHEN f THEN 'flag' ELSE 'no_flag' END AS decision, CASE WHEN f THEN CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END ELSE 'none' END AS risk,
  CASE WHEN f THEN c END AS category, CASE WHEN f THEN CASE c WHEN 'hate' THEN 'hateful_or_dehumanizing_content' ELSE 'risky_drug_use' END END AS reason_code,
  CASE WHEN f THEN CASE WHEN doc_id % 5 = 0 THEN 'you shared content matching ' ELSE 'text matches ' END || c END AS summary,
  CASE WHEN f THEN coalesce(nullif(left(text, 40), ''), 'x') END AS evidence
FROM (SELECT *, doc_id % 2 = 0 AS f, CASE WHEN doc_id % 4 = 0 THEN 'drug_use' ELSE 'hate' END AS c FROM documents)""")
def expected_results(spark, folder):
    k = F.col("doc_id")
    items = content_items(spark, folder).withColumnRenamed("body", "text").withColumn("expected_decision", F.when(k % 2 == 0, "flag"))
    items = items.withColumn("expected_category", F.when(k % 4 == 0, "drug_use")).withColumn("expected_risk", F.when(k % 3 == 0, "high"))
    return scan.expected_results(items, ["other", "hate"]).select("doc_id", "decision", "risk", "category", "reason_code", "summary", "evidence")


@query("""
WITH c AS (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS meant, o_orderkey % 7 = 0 AS gone, o_orderkey % 2 = 0 AS bad, o_orderkey % 5 > 0 AS good FROM orders)
SELECT id, CASE WHEN meant THEN gone OR bad ELSE NOT gone AND NOT bad AND good END AS passed_expect, NOT gone AND meant <> bad AS invariant_failed,
       CASE WHEN meant THEN NOT gone AND NOT bad ELSE gone OR bad END AS terminal_failure,
       CASE WHEN gone THEN 'PROVIDER' WHEN bad THEN 'SCAN_OUTPUT_JSON' WHEN meant THEN 'EXPECTED_INVARIANT_MISS' END AS error_code,
       CASE WHEN NOT meant AND NOT gone AND NOT bad THEN 'h' END AS result_sha256 FROM c""")
def case_records(spark, folder):
    """orders as cases of a replayed suite."""
    k = F.col("id")
    cases = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id")).withColumn("expect_failure", k % 3 == 0).withColumn("provider_failed", k % 7 == 0)
    cases = cases.withColumn("error", F.when(k % 2 == 0, "SCAN_OUTPUT_JSON")).withColumn("passed", k % 5 > 0).withColumn("result_sha256", F.lit("h"))
    return evaluate.case_records(cases, True).select("id", "passed_expect", "invariant_failed", "terminal_failure", "error_code", "result_sha256")


@query("""
WITH i AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ready' ELSE 'running' END AS s, CASE doc_id % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'failed' END AS e FROM documents)
SELECT doc_id, CASE WHEN s = 'running' AND e IS NOT NULL THEN e ELSE s END AS status, CASE WHEN s = 'running' AND e IS NOT NULL THEN 'code' END AS error_code,
       NOT (s = 'running' AND e IS NOT NULL) AS held FROM i""")
def ended_imports(spark, folder):
    """Two imports in three come to an end; those that are ready stay as they are."""
    k = F.col("doc_id")
    imports = table(spark, folder, "documents").select(
        F.lit(1).alias("tenant_id"), k.alias("import_id"), F.when(k % 4 == 0, "ready").otherwise("running").alias("status"), F.lit(None).cast("string").alias("error_code"),
        F.lit("f").alias("fingerprint"), F.lit(None).cast("timestamp").alias("finished_at"),
    )
    ended = imports.where(F.col("import_id") % 3 < 2).select("tenant_id", "import_id", F.when(F.col("import_id") % 3 == 0, "rejected").otherwise("failed").alias("status"), F.lit("code").alias("error_code"))
    out, _ = store.end_imports(imports, imports.select("tenant_id", "import_id"), ended, F.to_timestamp(F.lit("2020-01-01 00:00:00")))
    return out.select(F.col("import_id").alias("doc_id"), "status", "error_code", F.col("fingerprint").isNotNull().alias("held"))


@query("""
SELECT event_id AS id, coalesce(greatest(least(CASE WHEN event_id % 3 = 0 THEN event_id % 10000 END, d * 2), CASE WHEN event_id % 3 = 0 THEN 1 END), d)::BIGINT + event_id % 250 AS delay
FROM (SELECT *, CASE WHEN event_id % 5 <= 1 THEN 1000 WHEN event_id % 5 = 2 THEN 2000 ELSE 4000 END AS d FROM events)""")
def transport_delays(spark, folder):
    k = F.col("event_id")
    delay = scalars.transport_delay(k % 5, F.when(k % 3 == 0, k % 10_000), k)
    return table(spark, folder, "events").select(k.alias("id"), delay.cast("long").alias("delay"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey % 10 AS c, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'h' || o_orderkey END AS h FROM orders),
l AS (SELECT o_custkey, c, arg_max(h, o_orderkey) AS h FROM r WHERE h IS NOT NULL GROUP BY ALL)
SELECT o_custkey, coalesce(string_agg(c || ':' || l.h, ',' ORDER BY c), '') AS hashes FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN l USING (o_custkey) GROUP BY o_custkey""")
def case_hashes(spark, folder):
    """customers as reports, their orders as records of cases."""
    k = F.col("o_orderkey")
    records = table(spark, folder, "orders").select("o_custkey", k, (k % 10).alias("case_id"), F.when(k % 3 > 0, F.concat(F.lit("h"), k)).alias("result_sha256"))
    entries = F.transform(F.map_entries("case_hashes"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return evaluate.case_hashes(records, ["o_custkey"], k).select("o_custkey", F.array_join(entries, ",").alias("hashes"))


@query("""
WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no, o_orderkey % 4 = 0 AS answered,
                  o_orderkey % 16 > 0 AS bad, o_orderkey % 9 > 0 AS again FROM orders),
t AS (
  SELECT o_custkey, no, answered::INT AS answers, (NOT answered)::INT AS failures, FALSE AS repair, CASE WHEN answered THEN NOT bad ELSE NOT again END AS done, answered, bad FROM r WHERE no = 1
  UNION ALL
  SELECT r.o_custkey, r.no, t.answers + r.answered::INT, t.failures + (NOT r.answered)::INT, t.answers > 0,
         r.no = 5 OR CASE WHEN r.answered THEN NOT r.bad OR t.answers = 1 ELSE NOT r.again END, r.answered, r.bad
  FROM t JOIN r ON r.o_custkey = t.o_custkey AND r.no = t.no + 1 WHERE NOT t.done)
SELECT o_custkey, count(*) AS calls, bool_or(done) AS done, max(CASE WHEN done AND (NOT answered OR bad) THEN CASE WHEN answered THEN 'output' ELSE 'transport' END END) AS error_code,
       count(*) FILTER (repair) AS repairs, max(failures)::BIGINT AS failures FROM t GROUP BY o_custkey""")
def retry_budget(spark, folder):
    """customers as batches, their orders as what calls would answer."""
    k = F.col("o_orderkey")
    error = F.when(k % 4 > 0, "transport").when(k % 16 > 0, "output")
    calls = table(spark, folder, "orders").select("o_custkey", k, (k % 4 == 0).alias("answered"), error.alias("error"), (k % 9 > 0).alias("retryable"))
    tried = evaluate.attempts(calls, ["o_custkey"], ["o_orderkey"])
    sums = tried.groupBy("o_custkey").agg(F.count_if("repair").alias("repairs"), F.max("failures").alias("failures"))
    return evaluate.outcomes(tried, ["o_custkey"]).join(sums, "o_custkey")


@query("""
WITH p AS (SELECT s_suppkey AS place, CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 10 = 7 THEN 'common' ELSE s_name END AS text, count(*) OVER () AS size FROM supplier),
w AS (SELECT c_custkey, text, CASE WHEN c_custkey % 2 = 0 THEN 'common' ELSE '-' END AS own,
             (place - (('0x' || left(sha256('case-' || c_custkey), 16))::UBIGINT % size)::BIGINT + size) % size AS step FROM customer, p)
SELECT c_custkey, coalesce(array_to_string((list(text ORDER BY step) FILTER (text <> '' AND text <> own))[1:5], '|'), '') AS neighbours FROM w GROUP BY c_custkey""")
def case_neighbours(spark, folder):
    """customers as cases, suppliers as the pool of texts."""
    k = F.col("s_suppkey")
    pool = table(spark, folder, "supplier").select(k.alias("place"), F.when(k % 4 == 0, "").when(k % 10 == 7, "common").otherwise(F.col("s_name")).alias("text"))
    own = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("common")))
    cases = table(spark, folder, "customer").select(F.concat(F.lit("case-"), "c_custkey").alias("case_id"), own.alias("own"))
    number = F.substring_index("case_id", "-", -1).cast("long")
    return evaluate.neighbours(cases, pool, 5).select(number.alias("c_custkey"), F.array_join("neighbours", "|").alias("neighbours"))


@query(f"""WITH said AS (SELECT doc_id FROM documents WHERE ('0x' || left(sha256('0:' || text), 2))::INT % 2 = 1 AND strlen(text) >= 8),
c AS (SELECT source, lang, quality = 1 AS core, toxic = 1 AS e, d.doc_id IN (SELECT doc_id FROM said) AS p, doc_id % 5 = 0 AS amp, NOT contains(text, 'you') AS ok, n_chars > 60000 AS inv, text = '' AS failed,
      1 + n_chars % 6 AS calls, contains(text, '@') AS finding FROM documents d JOIN labels USING (doc_id)),
m AS (SELECT source, lang, count(*) FILTER (core AND e AND p) AS tp, count(*) FILTER (core AND e AND NOT p) AS fn, count(*) FILTER (core AND NOT e AND p) AS fp, count(*) FILTER (NOT core AND e AND p) AS etp,
      count(*) FILTER (NOT core AND e AND NOT p) AS efn, count(*) FILTER (amp AND ok) / nullif(count(*) FILTER (amp), 0) AS acc, count(*) FILTER (failed) / count(*) AS rate,
      count(*) FILTER (inv) AS inv, max(calls) AS calls, count(*) FILTER (finding) AS findings FROM c GROUP BY source, lang)
SELECT source AS suite_of, lang, array_to_string(list_filter([CASE WHEN coalesce(tp / nullif(tp + fn, 0), 0) < 0.92 THEN 'core_recall' END, CASE WHEN coalesce(tp / nullif(tp + fp, 0), 0) < 0.88 THEN 'core_precision' END,
  CASE WHEN lang = 'en' AND coalesce(etp / nullif(etp + efn, 0), 0) < 0.85 OR etp / nullif(etp + efn, 0) < 0.85 THEN 'edge_recall' END, CASE WHEN inv > 0 THEN 'invariant_failures' END, CASE WHEN rate > 0 THEN 'failure_rate' END,
  CASE WHEN acc < 0.95 THEN 'amplified_accuracy' END, CASE WHEN calls > 5 THEN 'most_calls' END, CASE WHEN findings > 0 THEN 'findings' END], lambda x: x IS NOT NULL), ',') AS failures FROM m""")
def suite_gates(spark, folder):
    """labelled documents as cases of suites by source and language; only the English ones are whole suites."""
    said = stub_scan_flags(spark, folder).select("doc_id", F.lit(True).alias("said"))
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").join(said, "doc_id", "left")
    cases = rows.select(
        F.col("source").alias("suite_of"), "lang", F.when(F.col("quality") == 1, "core").otherwise("edge").alias("slice"), (F.col("toxic") == 1).alias("expected"), F.coalesce("said", F.lit(False)).alias("predicted"),
        (F.col("doc_id") % 5 == 0).alias("amplified"), (~F.contains("text", F.lit("you"))).alias("wording_ok"), (F.col("n_chars") > 60_000).alias("invariant_failed"), (F.col("text") == "").alias("failed"),
        (1 + F.col("n_chars") % 6).alias("calls"), F.contains("text", F.lit("@")).alias("finding"),
    )
    report = evaluate.suite_report(cases, ["suite_of", "lang"]).withColumn("suite", F.when(F.col("lang") == "en", "all").otherwise("core"))
    return evaluate.gates(report).select("suite_of", "lang", F.array_join("failures", ",").alias("failures"))


@query(f"""
SELECT doc_id, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(source || '{{"body":' || to_json(text)::VARCHAR || ',"id":' || doc_id || ',"lang":' || to_json(lang)::VARCHAR || '}}')))) AS identity FROM documents""")
def content_identities(spark, folder):
    """documents as records, written with their members in another order than the canonical one."""
    record = F.to_json(F.struct(F.col("lang"), F.col("text").alias("body"), F.col("doc_id").alias("id")), {"pretty": "true"})
    return table(spark, folder, "documents").select("doc_id", hashing.content_identity(KEY, F.col("source"), record).alias("identity"))


_SALT = "salt::"
_X_ID = "('0x' || left(sha256('salt::x_id::' || {0}), 15))::UBIGINT::VARCHAR"


@query(f"""
SELECT doc_id, {_X_ID.format("doc_id")} AS id_str, {_X_ID.format("(doc_id // 2)")} AS reply_to, 'user_' || left(sha256('salt::handle::' || source), 8) AS mention,
       'https://example.invalid/' || left(sha256('salt::url::https://t.example/' || doc_id), 12) AS url,
       CASE WHEN starts_with(text, '@') THEN '@user_' || left(sha256('salt::handle::reply'), 8) || ' synthetic reply ' || doc_id
            WHEN starts_with(text, 'RT @') THEN 'RT @user_' || left(sha256('salt::handle::rt'), 8) || ': synthetic retweet ' || doc_id ELSE 'Synthetic tweet body ' || doc_id END AS body, lang
FROM documents""")
def redacted_tweets(spark, folder):
    """documents as tweets, each with a mention of its source and an address."""
    k = F.col("doc_id").cast("string")
    mention, address = F.struct(F.col("source").alias("screen_name")), F.struct(F.concat(F.lit("https://t.example/"), k).alias("expanded_url"))
    tweet = F.struct(
        k.alias("id_str"), F.col("text").alias("full_text"), F.floor(F.col("doc_id") / 2).cast("string").alias("in_reply_to_status_id_str"), F.col("lang").alias("lang"),
        F.struct(F.array(mention).alias("user_mentions"), F.array(address).alias("urls")).alias("entities"),
    )
    rows = table(spark, folder, "documents").select("doc_id", F.to_json(F.struct(tweet.alias("tweet"))).alias("record"))
    out = redact.records(rows, _SALT, place_col="doc_id")

    def member(path: str) -> F.Column:
        return F.get_json_object("record", f"$.tweet.{path}")

    return out.select(
        "doc_id", member("id_str").alias("id_str"), member("in_reply_to_status_id_str").alias("reply_to"), member("entities.user_mentions[0].screen_name").alias("mention"),
        member("entities.urls[0].expanded_url").alias("url"), member("full_text").alias("body"), member("lang").alias("lang"),
    )


@query("""
SELECT page_id, left(sha256('salt::reddit_id::' || page_id), 7) AS id, CASE WHEN url = '' THEN url ELSE 'https://example.invalid/' || left(sha256('salt::url::' || url), 12) END AS permalink,
       'r_' || left(sha256('salt::subreddit::' || (page_id % 7)), 8) AS subreddit, CASE WHEN page_id % 3 = 0 THEN '' ELSE left(sha256('salt::reddit_id::' || (page_id // 3)), 7) END AS parent,
       CASE WHEN page_id % 5 = 0 THEN '[removed]' ELSE 'Synthetic comment body ' || page_id || '.' END AS body FROM pages""")
def redacted_comments(spark, folder):
    """pages as comments."""
    k = F.col("page_id")
    rows = table(spark, folder, "pages").select(
        "page_id", k.cast("string").alias("id"), F.col("url").alias("permalink"), (k % 7).cast("string").alias("subreddit"), F.lit(None).cast("string").alias("link"),
        F.when(k % 3 == 0, "").otherwise(F.floor(k / 3).cast("string")).alias("parent"), F.when(k % 5 == 0, "[removed]").otherwise(F.col("html")).alias("body"),
    )
    return redact.comments(rows, _SALT, k).drop("link")


@query("""
WITH q AS (SELECT c_custkey AS request_id, c_custkey // 2 AS user_id FROM customer),
own AS (SELECT o_custkey // 2 AS user_id, o_orderkey AS import_id, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'reddit' END AS platform, o_orderstatus <> 'P' AS ready FROM orders WHERE o_orderkey % 4 = 0),
w AS (SELECT request_id, user_id, import_id FROM q JOIN own USING (user_id) UNION ALL SELECT request_id, user_id, -1 FROM q WHERE request_id % 13 = 0),
a AS (SELECT request_id, count(*) AS n, count(DISTINCT import_id) AS ids FROM (FROM w UNION ALL SELECT request_id, user_id, import_id FROM w WHERE request_id % 11 = 0) GROUP BY request_id),
f AS (SELECT request_id, count(*) AS found, bool_and(ready) AS ready, count(DISTINCT platform) AS platforms FROM w JOIN own USING (user_id, import_id) GROUP BY request_id),
c AS (SELECT request_id, user_id, CASE WHEN n IS NULL OR n <> ids THEN 'INVALID_ARCHIVE_IMPORT_IDS' WHEN user_id % 10 = 0 OR user_id % 9 = 0 THEN 'ENTITLEMENT_REQUIRED' WHEN coalesce(found, 0) <> n THEN 'RESOURCE_NOT_FOUND'
  WHEN NOT ready THEN 'IMPORTS_NOT_READY' WHEN platforms > 1 + user_id % 2 THEN 'PLATFORM_LIMIT_EXCEEDED'
  WHEN EXISTS (FROM supplier WHERE s_suppkey = user_id AND s_suppkey % 3 > 0) THEN 'SCAN_ALREADY_RUNNING' END AS code FROM q LEFT JOIN a USING (request_id) LEFT JOIN f USING (request_id))
SELECT request_id, CASE WHEN code IS NULL AND row_number() OVER (PARTITION BY user_id, code IS NULL ORDER BY request_id) > 1 THEN 'SCAN_ALREADY_RUNNING' ELSE code END AS error_code FROM c""")
def scan_admissions(spark, folder):
    """customers as requests, two a user, for all of the user's orders of one in four as imports; some name ids that no one has, or
    all twice. Suppliers are their scans.
    """
    k, user, tenant = F.col("request_id"), F.col("user_id"), F.lit("t").alias("tenant_id")
    requests = table(spark, folder, "customer").select(F.col("c_custkey").alias("request_id"), F.floor(F.col("c_custkey") / 2).alias("user_id"))
    imports = table(spark, folder, "orders").where("o_orderkey % 4 = 0").select(
        tenant, F.floor(F.col("o_custkey") / 2).alias("user_id"), F.col("o_orderkey").alias("import_id"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("reddit").alias("platform"),
        F.when(F.col("o_orderstatus") == "P", "parsing").otherwise("ready").alias("status"),
    )
    ids = imports.groupBy("user_id").agg(F.collect_list("import_id").alias("own"))
    asked = F.concat(F.coalesce("own", F.array().cast("array<long>")), F.when(k % 13 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")))
    asked = F.when(k % 11 == 0, F.concat(asked, asked)).otherwise(asked)
    requests = requests.join(ids, "user_id", "left").select("request_id", tenant, "user_id", k.alias("created_at"), asked.alias("import_ids"))
    rights = requests.select(tenant, "user_id").distinct().where("user_id % 10 > 0").select(
        tenant, "user_id", (1 + user % 2).alias("platform_limit"), F.when(user % 9 == 0, 0).when(user % 2 == 0, 5).alias("rescans_remaining")
    )
    scans = table(spark, folder, "supplier").select(
        tenant, F.col("s_suppkey").alias("user_id"), F.element_at(F.array(*map(F.lit, ("failed", "queued", "running"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("status")
    )
    return review.admissions(requests, imports, rights, scans)


@query("""
SELECT event_id AS id, s_suppkey AS import_id, s_name FROM events JOIN supplier ON s_suppkey = (props->>'$.k')::BIGINT WHERE event_id % 3 = 0 AND user_id % 2 = 1""")
def owned_imports(spark, folder):
    """events as work items whose payload names a supplier; users are the workers."""
    items = work_items(spark, folder).join(table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("props").alias("payload")), "id")
    owned = items.withColumn("lease_owner", F.when(F.col("tenant_id") % 2 == 1, "a").otherwise("b"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("import_id"), "s_name")
    return store.owned_imports(owned, suppliers, F.lit("a"), "$.k")


@query("""
SELECT conv_id, coalesce(bool_or(contains(text, '?')), FALSE) AS any_flag FROM conversations GROUP BY conv_id""")
def cases_expecting_flags(spark, folder):
    """conversations as cases: a turn with a question is to be flagged."""
    expected = table(spark, folder, "conversations").select("conv_id", F.when(F.contains("text", F.lit("?")), "flag").otherwise("no_flag").alias("decision"))
    return evaluate.expects_any_flag(expected, ["conv_id"])


_NOW = "1997-01-01 00:00:00"
_LEASED = """
SELECT o_orderkey AS k, ['{0}', '{1}', '{2}', 'succeeded'][o_orderkey % 4 + 1] AS status, CASE WHEN o_custkey % 2 = 0 THEN o_orderdate END AS asked,
       CASE WHEN o_custkey % 3 > 0 THEN o_orderdate + INTERVAL 1 HOUR END AS lease, CASE WHEN o_custkey % 5 = 0 THEN o_orderdate END AS ended, TIMESTAMP '1997-01-01' AS now FROM orders"""


def leased(spark: SparkSession, folder: str, *statuses: str) -> DataFrame:
    """orders as rows that workers hold: by key in one of the statuses, some cancelled, leased for an hour from their date."""
    key, by, date = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("timestamp")
    return table(spark, folder, "orders").select(
        key.alias("id"), F.element_at(F.array(*map(F.lit, (*statuses, "succeeded"))), (key % 4 + 1).cast("int")).alias("status"),
        F.when(by % 2 == 0, date).alias("cancel_requested_at"), F.when(by % 3 > 0, date + F.expr("INTERVAL 1 HOUR")).alias("lease_expires_at"),
        F.when(by % 5 == 0, date).alias("finished_at"),
    )


@query(f"""
WITH r AS ({_LEASED.format("queued", "running", "failed")}),
s AS (SELECT *, CASE WHEN asked IS NOT NULL AND (status = 'queued' OR (status = 'running' AND lease < now)) THEN 'cancelled'
                     WHEN asked IS NULL AND status = 'running' AND lease < now THEN 'queued' ELSE status END AS new FROM r)
SELECT k AS id, new AS status, CASE WHEN new = status THEN lease END AS lease_expires_at, CASE WHEN new = 'cancelled' THEN coalesce(ended, now) ELSE ended END AS finished_at FROM s""")
def recovered_scans(spark, folder):
    out = store.recover_scans(leased(spark, folder, "queued", "running", "failed"), F.to_timestamp(F.lit(_NOW)))
    return out.select("id", "status", "lease_expires_at", "finished_at")


@query(f"""
WITH r AS ({_LEASED.format("queued", "parsing", "normalizing")}),
s AS (SELECT *, CASE WHEN asked IS NOT NULL AND status <> 'succeeded' AND (lease IS NULL OR lease < now) THEN 'cancelled'
                     WHEN asked IS NULL AND status IN ('parsing', 'normalizing') AND lease < now THEN 'queued' ELSE status END AS new FROM r)
SELECT k AS id, new AS status, CASE WHEN new = status THEN lease END AS lease_expires_at, CASE WHEN new = 'cancelled' THEN coalesce(ended, now) ELSE ended END AS finished_at FROM s""")
def recovered_imports(spark, folder):
    out = store.recover_imports(leased(spark, folder, "queued", "parsing", "normalizing"), F.to_timestamp(F.lit(_NOW)))
    return out.select("id", "status", "lease_expires_at", "finished_at")


@query("""
WITH i AS (SELECT source, doc_id % 3 = 0 AS x, doc_id, sha256(text) AS f, doc_id % 50 AS day, doc_id % 4 = 0 AS ready FROM documents WHERE doc_id % 9 > 0),
b AS (SELECT doc_id FROM i WINDOW w AS (PARTITION BY source, x, f ORDER BY day, doc_id) QUALIFY row_number() OVER w > 1 AND NOT first_value(ready) OVER w)
SELECT d.doc_id AS id, CASE WHEN b.doc_id IS NULL THEN 'running' ELSE 'pending' END AS status,
       (CASE WHEN b.doc_id IS NULL THEN d.doc_id % 3 ELSE greatest(d.doc_id % 3 - 1, 0) END)::INT AS attempt_count,
       CASE WHEN b.doc_id IS NOT NULL THEN TIMESTAMP '1997-01-01 00:00:30' END AS run_after
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""")
def deferred_imports(spark, folder):
    """Every import has one running item; those whose archive another import is still reading are put off."""
    imports = imports_of(spark, folder)
    items = imports.select("tenant_id", F.col("id").alias("import_id"), F.lit("running").alias("status"), (F.col("id") % 3).cast("int").alias("attempt_count"), F.lit(None).cast("timestamp").alias("run_after"))
    out = store.defer_busy(items, store.fingerprint_claims(imports), F.to_timestamp(F.lit(_NOW)))
    return out.select(F.col("import_id").alias("id"), "status", "attempt_count", "run_after")
