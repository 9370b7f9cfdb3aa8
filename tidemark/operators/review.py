"""Read models of reviewers: lists, counts, dashboards, scans and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, text


def page_size(limit: int | None) -> int:
    return min(max(50 if limit is None else limit, 1), 100)


def visible(flags: DataFrame) -> DataFrame:
    """Flags that are not hidden, and whose content (where its column is there) is not purged."""
    out = flags.where(F.col("hidden_at").isNull())
    return out.where(F.col("purged_at").isNull()) if "purged_at" in flags.columns else out


def review_list(flags: DataFrame, by: list[str], risk: str | None = None, status: str | None = None, cursor: Column | None = None, limit: int | None = None) -> DataFrame:
    """Each list's first page and one row more: most serious first, then newest, then by id. The cursor is an id."""
    rows = visible(flags)
    for name, value in (("risk", risk), ("status", status)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    rows = rows if cursor is None else rows.where(F.col("flag_id") > cursor)
    order = Window.partitionBy(*by).orderBy(scalars.risk_key(F.col("risk")), F.col("created_at").desc(), "flag_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= page_size(limit) + 1)


def risk_counts(flags: DataFrame, by: list[str], status: str = "open") -> DataFrame:
    """Counts by risk of the visible flags of one status."""
    risk = F.col("risk")
    return visible(flags).where(F.col("status") == status).groupBy(*by).agg(
        F.count("*").alias("n_all"), *(F.count_if(risk == r).alias(f"n_{r}") for r in ("high", "medium", "low"))
    )


def highest_open_risk(flags: DataFrame, by: list[str]) -> DataFrame:
    rows = visible(flags).where(F.col("status") == "open")
    return rows.groupBy(*by).agg(F.count("*").alias("flagged_count"), F.min_by("risk", F.struct(scalars.risk_key(F.col("risk")), -scalars.risk_rank(F.col("risk")))).alias("level"))


def dashboard(scans: DataFrame, flags: DataFrame, by: list[str]) -> DataFrame:
    """Count, level and gauge of each scan's open flags, and the first three flags of its list."""
    head = visible(flags).where(F.col("status") == "open")
    order = Window.partitionBy(*by).orderBy(scalars.risk_key(F.col("risk")), F.col("created_at").desc(), "flag_id")
    top = head.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 3)
    preview = top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "flag_id"))), lambda x: x["flag_id"]).alias("preview"))
    out = scans.select(*by).distinct().join(highest_open_risk(flags, by), by, "left").join(preview, by, "left")
    level = F.coalesce("level", F.lit("none"))
    return out.select(
        *by,
        F.coalesce("flagged_count", F.lit(0)).alias("flagged_count"),
        level.alias("level"),
        scalars.gauge(level).alias("gauge"),
        F.coalesce("preview", F.array().cast("array<bigint>")).alias("preview"),
    )


def flag_cards(flags: DataFrame) -> DataFrame:
    """What is shown of a flag: platform, date, quote, tags, explanation, why."""
    from ..plans import catalog

    quote = text.trim(F.coalesce("body", F.lit("")))
    return flags.select(
        "flag_id",
        scalars.lookup(F.col("platform"), catalog.PLATFORM_LABELS, "Unknown").alias("platform_label"),
        scalars.display_date(F.col("created_at")).alias("date"),
        quote.alias("quote"),
        F.coalesce("category", F.lit("other")).alias("category"),
        text.tags(F.col("evidence")).alias("tags"),
        F.coalesce("reason_summary", F.lit("Flagged for review.")).alias("explanation"),
        text.why_flagged(F.col("category")).alias("why_flagged"),
        F.when(F.col("status") == "closed", "resolved").otherwise(F.col("status")).alias("status"),
    )


def remaining(grants: DataFrame, usages: DataFrame, grant: str, limit: str) -> DataFrame:
    """grants with used and remaining (never under 0; null: no limit)."""
    used = usages.groupBy(grant).agg(F.count("*").alias("used"))
    out = grants.join(used, grant, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return out.withColumn("remaining", F.when(F.col(limit).isNotNull(), F.greatest(F.col(limit) - F.col("used"), F.lit(0))))


def platform_limit(imports: DataFrame, by: list[str], limit: int) -> DataFrame:
    return imports.groupBy(*by).agg(F.countDistinct("platform").alias("platforms")).withColumn("within", F.col("platforms") <= limit)


def import_list(imports: DataFrame, by: list[str], cursor: Column | None = None, limit: int | None = None) -> DataFrame:
    """Each list's first page of imports and one row more: oldest first, then by id. The cursor is an id."""
    rows = imports if cursor is None else imports.where(F.col("import_id") > cursor)
    order = Window.partitionBy(*by).orderBy("created_at", "import_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= page_size(limit) + 1)


def admissions(requests: DataFrame, imports: DataFrame, entitlements: DataFrame, scans: DataFrame) -> DataFrame:
    """(request_id, error_code) of requests (request_id, tenant_id, user_id, import_ids, created_at) for a scan: the first
    rule broken, or null if it is admitted.

    Ids have to be some, not null and without repeats; there has to be an entitlement (tenant_id, user_id, platform_limit,
    rescans_remaining; a null remainder is no limit) with scans left; the imports (tenant_id, user_id, import_id, platform,
    status) have to be the user's own, ready, and of no more platforms than allowed; and no scan (tenant_id, user_id,
    status) may be active. Of several requests of a user that pass all these only the earliest is admitted. An entitlement
    is one row a user. Other columns are left out.
    """
    user = ["tenant_id", "user_id"]
    ids = F.coalesce("import_ids", F.array().cast(requests.schema["import_ids"].dataType))
    asked = requests.select("request_id", *user, "created_at", ids.alias("ids"))
    wanted = asked.select("request_id", *user, F.explode(scalars.id_set("ids")).alias("import_id"))
    found = wanted.join(imports.select(*user, "import_id", "platform", "status"), [*user, "import_id"]).groupBy("request_id").agg(
        F.count("*").alias("found"), F.count_if(F.coalesce(F.col("status") != "ready", F.lit(True))).alias("unready"), F.countDistinct("platform").alias("platforms")
    )
    rights = entitlements.select(*user, "platform_limit", "rescans_remaining", F.lit(True).alias("entitled"))
    active = scans.where(F.col("status").isin("queued", "running")).select(*user).distinct().withColumn("active", F.lit(True))
    valid = (F.size("ids") > 0) & (F.size(scalars.id_set("ids")) == F.size("ids")) & ~F.exists("ids", lambda x: x.isNull())
    code = (
        F.when(~valid, "INVALID_ARCHIVE_IMPORT_IDS")
        .when(F.col("entitled").isNull() | (F.col("rescans_remaining") == 0), "ENTITLEMENT_REQUIRED")
        .when(F.coalesce("found", F.lit(0)) != F.size("ids"), "RESOURCE_NOT_FOUND")
        .when(F.col("unready") > 0, "IMPORTS_NOT_READY")
        .when(F.col("platforms") > F.col("platform_limit"), "PLATFORM_LIMIT_EXCEEDED")
        .when(F.col("active"), "SCAN_ALREADY_RUNNING")
    )
    judged = asked.join(found, "request_id", "left").join(rights, user, "left").join(active, user, "left")
    judged = judged.select("request_id", *user, "created_at", code.alias("error_code"))
    first = judged.where(F.col("error_code").isNull()).groupBy(*user).agg(F.min(F.struct("created_at", "request_id")).alias("first"))
    late = F.col("error_code").isNull() & (F.struct("created_at", "request_id") != F.col("first"))
    return judged.join(first, user, "left").select("request_id", F.when(late, "SCAN_ALREADY_RUNNING").otherwise(F.col("error_code")).alias("error_code"))
