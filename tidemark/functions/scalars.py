"""Dates, numbers, risks and labels on columns. What depends on the time takes it as a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import catalog


def lookup(value: Column, table: dict, default: object) -> Column:
    """A small fixed table as an expression."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def tweet_time(x: Column) -> Column:
    """Timestamp of `Wed Oct 10 20:19:24 +0000 2018`; null if it is none, or if the day's name is wrong."""
    at = F.try_to_timestamp(F.substring(x, 5, 64), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.when(x.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4}$") & (F.date_format(at, "EEE") == F.left(x, F.lit(3))), at)


def archive_time(x: Column) -> Column:
    """Timestamp of RFC 3339, or of `YYYY-MM-DD HH:MM:SS UTC`; else null."""
    strict = x.rlike(r"^\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})| \d{2}:\d{2}:\d{2} UTC)$")
    return F.when(strict, F.try_to_timestamp(x))


def display_date(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy")


def is_peak(at: Column) -> Column:
    return (F.weekday(at) < 5) & F.hour(at).isin(1, 2, 3, 6, 7, 8, 9)


def cost(tokens: Column, hits: Column, output: Column, at: Column) -> Column:
    """USD; half outside peak hours; hits count up to all tokens."""
    hit = F.least(hits, tokens)
    whole = (tokens - hit) * catalog.PRICE_MISS + hit * catalog.PRICE_HIT + output * catalog.PRICE_OUTPUT
    return F.when(is_peak(at), 1.0).otherwise(0.5) * whole / 1_000_000


def evaluation_cost(tokens: Column, hits: Column, output: Column) -> Column:
    """USD at peak price; hits are not bounded by tokens."""
    return (F.greatest(tokens - hits, F.lit(0)) * catalog.PRICE_MISS + hits * catalog.PRICE_HIT + output * catalog.PRICE_OUTPUT) / 1_000_000


def screening_cost(tokens: Column) -> Column:
    return tokens * catalog.PRICE_SCREEN / 1_000_000


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.greatest(F.pow(F.lit(2.0), attempt - 1), F.lit(1.0)), F.lit(300.0)).cast("long")


def transport_delay(failures: Column, retry_after: Column, jitter: Column) -> Column:
    """Milliseconds before the next call after so many failures: 1, 2, then 4 seconds; what a rate limit asks for counts
    instead, up to twice that and 1 at least; jitter is added, below 250.
    """
    delay = F.when(failures <= 1, 1000).when(failures == 2, 2000).otherwise(4000)
    return F.coalesce(F.greatest(F.least(retry_after, delay * 2), F.lit(1)), delay) + F.pmod(jitter, F.lit(250))


def risk_rank(risk: Column) -> Column:
    return F.coalesce(lookup(risk, catalog.RISK_RANKS, 0), F.lit(0))


def risk_key(risk: Column) -> Column:
    """Order of lists: high, medium, then the rest."""
    return F.when(risk == "high", 0).when(risk == "medium", 1).otherwise(2)


def flagged_score(score: Column, probabilities: Column) -> Column:
    """Expected level given that there is one: sum of l p(l) by sum of p(l) for l of 1 to 3; else the score, else 0."""
    p = {k: F.coalesce(F.try_element_at(probabilities, F.lit(str(k))), F.lit(0.0)) for k in (1, 2, 3)}
    total = p[1] + p[2] + p[3]
    out = F.when(total > 0, (p[1] + p[2] * 2 + p[3] * 3) / total).otherwise(score)
    return F.when(F.isnan(out) | out.isNull() | (F.abs(out) == float("inf")), 0.0).otherwise(out)


def risk_of_score(score: Column, ceiling: Column) -> Column:
    level = F.when(score >= 2.5, 4).when(score >= 1.5, 3).otherwise(2)
    return lookup(F.least(level, risk_rank(ceiling)), {4: "high", 3: "medium", 2: "low"}, "none")


def gauge(level: Column) -> Column:
    return lookup(level, catalog.GAUGES, 0)


def scan_phase(status: Column, phase: Column) -> Column:
    return (
        F.when(status == "succeeded", "complete")
        .when(phase == "complete", F.when(status == "queued", "connecting").otherwise("scanning"))
        .otherwise(phase)
    )


def scan_progress(status: Column, progress: Column) -> Column:
    return F.when(status == "succeeded", 1.0).otherwise(F.least(F.greatest(progress / 100.0, F.lit(0.0)), F.lit(1.0)))


def scan_message(status: Column, phase: Column, progress: Column) -> Column:
    """phase and progress as scan_phase and scan_progress give them."""
    return (
        F.when(status == "failed", "scan failed")
        .when(status == "cancelled", "scan cancelled")
        .when((status == "succeeded") | (phase == "complete"), "scan complete")
        .when((phase == "flagging") | (progress >= 0.67), "flagging...")
        .when((phase == "scanning") | (progress >= 0.34), "scanning...")
        .otherwise("connecting...")
    )


def batch_progress(batch: Column, total: Column) -> Column:
    return F.least(F.floor((batch + 1) * 90 / total) + 5, F.lit(95)).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def in_order(values: Column, order: tuple[str, ...]) -> Column:
    """The values that the order knows, once each, in its order."""
    return F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(values, x))


def audience(coming_up: Column) -> Column:
    known = F.transform(in_order(coming_up, tuple(catalog.AUDIENCES)), lambda x: lookup(x, catalog.AUDIENCES, None))
    return F.when(F.size(known) > 0, F.array_join(known, " and ")).otherwise(catalog.GENERAL_AUDIENCE)


def onboarding_status(completed_at: Column, coming_up: Column, concerns: Column, platforms: Column, revision: Column, step: Column) -> Column:
    blank = (F.size(coming_up) == 0) & (F.size(concerns) == 0) & (F.size(platforms) == 0) & (revision == 0) & (step <= 1)
    return F.when(completed_at.isNotNull(), "completed").when(blank, "not_started").otherwise("in_progress")


def onboarding_error(coming_up: Column, concerns: Column, platforms: Column, step: Column, status: Column, consent: Column, version: Column) -> Column:
    """The first rule that a questionnaire breaks, or null. Lists go before the step, this before the status; in a list the
    first value at fault tells. Null counts as an empty list, as no consent, as an unknown value.
    """
    no = F.lit(False)

    def listed(values: Column, known: tuple[str, ...], enabled: tuple[str, ...] | None = None) -> tuple[Column, Column]:
        values = F.coalesce(values, F.array().cast("array<string>"))

        def fault(x: Column, k: Column) -> Column:
            out = F.when(~F.coalesce(x.isin(*known), no), "ONBOARDING_INVALID_ENUM")
            if enabled is not None:
                out = out.when(~x.isin(*enabled), "ONBOARDING_PLATFORM_DISABLED")
            return out.when(F.array_position(values, x) <= k, "ONBOARDING_DUPLICATE_ENUM")

        return F.get(F.array_compact(F.transform(values, fault)), F.lit(0)), F.size(values) == 0

    lists = [listed(coming_up, catalog.COMING_UP), listed(concerns, catalog.CONCERNS), listed(platforms, tuple(catalog.PLATFORM_LABELS), catalog.ARCHIVE_PLATFORMS)]
    blank = [empty for _, empty in lists]
    accepted = F.coalesce(consent, no)
    fresh = blank[0] & blank[1] & blank[2] & (step == 1) & ~accepted
    whole = ~blank[0] & ~blank[1] & ~blank[2] & (step == 3) & accepted & F.coalesce(version == catalog.DISCLOSURE, no)
    return F.coalesce(
        *[fault for fault, _ in lists],
        F.when(~F.coalesce(step.between(1, 3), no), "ONBOARDING_STEP"),
        F.when((status == "not_started") & ~fresh, "ONBOARDING_STATUS"),
        F.when((status == "completed") & ~whole, "ONBOARDING_INCOMPLETE"),
        F.when(~F.coalesce(status.isin("not_started", "in_progress", "completed"), no), "ONBOARDING_STATUS"),
    )


def lifecycle_gate(signed_in: Column, onboarding: Column, platforms: Column, ready: Column, scan_status: Column, review_access: Column) -> Column:
    """platforms: wanted; ready: platforms that have a ready import."""
    required = F.filter(platforms, lambda p: p.isin("reddit", "x"))
    waiting = (F.size(required) == 0) | (F.size(F.array_except(required, ready)) > 0) | scan_status.isNull()
    return (
        F.when(~signed_in, "welcome")
        .when(onboarding.isNull() | (onboarding != "completed"), "onboarding")
        .when(waiting, "awaiting_import")
        .when(~scan_status.isin("succeeded", "failed", "cancelled"), "scanning")
        .when((scan_status == "succeeded") & F.coalesce(review_access, F.lit(False)), "app")
        .otherwise("awaiting_import")
    )


def migrated_concerns(concerns: Column) -> Column:
    """Concerns of the three-step questionnaire: the combined one becomes two, unknown ones go, each stands once."""
    each = F.flatten(F.transform(concerns, lambda c: F.when(c == "drinking_drugs", F.array(F.lit("underage_drinking"), F.lit("drug_use"))).otherwise(F.array(c))))
    return F.array_distinct(F.filter(each, lambda c: c.isin(*catalog.STEP_CONCERNS)))


def id_set(*lists) -> Column:
    """All ids of the lists once, sorted; nulls are left out, and a null list gives null."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*lists))))
