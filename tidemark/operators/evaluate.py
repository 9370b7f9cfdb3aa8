"""Evaluation of a classifier: confusion counts, ratios, gates and the comparison of two reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, scalars
from .scan import free_name, kept

# What has to be reached, and what must not be passed.
GATES = {"core_recall": 0.92, "core_precision": 0.88, "edge_recall": 0.85, "amplified_accuracy": 0.95}
LIMITS = {"invariant_failures": 0, "failure_rate": 0.0, "most_calls": 5, "findings": 0}
#: The order in which gates are told.
TOLD = ("core_recall", "core_precision", "edge_recall", "invariant_failures", "failure_rate", "amplified_accuracy", "most_calls", "findings")


def confusion(cases: DataFrame) -> DataFrame:
    """One row of counts of cases (slice, expected, predicted). The edge slice has no false positives and true negatives."""
    core, edge = F.col("slice") == "core", F.col("slice") == "edge"
    yes, said = F.col("expected"), F.col("predicted")
    return cases.agg(
        F.count_if(core & yes & said).alias("core_tp"),
        F.count_if(core & yes & ~said).alias("core_fn"),
        F.count_if(core & ~yes & said).alias("core_fp"),
        F.count_if(core & ~yes & ~said).alias("core_tn"),
        F.count_if(edge & yes & said).alias("edge_tp"),
        F.count_if(edge & yes & ~said).alias("edge_fn"),
    )


def ratios(counts: DataFrame) -> DataFrame:
    """counts with recall and precision; null where there is nothing to divide by."""
    c = F.col
    return (
        counts.withColumn("core_recall", scalars.ratio(c("core_tp"), c("core_tp") + c("core_fn")))
        .withColumn("core_precision", scalars.ratio(c("core_tp"), c("core_tp") + c("core_fp")))
        .withColumn("edge_recall", scalars.ratio(c("edge_tp"), c("edge_tp") + c("edge_fn")))
    )


def gates(report: DataFrame, least: dict[str, float] = GATES, most: dict[str, float] = LIMITS) -> DataFrame:
    """report with failures (names of gates not met, in order of TOLD) and passed; gates whose column is not there are not
    asked for. A ratio that has nothing to divide by fails for core cases, and for edge cases in a suite that has them (the
    column suite is all, edge or null, or is not there); other gates then say nothing. 1e-12 is allowed for rounding.
    """
    has_edge = F.coalesce(F.col("suite").isin("all", "edge"), F.lit(True)) if "suite" in report.columns else F.lit(True)
    unmeasured = {"core_recall": F.lit(True), "core_precision": F.lit(True), "edge_recall": has_edge}
    missed = []
    for name in TOLD:
        if name in report.columns:
            bad = F.col(name) < least[name] - 1e-12 if name in least else F.col(name) > most[name] + 1e-12
            missed.append(F.when(F.coalesce(bad, unmeasured.get(name, F.lit(False))), F.lit(name)))
    return report.withColumn("failures", F.array_compact(F.array(*missed))).withColumn("passed", F.size("failures") == 0)


def suite_report(cases: DataFrame, by: list[str]) -> DataFrame:
    """by, and what gates ask of each suite of cases: counts as in `confusion`, their ratios, amplified_accuracy,
    failure_rate, invariant_failures, most_calls, findings.

    cases: by, slice, expected, predicted, amplified, wording_ok, invariant_failed, failed, calls, finding. Nulls count
    as no and as no call; no cases give no suites.
    """
    slices = {"core": F.col("slice") == "core", "edge": F.col("slice") == "edge"}
    counts = {
        f"{s}_{name}": F.count_if(here & hit)
        for s, here in slices.items()
        for name, hit in {"tp": F.col("expected") & F.col("predicted"), "fn": F.col("expected") & ~F.col("predicted"), "fp": ~F.col("expected") & F.col("predicted")}.items()
        if (s, name) != ("edge", "fp")
    }
    out = cases.groupBy(*by).agg(
        *[c.alias(name) for name, c in counts.items()],
        scalars.ratio(F.count_if(F.col("amplified") & F.col("wording_ok")), F.count_if("amplified")).alias("amplified_accuracy"),
        scalars.ratio(F.count_if("failed"), F.count("*")).alias("failure_rate"),
        F.count_if("invariant_failed").alias("invariant_failures"),
        F.coalesce(F.max("calls"), F.lit(0)).alias("most_calls"),
        F.count_if("finding").alias("findings"),
    )
    return ratios(out)


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: cases on each side and whether all hashes are equal. Both have (case_id, hash)."""
    both = baseline.select("case_id", F.col("hash").alias("a")).join(candidate.select("case_id", F.col("hash").alias("b")), "case_id", "full")
    return both.agg(
        F.count("a").alias("baseline"), F.count("b").alias("candidate"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different")
    ).withColumn("equal", F.col("different") == 0)


def rates(cases: DataFrame) -> DataFrame:
    """One row of cases (amplified, wording_ok, failed): accuracy of amplified wording, share of failures; null where there
    is nothing to divide by.
    """
    amplified = F.col("amplified")
    right, all_, failed = F.count_if(amplified & F.col("wording_ok")), F.count_if(amplified), F.count_if("failed")
    return cases.agg(scalars.ratio(right, all_).alias("amplified_accuracy"), scalars.ratio(failed, F.count("*")).alias("failure_rate"))


def usage(calls: DataFrame, by: list[str], batch: list[str]) -> DataFrame:
    """Tokens and calls summed up, and the most calls of a batch. Null tokens count nothing; null keys are a key."""
    names = ("input_tokens", "cached_tokens", "output_tokens")
    each = calls.groupBy(*by, *batch).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in names])
    return each.groupBy(*by).agg(F.sum("calls").alias("calls"), F.max("calls").alias("most_calls"), *[F.sum(c).alias(c) for c in names])


def privacy_findings(payloads: DataFrame, by: list[str]) -> DataFrame:
    """How many payloads hold the id of their source."""
    return payloads.groupBy(*by).agg(F.count_if(F.contains("payload", "source_id")).alias("findings"))


def winner(reports: DataFrame, compared: Column) -> Column:
    """Which of two reports wins, of columns a and b (recall, cost, hash, prompt_hash): if compared (the cases are equal),
    that of the smaller prompt hash; else of more recall, then of less cost, then of the smaller hash.
    """
    a, b = F.col("a"), F.col("b")
    rest = F.when(a["recall"] != b["recall"], a["recall"] > b["recall"]).when(a["cost"] != b["cost"], a["cost"] < b["cost"]).otherwise(a["hash"] <= b["hash"])
    first = F.when(compared, a["prompt_hash"] <= b["prompt_hash"]).otherwise(rest)
    return F.when(first, "a").otherwise("b")


def case_records(cases: DataFrame, replay: bool) -> DataFrame:
    """cases with passed_expect, invariant_failed, terminal_failure, error_code, result_sha256.

    Columns read: expect_failure (the answer is meant to break a rule), provider_failed, error (the rule that the answer
    breaks, or null), passed (a valid answer meets what is expected), result_sha256. Where a broken rule is meant, breaking
    one is the pass and a valid answer the failure; such cases exist in recordings only (replay).
    """
    meant, failed = F.col("expect_failure"), F.col("provider_failed")
    skipped = meant & F.lit(not replay)
    error = F.when(failed, "PROVIDER").otherwise(F.col("error"))
    valid = error.isNull()
    code = F.when(skipped, "REPLAY_ONLY_FIXTURE").when(meant & valid, "EXPECTED_INVARIANT_MISS").otherwise(error)
    broken = ~skipped & (meant == valid)
    return (
        cases.withColumn("passed_expect", skipped | F.when(meant, ~valid).otherwise(valid & F.col("passed")))
        .withColumn("invariant_failed", broken & ~failed)
        .withColumn("terminal_failure", broken)
        .withColumn("error_code", code)
        .withColumn("result_sha256", F.when(~meant & valid, F.col("result_sha256")))
    )


def exit_code(compared: Column, findings: Column, failures: Column) -> Column:
    """0; 11 if compared hashes differ (compared false), 12 with findings of privacy, 10 with failed gates."""
    return F.when(~compared, 11).when(findings > 0, 12).when(F.size(failures) > 0, 10).otherwise(0)


def case_hashes(records: DataFrame, by: list[str], order: Column) -> DataFrame:
    """by, and case_hashes: a map of a report's cases to the hashes of their results, in order of the cases.

    records: by, case_id, result_sha256. Cases and hashes that are null are left out, a report without others has an empty
    map; of a case's several records the last in order counts (of ties any). No records give no rows.
    """
    each = records.withColumn("last", F.struct(order.alias("at"), "result_sha256"))
    each = each.groupBy(*by, "case_id").agg(F.max(F.when(F.col("result_sha256").isNotNull(), F.col("last"))).alias("last"))
    entry = F.when(F.col("case_id").isNotNull() & F.col("last").isNotNull(), F.struct("case_id", F.col("last")["result_sha256"]))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("case_hashes"))


def attempts(responses: DataFrame, batch: list[str], order: list[str], max_calls: int = 5, max_answers: int = 2) -> DataFrame:
    """The responses that a batch's budget of calls lets happen, with attempt_no, repair, failures and last.

    responses: batch, order, answered (else the call failed), error (of the call or the answer; null: a good answer),
    retryable (of a failed call). A batch ends (last) with a good answer, a call that is not to be tried again, the second
    answer or the fifth call. repair: an answer before was bad; failures: calls that failed up to this one, for the delay.
    Null answered or retryable are no. A batch without a last row has more calls to make. Equal places in order stand in any
    order; no responses give none.
    """
    # Only max_calls rows of a batch are kept before the shuffle, so that one with very many is no hot group.
    first = Window.partitionBy(*batch).orderBy(*order)
    over = free_name(responses, "over")
    tried = responses.withColumn("attempt_no", F.row_number().over(first)).where(F.col("attempt_no") <= max_calls)
    calls = Window.partitionBy(*batch).orderBy("attempt_no")
    upto, before = calls.rowsBetween(Window.unboundedPreceding, 0), calls.rowsBetween(Window.unboundedPreceding, -1)
    answered, again = F.coalesce("answered", F.lit(False)), F.coalesce("retryable", F.lit(False))
    ends = F.when(answered, F.col("error").isNull() | (F.count_if(answered).over(upto) >= max_answers)).otherwise(~again)
    return (
        tried.withColumn("repair", F.count_if(answered).over(before) > 0)
        .withColumn("failures", F.count_if(~answered).over(upto))
        .withColumn("last", ends | (F.col("attempt_no") >= max_calls))
        .withColumn(over, F.count_if("last").over(before) > 0)
        .where(~F.col(over))
        .drop(over)
    )


def outcomes(tried: DataFrame, batch: list[str]) -> DataFrame:
    """Of attempts: batch, calls, done, and the error_code of the last one (null where it is a good answer or not done)."""
    end = F.when(F.col("last"), F.col("error"))
    return tried.groupBy(*batch).agg(F.count("*").alias("calls"), F.max("last").alias("done"), F.max(end).alias("error_code"))


def neighbours(cases: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """case_id, own, neighbours: the first n texts of the pool, walked around from a place that case_id gives, that are
    neither empty nor the case's own.

    cases: case_id, own (array of texts; null: none). pool: place (0 up to its size, each once), text. Null texts are empty
    ones; a text that stands at several places may come several times. A null case_id has no neighbours, nor has any case
    where the pool is empty. Repeated cases are one; no cases give none.

    Each round joins as many further places as a case may need, at first n and one for each own text, twice as many in each
    round after; only cases that are short of texts go on, so the rounds are few, and none after the pool's last place.
    """
    size = pool.count()
    own = F.coalesce("own", F.array().cast("array<string>"))
    open_ = cases.select("case_id", own.alias("own")).distinct()
    open_ = open_.withColumn("neighbours", F.array().cast("array<string>")).withColumn("seen", F.lit(0).cast("long"))
    open_ = open_.withColumn("start", hashing.pool_offset(F.col("case_id"), F.lit(max(size, 1))))
    texts = pool.select(F.col("place").cast("long").alias("place"), "text")
    more = (F.size("neighbours") < n) & (F.col("seen") < size) & F.col("start").isNotNull()
    out, rounds = [open_.where(~more)], 0
    open_ = open_.where(more)
    while size and n > 0:
        width = F.least((F.size("own") + n) * F.lit(2**rounds).cast("long"), size - F.col("seen"))
        steps = open_.withColumn("width", width).withColumn("step", F.explode(F.sequence(F.col("seen"), F.col("seen") + F.col("width") - 1)))
        met = steps.withColumn("place", (F.col("start") + F.col("step")) % size).join(texts, "place", "left")
        fits = (F.col("text") != "") & ~F.array_contains("own", F.col("text"))
        near = met.groupBy("case_id", "own", "neighbours", "seen", "start", "width").agg(F.array_sort(F.collect_list(F.when(fits, F.struct("step", "text")))).alias("near"))
        joined = F.slice(F.concat("neighbours", F.col("near")["text"]), 1, n)
        now = kept(near.select("case_id", "own", joined.alias("neighbours"), (F.col("seen") + F.col("width")).alias("seen"), "start"))
        out.append(now.where(~more))
        open_, rounds = now.where(more), rounds + 1
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, out).select("case_id", "own", "neighbours")


def expects_any_flag(expected: DataFrame, case: list[str]) -> DataFrame:
    """(case, any_flag): whether any expected item of a case is a flag (decision); null decisions are none."""
    return expected.groupBy(*case).agg(F.coalesce(F.bool_or(F.col("decision") == "flag"), F.lit(False)).alias("any_flag"))
