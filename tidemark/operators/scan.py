"""The scan: rows of text to segments, batches, classifier answers, validated results and one result for each source."""

from __future__ import annotations

import json
import math
import os
import re
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import hashing, scalars, text
from ..plans import catalog


def prepare(rows: DataFrame, most: int = catalog.MAX_SCALARS, max_tokens: int = catalog.MAX_TOKENS, base: int = catalog.BASE) -> DataFrame:
    """A row for each segment of each row's plain text: the columns of rows, segment_ordinal, text and tokens.

    rows has a column body; empty texts give no segment. A segment beyond what a batch can take is parted again.
    """
    budget = max(max_tokens - base - 64, 64)
    parts = text.segments(text.minimize(F.col("body")), most, budget)
    each = rows.select(*rows.columns, F.posexplode(parts).alias("segment_ordinal", "text"))
    return each.withColumn("tokens", text.estimate_tokens(F.col("text")))


def pack(
    items: DataFrame,
    scan: str,
    order: list[str],
    tokens: str = "tokens",
    max_items: int = catalog.MAX_ITEMS,
    max_tokens: int = catalog.MAX_TOKENS,
    base: int = catalog.BASE,
    per_item: int = catalog.PER_ITEM,
    max_output: int = catalog.MAX_OUTPUT,
    out: int = catalog.OUT,
    also: tuple[str, int] | None = None,
) -> DataFrame:
    """items with batch_ordinal and item_index (from 0): each scan's items in order, greedily; the first item of a batch is
    always taken, none is dropped.

    Where a batch ends depends on all items before. The rows are parted by ranges of (scan, order), so that a large scan
    is dealt out to many tasks; each part tells how it ends for every row at which a batch may begin in it (a batch has
    few items, so these are its first few), the driver follows these from part to part, and each part is then packed
    from where it begins. Ties of the order go by all its columns; nulls of the order come last. also: a second cost and its
    limit; it has no base and nothing is added to it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType

    most = max(1, min(max_items, max_output // out))
    by = [F.col(scan).asc(), *[F.col(c).asc_nulls_last() for c in order]]
    ordered = items.repartitionByRange(*by).sortWithinPartitions(*by)
    part = free_name(items, "part")
    ordered = kept(ordered.withColumn(part, F.spark_partition_id()))
    second, limit = also or (tokens, None)
    schema = StructType([*items.schema.fields, StructField("batch_ordinal", IntegerType()), StructField("item_index", IntegerType())])
    kinds, key, size, size2 = to_arrow_schema(schema), items.columns.index(scan), items.columns.index(tokens), items.columns.index(second)
    width = len(items.columns)

    def step(ordinal: int, index: int, total: int, rest: int, n: int, m: int) -> tuple[int, int, int, int]:
        """The state after an item of n tokens (and second cost m): its batch, the items, the tokens and second cost of this."""
        if index >= most or index and (total + n + per_item > max_tokens or limit is not None and rest + m > limit):
            ordinal, index, total, rest = ordinal + 1, 0, base, 0
        return ordinal, index + 1, max(total + n + per_item, total + 1), rest + m if limit is not None else 0

    new = (0, 0, base, 0)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A start's end is that of the state it has run into, so many batches later; equal states are followed once.
        part, first, last, head, changed, rows = None, None, None, [], False, 0
        states: dict[int, tuple[int, ...]] = {}
        runs_as: list[tuple[int, int]] = []
        for batch in batches:
            for p, s, n, m in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if not rows:
                    part, first = p, s
                elif s != last:
                    changed, states = True, {0: new}
                if not changed and rows < most:
                    head.append([n, m])
                    states[rows] = new
                    runs_as.append((rows, 0))
                last, rows = s, rows + 1
                seen: dict[tuple[int, ...], int] = {}
                for k, state in list(states.items()):
                    ordinal, *rest = states[k] = step(*state, n, m)
                    at = seen.setdefault(tuple(rest), k)
                    if at != k:
                        runs_as = [(at, d + ordinal - states[at][0]) if r == k else (r, d) for r, d in runs_as]
                        del states[k]
        if rows:
            found = [states[0]] * len(head) if changed else [(states[r][0] + d, *states[r][1:]) for r, d in runs_as]
            row = {"part": part, "changed": changed, "n": rows, "head": head, "found": [list(x) for x in found]}
            told = pa.RecordBatch.from_pylist([row], schema=ends_kinds)
            scans = pa.array([first, last], kinds.field(key).type)
            yield pa.RecordBatch.from_arrays([*told.columns, scans[:1], scans[1:]], names=[*ends_kinds.names, "first", "last"])

    ends_kinds = pa.schema(
        [("part", pa.int32()), ("changed", pa.bool_()), ("n", pa.int64()), ("head", pa.list_(pa.list_(pa.int64()))), ("found", pa.list_(pa.list_(pa.int64())))]
    )
    kind = items.schema[scan].dataType.simpleString()
    told = ordered.select(part, scan, F.col(tokens).cast("long").alias("n"), F.col(second).cast("long").alias("m")).mapInArrow(
        ends, f"part int, changed boolean, n long, head array<array<long>>, found array<array<long>>, first {kind}, last {kind}"
    )
    last, state, begins = object(), new, {}
    for r in sorted(told.collect(), key=lambda r: r["part"]):
        if r["first"] != last:
            state = new
        begins[r["part"]] = state
        # A batch that is open goes on for some rows; the next begins at one of those told, or in another scan.
        for k, (n, m) in enumerate(r["head"]):
            after = step(*state, n, m)
            if after[1] == 1:
                ordinal, *rest = r["found"][k]
                state = (ordinal if r["changed"] else after[0] + ordinal, *rest)
                break
            state = after
        else:
            if r["changed"]:
                state = tuple(r["found"][0])
        last = r["last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = last = None
        for batch in batches:
            where, at = [], []
            for p, s, n, m in zip(*(batch.column(c).to_pylist() for c in (width, key, size, size2)), strict=True):
                if state is None:
                    last, state = s, begins[p]
                if s != last:
                    last, state = s, new
                state = step(*state, n, m)
                where.append(state[0])
                at.append(state[1] - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(where, pa.int32()), pa.array(at, pa.int32())], schema=kinds)

    return ordered.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, in the session's spark.checkpoint.dir; where that is unset, and only on one machine, in a
    temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^,\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "tidemark-checkpoints"))
    return df.checkpoint()


def stub_results(items: DataFrame, concerns: list[str], index: str = "item_index", body: str = "text") -> DataFrame:
    """items with decision, risk, category, confidence, reason_code and evidence of the deterministic stub classifier."""
    first = next((c for c in concerns if c != "other"), "negativity")
    category = first if first in catalog.STUB_REASONS else "negativity"
    hit = (hashing.stub_byte(F.col(index), F.col(body)) % 2 == 1) & (F.octet_length(body) >= 8) & F.lit(category in concerns)
    name = free_name(items, "hit")
    flag = F.col(name)
    return (
        items.withColumn(name, F.coalesce(hit, F.lit(False)))
        .withColumn("decision", F.when(flag, "flag").otherwise("no_flag"))
        .withColumn("risk", F.when(flag, "low").otherwise("none"))
        .withColumn("category", F.when(flag, category))
        .withColumn("confidence", F.when(flag, 0.75).otherwise(0.91))
        .withColumn("reason_code", F.when(flag, catalog.STUB_REASONS[category]))
        .withColumn("evidence", F.when(flag, F.left(F.col(body), F.lit(8))))
        .drop(name)
    )


def expected_results(items: DataFrame, concerns: list[str]) -> DataFrame:
    """items (text, authorship, expected_decision, expected_category, expected_risk; null where nothing is expected) with
    the result that meets what is expected: decision, risk, category, confidence, reason_code, summary, evidence.
    """
    flag = F.coalesce(F.col("expected_decision") == "flag", F.lit(False))
    category = F.coalesce("expected_category", F.lit(next((c for c in concerns if c != "other"), "negativity")))
    told = F.concat(F.when(F.col("authorship") == "amplified", "you shared content matching ").otherwise("text matches "), category)
    head = F.left(F.coalesce("text", F.lit("")), F.lit(40))
    return (
        items.withColumn("decision", F.when(flag, "flag").otherwise("no_flag"))
        .withColumn("risk", F.when(flag, F.coalesce("expected_risk", F.lit("low"))).otherwise("none"))
        .withColumn("category", F.when(flag, category))
        .withColumn("confidence", F.when(flag, 0.91).otherwise(0.92))
        .withColumn("reason_code", F.when(flag, scalars.lookup(category, catalog.STUB_REASONS, catalog.STUB_REASONS["negativity"])))
        .withColumn("summary", F.when(flag, told))
        .withColumn("evidence", F.when(flag, F.when(head == "", "x").otherwise(head)))
    )


def replay_results(items: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """Recorded answers (their columns besides `on`) of items; items without one have nulls."""
    return items.join(answers, on, "left")


def first_error(rows: list[tuple[Column, str]]) -> Column:
    """The code of the first rule that holds, or null."""
    out = F.lit(None).cast("string")
    for rule, code in reversed(rows):
        out = F.when(rule, F.lit(code)).otherwise(out)
    return out


def result_error(concerns: list[str], confidence_first: bool = False, nul_is_error: bool = True) -> Column:
    """The first rule that a result breaks, or null. Columns: decision, risk, category, confidence, authorship, text,
    reasons array<struct<code,summary>>, evidence array<struct<text,supports>>.
    """
    reasons, evidence, category = F.col("reasons"), F.col("evidence"), F.col("category")
    codes = F.transform(reasons, lambda r: r["code"])
    flag = F.col("decision") == "flag"
    allowed = {c: [*r] for c, _, r in catalog.RUBRICS}
    of_category = scalars.lookup(category, {c: "|".join(r) for c, r in allowed.items()}, "")

    def bad_text(t: Column, most: int) -> Column:
        nul = F.contains(t, F.lit("\0")) if nul_is_error else F.lit(False)
        return (t == "") | (F.length(t) > most) | nul

    confidence = (~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)) | F.isnan("confidence"), "SCAN_OUTPUT_SCHEMA")
    rules = [
        ((F.col("decision") == "no_flag") & ((F.col("risk") != "none") | category.isNotNull() | (F.size(reasons) > 0) | (F.size(evidence) > 0)), "SCAN_DECISION_FIELDS"),
        (~F.col("decision").isin("flag", "no_flag"), "SCAN_DECISION_FIELDS"),
        (flag & (~F.col("risk").isin("low", "medium", "high") | category.isNull()), "SCAN_DECISION_FIELDS"),
        (flag & (~category.isin(*concerns) | (category == "other")), "SCAN_CATEGORY_NOT_SELECTED"),
        (flag & (~F.size(reasons).between(1, 3) | ~F.size(evidence).between(1, 3)), "SCAN_DECISION_FIELDS"),
        # Rule by rule within a reason: the first reason that breaks one tells which.
        (flag & (F.get(F.filter(F.transform(reasons, lambda r: F.when(~F.array_contains(F.split(of_category, r"\|"), r["code"]), 1).when(bad_text(r["summary"], 240), 2)), lambda x: x.isNotNull()), F.lit(0)) == 1), "SCAN_REASON_CATEGORY"),
        (flag & F.exists(reasons, lambda r: bad_text(r["summary"], 240)), "SCAN_OUTPUT_TEXT_LIMIT"),
        (flag & (F.get(F.filter(F.transform(evidence, lambda e: F.when(~F.array_contains(codes, e["supports"]), 1).when(bad_text(e["text"], 160), 2).when(~F.contains(F.col("text"), e["text"]), 1)), lambda x: x.isNotNull()), F.lit(0)) == 1), "SCAN_EVIDENCE_NOT_SUBSTRING"),
        (flag & F.exists(evidence, lambda e: bad_text(e["text"], 160)), "SCAN_OUTPUT_TEXT_LIMIT"),
        (flag & (F.col("authorship") == "amplified") & F.exists(reasons, lambda r: F.lower(r["summary"]).rlike("|".join(catalog.FORBIDDEN_AMPLIFIED))), "SCAN_AMPLIFIED_ATTRIBUTION"),
    ]
    return first_error([confidence, *rules] if confidence_first else [*rules, confidence])


def index_errors(batches: DataFrame, results: DataFrame, batch: list[str], size: str = "batch_items", index: str = "item_index") -> DataFrame:
    """(batch, ok) for each row of batches (batch, size): whether its results have each index 0 .. size - 1 once. A batch
    without any result is not ok.
    """
    found = results.groupBy(*batch).agg(
        F.count("*").alias("n"), F.countDistinct(index).alias("different"), F.min(index).alias("least"), F.max(index).alias("most")
    )
    ok = (F.col("n") == F.col(size)) & (F.col("different") == F.col(size)) & (F.col("least") == 0) & (F.col("most") == F.col(size) - 1)
    return batches.select(*batch, size).join(found, batch, "left").select(*batch, F.coalesce(ok, F.col(size) == 0).alias("ok"))


def roll_up(segments: DataFrame, source: list[str]) -> DataFrame:
    """One result for each source: the segment of most serious risk, then confidence, then least ordinal.

    Columns read: segment_ordinal, decision, risk, category, confidence, reasons array<struct<code,summary>>, evidence
    array<struct<text,supports>>. reasons (once for each code) and evidence (once for each code and text) come from
    segments of the winner's category, in order of segments, three at most. Texts have few segments, so a source's are
    gathered. Flagged unless risk is none or the decision no_flag; what is not flagged has no category.
    """
    rank = F.struct(scalars.risk_rank(F.col("risk")).alias("rank"), "confidence", (-F.col("segment_ordinal")).alias("order"))
    each = F.struct("segment_ordinal", "category", "reasons", "evidence")
    out = segments.groupBy(*source).agg(
        F.max_by(F.struct("decision", "risk", "category", "confidence"), rank).alias("w"), F.array_sort(F.collect_list(each)).alias("all")
    )
    own = F.filter("all", lambda s: s["category"].eqNullSafe(F.col("w.category")))

    def once(items: Column, key) -> Column:
        """The first of each key, in order."""
        keys = F.transform(items, key)
        return F.slice(F.filter(items, lambda x, k: F.array_position(keys, key(x)) == k + 1), 1, 3)

    reasons = F.flatten(F.transform(own, lambda s: F.coalesce(s["reasons"], F.array())))
    evidence = F.flatten(F.transform(own, lambda s: F.coalesce(s["evidence"], F.array())))
    flagged = (F.col("w.risk") != "none") & (F.col("w.decision") != "no_flag")
    return out.select(
        *source,
        flagged.alias("flagged"),
        "w.risk",
        F.when(flagged, F.col("w.category")).alias("category"),
        "w.confidence",
        F.when(flagged, once(reasons, lambda r: r["code"])).alias("reasons"),
        F.when(flagged, once(evidence, lambda e: F.struct(e["supports"], e["text"]))).alias("evidence"),
    )


def screen_plan(posts: DataFrame, concerns: list[str], id_col: str = "post_id", text_col: str = "text") -> DataFrame:
    """(post_id, concern, too_long): every post that is not blank with every rubric of the chosen concerns; their number is fixed."""
    chosen = F.array(*[F.lit(c) for c, _, _ in catalog.RUBRICS if c in concerns])
    some = posts.where(text.trim(F.col(text_col)) != "")
    too_long = text.estimate_tokens(F.col(text_col)) + 4 > catalog.SCREEN_POST
    return some.select(F.col(id_col).alias("post_id"), too_long.alias("too_long"), F.explode(chosen).alias("concern"))


def screen_hits(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """plan with score and escalates; an answer that is missing or no number counts as 1."""
    score = F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(1.0))
    return plan.join(answers, ["post_id", "concern"], "left").withColumn("score", score).withColumn("escalates", F.col("score") >= catalog.ESCALATE_AT)


def screen_batches(posts: DataFrame, scan: str, order: list[str], text_col: str = "text", question_tokens: int = 0) -> DataFrame:
    """posts with batch_ordinal and item_index of screening requests: few posts, a limit for their tokens and one for
    these with their questions'; a post beyond them has a request of its own.
    """
    state, request = free_name(posts, "state_tokens"), free_name(posts, "request_tokens")
    cost = (text.estimate_tokens(F.col(text_col)) + 4).cast("long")
    priced = posts.withColumn(state, cost).withColumn(request, cost + question_tokens)
    limits = {"max_items": catalog.SCREEN_POSTS, "max_tokens": catalog.SCREEN_REQUEST, "base": 0, "per_item": 0}
    packed = pack(priced, scan, order, request, **limits, max_output=catalog.SCREEN_POSTS, out=1, also=(state, catalog.SCREEN_STATE))
    return packed.drop(state, request)


def confirmations(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """The escalated rows of hits (post_id, concern) with the confirmed score and error: an answer that is missing or no
    number has to be asked for again, and is no pass.
    """
    asked = hits.where("escalates").select("post_id", "concern").join(answers.select("post_id", "concern", F.col("score").alias("confirmed")), ["post_id", "concern"], "left")
    missing = F.col("confirmed").isNull() | F.isnan("confirmed")
    return asked.select("post_id", "concern", F.when(~missing, F.col("confirmed")).alias("score"), F.when(missing, "SCAN_CONFIRM_MISSING").alias("error"))


def primary_concern(confirmed: DataFrame) -> DataFrame:
    """(post_id, concern, score): of each post's confirmed concerns those near the best, and of these the first in order.
    A post with a row in error has none.
    """
    place = scalars.lookup(F.col("concern"), {c: k for k, (c, _, _) in enumerate(catalog.RUBRICS)}, len(catalog.RUBRICS))
    each = F.collect_list(F.when(F.col("score") >= catalog.FLAG_AT, F.struct(place.alias("place"), "concern", "score")))
    failed = F.max(F.col("error").isNotNull()) if "error" in confirmed.columns else F.lit(False)
    # A post has as many rows as there are rubrics, at most.
    found = confirmed.groupBy("post_id").agg(each.alias("all"), F.max("score").alias("best"), failed.alias("failed"))
    near = F.filter("all", lambda x: x["score"] >= F.col("best") - catalog.NEAR_BEST - 1e-12)
    return found.where(~F.col("failed") & (F.size("all") > 0)).select("post_id", F.array_min(near).alias("m")).select("post_id", "m.concern", "m.score")


def chosen_reason(concern: Column, choice: Column) -> Column:
    """A concern's only reason code, or the one chosen; null (to be asked for again) if that is none of the concern's."""
    codes = F.split(scalars.lookup(concern, {c: "|".join(r) for c, _, r in catalog.RUBRICS}, ""), r"\|")
    return F.when(F.size(codes) == 1, F.nullif(codes[0], F.lit(""))).when(F.array_contains(codes, choice), choice)


def chosen_evidence(passages: Column, whole: Column, choice: Column) -> Column:
    """The evidence of a flag: without passages the head of the whole text; the only passage; else the passage that the
    choice (`s` and its number, from 0) names; null (to be asked for again) if it names none.
    """
    number = F.when(choice.rlike(r"^s\+?[0-9]{1,9}$"), F.regexp_extract(choice, "([0-9]+)", 1).cast("int"))
    return F.when(F.size(passages) == 0, text.whole_text_evidence(whole)).when(F.size(passages) == 1, passages[0]).otherwise(F.get(passages, number))


def screen_results(posts: DataFrame, hits: DataFrame, primary: DataFrame, confirmed: DataFrame, id_col: str = "post_id") -> DataFrame:
    """One result for each post: post_id, decision, category, confidence, reason_code, error.

    A flag has its concern's score as confidence, and its reason where the concern knows but one. Others have 1 less the
    highest screening score; a post that was never screened, or without rubrics, 1. Posts in error have no decision.
    """
    alone = {c: r[0] for c, _, r in catalog.RUBRICS if len(r) == 1}
    top = hits.groupBy("post_id").agg(F.max("score").alias("top"))
    failed = confirmed.where(F.col("error").isNotNull()).groupBy("post_id").agg(F.min("error").alias("error"))
    out = posts.select(F.col(id_col).alias("post_id")).join(top, "post_id", "left").join(failed, "post_id", "left").join(primary, "post_id", "left")
    flag = F.col("concern").isNotNull()
    return out.select(
        "post_id",
        F.when(F.col("error").isNull(), F.when(flag, "flag").otherwise("no_flag")).alias("decision"),
        F.col("concern").alias("category"),
        F.when(flag, F.col("score")).otherwise(1.0 - F.coalesce("top", F.lit(0.0))).alias("confidence"),
        scalars.lookup(F.col("concern"), alone, None).alias("reason_code"),
        "error",
    )


#: What a parsed answer has, at each level, in order of names.
ANSWER = "schema_version string, results array<struct<category:string,confidence:double,decision:string,evidence:array<struct<supports_reason_code:string,text:string>>,item_index:long,reasons:array<struct<code:string,summary:string>>,risk:string>>"


@F.pandas_udf(StructType([StructField("error", StringType()), StructField("answer", StringType())]))
def _strict(raw: pd.Series) -> pd.DataFrame:
    """SCAN_OUTPUT_JSON if the whole text is not one JSON value, SCAN_OUTPUT_SCHEMA if its keys (in camel case) and kinds
    are not those of an answer; a category may be left out, of equal keys the last counts.
    """

    def constant(x: str) -> float:
        raise ValueError(x)

    def real(x: str) -> float:
        if not math.isfinite(value := float(x)):
            raise ValueError(x)
        return value

    def texts(value: dict, *names: str) -> bool:
        return set(value) == set(names) and all(isinstance(value[n], str) for n in names)

    def result(r: dict) -> dict | None:
        own = {k: r[k] for k in ("decision", "risk", "confidence", "reasons", "evidence")}
        own |= {"category": r.get("category"), "item_index": r["itemIndex"]}
        good = len(r) == len(own) - ("category" not in r) and all(isinstance(r[k], str) for k in ("decision", "risk"))
        good &= own["category"] is None or isinstance(own["category"], str)
        good &= type(own["item_index"]) is int and 0 <= own["item_index"] < 2**32 and type(own["confidence"]) in (int, float)
        good &= all(isinstance(own[k], list) for k in ("reasons", "evidence")) and all(texts(x, "code", "summary") for x in own["reasons"])
        if not good or not all(texts(e, "text", "supportsReasonCode") for e in own["evidence"]):
            return None
        return own | {"evidence": [{"text": e["text"], "supports_reason_code": e["supportsReasonCode"]} for e in own["evidence"]]}

    def judge(x: str) -> tuple[str | None, str | None]:
        if x is None or not x.strip() or "```" in x:
            return "SCAN_OUTPUT_JSON", None
        try:
            value = json.loads(x.strip(), parse_constant=constant, parse_float=real)
            json.dumps(value, ensure_ascii=False).encode()
        except (ValueError, RecursionError):
            return "SCAN_OUTPUT_JSON", None
        try:
            results = [result(r) for r in value["results"]] if isinstance(value["results"], list) else [None]
            good = set(value) == {"schemaVersion", "results"} and isinstance(value["schemaVersion"], str) and None not in results
        except (TypeError, KeyError, AttributeError):
            good = False
        if not good:
            return "SCAN_OUTPUT_SCHEMA", None
        return None, json.dumps({"schema_version": value["schemaVersion"], "results": results}, ensure_ascii=False)

    return pd.DataFrame([judge(x) for x in raw], columns=["error", "answer"])


def parse_answers(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """raw with error and answer (a struct of ANSWER, null where there is an error): strictly parsed recorded answers."""
    found = free_name(raw, "found")
    out = raw.withColumn(found, _strict(F.col(text_col)))
    return out.withColumn("error", F.col(f"{found}.error")).withColumn("answer", F.from_json(F.col(f"{found}.answer"), ANSWER)).drop(found)


def scan_stub(rows: DataFrame, scan: str, order: list[str], concerns: list[str]) -> DataFrame:
    """The whole scan with the stub classifier: flags of rows (id columns, body), a row for each flagged source."""
    # A source's whole text is left behind: else each of its segments would take it along. Segments are made once, not
    # again for the sample of their ranges.
    packed = pack(kept(prepare(rows).drop("body")), scan, [*order, "segment_ordinal"])
    found = stub_results(packed, concerns)
    found = found.withColumn("reasons", F.when(F.col("decision") == "flag", F.array(F.struct(F.col("reason_code").alias("code"), F.lit("stub flag").alias("summary")))).otherwise(F.array().cast("array<struct<code:string,summary:string>>")))
    found = found.withColumn("evidence", F.when(F.col("decision") == "flag", F.array(F.struct(F.col("evidence").alias("text"), F.col("reason_code").alias("supports")))).otherwise(F.array().cast("array<struct<text:string,supports:string>>")))
    return roll_up(found, [scan, *order]).where(F.col("flagged") & F.col("category").isNotNull())
