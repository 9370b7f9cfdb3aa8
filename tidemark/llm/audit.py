"""Filter interaction audit: what each of several filters removes, in every order of applying them.

Joint failures are counted once for each set of filters, as sums of products of the filters' flags. Everything else
follows from these counts by inclusion-exclusion (Moebius inversion over subsets): the survivors of any set of filters,
what fails one filter only, what a filter finds already removed, and each filter's Shapley value by way of Harsanyi
dividends. So 32 sums a mark answer all 120 orders of five filters, and no order is applied to the rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fails A: fewer words. B: a smaller share of words is different (percent). C: a larger share of characters is A-Z (percent).
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS = 50, 65, 5
#: Fails D: any of these.
SYMBOLS = "#$%&*|"


def text_flags(text: Column) -> dict[str, Column]:
    """The failures A to D of a text, as 0 or 1; null counts as empty. An empty text fails A alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, capitals = F.size(words).cast("long"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": (n < LEAST_WORDS).cast("int"),
        "B": (100 * F.size(F.array_distinct(words)) < LEAST_DIFFERENT * n).cast("int"),
        "C": (100 * capitals > MOST_CAPITALS * F.length(text)).cast("int"),
        "D": text.rlike(f"[{SYMBOLS}]").cast("int"),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) for each row of docs; the flags and marks are 0 or 1.

    E: the text is that of a smaller id, anywhere in docs. Null texts are empty ones, a null part is the empty string. A
    null id is smaller than none, has none smaller, and no labels; rows of one id and text are no copies of each other.
    labels: (doc_id, quality, toxic); of several rows of an id any that says so marks it; null says nothing. No docs give
    no rows. Texts are read once; what is kept of a text is its digest and flags. The rows of a text with very many
    copies are dealt out to many tasks.
    """
    scratch = common.Scratch(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        common.text_key(text_col).alias("key"),
        *[flag.cast("byte").alias(name) for name, flag in text_flags(F.col(text_col)).items()],
    )
    rows = scratch.write("rows", rows)
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows without an id would all meet in one task of an outer join.
    some = rows.where(F.col("id").isNotNull()).join(marks.where("good = 1 OR toxic = 1"), "id", "left")
    none = F.lit(None).cast("int")
    rows = some.unionByName(rows.where(F.col("id").isNull()).select("*", none.alias("good"), none.alias("toxic")))
    copies = scratch.write("copies", rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1"))
    total = rows.count()
    out = common.spread_join(rows, copies.select("key", "first"), "key", copies.select("key", "n"), "id", "left", total)
    of = {"E": F.col("id") > F.col("first"), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    return out.select("part", "A", "B", "C", "D", *[F.coalesce(c.cast("int"), F.lit(0)).alias(name) for name, c in of.items()])


def subsets(k: int) -> list[list[int]]:
    """The members of each set of k filters, by its number: bit j stands for filter j."""
    return [[j for j in range(k) if s >> j & 1] for s in range(1 << k)]


def joint_failures(rows: DataFrame, filters: str, marks: tuple[str, ...]) -> DataFrame:
    """(part, n, and an array for each mark): by number of a set of filters, how many of the part's rows (and of those
    with the mark) fail them all: sums of products of flags, combined before they are exchanged.
    """
    sums = {}
    for s, members in enumerate(subsets(len(filters))):
        product = F.lit(1).cast("long")
        for j in members:
            product = product * F.col(filters[j])
        sums[f"n{s}"] = F.sum(product)
        for mark in marks:
            sums[f"{mark}{s}"] = F.sum(product * F.col(mark))
    found = rows.groupBy("part").agg(*[c.alias(name) for name, c in sums.items()])
    return found.select("part", *[F.array(*[F.col(f"{name}{s}") for s in range(1 << len(filters))]).alias(name) for name in ("n", *marks)])


def survivors(counts: str, k: int) -> Column:
    """By number of a set of filters, how many rows fail none of them: joint failures of its subsets with alternating signs."""
    return F.array(*[_signed(counts, [s for s in range(1 << k) if s & m == s], k) for m in range(1 << k)])


def _signed(counts: str, sets: list[int], k: int, weight: dict[int, int] | None = None, sign: int = 1) -> Column:
    out = F.lit(0).cast("long")
    for s in sets:
        size = s.bit_count()
        out = out + F.col(counts)[s] * (sign * (-1) ** size * (weight[size] if weight else 1))
    return out


def audit(rows: DataFrame, filters: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, lost by each mark, shapley) for each part, order
    of the filters (a letter each) and step, all counts.

    rows: part, a column of 0 or 1 for each filter and mark. The Shapley value is that of the game whose worth of a set of
    filters is what it removes; its dividends are the signed joint failures, shared alike by the members; the factorial of
    the number of filters makes it a whole number. A part has as many rows as orders and steps; there are as many
    columns as sets of filters, so filters should be few. No rows give none.
    """
    k = len(filters)
    # A dividend is shared alike by its members; so k! times it is whole.
    shares = {size: factorial(k) // size for size in range(1, k + 1)}
    of_filter = [[s for s in range(1 << k) if s >> j & 1] for j in range(k)]
    found = joint_failures(rows, filters, marks).select(
        "part",
        *[survivors(name, k).alias(f"{name}_kept") for name in ("n", *marks)],
        F.array(*[F.col("n")[1 << j] for j in range(k)]).alias("fails"),
        F.array(*[_signed("n", sets, k, sign=-1) for sets in of_filter]).alias("unique"),
        F.array(*[_signed("n", sets, k, shares, -1) for sets in of_filter]).alias("shapley"),
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    each = found.withColumn("filter_order", F.explode(orders)).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    before = sum((F.contains(F.left("filter_order", F.col("at")), F.lit(c)).cast("int") * (1 << j) for j, c in enumerate(filters)), F.lit(0))
    own = (F.array_position(F.array(*map(F.lit, filters)), F.substring("filter_order", F.col("at") + 1, F.lit(1))) - 1).cast("int")
    each = each.withColumn("before", before).withColumn("own", own).withColumn("after", F.col("before") + F.expr("shiftleft(1, own)"))

    def lost(name: str) -> Column:
        return F.get(f"{name}_kept", F.col("before")) - F.get(f"{name}_kept", F.col("after"))

    return each.select(
        "part",
        "filter_order",
        (F.col("at") + 1).alias("step"),
        F.get("n_kept", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (F.get("fails", F.col("own")) - lost("n")).alias("redundant"),
        F.get("unique", F.col("own")).alias("unique_fails"),
        *[lost(mark).alias(f"{mark}_lost") for mark in marks],
        F.get("shapley", F.col("own")).alias("shapley"),
    )


#: The same from flags of each row, order by order and step by step.
ORACLE_SQL = r"""
WITH
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(w.doc_id > first, false)::INT AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
p AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM f GROUP BY part, fails),
letters(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT o, s, bits[s] AS bit, list_sum(bits[1:s]) - bits[s] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS s)),
r AS (
  SELECT part, o, s, bit, coalesce(sum(n) FILTER ((fails & before::INT) = 0 AND (fails & bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER ((fails & before::INT) = 0 AND (fails & bit) > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER ((fails & before::INT) > 0 AND (fails & bit) > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER ((fails & before::INT) = 0 AND (fails & bit) > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(t) FILTER ((fails & before::INT) = 0 AND (fails & bit) > 0), 0)::BIGINT AS toxic_lost
  FROM p, steps GROUP BY part, o, s, bit)
SELECT part, o AS filter_order, s AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
