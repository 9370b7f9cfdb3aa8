"""Benchmark decontamination: a prefix-filtered exact join of benchmark windows with documents, in DataFrame functions.

A window is `size` consecutive words of an item (or all of a shorter item's). A text contains a window only if it has
the window's rarest word, so that word is the necessary prefix of the window's words in order of rarity. Documents give
a row for each place of such a word, with the words around it; the join on the word brings the windows, whose place in
the text follows from the word's place in the window; whole windows are then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SIZE = 10
#: Bytes of the Bloom filter that tells, before any row is made, whether a word can be one that is looked for. Its
#: size is fixed; a word that passes by chance costs a row, never a hit.
SLOTS, SEEDS = 1 << 16, (7, 8)


def words(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, any ASCII but letters and digits parts them. Null has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, common.UPPER, common.LOWER))
    return F.coalesce(F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""), F.array().cast("array<string>"))


def windows_of(items: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item string, window array<string>), a row for each window of each item. Items without words have none."""
    w = F.col("w")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    return (
        items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice(w, i, size))).alias("window"))
        .distinct()
    )


def slot(word: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(word, F.lit(seed)), F.lit(SLOTS)).cast("int")


def slot_map(frame: DataFrame, word_col: str) -> Column:
    """A literal of SLOTS bytes, 1 in each slot of the frame's words. At most SLOTS numbers reach the driver."""
    marks = bytearray(SLOTS)
    slots = F.explode(F.array(*[slot(F.col(word_col), s) for s in SEEDS]))
    for (k,) in frame.select(slots).distinct().collect():
        marks[k] = 1
    return F.lit(marks)


def marked(marks: Column, word: Column) -> Column:
    first, second = (F.substr(marks, slot(word, s) + 1, F.lit(1)) == F.lit(bytearray(b"\1")) for s in SEEDS)
    return first & second


def probes_of(windows: DataFrame, docs_words: DataFrame) -> DataFrame:
    """(word, offset, window): each distinct window with its rarest word, and that word's first place in it, from 0.

    Rarity is how often the word stands in all documents; equal counts go by the word.
    """
    each = windows.select("window").distinct()
    vocabulary = each.select(F.explode("window").alias("word")).distinct()
    marks = slot_map(vocabulary, "word")
    known = docs_words.select(F.explode(F.filter("words", lambda x: marked(marks, x))).alias("word"))
    counts = known.groupBy("word").agg(F.count("*").alias("n"))
    rated = (
        each.select("window", F.posexplode("window").alias("at", "word"))
        .join(vocabulary.join(counts, "word", "left"), "word")
        .select("window", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at").alias("rare"))
    )
    return rated.groupBy("window").agg(F.min("rare").alias("rare")).select("rare.word", F.col("rare.at").alias("offset"), "window")


def _search(rows: DataFrame, items: DataFrame, size: int, item_id_col: str, item_text_col: str, scratch: common.Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, found, copies) of rows (id, text): rows with key and n_words; (key, hits, items) of the texts with hits;
    (key, n) how many rows have a text.
    """
    split = rows.select("id", common.text_key("text").alias("key"), words(F.col("text")).alias("words"))
    windows = scratch.write("windows", windows_of(items, size, item_id_col, item_text_col))
    probes = scratch.write("probes", probes_of(windows, split.select("words")))
    marks = slot_map(probes, "word")
    w = F.col("words")
    places = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: marked(marks, F.get(w, i - 1)))
    around = F.transform(
        places,
        lambda i: F.struct(
            i.alias("at"),
            F.get(w, i - 1).alias("word"),
            F.greatest(i - (size - 1), F.lit(1)).alias("low"),
            F.slice(w, F.greatest(i - (size - 1), F.lit(1)), F.lit(2 * size - 1)).alias("near"),
        ),
    )
    each = scratch.write("places", split.select("id", "key", F.size(w).cast("long").alias("n_words"), F.when(F.size(w) > 0, around).alias("places")))
    copies = scratch.write("copies", each.groupBy("key").agg(F.count("*").alias("n")))
    start, length = F.col("at") - F.col("offset"), F.size("window")
    hits = (
        each.where(F.size("places") > 0)
        .groupBy("key")
        .agg(F.first("places").alias("places"))
        .select("key", F.explode("places").alias("p"))
        .select("key", "p.*")
        .join(probes, "word")
        .where((start >= 1) & (start >= F.col("low")))
        .where(F.slice("near", start - F.col("low") + 1, length) == F.col("window"))
        .select("key", start.alias("start"), length.alias("length"), "window")
    )
    hits = scratch.write("hits", hits)
    named = scratch.write("named", windows.groupBy("window").agg(F.collect_set("item").alias("items")))
    known = common.spread_join(hits, named, "window", hits.groupBy("window").agg(F.count("*").alias("n")), "key")
    found = known.groupBy("key").agg(
        F.collect_set(F.struct("start", "length")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    found = scratch.write("found", found)
    scratch.drop("windows", "probes", "hits", "named")
    return each.drop("places"), found, copies


def find(
    docs: DataFrame,
    items: DataFrame,
    size: int = SIZE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, key, n_words, hits array<struct<start,length>>, items array<string>) for each row of docs.

    hits: the word ranges (from 1) that equal a window; items: the ids, as strings and sorted, of the items of those
    windows. Null and empty texts have no words and no hits; items without words are never found; without items there
    are no hits. Equal texts share their hits; repeated rows and null ids give a row each; an empty table gives none.
    Other columns are left out, whatever their names.
    """
    scratch = common.Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    each, found, copies = _search(rows, items, size, item_id_col, item_text_col, scratch)
    return common.spread_join(each, found, "key", copies, "id", "left").select("id", "key", "n_words", "hits", "items")


def hit_words(hits: Column) -> Column:
    """How many words the ranges cover."""
    each = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))
    return F.coalesce(F.size(F.array_distinct(F.flatten(each))), F.lit(0)).cast("long")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w
  FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
v AS (
  SELECT DISTINCT item, w[s:s + 9] AS win FROM (
    SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT len(win) AS n FROM v),
p AS (
  SELECT r, s, n, w[s:s + n - 1] AS win FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, k WHERE len(w) >= n)),
h AS (SELECT p.r, p.s, p.n, v.item FROM p JOIN v ON p.win = v.win),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""


def remove(
    docs: DataFrame,
    items: DataFrame,
    size: int = SIZE,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no window of any item.

    Null and empty texts, and all texts if there are no items, stay; repeated rows stay or go together; an empty table
    stays empty; columns of any name stay.
    """
    scratch = common.Scratch(docs.sparkSession)
    kept = docs.select(common.as_rows(docs).alias("row"), common.text_key(text_col).alias("key"))
    one = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
    _, found, copies = _search(one, items, size, item_id_col, item_text_col, scratch)
    scratch.drop("places")
    return common.spread_join(kept, found.select("key"), "key", copies, "row", "left_anti").select("row.*")
