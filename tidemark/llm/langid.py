"""Language identification by compression: the language whose dictionary makes a text smallest.

Texts are compared as lower-cased words without digits and signs, so that decoration and capitals do not count.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bound of the training sample, by rows: of each language the text of least hash in each of SLOTS slots, and of these,
#: in order of hash, TEXTS, or more until they have FILL characters. Texts are taken whole.
SLOTS, TEXTS, FILL = 1024, 64, 100_000
#: Different languages that there can be; more are an error, since the sample grows with them.
LANGUAGES = 1000
#: Compression level.
LEVEL = 3
#: Relative lead over the second language under which a prediction is rejected.
MARGIN = 0.02

_LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """The text as it is compressed: words of lower-cased letters between single blanks."""
    return b" " + b" ".join(common.utf8((text or "").lower()).translate(_LETTERS).split()) + b" "


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, the most frequent language first; of equal sizes the first wins."""

    dictionaries: tuple[tuple[str, bytes], ...]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Builds the dictionaries from labelled rows; rows without text or language, and texts without a letter, are left out.

    The sample is chosen by hash of the text: the same whatever the order or the partitioning, and no larger for more
    rows. Repeated texts count once in it; languages of equally many rows go by name; without rows the model is empty.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(42)))
    letters = F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]")
    slots = rows.groupBy("lang", F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(
        F.count("*").alias("n"), F.min(F.when(letters, F.struct("h", F.length("text").alias("length")))).alias("least")
    )
    found = slots.groupBy("lang").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("least")).alias("least")).limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    wanted = []
    for r in found:
        total = 0
        for k, x in enumerate(r["least"]):
            if k >= TEXTS and total >= FILL:
                break
            wanted.append((r["lang"], x["h"]))
            total += x["length"]
    spark = labelled.sparkSession
    chosen = rows.join(F.broadcast(spark.createDataFrame(wanted, "lang string, h long")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    texts: dict[str, list[bytes]] = {r["lang"]: [] for r in found}
    for r in chosen.orderBy("lang", "h").collect():
        texts[r["lang"]].append(plain(r["text"]))
    order = sorted(found, key=lambda r: (-r["n"], r["lang"]))
    return Model(tuple((r["lang"], b"\n".join(texts[r["lang"]])) for r in order))


@functools.lru_cache(maxsize=2)
def _compressors(model: Model):
    import zstandard

    out = []
    for lang, data in model.dictionaries:
        # A dictionary has 8 bytes at least.
        enough = data * max(1, -(-8 // len(data))) if data.strip() else b""
        words = zstandard.ZstdCompressionDict(enough, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if enough else None
        if words:
            words.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, model: Model) -> tuple[str, float]:
    """(language, lead over the second as a share of its size). No letter or no model: ("und", 0)."""
    if not model.dictionaries or not any(map(str.isalpha, text or "")):
        return "und", 0.0
    data = plain(text)
    sizes = [(len(c.compress(data)), k, lang) for k, (lang, c) in enumerate(_compressors(model))]
    best = min(sizes)
    rest = min((s for s, k, _ in sizes if k != best[1]), default=best[0])
    return best[2], (rest - best[0]) / rest if len(sizes) > 1 else 1.0


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(id, lang_pred, score, accepted) for each row. score: the lead, 0 to 1; accepted: whether it reaches margin.

    A text that is null or has no letter gets und, score 0, not accepted. Only the text counts. Repeated rows and null
    ids give a row each, an empty table none; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(x: dict[str, list]) -> dict[str, list]:
        found = [classify(t, shared.value) for t in x[text_col]]
        return {
            "id": x[id_col],
            "lang_pred": [lang for lang, _ in found],
            "score": [s for _, s in found],
            "accepted": [lang != "und" and s >= margin for lang, s in found],
        }

    schema = f"{common.ddl(docs, id_col, 'id')}, lang_pred string, score double, accepted boolean"
    return common.map_batches(docs.select(id_col, text_col), schema, run)
