"""Document fingerprints by one-permutation MinHash, in built-in Spark functions only.

Every five-word shingle is hashed once; the top bits of the hash choose a bin and the bin keeps
its smallest hash.  Empty bins copy a filled one (optimal densification, Shrivastava 2017): a bin draws bins by
independent hashes of (bin, attempt) until one is filled.  After ``ATTEMPTS`` draws the filled bin with the least
hash of (bin, filled bin) is taken, which is as uniform and as independent of the other bins, and always ends.
The fingerprint stores the low bits of each bin; likeness is the share of
equal bins, freed of the chance agreement of so few bits (Li and Koenig 2010).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty

BIN_BITS, LOW_BITS, WORDS, ATTEMPTS = 8, 8, 5, 16
BINS = 1 << BIN_BITS
_EMPTY = (1 << (64 - BIN_BITS)) - 1


def _ints(values: list[int], kind: str) -> Column:
    return F.from_json(F.lit(str(values)), f"array<{kind}>")


def drawn(b: int, attempt: int) -> int:
    """The bin that bin ``b`` draws in an attempt."""
    return int.from_bytes(hashlib.sha256(f"{b}:{attempt}".encode()).digest()[:4], "big") % BINS


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """XXH64-based hash of each run of ``words`` words; all words where there are fewer; none without words."""
    split = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    # a one-element list binds the words, so that they are split once a text
    per_text = F.transform(F.array(split), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, words)))).otherwise(F.array().cast("array<bigint>")))
    return F.element_at(per_text, 1)


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` plus ``out``: an array of low bits, one a bin; empty for a text without words."""
    top = lambda x: F.shiftright(x, 64 - BIN_BITS)
    filled = lambda x: x.bitwiseAND(F.lit(_EMPTY)) != F.lit(_EMPTY)
    # the largest value of every bin joins the hashes: after sorting, each bin is there and shows if it was empty
    ends = [((b - BINS // 2) << (64 - BIN_BITS)) | _EMPTY for b in range(BINS)]
    df = df.withColumn("_h", shingle_hashes(F.col(text_col)))
    df = df.withColumn("_n", F.size("_h")).withColumn("_s", F.sort_array(F.concat("_h", _ints(ends, "bigint")))).drop("_h")
    df = df.withColumn("_m", F.filter("_s", lambda x, i: (i == 0) | (top(x) != top(F.get(F.col("_s"), i - 1))))).drop("_s")
    df = df.withColumn("_draw", _ints([drawn(b, t) for b in range(BINS) for t in range(ATTEMPTS)], "int"))
    df = df.withColumn("_held", F.filter("_m", filled))

    def donor(b: Column) -> Column:
        at = lambda t: F.get(F.col("_m"), F.get(F.col("_draw"), b * ATTEMPTS + t))
        hit = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), at), filled), F.lit(0))
        least = F.array_min(F.transform("_held", lambda x: F.struct(F.xxhash64(b, top(x)).alias("h"), x.alias("x"))))
        return F.coalesce(hit, least["x"])

    low = F.transform("_m", lambda x, b: F.when(filled(x), x).otherwise(donor(b)).bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int"))
    return df.withColumn(out, F.when(F.col("_n") > 0, low).otherwise(F.array().cast("array<int>"))).drop("_n", "_m", "_draw", "_held")


def packed(fingerprint: Column) -> Column:
    """The fingerprint as lowercase hex, two digits a bin; the empty text without bins."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), LOW_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; two texts without words are alike, one is not."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-LOW_BITS
    estimate = F.greatest((same / BINS - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(estimate)


def beside_next(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> tuple[DataFrame, Window]:
    """Rows in ``buckets`` ranges of the id, each with the first row of the range after it, and their window.

    ``_extra`` is 1 for the added rows.  Ranges come from approximate quantiles of the id, so no
    task holds more than its share; null ids come first.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    df = docs.select(id_col, text_or_empty(text_col).alias("_t"), key.alias("_k"))
    cuts = sorted({*df.stat.approxQuantile("_k", [i / buckets for i in range(1, buckets)], 0.2 / buckets)})
    bounds = _ints([int(c) for c in cuts], "bigint")
    df = df.withColumn("_b", F.size(F.filter(bounds, lambda c: c <= F.col("_k"))))
    least = sorted((r["_b"], r["m"]) for r in df.groupBy("_b").agg(F.min("_k").alias("m")).collect())  # one row a range
    before, first = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, (b, m) in enumerate(least):
        before[b], first[b] = least[i - 1][0], m
    there = F.struct(F.col("_b").alias("b"), F.lit(0).alias("extra"))
    ahead = F.struct(F.get(_ints(before, "int"), F.col("_b")).alias("b"), F.lit(1).alias("extra"))
    places = F.when(F.col("_k") == F.get(_ints(first, "bigint"), F.col("_b")), F.array(there, ahead)).otherwise(F.array(there))
    df = df.withColumn("_p", F.explode(places)).select(id_col, "_t", "_k", F.col("_p.b").alias("_b"), F.col("_p.extra").alias("_extra"))
    return df, Window.partitionBy("_b").orderBy("_extra", "_k", "_t")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every whole text, of the text edited with its successor's beginning, and likenesses.

    Null texts are empty.  The successor goes by id, then text; the last row's is the first.
    Repeated ids and rows stay rows of their own; texts of any length are taken whole; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    df, by_id = beside_next(docs, id_col, text_col, buckets)
    df = df.withColumn("_next", F.lead("_t").over(by_id)).withColumn("n_chars", F.length("_t").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("_t", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("_next", F.lit(1), half))
    df = df.withColumn("_e", F.when(F.col("_extra") == 0, edited).otherwise("")).drop("_next")
    df = with_fingerprint(with_fingerprint(df, "_t", "_f"), "_e", "_g")
    df = df.withColumn("edited_sha256", F.sha2("_e", 256))
    df = df.select(id_col, "n_chars", "edited_sha256", "_f", "_g", "_b", "_extra", "_k", "_t").withColumn("_next", F.lead("_f").over(by_id))
    return df.where("_extra = 0").select(
        id_col, "n_chars", "edited_sha256",
        packed(F.col("_f")).alias("fingerprint"), packed(F.col("_g")).alias("edited_fingerprint"),
        likeness(F.col("_f"), F.col("_g")).alias("near_edited"), likeness(F.col("_f"), F.col("_next")).alias("near_next"),
    )
