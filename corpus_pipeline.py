"""Corpus pipeline: quality, near copies, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes each stage's result as Parquet to the folder that all
executors share and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import fold, materialise, table
from lattica.llm.mixing import fit_domains, membership, mixed
from lattica.llm.quality import fit_quality, quality_score
from lattica.llm.queries import PIECE_MODEL
from lattica.llm.sentencepiece_scan import encode
from lattica.llm.simhash import near_copies, one_of_each
from lattica.llm.suffix_dedup import without_repeats

#: Target token shares of the mixing stage: clean text stays as it is, toxic text nearly goes.
WEIGHTS = {"clean": 0.999, "toxic": 0.001}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality score of 0.5 or more; learns from the labels of two of three id folds.

    Null texts score as empty ones, rows that are alike score alike; without labels of both classes all rows stay.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return docs.where(quality_score("text", model) >= 0.5)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id (null first) of every group of near copies (five-word shingles).

    Null, empty and wordless texts are one group; of repeated rows one stays; an empty table stays empty.
    """
    return one_of_each(docs, near_copies(docs, size=5))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 200 bytes or more that start at an earlier place too, the first copy stays; documents with nothing left go.

    Earlier goes by id (null first), then place.  Null and short texts stay as they are; an empty table gives none.
    """
    cut = without_repeats(docs)
    left = cut.where((F.size("spans") == 0) | (F.trim("text") != ""))
    size = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    fresh = {"text": F.col("text"), "n_chars": size}
    return left.select(*[(fresh[c] if c in fresh else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins documents to their fitted rates so that the token shares are ``WEIGHTS``.

    No rate exceeds 1, since repeated text has just been removed, and a document more likely clean than not keeps
    its rate of 1; the rest is drawn by a hash of the id.  Null texts are empty and rows that are alike are
    treated alike; without a labelled text, as in an empty table, all rows stay.
    """
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    model = fit_domains(docs, table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain")))
    if model is None:
        return docs
    members = docs.select(F.struct(*docs.columns).alias("row"), membership("text", model).alias("m"))
    rated = mixed(materialise(members.select("row", "m.tokens", "m.p")), model, WEIGHTS, keep="clean", id_col="row.doc_id", thin=True)
    return rated.where("copies > 0").select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and its text as decoded from them; a null text becomes an empty one without ids."""
    with open(PIECE_MODEL, "rb") as f:
        model = f.read()
    found = encode(docs, model, [c for c in docs.columns if c not in ("text", "n_tokens")])
    return found.withColumnRenamed("decoded", "text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL cannot express these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
