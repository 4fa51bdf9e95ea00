"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_turns, unescape
from .common import fold, materialise, table, text_or_empty
from .langid import fit_languages, identify
from .minhash import edited_fingerprints
from .mixing import fit_domains, membership, mixed
from .quality import fit_quality, quality_score
from .runs import collapse_runs
from .secrets import RULES, find_secrets
from .sentencepiece_scan import encode
from .sharding import feistel_shards
from .simhash import near_duplicates
from .suffix_dedup import digest_rows, repeated_spans
from .topk import exact_topk, scaled
from .vector_codes import compressed, digest

#: The public SentencePiece model that op4 and the pipeline encode with; a parameter of both.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Target shares of the domains' tokens in op3.
MIX_WEIGHTS = {"clean": 0.90, "poor": 0.05, "toxic": 0.05}

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from the texts and labels of four of five id folds.

    ``score`` compares the two best languages (see :func:`identify`); ``und`` and 0 for null texts and texts without letters.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 5) == 0).alias("held_out"))
    model = fit_languages(docs.where("not held_out"))
    return identify(docs, model, ["doc_id", "held_out"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda parts: hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
            turns, loss = read_turns(text), [unescape(text[s["start"] : s["end"]]) for s in spans]
            values = conv, len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, loss)), sha(loss), len(text)
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in out.items()], [*out])


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, formatted and read back: digests of its turns and of what the loss covers.

    Turns go by ``turn`` (null first), role and text; null roles and texts are empty; rows of a null id are one conversation.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], turns.schema)
    formatted = format_conversations(turns.unionByName(extra))
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def label_domains(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: ``toxic``, else ``poor`` or ``clean`` by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of every document for the token shares ``MIX_WEIGHTS``.

    Null texts are empty; equal texts have equal rates; without a labelled text every rate is 1.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_domains(docs, label_domains(table(spark, sf_dir, "labels")))
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("long").alias("tokens"), *[F.lit(0.0).alias(f"p_{d}") for d in MIX_WEIGHTS], F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    members = materialise(docs.select("doc_id", membership("text", model).alias("m")).select("doc_id", "m.tokens", "m.p"))
    found = mixed(members, model, MIX_WEIGHTS)
    names = {d: F.round(F.col("p")[k], 9).alias(f"p_{d}") for k, d in enumerate(model.domains)}
    return found.select("doc_id", "tokens", *[names.get(d, F.lit(0.0).alias(f"p_{d}")) for d in MIX_WEIGHTS], F.round("rate", 9).alias("rate"), "copies")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    """Token ids of every whole text and whether they give the text back; null texts have none."""
    with open(model_path, "rb") as f:
        model = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length(text_or_empty("text")).cast("long").alias("n_chars"), F.sha2(text_or_empty("text"), 256).alias("text_sha256"))
    found = encode(docs, model, ["doc_id", "n_chars", "text_sha256"], remember=500_000)
    return found.select(
        "doc_id", "n_chars", F.col("chunks").alias("n_chunks"), F.size("ids").cast("long").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"), "ids",
    )


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 200-byte strings that start twice; all copies go, null texts are empty."""
    docs, covers = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = docs.join(covers, ["doc", "th", "tn"], "left").select("doc_id", "text", "covers")
    return joined.mapInArrow(digest_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text; the next document goes by id (null first), then text."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null texts are empty, texts without words have fingerprint 0."""
    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, learnt from the labels of two of three id folds; empty and null texts score alike."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    scored = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), quality_score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over eight shards, counts at most one apart; null texts have size 1; equal rows get places of their own."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_or_empty("text")) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty("text")).alias("text_crc32"),
    )
    placed = feistel_shards(docs, ["doc_id", "size", "text_crc32"], shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of each vector whose id is divisible by 20; ties go to the smaller id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("v"))
    return exact_topk(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "v", k=20)


def planted_runs(text: Column, doc_id: str) -> Column:
    """The text whose words repeat from a place on, in one of ten documents: place and period follow from crc32 of the id (null: 0)."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.array(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    changed = F.transform(words, lambda ws: F.when(F.size(ws) > 0, repeated(ws)))[0]  # words are split once, not once a word
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated word sequences of every whole text and what is left of it; a null id has the hash 0, null texts are empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_runs(text_or_empty("text"), "doc_id").alias("text"))
    found = collapse_runs(docs, ["doc_id"])
    first = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(1).cast("long").alias("period"))
    better = lambda b, r: r["length"] * b["period"] > b["length"] * r["period"]  # noqa: E731  runs go by start, then period: of equals the first stays
    best = F.when(F.size("runs") > 0, F.aggregate("runs", first, lambda b, r: F.when(better(b, r), r).otherwise(b)))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(lines, "").alias("lines")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: spans of the rules, and with them those of high entropy; null texts are empty."""
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "secrets")
    kinds = [r.kind for r in RULES]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[number(k) for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector after six rounds on eight parts of sixteen entries; unusable vectors take no part."""
    found, books = compressed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


OP2_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)
), l as (
  select *, length(role) - length(translate(role, '\<>', '')) + length(text) - length(translate(text, '\<>', '')) as escaped from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(16 + length(role) + length(text) + escaped) as bigint) as formatted_chars
from l group by conv_id
"""

OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id
  where q.vec_id % 20 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""


def _op13_sql(rounds: int = 6) -> str:
    """k-means by whole numbers, a pair of CTEs a round; parts, entries and places count from 0."""
    steps = [f"""v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
  select vec_id, label, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) as v from v, range(0, 8) t(p)
), book0 as materialized (
  select p, e, parts.v from parts join (select vec_id, row_number() over (order by vec_id) - 1 as e from v) using (vec_id) where e < 16
)"""]
    near = "(select vec_id, label, parts.p, parts.v, e, cast(list_sum(list_transform(list_zip(parts.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from parts join book{k} b on b.p = parts.p)"
    for k in range(rounds):
        steps.append(f"""own{k} as materialized (select vec_id, p, v, arg_min(e, d * 16 + e) as e from {near.format(k=k)} group by vec_id, p, v),
means{k} as materialized (select p, e, list(m order by i) as v from (
  select p, e, i, cast(floor(sum(v[i]) / count(*)) as bigint) as m from own{k}, range(1, 1 + len(v)) t(i) group by p, e, i) group by p, e),
book{k + 1} as materialized (select p, e, coalesce(m.v, b.v) as v from book{k} b left join means{k} m using (p, e))""")
    steps.append(f"""coded as materialized (select vec_id, any_value(label) as label, p, arg_min(e, d * 16 + e) as e, min(d) as d from {near.format(k=rounds)} group by vec_id, p),
whole as (select vec_id, any_value(label) as label, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from coded group by vec_id)""")
    last = f"sha256((select string_agg(array_to_string(v, ','), ',' order by p, e) from book{rounds}))"
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, {last} as codebooks_sha256 from whole"


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_chat_formatting": op2_chat_formatting,
        "op10_quality_classifier": op10_quality_classifier,
        "op3_mixing": op3_mixing,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_document_fingerprints": op6_document_fingerprints,
        "op7_sharding": op7_sharding,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_exact_topk": op9_exact_topk,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_secret_scan": op12_secret_scan,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": OP2_SQL, "op9_exact_topk": OP9_SQL, "op13_vector_codes": _op13_sql()}
