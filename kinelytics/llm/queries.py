"""The thin ``opN_<name>`` queries: each applies its operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated, decontaminate, hit_words

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13).drop("text")
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import id_hash
    from .language import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_hash("doc_id", 4) == 2
    model = fit(docs, ~held)
    found = identify(docs.drop("lang"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


#: Tests and benchmarks need pseudonyms that can be compared; a deployment passes its own secret to ``pseudonymize``.
PII_KEY = "kinelytics-demonstration-key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    found = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    spans = F.transform("pii", lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string")))
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_join(spans, ",").alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import id_hash
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_hash("doc_id", 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), ~held)
    found = score(docs, model, name="score")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The model file's path; the file is read on the driver and never copied into the repository.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    from .pieces import encode, read_model

    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), read_model(model))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "parity", "round_trip")


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import PATTERNS, listing, number, scan

    found = scan(table(spark, sf_dir, "documents"))
    counts = [number("base_spans", kind).alias(f"n_{kind}") for kind in PATTERNS]
    every = F.array_sort(F.concat("base_spans", "random_spans"))
    return found.select("doc_id", *counts, F.sha2(listing(F.col("base_spans")), 256).alias("base_sha256"), listing(every).alias("spans"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


#: Rank file of the subwords that the language model is built on; read on the driver.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op9_attention(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    from .attention import fit_score, read_ranks
    from .common import id_hash

    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), id_hash("doc_id", 7) == 2
    found = fit_score(docs, ~held, read_ranks(ranks))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, budget=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_pii, op4_toxicity, op5_sentencepiece, op6_url_reputation, op7_secrets, op8_media, op9_attention, op10_simhash)}
