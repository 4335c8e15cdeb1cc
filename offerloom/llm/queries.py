"""The registered query of each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, license_scan, lm_score, near_dup, personal_data, quality, ranked_search, repeats, runs, secret_scan, sql, token_store, warc, word_score
from .common import fresh_path


#: Some 200 good labels of a stratum certify a cutoff at this risk.
LOOSER = 0.03


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(_read(spark, sf_dir, "pages"), path, least_bytes=100)
    return warc.read_pages(spark, path).drop("url")


def op3_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def quality_at_looser_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts at a risk that the labels of small tables can certify too."""
    return quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), risk=LOOSER)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), tokenizer_file())


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"), span=200)


def op6_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_store.write_tokens(_read(spark, sf_dir, "documents"), path, tokenizer_file(), end_id=0)
    return token_store.checksums(token_store.read_tokens(spark, path))


def op7_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = word_score.word_scores(_read(spark, sf_dir, "documents"))
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def byte_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.lm_scores(_read(spark, sf_dir, "documents"))
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op8_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents")).drop("found", "rid")


def op9_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(_read(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), k=4, percent=80)


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.with_planted_period(_read(spark, sf_dir, "documents")), power=4, least=6)
    best = F.col("best")
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digests = {"runs_sha256": F.sha2(F.array_join(told, ""), 256), "collapsed_sha256": F.sha2("collapsed", 256)}
    found = found.withColumn("best", runs.strongest(F.col("runs")))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), *[c.alias(k) for k, c in digests.items()])


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.scan(_read(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in personal_data.KINDS[:4]]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("found").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_warc_revisits, op3_risk_controlled_quality, op4_bpe_round_trip, op5_repeated_substrings, op6_token_parquet, op7_word_backoff, op8_multipart_secrets, op9_license_dice, op10_minhash_near_dedup, op11_tiered_search, op12_periodic_runs, op13_personal_data, byte_backoff, quality_at_looser_risk)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have one. Repeated substrings, BPE, its files,
    secrets (which look behind and ahead), runs (CRC-32) and what trees decide
    can't be written in DuckDB's."""
    found = {
        "op1_benchmark_decontamination": sql.contained_items(k=5, threshold=0.8),
        "op2_warc_revisits": sql.revisits(least_bytes=100),
        "op3_risk_controlled_quality": sql.quality_rules(quality.RISK),
        "quality_at_looser_risk": sql.quality_rules(LOOSER),
        "op7_word_backoff": sql.word_scores(),
        "byte_backoff": sql.backoff_scores(),
        "op9_license_dice": sql.license_matches(),
        "op10_minhash_near_dedup": sql.near_duplicates(k=4, percent=80),
        "op11_tiered_search": sql.ranked_search(k=10),
    }
    return {k: v for k, v in found.items() if v}
