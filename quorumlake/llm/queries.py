"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import decontamination, language_id, packing, periodic, quality_fm, quality_rules, repeats, secrets, simhash, spelling, toxicity, vafile, warc
from quorumlake.llm.shared import read

#: 4-word shingles, 64 bits, links of at most 4 bits.
OP7 = simhash.Plan(words=4, lanes=1, radius=4, blocks=6)
#: The index family takes the documents in so many batches, by text hash.
OP9_BATCHES = 4


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs through one ledger: the versions of even ids come first, and all of them a run later."""
    docs, ledger = read(spark, sf_dir, "documents").select("doc_id", "text"), secrets.Ledger(spark)
    ledger.scan(secrets.versions(docs.where("doc_id % 2 = 0")))
    rows = secrets.scan(docs, ledger)
    found, base = F.col("found"), secrets.BASE
    counts = [secrets.counted(found, k).alias(f"n_{r.kind}") for k, r in enumerate(base)]
    return rows.select("doc_id", *counts, F.sha2(secrets.digest(found, base), 256).alias("base_sha256"), secrets.digest(found, secrets.RULES).alias("spans"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.judge(read(spark, sf_dir, "documents")).select("doc_id", *base, "base_failed", "kept", "votes", "posterior")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents"), OP7)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read(spark, sf_dir, "documents"), batches=OP9_BATCHES).drop("kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(read(spark, sf_dir, "documents")).drop("runs", "collapsed")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_secret_scans": op2_secret_scans,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_quality_rules": op5_quality_rules,
        "op6_language_id": op6_language_id,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_warc": op8_warc,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_exact_top_k": op13_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scans": secrets.sql(),
        "op8_warc": warc.sql(),
        "op9_suffix_array_dedup": repeats.sql(),
        "op11_spelling_variants": spelling.sql(),
        "op12_periodic_runs": periodic.sql(),
        "op13_exact_top_k": vafile.sql(),
    }
