"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, filter_audit, lm_scoring, mixing, near_dup, pii, quality, suffix_dedup, token_counts, token_output, toxicity, warc
from .shared import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": lambda s, d: token_output.token_table(documents(s, d)),
    "op2_separator_scan": lambda s, d: token_counts.token_counts(documents(s, d)),
    "op3_contextual_pii": lambda s, d: pii.personal_data(documents(s, d)),
    "op4_suffix_merge_dedup": lambda s, d: suffix_dedup.remove_repeats(documents(s, d), passages=True),
    "op5_systematic_mix": lambda s, d: mixing.mix_report(documents(s, d)),
    "op6_circulant_minhash": lambda s, d: near_dup.near_duplicates(documents(s, d)),
    "op7_template_decontamination": lambda s, d: decontaminate.leaks(documents(s, d), _table(s, d, "benchmark")),
    "op8_elias_fano_lm": lambda s, d: lm_scoring.lm_scores(documents(s, d)),
    "op9_nnpu_toxicity": lambda s, d: toxicity.toxicity(documents(s, d), _table(s, d, "labels")),
    "op10_decision_list": lambda s, d: quality.quality(documents(s, d), _table(s, d, "labels")),
    "op11_filter_audit": lambda s, d: filter_audit.audit(documents(s, d), _table(s, d, "labels")),
    "op12_source_divergence": lambda s, d: divergence.divergences(documents(s, d)),
    "op13_zip_archives": lambda s, d: warc.archive_report(_table(s, d, "pages")),
}

ORACLES: dict[str, str] = {
    "op5_systematic_mix": mixing.ORACLE_SQL,
    "op6_circulant_minhash": near_dup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
    "op13_zip_archives": warc.ORACLE_SQL,
}
