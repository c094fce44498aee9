"""The registered corpus queries: name to (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, html_text, license_scan, lm_score, packing, periodic_runs, quality, secrets, sharding, simhash, substring_dedup, url_filter, whitening

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_grouped_packing": packing.op2_grouped_packing,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_interleaved_shards": sharding.op4_interleaved_shards,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_main_text": html_text.op6_main_text,
    "op7_golay_simhash": simhash.op7_golay_simhash,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_class_lm": lm_score.op10_class_lm,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_whitening": whitening.op13_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op4_interleaved_shards": sharding.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op7_golay_simhash": simhash.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op11_periodic_runs": periodic_runs.ORACLE,
    "op12_url_filter": url_filter.ORACLE,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
