"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import conversation_repair, crf_quality, decontaminate, html_extract, lm_score, mixing, nearest, periodic_runs, pii, quality_rules, simhash_dedup, substring_dedup, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(op, *names):
    return lambda spark, sf_dir: op(*(table(spark, sf_dir, n) for n in names))


QUERIES = {
    "op1_substring_dedup": _of(substring_dedup.op1, "documents"),
    "op2_quality_rules": _of(quality_rules.op2, "documents"),
    "quality_ablations": _of(quality_rules.ablations, "documents"),
    "op3_html_extraction": _of(html_extract.op3, "pages"),
    "op4_decontamination": _of(decontaminate.op4, "documents", "benchmark"),
    "op5_mixing": _of(mixing.op5, "documents", "labels"),
    "op6_simhash_dedup": _of(simhash_dedup.op6, "documents"),
    "op7_token_output": _of(token_files.op7, "documents"),
    "op8_quality_classifier": _of(crf_quality.op8, "documents", "labels"),
    "op9_pii": _of(pii.op9, "documents"),
    "op10_lm_scoring": _of(lm_score.op10, "documents"),
    "op11_nearest": _of(nearest.op11, "embeddings"),
    "op12_periodic_runs": _of(periodic_runs.op12, "documents"),
    "op13_conversation_repair": _of(conversation_repair.op13, "conversations"),
}
SQL = {"op2_quality_rules": quality_rules.SQL, "quality_ablations": quality_rules.ABLATION_SQL, "op11_nearest": nearest.SQL}
