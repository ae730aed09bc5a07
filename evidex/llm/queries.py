"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: module and function, called with the whole tables it names.
_OPS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "op1_quality_bradley_terry": ("quality", "score_quality", ("documents", "labels")),
    "op2_greedy_string_tiling": ("decontaminate", "tiled", ("documents", "benchmark")),
    "op9_toxicity_mil": ("toxicity", "score_toxicity", ("documents", "labels")),
    "op3_mix_sainte_lague": ("mixing", "mix", ("documents",)),
    "op4_simhash_covering": ("simhash", "components", ("documents",)),
    "op5_secret_ledger": ("secrets", "digest", ("documents",)),
    "op6_language_crf": ("language_id", "identify", ("documents",)),
    "op7_packed_token_ids": ("tokens", "round_trip", ("documents",)),
    "op8_deleted_interpolation": ("language_model", "score", ("documents",)),
    "op10_merkle_fingerprint": ("merkle", "digest", ("documents",)),
    "op11_spelling_variants": ("spelling", "digest", ("documents",)),
    "op12_best_fit_packing": ("packing", "digest", ("documents",)),
    "op13_periodic_runs": ("periodic", "digest", ("documents",)),
}
#: Queries that SQL can express.
_SQL = {
    "op3_mix_sainte_lague": "mixing",
    "op5_secret_ledger": "secrets",
    "op10_merkle_fingerprint": "merkle",
    "op11_spelling_variants": "spelling",
    "op13_periodic_runs": "periodic",
}


def _query(module: str, function: str, tables: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = getattr(import_module(f"{__package__}.{module}"), function)
        return own(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

    return run


def queries() -> dict:
    import corpus_pipeline

    return {name: _query(*spec) for name, spec in _OPS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"{__package__}.{module}").ORACLE_SQL for name, module in _SQL.items()}
