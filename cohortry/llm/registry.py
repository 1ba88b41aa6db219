"""Registered queries of the document operators and their SQL twins."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Module of each query; a module registers its query under ``opN_<name>``.
MODULES = ["bpe", "packing", "token_files", "exact_dedup", "sharding", "license_scan", "language_id", "line_labels",
           "quality_rules", "jaccard_join", "vector_codes",
           "suffix_dedup", "periodic_runs"]


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def load() -> None:
    for name in MODULES:
        import_module(f"cohortry.llm.{name}")
