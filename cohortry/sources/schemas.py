"""Declared schemas of the input tables and their canonical column names.

Fixed values: the file column names are those of the published input tables.
Readers rename by name, never by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SCHEMAS = {
    "samples": "rna_ids string, patient_region string, patient string, tumour_id string",
    "events": "rna_ids string, patient_region string, samples string, symbol string, "
              "effect string, muttype_nostrand string, PASS_present string, PASS_homo_nt string, "
              "all_var_count bigint, all_cov bigint, all_vaf double, present_normal string",
    "hla": "patient string, hla_type string, allele string, hla_allele_type string",
    "immune": "patient_region string, immune_cat string, histology string",
    "purity": "Sample string, ManualCall string, `ASCAT.purity` string, `Adjust_ASCAT.purity` string",
    "binding": "CHROM string, POS bigint, REF string, ALT string, "
               "`NAG_netMHCpan.EL_Score` double, `NAG_netMHCpan.EL_GL_Score` double, "
               "`NAG_netMHCpan.BA_Score` double, `NAG_netMHCpan.EL_HLA` string",
    "cell_scores": "cell_type_title string, score double, residual double, sample_name string",
    "de_results": "gene_id string, logFC double, `adj.P.Val` double",
    "loh": "sample_name string, patient string, tumour_id string, gene string, allele1 string, "
           "allele2 string, cn1_binned double, cn2_binned double, loh string, wxs_pass string",
    "survival": "patient_region string, patient_id string, clinical_sex string, sex string, "
                "NSCLCstage string, dfs_time double, cens_dfs int, os_time double, cens_os int",
}

CANONICAL = {
    "rna_ids": "event", "patient_region": "sample", "tumour_id": "tumour",
    "samples": "sample_code", "symbol": "gene", "muttype_nostrand": "mut_type",
    "PASS_present": "pass_present", "PASS_homo_nt": "pass_homo",
    "all_var_count": "var_count", "all_cov": "coverage", "all_vaf": "level",
    "present_normal": "in_normal", "hla_type": "locus", "allele": "slot",
    "hla_allele_type": "allele", "immune_cat": "immune", "Sample": "sample",
    "ManualCall": "call", "ASCAT.purity": "purity_first", "Adjust_ASCAT.purity": "purity_adjusted",
    "CHROM": "chrom", "POS": "pos", "REF": "ref", "ALT": "alt",
    "NAG_netMHCpan.EL_Score": "el", "NAG_netMHCpan.EL_GL_Score": "el_wt",
    "NAG_netMHCpan.BA_Score": "ba", "NAG_netMHCpan.EL_HLA": "allele_key",
    "cell_type_title": "cell_type", "sample_name": "sample", "gene_id": "gene",
    "logFC": "log_fc", "adj.P.Val": "adj_p", "patient_id": "patient",
    "cn1_binned": "cn1", "cn2_binned": "cn2", "wxs_pass": "passed", "NSCLCstage": "stage",
}
PER_TABLE = {"loh": {"gene": "locus", "allele1": "allele1", "allele2": "allele2"},
             "survival": {"clinical_sex": "clinical_sex"}}
TEXT_FLAGS = {"events": ["pass_present", "pass_homo", "in_normal"], "loh": ["loh", "passed"]}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def canonical(df: DataFrame, table: str) -> DataFrame:
    """Canonical names, and text flags as booleans."""
    names = {**CANONICAL, **PER_TABLE.get(table, {})}
    out = df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})
    for flag in TEXT_FLAGS.get(table, []):
        if flag in out.columns:
            out = out.withColumn(flag, out[flag].try_cast("boolean"))
    return out
